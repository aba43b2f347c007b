"""Scores of predictions: the G family, on nations and their customers."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodeframe.functions import metrics as m
from lodeframe.operators import alignment
from lodeframe.plans.bindings import HISTORY, Registry, history
from lodeframe.session import table

query = Registry()


@query(f"""WITH {HISTORY}, a AS (
  SELECT unit_id, count(*) AS n, avg(abs(point - y)) AS mae, avg(abs(naive - y)) AS naive_mae,
    avg(high - low + 20.0 * (greatest(low - y, 0) + greatest(y - high, 0))) AS loss,
    avg(naive_high - naive_low + 20.0 * (greatest(naive_low - y, 0) + greatest(y - naive_high, 0))) AS naive_loss,
    avg(CASE WHEN low <= y AND y <= high THEN 1.0 ELSE 0.0 END) AS coverage
  FROM history WHERE low IS NOT NULL GROUP BY unit_id
), q AS (SELECT *, naive_mae / (naive_mae + mae) AS quality, naive_loss / (naive_loss + loss) AS raw FROM a)
SELECT unit_id, n, round(mae, 3) AS mae, round(quality, 8) AS quality, round(raw, 8) AS interval_quality, round(least(raw, greatest(0.5, quality)), 8) AS capped,
  round(coverage, 8) AS coverage, round(0.7 * quality + 0.3 * least(raw, greatest(0.5, quality)), 8) AS composite FROM q""")
def g_composite(spark, sf):
    """Error ratio, interval score, cap, coverage and composite of each unit."""
    rows = history(spark, sf).filter("low is not null")
    y = F.col("y")
    each = rows.groupBy("unit_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.abs(F.col("point") - y)).alias("mae"),
        F.avg(F.abs(F.col("naive") - y)).alias("naive_mae"),
        F.avg(m.interval_loss(F.col("low"), F.col("high"), y)).alias("loss"),
        F.avg(m.interval_loss(F.col("naive_low"), F.col("naive_high"), y)).alias("naive_loss"),
        m.covered(F.col("low"), F.col("high"), y).alias("coverage"),
    )
    q = each.withColumn("quality", m.error_ratio(F.col("mae"), F.col("naive_mae"))).withColumn("raw", m.ratio_quality(F.col("loss"), F.col("naive_loss")))
    q = q.withColumn("cap", m.capped(F.col("raw"), F.col("quality")))
    return q.select("unit_id", "n", F.round("mae", 3).alias("mae"), F.round("quality", 8).alias("quality"), F.round("raw", 8).alias("interval_quality"), F.round("cap", 8).alias("capped"), F.round("coverage", 8).alias("coverage"), F.round(m.clipped(m.composite(F.col("quality"), F.col("cap"))), 8).alias("composite"))


@query("SELECT lang, count(*) AS n, round(avg(CASE WHEN (n_chars >= 600)::INT = quality THEN 1.0 ELSE 0.0 END), 8) AS accuracy FROM documents JOIN labels USING (doc_id) GROUP BY lang")
def g1_accuracy(spark, sf):
    """G1: the share of labels that a rule predicts."""
    both = table(spark, sf, "documents").select("doc_id", "lang", (F.col("n_chars") >= 600).cast("int").alias("p")).join(table(spark, sf, "labels"), "doc_id")
    return both.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.round(m.accuracy(F.col("p"), F.col("quality")), 8).alias("accuracy"))


@query("""WITH d AS (SELECT lang, (n_chars >= 600)::INT AS p, quality FROM documents JOIN labels USING (doc_id)),
a AS (SELECT lang, avg((p = quality)::INT) AS q, avg((quality = 1)::INT) AS naive FROM d GROUP BY lang)
SELECT lang, round(CASE WHEN q >= naive THEN CASE WHEN naive > 1 - 1e-12 THEN 1.0 ELSE 0.5 + 0.5 * (q - naive) / (1 - naive) END ELSE CASE WHEN naive > 0 THEN 0.5 * q / naive ELSE 0.5 END END, 8) AS anchored FROM a""")
def g7_anchored(spark, sf):
    """Quality anchored to the rule that always says the good label."""
    both = table(spark, sf, "documents").select("doc_id", "lang", (F.col("n_chars") >= 600).cast("int").alias("p")).join(table(spark, sf, "labels"), "doc_id")
    a = both.groupBy("lang").agg(m.accuracy(F.col("p"), F.col("quality")).alias("q"), m.accuracy(F.lit(1), F.col("quality")).alias("naive"))
    return a.select("lang", F.round(m.anchored(F.col("q"), m.anchor_of(F.col("naive"), F.lit("classification"))), 8).alias("anchored"))


@query(f"""WITH {HISTORY}, r AS (
  SELECT unit_id, rank() OVER (PARTITION BY unit_id ORDER BY x) + (count(*) OVER (PARTITION BY unit_id, x) - 1) / 2.0 AS rx,
    rank() OVER (PARTITION BY unit_id ORDER BY y) + (count(*) OVER (PARTITION BY unit_id, y) - 1) / 2.0 AS ry
  FROM (SELECT unit_id, round(point / 20000) AS x, y FROM history WHERE point IS NOT NULL)
), q AS (SELECT unit_id, (CASE WHEN stddev_pop(rx) * stddev_pop(ry) > 0 THEN covar_pop(rx, ry) / (stddev_pop(rx) * stddev_pop(ry)) ELSE 0 END + 1) / 2 AS q FROM r GROUP BY unit_id)
SELECT unit_id, round(q, 8) AS rank_quality, round(CASE WHEN q >= 0.5 THEN 0.5 + (q - 0.5) ELSE q END, 8) AS anchored FROM q""")
def g3_ranking(spark, sf):
    """Spearman with ties, rescaled, and held against the constant rule."""
    rows = history(spark, sf).filter("point is not null").select("unit_id", F.round(F.col("point") / 20000).alias("x"), "y")
    q = m.rank_quality(rows, ["unit_id"], "x", "y")
    return q.select("unit_id", F.round("rank_quality", 8).alias("rank_quality"), F.round(m.anchored(F.col("rank_quality"), m.anchor_of(F.lit(0.0), F.lit("ranking"))), 8).alias("anchored"))


@query("""WITH c AS (SELECT l_orderkey, count(*) AS n, count(*) FILTER (l_returnflag = 'R') AS f, count(DISTINCT l_suppkey) AS e FROM lineitem GROUP BY 1)
SELECT l_orderkey AS answer, n, f, CASE WHEN f = 0 THEN 1.0 ELSE round(1 - f / (f + least(n - f, 3 * e)), 8) END AS factor, round(1 - f / n, 8) AS faithfulness,
  round(0.8 * CASE WHEN f = 0 THEN 1.0 ELSE 1 - f / (f + least(n - f, 3 * e)) END, 8) AS penalised FROM c""")
def g11_soft_floor(spark, sf):
    """The padding-proof factor of each answer, its share and the penalised score."""
    c = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("answer")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("f"), F.count_distinct("l_suppkey").alias("e"))
    factor = m.soft_floor(F.col("f"), F.col("n"), F.col("e"))
    return c.select("answer", "n", "f", F.round(factor, 8).alias("factor"), F.round(m.faithful_share(F.col("f"), F.col("n")), 8).alias("faithfulness"), F.round(0.8 * factor, 8).alias("penalised"))


@query("""SELECT c_custkey AS answer, CASE WHEN c_acctbal < 0 THEN 0.0 ELSE round(least(1, c_acctbal / 8000), 11) END AS score,
  round(-0.27 + 1.27 * CASE WHEN c_acctbal < 0 THEN 0.0 ELSE least(1, c_acctbal / 8000) END + 0.25 * CASE WHEN c_custkey % 2 = 0 THEN 0.5 ELSE 0 END, 11) AS shown FROM customer""")
def g15_worst_case(spark, sf):
    """Failures keep the worst score; clipping; the display transform."""
    score = m.with_worst_case(F.col("c_acctbal") / 8000, F.col("c_acctbal") < 0)
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("answer"), F.round(score, 11).alias("score"), F.round(m.leaderboard(score, F.when(F.col("c_custkey") % 2 == 0, 0.5)), 11).alias("shown"))


PLANTED = """SELECT c_nationkey AS unit, CASE WHEN c_nationkey % 6 = 5 THEN 'classification' ELSE 'regression' END AS target_type,
  CASE c_nationkey % 6 WHEN 1 THEN CASE WHEN c_custkey % 2 = 0 THEN NULL ELSE c_acctbal END WHEN 2 THEN CASE WHEN c_custkey % 3 = 0 THEN 'NaN'::DOUBLE ELSE c_acctbal END WHEN 5 THEN NULL ELSE c_acctbal END AS y,
  CASE WHEN c_nationkey % 6 = 4 OR (c_nationkey % 6 = 1 AND c_nationkey > 10) THEN NULL WHEN c_nationkey % 6 = 3 THEN NULL ELSE 'up' END AS true_label FROM customer"""


@query(f"""WITH p AS ({PLANTED}) SELECT unit, CASE WHEN count(*) FILTER (y IS NULL AND true_label IS NULL) > 0 THEN 'uncovered' WHEN count(*) FILTER (isnan(y)) > 0 THEN 'not_finite'
  WHEN count(y) > 0 AND count(y) < count(*) THEN 'partly_numeric' WHEN max(target_type) = 'regression' AND count(y) < count(*) THEN 'numeric_truth_required' END AS truth_fault FROM p GROUP BY 1""")
def b21_truth(spark, sf):
    """Whether the truth covers the roster and is numeric where it must be, with faults planted by nation."""
    kind, own, k = F.col("c_nationkey") % 6, F.col("c_acctbal"), F.col("c_custkey")
    y = F.when(kind == 1, F.when(k % 2 != 0, own)).when(kind == 2, F.when(k % 3 == 0, F.lit(float("nan"))).otherwise(own)).when(kind != 5, own)
    label = F.when(~((kind == 4) | (kind == 3) | ((kind == 1) & (F.col("c_nationkey") > 10))), "up")
    rows = table(spark, sf, "customer").select(F.col("c_nationkey").alias("unit"), y.alias("y"), label.alias("true_label"), F.when(kind == 5, "classification").otherwise("regression").alias("target_type"))
    return alignment.truth_fault(rows, ["unit"])


QUERIES, ORACLES = query.queries, query.oracles
