"""Who may answer and cite: the B family, document access, and the claim verdicts."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodeframe.functions import metrics
from lodeframe.functions import text as words
from lodeframe.operators import alignment, citations, judges, verdicts
from lodeframe.plans.bindings import CLAIMS, Registry, claims, documents, items
from lodeframe.session import table

query = Registry()


def _roster_check(spark, sf, orders):
    customer = table(spark, sf, "customer")
    roster = customer.filter("c_custkey % 7 <> 0").select(F.col("c_nationkey").alias("unit_id"), F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("entity_id"))
    placed = orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
    pred = placed.select(F.col("c_nationkey").alias("unit_id"), F.when(F.col("o_orderkey") % 97 == 0, "").otherwise(F.concat(F.lit("C"), F.col("c_custkey").cast("string"))).alias("entity_id"))
    return alignment.roster_check(roster, pred, ["unit_id"])


@query("""WITH roster AS (SELECT c_nationkey AS unit_id, 'C' || c_custkey AS entity_id FROM customer WHERE c_custkey % 7 <> 0),
pred AS (SELECT c_nationkey AS unit_id, CASE WHEN o_orderkey % 97 = 0 THEN '' ELSE 'C' || c_custkey END AS entity_id FROM orders JOIN customer ON c_custkey = o_custkey),
e AS (SELECT unit_id, entity_id, sum(r) AS r, sum(p) AS p FROM (SELECT unit_id, entity_id, 1 AS r, 0 AS p FROM roster UNION ALL SELECT unit_id, entity_id, 0, 1 FROM pred) GROUP BY 1, 2),
c AS (SELECT unit_id, sum(CASE WHEN entity_id = '' THEN p ELSE 0 END)::BIGINT AS malformed, sum(CASE WHEN entity_id <> '' AND p > 1 THEN p - 1 ELSE 0 END)::BIGINT AS duplicate,
  count(*) FILTER (entity_id <> '' AND r = 0) AS unknown, count(*) FILTER (entity_id <> '' AND p = 0) AS missing FROM e GROUP BY 1)
SELECT *, CASE WHEN malformed > 0 THEN 'malformed' WHEN duplicate > 0 THEN 'duplicate' WHEN unknown > 0 THEN 'unknown' WHEN missing > 0 THEN 'missing' END AS reason FROM c""")
def b5_roster_check(spark, sf):
    """Set equality of roster and predictions with four counters and one reason."""
    return _roster_check(spark, sf, table(spark, sf, "orders"))


@query("""SELECT event_id, CASE WHEN event_id % 9 = 0 THEN 'interval_absent' WHEN event_id % 8 = 0 THEN 'level_mismatch' WHEN event_id % 7 = 0 THEN 'not_finite' WHEN value - 2 > CASE WHEN event_id % 5 = 0 THEN 1.0 ELSE value + 2 END THEN 'reversed' END AS fault FROM events""")
def b7_interval_fault(spark, sf):
    """Why an interval is refused."""
    e, v = F.col("event_id"), F.col("value")
    gone = e % 9 == 0
    low = F.when(gone, None).when(e % 7 == 0, F.lit(float("nan"))).otherwise(v - 2)
    high = F.when(gone, None).when(e % 5 == 0, 1.0).otherwise(v + 2)
    level = F.when(gone, None).when(e % 8 == 0, 0.8).otherwise(0.9)
    return table(spark, sf, "events").select("event_id", alignment.interval_fault(low, high, level, F.lit(0.9)).alias("fault"))


@query("""WITH r AS (SELECT l_orderkey, CASE WHEN l_orderkey % 3 = 0 THEN NULL WHEN l_orderkey % 3 = 1 AND l_linenumber = 2 AND l_orderkey % 2 = 0 THEN NULL ELSE l_linenumber END AS rank FROM lineitem)
SELECT l_orderkey, CASE WHEN count(rank) = 0 THEN NULL WHEN count(rank) < count(*) THEN 'partial_ranks' WHEN list_sort(list(rank)) <> range(1, count(*) + 1)::INT[] THEN 'not_a_permutation' END AS rank_fault FROM r GROUP BY 1""")
def b9_rank_fault(spark, sf):
    """Ranks are all absent or a permutation."""
    k, n = F.col("l_orderkey"), F.col("l_linenumber")
    rank = F.when(k % 3 == 0, None).when((k % 3 == 1) & (n == 2) & (k % 2 == 0), None).otherwise(n)
    return alignment.rank_fault(table(spark, sf, "lineitem").select("l_orderkey", rank.alias("rank")), ["l_orderkey"])


@query("""WITH r AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN event_id || '.0' WHEN 1 THEN event_id || '.5' WHEN 2 THEN 'true' WHEN 3 THEN '"' || event_id || '"' ELSE event_id::VARCHAR END AS raw FROM events)
SELECT event_id, CASE WHEN event_id % 5 IN (0, 4) THEN event_id::INT END AS value, event_id % 5 NOT IN (0, 4) AS malformed FROM r""")
def b10_offsets(spark, sf):
    """120.0 is 120; fractions, booleans and strings are refused."""
    e = F.col("event_id")
    t = e.cast("string")
    raw = F.when(e % 5 == 0, F.concat(t, F.lit(".0"))).when(e % 5 == 1, F.concat(t, F.lit(".5"))).when(e % 5 == 2, "true").when(e % 5 == 3, F.concat(F.lit('"'), t, F.lit('"'))).otherwise(t)
    value, bad = alignment.whole_offset(raw)
    return table(spark, sf, "events").select("event_id", value.alias("value"), bad.alias("malformed"))


@query("""SELECT l_suppkey, l_orderkey, l_linenumber, dense_rank() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey * 10 + l_linenumber)::INT AS claim_place FROM lineitem
QUALIFY dense_rank() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey * 10 + l_linenumber) <= 20""")
def h1_first_claims(spark, sf):
    """The first twenty claims of an entity in file order."""
    rows = table(spark, sf, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("o"))
    return alignment.first_claims(rows, ["l_suppkey"], "o").select("l_suppkey", "l_orderkey", "l_linenumber", "claim_place")


@query("""WITH g AS (SELECT conv_id, list({'t': turn, 'x': text} ORDER BY turn) AS l FROM conversations GROUP BY 1)
SELECT conv_id, greatest(len(l) - 2, 0)::INT AS ignored, u.i::INT - 1 AS claim_pos, l[u.i].x AS claim FROM g, LATERAL (SELECT unnest(range(1, least(len(l), 2) + 1)) AS i) u""")
def b11_explode_claims(spark, sf):
    """Claims exploded behind the cap, and how many it ignores."""
    own = table(spark, sf, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: F.struct(x["text"].alias("claim"))).alias("claims")).withColumn("entity_id", F.lit("e"))
    return alignment.explode_claims(own, ["conv_id"], 2).select("conv_id", "ignored", F.col("claim_pos"), "claim")


@query("""SELECT conv_id, turn, trim(text, chr(32) || chr(10)) AS claim, length(trim(text, chr(32) || chr(10))) > 4000 OR trim(text, chr(32) || chr(10)) = '' AS malformed FROM conversations""")
def b12_claim_text(spark, sf):
    """Claim text without outer white space; empty or too long is malformed."""
    claim, bad = alignment.claim_text(F.lit(None).cast("string"), F.col("text"))
    return table(spark, sf, "conversations").select("conv_id", "turn", claim.alias("claim"), bad.alias("malformed"))


@query(f"""WITH {CLAIMS}, s AS (
  SELECT entity_id, CASE WHEN order_key % 11 = 0 THEN 'malformed' WHEN d.doc_id IS NULL THEN 'unresolved' WHEN doc_date IS NULL THEN 'undated' WHEN doc_date > cutoff THEN 'post_cutoff' ELSE 'ok' END AS st
  FROM claims c LEFT JOIN docs d ON c.doc_id = d.doc_id),
r AS (SELECT entity_id, count(*) AS checked, count(*) FILTER (st = 'malformed') AS malformed, count(*) FILTER (st = 'unresolved') AS unresolved, count(*) FILTER (st = 'undated') AS undated, count(*) FILTER (st = 'post_cutoff') AS post_cutoff FROM s GROUP BY 1)
SELECT *, CASE WHEN post_cutoff > 0 THEN 'post_cutoff' WHEN unresolved + malformed > 0 THEN 'unresolved' WHEN undated > 0 THEN 'undated' END AS reason FROM r""")
def b15_embargo(spark, sf):
    """Citations resolved, dated and held against the cutoff; counters and reason."""
    joined = citations.resolve(claims(spark, sf), documents(spark, sf), ["doc_id"], ["doc_date"])
    state = citations.embargo_state(F.col("doc_id"), F.col("resolved"), F.col("doc_date"), F.col("cutoff"))
    return citations.embargo_report(joined.withColumn("embargo", state), ["entity_id"])


@query(f"""WITH {CLAIMS} SELECT entity_id, count(*) FILTER (coalesce(doc_date <= cutoff - 30, false)) AS usable, count(*) FILTER (NOT coalesce(doc_date > cutoff - 30, false)) AS not_known_late
FROM claims c LEFT JOIN docs d ON c.doc_id = d.doc_id GROUP BY 1""")
def b23_polarities(spark, sf):
    """The two opposite readings of an unknown date."""
    joined = citations.resolve(claims(spark, sf), documents(spark, sf), ["doc_id"], ["doc_date"])
    late = F.date_sub("cutoff", 30)
    return joined.groupBy("entity_id").agg(F.count_if(citations.usable_in_retrieval(F.col("doc_date"), late)).alias("usable"), F.count_if(citations.not_known_late(F.col("doc_date"), late)).alias("not_known_late"))


@query(f"""WITH {CLAIMS} SELECT entity_id, count(*) AS cited, count(*) FILTER (NOT (coalesce(shared, false) OR coalesce(list_contains(entity_ids, l_partkey % 1500), false))) AS wrong_entity
FROM claims c JOIN docs d ON c.doc_id = d.doc_id GROUP BY 1""")
def b17_admission(spark, sf):
    """Citations of documents that aren't about the entity."""
    joined = citations.resolve(claims(spark, sf), documents(spark, sf), ["doc_id"], ["shared", "entity_ids"]).filter("resolved")
    ok = citations.admits(F.col("shared"), F.col("entity_ids"), F.col("l_partkey") % 1500)
    return joined.groupBy("entity_id").agg(F.count(F.lit(1)).alias("cited"), F.count_if(~ok).alias("wrong_entity"))


@query(f"""WITH {CLAIMS}, u AS (SELECT (replace(doc_id, 'ORD-', '')::BIGINT % 50) AS unit_id, * FROM docs)
SELECT unit_id, count(*) FILTER (shared OR entity_ids IS NOT NULL) AS n_labelled, list_sort(list(doc_id) FILTER (NOT (shared OR entity_ids IS NOT NULL))) AS unlabelled FROM u GROUP BY 1
HAVING count(*) FILTER (shared OR entity_ids IS NOT NULL) > 0 AND count(*) FILTER (NOT (shared OR entity_ids IS NOT NULL)) > 0""")
def b20_label_gaps(spark, sf):
    """Units that label some documents and not others."""
    docs = documents(spark, sf).withColumn("unit_id", F.regexp_replace("doc_id", "ORD-", "").cast("long") % 50)
    return citations.label_gaps(docs)


@query("""WITH r AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%Y/%m/%d') WHEN 2 THEN '2024-02-31' ELSE strftime(o_orderdate, '%Y-%m-%d') || 'T00' END AS raw FROM orders)
SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN raw::DATE END AS day FROM r""")
def b16_strict_dates(spark, sf):
    """Only real days in the one form."""
    k, d = F.col("o_orderkey"), F.col("o_orderdate")
    raw = F.when(k % 4 == 0, F.date_format(d, "yyyy-MM-dd")).when(k % 4 == 1, F.date_format(d, "yyyy/MM/dd")).when(k % 4 == 2, "2024-02-31").otherwise(F.concat(F.date_format(d, "yyyy-MM-dd"), F.lit("T00")))
    return table(spark, sf, "orders").select("o_orderkey", citations.iso_date(raw).alias("day"))


@query("""SELECT p_partkey, coalesce(CASE WHEN p_size > 25 THEN p_size END, CASE WHEN p_size > 10 THEN p_size + (p_partkey % 2)::INT END, 7)::INT AS value, p_size > 25 AND p_partkey % 2 = 1 AS conflict FROM part""")
def b22_parameters(spark, sf):
    """Plan over card over default, with disagreement told."""
    size = F.col("p_size")
    value, conflict = alignment.merged(F.when(size > 25, size), F.when(size > 10, size + (F.col("p_partkey") % 2).cast("int")), F.lit(7))
    return table(spark, sf, "part").select("p_partkey", value.cast("int").alias("value"), conflict.alias("conflict"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 'too_few' WHEN p_partkey % 5 = 1 THEN 'padded' WHEN p_partkey % 5 = 2 THEN 'repeated' WHEN p_partkey % 5 = 3 THEN 'empty' END AS fault FROM part""")
def b4_vocabulary(spark, sf):
    """Why a label vocabulary is refused."""
    k, b = F.col("p_partkey"), F.col("p_brand")
    labels = F.when(k % 5 == 0, F.array(b)).when(k % 5 == 1, F.array(b, F.concat(F.lit(" "), b))).when(k % 5 == 2, F.array(b, b)).when(k % 5 == 3, F.array(b, F.lit(" "))).otherwise(F.array(b, F.lit("other")))
    return table(spark, sf, "part").select("p_partkey", alignment.vocabulary_fault(labels, F.lit("classification")).alias("fault"))


@query("""WITH s AS (SELECT doc_id, text, (doc_id * 7919 % (length(text) + 20))::INT AS s, (doc_id * 7919 % (length(text) + 20) + doc_id % 90)::INT AS e FROM documents)
SELECT doc_id, CASE WHEN 0 <= s AND s < e AND e <= length(text) THEN substring(text, s + 1, e - s) END AS span, NOT (0 <= s AND s < e AND e <= length(text)) AS out_of_range FROM s""")
def c1_spans(spark, sf):
    """Guarded slices in code points."""
    d = F.col("doc_id")
    start = (d * 7919 % (F.length("text") + 20)).cast("int")
    span, out = citations.span_text(F.col("text"), start, (start + d % 90).cast("int"))
    return table(spark, sf, "documents").select("doc_id", span.alias("span"), out.alias("out_of_range"))


@query("""SELECT doc_id, length(text) > 8000 AS over_cap, contains(text, substring(text, 11, 40)) AND trim(substring(text, 11, 40)) <> '' AS is_verbatim FROM (
  SELECT doc_id, regexp_replace(text, '[ \n\t\r]+', ' ', 'g') AS text FROM documents)""")
def e28_verbatim(spark, sf):
    """Spans over the cap, and quotes that a span holds word for word."""
    d = table(spark, sf, "documents").withColumn("text", F.regexp_replace("text", "[ \n\t\r]+", " "))
    return d.select("doc_id", citations.over_cap(F.col("text")).alias("over_cap"), citations.verbatim(F.substring("text", 11, 40), F.col("text")).alias("is_verbatim"))


@query("""WITH e AS (SELECT * FROM events WHERE ts <= TIMESTAMP '2024-01-15 00:00:00')
SELECT user_id, event_id, event_type FROM e QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts::DATE DESC, event_id) = 1""")
def g17_newest(spark, sf):
    """The newest document on or before the cutoff, the first in order on ties."""
    e = table(spark, sf, "events").filter(F.col("ts") <= F.lit("2024-01-15").cast("timestamp")).select("user_id", "event_id", "event_type", F.col("ts").cast("date").alias("doc_date"))
    return citations.newest_eligible(e, ["user_id"], F.lit("2024-01-15").cast("date"), "event_id").select("user_id", "event_id", "event_type")


@query("""WITH l AS (SELECT n_regionkey, n_nationkey, '{"entity_id": ' || n_nationkey || ', "name": "' || n_name || '"}' AS line FROM nation)
SELECT n_regionkey, n_nationkey, coalesce(sum(length(line) + 1) OVER w, 0)::BIGINT AS row_start, (coalesce(sum(length(line) + 1) OVER w, 0) + length(line))::BIGINT AS row_end FROM l
WINDOW w AS (PARTITION BY n_regionkey ORDER BY n_nationkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def a10_row_ranges(spark, sf):
    """A10 H2: rows of the task table and their places in its text."""
    line = F.format_string('{"entity_id": %d, "name": "%s"}', "n_nationkey", "n_name")
    return citations.row_ranges(table(spark, sf, "nation").withColumn("line", line), ["n_regionkey"], "line", "n_nationkey").select("n_regionkey", "n_nationkey", F.col("row_start").cast("long").alias("row_start"), F.col("row_end").cast("long").alias("row_end"))


@query("""SELECT n_regionkey, string_agg('{"entity_id": ' || n_nationkey || ', "name": "' || n_name || '"}', chr(10) ORDER BY n_nationkey) AS text, 'task' AS doc_id FROM nation GROUP BY 1""")
def a10_table_text(spark, sf):
    """A10: the task table as one document."""
    line = F.format_string('{"entity_id": %d, "name": "%s"}', "n_nationkey", "n_name")
    return citations.table_text(table(spark, sf, "nation").withColumn("line", line), ["n_regionkey"], "line", "n_nationkey")


VERDICT = """v AS (SELECT l_orderkey AS unit, l_suppkey AS entity_id, l_linenumber AS pos,
  CASE WHEN l_quantity > 49 THEN 'malformed' WHEN l_tax > 0.07 THEN 'over_cap' WHEN l_discount > 0.08 THEN 'unanchored' WHEN l_partkey % 17 = 0 THEN 'content_free'
    WHEN l_partkey % 3 <> 0 AND l_extendedprice > 90000 THEN 'contradicted' ELSE 'neutral' END AS status, l_returnflag = 'R' AS wrong, l_linestatus = 'F' AND l_linenumber = 3 AS outside FROM lineitem)"""


def _verdicts(spark, sf):
    line = table(spark, sf, "lineitem")
    state = verdicts.status(F.col("l_quantity") > 49, F.col("l_tax") > 0.07, F.when(F.col("l_discount") > 0.08, "unanchored").otherwise("anchored"), F.col("l_partkey") % 17 == 0, F.col("l_partkey") % 3 == 0, F.when(F.col("l_extendedprice") > 90000, 0.95).otherwise(0.9))
    rows = line.select(F.col("l_orderkey").alias("unit"), F.col("l_suppkey").alias("entity_id"), F.col("l_linenumber").alias("pos"), F.col("l_partkey").alias("doc_id"), F.col("l_linenumber").alias("claim_pos"), state.alias("status"), (F.col("l_returnflag") == "R").alias("wrong"), ((F.col("l_linestatus") == "F") & (F.col("l_linenumber") == 3)).alias("outside"))
    return rows.withColumn("reasons", verdicts.reasons(F.col("wrong"), F.col("outside"), F.col("status")))


@query(f"""WITH {VERDICT}, r AS (SELECT *, wrong OR outside OR status <> 'neutral' AS bad FROM v)
SELECT unit, count(*) AS n_claims, count(*) FILTER (bad) AS n_false, count(*) FILTER (wrong) AS n_wrong_entity, count(*) FILTER (outside) AS n_out_of_range, count(*) FILTER (status = 'malformed') AS n_malformed,
  count(*) FILTER (status = 'over_cap') AS n_over_cap, count(*) FILTER (status = 'unanchored') AS n_unanchored, count(*) FILTER (status = 'content_free') AS n_content_free, count(*) FILTER (status = 'contradicted') AS n_contradicted,
  count(*) FILTER (status = 'neutral') AS n_neutral, count(DISTINCT entity_id) AS n_entities FROM r GROUP BY 1""")
def d11_report(spark, sf):
    """Reasons and its counters."""
    return verdicts.report(_verdicts(spark, sf), ["unit"])


@query(f"""WITH {VERDICT} SELECT unit, entity_id, pos AS claim_pos, unnest(list_filter([CASE WHEN wrong THEN 'wrong_entity' END, CASE WHEN outside THEN 'out_of_range' END, CASE WHEN status <> 'neutral' THEN status END], lambda x: x IS NOT NULL)) AS code FROM v""")
def d14_findings(spark, sf):
    """One finding for each claim and reason."""
    return verdicts.findings(_verdicts(spark, sf), ["unit"])


@query(f"""WITH {VERDICT}, r AS (SELECT unit, count(*) AS n, count(*) FILTER (wrong OR outside OR status <> 'neutral') AS f, count(DISTINCT entity_id) AS e FROM v GROUP BY 1)
SELECT unit, f AS n_false, round(CASE WHEN f = 0 THEN 1 ELSE 1 - f / (f + least(n - f, 3 * e)) END, 8) AS factor, round(0.5 * CASE WHEN f = 0 THEN 1 ELSE 1 - f / (f + least(n - f, 3 * e)) END, 8) AS penalised FROM r""")
def d15_penalty(spark, sf):
    """The penalty preview of each answer."""
    counted = verdicts.report(_verdicts(spark, sf), ["unit"]).withColumn("score", F.lit(0.5))
    return verdicts.penalised(counted, "score", F.col("n_entities")).select("unit", "n_false", F.round("factor", 8).alias("factor"), F.round("penalised", 8).alias("penalised"))


@query(f"""WITH {VERDICT} SELECT unit, count(*) AS n_false, string_agg(pos::VARCHAR || ':' || entity_id, ',' ORDER BY pos, entity_id) AS claims FROM v WHERE wrong OR outside OR status <> 'neutral' GROUP BY 1""")
def d12_false_claims(spark, sf):
    """The false claims of an answer in order."""
    listed = verdicts.false_claims(_verdicts(spark, sf), ["unit"])
    return listed.select("unit", F.size("false_claims").cast("long").alias("n_false"), F.array_join(F.transform("false_claims", lambda x: F.concat_ws(":", x["pos"].cast("string"), x["entity_id"].cast("string"))), ",").alias("claims"))


@query("""WITH s AS (SELECT l_orderkey AS unit, l_suppkey AS entity_id, l_linenumber % 3 AS phrasing, max(l_discount * 10) AS best FROM lineitem GROUP BY 1, 2, 3),
m AS (SELECT unit, entity_id, median(best) AS middle FROM s GROUP BY 1, 2) SELECT unit, round(avg((middle > 0.5)::INT), 8) AS relevance FROM m GROUP BY 1""")
def d13_relevance(spark, sf):
    """Best citation, median phrasing, share over the bar."""
    rows = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("unit"), F.col("l_suppkey").alias("entity_id"), (F.col("l_linenumber") % 3).alias("phrasing"), (F.col("l_discount") * 10).alias("entail"))
    return verdicts.relevance(rows, ["unit"]).withColumn("relevance", F.round("relevance", 8))


@query("""WITH c AS (SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'Evidence for User ' || user_id || ' from the cited passage.' WHEN 1 THEN 'User ' || user_id || ' fell.' WHEN 2 THEN 'Model inference failed.' WHEN 3 THEN 'No quotes were submitted.'
  WHEN 4 THEN 'Pre-cutoff evidence selected for the submitted prediction.' ELSE 'The source contains 5.' END AS claim, event_id % 6 IN (0, 2, 4) AS content_free FROM events) SELECT event_id, content_free FROM c""")
def d4_content_free(spark, sf):
    """Claims that say nothing once names are blanked."""
    e, user = F.col("event_id") % 6, F.concat(F.lit("User "), F.col("user_id").cast("string"))
    claim = F.when(e == 0, F.concat(F.lit("Evidence for "), user, F.lit(" from the cited passage."))).when(e == 1, F.concat(user, F.lit(" fell."))).when(e == 2, "Model inference failed.").when(e == 3, "No quotes were submitted.").when(e == 4, "Pre-cutoff evidence selected for the submitted prediction.").otherwise("The source contains 5.")
    return table(spark, sf, "events").select("event_id", words.content_free(claim, F.lit("no_figures"), F.array(user)).alias("content_free"))


@query("""WITH s AS (SELECT event_id AS e, value FROM events) SELECT e AS event_id, array_to_string(list_filter([CASE WHEN e % 13 = 0 THEN 'missing_field' END, CASE WHEN e % 7 = 0 THEN 'empty_claim' END,
  CASE WHEN e % 2 = 0 AND (e % 5 = 0 OR 40 > 50 + e % 3 * -20) THEN 'bad_span' END, CASE WHEN e % 2 = 1 THEN 'unknown_doc' END, CASE WHEN e % 2 = 0 AND e % 3 = 0 THEN 'stale_doc' END], lambda x: x IS NOT NULL), ',') AS codes FROM s""")
def d16_claim_shape(spark, sf):
    """The rail's codes of a claim."""
    e = F.col("event_id")
    start = F.when(e % 5 == 0, -1).otherwise(3)
    codes = verdicts.shape_codes(F.when(e % 13 != 0, "d").otherwise("d"), start, F.lit(40), F.when(e % 7 == 0, " ").otherwise("text"), e % 2 == 0, e % 3 == 0, (50 + e % 3 * -20).cast("int"))
    with_missing = F.when(e % 13 == 0, F.concat(F.array(F.lit("missing_field")), codes)).otherwise(codes)
    return table(spark, sf, "events").select("event_id", F.array_join(with_missing, ",").alias("codes"))


@query("""WITH p AS (SELECT d.doc_id, string_split_regex(lower(trim(d.text)), '[ \n\t\r]+') AS p, string_split_regex(lower(trim(b.text)), '[ \n\t\r]+') AS h FROM documents d JOIN benchmark b ON d.doc_id % (SELECT count(*) FROM benchmark) = b.item_id),
w AS (SELECT doc_id, list_distinct(list_filter(p, lambda x: length(x) > 2)) AS p, list_distinct(list_filter(h, lambda x: length(x) > 2)) AS h FROM p)
SELECT doc_id, round(len(list_intersect(h, p)) / len(h), 8) AS entailment FROM w""")
def f1_lexical(spark, sf):
    """The lexical judge."""
    pairs = table(spark, sf, "documents").select("doc_id", "text", items(spark, sf, "doc_id").alias("item_id")).join(table(spark, sf, "benchmark").withColumnRenamed("text", "claim"), "item_id")
    return pairs.select("doc_id", F.round(judges.lexical(F.col("text"), F.col("claim")), 8).alias("entailment"))


@query("""WITH x AS (SELECT l_orderkey, l_linenumber, l_discount * 30 AS a, l_tax * 40 AS b, l_quantity / 20 AS c FROM lineitem)
SELECT l_orderkey, l_linenumber, round(exp(c - greatest(a, b, c)) / (exp(a - greatest(a, b, c)) + exp(b - greatest(a, b, c)) + exp(c - greatest(a, b, c))), 8) AS contradiction, round(1 / (1 + exp(c - a)), 8) AS entailment FROM x""")
def f3_softmax(spark, sf):
    """Three-way and two-way probabilities from logits."""
    a, b, c = F.col("l_discount") * 30, F.col("l_tax") * 40, F.col("l_quantity") / 20
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.round(judges.three_way(a, b, c)["contradiction"], 8).alias("contradiction"), F.round(judges.two_way(a, c), 8).alias("entailment"))


@query("""SELECT l_orderkey::VARCHAR AS pair, count(*) AS members, round(avg(l_discount), 8) AS entailment, round(avg(l_tax), 8) AS contradiction, max(l_partkey) AS claim_tokens, count(DISTINCT l_returnflag) <= 1 AS windows_agree FROM lineitem GROUP BY 1""")
def f4_ensemble(spark, sf):
    """The mean of members, the longest of given token counts, and whether windows agree."""
    rows = table(spark, sf, "lineitem").select(F.col("l_orderkey").cast("string").alias("pair"), F.col("l_discount").alias("entailment"), F.col("l_tax").alias("contradiction"), F.col("l_partkey").alias("claim_tokens"), F.col("l_returnflag").alias("window"))
    found = judges.ensemble(rows)
    return found.withColumn("entailment", F.round("entailment", 8)).withColumn("contradiction", F.round("contradiction", 8))


@query("""WITH l AS (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_discount, l_tax FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber, l_partkey, l_suppkey ORDER BY l_discount, l_tax) = 1), a AS (SELECT l_discount * 10 AS x, l_discount * 10 + CASE WHEN l_linenumber = 2 THEN l_tax / 100 ELSE 0 END AS y FROM l)
SELECT count(*) AS pairs, round(max(abs(x - y)), 8) AS largest, round(avg(abs(x - y)), 8) AS mean, count(*) FILTER (x = y) AS exact, count(*) FILTER ((x > 0.5) <> (y > 0.5)) AS crossings FROM a""")
def f10_equivalence(spark, sf):
    """How far two backends lie apart."""
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    line = table(spark, sf, "lineitem").groupBy(*keys).agg(F.min(F.struct("l_discount", "l_tax")).alias("x")).select(*keys, "x.*").withColumn("pair", F.concat_ws("-", *[F.col(k).cast("string") for k in keys]))
    a = line.select("pair", (F.col("l_discount") * 10).alias("score"))
    b = line.select("pair", (F.col("l_discount") * 10 + F.when(F.col("l_linenumber") == 2, F.col("l_tax") / 100).otherwise(0.0)).alias("score"))
    found = judges.equivalence(a, b, "score", 0.5)
    return found.withColumn("largest", F.round("largest", 8)).withColumn("mean", F.round("mean", 8))


@query("""SELECT c_mktsegment, count(*) AS n, round(sum(CASE WHEN c_acctbal < 0 THEN 0.0 ELSE least(c_acctbal / 10000, 1) END) / count(*), 8) AS mean_score FROM customer GROUP BY 1""")
def g15_unit_mean(spark, sf):
    """The mean over units, failures included."""
    score = metrics.with_worst_case(F.col("c_acctbal") / 10000, F.col("c_acctbal") < 0)
    return table(spark, sf, "customer").groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(score), 8).alias("mean_score"))


QUERIES, ORACLES = query.queries, query.oracles
