"""Evidence: retrieval, figures, addresses, reasons, agents, profiles and bundle reading on the test tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from lodeframe.functions import figures, metrics, text, urls
from lodeframe.operators import agents, outcomes, profile, reading, reasons, retrieval, verdicts
from lodeframe.plans.bindings import Registry, items
from lodeframe.session import bounded_batches, dealt, spread, table
from lodeframe.sources import bundle

query = Registry()

DAY = "date '2024-01-01' + (doc_id % 300)::INT"


def _chunks(spark, sf):
    d = F.col("doc_id")
    return table(spark, sf, "documents").select(F.concat(F.lit("D"), d.cast("string")).alias("doc_id"), F.when(d % 13 != 0, F.date_add(F.lit("2024-01-01").cast("date"), (d % 300).cast("int"))).alias("doc_date"), (d % 5 * 10).cast("int").alias("start"), d.cast("int").alias("pos"), "text")


def _queries(spark, sf):
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


@query("""WITH c AS (SELECT 'D' || doc_id AS doc_id, (doc_id % 5 * 10)::INT AS start, list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda x: length(x) > 1) AS terms FROM documents WHERE doc_id % 13 <> 0 AND doc_id % 300 <= 250),
n AS (SELECT *, len(terms) AS n FROM c), t AS (SELECT count(*) AS chunks, avg(n) AS mean FROM n),
p AS (SELECT term, doc_id, start, n, count(*) AS tf FROM (SELECT doc_id, start, n, unnest(terms) AS term FROM n) GROUP BY ALL),
f AS (SELECT term, count(*) AS df FROM p GROUP BY 1),
q AS (SELECT item_id AS query_id, unnest(list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda x: length(x) > 1))) AS term FROM benchmark),
s AS (SELECT query_id, doc_id, start, sum(ln(1 + (chunks - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * n / mean))) AS score FROM q JOIN p USING (term) JOIN f USING (term), t GROUP BY 1, 2, 3)
SELECT query_id, doc_id, start, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id, start)::INT AS rank FROM s) WHERE rank <= 5""")
def h3_bm25(spark, sf):
    """BM25 over the chunks that the embargo admits, five best of each query."""
    found = retrieval.bm25(_chunks(spark, sf), _queries(spark, sf), F.lit("2024-09-07").cast("date"), 5)
    return found.withColumn("score", F.round("score", 6))


@query("""WITH c AS (SELECT doc_id, text, list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda x: length(x) > 2) AS terms FROM documents WHERE doc_id % 13 = 0 OR doc_id % 300 <= 250),
u AS (SELECT doc_id, len(terms) AS n, unnest(terms) AS term FROM c),
q AS (SELECT item_id AS query_id, unnest(list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda x: length(x) > 2))) AS term FROM benchmark),
s AS (SELECT query_id, doc_id, count(*) / sqrt(any_value(n)) AS score FROM q JOIN u USING (term) GROUP BY 1, 2),
b AS (SELECT query_id, doc_id, score FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) = 1),
z AS (SELECT i.query_id, coalesce(b.doc_id, (SELECT min(doc_id) FROM u)) AS doc_id, coalesce(score, 0.0) AS score FROM (SELECT DISTINCT query_id FROM q) i LEFT JOIN b USING (query_id))
SELECT query_id, 'D' || z.doc_id AS doc_id, round(score, 8) AS score, 0 AS start, least(length(text), 240)::INT AS "end", text[1:240] AS text FROM z JOIN c USING (doc_id)""")
def h4_overlap(spark, sf):
    """H4: the best document by overlap; undated ones pass."""
    found = retrieval.overlap_best(_chunks(spark, sf), _queries(spark, sf), F.lit("2024-09-07").cast("date"))
    return found.withColumn("score", F.round("score", 8))


@query("""WITH p AS (SELECT d.doc_id, d.text, b.text AS quote FROM documents d JOIN benchmark b ON d.doc_id % (SELECT count(*) FROM benchmark) = b.item_id
UNION ALL SELECT doc_id + 1000000, text, replace(text[21:50], '''', '’') FROM documents)
SELECT doc_id, CASE WHEN trim(quote) = '' THEN NULL WHEN instr(text, trim(quote)) > 0 THEN instr(text, trim(quote)) - 1 WHEN instr(text, replace(trim(quote), '’', '''')) > 0 THEN instr(text, replace(trim(quote), '’', '''')) - 1 END::INT AS start FROM p""")
def c9_find_quote(spark, sf):
    """Where a quote stands, quotes and dashes made plain."""
    d = table(spark, sf, "documents")
    a = d.select("doc_id", "text", items(spark, sf, "doc_id").alias("item_id")).join(table(spark, sf, "benchmark").select("item_id", F.col("text").alias("quote")), "item_id").select("doc_id", "text", "quote")
    b = d.select((F.col("doc_id") + 1000000).alias("doc_id"), "text", F.translate(F.substring("text", 21, 30), "'", "’").alias("quote"))
    start, _ = retrieval.find_quote(F.col("text"), F.col("quote"))
    return a.union(b).select("doc_id", start.cast("int").alias("start"))


@query("""WITH q AS (SELECT item_id AS quote_id, 'D' || (item_id * 7919 % (SELECT count(*) FROM documents)) AS doc_id, text AS quote FROM benchmark), c AS (SELECT 'D' || doc_id AS doc_id, (doc_id % 5 * 10)::INT AS start, text FROM documents),
w AS (SELECT quote_id, doc_id, start, len(list_intersect(list_distinct(string_split_regex(lower(trim(quote)), '[ \n\t\r]+')), list_distinct(string_split_regex(lower(trim(text)), '[ \n\t\r]+')))) AS shared FROM q JOIN c USING (doc_id))
SELECT quote_id, doc_id, start, shared::INT AS shared FROM w WHERE shared > 0""")
def c11_best_chunk(spark, sf):
    """C11: the chunk of a document that shares most words with a quote."""
    quotes = table(spark, sf, "benchmark").select(F.col("item_id").alias("quote_id"), F.concat(F.lit("D"), (F.col("item_id") * 7919 % table(spark, sf, "documents").count()).cast("string")).alias("doc_id"), F.col("text").alias("quote"))
    chunks = _chunks(spark, sf).withColumn("end", F.col("start") + F.length("text"))
    return retrieval.best_chunk(quotes, chunks).drop("end")


@query("""SELECT doc_id, CASE WHEN length(text) > 200 THEN regexp_replace(text[1:200], ' [^ ]*$', '') ELSE text END AS claim FROM documents""")
def c12_prefix_claim(spark, sf):
    """A verbatim prefix cut back to a whole word."""
    return table(spark, sf, "documents").select("doc_id", retrieval.prefix_claim(F.col("text")).alias("claim"))


@query("""WITH w AS (SELECT item_id, list_distinct(list_filter(list_transform(regexp_extract_all(lower(text), '[a-z0-9][a-z0-9.\\-]*'), lambda x: trim(x, '.-')), lambda x: length(x) >= 2)) AS w FROM benchmark)
SELECT item_id, len(list_filter(w, lambda x: NOT list_contains(string_split('""" + " ".join(w.replace("'", "''") for w in dict.fromkeys(text.WINDOW_STOPWORDS)) + """', ' '), x)))::INT AS n_words FROM w""")
def c7_window_words(spark, sf):
    """Distinct words by which windows are matched."""
    return table(spark, sf, "benchmark").select("item_id", F.size(text.window_words(F.col("text"))).alias("n_words"))


@query()
def c6_best_window(spark, sf):
    """The window of a passage that shares most words with the claim."""
    pairs = table(spark, sf, "documents").select("doc_id", F.col("text").alias("whole"), items(spark, sf, "doc_id").alias("item_id")).join(table(spark, sf, "benchmark").withColumnRenamed("text", "claim"), "item_id")
    return pairs.select("doc_id", text.best_window(F.col("whole"), F.lit(400), F.col("claim")).alias("start"))


@query("""SELECT p_partkey, unnest([p_name || ' ' || 'misses the bar.', 'It holds that ' || p_name || ' misses the bar.', 'The evidence says that ' || p_name || ' misses the bar.']) AS hypothesis, unnest([0, 1, 2])::INT AS phrasing FROM part""")
def c22_hypotheses(spark, sf):
    """Three phrasings of each prediction, one row each."""
    none = F.lit(None).cast("string")
    h = agents.hypotheses(F.lit("size"), F.col("p_name"), F.lit("classification"), F.lit("misses the bar"), none, none, none, none)
    return agents.exploded_hypotheses(table(spark, sf, "part").withColumn("hypotheses", h), ["p_partkey"])


@query("""SELECT c_custkey, [c_name, 'C' || c_custkey] AS names, concat_ws(' ', c_name, 'C' || c_custkey, c_mktsegment, 'outlook') AS query FROM customer""")
def c26_entity_names(spark, sf):
    """The names of an entity and its retrieval query."""
    code = F.concat(F.lit("C"), F.col("c_custkey").cast("string"))
    names = agents.entity_names(F.create_map(F.lit("name"), F.col("c_name"), F.lit("entity_id"), code, F.lit("sector"), F.col("c_mktsegment"), F.lit("x_ticker"), F.lit(" ")))
    return table(spark, sf, "customer").select("c_custkey", names.alias("names"), retrieval.entity_query(F.col("c_name"), code, F.col("c_mktsegment"), suffix="outlook").alias("query"))


@query("""WITH u AS (SELECT page_id, regexp_extract(url, '^[^\\s,;()\\[\\]{}<>"'']*', 0) AS own, url FROM pages)
SELECT page_id, 'see ' || repeat(' ', length(own)) || url[length(own) + 1:] || ' at 5' AS blanked, 'see ' || repeat('#', length(own)) || url[length(own) + 1:] || ' at 5' AS masked, 4 AS start, (4 + length(own))::INT AS stop FROM u""")
def c14_addresses(spark, sf):
    """Places of addresses, blanked and masked at equal length."""
    t = F.concat(F.lit("see "), F.col("url"), F.lit(" at 5"))
    return table(spark, sf, "pages").select("page_id", urls.blank_addresses(t).alias("blanked"), urls.mask_addresses(t).alias("masked"), urls.address_places(t).alias("p")).select("page_id", "blanked", "masked", F.col("p")[0]["start"].alias("start"), F.col("p")[0]["stop"].alias("stop"))


@query(r"""SELECT doc_id, md5(trim(regexp_replace(replace(lower(regexp_replace(nfc_normalize(text), '\p{Cf}', '', 'g')), 'ß', 'ss'), '[\s\x0b\x1c-\x1f\x{85}\p{Z}]+', ' ', 'g'))) AS key FROM documents""")
def c19_content_key(spark, sf):
    """The key by which duplicates in content are found."""
    bounded_batches(spark)
    return table(spark, sf, "documents").select("doc_id", F.md5(urls.content_key("text")).alias("key"))


STATED = "'Total was $' || printf('%.2f', o_totalprice) || ' in 12 weeks to March 31, 2025; see Item 2.02 and 10-K'"


def _stated(price):
    return F.concat(F.lit("Total was $"), F.format_string("%.2f", price), F.lit(" in 12 weeks to March 31, 2025; see Item 2.02 and 10-K"))


@query("""SELECT o_orderkey, [printf('%.2f', o_totalprice)] AS figures, 2 AS places FROM orders""")
def e1_figures(spark, sf):
    """The amounts of a text; dates, periods, items and forms are none."""
    rows = table(spark, sf, "orders").select("o_orderkey", _stated(F.col("o_totalprice")).alias("text"))
    found = reading.each_once(rows, ["text"], "f", figures.figures_of("text"))
    return found.select("o_orderkey", F.transform("f", lambda x: x["value"]).alias("figures"), F.array_max(F.transform("f", lambda x: x["places"])).alias("places"))


@query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN -1 WHEN 1 THEN 1 WHEN 2 THEN 0 ELSE 0 END::INT AS direction, o_orderkey % 4 = 3 AS half_width FROM orders""")
def e15_directions(spark, sf):
    """Written directions and half-widths."""
    k = F.col("o_orderkey") % 4
    t = F.concat(F.when(k == 0, "It fell by about ").when(k == 1, "It rose ").when(k == 2, "A level of ").otherwise("It is ±"), F.format_string("%.1f", F.col("o_totalprice") / 1000), F.lit(" now"))
    rows = table(spark, sf, "orders").select("o_orderkey", t.alias("text"))
    return reading.each_once(rows, ["text"], "f", figures.figures_of("text")[0]).select("o_orderkey", "f.direction", "f.half_width")


@query("""SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'anchored' WHEN 1 THEN 'unanchored' WHEN 2 THEN 'no_figures' WHEN 3 THEN 'anchored' ELSE 'no_figures' END AS status FROM orders""")
def e31_figure_status(spark, sf):
    """Whether a passage carries every figure of a claim, at any scale step."""
    k, price = F.col("o_orderkey") % 5, F.col("o_totalprice")
    cents = F.format_string("%.2f", price)
    claim = F.when(k == 0, F.concat(F.lit("It came to $"), cents)).when(k == 1, F.concat(F.lit("It came to $"), F.format_string("%.2f", price + 7))).when(k == 2, "It came to nothing much").when(k == 3, F.concat(F.lit("It came to "), cents, F.lit(" thousand"))).otherwise(F.concat(F.lit("We say "), cents))
    span = F.concat(F.lit("The order was at "), cents, F.lit(" in all"))
    own = F.when(k == 4, F.array(price)).otherwise(F.array().cast("array<double>"))
    rows = table(spark, sf, "orders").select("o_orderkey", claim.alias("claim"), F.array(span).alias("spans"), own.alias("own"))
    return reading.each_once(rows, ["claim", "spans", "own"], "status", figures.figure_status("claim", "spans", "own", cap=8000)).select("o_orderkey", "status")


@query("""WITH p AS (SELECT l_orderkey, list(round(l_extendedprice / 1000, 3)) AS pool, max(round(l_extendedprice, -2)) AS v FROM lineitem GROUP BY 1)
SELECT l_orderkey, len(list_filter(pool, lambda c: len(list_filter([1e-12, 1e-9, 1e-6, 1e-3, 1.0, 1e3, 1e6, 1e9, 1e12, 1e-2, 1e2], lambda f: c * f >= v - 0.5 - 1e-9 AND c * f < v + 0.5 - 1e-9)) > 0)) > 0 AS carried FROM p""")
def e29_carried(spark, sf):
    """The band test as a column expression."""
    g = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_list(metrics.rounded(F.col("l_extendedprice") / 1000, 3)).alias("pool"), F.max(metrics.rounded(F.col("l_extendedprice"), -2)).alias("v"))
    return g.select("l_orderkey", figures.carried(F.col("v"), F.lit(0), F.col("pool")).alias("carried"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 4 <> 0 THEN p_retailprice END AS eps FROM part""")
def e33_eps(spark, sf):
    """Earnings per share in a filing's words."""
    t = F.when(F.col("p_partkey") % 4 != 0, F.concat(F.lit("Diluted Earnings per share of $"), F.format_string("%.2f", F.col("p_retailprice")), F.lit("."))).otherwise("No earnings were stated.")
    return table(spark, sf, "part").select("p_partkey", figures.earnings_per_share(t).alias("eps"))


@query("""WITH p AS (SELECT p_partkey, p_retailprice AS c, 0.05 AS t, CASE WHEN p_partkey % 6 <> 0 THEN p_retailprice * (0.9 + (p_partkey % 5) * 0.05) END AS r, p_size FROM part),
x AS (SELECT p_partkey, coalesce(r, c) AS point, CASE WHEN r IS NULL THEN 10 * greatest(1, abs(c), p_size) ELSE greatest(abs(r) * t * 2, 0.05) END AS half,
  CASE WHEN r IS NULL THEN 'inline' WHEN r > c * (1 + t) THEN 'beat' WHEN r < c * (1 - t) THEN 'miss' ELSE 'inline' END AS label FROM p)
SELECT p_partkey, CASE WHEN label = 'miss' AND p_partkey % 2 = 0 THEN 'inline' ELSE label END AS label, round(point, 6) AS point, round(point - half, 6) AS low, round(point + half, 6) AS high FROM x""")
def i2_predictions(spark, sf):
    """The deterministic agent's rows."""
    k, c = F.col("p_partkey"), F.col("p_retailprice")
    reported = F.when(k % 6 != 0, c * (0.9 + (k % 5) * 0.05))
    labels = F.when(k % 2 == 0, F.array(F.lit("beat"), F.lit("inline"))).otherwise(F.array(F.lit("beat"), F.lit("miss"), F.lit("inline")))
    x = agents.predicted(reported, c, F.lit(0.05), agents.uninformative_band([c, F.col("p_size")]), labels)
    return table(spark, sf, "part").select("p_partkey", x.alias("x")).select("p_partkey", "x.label", F.round("x.point_forecast", 6).alias("point"), F.round("x.low", 6).alias("low"), F.round("x.high", 6).alias("high"))


@query("""SELECT event_id, round(CASE WHEN event_id % 3 = 0 THEN value - 1 ELSE value - greatest(abs(value) / 2, 1) END, 6) AS low, round(CASE WHEN event_id % 3 = 0 THEN value + 1 ELSE value + greatest(abs(value) / 2, 1) END, 6) AS high FROM events""")
def i4_safe_interval(spark, sf):
    """Unsound intervals are replaced around the centre."""
    e, v = F.col("event_id") % 3, F.col("value")
    x = agents.safe_interval(F.when(e == 0, v - 1).when(e == 1, v + 5).otherwise(None), F.when(e == 0, v + 1).when(e == 1, v - 5).otherwise(v), v)
    return table(spark, sf, "events").select("event_id", x.alias("x")).select("event_id", F.round("x.low", 6).alias("low"), F.round("x.high", 6).alias("high"))


@query("""SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'beat' ELSE 'miss' END AS label, round(CASE WHEN event_id % 3 = 2 THEN 0 ELSE value END, 4) AS point FROM events""")
def i7_reply_rows(spark, sf):
    """Rows from a model's replies in prose."""
    e, v = F.col("event_id") % 3, F.col("value").cast("string")
    reply = F.when(e == 0, F.concat(F.lit('Sure: {"label": "beat", "point_forecast": '), v, F.lit("} as asked"))).when(e == 1, F.concat(F.lit('{"label": "unknown", "point_forecast": '), v, F.lit("}"))).otherwise("I can't say.")
    row = agents.from_reply(agents.reply_object(reply), F.when(e == 0, F.array(F.lit("miss"), F.lit("beat"))).otherwise(F.array(F.lit("miss"))))
    return table(spark, sf, "events").select("event_id", row["label"].alias("label"), F.round(row["point_forecast"], 4).alias("point"))


@query("""SELECT family, kind, verdict, sum(n)::BIGINT AS n FROM (
  SELECT 'date' AS family, 'iso' AS kind, 'covered' AS verdict, count(*) AS n FROM orders WHERE o_orderkey % 3 = 0
  UNION ALL SELECT 'spelled', 'point', 'covered', count(*) FROM orders WHERE o_orderkey % 3 = 1
  UNION ALL SELECT 'fraction', 'simple', 'covered', count(*) FROM orders WHERE o_orderkey % 3 = 2
  ) GROUP BY 1, 2, 3 HAVING sum(n) > 0
UNION ALL SELECT 'unread', 'year_or_period', 'left_alone', count(*) FROM orders WHERE o_orderkey % 3 = 0""")
def j1_profile(spark, sf):
    """Number forms by family, kind and verdict."""
    k = F.col("o_orderkey") % 3
    t = F.when(k == 0, F.concat(F.lit("On "), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(" it went on"))).when(k == 1, "It moved twenty-five basis points").otherwise("It moved by ½ percentage point")
    texts = table(spark, sf, "orders").groupBy(t.alias("t")).agg(F.count(F.lit(1)).alias("times"))
    report = profile.profile(dealt(texts, rows=reading.ROWS), "t", "times")
    return report.groupBy("family", "kind", "verdict").agg(F.sum("n").alias("n"))


@query()
def j1_pages_profile(spark, sf):
    """J1 to J11 over real pages and documents."""
    texts = table(spark, sf, "pages").select(F.col("html").alias("t")).union(table(spark, sf, "documents").select("text"))
    return profile.profile(spread(texts), "t")


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN ['leaderboard'] WHEN 1 THEN ['units/', '://'] WHEN 2 THEN [] ELSE ['canary'] END::VARCHAR[] AS denied FROM events""")
def j12_denied(spark, sf):
    """Denied words, also disguised."""
    e = F.col("event_id") % 4
    t = F.when(e == 0, "See the LeaderBoard").when(e == 1, "http:⁄⁄x.com units/ab").when(e == 2, "All fine").otherwise("a can​ary sings")
    return table(spark, sf, "events").select("event_id", urls.fold_text(t).alias("seen")).select("event_id", reasons.denied(F.col("seen")).alias("denied"))


@query("""SELECT d.doc_id AS unit, b.text AS premise, contains(d.text, trim(b.text)) AS is_quote FROM documents d JOIN benchmark b ON d.doc_id % (SELECT count(*) FROM benchmark) = b.item_id""")
def j13_premise_quotes(spark, sf):
    """Premises that quote a document of their unit."""
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("unit"), "text")
    premises = docs.select("unit", items(spark, sf, "unit").alias("item_id")).join(table(spark, sf, "benchmark").withColumnRenamed("text", "premise"), "item_id").select("unit", "premise")
    return reasons.premise_quotes(premises, docs, ["unit"], masked=False)


@query("""WITH RECURSIVE o AS (SELECT l_orderkey AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS i, l_quantity::BIGINT AS q, (l_extendedprice / 100)::BIGINT AS e FROM lineitem),
r AS (SELECT k, 0::BIGINT AS i, 0::BIGINT AS sq, 0::BIGINT AS se, NULL::VARCHAR AS why FROM o GROUP BY 1
UNION ALL SELECT r.k, o.i, CASE WHEN r.sq + o.q <= 60 AND r.se + o.e <= 900 THEN r.sq + o.q ELSE r.sq END, CASE WHEN r.sq + o.q <= 60 AND r.se + o.e <= 900 THEN r.se + o.e ELSE r.se END,
  CASE WHEN r.sq + o.q > 60 THEN 'q' WHEN r.se + o.e > 900 THEN 'e' END FROM r JOIN o ON o.k = r.k AND o.i = r.i + 1)
SELECT k, i AS pos, why IS NULL AS judged, why FROM r WHERE i > 0""")
def h6_greedy_budget(spark, sf):
    """The greedy budget that skips and goes on."""
    from pyspark.sql.window import Window as W

    place = F.row_number().over(W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    items = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"), place.cast("long").alias("pos"), F.rint("l_quantity").cast("long").alias("q"), F.rint(F.col("l_extendedprice") / 100).cast("long").alias("e"), F.lit(None).cast("string").alias("blocked"))
    return reasons.greedy_budget(items, ["k"], ["q", "e"], [60, 900])


@query("""WITH c AS (SELECT c_custkey AS pos, c_nationkey AS unit, lower(c_mktsegment) AS a FROM customer)
SELECT unit, pos, row_number() OVER (PARTITION BY unit, a ORDER BY pos) > 1 AS duplicate, 'r' || row_number() OVER (PARTITION BY unit ORDER BY pos) AS reason_id FROM c""")
def h7_duplicates(spark, sf):
    """H7 H8: content duplicates after the first, and renumbered ids."""
    c = table(spark, sf, "customer")
    rows = c.select(F.col("c_nationkey").alias("unit"), F.col("c_custkey").alias("pos"), F.when(F.col("c_custkey") % 2 == 0, F.lower("c_mktsegment")).otherwise(F.concat(F.lit(" "), F.col("c_mktsegment"))).alias("premise"), F.lit("m").alias("mechanism"), F.lit("a").alias("answer_implication"))
    return reasons.renumbered(reasons.first_of_each(rows, ["unit"]), ["unit"]).select("unit", "pos", "duplicate", "reason_id")


@query("""SELECT c_custkey, (octet_length(encode(c_mktsegment)) + octet_length(encode(c_name)) + 15)::INT AS bytes, CASE WHEN c_custkey % 5 = 0 THEN 'no_id' WHEN c_custkey % 7 = 0 THEN 'empty_text' END AS fault, CASE WHEN c_custkey % 5 IN (0, 4) THEN 'count' END AS n_fault FROM customer""")
def g22_reason_shape(spark, sf):
    """Sizes in bytes of compact sorted JSON, and shapes."""
    k = F.col("c_custkey")
    size = reasons.byte_size(reasons.compact_json(("b", F.col("c_name")), ("a", F.col("c_mktsegment"))))
    fault = reasons.shape_fault(F.when(k % 5 != 0, "r"), F.col("c_name"), F.when(k % 7 == 0, " ").otherwise("x"))
    return table(spark, sf, "customer").select("c_custkey", size.alias("bytes"), fault.alias("fault"), reasons.count_fault(k % 5).alias("n_fault"))


@query("""WITH p AS (SELECT a.vec_id AS a, b.vec_id AS b, list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / (sqrt(list_inner_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_inner_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[]))) AS dense
  FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)
SELECT a, round(dense, 8) AS dense, round(0.4 * CASE WHEN a % 2 = 0 THEN (a % 10) / 10 ELSE 0 END + 0.6 * dense, 8) AS hybrid FROM p""")
def l1_hybrid(spark, sf):
    """L1: lexical and dense scores mixed."""
    v = table(spark, sf, "embeddings").select("vec_id", "embedding")
    pairs = v.select(F.col("vec_id").alias("a"), F.col("embedding").alias("x"), (F.col("vec_id") + 1).alias("vec_id")).join(v, "vec_id")
    dense = retrieval.cosine(F.col("x"), F.col("embedding"))
    return pairs.select("a", F.round(dense, 8).alias("dense"), F.round(retrieval.hybrid(F.when(F.col("a") % 2 == 0, F.col("a") % 10 / 10), dense), 8).alias("hybrid"))


@query("""SELECT doc_id, sha256(text) AS sha256, octet_length(encode(text))::INT AS bytes, octet_length(encode(text)) > 8000 AS too_large, sha256(text) = sha256(CASE WHEN doc_id % 9 = 0 THEN text || ' ' ELSE text END) AS sound FROM documents""")
def a8_digests(spark, sf):
    """Digests and sizes of texts, and those that a declared digest refuses."""
    t = F.col("text")
    declared = F.sha2(F.when(F.col("doc_id") % 9 == 0, F.concat(t, F.lit(" "))).otherwise(t), 256)
    return table(spark, sf, "documents").select("doc_id", F.sha2(t, 256).alias("sha256"), F.octet_length(t).alias("bytes"), (F.octet_length(t) > 8000).alias("too_large"), (F.sha2(t, 256) == declared).alias("sound"))


@query("""SELECT 'u' || c_nationkey AS unit, 'corpus/D' || c_custkey || '.json' AS file, CASE WHEN c_custkey % 4 = 0 THEN '' ELSE 'D' || c_custkey END AS doc_id, c_custkey % 3 = 0 AS shared,
  CASE WHEN c_custkey % 4 = 0 THEN 'path' WHEN c_custkey % 6 = 0 THEN 'shared_and_labelled' END AS fault FROM customer""")
def a5_manifest(spark, sf):
    """Manifests parsed, entries checked, ids from paths."""
    k = F.col("c_custkey")
    name = F.when(k % 4 == 0, F.concat(F.lit("corpus//D"), k.cast("string"), F.lit(".json"))).otherwise(F.concat(F.lit("corpus/D"), k.cast("string"), F.lit(".json")))
    entry = F.struct(name.alias("path"), F.lit("corpus").alias("role"), F.sha2(F.col("c_name"), 256).alias("sha256"), F.lit(10).alias("bytes"), (k % 3 == 0).alias("shared"), F.when(k % 2 == 0, F.array(F.col("c_name"))).alias("entity_ids"))
    made = table(spark, sf, "customer").groupBy(F.concat(F.lit("u"), F.col("c_nationkey").cast("string")).alias("unit")).agg(F.to_json(F.struct(F.collect_list(entry).alias("files"))).cast("binary").alias("content")).withColumn("file", F.lit("manifest.json"))
    found = bundle.manifest_entries(made)
    return found.select("unit", F.regexp_replace("file", "//", "/").alias("file"), "doc_id", "shared", "fault")


@query("""SELECT event_id, CASE event_id % 4 WHEN 1 THEN 'non_finite' WHEN 2 THEN 'not_json' WHEN 3 THEN 'not_json' END AS fault, CASE WHEN event_id % 4 = 0 THEN 't' || event_id END AS task_id FROM events""")
def a13_answers(spark, sf):
    """Answers read; what is no JSON object, and numbers that JSON doesn't know, are faults."""
    e, t = F.col("event_id") % 4, F.col("event_id").cast("string")
    raw = F.when(e == 0, F.concat(F.lit('{"task_id": "t'), t, F.lit('", "entity_predictions": []}'))).when(e == 1, '{"x": NaN}').when(e == 2, "[1]").otherwise("{oops")
    return bundle.answers(table(spark, sf, "events").select(F.col("event_id").alias("unit"), raw.cast("binary").alias("content"))).select(F.col("unit").alias("event_id"), "fault", F.when(F.col("fault").isNull(), F.col("task_id")).alias("task_id"))


@query("""SELECT 'S' || l_orderkey AS submission_id, count(*) AS n, sum(l_suppkey)::BIGINT AS entities, round(sum(round(l_extendedprice, 4)), 2) AS points, 't' || any_value(l_orderkey % 7) AS task_id, sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END)::BIGINT AS returned FROM lineitem GROUP BY l_orderkey""")
def a22_answer_sink(spark, sf):
    """Answers written as JSON, in roster order, and read back."""
    rows = table(spark, sf, "lineitem").select(F.concat(F.lit("S"), F.col("l_orderkey").cast("string")).alias("submission_id"), F.lit("u").alias("unit_id"), F.concat(F.lit("t"), (F.col("l_orderkey") % 7).cast("string")).alias("task_id"), F.col("l_linenumber").alias("pos"), F.col("l_suppkey").alias("entity_id"), F.col("l_returnflag").alias("label"), agents.rounded(F.col("l_extendedprice")).alias("point_forecast"), F.lit(0.9).alias("level"), F.col("l_discount").alias("low"), F.col("l_tax").alias("high"), F.array(F.struct(F.lit("task").alias("doc_id"))).alias("claims"))
    answer = agents.answer_json(rows)
    back = F.from_json("answer", "task_id string, entity_predictions array<struct<entity_id:bigint,label:string,point_forecast:double,claims:array<struct<doc_id:string>>>>")
    rows = back["entity_predictions"]
    total = lambda xs: F.aggregate(xs, F.lit(0).cast("long"), lambda a, x: a + x)
    points = F.aggregate(F.transform(rows, lambda r: r["point_forecast"]), F.lit(0.0), lambda a, x: a + x)
    returned = F.size(F.filter(rows, lambda r: (r["label"] == "R") & (r["claims"][0]["doc_id"] == "task"))).cast("long")
    return answer.select("submission_id", F.size(rows).cast("long").alias("n"), total(F.transform(rows, lambda r: r["entity_id"])).alias("entities"), F.round(points, 2).alias("points"), back["task_id"].alias("task_id"), returned.alias("returned"))


REASON = "CASE o_orderkey % 8 WHEN 0 THEN 'post_cutoff' WHEN 1 THEN 'missing' WHEN 2 THEN 'schema' WHEN 3 THEN 'reversed' WHEN 4 THEN 'no_answer' WHEN 5 THEN 'unresolved' WHEN 6 THEN 'task_mismatch' END"


@query(f"""WITH r AS (SELECT o_orderkey, {REASON} AS reason FROM orders)
SELECT o_orderkey, CASE WHEN reason = 'reversed' THEN 't4_miscalibrated_interval' WHEN reason = 'unresolved' THEN 't4_unfaithful_citation' WHEN reason = 'post_cutoff' THEN 't4_stale_evidence' WHEN reason IS NOT NULL THEN 'schema_invalid_output' END AS label,
  CASE reason WHEN 'post_cutoff' THEN 'cutoff_violation' WHEN 'missing' THEN 'incomplete_output' WHEN 'schema' THEN 'schema_invalid' WHEN 'no_answer' THEN 'no_output' ELSE CASE WHEN reason IS NOT NULL THEN 'domain_gate_failed' END END AS code,
  CASE WHEN reason IS NOT NULL THEN o_orderkey % 5 END::BIGINT AS missing_count FROM r""")
def b26_labels(spark, sf):
    """The public label and code of each reason, and the detail that may be published: code and counts."""
    k = F.col("o_orderkey")
    reason = reduce(lambda chain, x: F.when(k % 8 == x[0], x[1]).otherwise(chain), enumerate(["post_cutoff", "missing", "schema", "reversed", "no_answer", "unresolved", "task_mismatch"]), F.lit(None).cast("string"))
    rows = table(spark, sf, "orders").withColumn("reason", reason)
    detail = outcomes.public_detail(F.col("reason"), {"missing_count": k % 5})
    return rows.select("o_orderkey", outcomes.public_label(F.col("reason")).alias("label"), detail["code"].alias("code"), detail["missing_count"].alias("missing_count"))


@query("""SELECT d.doc_id, b.text AS hypothesis, round(len(list_intersect(list_distinct(list_filter(string_split_regex(lower(trim(b.text)), '[ \n\t\r]+'), lambda x: length(x) > 2)), list_distinct(list_filter(string_split_regex(lower(trim(d.text)), '[ \n\t\r]+'), lambda x: length(x) > 2))))
  / len(list_distinct(list_filter(string_split_regex(lower(trim(b.text)), '[ \n\t\r]+'), lambda x: length(x) > 2))), 8) AS contradiction FROM documents d JOIN benchmark b ON d.doc_id % (SELECT count(*) FROM benchmark) = b.item_id WHERE d.doc_id % 3 = 0
UNION ALL SELECT d.doc_id, b.text, NULL FROM documents d JOIN benchmark b ON d.doc_id % (SELECT count(*) FROM benchmark) = b.item_id WHERE d.doc_id % 3 <> 0""")
def o3_lazy_judge(spark, sf):
    """The judge runs on open claims only, once for each distinct pair."""
    from lodeframe.operators import judges

    claims = table(spark, sf, "documents").select("doc_id", F.col("text").alias("premise"), items(spark, sf, "doc_id").alias("item_id")).join(table(spark, sf, "benchmark").withColumnRenamed("text", "hypothesis"), "item_id").withColumn("open", F.col("doc_id") % 3 == 0)
    judge = lambda pairs: pairs.select("pair", judges.lexical(F.col("premise"), F.col("hypothesis")).alias("contradiction"))
    return verdicts.judge_open(claims, judge, ["doc_id"], "premise", "hypothesis").select("doc_id", "hypothesis", F.round("contradiction", 8).alias("contradiction"))


QUERIES, ORACLES = query.queries, query.oracles
