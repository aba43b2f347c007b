"""Planted forms: a sentence for each rule of the figure reader and of the number-form profile, and the small parts of bundles, each with its SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodeframe.functions import figures, urls
from lodeframe.operators import alignment, citations, judges, profile, reading, retrieval, scoring
from lodeframe.plans.bindings import Registry
from lodeframe.session import table
from lodeframe.sources import bundle

query = Registry()

N = "(o_orderkey % 89 + 11)"  # two digits that belong to no rule
FORMS = [  # a sentence around N, and the figures that it states
    ("It was {n}.5bn", ["{n}500000000"]),
    ("It was {n}.25k and {n}bps", ["{n}250", "{n}"]),
    ("It was {n}tn, {n}mn and {n} x", ["{n}000000000000", "{n}000000", "{n}"]),
    ("on 3/20 it was {n}", ["{n}"]),
    ("the 5/6 memo said {n}", ["5", "6", "{n}"]),
    ("between 3/20 and 4/15 it was {n}", ["{n}"]),
    ("it grew {n}-1/4 percent", ["{n}.25"]),
    ("it grew {n} 3/4 percent", ["{n}.75"]),
    ("a quarter-point cut from {n}", ["0.25", "{n}"]),
    ("the first quarter percent change was {n}", ["{n}"]),
    ("raised half a percentage point to {n}", ["0.5", "{n}"]),
    ("an eighth of a point over {n}", ["0.125", "{n}"]),
    ("twenty-five basis points over {n}", ["25", "{n}"]),
    ("four and a half percent over {n}", ["4.5", "{n}"]),
    ("one hundred fifty billion over {n}", ["150", "{n}"]),
    ("it cost ${n}mm", ["{n}000000"]),
    ("it cost $61.2B5 and {n}.5Total", ["61200000000", "5", "{n}.5"]),
    ("over {n}.3yrs at CNY2.40", ["{n}.3", "2.40"]),
    ("{n}.4² was noted", ["{n}.4"]),
    ("1982-84=100 stood at {n}", ["{n}"]),
    ("Q4-25, 03/2025 and rule 13a-15 at {n}", ["{n}"]),
    ("31 March 2025, 3rd of Item 2.02, Form 10-K, {n}", ["{n}"]),
]


def _sentence(texts: list[str], k: Column, n: Column) -> Column:
    number = n.cast("string")
    made = [reduce(lambda a, b: F.concat(a, number, b), [F.lit(x) for x in t.split("{n}")]) for t in texts]
    return reduce(lambda chain, x: F.when(k == x[0], x[1]).otherwise(chain), enumerate(made), F.lit(None).cast("string"))


def _sql(text: str) -> str:
    return " || ".join(["'" + x.replace("'", "''") + "'" for x in text.split("{n}")]).replace(" || ", f" || {N} || ")


@query(f"SELECT o_orderkey, CASE o_orderkey % {len(FORMS)} " + " ".join(f"WHEN {k} THEN [{', '.join(_sql(x) for x in found)}]" for k, (_, found) in enumerate(FORMS)) + " END AS figures FROM orders")
def e5_forms(spark, sf):
    """The figures of a sentence for each rule, around a number of the row."""
    k, n = F.col("o_orderkey") % len(FORMS), F.col("o_orderkey") % 89 + 11
    rows = table(spark, sf, "orders").select("o_orderkey", _sentence([t for t, _ in FORMS], k, n).alias("text"))
    return reading.each_once(rows, ["text"], "figures", F.transform(figures.figures_of("text"), lambda f: f["value"])).select("o_orderkey", "figures")


CLAIMS = [  # claim, span, status by "every", status by "any"
    ("We saw {n} and 7", "they had {n}", "unanchored", "anchored"),
    ("We saw {n} and 7", "they had {n} of 7", "anchored", "anchored"),
    ("We saw {n}", "they had none", "unanchored", "unanchored"),
    ("We saw them", "they had {n}", "no_figures", "no_figures"),
    ("Our 95.5% interval is at {n}", "they had {n}", "anchored", "anchored"),
    ("Our 95.5% interval is wide", "they had {n}", "no_figures", "unanchored"),
    ("Lot 7: they had {n} of all things", "they had {n} of all things, and more", "unanchored", "anchored"),
    ("Note: they had {n} of all things", "they had {n} of all things, and more", "anchored", "anchored"),
    ("They had {n}.0 thousand", "they had {n}000", "anchored", "anchored"),
]


@query(f"SELECT o_orderkey, CASE o_orderkey % {len(CLAIMS)} " + " ".join(f"WHEN {k} THEN '{c[2]}'" for k, c in enumerate(CLAIMS)) + f" END AS by_every, CASE o_orderkey % {len(CLAIMS)} " + " ".join(f"WHEN {k} THEN '{c[3]}'" for k, c in enumerate(CLAIMS)) + " END AS by_any FROM orders")
def e32_rules(spark, sf):
    """Claims by both rules: levels, labels before quotes, scales."""
    k, n = F.col("o_orderkey") % len(CLAIMS), F.col("o_orderkey") % 89 + 11
    rows = table(spark, sf, "orders").select("o_orderkey", _sentence([c[0] for c in CLAIMS], k, n).alias("claim"), F.array(_sentence([c[1] for c in CLAIMS], k, n)).alias("spans"))
    every = figures.figure_status("claim", "spans", cap=8000, levels=F.array(F.lit(0.955)))
    both = F.struct(every.alias("by_every"), figures.figure_status("claim", "spans", rule="any").alias("by_any"))
    return reading.each_once(rows, ["claim", "spans"], "x", both).select("o_orderkey", "x.by_every", "x.by_any")


CASES = [  # a text, and the family, kind and verdict of its one match in that family
    ("a quarter-point cut from {n}", "fraction_word", "quarter", "covered"),
    ("the first quarter percent was {n}", "fraction_word", "period_word", "covered"),
    ("half point was {n}", "fraction_word", "no_move_context", "covered"),
    ("two-thirds point rise from {n}", "fraction_word", "two_thirds", "left_alone"),
    ("1982-84=100 at {n}", "index_base", "year_base", "covered"),
    ("on 3/20 it was {n}", "date", "m_d", "covered"),
    ("the 5/6 memo of {n}", "date", "m_d_no_date_word", "left_alone"),
    ("phase 2/3 of {n}", "date", "m_d_not_a_date", "covered"),
    ("1/2 warrant of {n}", "date", "m_d_not_a_date", "covered"),
    ("it was 3-{n}%", "range", "amounts", "covered"),
    ("it was {n}.4²", "footnote", "superscript", "covered"),
    ("it was {n}.5%1", "footnote", "percent_digit", "covered"),
    ("it was {n}.25**", "footnote", "star", "covered"),
    ("it cost ${n}mm", "glued", "currency_mm", "covered"),
    ("it was {n}mm long", "glued", "mm_length", "left_alone"),
    ("it was {n}.5bn", "glued", "suffix_bn", "covered"),
    ("the {n}th of them", "glued", "ordinal", "covered"),
    ("a {n}yr note", "glued", "tenor", "left_alone"),
    ("over {n}.3yrs", "glued", "duration", "covered"),
    ("it was {n}.5Total", "glued", "value_then_label", "covered"),
]


@query(f"WITH c AS (SELECT * FROM (VALUES {', '.join(f'''({k}, '{c[1]}', '{c[2]}', '{c[3]}')''' for k, c in enumerate(CASES))}) v(k, family, kind, verdict)) SELECT o_orderkey, family, kind, verdict FROM orders JOIN c ON k = o_orderkey % {len(CASES)}")
def j3_cases(spark, sf):
    """A planted match of each kind, and the verdict on it."""
    k, n = F.col("o_orderkey") % len(CASES), F.col("o_orderkey") % 89 + 11
    family = reduce(lambda chain, x: F.when(k == x[0], x[1][1]).otherwise(chain), enumerate(CASES), F.lit(None).cast("string"))
    rows = table(spark, sf, "orders").select("o_orderkey", family.alias("asked"), _sentence([c[0] for c in CASES], k, n).alias("text"))
    return profile.each_judged(rows, "text").filter("family = asked").select("o_orderkey", "family", "kind", "verdict")


@query("""WITH s AS (SELECT conv_id, turn, coalesce(text, '') AS text, coalesce(sum(length(coalesce(text, '')) + 1) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM conversations)
SELECT conv_id AS doc_id, start, (start + length(text))::BIGINT AS "end", text FROM s WHERE text <> ''""")
def a17_span_chunks(spark, sf):
    """A chunk for each turn of a conversation, with its place in the joined text."""
    turns = table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("spans"))
    chunks = retrieval.span_chunks(turns.select(F.col("conv_id").alias("doc_id"), F.lit("2024-01-01").cast("date").alias("doc_date"), "spans"))
    return chunks.select("doc_id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "text")


@query("""SELECT conv_id AS doc_id, CASE WHEN conv_id % 3 = 0 THEN 'whole ' || conv_id WHEN conv_id % 3 = 1 THEN string_agg(coalesce(text, ''), ' ' ORDER BY turn) ELSE '' END AS text FROM conversations GROUP BY conv_id""")
def a16_document_text(spark, sf):
    """A document's text, else its spans joined, else nothing."""
    k = F.col("conv_id") % 3
    turns = table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.coalesce("text", F.lit("")).alias("text")))).alias("spans"))
    text = retrieval.document_text(F.when(k == 0, F.concat(F.lit("whole "), F.col("conv_id").cast("string"))), F.when(k == 1, F.col("spans")))
    return turns.select(F.col("conv_id").alias("doc_id"), text.alias("text"))


@query("""WITH f AS (SELECT c_nationkey AS root, 'd' || c_custkey AS file, sha256(c_name) AS sha FROM customer)
SELECT root, sha256('{' || string_agg('"' || file || '":"' || sha || '"', ',' ORDER BY file) || '}') AS digest, count(*) AS files FROM f GROUP BY root""")
def a26_tree_digest(spark, sf):
    """One digest of a tree of files, from sorted paths and digests."""
    listing = table(spark, sf, "customer").select(F.col("c_nationkey").alias("root"), F.concat(F.lit("d"), F.col("c_custkey").cast("string")).alias("file"), F.sha2("c_name", 256).alias("sha256"))
    return bundle.tree_digest(listing)


@query("""SELECT c_custkey AS doc, CASE c_custkey % 6 WHEN 1 THEN 'digest_mismatch' WHEN 2 THEN 'missing_file' WHEN 3 THEN 'not_json' WHEN 4 THEN 'no_date' END AS fault, CASE WHEN c_custkey % 6 IN (0, 5) THEN c_name END AS text FROM customer""")
def a8_documents(spark, sf):
    """Declared files with their bytes: digests, form and dates are verified, and each fault is named."""
    k = F.col("c_custkey") % 6
    c = table(spark, sf, "customer").withColumn("unit", F.concat(F.lit("u"), F.col("c_nationkey").cast("string"))).withColumn("doc_id", F.concat(F.lit("D"), F.col("c_custkey").cast("string"))).withColumn("file", F.concat(F.lit("corpus/"), F.col("doc_id"), F.lit(".json")))
    body = F.when(k == 3, "[oops").otherwise(F.concat(F.lit('{"text": "'), F.col("c_name"), F.lit('"'), F.when(k == 4, "").otherwise(', "doc_date": "2024-01-02"'), F.lit("}")))
    corpus = c.filter(k != 2).select("unit", "file", body.cast("binary").alias("content")).withColumn("bytes", F.length("content").cast("long")).withColumn("sha256", F.sha2("content", 256))
    entries = c.select("unit", "file", "doc_id", F.when(k == 1, F.sha2(F.lit("x"), 256)).otherwise(F.sha2(body.cast("binary"), 256)).alias("declared"), F.lit(True).alias("shared"), F.lit(None).cast("array<string>").alias("entity_ids"), F.lit(None).cast("string").alias("fault"))
    found = bundle.verified_documents(entries, corpus)
    return found.select(F.substring("doc_id", 2, 20).cast("int").alias("doc"), "fault", F.when(F.col("fault").isNull(), F.col("text")).alias("text"))


@query("""WITH t AS (SELECT c_nationkey AS unit, c_custkey, CASE WHEN c_nationkey % 5 = 1 AND c_custkey % 10 = 0 THEN '' WHEN c_nationkey % 5 = 2 THEN 'C' || (c_custkey % 3) ELSE 'C' || c_custkey END AS e FROM customer)
SELECT unit, count(*) FILTER (trim(e) = '') AS n_empty, (count(e) - count(DISTINCT e))::BIGINT AS n_repeated FROM t GROUP BY unit HAVING count(*) FILTER (trim(e) = '') > 0 OR count(e) > count(DISTINCT e)""")
def b3_rosters(spark, sf):
    """Rosters from tasks, and those that can't be trusted."""
    kind, k = F.col("c_nationkey") % 5, F.col("c_custkey")
    entity = F.when((kind == 1) & (k % 10 == 0), "").when(kind == 2, F.concat(F.lit("C"), (k % 3).cast("string"))).otherwise(F.concat(F.lit("C"), k.cast("string")))
    tasks = table(spark, sf, "customer").select(F.col("c_nationkey").alias("unit"), F.struct(k.alias("k"), entity.alias("e")).alias("x")).groupBy("unit").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["e"]).alias("entities"))
    return alignment.roster_faults(alignment.build_roster(tasks, ["unit"]), ["unit"])


@query("""SELECT c_nationkey % 4 AS submission_id, c_nationkey AS unit_id, 'task_mismatch' AS task_reason FROM (SELECT DISTINCT c_nationkey FROM customer) WHERE c_nationkey % 3 <> 0""")
def b2_binding(spark, sf):
    """B2: answers that name another task than their unit's."""
    unit = table(spark, sf, "customer").select(F.col("c_nationkey").alias("unit_id")).distinct()
    name = F.concat(F.lit("t"), F.col("unit_id").cast("string"))
    given = F.when(F.col("unit_id") % 3 == 1, "t").when(F.col("unit_id") % 3 == 0, name)
    return scoring.task_binding(unit.select((F.col("unit_id") % 4).alias("submission_id"), "unit_id", given.alias("task_id")), unit.select("unit_id", name.alias("task_id")))


@query("""SELECT doc_id, list_max([len(regexp_extract_all(text, '[^ ]+')), len(regexp_extract_all(text, '[A-Za-z]'))])::INT AS n FROM documents""")
def f5_tokens(spark, sf):
    """The tokens of a text, the most of two tokenisers."""
    import re

    words, letters = (lambda text, p=p: [m.span() for m in re.finditer(p, text)] for p in ("[^ ]+", "[A-Za-z]"))
    return table(spark, sf, "documents").select("doc_id", judges.token_count([words, letters])("text").alias("n"))


@query(r"""SELECT page_id, 'at ' || repeat('█', length(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^\s,;()\[\]{}<>"'']*'))) || url[length(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^\s,;()\[\]{}<>"'']*')) + 1:] AS masked FROM pages""")
def c18_masked(spark, sf):
    """Plain addresses masked at equal length."""
    return table(spark, sf, "pages").select("page_id", urls.mask_plain_addresses(F.concat(F.lit("at "), F.col("url"))).alias("masked"))


@query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 1 THEN 'unknown_doc' WHEN 2 THEN 'bad_span' ELSE 'bad_span' END AS code FROM orders WHERE o_orderkey % 4 <> 0""")
def i11_self_check(spark, sf):
    """The claims of an answer whose offsets don't resolve."""
    k = F.col("o_orderkey") % 4
    o = table(spark, sf, "orders").withColumn("unit_id", F.col("o_orderkey") % 7)
    claims = o.select("unit_id", F.col("o_orderkey").alias("entity_id"), F.when(k == 1, "none").otherwise(F.concat(F.lit("D"), F.col("o_orderkey").cast("string"))).alias("doc_id"), F.when(k != 3, 0).alias("span_start"), F.when(k == 2, 99).otherwise(4).alias("span_end"))
    docs = o.select("unit_id", F.concat(F.lit("D"), F.col("o_orderkey").cast("string")).alias("doc_id"), F.lit("some text").alias("text"))
    return bundle.self_check(claims, docs).select(F.col("entity_id").alias("o_orderkey"), "code")


@query("""WITH l AS (SELECT n_regionkey AS unit_id, n_nationkey AS e, '{"entity_id": "' || n_nationkey || '", "name": "' || n_name || '"}' AS line FROM nation),
p AS (SELECT *, coalesce(sum(length(line) + 1) OVER (PARTITION BY unit_id ORDER BY e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS start FROM l)
SELECT unit_id, e::VARCHAR AS entity_id, e % 3 = 1 AS wrong_entity, CASE e % 3 WHEN 0 THEN line WHEN 1 THEN line || chr(10) ELSE line[4:] END AS span, 'ok' AS embargo FROM p
WHERE NOT (e % 3 = 1 AND e = (SELECT max(q.e) FROM p q WHERE q.unit_id = p.unit_id))
UNION ALL SELECT unit_id, e::VARCHAR, TRUE, NULL, 'ok' FROM p WHERE e % 3 = 1 AND e = (SELECT max(q.e) FROM p q WHERE q.unit_id = p.unit_id)""")
def a11_task_documents(spark, sf):
    """The task's table as a document of its unit; an entity may cite its own row, or a part of it, and nothing beyond."""
    nation = table(spark, sf, "nation").select(F.col("n_regionkey").alias("unit_id"), F.col("n_nationkey").alias("pos"), F.col("n_nationkey").cast("string").alias("entity_id"), F.col("n_name").alias("name"))
    roster = nation.withColumn("line", F.format_string('{"entity_id": "%s", "name": "%s"}', "entity_id", "name"))
    units = roster.select("unit_id").distinct().withColumn("cutoff", F.lit("2024-06-30").cast("date"))
    rows = roster.join(units, "unit_id").withColumn("submission_id", F.lit("s"))
    places = citations.row_ranges(roster, ["unit_id"], "line", "pos")
    k = F.col("pos") % 3
    claims = places.select(F.lit("s").alias("submission_id"), "unit_id", "entity_id", F.lit(0).alias("claim_pos"), F.lit("task").alias("doc_id"), (F.col("row_start") + F.when(k == 2, 3).otherwise(0)).cast("int").alias("span_start"), (F.col("row_end") + F.when(k == 1, 1).otherwise(0)).cast("int").alias("span_end"), F.lit("x").alias("claim"))
    none = spark.createDataFrame([], "unit_id int, doc_id string, doc_date date, text string, shared boolean, entity_ids array<string>").withColumn("unit_id", F.col("unit_id").cast(nation.schema["unit_id"].dataType))
    cited = scoring.cited_spans(rows, claims, scoring.with_task_documents(none, units, roster))
    return cited.select("unit_id", "entity_id", "wrong_entity", "span", "embargo")


QUERIES, ORACLES = query.queries, query.oracles
