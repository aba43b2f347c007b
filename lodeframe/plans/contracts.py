"""Gates, memos, ledgers, panels and calibration on the test tables: what an evaluation asks of answers, judges and graders."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from lodeframe.functions import metrics, text
from lodeframe.operators import bands, calibration, judges, panel, profile, reading, schema, verdicts
from lodeframe.plans.bindings import Registry
from lodeframe.session import dealt, shared_folder, spread, table
from lodeframe.sources import bundle

query = Registry()

# ---- planted faults of answers: (the answer's text with the fault, what the gate has to report, in the order of the schema)
_CLAIM = '{"doc_id":"ORD-%s","span_start":0,"span_end":4.0,"claim":"c"}'
_ROW = '{"entity_id":"e%s","interval":{"level":0.90,"lo":-1,"hi":2.5e3},"claims":[%s]}'
_AT = "/entity_predictions/1"


def _answer(second: str = "", claim: str | None = None, interval: str | None = None, head: str = '"task_id":"t",', tail: str = "") -> str:
    """An answer of two rows; the key of the order stands for @."""
    row = second or _ROW % ("2", claim or _CLAIM % "@")
    if interval:
        row = row.replace('{"level":0.90,"lo":-1,"hi":2.5e3}', interval)
    return "{" + head + '"notes":{"free":true},"entity_predictions":[' + _ROW % ("@", _CLAIM % "@") + "," + row + "]" + tail + "}"


def _with(claim: str) -> str:
    return _answer(claim=claim)


PLANTED = [
    (_answer(), []),
    (_answer(head=""), [("", "required")]),
    (_answer(head='"task_id":7,'), [("/task_id", "type")]),
    ('{"task_id":"t","entity_predictions":[]}', [("/entity_predictions", "minItems")]),
    (_answer(interval='{"level":0.8,"lo":0,"hi":1}'), [(f"{_AT}/interval/level", "const")]),
    (_answer(interval='{"level":0.9,"hi":1}'), [(f"{_AT}/interval", "required")]),
    (_answer(interval='{"level":0.9,"lo":"0","hi":1}'), [(f"{_AT}/interval/lo", "type")]),
    (_with('{"doc_id":"d","span_start":true,"span_end":4,"claim":"c"}'), [(f"{_AT}/claims/0/span_start", "type")]),
    (_with('{"doc_id":"d","span_start":"3","span_end":4,"claim":"c"}'), [(f"{_AT}/claims/0/span_start", "type")]),
    (_with('{"doc_id":"d","span_start":-1,"span_end":4,"claim":"c"}'), [(f"{_AT}/claims/0/span_start", "minimum")]),
    (_with('{"doc_id":"d","span_start":0,"claim":"c"}'), [(f"{_AT}/claims/0", "required")]),
    (_answer(second='{"entity_id":"b","interval":{"level":0.9,"lo":0,"hi":1},"claims":[]}'), [(f"{_AT}/claims", "minItems")]),
    (_with('{"doc_id":"d","span_start":3.5,"span_end":4,"text":"c"}'), [(f"{_AT}/claims/0/span_start", "type")]),
    (_answer(tail=',"target_type":"guess"'), [("/target_type", "enum")]),
    (_answer(tail=',"submitted_reasons":[{"reason_id":"r","premise":"p","mechanism":"m","answer_implication":"a"},{"reason_id":"r","premise":"","mechanism":"m","answer_implication":"a"},{"premise":"p","mechanism":"m"},{"reason_id":"r","premise":"p","mechanism":"m","answer_implication":"a"}]'), [("/submitted_reasons", "maxItems"), ("/submitted_reasons/1/premise", "minLength"), ("/submitted_reasons/2", "required"), ("/submitted_reasons/2", "required")]),
    (_with('{"doc_id":"d","span_start":0,"span_end":1}'), [(f"{_AT}/claims/0", "anyOf")]),
    ('{"task_id":"t","entity_predictions":[', [("", "json")]),
    (_answer(second='{"entity_id":"","rank":0,"interval":{"level":"x"},"claims":"none"}'), [(f"{_AT}/claims", "type"), (f"{_AT}/entity_id", "minLength"), (f"{_AT}/interval", "required"), (f"{_AT}/interval", "required"), (f"{_AT}/interval/level", "const"), (f"{_AT}/interval/level", "type"), (f"{_AT}/rank", "minimum")]),
    ("[1]", [("", "type")]),
]


def _listed(faults: list[tuple[str, str]]) -> str:
    return ",".join(sorted(f"{path} {keyword}" for path, keyword in faults))


@query(f"""SELECT o_orderkey, {len(PLANTED)}::INT AS kinds, (['{"','".join(_listed(f) for _, f in PLANTED)}'])[(o_orderkey % {len(PLANTED)})::INT + 1] AS faults, ([{",".join(str(len(f)) for _, f in PLANTED)}])[(o_orderkey % {len(PLANTED)})::INT + 1]::INT AS n FROM orders""")
def b1_schema_gate(spark, sf):
    """B1: every fault of an answer against its schema, one planted fault or more for each keyword, as places and as their number."""
    orders = dealt(table(spark, sf, "orders").select("o_orderkey"), rows=reading.ROWS)
    raw = F.replace(F.element_at(F.array(*[F.lit(x) for x, _ in PLANTED]), (F.col("o_orderkey") % len(PLANTED)).cast("int") + 1), F.lit("@"), F.col("o_orderkey").cast("string"))
    found = orders.select("o_orderkey", schema.schema_faults(raw, schema.answer_schema(0.9)).alias("f"))
    named = F.array_sort(F.transform("f", lambda x: F.concat_ws(" ", x["path"], x["keyword"])))
    return found.select("o_orderkey", F.lit(len(PLANTED)).alias("kinds"), F.array_join(named, ",").alias("faults"), F.size("f").alias("n"))


_FACTORS = "[1e-12, 1e-9, 1e-6, 1e-3, 1.0, 1e3, 1e6, 1e9, 1e12, 1e-2, 1e2]"


@query(f"""WITH o AS (SELECT o_orderkey, c_nationkey AS unit_id, o_totalprice, (o_orderkey % 4)::INT AS places FROM orders JOIN customer ON o_custkey = c_custkey),
c AS (SELECT o_orderkey, unit_id, places, round(CASE o_orderkey % 5 WHEN 0 THEN o_totalprice / 1000 WHEN 1 THEN o_totalprice * 100 WHEN 2 THEN o_totalprice + 0.37 WHEN 3 THEN o_orderkey % 3 ELSE o_totalprice / 7 END, places) AS v FROM o),
d AS (SELECT DISTINCT unit_id, places, v, greatest(v - pow(10.0, -places) / 2, 0.0) AS low, v + pow(10.0, -places) / 2 AS high FROM c),
p AS (SELECT DISTINCT unit_id, o_totalprice * f AS x FROM o, (SELECT unnest({_FACTORS}) AS f) WHERE o_orderkey % 3 = 0),
h AS (SELECT unit_id, places, v FROM d WHERE EXISTS (FROM p WHERE p.unit_id = d.unit_id AND p.x >= d.low * (1 - 1e-13) AND p.x < d.high * (1 - 1e-13)))
SELECT o_orderkey, h.v IS NOT NULL AS carried FROM c LEFT JOIN h USING (unit_id, places, v)""")
def e29_band_join(spark, sf):
    """Figures of a unit's claims against all figures of the unit, at any scale step, as an equi-join on cells of mantissas."""
    customer = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("unit_id"))
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice").join(customer, "o_custkey").withColumn("places", (F.col("o_orderkey") % 4).cast("int"))
    k, price = F.col("o_orderkey") % 5, F.col("o_totalprice")
    raw = F.when(k == 0, price / 1000).when(k == 1, price * 100).when(k == 2, price + 0.37).when(k == 3, (F.col("o_orderkey") % 3).cast("double")).otherwise(price / 7)
    rounded = reduce(lambda chain, d: F.when(F.col("places") == d, metrics.rounded(raw, d)).otherwise(chain), range(3), metrics.rounded(raw, 3))
    claims = o.select("o_orderkey", "unit_id", "places", rounded.alias("value"))
    pool = o.filter("o_orderkey % 3 = 0").select("unit_id", F.col("o_totalprice").alias("candidate"))
    return bands.carried(claims, pool, ["unit_id"]).select("o_orderkey", "carried")


def _cited(spark, sf):
    """Lines as claims on one passage for each supplier, which hundreds of lines cite."""
    line = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey").distinct()
    supplier = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.format_string("%.2f", F.abs("s_acctbal") + 1).alias("amount"))
    passage = F.concat(F.lit("The balance of supplier came to $"), F.col("amount"), F.lit(" on March 3, 2024, as the ledger had it."))
    claim = F.when(F.col("l_linenumber") % 3 == 0, F.concat(F.lit("It came to $"), F.col("amount"))).when(F.col("l_linenumber") % 3 == 1, F.lit("It came to $0.1234567")).otherwise(F.lit("It came to little"))
    return line.join(supplier, "l_suppkey").select("l_orderkey", "l_linenumber", "l_suppkey", claim.alias("claim"), F.array(passage).alias("spans"))


@query("""SELECT DISTINCT l_orderkey, l_linenumber, l_suppkey, CASE l_linenumber % 3 WHEN 0 THEN 'anchored' WHEN 1 THEN 'unanchored' ELSE 'no_figures' END AS status FROM lineitem JOIN supplier ON l_suppkey = s_suppkey""")
def e30_memo(spark, sf):
    """Statuses of claims whose passages are read once for all that cite them."""
    return verdicts.equal_statuses(_cited(spark, sf), ["claim", "spans"], "status", "claim", "spans", cap=8000).select("l_orderkey", "l_linenumber", "l_suppkey", "status")


@query("""SELECT 2 * count(*) AS asked, count(DISTINCT s) + count(DISTINCT s) FILTER (k = 0) + count(DISTINCT k) FILTER (k > 0) AS read
FROM (SELECT DISTINCT l_orderkey, l_linenumber, printf('%.2f', abs(s_acctbal) + 1) AS s, l_linenumber % 3 AS k, l_suppkey FROM lineitem JOIN supplier ON l_suppkey = s_suppkey)""")
def e30_texts_read(spark, sf):
    """How many texts claims ask for, and how many the memo reads."""
    texts, _ = verdicts.figures.status_parts("claim", "spans", cap=8000)
    asked = verdicts.texts_to_read(_cited(spark, sf), ["l_orderkey", "l_linenumber", "l_suppkey"], texts).filter("digest is not null")
    return asked.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).agg(F.sum("n").alias("asked"), F.count(F.lit(1)).alias("read"))


@query("""WITH x AS (SELECT o_orderkey, 24 * (o_orderkey % 60 + 10) AS p, length('Zeta eta clerk' || o_orderkey || ' theta') AS e FROM orders)
SELECT o_orderkey, greatest(0, ceil((p + e - 240) / 120.0) * 120)::INT AS start FROM x""")
def c6_planted_windows(spark, sf):
    """The earliest window that holds a planted sentence, among sentences of other words."""
    filler, own = "Alpha beta gamma delta. ", F.concat(F.lit("Zeta eta clerk"), F.col("o_orderkey").cast("string"), F.lit(" theta"))
    passage = F.concat(F.repeat(F.lit(filler), (F.col("o_orderkey") % 60 + 10).cast("int")), own, F.lit(". "), F.repeat(F.lit(filler), 30))
    return dealt(table(spark, sf, "orders").select("o_orderkey"), rows=reading.ROWS).select("o_orderkey", text.best_window(passage, F.lit(240), own).alias("start"))


@query("""SELECT o_orderkey, round(0.1 + (o_orderkey % 80) / 100.0, 6) AS contradiction, 1 AS calls FROM orders""")
def f6_ledger(spark, sf):
    """replies of a judge from a ledger: what was asked once is not asked again, as the second run's scores, of another model under the same name, show."""
    ledger = shared_folder(spark, "ledger")
    key = F.regexp_extract("hypothesis", r"(\d+)", 1).cast("long")
    pairs = table(spark, sf, "orders").select(F.sha2(F.col("o_orderkey").cast("string"), 256).alias("pair"), F.lit("p").alias("premise"), F.concat(F.lit("order "), F.col("o_orderkey").cast("string")).alias("hypothesis"))
    model = lambda base: lambda asked: asked.select("pair", F.lit(0.0).alias("entailment"), (base + (key % 80) / 100.0).alias("contradiction"))
    judges.with_ledger(model(F.lit(0.1)), ledger, "m@1", 6_000)(pairs.filter(key % 7 != 0))
    both = judges.with_ledger(model(F.lit(0.1)), ledger, "m@1", 6_000)(pairs)
    again = judges.with_ledger(model(F.lit(9.0)), ledger, "m@1", 6_000)(pairs)
    kept = spark.read.parquet(ledger).groupBy("pair").agg(F.count(F.lit(1)).cast("int").alias("calls"))
    named = pairs.select("pair", key.alias("o_orderkey"))
    return named.join(both.select("pair"), "pair").join(again, "pair").join(kept, "pair").select("o_orderkey", F.round("contradiction", 6).alias("contradiction"), "calls")


@query("""SELECT 'glued' AS family, 'suffix_m' AS kind, 'covered' AS verdict, '' AS reason, count(*) AS n, 0::BIGINT AS gaps FROM orders WHERE o_orderkey % 2 = 0
UNION ALL SELECT 'date', 'iso', 'covered', '', count(*), 0 FROM orders WHERE o_orderkey % 2 = 1""")
def a23_report_sink(spark, sf):
    """A profile's findings and failure total, written twice to one place and read back."""
    folder = shared_folder(spark, "report")
    t = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("It made "), F.format_string("%.1f", (200 + F.col("o_orderkey") % 50).cast("double")), F.lit("m then"))).otherwise("It was on 2024-03-05 then")
    found = spread(table(spark, sf, "orders").select(t.alias("text"))).select(F.explode(profile.cases(F.col("text"))).alias("x")).select("x.*")
    counted = found.groupBy(*found.columns).agg(F.count(F.lit(1)).alias("n"))
    report = profile.judged(counted).groupBy("family", "kind", "verdict", "reason").agg(F.sum("n").alias("n"))
    profile.write_report(report, folder)
    gaps = profile.write_report(report, folder)
    return spark.read.parquet(f"{folder}/findings").withColumn("gaps", F.lit(gaps).cast("long"))


# ---- bundles as rows: a unit of fifty customers, its files as an organiser would write them, one kind of fault in each of five of six units
def _bundle_files(spark, sf):
    key, kind = F.col("c_custkey"), F.col("k") % 6
    unit = F.concat(F.lit("u"), F.col("k").cast("string"))
    people = table(spark, sf, "customer").groupBy(F.floor(key / 50).alias("k")).agg(F.array_sort(F.collect_list(F.struct(key.alias("key"), F.col("c_acctbal").alias("y")))).alias("es"))
    name = lambda x: F.concat(F.lit("c"), x["key"].cast("string")).alias("entity_id")
    lit = lambda **values: [F.lit(v).alias(k) for k, v in values.items()]
    entities = F.transform("es", lambda x: F.struct(name(x), F.concat(F.lit("Customer "), x["key"].cast("string")).alias("name")))
    task = F.to_json(F.struct(*lit(task_id="t1", cutoff_date="2024-06-30"), F.struct(*lit(name="y", type="regression")).alias("target"), entities.alias("entities")))
    doc = F.to_json(F.struct(*lit(doc_id="d1", doc_date="2024-01-02"), F.concat(F.lit("Balances of unit "), unit).alias("text")))
    entry = F.struct(*lit(path="corpus/d1.json", role="corpus"), F.when(kind == 1, F.repeat(F.lit("0"), 64)).otherwise(F.sha2(doc, 256)).alias("sha256"), F.length(doc).cast("long").alias("bytes"), F.lit(True).alias("shared"))
    outcome = F.to_json(F.struct(unit.alias("unit_id"), F.transform("es", lambda x: F.struct(name(x), x["y"].alias("y"))).alias("outcomes")))
    interval = F.struct(*lit(level=0.9, lo=-1e4, hi=1e4)).alias("interval")
    claims = F.array(F.struct(*lit(doc_id="d1", span_start=0, span_end=8, claim="Balances of it."))).alias("claims")
    covered = F.when(kind == 3, F.slice("es", 2, F.size("es"))).otherwise(F.col("es"))
    naive = F.to_json(F.struct(*lit(task_id="t1"), F.transform(covered, lambda x: F.struct(name(x), F.lit(0.0).alias("point_forecast"), interval, claims)).alias("entity_predictions")))
    card = F.concat(F.lit('[task]\nid = "t1"\n[scoring.params]\ntarget_type = "regression"\ninterval_level = '), F.when(kind == 4, "1.5").otherwise("0.9"), F.lit("\n"))
    given = [("card.toml", card), ("task.json", F.when(kind == 5, "{oops").otherwise(task)), ("manifest.json", F.to_json(F.struct(F.array(entry).alias("files")))), ("corpus/d1.json", doc), ("reference/outcome.json", outcome), ("reference/naive_answer.json", F.when(kind != 2, naive))]
    rows = people.select(unit.alias("unit"), F.explode(F.array(*[F.struct(F.lit(f).alias("file"), c.alias("content")) for f, c in given])).alias("x")).select("unit", "x.*").filter("content is not null")
    stray = people.select(F.concat(F.lit("folder"), F.col("k").cast("string")).alias("unit"), F.lit("notes.txt").alias("file"), F.lit("no unit").alias("content"))
    return rows.union(stray)


@query("""WITH u AS (SELECT c_custkey // 50 AS k, count(*) AS n FROM customer GROUP BY 1)
SELECT 'u' || k AS unit_id, CASE WHEN k % 6 = 4 THEN 1.5 ELSE 0.9 END::DOUBLE AS level, CASE WHEN k % 6 = 5 THEN 0 ELSE n END::BIGINT AS entities, (k % 6 <> 1)::BIGINT AS docs, n AS truths,
  CASE k % 6 WHEN 2 THEN 0 WHEN 3 THEN n - 1 ELSE n END::BIGINT AS naives, (['', 'd1 digest_mismatch', 'reference/naive_answer.json roster_missing', 'reference/naive_answer.json roster_missing', 'card.toml level', 'task.json not_json'])[(k % 6)::INT + 1] AS faults FROM u""")
def a1_hydrate(spark, sf):
    """Units from their files: what each has of entities, documents, outcomes and naive rows, and what of it can't be trusted."""
    files_ = _bundle_files(spark, sf)
    found = bundle.hydrate_files(files_, files_.filter("unit is null"))
    count = lambda of, name: found[of].groupBy("unit_id").agg(F.count(F.lit(1)).alias(name))
    faults = found["faults"].groupBy("unit_id").agg(F.array_join(F.array_sort(F.collect_set(F.concat_ws(" ", "file", "fault"))), ",").alias("faults"))
    sides = [count("roster", "entities"), count("docs", "docs"), count("truth", "truths"), count("naive", "naives")]
    joined = reduce(lambda a, b: a.join(b, "unit_id", "left"), [*sides, faults], found["units"].select("unit_id", "level"))
    return joined.select("unit_id", "level", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("entities", "docs", "truths", "naives")], F.coalesce("faults", F.lit("")).alias("faults"))


CARDS = [
    ("interval_level = 0.8\ntau_citation = 0.25", 0.8, 0.7, 0.25, None), ("", 0.9, 0.7, 0.5, None), ("interval_level = 1.0", 1.0, 0.7, 0.5, "level"), ("composite_weights = [0.5, 0.4]", 0.9, 0.5, 0.5, "weights"), ("composite_weights = [1.0]", 0.9, 1.0, 0.5, "weights"),
    ("faithfulness_threshold = 0.5", 0.9, 0.7, 0.5, "threshold"), ("tau_citation = 1.0", 0.9, 0.7, 1.0, "tau"), ("penalty_k = 2.0", 0.9, 0.7, 0.5, "fixed_key"), ("interval_level = ", None, None, None, "not_a_card"), ('interval_level = "high"', None, None, None, "not_a_card"),
]
_SQL = lambda x: "NULL" if x is None else f"'{x}'" if isinstance(x, str) else repr(x)


@query(f"""SELECT 'u' || o_orderkey AS unit, {", ".join(f"([{', '.join(_SQL(c[i]) for c in CARDS)}])[(o_orderkey % {len(CARDS)})::INT + 1]::{kind} AS {name}" for i, name, kind in ((1, "level", "DOUBLE"), (2, "w_a", "DOUBLE"), (3, "tau", "DOUBLE"), (4, "fault", "VARCHAR")))} FROM orders""")
def a3_cards(spark, sf):
    """A3: cards in TOML, with defaults, and what each kind of fault in them is called."""
    params = F.element_at(F.array(*[F.lit(c[0]) for c in CARDS]), (F.col("o_orderkey") % len(CARDS)).cast("int") + 1)
    cards = table(spark, sf, "orders").select(F.concat(F.lit("u"), F.col("o_orderkey").cast("string")).alias("unit"), F.concat(F.lit('[task]\nid = "t"\n[scoring.params]\n'), params, F.lit("\n")).alias("content"))
    return bundle.read_cards(cards).select("unit", F.col("interval_level").alias("level"), "w_a", "tau", "fault")


# ---- planted dates and tokens: (SQL text of the form on the day t or the digit n, what it has to be called)
DATES = [
    ("date_format(t, 'yyyy-MM-dd')", "iso covered"), ("date_format(t, 'MM/dd/yyyy')", "m_d_y covered"), ("date_format(t, 'M/yyyy')", "m_yyyy covered"), ("date_format(t, 'MMMM d, yyyy')", "month_day covered"),
    ("date_format(t, 'd MMMM yyyy')", "day_month covered"), ("concat(quarter(t), 'Q', date_format(t, 'yy'))", "period_label covered"), ("concat('Q', quarter(t), ' ', date_format(t, 'yy'))", "period_label_spaced left_alone"),
    ("date_format(t, 'MMM-yy')", "month_yy left_alone"), ("concat(chr(39), date_format(t, 'yy'))", "apostrophe_yy left_alone"), ("date_format(t, 'yyyyMMdd')", "compact_ymd left_alone"), ("concat(10 + n, ':45')", "clock_time left_alone"),
    ("date_format(t, 'M/d')", "m_d covered"), ("concat('13/4', n)", "m_d_not_a_date covered"),
]
TOKENS = [
    ("'=100'", "index_base"), ("concat('(', year(t), '-9', n, ')')", "year_or_period"), ("concat(year(t), '/est')", "year_then_word"), ("concat(n, '.5.98')", "date"), ("concat('ABC', n)", "identifier"), ("concat(n, '½')", "period_with_fraction"),
    ("concat('1', n, '.5abc')", "number_then_word"), ("concat('1-', n, '-x')", "id_with_punctuation"), ("concat('*', n, '*')", "marker_only"), ("concat('#12345', n)", "hex_colour"), ("concat(n, ',/x')", "path_or_url"), ("concat('5,6', n, '%8')", "glued_values"), ("concat(n, '€6')", "gap"),
]


def _planted_forms(spark, sf, forms):
    """o_orderkey and text: each order's date or digit in one of the forms."""
    t, n = F.col("o_orderdate").cast("date").alias("t"), (F.col("o_orderkey") % 9 + 1).cast("string").alias("n")
    form = reduce(lambda chain, k: F.when(F.col("o_orderkey") % len(forms) == k, F.expr(forms[k][0])).otherwise(chain), range(len(forms)), F.lit(None).cast("string"))
    return spread(table(spark, sf, "orders").select("o_orderkey", t, n)).select("o_orderkey", form.alias("text"))


def _named(forms) -> str:
    return f"""(['{"','".join(name for _, name in forms)}'])[(o_orderkey % {len(forms)})::INT + 1]"""


@query(f"""SELECT o_orderkey, {_named(DATES)} AS called FROM orders""")
def j6_date_kinds(spark, sf):
    """A planted date of each kind, and what the profile makes of it; that is one case for each."""
    said = _planted_forms(spark, sf, DATES).select("o_orderkey", F.concat(F.lit("It came on "), "text", F.lit(" then")).alias("text"))
    return profile.each_judged(said, "text").filter("family = 'date'").select("o_orderkey", F.concat_ws(" ", "kind", "verdict").alias("called"))


@query(f"""SELECT o_orderkey, {_named(TOKENS)} AS called FROM orders""")
def j11_unread_classes(spark, sf):
    """A planted token of each class of what yields no figure, and one of none."""
    return _planted_forms(spark, sf, TOKENS).select("o_orderkey", F.coalesce(profile.unread_class(F.col("text")), F.lit("gap")).alias("called"))


# ---- a panel: five judges vote on each component of each of three target reasons of an order's answer ------------------------
_PARTS = panel.COMPONENTS + panel.FLAGS
_VOTE = "CASE WHEN (k * 7 + t * 5 + c * 3 + j * 11) % 17 = 0 THEN NULL WHEN c = 6 THEN ((k + t) % 9 = 0 AND j <> 2)::INT ELSE ((k * 3 + t * 5 + c + j * 2) % 8 <> 0)::INT END"


@query(f"""WITH v AS (SELECT k, t, c, j, {_VOTE} AS vote FROM (SELECT o_orderkey AS k FROM orders), (SELECT unnest(range(3)) AS t), (SELECT unnest(range({len(_PARTS)})) AS c), (SELECT unnest(range(5)) AS j) WHERE (k + t) % 5 <> 0),
s AS (SELECT k, t, c, CASE WHEN count(vote) >= 3 THEN sum(vote) / count(vote) ELSE 0 END AS share FROM v GROUP BY ALL),
w AS (SELECT k, t, max(share) FILTER (c = 0) AS s0, max(share) FILTER (c = 1) AS s1, max(share) FILTER (c = 2) AS s2, CASE WHEN (k + t) % 3 = 0 THEN 1.0 WHEN (k + t) % 3 = 1 THEN 0.0 ELSE max(share) FILTER (c = 3) END AS s3,
  max(share) FILTER (c = 4) AS g, max(share) FILTER (c = 5) AS i, max(share) FILTER (c = 6) AS x FROM s GROUP BY k, t),
r AS (SELECT k, sum(CASE WHEN s0 <= 0.5 OR g <= 0.5 OR i <= 0.5 OR x > 0.5 THEN 0 ELSE (s0 + s1 + s2 + s3) / 4 END) / 3 AS reasoning FROM w GROUP BY k)
SELECT o_orderkey, round(reasoning, 6) AS reasoning, round(-0.27 + 1.27 * ((o_orderkey % 10) / 10.0) + 0.25 * coalesce(reasoning, 0), 6) AS final FROM orders LEFT JOIN r ON k = o_orderkey""")
def l4_panel(spark, sf):
    """Votes of a panel, abstentions and a repeated vote among them, to cells, target reasons, the reasoning score and the final one."""
    orders = dealt(table(spark, sf, "orders").select(F.col("o_orderkey").alias("k")), "k", rows=4096)  # votes are made where they are counted, so none is shuffled
    each = lambda n, name: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    cells = orders.select("k", each(3, "t")).filter("(k + t) % 5 <> 0").select("k", "t", each(len(_PARTS), "c")).select("*", each(5, "j"))
    vote = F.expr(_VOTE.replace("::INT", "").replace("((k + t) % 9 = 0 AND j <> 2)", "int((k + t) % 9 = 0 AND j <> 2)").replace("((k * 3 + t * 5 + c + j * 2) % 8 <> 0)", "int((k * 3 + t * 5 + c + j * 2) % 8 <> 0)"))
    names = F.element_at(F.array(*map(F.lit, _PARTS)), F.col("c") + 1)
    seats = F.when((F.col("j") == 3) & (F.col("k") % 4 == 0), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))  # a second vote of one judge, which doesn't count
    cast = cells.select("k", "t", "c", "j", F.explode(seats).alias("seat"))
    votes = cast.select("k", F.col("t").alias("target"), names.alias("component"), F.col("j").alias("judge"), "seat", F.when(F.col("seat") == 0, vote).otherwise(1 - vote).alias("vote"))
    judged = panel.cells(votes, ["k", "target", "component"])
    target = orders.select("k", each(3, "target"))
    checked = target.select("k", "target", F.when((F.col("k") + F.col("target")) % 3 == 0, True).when((F.col("k") + F.col("target")) % 3 == 1, False).alias("consistent"))
    got = panel.reasoning(panel.target_scores(judged, checked, ["k"]), target, ["k"], ["k"])
    scored = orders.join(got, "k", "left")
    final = panel.final_score((F.col("k") % 10) / 10.0, F.col("reasoning"))
    return scored.select(F.col("k").alias("o_orderkey"), F.round("reasoning", 6).alias("reasoning"), F.round(final, 6).alias("final"))


def calibration_rows(spark, sf):
    """Orders with an outcome whose spread follows three features, hash noise standing for what can't be known; fold 0 trains, 1 calibrates, 2 is held out."""
    k = F.col("o_orderkey")
    unit = lambda salt: (F.pmod(F.xxhash64(k, F.lit(salt)), F.lit(1_000_003)) + 0.5) / 1_000_003
    o = table(spark, sf, "orders").select("o_orderkey", unit(1).alias("confidence"), unit(2).alias("retrieval"), (F.col("o_totalprice") / 100_000).alias("spread"), unit(3).alias("u"), unit(4).alias("v"))
    noise = F.sqrt(-2 * F.log("u")) * F.cos(6.283185307179586 * F.col("v"))
    return o.select("o_orderkey", "confidence", "retrieval", "spread", (2 * F.col("confidence") + (0.2 + F.col("spread") + 2 * (1 - F.col("retrieval"))) * noise).alias("y"), F.pmod(F.xxhash64(k, F.lit(5)), F.lit(3)).cast("int").alias("fold"))


@query()
def l2_quantile_head(spark, sf):
    """L2: 90 % intervals from quantile regression on confidence, retrieval strength and spread, calibrated on rows that the fit didn't see."""
    rows = calibration_rows(spark, sf)
    features = ["confidence", "retrieval", "spread"]
    head = calibration.conformal(calibration.fit(rows.filter("fold = 0"), features, "y"), rows.filter("fold = 1"), "y")
    low, high = head.interval()
    return rows.select("o_orderkey", "fold", "y", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


QUERIES, ORACLES = query.queries, query.oracles
