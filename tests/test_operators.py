import json

import pytest
from pyspark.sql import functions as F

from lodeframe.operators import agents, alignment, citations, judges, reasons
from lodeframe.sources import bundle
from lodeframe.streaming import embargo


def test_roster_precedence(spark):
    roster = spark.createDataFrame([("s", x) for x in "abc"], "k string, entity_id string")
    for rows, reason in (("abc", None), ("ab", "missing"), ("abcd", "unknown"), ("aabc", "duplicate"), ("aabd", "duplicate")):
        got = alignment.roster_check(roster, spark.createDataFrame([("s", x) for x in rows], "k string, entity_id string"), ["k"]).first()
        assert got.reason == reason
    blank = spark.createDataFrame([("s", x) for x in ("a", "b", "c", "")], "k string, entity_id string")
    assert alignment.roster_check(roster, blank, ["k"]).first().reason == "malformed"


def test_align_keeps_the_roster(spark):
    roster = spark.createDataFrame([("s", "a", 0), ("s", "b", 1)], "k string, entity_id string, pos int")
    pred = spark.createDataFrame([("s", "b", 1.0), ("s", "z", 2.0)], "k string, entity_id string, point double")
    assert [(r.entity_id, r.point) for r in alignment.align(roster, pred, ["k"]).orderBy("pos").collect()] == [("a", None), ("b", 1.0)]


def test_embargo_fails_closed(spark):
    df = spark.createDataFrame([("d", True, "2024-01-01"), ("d", True, "2024-02-02"), ("d", True, None), ("d", False, None), ("../d", False, None)], "doc_id string, resolved boolean, day string")
    got = [r.x for r in df.select(citations.embargo_state(F.col("doc_id"), F.col("resolved"), F.to_date("day"), F.lit("2024-01-31").cast("date")).alias("x")).collect()]
    assert got == ["ok", "post_cutoff", "undated", "unresolved", "malformed"]


def test_greedy_budget_skips(spark):
    rows = [("k", 1, 4, None), ("k", 2, 9, None), ("k", 3, 5, None), ("k", 4, 1, "duplicate")]
    items = spark.createDataFrame(rows, "k string, pos long, n long, blocked string")
    got = {r.pos: (r.judged, r.why) for r in reasons.greedy_budget(items, ["k"], ["n"], [10]).collect()}
    assert got == {1: (True, None), 2: (False, "n"), 3: (True, None), 4: (False, "duplicate")}


def test_model_judge_and_service(spark):
    pairs = spark.createDataFrame([("1", "a b", "a"), ("2", " ", "a")], "pair string, premise string, hypothesis string")
    judge = judges.model_judge("test", lambda: lambda p, h: [(0.7, 0.2, 0.1)] * len(p))
    assert {r.pair: r.contradiction for r in judge(pairs).collect()} == {"1": pytest.approx(0.1), "2": 0.0}
    calls = []

    def post(rows):
        calls.append(len(rows))
        if len(calls) < 3:
            raise OSError
        return [{"entailment": 1.0, "neutral": 0.0, "contradiction": 0.0}] * len(rows)

    waits = []
    assert judges.served(post, waits.append)(["p"], ["h"]) == [(1.0, 0.0, 0.0)]
    assert waits == [2.0, 4.0]
    assert judges.bounded_premise("a , b c d", 2) == "a , b"
    with pytest.raises(ValueError):
        judges.checked_spec({"members": [{"model": "m", "revision": "x", "digest": "y"}]})


def test_model_replies_keep_faults(spark):
    def build():
        def complete(prompt):
            if prompt == "bad":
                raise ValueError
            return prompt.upper()

        return complete

    got = {r.key: (r.reply, r.error) for r in agents.model_replies(spark.createDataFrame([("1", "ok"), ("2", "bad")], "key string, prompt string"), build).collect()}
    assert got == {"1": ("OK", None), "2": (None, "ValueError")}


def test_number_text(spark):
    got = spark.createDataFrame([(3.0,), (0.1234567,), (1e20,)], "x double").select(agents.number_text("x").alias("t")).collect()
    assert [r.t for r in got] == ["3", "0.123457", "1e+20"]


def test_bundle_round_trip(spark, tmp_path):
    import hashlib

    unit = tmp_path / "u1"
    (unit / "corpus").mkdir(parents=True)
    entries = []
    for name, doc, good in (("A", {"doc_id": "A", "doc_date": "2024-01-01", "text": "x"}, True), ("B", {"doc_id": "B", "doc_date": "2024-01-01", "text": "y"}, False), ("C", {"doc_id": "C", "text": "z"}, True)):
        body = json.dumps(doc).encode()
        (unit / "corpus" / f"{name}.json").write_bytes(body)
        entries.append({"path": f"corpus/{name}.json", "role": "corpus", "sha256": hashlib.sha256(body if good else b"").hexdigest(), "shared": True})
    entries.append({"path": "corpus/D.json", "role": "corpus", "sha256": "0" * 64, "shared": True})
    (unit / "manifest.json").write_text(json.dumps({"unit_id": "u1", "files": entries}))
    manifest = bundle.manifest_entries(bundle.files(spark, str(tmp_path), "manifest.json"))
    docs = bundle.verified_documents(manifest, bundle.files(spark, str(tmp_path), "corpus/*.json"))
    assert {r.doc_id: r.fault for r in docs.collect()} == {"A": None, "B": "digest_mismatch", "C": "no_date", "D": "missing_file"}
    with pytest.raises(Exception, match="organiser's fault"):
        bundle.must_be_sound(docs).collect()


def test_cards(spark):
    texts = {"good": "[task]\nid='t'\n[scoring.params]\ninterval_level=0.8\n", "bad": "[scoring.params]\ncomposite_weights=[0.5,0.6]\n", "fixed": "[scoring.params]\npenalty_k=2.0\n"}
    assert {r.unit: (r.interval_level, r.fault) for r in bundle.cards(spark, texts).collect()} == {"good": (0.8, None), "bad": (0.9, "weights"), "fixed": (0.9, "fixed_key")}


def test_streaming_embargo_equals_batch(spark, tmp_path):
    docs = spark.createDataFrame([("d1", "2024-01-01"), ("d2", "2024-03-01")], "doc_id string, day string").select("doc_id", F.to_date("day").alias("doc_date"))
    claims = spark.createDataFrame([("d1", "2024-02-01", "2024-02-01 10:00:00"), ("d2", "2024-02-01", "2024-02-01 10:01:00"), ("d3", "2024-02-01", "2024-02-01 11:30:00")], "doc_id string, c string, t string").select("doc_id", F.to_date("c").alias("cutoff"), F.to_timestamp("t").alias("ts"))
    path = str(tmp_path / "in")
    claims.write.parquet(path)
    counts = lambda df: embargo.embargo_counts(embargo.stamped(df, docs, ["doc_id"]), "ts", "10 minutes", "1 hour")
    stream = counts(spark.readStream.schema(claims.schema).parquet(path)).writeStream.outputMode("complete").format("memory").queryName("embargo").start()
    stream.processAllAvailable()
    stream.stop()
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(spark.sql("select * from embargo")) == rows(counts(claims))


def test_interval_losses_by_window(spark):
    import datetime as dt

    from lodeframe.streaming import embargo

    at = lambda minute: dt.datetime(2024, 1, 1, 0, minute)
    rows = [(at(1), 0.0, 2.0, 1.0), (at(4), 0.0, 2.0, 3.0), (at(11), 0.0, 1.0, -1.0)]
    df = spark.createDataFrame(rows, "ts timestamp, low double, high double, y double")
    got = {r.start: (round(r.loss, 9), r.n) for r in embargo.loss_by_window(df, "ts", "1 hour", "10 minutes", 0.9).collect()}
    assert got == {at(0): (12.0, 2), at(10): (21.0, 1)}


def test_equal_values_are_read_once_and_in_small_parts(spark):
    from lodeframe.operators import reading

    rows = spark.range(30_000).selectExpr("id", "case when id % 9 = 0 then null when id % 2 = 0 then 'hot' else concat('t', id % 5000) end as t", "id % 3 as n")
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def of(t, n):
        read.add(1)
        return f"{t}-{n}"

    got = reading.each_once(rows, ["t", "n"], "x", of("t", "n")).collect()
    assert len(got) == 30_000 and all(r.x == f"{r.t}-{r.n}" for r in got)
    assert read.value == rows.select("t", "n").distinct().count()
    parts = rows.select("t", "n").distinct().count() // reading.ROWS
    assert parts >= 2 and reading.dealt(rows, rows=reading.ROWS).rdd.getNumPartitions() == 15


def test_weighted_texts_make_the_same_profile(spark):
    from lodeframe.operators import profile

    texts = spark.createDataFrame([("It rose ½ percentage point on 2024-03-05",)] * 5 + [("Index 1982-84=100, #123456",)] * 3 + [(None,)], "t string")
    counted = texts.groupBy("t").agg(F.count(F.lit(1)).alias("times"))
    of = lambda report: sorted(map(tuple, report.collect()))
    assert of(profile.profile(counted, "t", "times")) == of(profile.profile(texts, "t"))
