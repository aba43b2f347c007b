"""The schema gate, the band join, the figure memo, the judge's ledger, the panel and the calibration head against plain Python."""

import json
import random

import pytest
from pyspark.sql import functions as F

from lodeframe.operators import bands, calibration, judges, panel, profile, schema, verdicts
from lodeframe.plans import contracts

KEYWORDS = {
    "type": "object",
    "required": ["a", "b"],
    "additionalProperties": False,
    "properties": {
        "a": {"type": "integer", "minimum": 1, "maximum": 5},
        "b": {"type": "array", "minItems": 1, "maxItems": 2, "items": {"enum": ["x", 1, True, None]}},
        "c": {"type": "string", "minLength": 2, "maxLength": 3, "pattern": "^[a-zé]+$"},
        "d": {"type": "number", "exclusiveMinimum": 0, "exclusiveMaximum": 1},
        "e": {"anyOf": [{"type": "null"}, {"const": 0.5}]},
        "f": {"type": "boolean"},
    },
}


@pytest.mark.parametrize("of, faults", [
    ({"a": 1, "b": ["x"]}, []),
    ({"a": 5.0, "b": [1, True], "c": "éa", "d": 0.5, "e": None, "f": False}, []),
    ({"b": ["x"], "z": 1, "y": 2}, [("", "additionalProperties"), ("", "required")]),
    ({"a": 0, "b": []}, [("/a", "minimum"), ("/b", "minItems")]),
    ({"a": 6, "b": ["x", "x", "q"]}, [("/a", "maximum"), ("/b", "maxItems"), ("/b/2", "enum")]),
    ({"a": True, "b": "x"}, [("/a", "type"), ("/b", "type")]),
    ({"a": 1.5, "b": [False]}, [("/a", "type"), ("/b/0", "enum")]),
    ({"a": "1", "b": [None], "c": "X"}, [("/a", "type"), ("/c", "minLength"), ("/c", "pattern")]),
    ({"a": 2, "b": ["x"], "c": "abcd", "d": 0}, [("/c", "maxLength"), ("/d", "exclusiveMinimum")]),
    ({"a": 2, "b": ["x"], "d": 1, "e": 0.4, "f": None}, [("/d", "exclusiveMaximum"), ("/e", "anyOf"), ("/f", "type")]),
    ([1], [("", "type")]),
])
def test_every_keyword(spark, of, faults):
    found = spark.createDataFrame([(json.dumps(of),)], "t string").select(schema.schema_faults(F.col("t"), KEYWORDS)).first()[0]
    assert sorted(map(tuple, found)) == faults


def test_texts_that_are_no_json(spark):
    df = spark.createDataFrame([("{",), (None,), ('{"a":1,"a":2,"b":["x"]}',)], "t string")
    assert [[tuple(x) for x in r[0]] for r in df.select(schema.schema_faults(F.col("t"), KEYWORDS)).collect()] == [[("", "json")]] * 3
    with pytest.raises(ValueError):
        schema.schema_faults(F.col("t"), {"uniqueItems": True})


STEPS = [-12, -9, -6, -3, 0, 3, 6, 9, 12, -2, 2]


def carries(value, places, candidate):
    half = 10.0**-places / 2
    low, high = max(value - half, 0.0), value + half
    return any(low * (1 - 1e-13) <= candidate * 10.0**s < high * (1 - 1e-13) for s in STEPS)


def test_band_join_against_every_pair(spark):
    r = random.Random(2)
    claims, pool = [], []
    for unit in [*range(25), None]:
        own = [round(10 ** r.uniform(-4, 9), r.randint(0, 4)) for _ in range(12)] + [0.0] * (unit is not None and unit % 9 == 0)
        pool += [(unit, p) for p in own] + [(unit, None), (unit, float("inf")), (unit, -3.0)]
        for _ in range(40):
            places = r.randint(0, 3)
            claims.append((unit, round(1.0 * r.choice([10 ** r.uniform(-3, 9), r.choice(own) * 10.0 ** r.choice(STEPS) * r.choice([1, 1, 1.0004, 10]), r.randint(0, 3)]), places), places))
    claims += claims[:20] + [(1, None, 0)]
    of = lambda unit: [p for u, p in pool if u == unit and p is not None and 0 <= p < float("inf")]
    got = bands.carried(spark.createDataFrame(claims, "unit int, value double, places int"), spark.createDataFrame(pool, "unit int, candidate double"), ["unit"])
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString() and "Cartesian" not in got._jdf.queryExecution().executedPlan().toString()
    rows = got.collect()
    assert len(rows) == len(claims)
    for x in rows:
        assert x.carried == (x.unit is not None and x.value is not None and any(carries(x.value, x.places, c) for c in of(x.unit)))


def test_memo_reads_a_span_once(spark):
    from lodeframe.functions import figures

    span = "Revenue came to $12.5 million in all."
    rows = [(k, ["It was $12.5m.", "It was $13.1m.", "It was fine.", None][k % 4], [span, None] if k % 5 else None) for k in range(400)]
    claims = spark.createDataFrame(rows, "k int, claim string, spans array<string>")
    texts, _ = figures.status_parts("claim", "spans")
    asked = verdicts.texts_to_read(claims, ["k"], texts).filter("digest is not null")
    assert asked.count() > 500 and asked.select("digest").distinct().count() == 4
    got = {r.k: r.status for r in verdicts.figure_statuses(claims, ["k"], "status", "claim", "spans").collect()}
    assert got == {r.k: r.status for r in claims.select("k", figures.figure_status("claim", "spans").alias("status")).collect()}
    assert got[1] == "unanchored" and got[4] == "anchored" and got[2] == "no_figures" and got[3] is None


def test_ledger_asks_only_for_what_is_missing(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()

    def build():
        def score(premises, hypotheses):
            import uuid

            (calls / uuid.uuid4().hex).write_text("\n".join(hypotheses))
            if "down" in hypotheses and not (calls / "up").exists():
                raise OSError("no service")
            return [(0.1, 0.2, 0.7) for _ in hypotheses]

        return score

    pairs = spark.createDataFrame([(f"p{k}", "passage", f"claim {k}") for k in range(30)] + [("bad", "passage", "down")], "pair string, premise string, hypothesis string").repartition(3)
    asked = lambda: [x for f in calls.iterdir() if f.name != "up" for x in f.read_text().split("\n")]
    judge = judges.with_ledger(judges.fault_tolerant("t", build, rows=1), str(tmp_path / "ledger"), "m@1", slice_pairs=10)
    first = {r.pair: r.contradiction for r in judge(pairs).collect()}
    assert first == {f"p{k}": 0.7 for k in range(30)} | {"bad": None} and sorted(asked()) == sorted([*(f"claim {k}" for k in range(30)), "down"])
    assert spark.read.parquet(str(tmp_path / "ledger")).filter("fault is not null").select("pair", "fault").collect() == [("bad", "OSError: no service")]
    before = len(asked())
    (calls / "up").write_text("")
    assert {r.pair: r.contradiction for r in judge(pairs).collect()} == first | {"bad": 0.7}
    assert asked().count("down") == 2 and len(asked()) == before + 1  # only the fault is asked again
    other = judges.with_ledger(judges.fault_tolerant("t", build), str(tmp_path / "ledger"), "m@2")
    assert other(pairs.filter("pair in ('p0', 'p1', 'p2')")).filter("contradiction = 0.7").count() == 3 and len(asked()) == before + 4


def test_ledger_of_many_slices_takes_few_jobs(spark, tmp_path):
    calls, ledger = [], str(tmp_path / "ledger")

    def judge(pairs):
        calls.append(1)
        down = F.col("pair").eqNullSafe("p7") & F.lit(len(calls) <= judges.ROUNDS and broken)
        return pairs.select("pair", F.when(down, F.raise_error(F.lit("down"))).otherwise(0.1).cast("double").alias("entailment"), F.lit(0.7).alias("contradiction"))

    pairs = spark.range(200).selectExpr("concat('p', id) as pair", "'passage' as premise", "concat('claim ', id) as hypothesis")
    broken = True
    with pytest.raises(Exception, match="down"):
        judges.with_ledger(judge, ledger, "m@1", slice_pairs=2)(pairs)
    broken = False
    assert judges.with_ledger(judge, ledger, "m@1", slice_pairs=2)(pairs).filter("contradiction = 0.7").count() == 200
    assert len(calls) <= 2 * judges.ROUNDS
    rows = spark.read.parquet(ledger)
    assert rows.count() == rows.select("pair").distinct().count() == 200
    assert len(rows.inputFiles()) >= 90  # a file for each slice that was committed on its own
    assert [f.name for f in tmp_path.iterdir()] == ["ledger"]


def test_report_is_written_whole_and_again(spark, tmp_path):
    rows = [("date", "iso", "covered", "", 4), ("glued", "label", "gap", "", 2), ("range", "amounts", "gap", "", 3)]
    report = spark.createDataFrame(rows, "family string, kind string, verdict string, reason string, n long")
    assert [profile.write_report(report, str(tmp_path / "r")) for _ in range(2)] == [5, 5]
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "r" / "findings")).collect())) == rows
    assert tuple(spark.read.parquet(str(tmp_path / "r" / "total")).first()) == (5, 9)
    assert profile.write_report(report.limit(0), str(tmp_path / "r")) == 0


def test_panel_cells(spark):
    votes = [("full", j, 0, v) for j, v in enumerate([1, 1, 1, 0, 1])] + [("quorum", j, 0, v) for j, v in enumerate([1, 0, 1, None, None])] + [("open", j, 0, v) for j, v in enumerate([1, 1, None, None, None])] + [("open", 0, 1, 0), ("none", 0, 0, None)]
    got = {r.cell: tuple(r)[1:] for r in panel.cells(spark.createDataFrame(votes, "cell string, judge int, seat int, vote int"), ["cell"]).collect()}
    assert got == {"full": (5, 4, 0.8, 0.8, False), "quorum": (3, 2, 2 / 3, 2 / 3, False), "open": (2, 2, 0.0, 1.0, True), "none": (0, 0, 0.0, None, True)}


def test_panel_votes_are_not_shuffled(spark, sf):
    frame = contracts.l4_panel(spark, sf)
    frame.collect()
    plan = frame._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "HashAggregate" in plan and not [x for x in plan.splitlines() if "Exchange" in x and ("component" in x or "judge" in x)]


def test_calibration_head(spark, sf):
    """Held-out coverage near the level, and losses below those of bands that know no feature."""
    rows = contracts.calibration_rows(spark, "/root/testdata/sf0.01").persist()
    features = ["confidence", "retrieval", "spread"]
    head = calibration.conformal(calibration.fit(rows.filter("fold = 0"), features, "y"), rows.filter("fold = 1"), "y")
    low, high = head.interval()
    held = rows.filter("fold = 2")
    assert abs(held.agg(F.avg(F.col("y").between(low, high).cast("int"))).first()[0] - 0.9) < 0.02
    flat = rows.filter("fold = 0").agg(*[F.percentile("y", t) for t in (0.05, 0.95)]).first()
    for tau, band in zip((0.05, 0.95), flat, strict=True):
        own, plain = held.agg(F.avg(calibration.pinball(F.col("y"), head.quantile(tau), tau)), F.avg(calibration.pinball(F.col("y"), F.lit(band), tau))).first()
        assert own < 0.9 * plain


def test_calibration_of_odd_rows(spark):
    rows = spark.createDataFrame([(1.0, 2.0, 3.0), (None, 1.0, 1.0), (float("nan"), 1.0, 1.0), (1.0, 2.0, None)], "a double, b double, y double")
    head = calibration.fit(rows, ["a", "b"], "y")
    assert rows.limit(1).select(head.quantile(0.05)).first()[0] == pytest.approx(3.0, abs=0.1)
    assert calibration.fit(rows.limit(0), ["a", "b"], "y").weights[0.95] == (0.0, 0.0, 0.0)


def test_equal_claims_are_judged_once(spark):
    from lodeframe.operators import verdicts

    rows = [(i, f"It came to {i % 3}.5", [f"It was {x}.5 then" for x in range(i % 2 + 1)] if i % 5 else None) for i in range(40)]
    claims = spark.createDataFrame(rows, "k int, claim string, spans array<string>")
    each = verdicts.figure_statuses(claims, ["k"], "status", "claim", "spans").select("k", "status")
    once = verdicts.equal_statuses(claims, ["claim", "spans"], "status", "claim", "spans").select("k", "status")
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, each.collect()))
    assert {s for _, s in map(tuple, once.collect())} == {"anchored", "unanchored"}
