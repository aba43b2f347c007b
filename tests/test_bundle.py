"""From a folder of units and one of answers to scores."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from lodeframe.operators import alignment, scoring
from lodeframe.sources import bundle

IDS = ["e0", "e1", "e2", "e3"]
TEXT = "Sales rose to 1,234.5 million in the year. Orders fell by 20 bps."


def answer(task="t1", points=(1.0, 2.0, 3.0, 4.0), half=0.5, ids=IDS, claim=("d1", 0, 41, "Sales rose to 1,234.5 million in the year."), notes="a list [NaN, 3] in prose"):
    keys = ("doc_id", "span_start", "span_end", "claim")
    return {"task_id": task, "notes": notes, "entity_predictions": [{"entity_id": e, "point_forecast": p, "interval": {"level": 0.9, "lo": p - half, "hi": p + half}, "claims": [dict(zip(keys, claim, strict=True))]} for e, p in zip(ids, points, strict=False)]}


def write(path, content):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(content if isinstance(content, str) else json.dumps(content, ensure_ascii=False))


def unit(root, name, naive=True, outcome=True, tampered=False, ids=IDS):
    own = root / name
    write(own / "card.toml", '[task]\nid = "t1"\n[scoring.params]\ntarget_type = "regression"\ninterval_level = 0.9\n')
    write(own / "task.json", {"task_id": "t1", "cutoff_date": "2024-06-30", "target": {"name": "y", "type": "regression"}, "entities": [{"entity_id": e, "name": f"Issuer {e}", "spread": 70 + i, "note": "a:b, c"} for i, e in enumerate(ids)]})
    write(own / "corpus" / "d1.json", {"doc_id": "d1", "doc_date": "2024-01-02", "text": TEXT})
    digest = hashlib.sha256((own / "corpus" / "d1.json").read_bytes()).hexdigest()
    write(own / "manifest.json", {"files": [{"path": "corpus/d1.json", "role": "corpus", "sha256": "0" * 64 if tampered else digest, "bytes": 9, "shared": True}]})
    if outcome:
        write(own / "reference" / "outcome.json", {"unit_id": name, "outcomes": [{"entity_id": e, "y": float(i + 1)} for i, e in enumerate(IDS)]})
    if naive:
        write(own / "reference" / "naive_answer.json", answer(points=[2.5] * 4, half=1.5, ids=ids if naive is True else ids[:2]))


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("bundles")
    units, given = root / "units", root / "answers"
    unit(units, "u1")
    unit(units, "u2", naive=False)
    unit(units, "u3", tampered=True)
    unit(units, "u4", naive="short")
    unit(units, "u5", ids=["e0", "e1", "e2", "e2"])
    (units / "other").mkdir()
    write(units / "other" / "notes.txt", "no unit")
    line = '{"entity_id": "e1", "name": "Issuer e1", "spread": 71, "note": "a:b, c"}'
    at = len(line) + 1
    write(given / "u1" / "right.json", answer())
    write(given / "u1" / "naive.json", answer(points=[2.5] * 4, half=1.5))
    write(given / "u1" / "other.json", answer(task="t9"))
    write(given / "u1" / "broken.json", "{oops")
    write(given / "u1" / "quoted.json", answer(claim=("d1", "0", 41, "Sales rose.")))
    write(given / "u1" / "bare.json", '{"task_id": "t1", "x": NaN}')
    write(given / "u1" / "empty.json", {"task_id": "t1"})
    write(given / "u1" / "table.json", answer(claim=("task", at, at + len(line), "The spread is 71.")))
    write(given / "u1" / "whole.json", answer(claim=("d1", 0.0, 41.0, "Sales rose to 1,234.5 million in the year.")))
    return bundle.hydrate(spark, str(units), str(given))


def test_scores_from_folders(tables):
    got = {r.submission_id: r for r in scoring.evaluate(**{k: v for k, v in tables.items() if k != "faults"}).collect()}
    assert {s: r.reason for s, r in got.items()} == {"right": None, "naive": None, "other": "task_mismatch", "broken": "not_json", "quoted": "bad_offsets", "bare": "non_finite", "empty": "schema", "table": None, "whole": None}
    assert got["right"].quality == 1.0 and got["naive"].quality == pytest.approx(0.5) and got["right"].n_false == 0 and got["whole"].score == got["right"].score
    assert got["table"].n_false == 3  # the row is that of one entity


def test_faults_of_the_organiser(tables):
    found = {(r.unit_id, r.file, r.fault) for r in tables["faults"].collect()}
    assert found == {("u2", "reference/naive_answer.json", "roster_missing"), ("u3", "d1", "digest_mismatch"), ("u4", "reference/naive_answer.json", "roster_missing"), ("u5", "task.json", "roster"), ("u5", "reference/naive_answer.json", "roster_duplicate")}
    assert {r.unit_id for r in tables["units"].collect()} == {"u1", "u2", "u3", "u4", "u5"}


def test_task_table(spark, tables):
    lines = [r.line for r in tables["roster"].filter("unit_id = 'u1'").orderBy("pos").collect()]
    rows = [{"entity_id": e, "name": f"Issuer {e}", "spread": 70 + i, "note": "a:b, c"} for i, e in enumerate(IDS)]
    assert lines == [json.dumps(r, ensure_ascii=False, separators=(", ", ": ")) for r in rows]
    docs = scoring.with_task_documents(tables["docs"], tables["units"], tables["roster"]).filter("unit_id = 'u1' and doc_id = 'task'").collect()
    assert [d.text for d in docs] == ["\n".join(lines)] and str(docs[0].doc_date) == "2024-06-30"


def test_self_check(spark):
    docs = spark.createDataFrame([("u", "d", "abc")], "unit_id string, doc_id string, text string")
    claims = spark.createDataFrame([("u", "e", "d", 0, 3), ("u", "e", "d", 0, 4), ("u", "f", "d", None, 2), ("u", "g", "x", 0, 1), ("u", "h", "d", 2, 2)], "unit_id string, entity_id string, doc_id string, span_start int, span_end int")
    assert {(r.entity_id, r.code) for r in bundle.self_check(claims, docs).collect()} == {("e", "bad_span"), ("f", "bad_span"), ("g", "unknown_doc"), ("h", "bad_span")}


def test_offsets_are_whole_numbers(spark):
    raw = spark.createDataFrame([(i, f'{{"x": {t}}}') for i, t in enumerate(["120", "120.0", "120.5", "true", '"120"', "null", "1e2"])], "i int, t string")
    of = alignment.whole_offset(F.to_json(F.from_json("t", "x variant")["x"]))
    assert [(r.o, r.bad) for r in raw.select("i", of[0].alias("o"), of[1].alias("bad")).orderBy("i").collect()] == [(120, False), (120, False), (None, True), (None, True), (None, True), (None, False), (100, False)]
