"""The pipeline and its queries on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from lodeframe.llm import mixing, near_dedup, pii, quality, queries, training

ORDER = ["quality", "MinHash", "PII", "mixing", "packing"]


def test_stages_follow_one_another(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, kept = docs.columns, docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        assert ORDER[k] in name
        before = kept
        kept = stage(spark, kept, sf)
        if k < len(ORDER) - 1:
            assert kept.columns == columns
        kept.write.parquet(str(tmp_path / str(k)))
        kept = spark.read.parquet(str(tmp_path / str(k)))
        ids = {r.doc_id for r in kept.select("doc_id").distinct().collect()}
        if k == 0:
            labels = spark.read.parquet(f"{sf}/labels.parquet")
            scores = {r.doc_id: r.score for r in quality.quality(before, labels, training.fold("doc_id", 3) != 1).collect()}
            assert ids == {i for i, s in scores.items() if s >= 0.5}
        if k == 1:
            assert ids == {r.doc_id for r in near_dedup.near_dedup(before).filter("kept").collect()}
        if k == 2:
            assert ids == {r.doc_id for r in before.collect()}
            assert pii.summary(pii.find(kept)).filter("n_email + n_ip + n_card + n_phone > 0").count() == 0
        if k == 3:
            copies = {r.doc_id: r.copies for r in mixing.mix(before).collect() if r.copies}
            assert {r.doc_id: r["count"] for r in kept.groupBy("doc_id").count().collect()} == copies
    assert kept.count() == corpus_pipeline.run(spark, sf).count()


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, sf, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings"):
        con.sql(f"create view {table} as select * from '{sf}/{table}.parquet'")
    df, found = queries.QUERIES[name](spark, sf), con.sql(queries.ORACLES[name])
    order = sorted(df.columns)
    assert order == sorted(found.columns)
    rows = lambda data, columns: sorted(tuple(repr(r[columns.index(c)]) for c in order) for r in data)
    assert rows([tuple(r) for r in df.collect()], df.columns) == rows(found.fetchall(), found.columns)


def test_entry_has_all(spark):
    assert {f"op{n}_" for n in range(1, 14)} == {x[: x.index("_") + 1] for x in entry.queries() if x.startswith("op")}
    assert "pipeline" in entry.queries()


def test_repeated_rows_stay_once(spark):
    from fixtures import prose

    texts = [prose(i, 80) for i in range(6)]
    data = [*enumerate(texts[:3]), (0, texts[0]), (0, texts[0]), (1, texts[4]), (None, texts[2]), (None, texts[5]), (None, texts[5]), (None, None), (None, None), (7, texts[1])]
    df = spark.createDataFrame([(i, t, "x") for i, t in data], "doc_id long, text string, source string").repartition(3)
    got = corpus_pipeline._one_of_each_group(spark, df, "")
    assert got.columns == df.columns
    kept = [(r.doc_id, r.text) for r in got.collect()]
    assert len(kept) == len(set(kept))
    by = {i: sorted(t or "" for j, t in kept if j == i) for i in {i for i, _ in kept}}
    assert by[0] == [texts[0]] and by[2] == [texts[2]] and by[None] == ["", texts[5]]


def test_stages_stand_odd_tables(spark, sf, tmp_path):
    """Nulls in every column, empty and very long texts, ties, repeats, an empty table and columns with clashing names."""
    from fixtures import SCHEMA, documents, empty, rows

    columns = [c.split()[0] for c in SCHEMA.split(", ")]
    docs = documents(spark)
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        none = stage(spark, empty(spark), sf)
        assert none.count() == 0
        before = {(r.doc_id, r.text) for r in docs.collect()}
        docs = stage(spark, docs, sf)
        assert docs.columns == none.columns
        if k == len(corpus_pipeline.STAGES) - 1:
            break
        assert docs.columns == columns
        docs.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        after = [(r.doc_id, r.text) for r in docs.collect()]
        if name != "PII":
            assert set(after) <= before
        if k == 1:
            assert len(after) == len(set(after))
        if name == "PII":
            assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in docs.collect())
    pieces = docs.collect()
    assert {(r.doc_id) for r in pieces} == {i for i, _ in after} and all(r.length == len(r.ids) // 4 for r in pieces)


@pytest.mark.parametrize("k", range(5))
def test_each_stage_on_odd_rows(spark, sf, k):
    from fixtures import documents, rows, words

    name, stage = corpus_pipeline.STAGES[k]
    got = stage(spark, documents(spark), sf).collect()
    own = {(r[0], r[1]) for r in rows()}
    if k == 1:
        assert {r.doc_id for r in got if r.doc_id is not None} == {0, *range(3, 15)} and len(got) == len({(r.doc_id, r.text) for r in got})
    elif k == 2:
        assert len(got) == len(rows())
        assert all(r.text == dict(own)[r.doc_id] for r in got if r.doc_id in (0, 3, 4, 5, 10, 13))
    elif k == 3:
        sizes = {}
        for r in rows():
            sizes[r[3]] = sizes.get(r[3], 0) + len(words(r[1]))
        assert {(r.doc_id, r.text) for r in got} <= own
        assert all(sum(len(words(r.text)) for r in got if r.source == s) <= 3 * n for s, n in sizes.items())
    elif k == 4:
        assert sum(r.length == 1 for r in got) >= 3  # null and empty texts are the end id
        assert {r.doc_id for r in got} == {i for i, _ in own}
    else:
        assert {(r.doc_id, r.text) for r in got} <= own
