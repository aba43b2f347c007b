"""The corpus pipeline: documents from raw texts to packed training sequences, each stage on all that its predecessor kept.

All stages stand nulls in any column, empty and very long texts, repeated rows, empty tables and columns of any further names: what isn't named below
is carried along, and an empty table gives an empty one with the same columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeframe.llm import mixing, near_dedup, packing, pii, quality, queries, training
from lodeframe.llm.store import checkpoint


def _good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go; the folds are those of its query.

    Null and empty texts are scored as such, a null id trains nothing, and rows that repeat are kept or go together.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    name = "_".join([*docs.columns, "score"])  # no column has it
    scores = quality.annotate(docs, labels, training.fold("doc_id", 3) != 1, name)
    return scores.filter(F.col(f"`{name}`") >= 0.5).select(*[F.col(f"`{c}`") for c in docs.columns])


def _one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: that with the smallest id.

    Rows that repeat an id and a text stay once. Of documents without an id, one of each text stays, if none with an id that stays has it.
    """
    own_id, text = F.col("doc_id"), F.col("text").cast("string")
    gone = checkpoint(near_dedup.near_dedup(docs).filter(~F.col("kept")).select("doc_id").distinct())
    twice = checkpoint(docs.filter(own_id.isNotNull()).groupBy("doc_id").agg(F.count(F.lit(1)).alias("_rows")).filter("_rows > 1").select("doc_id").join(gone, "doc_id", "left_anti"))
    once = docs.filter(own_id.isNotNull()).join(gone.union(twice), "doc_id", "left_anti").select(*docs.columns)
    repeated = docs.join(twice, "doc_id", "left_semi").select(*docs.columns)
    key = "_".join([*docs.columns, "key"])  # no column has it
    one = repeated.withColumn(key, F.md5(text)).dropDuplicates(["doc_id", key]).drop(key)
    nameless = docs.filter(own_id.isNull()).withColumn(key, F.md5(text))
    if nameless.isEmpty():
        return once.union(one)
    held = docs.filter(own_id.isNotNull()).select("doc_id", F.md5(text).alias(key)).join(gone, "doc_id", "left_anti").select(key).distinct()
    return once.union(one).union(nameless.dropDuplicates([key]).join(held, key, "left_anti").select(*docs.columns))


def _masked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; n_chars follows, where there is such a column. A null text stays null."""
    masked = pii.mask(docs)
    return masked.withColumn("n_chars", F.length("text").cast(masked.schema["n_chars"].dataType)) if "n_chars" in masked.columns else masked


def _mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it. Null and empty texts have no words; a null source is one of its own."""
    return mixing.mix_documents(docs)


def _packed(spark: SparkSession, docs: DataFrame, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    """A row for each piece, with its ids and its place in a sequence. A null or empty text is the end id alone."""
    return packing.pack(docs, vocabulary or queries.vocabulary(), with_ids=True)


STAGES = [
    ("quality classifier", _good_quality),
    ("MinHash near-dedup", _one_of_each_group),
    ("PII", _masked),
    ("mixing sources to target weights", _mixed),
    ("best-fit packing", _packed),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; what one kept is written once, as the next may read it several times."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, checkpoint(docs) if k else docs, sf_dir)
    return docs
