"""One query for each operator of this subpackage, over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeframe.llm import conversations, fill_middle, fingerprint, line_rules, mixing, near_dedup, nearest, packing, pii, quality, secrets, substring_dedup, toxicity, training


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _scored(scores: DataFrame, held_out) -> DataFrame:
    return scores.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = training.fold("doc_id", 3) == 1
    return _scored(quality.quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), ~held_out), held_out)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_dedup(_table(spark, sf_dir, "documents"), width=3, num=85, den=100)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = training.fold("doc_id", 5) == 0
    return _scored(toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), ~held_out), held_out)


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.summary(pii.find(_table(spark, sf_dir, "documents")))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.summary(secrets.find(_table(spark, sf_dir, "documents")))


def op7_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op8_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edited_fingerprints(_table(spark, sf_dir, "documents"))


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), vocabulary())


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.substring_dedup(_table(spark, sf_dir, "documents"), keep_text=False)


def op11_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_rules.clean_lines(_table(spark, sf_dir, "documents"), keep_text=False)


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.audit(*conversations.damaged(_table(spark, sf_dir, "conversations")))


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.fill_middle(_table(spark, sf_dir, "documents"), keep_text=False)


QUERIES = {f.__name__: f for f in (op1_quality, op2_mixing, op3_near_dedup, op4_toxicity, op5_pii, op6_secrets, op7_nearest, op8_fingerprint, op9_packing, op10_substring_dedup, op11_line_rules, op12_conversation_repair, op13_fill_middle)}
ORACLES: dict[str, str] = {"op2_mixing": mixing.ORACLE, "op3_near_dedup": near_dedup.ORACLE, "op7_nearest": nearest.ORACLE, "op10_substring_dedup": substring_dedup.ORACLE, "op11_line_rules": line_rules.ORACLE, "op13_fill_middle": fill_middle.ORACLE}
