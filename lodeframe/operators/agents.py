"""Answering rows: the deterministic agent's predictions, fallbacks, hypotheses and prompts as expressions."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# fixed values of the agents' contract
ORDERS, FLOOR, PLACES = 10.0, 0.05, 4


def classified(reported: Column, consensus: Column, threshold: Column) -> Column:
    return F.when(reported > consensus * (1 + threshold), "beat").when(reported < consensus * (1 - threshold), "miss").otherwise("inline")


def uninformative_band(features: list[Column]) -> Column:
    """Ten times the largest magnitude that an entity declares, or ten."""
    sound = [F.when(x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x) != float("inf")), F.abs(x).cast("double")) for x in features]
    return ORDERS * F.greatest(F.lit(1.0), *sound) if len(sound) else F.lit(ORDERS)


def in_vocabulary(label: Column, labels: Column) -> Column:
    """A label outside the vocabulary becomes inline where that is one, else the first."""
    return F.when(labels.isNull() | (F.size(labels) == 0) | F.array_contains(labels, label), label).when(F.array_contains(labels, F.lit("inline")), "inline").otherwise(F.element_at(labels, 1))


def predicted(reported: Column, consensus: Column, threshold: Column, band: Column, labels: Column) -> Column:
    """label, point_forecast, low and high of one row."""
    known = reported.isNotNull() & consensus.isNotNull()
    point = F.when(known, reported).otherwise(F.coalesce(consensus, F.lit(0.0)))
    half = F.when(known, F.greatest(F.abs(point) * threshold * 2, F.lit(FLOOR))).otherwise(band)
    label = in_vocabulary(F.when(known, classified(reported, consensus, threshold)).otherwise(F.lit("inline")), labels)
    return F.struct(label.alias("label"), point.alias("point_forecast"), (point - half).alias("low"), (point + half).alias("high"))


def safe_interval(low: Column, high: Column, centre: Column) -> Column:
    """The interval if it is one, else the centre and half its magnitude, or one, to each side."""
    sound = low.isNotNull() & high.isNotNull() & ~F.isnan(low) & ~F.isnan(high) & (F.abs(low) != float("inf")) & (F.abs(high) != float("inf")) & (low <= high)
    half = F.greatest(F.abs(centre) / 2, F.lit(1.0))
    return F.struct(F.when(sound, low).otherwise(centre - half).alias("low"), F.when(sound, high).otherwise(centre + half).alias("high"))


def rounded(x: Column) -> Column:
    """Half to even, as the answer format writes numbers."""
    return F.bround(x, PLACES)


def target_type(flat: Column, nested: Column) -> Column:
    return F.coalesce(flat, nested, F.lit("classification"))


def answer_json(df: DataFrame) -> DataFrame:
    """One JSON answer for each submission and unit from aligned rows: the sink's format."""
    row = F.struct("entity_id", "label", "point_forecast", F.struct(F.col("level"), F.col("low").alias("lo"), F.col("high").alias("hi")).alias("interval"), "claims")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("pos", row.alias("row")))), lambda x: x["row"])
    return df.groupBy("submission_id", "unit_id").agg(F.to_json(F.struct(F.first("task_id").alias("task_id"), ordered.alias("entity_predictions"))).alias("answer"))


@F.pandas_udf(T.StringType())
def number_text(value: pd.Series) -> pd.Series:
    """Integers as such, other numbers with six significant digits."""
    codes, distinct = pd.factorize(value)  # each distinct number is written once
    written = [str(int(x)) if math.isfinite(x) and x == int(x) and abs(x) < 1e15 else f"{x:.6g}" for x in distinct.tolist()]
    return pd.Series([None if c < 0 else written[c] for c in codes], dtype=object)


def hypotheses(target: Column, name: Column, kind: Column, assertion: Column, point: Column, low: Column, high: Column, rank: Column) -> Column:
    """Three phrasings of one prediction, by target type."""
    by = {
        "classification": [F.concat(name, F.lit(" "), assertion, F.lit(".")), F.concat(F.lit("It holds that "), name, F.lit(" "), assertion, F.lit(".")), F.concat(F.lit("The evidence says that "), name, F.lit(" "), assertion, F.lit("."))],
        "regression": [F.concat(F.lit("The "), target, F.lit(" of "), name, F.lit(" will be about "), point, F.lit(".")), F.concat(name, F.lit(" will have a "), target, F.lit(" near "), point, F.lit(".")), F.concat(F.lit("The "), target, F.lit(" of "), name, F.lit(" will lie between "), low, F.lit(" and "), high, F.lit("."))],
        "ranking": [F.concat(name, F.lit(" will rank "), rank, F.lit(" by "), target, F.lit(".")), F.concat(F.lit("By "), target, F.lit(", "), name, F.lit(" takes place "), rank, F.lit(".")), F.concat(F.lit("The "), target, F.lit(" of "), name, F.lit(" will be about "), point, F.lit("."))],
    }
    chosen = F.lit(None).cast("array<string>")
    for of, texts in by.items():
        chosen = F.when(kind == of, F.array(*texts)).otherwise(chosen)
    return chosen


def exploded_hypotheses(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.select(*keys, F.posexplode("hypotheses").alias("phrasing", "hypothesis"))


def entity_names(features: Column) -> Column:
    """Distinct values of name, entity_id and any key that ends in ticker, of a string map, in order."""
    own = F.map_filter(features, lambda k, v: (k == "name") | (k == "entity_id") | k.endswith("ticker"))
    return F.array_distinct(F.filter(F.map_values(own), lambda v: F.trim(v) != ""))


def reply_object(reply: Column) -> Column:
    """The first brace-delimited block of a model's reply, if it parses."""
    block = F.regexp_extract(reply, r"(?s)\{.*\}", 0)
    return F.when(F.try_parse_json(block).isNotNull(), block)


def prompt(task: Column, entity: Column, excerpts: Column) -> Column:
    """A prompt with numbered excerpts (array of struct<doc_id,text>)."""
    numbered = F.transform(excerpts, lambda x, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), x["doc_id"], F.lit(": "), x["text"]))
    return F.concat_ws("\n", F.concat(F.lit("Task: "), task), F.concat(F.lit("Entity: "), entity), F.lit("Excerpts:"), F.array_join(numbered, "\n"), F.lit('Reply with one JSON object: {"label", "point_forecast", "interval", "evidence"}.'))


def from_reply(reply: Column, labels: Column) -> Column:
    """label, point_forecast, low, high of a reply's object; labels outside the vocabulary become the first one."""
    o = F.from_json(reply, "label string, point_forecast double, interval struct<lo:double,hi:double>")
    label = F.when(F.array_contains(labels, o["label"]), o["label"]).otherwise(F.element_at(labels, 1))
    point = F.coalesce(o["point_forecast"], F.lit(0.0))
    interval = safe_interval(o["interval"]["lo"], o["interval"]["hi"], point)
    return F.struct(label.alias("label"), point.alias("point_forecast"), interval["low"].alias("low"), interval["high"].alias("high"))


def model_replies(prompts: DataFrame, build) -> DataFrame:
    """prompts (key, prompt) with reply and error, from build() -> complete(prompt); a refused or failed call is a row, not an abort."""

    def run(frames):
        complete = build()
        for frame in frames:
            out = []
            for text in frame.prompt:
                try:
                    out.append((complete(text), None))
                except (OSError, TimeoutError, ValueError) as fault:
                    out.append((None, type(fault).__name__))
            yield pd.DataFrame({"key": frame.key, "reply": [r for r, _ in out], "error": [e for _, e in out]})

    return prompts.select("key", "prompt").mapInPandas(run, "key string, reply string, error string")
