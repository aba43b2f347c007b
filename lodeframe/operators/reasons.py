"""Submitted reasons: shape, duplicates, deny list, quotes, and the greedy budgets of what is judged.

Table: reasons (keys, pos, reason_id, premise, mechanism, answer_implication, citations: array of struct<doc_id,span_start,span_end>).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lodeframe.functions.urls import content_key, mask_addresses

# fixed values of the contract
MOST_REASONS, CITATION_CHARS = 3, 8000
ANSWER_BYTES, REASON_BYTES, EVIDENCE_BYTES = 3000, 6500, 46_500
QUOTE_WORDS = 3
DENIED = ["leaderboard", "canary", "/home/", "units/", "reference/", "outcome.json", "team_id", "team name", "participant_id", "participant name", "submission_id", "other submission"]
FIELDS = ["premise", "mechanism", "answer_implication"]

PAIRS = 65_536  # premises times documents of a unit that are compared one by one


def compact_json(*fields: tuple[str, Column]) -> Column:
    """A JSON object with sorted keys and no spaces, so its size doesn't depend on how it was written."""
    return F.to_json(F.struct(*[value.alias(name) for name, value in sorted(fields, key=lambda x: x[0])]))


def byte_size(json_text: Column) -> Column:
    return F.octet_length(json_text)


def shape_fault(reason_id: Column, *texts: Column) -> Column:
    """Why a reason is malformed; null if it is sound."""
    blank = [F.coalesce(F.trim(x), F.lit("")) == "" for x in texts]
    any_blank = blank[0]
    for x in blank[1:]:
        any_blank = any_blank | x
    return F.when(F.coalesce(reason_id, F.lit("")) == "", "no_id").when(any_blank, "empty_text")


def count_fault(n: Column) -> Column:
    return F.when(~n.between(1, MOST_REASONS), "count")


def first_of_each(reasons: DataFrame, keys: list[str]) -> DataFrame:
    """Content duplicates marked: all but the first reason with one folded text are duplicates."""
    text = F.concat_ws("\u001f", *[content_key(F.col(x)) for x in FIELDS])
    own = W.partitionBy(*keys, "content").orderBy("pos")
    return reasons.withColumn("content", text).withColumn("duplicate", F.row_number().over(own) > 1).drop("content")


def renumbered(reasons: DataFrame, keys: list[str]) -> DataFrame:
    """Ids r1, r2, ... by place."""
    return reasons.withColumn("reason_id", F.concat(F.lit("r"), F.row_number().over(W.partitionBy(*keys).orderBy("pos")).cast("string")))


def denied(seen: Column) -> Column:
    """The denied words that a folded text holds; an address counts as one."""
    return F.filter(F.array(*[F.lit(x) for x in [*DENIED, "://"]]), lambda w: F.contains(F.lower(seen), w))


def premise_quotes(premises: DataFrame, docs: DataFrame, on: list[str], masked: bool = True) -> DataFrame:
    """premises with is_quote: three words or more after masking addresses, and a piece of a document of the same unit.

    Texts and premises are shuffled once, by unit, and a premise meets the documents of its unit until one holds it. Units of more than PAIRS
    pairs of them are left out of that and looked through by words.
    """
    mask = mask_addresses if masked else (lambda x: x)
    plain = F.trim(mask(F.col("premise")))
    asked = premises.withColumn("_wanted", F.when(F.size(_words(plain)) >= QUOTE_WORDS, plain))
    texts = docs.select(*on, mask(F.col("text")).alias("_text"))
    times = lambda df, name: df.groupBy(*on).agg(F.count(F.lit(1)).alias(name))
    crowded = times(premises, "_p").join(times(docs, "_d"), on).filter(F.col("_p") * F.col("_d") > PAIRS).select(*on)
    if crowded.isEmpty():
        return _quoted(asked, texts, on)
    apart = lambda df, how: df.join(crowded, on, how)
    return _quoted(apart(asked, "left_anti"), apart(texts, "left_anti"), on).unionByName(_quoted_by_words(apart(asked, "left_semi"), apart(texts, "left_semi"), on))


def _words(text: Column) -> Column:
    return F.split(text, r"\s+")


def _quoted(asked: DataFrame, texts: DataFrame, on: list[str]) -> DataFrame:
    """is_quote by joins on the unit, which stop at the first document that holds the premise."""
    own = texts.select(*[F.col(c).alias(f"_{c}") for c in on], "_text")
    held = reduce(lambda a, c: a & (F.col(f"_{c}") == F.col(c)), on, F.contains("_text", "_wanted"))
    part = lambda how, quotes: asked.join(own, held, how).drop("_wanted").withColumn("is_quote", F.lit(quotes))
    return part("left_semi", True).union(part("left_anti", False))


def _quoted_by_words(asked: DataFrame, texts: DataFrame, on: list[str]) -> DataFrame:
    """is_quote of units with many pairs. The words inside a premise stand whole in a document that holds it, so a premise meets only the documents that have the rarest of them.

    Words and documents travel as 64-bit hashes: equal ones of different words bring more documents to be read, and lose none.
    """
    known = asked.withColumn("_asked", F.unhex(F.sha2("_wanted", 256)))
    long = known.select(*on, "_asked", "_wanted").distinct().filter("_wanted is not null")
    hashes = lambda words: F.explode(F.array_distinct(F.transform(words, lambda w: F.xxhash64(w)))).alias("word")
    inner = long.select(*on, "_asked", hashes(F.slice(_words(F.col("_wanted")), 2, F.size(_words(F.col("_wanted"))) - 2)))
    texts = texts.withColumn("_doc", F.xxhash64("_text"))
    held = texts.select(*on, "_doc", hashes(_words(F.col("_text")))).join(inner.select(*on, "word").distinct(), [*on, "word"], "left_semi")
    common = held.groupBy(*on, "word").agg(F.count(F.lit(1)).alias("n"))
    # a word that no document has leaves no quote; otherwise the rarest one decides which documents are read
    rarest = inner.join(common, [*on, "word"], "left").groupBy(*on, "_asked").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word"))["word"].alias("word"))
    near = rarest.join(held, [*on, "word"]).select(*on, "_asked", "_doc").join(long, [*on, "_asked"])
    hit = near.join(texts, [*on, "_doc"]).filter(F.contains("_text", F.col("_wanted"))).select(*on, "_asked").distinct().withColumn("is_quote", F.lit(True))
    return known.join(hit, [*on, "_asked"], "left").withColumn("is_quote", F.coalesce("is_quote", F.lit(False))).select(*[c for c in asked.columns if c != "_wanted"], "is_quote")


def trusted_citations(reasons: DataFrame, docs: DataFrame, on: list[str], cutoff: Column) -> DataFrame:
    """A row for each citation of a reason that resolves, isn't late and lies in its document; reasons survive without."""
    cited = reasons.select(*on, "reason_id", F.posexplode("citations").alias("cite_pos", "c")).select(*on, "reason_id", "cite_pos", "c.*")
    known = cited.join(docs.select(*on, "doc_id", "doc_date", F.length("text").alias("doc_length")), [*on, "doc_id"])
    return known.filter((F.col("doc_date") <= cutoff) & (F.col("span_start") >= 0) & (F.col("span_start") < F.col("span_end")) & (F.col("span_end") <= F.col("doc_length")) & (F.col("span_end") - F.col("span_start") <= CITATION_CHARS))


def greedy_budget(items: DataFrame, keys: list[str], sizes: list[str], budgets: list[int], order: str = "pos") -> DataFrame:
    """Each item's `judged` and `why`, in order: an item that would break a budget is skipped and takes nothing of it.

    A running sum can't do this, as skipped items must not count: a fold over the ordered items of a key carries
    the totals. Budgets bound the items that a key keeps; keys are answers, with few items each.
    """
    cells = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), *[F.col(s).cast("long").alias(s) for s in sizes], "blocked")))
    start = F.struct(*[F.lit(0).cast("long").alias(s) for s in sizes], F.array().cast("array<struct<o:bigint,judged:boolean,why:string>>").alias("out"))

    def step(a: Column, x: Column) -> Column:
        over = F.coalesce(x["blocked"], *[F.when(a[s] + x[s] > limit, F.lit(s)) for s, limit in zip(sizes, budgets, strict=True)])
        kept = over.isNull()
        row = F.struct(x["o"].cast("long").alias("o"), kept.alias("judged"), over.alias("why"))
        return F.struct(*[(a[s] + F.when(kept, x[s]).otherwise(F.lit(0).cast("long"))).alias(s) for s in sizes], F.array_append(a["out"], row).alias("out"))

    folded = items.groupBy(*keys).agg(F.aggregate(cells, start, step, lambda a: a["out"]).alias("out"))
    return folded.select(*keys, F.explode("out").alias("x")).select(*keys, F.col("x.o").alias(order), "x.judged", "x.why")
