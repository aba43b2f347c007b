"""Evidence retrieval: chunks with offsets, BM25, overlap ranking, quote grounding and a hybrid score.

Tables: docs (doc_id, doc_date, text or spans), chunks (doc_id, doc_date, start, end, text), queries (query_id, query).
Statistics are taken after the embargo filter, which is part of their meaning, not an optimisation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lodeframe.session import counted, dealt

DOCS = 1000  # documents whose terms one task holds

# fixed values of the ranking contract
K1, B, ALPHA = 1.5, 0.75, 0.4


def tokens(text: Column, longer_than: int = 1) -> Column:
    """Lower-case runs of ASCII letters and digits longer than so many characters."""
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0)), lambda t: F.length(t) > longer_than)


def document_text(text: Column, spans: Column) -> Column:
    """The text, or its spans joined by a space, or nothing."""
    return F.coalesce(text, F.array_join(F.transform(spans, lambda s: s["text"]), " "), F.lit(""))


def span_chunks(docs: DataFrame) -> DataFrame:
    """A chunk for each span with global offsets in the joined text; empty spans move offsets and give no chunk."""
    rows = docs.select("doc_id", "doc_date", F.posexplode("spans").alias("pos", "span")).select("doc_id", "doc_date", "pos", F.coalesce(F.col("span.text"), F.lit("")).alias("text"))
    before = W.partitionBy("doc_id").orderBy("pos").rowsBetween(W.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("text") + 1).over(before), F.lit(0))
    return rows.withColumn("start", start).withColumn("end", F.col("start") + F.length("text")).filter("text <> ''").select("doc_id", "doc_date", "start", "end", "text")


def bm25(chunks: DataFrame, queries: DataFrame, cutoff: Column, k: int) -> DataFrame:
    """query_id, doc_id, start, score and rank of the k best chunks of each query.

    Chunks are dealt by document, DOCS a task, and queries' terms come to them, so postings and scores are made, counted and ranked where
    the chunk lies: only terms' frequencies and each task's k best of a query move. Order: score to nine digits, as sums of doubles differ behind them, then doc_id, then start.
    """
    usable = dealt(chunks.filter(F.coalesce(F.col("doc_date") <= cutoff, F.lit(False))).select("doc_id", "start", "text"), "doc_id", rows=DOCS).select("doc_id", "start", tokens(F.col("text")).alias("terms"))
    sized = usable.withColumn("n", F.size("terms"))
    totals = sized.agg(F.count(F.lit(1)).alias("chunks"), F.avg("n").alias("mean"))
    asked = queries.select("query_id", F.explode(F.array_distinct(tokens(F.col("query")))).alias("term"))
    wanted = counted(asked.select("term").distinct())
    postings = sized.select("doc_id", "start", "n", F.explode("terms").alias("term")).join(wanted, "term", "left_semi").groupBy("term", "doc_id", "start", "n").agg(F.count(F.lit(1)).alias("tf"))
    frequency = postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    # one row of totals: its size is fixed
    weighed = frequency.join(F.broadcast(totals)).withColumn("idf", F.log(1 + (F.col("chunks") - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    each = postings.join(counted(asked.join(weighed, "term")), "term").withColumn("part", F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("n") / F.col("mean"))))
    scored = each.groupBy("query_id", "doc_id", "start").agg(F.sum("part").alias("score")).filter("score > 0")
    order = W.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "doc_id", "start")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def overlap_best(docs: DataFrame, queries: DataFrame, cutoff: Column, most_chars: int = 240) -> DataFrame:
    """The document of each query with the most query tokens (repeats count) over the root of its length.

    Undated documents pass. The first in `pos` wins ties; a document without a shared token scores 0 and may still win.
    """
    admitted = docs.filter(~F.coalesce(F.col("doc_date") > cutoff, F.lit(False)))
    termed = lambda rows: rows.withColumn("terms", tokens(F.col("text"), 2)).filter(F.size("terms") > 0)
    passing = termed(dealt(admitted.select("doc_id", "pos", "text"), "doc_id", rows=DOCS))
    asked = queries.select("query_id", F.array_distinct(tokens(F.col("query"), 2)).alias("asked")).filter(F.size("asked") > 0)
    wanted = asked.select("query_id", F.explode("asked").alias("term"))
    # documents are dealt, DOCS a task, and queries' terms come to them, so no term moves
    words = passing.select("doc_id", "pos", F.size("terms").alias("n"), F.explode("terms").alias("term")).join(counted(wanted.select("term").distinct()), "term", "left_semi")
    times = words.groupBy("term", "doc_id", "pos", "n").agg(F.count(F.lit(1)).alias("tf"))
    hits = times.join(counted(wanted), "term").groupBy("query_id", "doc_id", "pos", "n").agg(F.sum("tf").alias("shared"))
    best = hits.withColumn("score", F.col("shared") / F.sqrt(F.col("n"))).groupBy("query_id").agg(F.max(F.struct("score", (-F.col("pos")).alias("order"), "doc_id")).alias("best"))
    # queries that share no token get the first document with score 0
    first = passing.agg(F.min(F.struct("pos", "doc_id")).alias("first"))
    chosen = asked.select("query_id").join(best, "query_id", "left").join(F.broadcast(first)).select("query_id", F.coalesce("best.doc_id", "first.doc_id").alias("doc_id"), F.coalesce("best.score", F.lit(0.0)).alias("score"))
    return termed(admitted.select("doc_id", "text")).join(counted(chosen), "doc_id").select("query_id", "doc_id", "score", F.lit(0).alias("start"), F.least(F.length("text"), F.lit(most_chars)).alias("end"), F.left("text", F.lit(most_chars)).alias("text"))


_CURLY, _PLAIN = "‘’“”–— ", "''\"\"-- "


def find_quote(text: Column, quote: Column) -> tuple[Column, Column]:
    """(start, end) of the first place of a quote, as written or with quotes, dashes and hard spaces made plain; null if none."""
    wanted = F.trim(quote)
    fold = lambda x: F.translate(x, _CURLY, _PLAIN)
    at = F.when(F.instr(text, wanted) > 0, F.instr(text, wanted)).otherwise(F.instr(fold(text), fold(wanted)))
    start = F.when((wanted != "") & (at > 0), at - 1)
    return start, start + F.length(wanted)


def word_overlap(a: Column, b: Column) -> Column:
    """Distinct white-space words in common, in lower case."""
    return F.size(F.array_intersect(F.split(F.lower(F.trim(a)), r"\s+"), F.split(F.lower(F.trim(b)), r"\s+")))


def best_chunk(quotes: DataFrame, chunks: DataFrame) -> DataFrame:
    """For each quote (quote_id, doc_id, quote) the chunk of its document with most words in common; none without a common word."""
    pairs = quotes.join(chunks, "doc_id").withColumn("shared", word_overlap(F.col("quote"), F.col("text"))).filter("shared > 0")
    return pairs.groupBy("quote_id").agg(F.max_by(F.struct("doc_id", "start", "end", "shared"), F.struct("shared", (-F.col("start")).alias("order"))).alias("c")).select("quote_id", "c.*")


def ground(quotes: DataFrame, docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """Offsets of each quote: where it stands, else its best chunk, else none (how is then null)."""
    start, end = find_quote(F.col("text"), F.col("quote"))
    found = quotes.join(docs.select("doc_id", "text"), "doc_id", "left").select("quote_id", "doc_id", start.alias("q_start"), end.alias("q_end"))
    rest = best_chunk(quotes, chunks).select("quote_id", F.col("start").alias("c_start"), F.col("end").alias("c_end"))
    return found.join(rest, "quote_id", "left").select("quote_id", "doc_id", F.coalesce("q_start", "c_start").alias("start"), F.coalesce("q_end", "c_end").alias("end"), F.when(F.col("q_start").isNotNull(), "quote").when(F.col("c_start").isNotNull(), "chunk").alias("how"))


def prefix_claim(text: Column, most_chars: int = 200) -> Column:
    """A verbatim prefix, cut back to a whole word."""
    head = F.left(text, F.lit(most_chars))
    return F.when(F.length(text) > most_chars, F.regexp_replace(head, " [^ ]*$", "")).otherwise(text)


def entity_query(*parts: Column, suffix: str = "") -> Column:
    """The parts that are there, joined by spaces, and a suffix."""
    return F.concat_ws(" ", *parts, *([F.lit(suffix)] if suffix else []))


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def hybrid(lexical: Column, dense: Column, alpha: float = ALPHA) -> Column:
    """alpha of the lexical score and the rest of the dense one; a missing score counts 0."""
    return alpha * F.coalesce(lexical, F.lit(0.0)) + (1 - alpha) * F.coalesce(dense, F.lit(0.0))
