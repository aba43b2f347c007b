"""Personal data by weak supervision, with DataFrame operations only.

Base spans (email, ip, card, phone) are leftmost non-overlapping matches that pass their rule; they always stay. Further
candidates are looser forms: masked emails, national telephone numbers, grouped identity numbers and matches that a rule dropped.
Labelers vote for, against or not at all on every candidate: strict form, checksum and shape, gazetteers of endings,
calling codes and issuers, words before that announce personal data, words that announce something else, and
isolation. Votes are counted by pattern (at most 3**6 rows, whatever the input); expectation-maximisation over the
counts estimates the labelers' reliabilities and each pattern's posterior. A final span classifier, naive Bayes over the
span's own features (kind, length, separators, digit share, neighbours), is trained on posterior-weighted counts.
A candidate that isn't base is added if the classifier and the posterior both reach `threshold`.

Defined cases: a null text is empty; empty texts have no spans; a null doc_id is kept as it is; rows that repeat are
read each; added spans that touch a base span or an earlier added one are dropped; an empty table gives no row;
other columns are ignored by `find` and kept by `mask`.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeframe.llm.spanning import apart, in_order, listed, replaced, with_spans
from lodeframe.llm.store import checkpoint

KINDS = ["email", "ip", "card", "phone"]
EXTRA = ["masked", "local", "idno"]
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "masked": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?[(\[]at[)\]] ?[A-Za-z0-9-]{1,63}+(?: ?(?:[(\[]dot[)\]]|\.) ?[A-Za-z0-9-]{1,63}+){1,8}+",
    "local": r"(?<![0-9+(.-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])",
    "idno": r"(?<![0-9.-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
# fixed values: words of the gazetteers and contexts, in the four languages of the corpus
ENDINGS = ["com", "org", "net", "edu", "gov", "info", "de", "fr", "es", "uk", "eu", "io", "example"]
CALLING = ["1", "7", "20", "27", "30", "31", "32", "33", "34", "39", "41", "43", "44", "45", "46", "47", "48", "49", "52", "54", "55", "61", "81", "86", "91"]
ANNOUNCE = ["mail", "contact", "kontakt", "correo", "courriel", "phone", "call", "tel", "fon", "mobile", "fax", "card", "visa", "karte", "tarjeta", "carte", "address", "adresse", "ssn", "reach"]
ELSEWHERE = ["version", "order", "invoice", "isbn", "issn", "price", "total", "section", "figure", "table", "page", "build", "http"]
LABELERS = ["form", "shape", "gazetteer", "announced", "elsewhere", "alone"]
THRESHOLD, EM_STEPS = 0.9, 60


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(d: Column) -> Column:
    value = lambda i: F.substring(d, F.length(d) - i + 1, F.lit(1)).cast("int")
    double = lambda x: F.when(x > 4, 2 * x - 9).otherwise(2 * x)
    return F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), lambda a, i: a + F.when(i % 2 == 0, double(value(i))).otherwise(value(i))) % 10 == 0


def _valid(s: Column) -> Column:
    """Whether a match passes the rule of its kind."""
    d = _digits(s["match"])
    octet = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
    return (
        F.when(s["kind"] == "email", True)
        .when(s["kind"] == "ip", s["match"].rlike(rf"^{octet}(?:\.{octet}){{3}}$"))
        .when(s["kind"] == "card", F.when(F.length(d).between(13, 19), _luhn(d)).otherwise(False))
        .when(s["kind"] == "phone", F.length(d).between(9, 15))
        .otherwise(False)
    )


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, "+").when(no, "-").otherwise("0")


def _votes(s: Column, valid: Column) -> Column:
    d, kind = _digits(s["match"]), s["kind"]
    before = F.lower(s["before"])
    ending = F.lower(F.regexp_extract(s["match"], r"([A-Za-z0-9-]+)$", 1))
    any_of = lambda words: before.rlike("|".join(words))
    shape = _vote((kind == "email") | (kind == "card") & valid | kind.isin("local", "idno", "masked") | (kind == "phone") & (F.length(d) >= 10), (kind == "card") & ~valid | F.length(d).between(20, 10_000))
    gazetteer = _vote(
        kind.isin("email", "masked") & ending.isin(ENDINGS) | (kind == "phone") & d.rlike("^(?:" + "|".join(CALLING) + ")") | (kind == "card") & d.rlike("^(?:3[47]|4|5[1-5]|6)"),
        (kind == "ip") & s["match"].rlike(r"^(?:0|127|255)\.") | (kind == "card") & d.rlike("^0"),
    )
    alone = _vote(~F.coalesce(s["before"].rlike("[A-Za-z0-9]$"), F.lit(False)) & ~F.coalesce(s["after"].rlike("^[A-Za-z0-9]"), F.lit(False)), s["after"].rlike("^[A-Za-z0-9]") | s["before"].rlike("[A-Za-z0-9]$"))
    return F.concat(_vote(valid, kind.isin(KINDS) & ~valid), shape, gazetteer, _vote(any_of(ANNOUNCE), F.lit(False)), _vote(F.lit(False), any_of(ELSEWHERE)), alone)


def _features(s: Column) -> Column:
    d = F.length(_digits(s["match"]))
    n = F.length(s["match"])
    return F.array(
        F.concat(F.lit("kind "), s["kind"]),
        F.concat(F.lit("length "), F.least(F.floor(n / 4), F.lit(12)).cast("string")),
        F.concat(F.lit("digits "), F.floor(4 * d / n).cast("string")),
        F.concat(F.lit("parts "), F.least(F.size(F.split(s["match"], "[ ().@-]+")), F.lit(8)).cast("string")),
        F.concat(F.lit("left "), F.when(s["before"] == "", "end").when(s["before"].rlike(r"\s$"), "space").when(s["before"].rlike("[A-Za-z0-9]$"), "word").otherwise("mark")),
        F.concat(F.lit("right "), F.when(s["after"] == "", "end").when(s["after"].rlike(r"^\s"), "space").when(s["after"].rlike("^[A-Za-z0-9]"), "word").otherwise("mark")),
    )


def estimate(counts: dict[str, int], steps: int = EM_STEPS) -> dict[str, float]:
    """The posterior of each vote pattern under a two-class model with independent labelers.

    It starts from the majority of votes; rates are smoothed, so a labeler that never votes is harmless.
    """
    chance = {v: (1 + v.count("+")) / (2 + v.count("+") + v.count("-")) for v in counts}
    total = sum(counts.values())
    for _ in range(steps if total else 0):
        prior = min(0.99, max(0.01, sum(n * chance[v] for v, n in counts.items()) / total))
        rates = []
        for i in range(len(LABELERS)):
            by = {c: {x: 1.0 for x in "+-0"} for c in (0, 1)}
            by[1]["+"] += 2
            by[0]["-"] += 2
            for v, n in counts.items():
                by[1][v[i]] += n * chance[v]
                by[0][v[i]] += n * (1 - chance[v])
            rates.append({c: {x: w / sum(by[c].values()) for x, w in by[c].items()} for c in by})
        for v in counts:
            odds = math.log(prior / (1 - prior)) + sum(math.log(rates[i][1][x] / rates[i][0][x]) for i, x in enumerate(v))
            chance[v] = 1 / (1 + math.exp(-max(-30, min(30, odds))))
    return chance


def _lookup(values: dict[str, float], key: Column) -> Column:
    if not values:
        return F.lit(0.0)
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in values.items() for x in pair]), key), F.lit(0.0))


def _candidates(documents: DataFrame, columns: list[str]) -> DataFrame:
    """columns, base (spans in order of kind and start) and open (the other candidates with votes and features)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    df = documents.withColumn("text", text).withColumn("_digit", F.col("text").rlike("[0-9]"))
    digit = F.col("_digit")
    may = {"email": F.contains("text", F.lit("@")), "masked": F.col("text").rlike(r"[(\[]at[)\]]"), "phone": digit & F.contains("text", F.lit("+"))}
    df = with_spans(df, "text", {k: (p, may.get(k, digit)) for k, p in PATTERNS.items()})
    every = F.flatten(F.array(*[F.col(f"spans_{k}") for k in PATTERNS]))
    judged = F.transform(every, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["stop"].alias("stop"), _valid(s).alias("valid"), _votes(s, _valid(s)).alias("votes"), _features(s).alias("features")))
    return df.select(*columns, judged.alias("judged"))


def _decided(rows: DataFrame, threshold: float) -> DataFrame:
    """rows with base and spans, from the column judged."""
    single = rows.select(F.explode("judged").alias("s")).select("s.*")
    counts = {r.votes: r.n for r in single.groupBy("votes").agg(F.count(F.lit(1)).alias("n")).collect()}  # 3**6 rows at most
    posterior = estimate(counts)
    chance = _lookup(posterior, F.col("votes"))
    weighed = single.select(F.explode("features").alias("feature"), chance.alias("chance")).groupBy("feature").agg(F.sum("chance").alias("yes"), F.sum(1 - F.col("chance")).alias("no"))
    sums = {r.feature: (r.yes, r.no) for r in weighed.collect()}  # a row for each value of a feature, under 60
    yes, no = (sum(v[i] for f, v in sums.items() if f.startswith("kind ")) for i in (0, 1))
    weight = {f: math.log((a + 1) / (yes + 12)) - math.log((b + 1) / (no + 12)) for f, (a, b) in sums.items()}
    bias = math.log((yes + 1) / (no + 1))
    final = lambda s: 1 / (1 + F.exp(-(F.lit(bias) + F.aggregate(F.transform(s["features"], lambda f: _lookup(weight, f)), F.lit(0.0), lambda a, x: a + x))))
    base = in_order(F.filter("judged", lambda s: s["valid"]), KINDS, True)
    added = F.filter("judged", lambda s: ~s["valid"] & (_lookup(posterior, s["votes"]) >= threshold) & (final(s) >= threshold))
    rows = rows.withColumn("base", base).withColumn("added", apart(in_order(added, KINDS + EXTRA, False), F.col("base")))
    return rows.withColumn("spans", in_order(F.concat("base", "added"), KINDS + EXTRA, True)).drop("judged", "added")


def find(documents: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, base and spans (lists of kind, start, stop, ...) of each row of documents."""
    narrow = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return _decided(checkpoint(_candidates(narrow, ["doc_id"])), threshold)


def summary(found: DataFrame) -> DataFrame:
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *[count(k) for k in KINDS], F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def mask(documents: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The columns of documents; each span of a text is replaced by its kind in angle brackets."""
    columns = documents.columns
    at = {c.lower(): c for c in columns}
    own = documents.toDF(*[f"own_{c}" for c in columns])
    rows = _candidates(own.withColumn("text", F.col(f"own_{at['text']}")), [f"own_{c}" for c in columns])
    spans = in_order(F.col("spans"), KINDS + EXTRA, False)
    text = F.col(f"own_{at['text']}")
    masked = replaced(text, spans, lambda s: F.concat(F.lit("<"), s["kind"], F.lit(">")))
    done = _decided(checkpoint(rows), threshold).withColumn("_masked", masked)
    return done.select(*[(F.col("_masked") if c == at["text"] else F.col(f"own_{c}")).alias(c) for c in columns])
