"""Secrets by a battery of randomness tests with false-discovery control, with DataFrame operations only.

Base spans (assign, access, hex) are leftmost non-overlapping matches that pass their rule; they always stay. Further
candidates are runs of 16 or more token characters that hold a letter and a digit, or letters of both cases. The encoding of
each is inferred from its characters, which fixes an alphabet. Three tests ask whether it could be uniformly random there:
chi-squared uniformity of its characters, the number of runs above and below the middle of the alphabet, and the serial
correlation of neighbours; Fisher's method joins their p-values, and below `BATTERY` a candidate is out.

A false discovery is an ordinary token taken for a secret, so that is the null hypothesis of the control: characters as frequent as in the text around
candidates (ordinary), nine digits to a letter (numbers and ids), or neighbours that repeat or follow one another (counters and
fillers). The likelihood of uniform characters over the largest of these is an e-value: under each null its mean is 1 at most.
It grows with the token's length, so a short token needs more evidence for its size and a long one has it. Candidates are added, as kind random, by the
e-value form of the Benjamini-Hochberg rule over all candidates, which holds the false-discovery rate to `rate` however
tokens depend on each other.

The control needs only the counts of 66 characters and of e-values by bin (at most 242 rows, whatever the input).

Defined cases: a null text is empty; empty texts have no spans; a null doc_id is kept as it is; rows that repeat are
read each; added spans that touch a base span or an earlier added one are dropped; an empty table gives no row;
other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeframe.llm.spanning import apart, in_order, listed, with_spans
from lodeframe.llm.store import checkpoint

KINDS = ["assign", "access", "hex"]
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?+key))["']?+\x20*+[:=]\x20*+["']?+([A-Za-z0-9+/_.=-]++)"""
PATTERNS = {
    "assign": ASSIGN,
    "access": r"AKIA[A-Z0-9]++",
    "hex": r"(?<![0-9a-f])[0-9a-f]{16,}+",
    "random": r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+={0,2}+",
}
# fixed values: the alphabets of the encodings, in the order in which they are tried
ALPHABETS = {
    "hex": "0123456789abcdef",
    "HEX": "0123456789ABCDEF",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789",
    "lower": "abcdefghijklmnopqrstuvwxyz0123456789",
    "mixed": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_",
}
RATE, BATTERY, BINS = 0.05, 0.01, 240
DIGITS = 0.9  # the share of digits in numbers and ids
EVERY = ALPHABETS["base64"]


def _tail(z: Column) -> Column:
    """The upper tail of the normal distribution, to 2e-4."""
    z = F.greatest(F.lit(-9.0), F.least(F.lit(9.0), z))
    return 1 / (1 + F.exp(1.5976 * z + 0.070565992 * z * z * z))


def _let(value: Column, use) -> Column:
    """use(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _letters(text: Column) -> Column:
    return F.filter(F.split(text, "", -1), lambda c: c != "")


def _sum(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)


def _battery(of: Column, places: Column, counts: Column, n: Column, k: Column, mean: Column) -> Column:
    """The encoding of a token and the joint p-value, from the places of its characters in an alphabet of k."""
    df = k - 1
    chi = k / n * _sum(F.transform(counts, lambda c: c * c)) - n
    uniform = _tail((F.pow(F.greatest(chi, F.lit(0.0)) / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df)))

    before, after = F.slice(places, 1, F.size(places) - 1), F.slice(places, 2, F.size(places) - 1)
    high = lambda x: 2 * x > k + 1
    runs = 1.0 + F.size(F.filter(F.zip_with(before, after, lambda a, b: high(a) != high(b)), lambda x: x))
    above = F.size(F.filter(places, high)).cast("double")
    expected = 2 * above * (n - above) / n + 1
    spread = (expected - 1) * (expected - 2) / (n - 1)
    run = F.when(spread > 0, F.abs(runs - expected) / F.sqrt(spread)).otherwise(9.0)

    square = _sum(F.transform(places, lambda x: (x - mean) * (x - mean)))
    product = _sum(F.zip_with(before, after, lambda a, b: (a - mean) * (b - mean)))
    serial = F.when(square > 0, F.abs(product / square + 1 / n) * F.sqrt(n)).otherwise(9.0)

    two_sided = lambda z: F.least(F.lit(1.0), 2 * _tail(z))
    joint = lambda x: F.exp(-x) * (1 + x + x * x / 2)
    p = _let(-F.log(uniform) - F.log(two_sided(run)) - F.log(two_sided(serial)), joint)
    return F.struct(of.alias("of"), p.alias("p"))


def p_value(token: Column) -> Column:
    """of, the encoding of a token, and p, the joint p-value of its three tests."""
    encoding = lambda body: F.coalesce(*[F.when(body.rlike(f"^[{letters}]+$"), name) for name, letters in list(ALPHABETS.items())[:-1]], F.lit("base64"))
    alphabets = F.create_map(*[F.lit(x) for pair in ALPHABETS.items() for x in pair])
    named = lambda body: F.struct(_letters(body).alias("chars"), encoding(body).alias("of"))
    lettered = lambda s: F.struct(s["chars"].alias("chars"), s["of"].alias("of"), F.element_at(alphabets, s["of"]).alias("alphabet"))
    placed = lambda s: F.struct(
        s["of"].alias("of"),
        F.transform(s["chars"], lambda c: F.position(c, s["alphabet"]).cast("double")).alias("places"),
        F.transform(_letters(s["alphabet"]), lambda c: F.size(F.filter(s["chars"], lambda x: x == c)).cast("double")).alias("counts"),
        F.size(s["chars"]).cast("double").alias("n"),
        F.length(s["alphabet"]).cast("double").alias("k"),
    )
    centred = lambda s: F.struct(*[s[x].alias(x) for x in ("of", "places", "counts", "n", "k")], (_sum(s["places"]) / s["n"]).alias("mean"))
    judged = lambda s: _battery(*[s[x] for x in ("of", "places", "counts", "n", "k", "mean")])
    found = F.regexp_replace(token, "=+$", "")
    for step in (named, lettered, placed, centred, judged):
        found = _let(found, step)
    return found


def null_weights(counts: dict[str, int]) -> dict[str, tuple[list[float], list[float]]]:
    """For each encoding: the logarithms of its uniform likelihood over that of ordinary text, and over that of ids, by character.

    counts are of the characters of ordinary text; one is added to each. An alphabet of one case takes the letters of both.
    """
    found = {}
    for of, letters in ALPHABETS.items():
        both = letters.upper() != letters and letters.lower() != letters
        seen = [1 + sum(counts.get(x, 0) for x in ({c} if both else {c.lower(), c.upper()})) for c in letters]
        share = [n / sum(seen) for n in seen]
        rest = sum(x for c, x in zip(letters, share, strict=True) if not c.isdigit())
        figures = sum(map(str.isdigit, letters))
        of_id = [DIGITS / figures if c.isdigit() else (1 - DIGITS) * x / rest for c, x in zip(letters, share, strict=True)]
        found[of] = tuple([-math.log(len(letters) * x) for x in null] for null in (share, of_id))
    return found


def _evidence(token: Column, of: Column, weights: dict[str, tuple[list[float], list[float]]]) -> Column:
    """The logarithm (base 2) of a token's e-value: the least over the nulls."""
    tables = F.create_map(*[x for name, (text, ids) in weights.items() for x in (F.lit(name), F.struct(F.lit(ALPHABETS[name]).alias("letters"), F.array(*map(F.lit, text)).alias("text"), F.array(*map(F.lit, ids)).alias("ids")))])

    def least(s: Column) -> Column:
        places, own = s["places"], s["own"]
        by = [_sum(F.transform(places, lambda p: F.element_at(own["text"], p))), _sum(F.transform(places, lambda p: F.element_at(own["ids"], p)))]
        return F.least(*by, _chained(places, F.length(own["letters"]).cast("double")))

    placed = lambda own: F.struct(F.transform(_letters(F.regexp_replace(token, "=+$", "")), lambda c: F.position(c, own["letters"])).alias("places"), own.alias("own"))
    return _let(_let(F.element_at(tables, of), placed), least) / math.log(2)


def _chained(places: Column, k: Column) -> Column:
    """Against neighbours that repeat or follow one another in the alphabet half of the time."""
    pairs = F.zip_with(F.slice(places, 1, F.size(places) - 1), F.slice(places, 2, F.size(places) - 1), lambda a, b: F.abs(a - b) <= 1)
    near = F.size(F.filter(pairs, lambda x: x)).cast("double")
    return (F.size(pairs) - near) * math.log(2) - near * F.log(k / 6 + 0.5)


def _rows(documents: DataFrame) -> DataFrame:
    """doc_id, base spans in order of start, and tested: the other candidates that stand the battery, and the text around all of them."""
    df = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    low = F.lower("text")
    may = {"assign": low.rlike("passw|secret|token|api_?key"), "access": F.contains("text", F.lit("AKIA")), "hex": F.col("text").rlike("[0-9a-f]{16}"), "random": F.col("text").rlike("[A-Za-z0-9+/_-]{16}")}
    df = with_spans(df, "text", {k: (p, may[k]) for k, p in PATTERNS.items()})
    good = lambda s: F.when(s["kind"] == "assign", F.length(F.regexp_extract(s["match"], ASSIGN, 2)) >= 12).when(s["kind"] == "access", F.length(s["match"]) >= 18).otherwise(True)
    base = F.filter(F.flatten(F.array(*[F.col(f"spans_{k}") for k in KINDS])), good)
    random = F.filter("spans_random", lambda s: s["match"].rlike("[A-Za-z]") & (s["match"].rlike("[0-9]") | s["match"].rlike("[a-z]") & s["match"].rlike("[A-Z]")))
    tested = F.transform(random, lambda s: _let(p_value(s["match"]), lambda r: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["stop"].alias("stop"), s["match"].alias("match"), r["of"].alias("of"), (r["p"] >= BATTERY).alias("stands"))))
    around = F.array_join(F.transform(random, lambda s: F.concat(s["before"], F.lit(" "), s["after"])), " ")
    plain = lambda spans: F.transform(spans, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["stop"].alias("stop")))
    return df.select("doc_id", in_order(plain(base), KINDS, False).alias("base"), tested.alias("tested"), around.alias("around"))


def least_bin(counts: dict[int, int], rate: float = RATE) -> int:
    """The least bin (whole log2 of the e-value) whose candidates are added: n / (rate * k) is reached by the k candidates from it on.

    counts hold all candidates, those that the battery rejects below any bin that could be reached.
    """
    total, seen, least = sum(counts.values()), 0, BINS + 1
    for size in sorted(counts, reverse=True):
        seen += counts[size]
        if size + math.log2(seen) >= math.log2(total / rate):
            least = size
    return least


def find(documents: DataFrame, rate: float = RATE) -> DataFrame:
    """doc_id, base and spans (lists of kind, start, stop) of each row of documents."""
    rows = checkpoint(_rows(documents))
    letters = rows.filter("around != ''").select(F.explode(F.filter(F.split("around", ""), lambda c: F.instr(F.lit(EVERY), c) > 0)).alias("c"))
    weights = null_weights({r["c"]: r["n"] for r in letters.groupBy("c").agg(F.count(F.lit(1)).alias("n")).collect() if r["c"]})  # a row for each of 66 characters
    size = lambda s: F.when(s["stands"], F.least(F.lit(BINS), F.greatest(F.lit(-1), F.floor(_evidence(s["match"], s["of"], weights)).cast("int")))).otherwise(F.lit(-1))
    binned = F.transform("tested", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["stop"].alias("stop"), size(s).alias("bin")))
    rows = checkpoint(rows.select("doc_id", "base", binned.alias("binned")))
    counts = rows.select(F.explode("binned").alias("s")).groupBy("s.bin").agg(F.count(F.lit(1)).alias("n")).collect()
    limit = least_bin({r["bin"]: r["n"] for r in counts}, rate)
    random = F.transform(F.filter("binned", lambda s: s["bin"] >= limit), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["stop"].alias("stop")))
    return rows.select("doc_id", "base", in_order(F.concat("base", apart(random, F.col("base"))), [*KINDS, "random"], False).alias("spans"))


def summary(found: DataFrame) -> DataFrame:
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *[count(k) for k in KINDS], F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
