"""Places of regular expression matches as column expressions, without Python on the executors.

Splitting a text on a pattern gives the pieces between its matches, so running lengths of pieces and matches are
the code-point offsets of all leftmost non-overlapping matches. The patterns handed in are linear: possessive, and anchored to
the start of a run, so a megabyte without a break costs no more than any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeframe.functions.arrays import blocks, cut, let, running, stretches

SPAN = "struct<kind:string,start:int,stop:int,match:string,before:string,after:string>"
BEFORE, AFTER = 40, 24


def with_spans(df: DataFrame, text: str, patterns: dict[str, tuple[str, Column]]) -> DataFrame:
    """df with a column spans_<kind> for each kind: (pattern, a cheap condition without which it can't match).

    before and after are the characters beside a match, up to the matches beside it.
    """
    none = F.lit(None).cast("array<string>")
    df = df.withColumns({f"_p_{k}": F.when(may, F.split(F.col(text), pattern, -1)).otherwise(none) for k, (pattern, may) in patterns.items()})
    df = df.withColumns({f"_m_{k}": F.when(F.size(f"_p_{k}") > 1, F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))).otherwise(none) for k, (pattern, _) in patterns.items()})

    def placed(k: str):
        pieces, found = F.col(f"_p_{k}"), F.col(f"_m_{k}")
        lengths = F.zip_with(F.slice(pieces, 1, F.size(found)), found, lambda p, m: F.length(p) + F.length(m))

        def spans(starts):
            def one(m, i):
                start = F.get(starts, i) + F.length(F.get(pieces, i))
                return F.struct(F.lit(k).alias("kind"), start.alias("start"), (start + F.length(m)).alias("stop"), m.alias("match"), F.right(F.get(pieces, i), F.lit(BEFORE)).alias("before"), F.left(F.get(pieces, i + 1), F.lit(AFTER)).alias("after"))

            return F.transform(found, one)

        return F.when(found.isNull(), F.expr(f"cast(array() as array<{SPAN}>)")).otherwise(let(running(lengths), spans))

    return df.withColumns({f"spans_{k}": placed(k) for k in patterns}).drop(*[f"_{x}_{k}" for k in patterns for x in "pm"])


def listed(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def in_order(spans: Column, kinds: list[str], kind_first: bool) -> Column:
    """Sorted by kind as listed and start, or by start and kind."""
    place = lambda s: F.array_position(F.array(*map(F.lit, kinds)), s["kind"]).cast("int")
    keyed = F.transform(spans, lambda s: F.struct(*([place(s).alias("a"), s["start"].alias("b")] if kind_first else [s["start"].alias("a"), place(s).alias("b")]), s.alias("s")))
    return F.transform(F.array_sort(keyed), lambda x: x["s"])


def apart(added: Column, base: Column) -> Column:
    """The added spans that touch no base span and no added one before them; both in order of start.

    Base spans by start and added ones by end are swept once: an added span is clear if what starts before its end doesn't end beyond its start.
    Then the clear ones are taken from the left, block by block, so that no long list is copied for each of its elements.
    """
    def swept(s: Column) -> Column:
        events = F.array_sort(F.concat(
            F.transform(s["added"], lambda x, i: F.struct(x["stop"].alias("at"), F.lit(0).alias("stop"), i.alias("place"))),
            F.transform(s["base"], lambda b: F.struct(b["start"].alias("at"), b["stop"].alias("stop"), F.lit(-1).alias("place"))),
        ))
        reach = lambda es: F.zip_with(es, running(F.transform(es, lambda e: e["stop"]), F.greatest), lambda e, until: F.struct(e["place"].alias("place"), until.alias("until")))
        clear = lambda es: F.filter(reach(es), lambda e: (e["place"] >= 0) & (F.get(s["added"], e["place"])["start"] >= e["until"]))
        return F.transform(F.array_sort(F.transform(let(events, clear), lambda e: e["place"])), lambda i: F.get(s["added"], i))

    def taken(clear: Column) -> Column:
        none = F.filter(clear, lambda s: F.lit(False))
        step = lambda a, s: F.when(s["start"] >= a["until"], F.struct(s["stop"].alias("until"), F.array_append(a["out"], s).alias("out"))).otherwise(a)
        of_block = lambda until, part: F.aggregate(part, F.struct(until.alias("until"), none.alias("out")), step)
        joined = lambda a, done: F.struct(done["until"].alias("until"), F.array_append(a["out"], done["out"]).alias("out"))
        return F.flatten(F.aggregate(blocks(clear), F.struct(F.lit(0).alias("until"), F.array(none).alias("out")), lambda a, part: let(of_block(a["until"], part), lambda done: joined(a, done)), lambda a: a["out"]))

    return F.when(F.size(added) == 0, added).otherwise(let(let(F.struct(added.alias("added"), base.alias("base")), swept), taken))


def replaced(text: Column, spans: Column, by) -> Column:
    """text with by(span) in the place of each span, spans being in order of start; of spans that touch, the first one's."""

    def joined(s: Column) -> Column:
        pieces = F.zip_with(s["spans"], s["until"], lambda x, until: F.when(x["start"] >= until, F.concat(cut(s["text"], until, x["start"] - until), by(x))).otherwise(""))
        end = F.array_max(F.transform(s["spans"], lambda x: x["stop"]))
        return F.concat(F.array_join(pieces, ""), cut(s["text"], end, F.greatest(s["size"] - end, F.lit(0))))

    parts = lambda spans: F.struct(stretches(text).alias("text"), F.length(text).alias("size"), spans.alias("spans"), running(F.transform(spans, lambda x: x["stop"]), F.greatest).alias("until"))
    return F.when(F.size(spans) == 0, text).otherwise(let(let(spans, parts), joined))
