"""Array expressions whose cost grows with the array: values that are computed once, running sums, matches of a pattern with what stands beside them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK = 64  # a fold copies the array that it appends to, so none appends to more than a block, or a value for each block
FEW = 6  # pieces beside a match that hold its neighbours as a rule


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def blocks(every: Column, size: int = BLOCK) -> Column:
    """An array in slices of size elements; every should be computed once already."""
    first = F.filter(F.sequence(F.lit(0), F.size(every), F.lit(size)), lambda i: i < F.size(every))
    return F.transform(first, lambda i: F.slice(every, i + 1, size))


def _plus(a: Column, b: Column) -> Column:
    return a + b


def _fold(numbers: Column, of: Callable[[Column, Column], Column]) -> Column:
    none = F.expr("cast(array() as array<int>)")
    step = lambda acc, n: F.struct(of(acc["at"], n).alias("at"), F.array_append(acc["out"], acc["at"]).alias("out"))
    return F.aggregate(numbers, F.struct(F.lit(0).alias("at"), none.alias("out")), step, lambda acc: acc["out"])


def running(numbers: Column, of: Callable[[Column, Column], Column] = _plus, levels: int = 2) -> Column:
    """For each integer of an array, the sum of those before it, 0 for the first: sums within blocks, and by the same way of the blocks before them.

    of may be another associative function of integers for which 0 changes nothing, as F.greatest is of such as aren't negative.
    """
    total = lambda part: F.aggregate(part, F.lit(0), lambda a, n: of(a, n))
    shifted = lambda at, part: F.transform(_fold(part, of), lambda n: of(at, n))
    joined = lambda parts: F.flatten(F.zip_with(running(F.transform(parts, total), of, levels - 1), parts, shifted))
    return _fold(numbers, of) if levels == 0 else let(numbers, lambda every: F.when(F.size(every) <= BLOCK, _fold(every, of)).otherwise(let(blocks(every), joined)))


STRETCH = 4096


def stretches(text: Column) -> Column:
    """A text in pieces of STRETCH characters, for cut()."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{STRETCH}}}"), F.lit(0))


def cut(pieces: Column, start: Column, length: Column) -> Column:
    """length characters from start (from 0) of a text in stretches, at the cost of those and not of the whole text."""
    held = F.array_join(F.slice(pieces, F.floor(start / STRETCH).cast("int") + 1, F.floor(length / STRETCH).cast("int") + 2), "")
    return F.substring(held, start % STRETCH + 1, length)


def found(text: Column, pattern: str) -> Column:
    """The matches of a pattern, from the left; none in a text without one, or in null."""
    return F.when(text.rlike(pattern), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(F.expr("cast(array() as array<string>)"))


def ends(text: Column, pattern: str) -> Column:
    """Where the matches of a pattern end, from the left."""
    lengths = F.zip_with(F.split(text, pattern, -1), found(text, pattern), lambda p, m: F.length(p) + F.coalesce(F.length(m), F.lit(0)))
    return F.when(text.rlike(pattern), F.slice(running(F.concat(lengths, F.array(F.lit(0)))), 2, F.size(found(text, pattern)))).otherwise(F.expr("cast(array() as array<int>)"))


def in_context(text: Column, pattern: str, ahead: int, behind: int) -> Column:
    """match, before and after of each match, from the left: before and after are the characters beside it, ahead and behind at most.

    They come from the pieces between the matches: a place in a text is found by counting its characters, so that reading beside each match in
    the whole text would cost its length every time.
    """
    none = F.expr("cast(array() as array<struct<match:string,before:string,after:string>>)")

    def cell(piece: Column, match: Column) -> Column:
        whole = F.concat(piece, F.coalesce(match, F.lit("")))
        return F.struct(piece.alias("piece"), match.alias("match"), F.right(whole, F.lit(ahead)).alias("tail"), F.left(whole, F.lit(behind)).alias("head"))

    def beside(every: Column) -> Column:
        def one(own: Column, i: Column) -> Column:
            near = lambda n: F.concat(F.array_join(F.slice(every, F.greatest(i - n, F.lit(0)) + 1, F.least(i, F.lit(n)))["tail"], ""), own["piece"])
            beyond = lambda n: F.array_join(F.slice(every, i + 2, F.lit(n))["head"], "")
            enough = lambda by, size: F.when(F.length(by(FEW)) >= size, by(FEW)).otherwise(by(size))
            before = F.when(F.length(own["piece"]) >= ahead, own["piece"]).otherwise(enough(near, ahead))
            return F.struct(own["match"].alias("match"), F.right(before, F.lit(ahead)).alias("before"), F.left(enough(beyond, behind), F.lit(behind)).alias("after"))

        return F.slice(F.transform(every, one), 1, F.size(every) - 1)

    return F.when(text.rlike(pattern), let(F.zip_with(F.split(text, pattern, -1), found(text, pattern), cell), beside)).otherwise(none)
