"""Repair of conversation structure: the cheapest edits that make the roles of a conversation a sentence of the role grammar.

Three weighted automata are composed lazily: the input acceptor (a conversation's rows in order), the edit transducer (keep, rerole, delete, insert) and the
acceptor of `(s?(ua)+)?`. The shortest path is taken in topological order over lexicographic weights (cost, string of labels).

A conversation may hold any share of all rows. Its rows are sorted by range over all tasks, and each run of them becomes a block: the best path between any two
grammar states. Blocks are joined from the last to the first, which a task does for one of a thousand rows. Only the hash of a repaired conversation,
which SHA-256 defines as one sequence, reads its rows one after another, as a stream.

Inserts are taken before the row they precede, so two strings of one block never are the beginning of each other, and their order holds whatever follows.

Defined cases: nulls in id, turn, role and text read as one space (a null turn sorts first and doesn't count for gaps); a role without a first character, or of another
initial, can't be kept; rows of one turn are ordered by role and by the SHA-256 of their text; repeated rows are duplicates, counted before they are sorted;
an empty table gives an empty one. Columns beside the four are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeframe.llm.store import bounded_batches

SPACES = " \t\n\x0b\f\r"
START, SYSTEM, USER, ASSISTANT = range(4)
GRAMMAR = {START: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": ASSISTANT}, ASSISTANT: {"u": USER}}
ACCEPTED = {START: (0, 0, ""), SYSTEM: (6, 2, "II"), USER: (3, 1, "I"), ASSISTANT: (0, 0, "")}  # what ends a conversation from each state: cost, rank, label
KEEP, REROLE, DELETE, INSERT, LATE = 0, 3, 4, 3, 3
BLOCK = 1024
KEY = ["conv", "known", "at", "role", "digest"]
BLOCKS = """conv string, known boolean, at long, role binary, digest binary, least long, most long, turns long, blank long, duplicate long, truncated long, illegal long,
    head string, tail string, costs array<long>, labels array<string>"""
AUDIT = "conv string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
RESULT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
TURNS = "conv_id long, place long, turn long, role string, text string, edit string"


def _text(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(" "))


def rows_of(conversations: DataFrame) -> DataFrame:
    """The rows of a table of conversations as the repair reads them, one copy of each."""
    return conversations.select(
        _text("conv_id").alias("conv"), F.col("turn").isNotNull().alias("known"), F.coalesce(F.col("turn").cast("long"), F.lit(0)).alias("at"), _text("role").alias("role"), _text("text").alias("text"), F.lit(1).cast("long").alias("copies")
    )


def damaged(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows after the contract's damage, and all ids of conversations."""
    rows = rows_of(conversations)
    ids = rows.select("conv").distinct()
    lot = F.pmod(F.crc32(F.concat("conv", F.lit(":"), F.when(F.col("known"), F.col("at").cast("string")).otherwise(F.lit(" ")))), F.lit(20))
    rows = rows.withColumn("lot", lot).filter("lot <> 0")
    text = F.when(F.col("lot") == 1, F.lit("")).when(F.col("lot") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return rows.withColumns({"text": text, "role": F.when(F.col("lot") == 4, F.lit("user")).otherwise(F.col("role")), "copies": F.when(F.col("lot") == 3, F.col("copies") * 2).otherwise(F.col("copies"))}).drop("lot"), ids


def _arcs(symbol: str, state: int, inserted: int) -> Iterator[tuple[str, int, int, bool]]:
    """The composition's arcs at one row: label, cost, next grammar state, and whether the row is read. symbol: the role's initial, an upper case one if late, or x."""
    allowed = GRAMMAR[state]
    if inserted < 2:  # two take the grammar from any state to any other that more could reach
        yield from (("I", INSERT, allowed[out], False) for out in "ua" if out in allowed)
    yield "D", DELETE, state, True
    if symbol != "x":
        late = LATE if symbol.isupper() else 0
        if symbol.lower() in allowed:
            yield "K", KEEP + late, allowed[symbol.lower()], True
        yield from (("R", REROLE + late, allowed[out], True) for out in "ua" if out in allowed)


@lru_cache(1 << 14)
def _step(symbol: str, layer: tuple) -> tuple[tuple, int, tuple]:
    """From the best paths after a row to those before it. layer: (cost, rank of the string) of each grammar state, or None.

    Gives the new layer with its least cost taken off, that cost, and for each state the label of its path and the state after the row.
    """
    best: dict = {}
    for inserted in (2, 1, 0):
        for state in GRAMMAR:
            ways = []
            for label, cost, then, read in _arcs(symbol, state, inserted):
                tail = (layer[then] and (layer[then][0], "", layer[then][1], then)) if read else best.get((then, inserted + 1))
                if tail:
                    ways.append((cost + tail[0], label + tail[1], tail[2], tail[3]))
            if ways:
                best[state, inserted] = min(ways)
    here = [best.get((state, 0)) for state in GRAMMAR]
    order = sorted({x[1:3] for x in here if x})
    base = min((x[0] for x in here if x), default=0)
    return tuple(x and (x[0] - base, order.index(x[1:3])) for x in here), base, tuple(x and (x[1], x[3]) for x in here)


def _best_paths(symbols: list[tuple[str, int]]) -> tuple[list[int | None], list[str | None]]:
    """Cost and string of the best path from each grammar state to each, by 4 * first + last; None where there is none. A symbol x may stand for many rows."""
    costs, strings = [None] * 16, [None] * 16
    for last in GRAMMAR:
        layer = tuple((0, 0) if state == last else None for state in GRAMMAR)
        total, steps = 0, []
        for symbol, times in reversed(symbols):
            layer, base, choices = _step(symbol, layer)
            total += base + DELETE * (times - 1)
            steps.append((choices, times))
        for first in GRAMMAR:
            if layer[first] is not None:
                state, labels = first, []
                for choices, times in reversed(steps):
                    label, state = choices[state]
                    labels.append(label + label[-1] * (times - 1))
                costs[4 * first + last], strings[4 * first + last] = total + layer[first][0], "".join(labels)
    return costs, strings


def _block(rows: list[dict]) -> dict:
    """What a run of one conversation's rows, in order, tells of itself."""
    symbols: list[tuple[str, int]] = []
    out = dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "turns"), 0) | {"least": None, "most": None}
    tail = None
    for r in rows:
        initial, n = r["initial"], r["copies"]
        real = r["first"] and not r["blank"]
        out["blank"] += n if r["blank"] else 0
        out["duplicate"] += 0 if r["blank"] else n - real
        out["truncated"] += real and r["late"]
        out["illegal"] += (tail is not None and tail + initial not in ("su", "ua", "au")) + n - 1
        if r["known"] and out["most"] != r["at"]:
            out["least"], out["most"], out["turns"] = r["at"] if out["least"] is None else out["least"], r["at"], out["turns"] + 1
        tail = initial
        symbol = initial if initial in ("s", "u", "a") else "o"
        if real:
            symbols.append((symbol.upper() if r["late"] else symbol, 1))
        if n > real:
            symbols.append(("x", n - real))
    costs, labels = _best_paths(symbols)
    return {k: rows[0][k] for k in KEY} | out | {"head": rows[0]["initial"], "tail": tail, "costs": costs, "labels": labels}


def _arrow(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema)


def _dicts(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        yield from batch.to_pylist()


def _in_arrow(schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(schema))


def _emitted(rows: Iterator[dict], schema: pa.Schema, size: int) -> Iterator[pa.RecordBatch]:
    held = []
    for r in rows:
        held.append(r)
        if len(held) == size:
            yield _arrow(held, schema)
            held = []
    if held:
        yield _arrow(held, schema)


def _blocks(narrow: DataFrame) -> DataFrame:
    """The blocks of all conversations: rows are sorted by range, so a large one lies in several tasks."""
    schema = _in_arrow(BLOCKS)

    def summarise(batches):
        def runs():
            for _, rows in groupby(_dicts(batches), key=lambda r: r["conv"]):
                held = []
                for r in rows:
                    held.append(r)
                    if len(held) == BLOCK:
                        yield _block(held)
                        held = []
                if held:
                    yield _block(held)

        return _emitted(runs(), schema, 256)

    return narrow.repartitionByRange(*KEY).sortWithinPartitions(*KEY).mapInArrow(summarise, BLOCKS)


def _joined(blocks: Iterator[dict]) -> dict:
    """The figures and the audit of one conversation from its blocks, the last one first. Strings are chained, so memory is that of the paths that still can win."""
    ahead = {state: (cost, rank, (label, None)) for state, (cost, rank, label) in ACCEPTED.items()}
    sums = dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "turns"), 0)
    head = least = most = None
    for b in blocks:
        for k in sums:
            sums[k] += b[k]
        if head is not None:
            sums["illegal"] += b["tail"] + head not in ("su", "ua", "au")
        head = b["head"]
        if b["least"] is not None:
            sums["turns"] -= b["most"] == least
            least, most = b["least"], b["most"] if most is None else most
        found = {}
        for state in GRAMMAR:
            ways = [(b["costs"][4 * state + then] + cost, b["labels"][4 * state + then], rank, then) for then, (cost, rank, _) in ahead.items() if b["costs"][4 * state + then] is not None]
            if ways:
                found[state] = min(ways)
        order = {key: k for k, key in enumerate(sorted({x[1:3] for x in found.values()}))}
        ahead = {state: (x[0], order[x[1:3]], (x[1], ahead[x[3]][2])) for state, x in found.items()}
    cost, _, chain = ahead[START]
    labels = []
    while chain:
        labels.append(chain[0])
        chain = chain[1]
    gaps = 0 if least is None else most - least + 1 - sums["turns"]
    return {"gaps": gaps, **{k: sums[k] for k in ("blank", "duplicate", "truncated", "illegal")}, "cost": cost, "audit": "".join(labels)}


def _narrow(rows: DataFrame) -> DataFrame:
    """A row for each different row without its text: how many there are, whether it is the first of its role and text, and what is wrong with it.

    Groups and join keys are those of different rows, so a row that repeats, or a text that many turns have, is summed before it is shuffled.
    """
    bare = F.rtrim("text", F.lit(SPACES))
    facts = rows.select(
        "conv", "known", "at", F.encode("role", "UTF-8").alias("role"), F.unhex(F.sha2("text", 256)).alias("digest"), "copies", F.left("role", F.lit(1)).alias("initial"),
        (F.length(bare) == 0).alias("blank"), (~F.right(bare, F.lit(1)).isin(".", "!", "?")).alias("late"),
    )
    counted = facts.groupBy(*KEY).agg(F.sum("copies").alias("copies"), F.first("initial").alias("initial"), F.first("blank").alias("blank"), F.first("late").alias("late"))
    firsts = counted.groupBy("conv", "role", "digest").agg(F.min(F.struct("known", "at")).alias("_first")).select("conv", "_first.known", "_first.at", "role", "digest", F.lit(True).alias("first"))
    return counted.join(firsts, KEY, "left").withColumn("first", F.coalesce("first", F.lit(False)))


def _with_audits(rows: DataFrame, ids: DataFrame | None, stream, schema: str) -> DataFrame:
    """stream over each conversation's audit and then its rows in order; a conversation without rows has its audit alone."""
    bounded_batches(rows.sparkSession)
    ids = rows.select("conv").distinct() if ids is None else ids
    arrow = _in_arrow(AUDIT)
    blocks = _blocks(_narrow(rows)).unionByName(ids, allowMissingColumns=True)

    def fold(batches):
        found = groupby(_dicts(batches), key=lambda r: r["conv"])
        return _emitted(({"conv": conv} | _joined(b for b in of if b["costs"] is not None) for conv, of in found), arrow, 256)

    last_first = [F.col(k).desc() for k in KEY[1:]]
    audits = blocks.repartition("conv").sortWithinPartitions("conv", *last_first).mapInArrow(fold, AUDIT)
    texts = rows.select("conv", "known", "at", "role", F.encode("role", "UTF-8").alias("key"), F.unhex(F.sha2("text", 256)).alias("digest"), "text", "copies")
    both = audits.unionByName(texts, allowMissingColumns=True)
    return both.repartition("conv").sortWithinPartitions("conv", F.col("cost").isNull(), "known", "at", "key", "digest").mapInArrow(stream, schema)


class _Repair:
    """Reads an audit along a conversation's rows and gives the repaired turns."""

    def __init__(self, audit: str):
        self.audit, self.at, self.place = audit, 0, 0
        self.led = (len(audit) - audit.count("D")) % 2  # 1 if a system turn leads

    def _turn(self, edit: str, row: dict | None) -> tuple[str, str, str]:
        role = row["role"] if edit == "K" else "user" if (self.place - self.led) % 2 == 0 else "assistant"
        self.place += 1
        return role, row["text"] if row else "", edit

    def inserted(self) -> Iterator[tuple[str, str, str]]:
        while self.audit[self.at : self.at + 1] == "I":
            self.at += 1
            yield self._turn("I", None)

    def turns(self, row: dict) -> Iterator[tuple[str, str, str]]:
        for _ in range(row["copies"]):
            yield from self.inserted()
            edit = self.audit[self.at]
            self.at += 1
            if edit != "D":
                yield self._turn(edit, row)


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, Iterator[tuple[dict | None, tuple]]]]:
    """Each conversation's audit, with its repaired turns as a stream."""
    for _, rows in groupby(_dicts(batches), key=lambda r: r["conv"]):
        audit = next(rows)
        repair = _Repair(audit["audit"])

        def turns(rows=rows, repair=repair):
            for row in rows:
                for turn in repair.turns(row):
                    yield row, turn
            for turn in repair.inserted():
                yield None, turn

        yield audit, turns()


def _id(conv: str) -> int | None:
    return None if conv == " " else int(conv)


def audit(rows: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """Per conversation: conv_id, its faults, the cost and labels of the cheapest edits, and the hash of the repaired conversation.

    rows are those of rows_of() or damaged(); ids names conversations that may have lost all rows.
    """
    arrow = _in_arrow(RESULT)

    def hashed(batches):
        def results():
            for found, turns in _conversations(batches):
                digest = hashlib.sha256()
                for k, (_, (role, text, _)) in enumerate(turns):
                    digest.update(f"{chr(10) * (k > 0)}{role}:{text}".encode())
                yield {"conv_id": _id(found["conv"]), **{k: found[k] for k in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")}, "repaired_sha256": digest.hexdigest()}

        return _emitted(results(), arrow, 256)

    return _with_audits(rows, ids, hashed, RESULT)


def repaired(rows: DataFrame) -> DataFrame:
    """The turns of the repaired conversations: conv_id, place, the turn they were (null if inserted), role, text, and the edit that made them."""
    arrow = _in_arrow(TURNS)

    def turned(batches):
        def results():
            for found, turns in _conversations(batches):
                for place, (row, (role, text, edit)) in enumerate(turns):
                    yield {"conv_id": _id(found["conv"]), "place": place, "turn": row["at"] if row and row["known"] and edit != "I" else None, "role": role, "text": text, "edit": edit}

        return _emitted(results(), arrow, 64)

    return _with_audits(rows, None, turned, TURNS)
