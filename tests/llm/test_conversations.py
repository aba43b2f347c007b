"""Conversation repair against an exhaustive search, in blocks of a few rows, and on odd tables."""

import hashlib
import random
import re
import zlib

import pytest
from fixtures import SCHEMA as _  # noqa: F401  (the folder is on the path)

from lodeframe.llm import conversations as C
from lodeframe.llm import queries

SCHEMA = "conv_id long, turn long, role string, text string, cost long, audit string, conv string, digest string"
WORD = re.compile(r"[^\x20\x09-\x0D]")


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        show = lambda x: " " if x is None else str(x)
        lot = zlib.crc32(f"{show(conv)}:{show(turn)}".encode()) % 20
        role, text = show(role), show(text)
        if lot == 0:
            continue
        text = "" if lot == 1 else re.sub("[.!?]", "", text) if lot == 2 else text
        out += [(conv, turn, "user" if lot == 4 else role, text)] * (2 if lot == 3 else 1)
    return out


def expected(rows):
    """Of one conversation's rows after damage: the search keeps every state's best path whole."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), hashlib.sha256(r[3].encode()).digest()))
    seen, faults = set(), []
    for r in rows:
        visible = WORD.findall(r[3])
        faults.append("blank" if not visible else "duplicate" if r[2:] in seen else "truncated" if visible[-1] not in ".!?" else None)
        seen.add(r[2:])
    pairs = [a[2][:1] + b[2][:1] for a, b in zip(rows, rows[1:])]
    turns = [r[1] for r in rows if r[1] is not None]
    allowed = {"": "su", "s": "u", "u": "a", "a": "u"}
    name = {"u": "user", "a": "assistant"}

    def with_inserts(states):
        todo = list(states.items())
        while todo:
            state, (cost, labels, out) = todo.pop()
            for new in set(allowed[state]) & set("ua"):
                way = (cost + 3, labels + "I", out + [(name[new], "")])
                if new not in states or way[:2] < states[new][:2]:
                    states[new] = way
                    todo.append((new, way))
        return states

    states = with_inserts({"": (0, "", [])})
    for r, fault in zip(rows, faults):
        then = {}

        def offer(state, way):
            if state not in then or way[:2] < then[state][:2]:
                then[state] = way

        late = 3 if fault == "truncated" else 0
        for state, (cost, labels, out) in states.items():
            offer(state, (cost + 4, labels + "D", out))
            if fault not in ("blank", "duplicate"):
                if r[2][:1] and r[2][0] in allowed[state]:
                    offer(r[2][0], (cost + late, labels + "K", out + [r[2:]]))
                for new in set(allowed[state]) & set("ua"):
                    offer(new, (cost + 3 + late, labels + "R", out + [(name[new], r[3])]))
        states = with_inserts(then)
    cost, labels, out = min((states[s] for s in ("", "a") if s in states), key=lambda way: way[:2])
    text = "\n".join(f"{role}:{body}" for role, body in out)
    return (
        max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"),
        sum(p not in ("su", "ua", "au") for p in pairs), cost, labels, hashlib.sha256(text.encode()).hexdigest(),
    )


def by_conversation(rows):
    out = {}
    for r in damage(rows):
        out.setdefault(r[0], []).append(r)
    return {conv: expected(out.get(conv, [])) for conv in {r[0] for r in rows}}


def found(table):
    return {r[0]: tuple(r[1:]) for r in C.audit(*C.damaged(table)).collect()}


def invented(seed, conversations, most):
    r = random.Random(seed)
    rows = []
    for conv in range(conversations):
        for turn in range(r.randint(1, most)):
            role = r.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None])
            text = r.choice(["a.", "b", "c!", " ", "", "d?\n ", "é… ", "x.y", None, f"t{r.randint(0, 9)}."])
            rows.append((conv, r.choice([turn, turn, turn, turn + 1, None]), role, text))
            if r.random() < 0.1:
                rows.append(rows[-1])
    return rows + [(None, None, "user", "hi."), (None, 1, "assistant", "yes.")]


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, "KD", "x", "y") for r in rows], SCHEMA).repartition(3)


def test_small_conversations_match_the_search(spark):
    rows = invented(1, 400, 7)
    assert found(table(spark, rows)) == by_conversation(rows)


@pytest.mark.parametrize("size", [1, 2, 3])
def test_blocks_of_a_few_rows_give_the_same(size):
    r = random.Random(size)
    for _ in range(300):
        rows = [(0, k, role, text) for k in range(r.randint(0, 9)) for role, text in [(r.choice(["s", "u", "a", "q"]), r.choice(["", "t", "t.", f"{k}."]))]]
        rows.sort(key=lambda x: (x[1], x[2].encode(), hashlib.sha256(x[3].encode()).digest()))
        seen, facts = set(), []
        for _, turn, role, text in rows:
            facts.append({"conv": "0", "known": True, "at": turn, "role": role, "digest": b"", "initial": role, "copies": 1, "blank": not text, "late": text[-1:] not in ".!?", "first": (role, text) not in seen})
            seen.add((role, text))
        blocks = [C._block(facts[k : k + size]) for k in range(0, len(facts), size)]
        got = C._joined(iter(blocks[::-1]))
        want = expected(rows)
        assert tuple(got[k] for k in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")) == want[:-1]


def test_a_conversation_over_many_blocks_and_tasks(spark, monkeypatch):
    r = random.Random(5)
    rows = [(7, k, r.choice(["user", "assistant", "system"]), r.choice([f"t{k}.", f"t{k}", "same."])) for k in range(6000)] + [(8, 0, "user", "hi."), (8, 1, "assistant", "yes.")]
    partitions = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled", "true")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert found(table(spark, rows)) == by_conversation(rows)
        blocks = C._blocks(C._narrow(C.damaged(table(spark, rows))[0]))
        assert blocks.filter("conv = '7'").count() > 6  # no block has more than a bounded number of rows
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", partitions)


def test_rows_that_repeat_are_counted_before_they_are_sorted(spark):
    rows = [(1, 2, "user", "again.")] * 5000 + [(1, 3, "assistant", "yes."), (1, 1, "system", "be kind.")]
    assert found(table(spark, rows)) == by_conversation(rows)
    assert C._narrow(C.damaged(table(spark, rows))[0]).count() <= 3


def test_repaired_turns_hash_to_the_audit(spark):
    rows = invented(3, 60, 6)
    source = C.rows_of(table(spark, rows))
    turns = {}
    for t in sorted(C.repaired(source).collect(), key=lambda t: t.place):
        turns.setdefault(t.conv_id, []).append(f"{t.role}:{t.text}")
    for r in C.audit(source).collect():
        assert hashlib.sha256("\n".join(turns.get(r.conv_id, [])).encode()).hexdigest() == r.repaired_sha256
        assert re.fullmatch("(s?(ua)+)?", "".join(t[0] for t in turns.get(r.conv_id, [])))


def test_empty_table(spark):
    assert C.audit(*C.damaged(spark.createDataFrame([], SCHEMA))).collect() == []
    assert C.repaired(C.rows_of(spark.createDataFrame([], SCHEMA))).collect() == []


def test_whole_table(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert {r[0]: tuple(r[1:]) for r in queries.op12_conversation_repair(spark, sf).collect()} == by_conversation(rows)
