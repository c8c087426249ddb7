"""Conversation repair against a brute-force search over all edits."""

import hashlib
import itertools
import random
import re
import zlib
from functools import cache

import pytest

from skein.llm import conversations as C
from skein.llm.common import Scratch

AFTER = {"": "su", "s": "u", "u": "a", "a": "u"}
SCHEMA = "conv_id long, turn long, role string, text string, key string, pos int, chunk int, symbol int, copies int, edits string"


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if role is None else role), (" " if text is None else text)
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 4:
            role = "user"
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def brute(rows):
    """Of one conversation: its report and its repaired rows."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
    seen, faults = set(), []
    for _, _, role, text in rows:
        solid = text.rstrip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else "")
        seen.add((role, text))

    @cache
    def best(i, state, more):
        """(cost, audit, rows left) from row i on in a state; ``more`` insertions may precede row i."""
        ways = []
        if more:
            for to in AFTER[state].replace("s", ""):
                c, a, left = best(i, to, more - 1)
                ways.append((c + 2, "I" + a, ((to, ""), *left)))
        if i == len(rows):
            if state in ("", "a"):
                ways.append((0, "", ()))
        else:
            _, _, role, text = rows[i]
            c, a, left = best(i + 1, state, 3)
            ways.append((c + 3, "D" + a, left))
            if faults[i] not in ("blank", "duplicate"):
                extra = faults[i] == "truncated"
                for to in AFTER[state]:
                    c, a, left = best(i + 1, to, 3)
                    if role[:1] == to:
                        ways.append((c + extra, "K" + a, ((role, text), *left)))
                    if to != "s":
                        ways.append((c + 2 + extra, "R" + a, ((to, text), *left)))
        return min(ways, key=lambda w: w[:2], default=(10**9, "", ()))

    cost, audit, left = best(0, "", 3)
    named = [({"u": "user", "a": "assistant"}.get(r, r), t) for r, t in left]
    turns = {r[1] for r in rows if r[1] is not None}
    illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    counts = [faults.count(f) for f in ("blank", "duplicate", "truncated")]
    digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in named).encode()).hexdigest()
    return (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *counts, illegal, cost, audit, digest), named


def table(spark, tmp_path, rows, name="c"):
    spark.createDataFrame([(*r, "x", 1, 1, 1, 1, "x") for r in rows], SCHEMA).repartition(3).write.parquet(str(tmp_path / f"{name}.parquet"))
    return spark.read.parquet(str(tmp_path / f"{name}.parquet"))


def made(seed, convs, longest):
    rnd, rows = random.Random(seed), []
    for conv in range(convs):
        for turn in range(rnd.randint(1, longest)):
            role = rnd.choice(["user", "assistant", "system", "tool", "", "Üser", None] if conv % 3 == 0 else ["user", "assistant"])
            rows.append((conv if conv else None, rnd.choice([turn, turn, turn + 3, None]) if conv % 4 == 1 else turn, role, rnd.choice(["Hi.", "Hi.", "So what", f"n {rnd.random()}!", "\n ", "", None, "x? \n"])))
    return rows


def check(spark, tmp_path, rows, name="c"):
    table(spark, tmp_path, rows, "conversations" if name == "c" else name)
    got = {r["conv_id"]: tuple(r)[1:] for r in C.op13_conversation_repair(spark, str(tmp_path)).collect()}
    bad = damaged(rows)
    want = {conv: brute([r for r in bad if r[0] == conv])[0] for conv in {r[0] for r in rows}}
    assert got == want


def test_repair_equals_brute_force(spark, tmp_path):
    rows = made(1, 60, 12)
    check(spark, tmp_path, rows + rows[:7] + [(5000, None, "user", "a."), (5000, None, "user", "a."), (5001, 2, "system", "s.")])


@pytest.mark.parametrize("parts", ["3", "16"])
def test_a_conversation_in_many_chunks(spark, tmp_path, parts):
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    rows = made(2, 3, 5) + [(77, t, r, f"{t % 50} x." if t % 7 else "open") for t, r in enumerate(random.Random(4).choices(["user", "assistant", "system"], k=180))]
    try:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        check(spark, tmp_path, rows)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_repaired_rows_and_plain_edits(spark, tmp_path):
    rows = [r for r in made(9, 20, 9) if r[2] is not None and r[3] is not None]
    edited = C.edits(table(spark, tmp_path, rows), Scratch(spark, "t"))
    got = {}
    for r in C.repaired(edited).orderBy("pos", "nth").collect():
        got.setdefault(r["conv_id"], []).append((r["role"], r["text"]))
    for conv in {r[0] for r in rows}:
        assert got.get(conv, []) == brute([r for r in rows if r[0] == conv])[1]


def test_long_texts_no_rows_and_all_dropped(spark, tmp_path):
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    kept = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 > 4)
    check(spark, tmp_path, [(gone, 0, "user", "a."), (kept, 0, "user", "word " * 200_000 + ".")])
    table(spark, tmp_path, [], "none/conversations")
    assert C.op13_conversation_repair(spark, str(tmp_path / "none")).collect() == []


def test_the_automaton_stays_small():
    auto = C.Determinised()
    at, _ = auto.state(C.END)
    rnd = random.Random(1)
    auto.scan([rnd.randrange(9) for _ in range(20_000)], at)
    assert len(auto.vectors) < 60 and len(auto.steps) < 540
