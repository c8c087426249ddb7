"""Repair of conversation structure by lazy weighted determinisation.

The cheapest edits that give a conversation the role initials ``(s?(ua)+)?`` are paths through a weighted automaton of
four states (``START``, after a system row, after a user's, after an assistant's). ``Determinised`` turns it into a
deterministic one as it goes: the costs from each state to the end, less their least, are *one* state, of which there are
few; a table caches (state, symbol) -> (state, cost). A scan of a conversation from its end is a lookup per row and gives
the costs; the trace back along it follows, from START, the tight arcs, the ASCII-least at each place (all arcs out of a
state differ in their initial, so that the choice is exact), and is cached by (state, symbol, place) as well.

Scale: equal rows of a turn are counted before anything is exchanged; rows are sorted over the whole table, so that a
conversation may lie in several *chunks*. For a chunk that holds an end of a conversation that goes on elsewhere, the scan
gives a min-plus matrix of its costs between states; those (two rows a chunk at most, whatever the rows) are composed on
the driver, which tells each chunk the costs at its right and its first state. Earlier copies are found by an aggregation.
Only the digest of a repaired conversation, which SHA-256 must read in order, goes through one task, as a stream in
constant memory apart from the audit.

Rules of ``edits``: rows are taken by turn (null first; ties by role, text); blank text: no character but white space;
duplicate: role and text seen earlier in the conversation; truncated: the last character that isn't white space is none of
``.!?``. Keep costs 0, Rerole 2, Delete 3, Insert 2, a truncated row that stays 1; blank and duplicate rows are deleted.
Defined results: null role and text are one space, a null conv_id is a conversation of its own, repeated rows are
duplicates; an empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WS_CHARS, Scratch, read

START, SYSTEM, USER, ASSISTANT = range(4)
NEVER = 1 << 60
DELETE, REROLE, INSERT, TRUNCATED = 3, 2, 2, 1
#: State after a row of an initial.
AFTER = [{"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER}]
MUST_GO = 0  # the symbol of blank and duplicate rows; others are 1 + 2 * class + truncated
CLASSES = "sua?"


class Determinised:
    """The lazily built deterministic automaton over cost vectors, and its trace."""

    def __init__(self):
        self.ids: dict[tuple, int] = {}
        self.vectors: list[tuple] = []
        self.steps: dict[tuple[int, int], tuple[int, int]] = {}
        self.traces: dict[tuple[int, int, int], tuple[str, str, int]] = {}

    def state(self, costs: list[int]) -> tuple[int, int]:
        """(id, least cost) of a vector, closed under insertions."""
        costs = list(costs)
        for _ in range(3):
            costs = [min([c, *(INSERT + costs[to] for i, to in AFTER[q].items() if i != "s")]) for q, c in enumerate(costs)]
        low = min(costs)
        key = tuple(c - low if c < NEVER else NEVER for c in costs)
        if key not in self.ids:
            self.ids[key] = len(self.vectors)
            self.vectors.append(key)
        return self.ids[key], low

    def arcs(self, q: int, symbol: int) -> list[tuple[str, str, int, int]]:
        """(edit, code of the row that it leaves, state, cost) of the ways over one row."""
        out = [("D", "", q, DELETE)]
        if symbol != MUST_GO:
            initial, extra = CLASSES[(symbol - 1) // 2], (symbol - 1) % 2 * TRUNCATED
            out += [("K", "k", AFTER[q][initial], extra)] if initial in AFTER[q] else []
            out += [("R", i.upper(), to, REROLE + extra) for i, to in AFTER[q].items() if i != "s"]
        return out

    def step(self, at: int, symbol: int) -> tuple[int, int]:
        """State before a row of ``symbol``, given the one after it, and the cost to add."""
        if (at, symbol) not in self.steps:
            after = self.vectors[at]
            self.steps[at, symbol] = self.state([min(min(after[to] + cost, NEVER) for _, _, to, cost in self.arcs(q, symbol)) for q in range(4)])
        return self.steps[at, symbol]

    def scan(self, symbols: list[int], at: int) -> tuple[list[int], int]:
        """States before each row and after the last, from right to left, and the cost that was added."""
        states, total = [at] * (len(symbols) + 1), 0
        for i in range(len(symbols) - 1, -1, -1):
            at, add = self.step(at, symbols[i])
            states[i] = at
            total += add
        return states, total

    def over(self, at: int, symbol: int, q: int) -> tuple[str, str, int]:
        """Edits, codes of the rows left and next state: the ASCII-least tight way over a row from state ``q``."""
        key = (at, symbol, q)
        if key not in self.traces:
            before, add = self.step(at, symbol)
            edits = codes = ""
            here = q
            while True:
                left = self.vectors[before][here] + add
                tight = [(e, c, to, False) for e, c, to, cost in self.arcs(here, symbol) if cost + self.vectors[at][to] == left]
                tight += [("I", i, to, True) for i, to in AFTER[here].items() if i != "s" and INSERT + self.vectors[before][to] == self.vectors[before][here]]
                edit, code, here, stays = min(tight)
                edits, codes = edits + edit, codes + code
                if not stays:
                    break
            self.traces[key] = edits, codes, here
        return self.traces[key]

    def close(self, q: int) -> tuple[str, str]:
        """Insertions after the last row."""
        out = ""
        while q in (SYSTEM, USER):
            i = "u" if q == SYSTEM else "a"
            out, q = out + i, AFTER[q][i]
        return "I" * len(out), out

    def trace(self, symbols: list[int], states: list[int], q: int) -> tuple[list[tuple[str, str]], int]:
        out = []
        for symbol, at in zip(symbols, states[1:], strict=True):
            edits, codes, q = self.over(at, symbol, q)
            out.append((edits, codes))
        return out, q


END = [0, NEVER, NEVER, 0]
ROW = ["key", "chunk", "pos", "symbol", "copies"]


def times(matrix: list[list[int]], right: list[int]) -> list[int]:
    return [min(min(m + r for m, r in zip(row, right, strict=True)), NEVER) for row in matrix]


def symbols_of(pdf: pd.DataFrame) -> tuple[list[int], list[int], list[int]]:
    """Symbols with further copies of a row as deletions after it; for each row its first and number of symbols."""
    symbols, first, size = [], [], []
    for symbol, copies in zip(pdf["symbol"].tolist(), pdf["copies"].tolist(), strict=True):
        first.append(len(symbols))
        size.append(copies)
        symbols += [symbol] + [MUST_GO] * (copies - 1)
    return symbols, first, size


def matrices(pdf: pd.DataFrame) -> pd.DataFrame:
    """Costs between states over a chunk's part of its first and of its last conversation."""
    pdf, auto, out = pdf.sort_values("pos", kind="stable"), Determinised(), []
    for key in dict.fromkeys([pdf["key"].iloc[0], pdf["key"].iloc[-1]]):
        part = pdf[pdf["key"] == key]
        symbols, columns = symbols_of(part)[0], []
        for q in range(4):
            at, low = auto.state([0 if p == q else NEVER for p in range(4)])
            states, total = auto.scan(symbols, at)
            columns.append([c + low + total if c < NEVER else NEVER for c in auto.vectors[states[0]]])
        out.append((key, part["chunk"].iloc[0], part["pos"].iloc[0], [columns[q][p] for p in range(4) for q in range(4)]))
    return pd.DataFrame(out, columns=["key", "chunk", "pos", "costs"])


def rights(parts: DataFrame) -> dict[tuple[str, int], dict]:
    """For each chunk of a conversation in several: costs at its right, whether it is the first or last, the cost of all."""
    chains: dict[str, list] = {}
    for row in parts.orderBy("key", "pos").collect():
        chains.setdefault(row["key"], []).append(row)
    out = {}
    for key, rows in chains.items():
        if len(rows) < 2:
            continue
        right = END
        for i in range(len(rows) - 1, -1, -1):
            matrix = [rows[i]["costs"][4 * p : 4 * p + 4] for p in range(4)]
            out[key, rows[i]["chunk"]] = {"right": right, "last": i == len(rows) - 1, "q": START if i == 0 else None, "cost": 0, "next": None if i == len(rows) - 1 else rows[i + 1]["chunk"]}
            right = times(matrix, right)
        out[key, rows[0]["chunk"]]["cost"] = right[START]
    return out


def ends(pdf: pd.DataFrame, known: dict) -> pd.DataFrame:
    """The state in which a trace leaves a chunk, for each in which it may enter it."""
    pdf, auto, out = pdf.sort_values("pos", kind="stable"), Determinised(), []
    for key, part in pdf.groupby("key", sort=False):
        about = known[key, int(part["chunk"].iloc[0])]
        symbols = symbols_of(part)[0]
        at, _ = auto.state(about["right"])
        states, _ = auto.scan(symbols, at)
        to = [auto.trace(symbols, states, q)[1] if auto.vectors[states[0]][q] < NEVER else -1 for q in range(4)]
        out.append((key, int(part["chunk"].iloc[0]), to))
    return pd.DataFrame(out, columns=["key", "chunk", "to"])


def traced(pdf: pd.DataFrame, known: dict) -> pd.DataFrame:
    """Edits of each row of a chunk; the cost of a conversation stands at its first row."""
    pdf, auto, out = pdf.sort_values("pos", kind="stable"), Determinised(), []
    for key, part in pdf.groupby("key", sort=False):
        about = known.get((key, int(part["chunk"].iloc[0])))
        symbols, first, size = symbols_of(part)
        at, low = auto.state(about["right"] if about else END)
        states, total = auto.scan(symbols, at)
        start = about["q"] if about else START
        ways, q = auto.trace(symbols, states, start)
        if not about or about["last"]:
            edits, codes = auto.close(q)
            ways[-1] = ways[-1][0] + edits, ways[-1][1] + codes
        cost = about["cost"] if about else low + total + auto.vectors[states[0]][START]
        for i, (pos, f, n) in enumerate(zip(part["pos"].tolist(), first, size, strict=True)):
            out.append((pos, "".join(w[0] for w in ways[f : f + n]), "".join(w[1] for w in ways[f : f + n]), cost if i == 0 else 0))
    return pd.DataFrame(out, columns=["pos", "edits", "codes", "cost"])


def edits(conversations: DataFrame, scratch: Scratch) -> DataFrame:
    """Per distinct row of a turn, in order of ``pos``: its copies, first fault, ``edits`` and ``codes``.

    ``edits`` has the initials of Keep, Rerole, Delete and Insert at this row (insertions stand before it, at the end of a
    conversation after it); ``codes`` tells the rows that they leave: k (the row), U or A (the row with another role), u or
    a (an inserted row). Columns: ``key, conv_id, pos, turn, role, text, copies, blank, later, truncated, edits, codes, cost``.
    """
    copies = F.col("__copies") if "__copies" in conversations.columns else F.lit(1).cast("long")
    rows = conversations.select(
        F.when(F.col("conv_id").isNull(), "").otherwise(F.concat(F.lit("v"), F.col("conv_id").cast("string"))).alias("key"), "conv_id",
        F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), copies.alias("copies"),
    )
    rows = rows.groupBy("key", "conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
    solid = F.rtrim(F.col("text"), F.lit(WS_CHARS))
    rows = rows.withColumn("blank", solid == "").withColumn("open", ~F.substring(solid, -1, 1).isin(".", "!", "?"))
    rows = rows.withColumn("digest", F.sha2("text", 256))
    rows = scratch.cut(rows.orderBy("key", F.asc_nulls_first("turn"), "role", "text").withColumn("chunk", F.spark_partition_id()).withColumn("pos", F.monotonically_increasing_id()))
    said = rows.where("not blank")
    earliest = said.groupBy("key", "role", "digest").agg(F.min("pos").alias("pos0"))
    said = said.select("key", "role", "digest", "pos").join(earliest, ["key", "role", "digest"]).select("pos", (F.col("pos") > F.col("pos0")).alias("later"))
    light = rows.drop("text", "conv_id", "turn", "digest").join(said, "pos", "left")
    later = F.coalesce("later", F.lit(False))
    kind = F.coalesce(F.array_position(F.array(*map(F.lit, CLASSES[:3])), F.substring("role", 1, 1)), F.lit(0))
    kind = F.when(kind == 0, 3).otherwise(kind - 1)
    symbol = F.when(F.col("blank") | later, MUST_GO).otherwise(1 + 2 * kind + F.col("open").cast("int"))
    light = scratch.cut(light.select("key", F.col("chunk").cast("long").alias("chunk"), "pos", symbol.cast("int").alias("symbol"), "copies", later.alias("later")))

    known = rights(light.select(*ROW).groupBy("chunk").applyInPandas(matrices, "key string, chunk long, pos long, costs array<long>"))
    if known:
        some = light.sparkSession.createDataFrame([(k, c) for k, c in known], "key string, chunk long")
        spread = light.select(*ROW).join(F.broadcast(some), ["key", "chunk"], "left_semi")  # two rows a chunk at most
        to = {(r["key"], r["chunk"]): r["to"] for r in spread.groupBy("chunk").applyInPandas(lambda pdf: ends(pdf, known), "key string, chunk long, to array<int>").collect()}
        for key, chunk in [k for k, v in known.items() if v["q"] is not None]:
            while known[key, chunk]["next"] is not None:
                following = known[key, chunk]["next"]
                known[key, following]["q"] = to[key, chunk][known[key, chunk]["q"]]
                chunk = following
    ways = light.select(*ROW).groupBy("chunk").applyInPandas(lambda pdf: traced(pdf, known), "pos long, edits string, codes string, cost long")
    out = rows.drop("chunk", "digest").join(light.select("pos", "later"), "pos").join(ways, "pos")
    return scratch.cut(out.withColumn("truncated", F.col("open") & ~F.col("blank") & ~F.col("later")).drop("open"))


def repaired(edited: DataFrame) -> DataFrame:
    """The repaired rows: ``conv_id, pos, nth, role, text, inserted`` in order of (pos, nth)."""
    code = F.col("code")
    role = F.when(code == "k", F.col("role")).when(F.lower(code) == "u", "user").otherwise("assistant")
    inserted = code.isin("u", "a")
    rows = edited.where("codes <> ''").select("conv_id", "pos", "role", "text", F.posexplode(F.split("codes", "(?!$)")).alias("nth", "code"))
    return rows.select("conv_id", "pos", "nth", role.alias("role"), F.when(inserted, "").otherwise(F.col("text")).alias("text"), inserted.alias("inserted"))


def digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Streams rows sorted by (key, pos); a conversation may go on over batches."""
    legal, key, done = {"su", "ua", "au"}, None, []
    columns = ["key", "audit", "repaired_sha256", "illegal", "cost"]

    def row():
        return key, "".join(audit), sha.hexdigest(), illegal, cost

    for pdf in batches:
        for k, role, text, copies, edit, codes, add in zip(*[pdf[c].tolist() for c in ("key", "role", "text", "copies", "edits", "codes", "cost")], strict=True):
            if k != key:
                if key is not None:
                    done.append(row())
                key, audit, sha, illegal, cost, last, some = k, [], hashlib.sha256(), 0, 0, None, False
            illegal += copies - 1 + (last is not None and last + role[:1] not in legal)
            last, cost = role[:1], cost + add
            audit.append(edit)
            for code in codes:
                named = role if code == "k" else "user" if code in "uU" else "assistant"
                sha.update((("\n" if some else "") + named + ":").encode())
                if code not in "ua":
                    sha.update(text.encode())
                some = True
        if len(done) > 1000:
            yield pd.DataFrame(done, columns=columns)
            done = []
    if key is not None:
        done.append(row())
    if done:
        yield pd.DataFrame(done, columns=columns)


def report(edited: DataFrame) -> DataFrame:
    """One row per conversation: faults, gaps, illegal pairs, cost, audit and the digest of what is repaired."""
    turns = edited.where("turn is not null").groupBy("key", "turn").agg(F.lit(1).alias("one")).groupBy("key").agg((F.max("turn") - F.min("turn") + 1 - F.count("*")).alias("gaps"))
    n = F.col("copies")
    again = F.when(F.col("blank"), 0).when(F.col("later"), n).otherwise(n - 1)
    faults = edited.groupBy("key").agg(
        F.sum(F.when(F.col("blank"), n).otherwise(0)).alias("blank"), F.sum(again).alias("duplicate"), F.sum(F.col("truncated").cast("long")).alias("truncated")
    )
    fields = edited.select("key", "pos", "role", "text", "copies", "edits", "codes", "cost").repartition("key").sortWithinPartitions("key", "pos")
    told = fields.mapInPandas(digests, "key string, audit string, repaired_sha256 string, illegal long, cost long")
    return told.join(faults, "key").join(turns, "key", "left").withColumn("gaps", F.coalesce("gaps", F.lit(0).cast("long")))


def damage(conversations: DataFrame) -> DataFrame:
    """Faults by crc32 of ``conv_id:turn``: rows dropped, emptied, without sentence ends, repeated, or given to the user."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn"))) % 20
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    return conversations.where(kind != 0).select(
        "conv_id", "turn", F.when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.when(kind == 3, 2).otherwise(1).cast("long").alias("__copies"),
    )


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations, scratch = read(spark, sf_dir, "conversations"), Scratch(spark, "repair")
    found = report(edits(damage(conversations), scratch))
    key = F.when(F.col("conv_id").isNull(), "").otherwise(F.concat(F.lit("v"), F.col("conv_id").cast("string")))
    named = conversations.select("conv_id").distinct().withColumn("key", key).join(found, "key", "left")
    count = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return named.select(
        "conv_id", *map(count, ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]),
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )
