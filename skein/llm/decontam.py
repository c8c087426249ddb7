"""Benchmark decontamination by a generalised suffix automaton of the test items.

Items are normalised to words; one automaton holds all their substrings. Documents' words stream through it, and
the automaton tells, at every word, the longest run ending there that occurs in an item. Where that run reaches a
window (13 words, or a whole shorter item), the window's words are hit. Words that no item has break every run, so
only runs of known words at least as long as the shortest window are streamed.

The automaton is sent to every task, so its size is bounded: the items are dealt into as many automata as
``shard_words`` asks for (a kilobyte of a worker's memory a word was measured, so the default takes 0.25 GB). With
one, documents pass it and are done. With more, each is collected, sent, scanned with in a job of its own, whose few
hits are written, and given up before the next, so only one is alive at any time; the hits of all are merged and
joined to the documents.

Defined results: null text or text without words has no hits; null or wordless items are ignored; items with equal
texts all count; a null item_id counts as no item in ``n_items`` but its windows hit; repeated documents are judged
each for itself; an empty benchmark hits nothing; extra columns are dropped. The items' hash is that of the empty
string where no item occurs.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, clean_columns, read, small_batches

WINDOW = 13
#: A-Z to a-z; every other ASCII character but a-z and 0-9 to a blank; the bytes of other characters stay.
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 or 48 <= b <= 57 else 32 for b in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(TABLE).split() if text else []


class SuffixAutomaton:
    """Of many word sequences. States know how long their words can be, their suffix link, the items in which they
    occur, and the short whole items that end there."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.word: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends: list[tuple[int, int]] = []
        self.items = [i for i, _ in items]
        self.shortest = min((min(window, len(w)) for _, w in items if w), default=0)
        whole: list[tuple[int, int, int]] = []
        for k, (_, words) in enumerate(items):
            last = 0
            for w in words:
                last = self._add(last, self.word.setdefault(w, len(self.word)))
                ends.append((last, k))
            if 0 < len(words) < window:
                whole.append((last, len(words), k))
        order = sorted(range(1, len(self.next)), key=self.length.__getitem__)
        # The state of the last `window` words of a match in state s.
        self.top = [0] * len(self.next)
        for s in order:
            parent = self.link[s]
            self.top[s] = self.top[parent] if self.length[parent] >= window else s
        #: Items with each window: gathered from the leaves of the link tree down to window states.
        sets: list[set[int]] = [set() for _ in self.next]
        for s, k in ends:
            sets[s].add(k)
        for s in reversed(order):
            if self.length[self.link[s]] >= window:
                sets[self.link[s]] |= sets[s]
        self.of_window = {s: sorted(sets[s]) for s in order if self.top[s] == s and self.length[s] >= window}
        #: Short items that are suffixes of what a state stands for: (words, item).
        mine: dict[int, list[tuple[int, int]]] = {}
        for s, n, k in whole:
            mine.setdefault(s, []).append((n, k))
        self.short: dict[int, list[tuple[int, int]]] = {}
        for s in order if mine else []:
            got = self.short.get(self.link[s], []) + mine.get(s, [])
            if got:
                self.short[s] = got

    def _add(self, last: int, c: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        if c in nxt[last]:
            q = nxt[last][c]
            return q if length[q] == length[last] + 1 else self._clone(last, c, q)
        cur = len(nxt)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, c, q)
        return cur

    def _clone(self, p: int, c: int, q: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        new = len(nxt)
        nxt.append(dict(nxt[q]))
        link.append(link[q])
        length.append(length[p] + 1)
        link[q] = new
        while p >= 0 and nxt[p].get(c) == q:
            nxt[p][c] = new
            p = link[p]
        return new

    def matches(self, codes: list[int], start: int) -> Iterable[tuple[int, int, int]]:
        """Streams known words that begin at ``start``: (position, state, longest matching length) at each."""
        nxt, link, length = self.next, self.link, self.length
        s = n = 0
        for at, c in enumerate(codes, start):
            while s and c not in nxt[s]:
                s = link[s]
                n = length[s]
            s = nxt[s].get(c, 0)
            n = n + 1 if s else 0
            yield at, s, n

    def scan(self, words: list[bytes]) -> tuple[list[list[int]], set[int]]:
        """Spans of hit words (start, end exclusive; disjoint, in order) and indexes of the items that occur."""
        spans: list[list[int]] = []
        seen: set[int] = set()
        if not self.shortest or len(words) < self.shortest:
            return spans, seen
        get = self.word.get
        codes = np.array([get(w, -1) for w in words], np.int32)
        edge = np.flatnonzero(np.diff(np.concatenate(([0], (codes >= 0).view(np.int8), [0]))))
        window, top, short, tops = self.window, self.top, self.short, set()
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
            if b - a < self.shortest:
                continue
            for at, s, n in self.matches(codes[a:b].tolist(), a):
                size = 0
                if n >= window:
                    size = window
                    tops.add(top[s])
                if short and s in short:
                    for k, item in short[s]:
                        if k <= n:
                            size = max(size, k)
                            seen.add(item)
                if size:
                    first = at + 1 - size
                    while spans and spans[-1][0] >= first:
                        spans.pop()
                    if spans and spans[-1][1] >= first:
                        spans[-1][1] = at + 1
                    else:
                        spans.append([first, at + 1])
        for s in tops:
            seen.update(self.of_window[s])
        return spans, seen


def item_shards(items: DataFrame, shard_words: int) -> list[DataFrame]:
    """The items (``i``, ``t``) in groups of about ``shard_words`` words."""
    items = clean_columns(items, "item_id", "text").select(F.col("item_id").cast("string").alias("i"), F.col("text").cast("binary").alias("t")).where("t is not null")
    size = items.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0]
    n = max(1, -(-size // (6 * shard_words)))
    return [items if n == 1 else items.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k) for k in range(n)]


def scanner(spark: SparkSession, items: DataFrame, window: int) -> tuple[Callable, Callable[[], None]]:
    """(a function of a text that gives its number of words, spans and items, to be called in tasks; a function that
    gives the items up)."""
    sent, name = spark.sparkContext.broadcast([(r["i"], w) for r in items.collect() if (w := words_of(r["t"]))]), uuid.uuid4().hex

    def scan(text: bytes | None) -> tuple[int, list[list[int]], list[str]]:
        auto, words = _automaton(name, sent, window), words_of(text)
        spans, seen = auto.scan(words)
        return len(words), spans, sorted({auto.items[k] for k in seen if auto.items[k] is not None})

    return scan, lambda: sent.destroy()


_FOUND = "n_words bigint, spans array<array<bigint>>, items array<string>"


def _columns(got: list[tuple]) -> list:
    import pyarrow as pa

    types = (pa.int64(), pa.list_(pa.list_(pa.int64())), pa.list_(pa.string()))
    return [pa.array([g[i] for g in got], t) for i, t in enumerate(types)]


def contamination(docs: DataFrame, items: DataFrame, keep: list[str], window: int = WINDOW, shard_words: int = 250_000) -> DataFrame:
    """For every document ``row`` (a struct of its columns ``keep``), ``n_words``, ``spans`` (array of [start, end)
    in words) and ``items`` (ids of the items that occur)."""
    import pyarrow as pa

    spark = docs.sparkSession
    small_batches(spark)
    row = F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row")
    text = F.col("`text`").cast("binary").alias("t")
    shards = item_shards(items, shard_words)
    if len(shards) == 1:
        # Columns ride along, so nothing is joined back.
        scan, _ = scanner(spark, shards[0], window)

        def run(batches):
            for batch in batches:
                yield pa.RecordBatch.from_arrays([batch.column(0), *_columns([scan(t.as_py()) for t in batch.column(1)])], names=["row", "n_words", "spans", "items"])

        src = docs.select(row, text)
        return src.mapInArrow(run, f"row {src.schema['row'].dataType.simpleString()}, {_FOUND}" if keep else _FOUND)

    scratch = Scratch(spark, "decontam")
    src = docs.select(F.monotonically_increasing_id().alias("rid"), row, text)
    found = None
    for shard in shards:
        scan, give_up = scanner(spark, shard, window)

        def hits(batches, scan=scan):
            for batch in batches:
                got = [(rid, g) for rid, t in zip(batch.column(0).to_pylist(), batch.column(1)) if (g := scan(t.as_py()))[1]]
                yield pa.RecordBatch.from_arrays([pa.array([r for r, _ in got], pa.int64()), *_columns([g for _, g in got])], names=["rid", "n_words", "spans", "items"])

        part = scratch.cut(src.select("rid", "t").mapInArrow(hits, f"rid bigint, {_FOUND}"))
        give_up()
        found = part if found is None else found.unionByName(part)
    # A document has a row of each shard at most.
    found = found.groupBy("rid").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))

    def finish(batches):
        for batch in batches:
            texts, spans, ids = (batch.column(i).to_pylist() for i in (1, 2, 3))
            got = [(len(words_of(t)), merged(s or []), sorted(i or [])) for t, s, i in zip(texts, spans, ids)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *_columns(got)], names=["row", "n_words", "spans", "items"])

    both = src.join(found.hint("merge"), "rid", "left").select("row", "t", "spans", "items")
    return both.mapInArrow(finish, f"row {src.schema['row'].dataType.simpleString()}, {_FOUND}")


_BUILT: dict[str, SuffixAutomaton] = {}


def _automaton(name: str, sent, window: int) -> SuffixAutomaton:
    """Built once by each worker; only the last one is kept."""
    if name not in _BUILT:
        _BUILT.clear()
        _BUILT[name] = SuffixAutomaton(sent.value, window)
    return _BUILT[name]


def merged(spans: list[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(map(tuple, spans)):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def verdicts(found: DataFrame) -> DataFrame:
    """Adds ``n_hit, n_items, items_sha256, contaminated`` (a twentieth of the words at least)."""
    hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda a, s: a + F.get(s, F.lit(1)) - F.get(s, F.lit(0)))
    out = found.withColumn("n_hit", hit)
    return out.select(
        "*",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents that aren't contaminated, with their own columns and their text as it is."""
    return verdicts(contamination(docs, items, docs.columns, window)).where("not contaminated").select("row.*")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = verdicts(contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), ["doc_id"]))
    return out.select("row.doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


OP7_SQL = r"""
with d as (
  select row_number() over () rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') ws from documents),
b as (
  select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') ws from benchmark),
win as (
  select distinct item_id, least(13, len(ws)) n, unnest(list_transform(range(1, greatest(len(ws) - 12, 1) + 1), lambda k: array_to_string(ws[k:k+12], ' '))) g
  from b where len(ws) > 0),
sizes as (select distinct n from win),
dw as (
  select rid, n, unnest(range(1, len(ws) - n + 2)) i, unnest(list_transform(range(1, len(ws) - n + 2), lambda k: array_to_string(ws[k:k+n-1], ' '))) g
  from d, sizes where len(ws) >= n),
hit as (select rid, i, dw.n, item_id from dw join win on dw.n = win.n and dw.g = win.g),
pos as (select rid, count(distinct i + j) n_hit from (select distinct rid, i, n from hit), range(13) r(j) where j < n group by rid),
it as (select rid, count(distinct item_id) n_items, string_agg(distinct item_id::varchar, ',' order by item_id::varchar) ids from hit group by rid)
select doc_id, len(ws)::bigint n_words, coalesce(n_hit, 0)::bigint n_hit, coalesce(n_items, 0)::bigint n_items, sha256(coalesce(ids, '')) items_sha256,
  (coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(ws)) contaminated
from d left join pos using (rid) left join it using (rid)
"""
