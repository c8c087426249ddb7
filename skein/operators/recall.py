"""Recall of candidate events by rules and by vectors, their union, and the merge decision."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import score as S
from ..functions.text import distinct_ci, letters_and_digits, strings, tokenize
from ..sources.config import Config


def recallable(events: DataFrame, at: Column, cfg: Config, skip_blacklisted: bool = False) -> DataFrame:
    """Active events of the history window and stale ones of the archive window. Rule recall keeps blacklisted events,
    vector recall and secondary merges skip them."""
    since = lambda unit, n: F.timestamp_add(unit, F.lit(-max(1, n)), at)
    live = (F.col("status") == "Active") & (F.col("last_seen_at") >= since("HOUR", cfg.history_hours))
    stale = (F.col("status") == "Stale") & (F.col("last_seen_at") >= since("DAY", cfg.archive_recall_days))
    out = events.where(live | stale)
    return out.where(~F.col("is_blacklisted")) if skip_blacklisted else out


#: Tasks that a search over blocks of texts is dealt to at least, where there are as many blocks.
TASKS = 128
#: Rows of a block of vectors, and bytes of a block of texts; two blocks are what a task holds at a time.
BLOCK, BLOCK_BYTES = 1024, 4 << 20


def blocks(df: DataFrame, key: str, columns: list[str], name: str, n: int, *by: str) -> DataFrame:
    """(``name`` (number of a block), ``by``, ``{name}_rows``: the rows of one of ``n`` blocks as an array)."""
    dealt = df.withColumn(name, F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(n)))
    return dealt.groupBy(name, *by).agg(F.collect_list(F.struct(*columns)).alias(f"{name}_rows"))


class ItemIndex:
    """Postings of a block of items: word or n-gram to the items that hold it, and each item's k-th best score so far.

    ``score`` adds an event. What an item can reach with it is bounded, from the cheapest bound on, and compared with the
    item's k-th score (or the floor): first by the shared words, which are counted exactly, and the two numbers of n-grams;
    then by the shared n-grams of short posting lists, where the long lists' (those of more than ``LONG`` of the items)
    count as shared as far as both sides have such; only for what is left the long lists are counted, too. A k-th score
    only rises, so skipped pairs can't be among the best. With ``k`` 0 all pairs that reach the floor are kept.
    """

    LONG = 0.25

    def __init__(self, rows, k: int, floor: float):
        import numpy as np

        self.k, self.ids, self.n = k, rows.field("item_id"), len(rows)
        self.words, self.tok = self.postings([set(w) for w in rows.field("tok").to_pylist()])
        self.grams, self.gram = self.postings([set(gram_codes(t).tolist()) for t in rows.field("letters").to_pylist()])
        self.ti, self.gi = self.tok.sum(axis=0, dtype=np.int64), self.gram.sum(axis=0, dtype=np.int64)
        long = self.gram.sum(axis=1) > self.LONG * self.n
        self.long = set(np.flatnonzero(long).tolist())
        self.long_i = self.gram[long].sum(axis=0, dtype=np.int64)
        self.best, self.kth = np.full((self.n, max(1, k)), -1.0), np.full(self.n, floor)
        self.pairs = self.scored = 0

    @staticmethod
    def postings(sets: list[set]):
        import numpy as np

        words: dict = {}
        for s in sets:
            for w in s:
                words.setdefault(w, len(words))
        table = np.zeros((len(words), len(sets)), np.uint8)
        for i, s in enumerate(sets):
            table[[words[w] for w in s], i] = 1
        return words, table

    def ratio(self, n, a, b):
        """Jaccard from the number of shared elements; 0 if either set is empty."""
        import numpy as np

        return np.where((a == 0) | (b == 0), 0.0, n / np.maximum(a + b - n, 1))

    def score(self, tok: list[str], letters: str, titles: list[str], keys: list[str], rec: float):
        """(items, tok, gram, rep, key) of the pairs of an event that can be among their items' best."""
        import numpy as np

        self.pairs += self.n
        codes, te = gram_codes(letters), len(tok)
        ge = len(codes)
        at = [self.words[w] for w in tok if w in self.words]
        tok_n = self.tok[at].sum(axis=0, dtype=np.int64) if at else np.zeros(self.n, np.int64)
        tj = self.ratio(tok_n, self.ti, te)
        held = sum(1 for w in keys if w in self.words)
        # Titles' n-grams are n-grams of the event, so an item shares no more with them; key terms are its words.
        rep_most = lambda n, i: 0.15 * n / np.maximum(self.gi[i], 1) if titles else 0.0
        # Scores are rounded to four places: a hair is left to each bound.
        rest = 0.35 * tj + 0.05 * rec + (0.10 * held / len(keys) if keys else 0.0) + 0.0001
        every = slice(None)
        most = np.minimum(self.gi, ge)
        left = np.flatnonzero(rest + 0.35 * self.ratio(most, self.gi, ge) + rep_most(most, every) >= self.kth)
        if not len(left):
            return None
        at = [self.grams[c] for c in codes.tolist() if c in self.grams]
        short, long = [c for c in at if c not in self.long], [c for c in at if c in self.long]
        n = self.gram[np.ix_(short, left)].sum(axis=0, dtype=np.int64)
        most = np.minimum(n + np.minimum(self.long_i[left], len(long)), np.minimum(self.gi[left], ge))
        keep = rest[left] + 0.35 * self.ratio(most, self.gi[left], ge) + rep_most(most, left) >= self.kth[left]
        left, n = left[keep], n[keep]
        if not len(left):
            return None
        n = n + self.gram[np.ix_(long, left)].sum(axis=0, dtype=np.int64)
        gj = self.ratio(n, self.gi[left], ge)
        rep = np.zeros(len(left))
        for t in titles:
            c = gram_codes(t)
            own = [self.grams[x] for x in c.tolist() if x in self.grams]
            rep = np.maximum(rep, self.ratio(self.gram[np.ix_(own, left)].sum(axis=0, dtype=np.int64), self.gi[left], len(c)))
        own = [self.words[w] for w in keys if w in self.words]
        key = self.tok[np.ix_(own, left)].sum(axis=0, dtype=np.int64) / len(keys) if keys else np.zeros(len(left))
        score = 0.35 * tj[left] + 0.35 * gj + 0.15 * rep + 0.10 * key + 0.05 * rec
        self.scored += len(left)
        good = score + 0.0001 >= self.kth[left]
        left, score, tj, gj, rep, key = left[good], score[good], tj[left][good], gj[good], rep[good], key[good]
        if not self.k:
            return left, tj, gj, rep, key
        # The k-th best score so far takes the least one's place.
        worst = self.best[left].argmin(axis=1)
        better = score > self.best[left, worst]
        self.best[left[better], worst[better]] = score[better]
        self.kth[left] = np.maximum(self.kth[left], self.best[left].min(axis=1) - 0.0001)
        return left, tj, gj, rep, key


def gram_codes(letters: str | None):
    """The distinct n-grams of two and three UTF-16 units of a text of letters and digits, as numbers."""
    import numpy as np

    u = np.frombuffer((letters or "").encode("utf-16-le", "surrogatepass"), np.uint16).astype(np.int64) + 1
    return np.unique(np.concatenate((u[:-1] << 17 | u[1:], u[:-2] << 34 | u[1:-1] << 17 | u[2:])))


def text_blocks(df: DataFrame, text: Column, size: int) -> int:
    """Into how many blocks of about ``size`` bytes a frame's texts go."""
    return max(1, -(-df.agg(F.coalesce(F.sum(F.length(text) + 64), F.lit(0))).first()[0] // size))


def shared_text(items: DataFrame, events: DataFrame, ni: int, ne: int, k: int, floor: float, stats=None) -> DataFrame:
    """``item_id, event_id, last_seen_at, tok, gram, rep, key, rec``: pairs among which each item's best ``k`` are.

    ``items(item_id, tok, letters)``; ``events(event_id, last_seen_at, rec, tok, letters, titles, keys)``. Both are dealt
    into ``ni`` and ``ne`` blocks; every block of events meets every index of a block of items (``ItemIndex``), which
    a task keeps, with its k-th scores, from one block of events to the next. A block of items goes to several tasks,
    each with a group of the events, so that few items with many events aren't one task. ``stats`` is an accumulator's ``add`` for
    (pairs looked at, pairs scored in full).
    """
    ib, eb = blocks(items, "item_id", ["item_id", "tok", "letters"], "ib", ni), blocks(events, "event_id", ["event_id", "last_seen_at", "rec", "tok", "letters", "titles", "keys"], "eb", ne)
    kinds = dict(items.dtypes) | dict(events.dtypes)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        known, at = None, None
        for batch in batches:
            for b in range(batch.num_rows):
                # A group comes with its items first, so one index is alive at a time.
                if batch.column(2)[b].as_py() is not None:
                    at, known = (batch.column(0)[b].as_py(), batch.column(1)[b].as_py()), ItemIndex(batch.column(2)[b].values, k, floor)
                    continue
                if at != (batch.column(0)[b].as_py(), batch.column(1)[b].as_py()):
                    continue  # no items
                theirs = batch.column(3)[b].values
                found: list[list] = [[], [], [], [], [], []]
                facts = zip(*(theirs.field(c).to_pylist() for c in ("tok", "letters", "titles", "keys", "rec")), strict=True)
                for e, (tok, letters, titles, keys, rec) in enumerate(facts):
                    got = known.score(tok, letters, titles, keys, rec)
                    if got is not None:
                        for col, x in zip(found, (np.full(len(got[0]), e), *got), strict=True):
                            col.append(x)
                if stats:
                    stats(known.pairs, known.scored)
                    known.pairs = known.scored = 0
                if found[0]:
                    e, i, *parts = (np.concatenate(x) for x in found)
                    # A k-th score of later in the block rules out more.
                    now = 0.35 * parts[0] + 0.35 * parts[1] + 0.15 * parts[2] + 0.10 * parts[3] + 0.05 * theirs.field("rec").to_numpy(zero_copy_only=False)[e]
                    good = now + 0.0002 >= known.kth[i]
                    e_at, i_at = pa.array(e[good]), pa.array(i[good])
                    yield pa.RecordBatch.from_arrays(
                        [known.ids.take(i_at), theirs.field("event_id").take(e_at), theirs.field("last_seen_at").take(e_at), *(pa.array(p[good], pa.float64()) for p in parts), theirs.field("rec").take(e_at)],
                        names=["item_id", "event_id", "last_seen_at", "tok", "gram", "rep", "key", "rec"],
                    )

    groups = min(ne, -(-TASKS // ni))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    both = ib.withColumn("group", every(groups)).unionByName(eb.select((F.col("eb") % groups).alias("group"), "eb_rows").withColumn("ib", every(ni)), allowMissingColumns=True)
    # A number of its own, which isn't brought down for small partitions: they are small in bytes and long in work.
    pairs = both.select("ib", "group", "ib_rows", "eb_rows").repartition(ni * groups, "ib", "group").sortWithinPartitions("ib", "group", F.col("eb_rows").isNotNull())
    out = f"item_id {kinds['item_id']}, event_id {kinds['event_id']}, last_seen_at {kinds['last_seen_at']}, tok double, gram double, rep double, key double, rec double"
    return pairs.mapInArrow(run, out)


def rule_pairs(items: DataFrame, events: DataFrame, at: Column, k: int, floor: float, stats=None) -> DataFrame:
    """``item_id, event_id, last_seen_at, tok, gram, rep, key, rec, score, features`` of the pairs above ``floor`` among
    which each item's best ``k`` are (``k`` 0: all)."""
    src = F.concat_ws(" ", F.trim("title"), F.trim("summary"))
    cand = F.concat_ws(" ", "canonical_title", "summary", F.concat_ws(" ", "entities"), F.concat_ws(" ", "representative_titles"), F.concat_ws(" ", "key_terms"), F.concat_ws(" ", "aliases"))
    some = lambda c: F.coalesce(F.col(c), strings([]))
    i = items.select("item_id", tokenize(src).alias("tok"), letters_and_digits(src).alias("letters"))
    e = events.select(
        "event_id", "last_seen_at", S.recency("status", "last_seen_at", at).alias("rec"), tokenize(cand).alias("tok"), letters_and_digits(cand).alias("letters"),
        F.transform(some("representative_titles"), letters_and_digits).alias("titles"), F.transform(some("key_terms"), lambda k: F.lower(F.trim(k))).alias("keys"),
    )
    # An index is a table of n-grams by items, so its items are fewer.
    df = shared_text(i, e, text_blocks(items, src, BLOCK_BYTES // 32), text_blocks(events, cand, BLOCK_BYTES), k, floor, stats)
    df = df.withColumn("score", S.recall_score("tok", "gram", "rep", "key", "rec")).where(F.col("score") > floor)
    return df.withColumn("features", S.recall_features("tok", "gram", "rep", "key", "rec")).select("item_id", "event_id", "last_seen_at", "tok", "gram", "rep", "key", "rec", "score", "features")


def rule_recall(items: DataFrame, events: DataFrame, at: Column, cfg: Config, floor: float = 0.08, stats=None) -> DataFrame:
    """``item_id, event_id, score, features``: the best ``candidate_limit`` events of each item above ``floor``.

    ``items(item_id, title, summary)``; ``events`` has titles and lists. Recency alone can't reach the floor, so a
    candidate shares a token or an n-gram with the item. Pairs that can't be among an item's best are skipped by upper
    bounds (``ItemIndex``); the rest is scored, rounded and ranked here.
    """
    return top_per("item_id", rule_pairs(items, events, at, max(1, cfg.candidate_limit), floor, stats), cfg.candidate_limit, F.desc("score"), F.desc("last_seen_at"), F.asc("event_id"))


def top_per(key: str, df: DataFrame, k: int, *order: Column) -> DataFrame:
    """The first ``max(1, k)`` rows of each key."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("__n") <= max(1, k)).drop("__n")


def spread_pivots(units: DataFrame, n: int, most: int = 4096) -> list:
    """``n`` unit vectors far apart from each other among the ``most`` of least hash (a documented, bounded sample)."""
    import numpy as np

    rows = units.orderBy(F.xxhash64("v")).limit(most).collect()
    v = np.array([r["v"] for r in rows]) if rows else np.empty((0, 0))
    chosen = [0] if len(v) else []
    near = v @ v[0] if len(v) else None
    while len(chosen) < min(n, len(v)):
        far = int(near.argmin())
        if near[far] > 1 - 1e-9:
            break
        chosen.append(far)
        near = np.maximum(near, v @ v[far])
    return v[chosen].tolist()


#: Slack of an angle's bound, in radians: doubles are good to far less. Rings of equal width around a pivot.
HAIR, RINGS = 1e-6, 64
#: Groups of blocks on either side of a vector search, and bytes of a group of events that a task holds.
TILES, TILE_BYTES = 8, 128 << 20


def vector_topk(queries: DataFrame, events: DataFrame, k: int, least: float, rows: int = BLOCK, stats=None) -> DataFrame:
    """``query_id, event_id, similarity``: exact cosine neighbours at ``least`` or above.

    ``queries(query_id, v)`` against ``events(event_id, v, last_seen_at)``. Vectors are dealt to their nearest *pivot*
    (``spread_pivots``, fitted on a bounded sample; every row is dealt), and those of a ring around it into blocks of about
    ``rows``. A block knows the least and greatest angle to its pivot. For a query at angle q from that pivot no vector of the block is
    nearer than the gap between q and that range, so a block of queries skips blocks whose gap exceeds the angle of
    ``least`` for all of its queries; of a block that is looked at, queries out of reach, and those whose k-th neighbour so
    far in the task is nearer than the gap, are left out of the product.

    Blocks are dealt to ``TILES`` groups on either side and every two groups are a task, so a vector is sent ``TILES`` times
    at most, however many there are; only groups of more than ``TILE_BYTES`` of events are cut into more. A task holds its
    events and one block of queries, and gives each query's best ``k`` in the final order, equals included, no more. Nothing
    is broadcast but the pivots. ``stats`` is an accumulator's ``add`` for (pairs in looked-at blocks, pairs multiplied).
    """
    import numpy as np

    q = queries.select("query_id", S.unit("v").alias("v")).where("v is not null").withColumn("size", F.size("v"))
    e = events.select("event_id", "last_seen_at", S.unit("v").alias("v")).where("v is not null").withColumn("size", F.size("v"))
    kinds = dict(q.dtypes) | dict(e.dtypes)
    count, sizes, numbers = e.agg(F.count("*"), F.collect_set("size"), F.coalesce(F.sum("size"), F.lit(0))).first()
    tiles = lambda n: int(max(1, min(TILES, -(-n // max(1, rows)))))
    q_tiles, e_tiles = tiles(q.count()), max(tiles(count), -(-8 * numbers // TILE_BYTES))
    n_pivots = int(max(1, min(256, (count // max(1, rows)) + 1, round(count**0.5))))
    pivots = {s: spread_pivots(e.where(F.col("size") == s).select("v"), n_pivots) for s in sizes}
    reach = float(np.arccos(min(1.0, max(-1.0, least)))) + HAIR

    def placed(ids: str, extra: list[str]):
        """Adds the nearest pivot and the angle to it."""
        fields = f"{ids} {kinds[ids]}, " + "".join(f"{c} {kinds[c]}, " for c in extra) + "v array<double>, size int, pivot int, angle double"

        def run(batches):
            import pyarrow as pa

            for batch in batches:
                sizes_, at, angle = batch.column("size").to_numpy(), np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows)
                for s in np.unique(sizes_).tolist():
                    own = np.flatnonzero(sizes_ == s)
                    v = batch.column("v").take(pa.array(own)).flatten().to_numpy(zero_copy_only=False).reshape(len(own), -1)
                    cos = np.clip(v @ np.array(pivots[s]).T, -1, 1) if pivots.get(s) else np.ones((len(own), 1))
                    at[own], angle[own] = cos.argmax(axis=1), np.arccos(cos.max(axis=1))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at), pa.array(angle)], names=[*batch.schema.names, "pivot", "angle"])

        return run, fields

    q, e = (df.select(i, *x, "v", "size").mapInArrow(*placed(i, x)) for df, i, x in ((q, "query_id", []), (e, "event_id", ["last_seen_at"])))

    def in_blocks(df: DataFrame, key: str, columns: list[str], name: str, groups: int) -> DataFrame:
        """A ring's rows in blocks of about ``rows``, each in one of ``groups``."""
        df = df.withColumn("ring", F.floor(F.col("angle") * (RINGS / np.pi)))
        counts = df.groupBy("size", "pivot", "ring").agg(F.count("*").alias("n")).collect()  # a few thousand rows at most
        lots, fill = [], {}
        for size, pivot, ring, n in sorted(map(tuple, counts)):
            # Neighbouring rings share a block as long as they fit; a full ring is dealt by hash.
            start, held = fill.get((size, pivot), (ring, 0))
            start, held = (ring, n) if held and held + n > rows else (start, held + n)
            fill[size, pivot] = start, held
            lots.append((size, pivot, ring, start, -(-n // rows)))
        lots = df.sparkSession.createDataFrame(lots, "size int, pivot int, ring long, block long, lots long")
        dealt = df.join(F.broadcast(lots), ["size", "pivot", "ring"]).withColumn("lot", F.pmod(F.xxhash64(F.col(key).cast("string")), F.col("lots")))
        out = dealt.groupBy("size", "pivot", "block", "lot").agg(F.min("angle").alias("low"), F.max("angle").alias("high"), F.collect_list(F.struct(*columns)).alias("rows"))
        group = F.pmod(F.xxhash64("size", "pivot", "block", "lot"), F.lit(groups)).cast("int").alias(f"{name}_tile")
        return out.select(group, "size", "pivot", "low", "high", F.col("rows").alias(f"{name}_rows"))

    qb, eb = in_blocks(q, "query_id", ["query_id", "v"], "q", q_tiles), in_blocks(e, "event_id", ["event_id", "last_seen_at", "v"], "e", e_tiles)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    both = eb.withColumn("q_tile", every(q_tiles)).unionByName(qb.withColumn("e_tile", every(e_tiles)), allowMissingColumns=True)
    # A tile's events come before its queries.
    both = both.select("q_tile", "e_tile", F.col("q_rows").isNotNull().alias("asks"), "size", "pivot", "low", "high", "q_rows", "e_rows")
    both = both.repartition(q_tiles * e_tiles, "q_tile", "e_tile").sortWithinPartitions("q_tile", "e_tile", "asks")
    # Angle of two pivots, less the block's own spreads: the least angle between their vectors (triangle inequality on the sphere).
    apart = {s: np.arccos(np.clip(np.array(p) @ np.array(p).T, -1, 1)) * (1 - np.eye(len(p))) for s, p in pivots.items() if p}
    k = max(1, k)

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        def matrix(x, size):
            return x.field("v").flatten().to_numpy(zero_copy_only=False).reshape(len(x), size)

        tile, blocks_, held = None, [], None
        for batch in batches:
            for n in range(batch.num_rows):
                at, size, pivot, low, high = (batch.column(0)[n].as_py(), batch.column(1)[n].as_py()), *(batch.column(c)[n].as_py() for c in range(3, 7))
                if at != tile:
                    tile, blocks_, held = at, [], None
                if not batch.column(2)[n].as_py():
                    # A copy, so that no batch stays alive for its sake.
                    x = pa.concat_arrays([batch.column(8)[n].values, batch.column(8)[n].values.slice(0, 0)])
                    blocks_.append((size, pivot, low, high, x))
                    continue
                if held is None:
                    held = EventTile(blocks_, matrix)
                mine = batch.column(7)[n].values
                if size not in held.size or size not in apart:
                    continue
                a, angles = matrix(mine, size), np.arccos(np.clip(matrix(mine, size) @ np.array(pivots[size]).T, -1, 1))
                best = Best(len(a), k, least)
                own = held.size[size]
                gap = np.maximum.reduce((apart[size][pivot, own["pivot"]] - high - own["high"], own["low"] - apart[size][pivot, own["pivot"]] - high, low - apart[size][pivot, own["pivot"]] - own["high"]))
                for i in np.argsort(gap, kind="stable").tolist():
                    if gap[i] > reach:
                        break
                    b, place = own["v"][i], own["at"][i]
                    t = angles[:, own["pivot"][i]]
                    nearest = np.cos(np.clip(np.maximum(t - own["high"][i], own["low"][i] - t) - HAIR, 0, np.pi))
                    use = np.flatnonzero(nearest >= best.bar - 1e-9)
                    if stats:
                        stats(len(a) * len(b), len(use) * len(b))
                    if len(use):
                        best.add(use, a[use] @ b.T, place, held.rank)
                r, sim, place = best.rows()
                if len(r):
                    p = pa.array(place)
                    yield pa.RecordBatch.from_arrays([mine.field("query_id").take(pa.array(r)), pc.take(held.ids, p), pc.take(held.seen, p), pa.array(sim, pa.float64())], names=["query_id", "event_id", "last_seen_at", "similarity"])

    sim = both.mapInArrow(run, f"query_id {kinds['query_id']}, event_id {kinds['event_id']}, last_seen_at {kinds['last_seen_at']}, similarity double")
    return top_per("query_id", sim, k, F.desc("similarity"), F.desc("last_seen_at"), F.asc("event_id"))


class EventTile:
    """The events of a task: their blocks by number of dimensions, and each event's rank among equally similar ones."""

    def __init__(self, blocks_: list[tuple], matrix):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        self.size: dict = {}
        ids, seen, start = [], [], 0
        for size, pivot, low, high, x in blocks_:
            own = self.size.setdefault(size, {"pivot": [], "low": [], "high": [], "v": [], "at": []})
            for name, value in zip(("pivot", "low", "high", "v", "at"), (pivot, low, high, matrix(x, size), start), strict=True):
                own[name].append(value)
            ids.append(x.field("event_id"))
            seen.append(x.field("last_seen_at"))
            start += len(x)
        for own in self.size.values():
            own |= {c: np.array(own[c]) for c in ("pivot", "low", "high")}
        self.ids, self.seen = (pa.concat_arrays(x) if x else pa.array([]) for x in (ids, seen))
        order = pc.sort_indices(pa.table({"seen": self.seen, "id": self.ids}), sort_keys=[("seen", "descending"), ("id", "ascending")]).to_numpy()
        self.rank = np.empty(start, np.int64)
        self.rank[order] = np.arange(start)


class Best:
    """The best ``k`` events so far of each query of a block, by similarity and, of equals, by rank; ``bar`` is what a
    further one must reach: the k-th similarity, or the least one that counts."""

    def __init__(self, n: int, k: int, least: float):
        import numpy as np

        self.n, self.k, self.bar, self.last = n, k, np.full(n, least), np.full(n, np.iinfo(np.int64).max)
        self.kept = (np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64), np.empty(0, np.int64))
        self.more, self.size = [], 0

    def add(self, use, product, start: int, rank):
        """A block of products of the queries ``use`` with the events from place ``start`` on."""
        import numpy as np

        i, j = np.nonzero(product >= self.bar[use][:, None] - 1e-11)
        # A product's last bits depend on the blocks' shapes; equal vectors stay equal without them.
        sim, row, place = np.round(product[i, j], 12), use[i], start + j
        good = (sim > self.bar[row]) | ((sim == self.bar[row]) & (rank[place] < self.last[row]))
        if good.any():
            self.more.append((row[good], sim[good], rank[place[good]], place[good]))
            self.size += int(good.sum())
            if self.size > self.n * self.k:
                self.fold()

    def fold(self):
        import numpy as np

        row, sim, rank, place = (np.concatenate(x) for x in zip(self.kept, *self.more, strict=True))
        order = np.lexsort((rank, -sim, row))
        row = row[order]
        nth = np.arange(len(row)) - np.searchsorted(row, row)
        keep = order[nth < self.k]
        full = order[nth == self.k - 1]
        self.kept, self.more, self.size = (row[nth < self.k], sim[keep], rank[keep], place[keep]), [], 0
        at = row[nth == self.k - 1]
        self.bar[at], self.last[at] = sim[full], rank[full]

    def rows(self):
        """(query's row, similarity, event's place)."""
        if self.more:
            self.fold()
        return self.kept[0], self.kept[1], self.kept[3]


def composite(rule: DataFrame, vector: DataFrame) -> DataFrame:
    """Candidates of both recalls by item and event: the higher score, and all features, the rule's first."""
    v = vector.select("item_id", "event_id", F.bround("similarity", 4).alias("score"), F.array(F.lit("vector_cosine_similarity"), F.concat(F.lit("cosine_similarity:"), F.format_string("%.4f", "similarity"))).alias("features"), F.lit(1).alias("o"))
    both = rule.select("item_id", "event_id", "score", "features", F.lit(0).alias("o")).unionByName(v)
    lists = F.transform(F.sort_array(F.collect_list(F.struct("o", "features"))), lambda x: x["features"])
    return both.groupBy("item_id", "event_id").agg(F.max("score").alias("score"), distinct_ci(F.flatten(lists)).alias("features"))


def fingerprint(candidates: Column) -> Column:
    """A digest of an ordered candidate list, to tell whether it changed."""
    return F.sha2(F.array_join(F.transform(candidates, lambda c: F.concat_ws("|", c["event_id"], c["score"].cast("string"), F.array_join(c["features"], ","))), ";"), 256)


def revalidate(before: DataFrame, after: DataFrame, matched: DataFrame) -> DataFrame:
    """``item_id``: matches to be decided again before they are committed. Those that would found a new event are, if
    their candidates have changed since (``before`` and ``after``: item_id, event_id, score, features)."""

    def prints(c: DataFrame, name: str) -> DataFrame:
        rows = F.transform(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "event_id", "features"))), lambda x: F.struct(x["event_id"].alias("event_id"), (-x["s"]).alias("score"), F.array_sort(x["features"]).alias("features")))
        return c.groupBy("item_id").agg(fingerprint(rows).alias(name))

    open_ = matched.where("event_id is null").select("item_id")
    both = open_.join(prints(before, "p"), "item_id", "left").join(prints(after, "q"), "item_id", "left")
    return both.where(~F.col("p").eqNullSafe(F.col("q"))).select("item_id")


def joins(pairs: DataFrame, cfg: Config) -> DataFrame:
    """Pairs whose rule score merges them without a model."""
    return pairs.where((F.col("score") >= cfg.rule_merge_threshold) & F.array_contains("features", "token_overlap") & F.array_contains("features", "char_ngram_jaccard"))


def settle(order: DataFrame, pairs: DataFrame, cut: Callable[[str, DataFrame], DataFrame], most: int = 1000) -> DataFrame:
    """``item_id, founder, score``: which items found an event (founder is the item) and which join an earlier one's.

    ``order(item_id, place)`` is the order of commits; ``pairs(item_id, other, score)``: an item could join the event that
    ``other``, of a smaller place, would found. As if committed one by one: an item joins the best founder before it, or
    founds an event if there is none. It goes by rounds: open items without an open one before them found, and open items
    with a founder before them join, whatever else comes before them. Which founder is best is asked once, at the end.
    A round's pairs are those between items that it leaves open, so items that are all alike take one round.
    """
    pairs = pairs.join(order.withColumnRenamed("place", "p"), "item_id").join(order.select(F.col("item_id").alias("other"), F.col("place").alias("q")), "other").where("q < p").select("item_id", "other", "score", "q")
    pairs = cut("settle_pairs", pairs)
    founders = cut("founders_0", order.join(pairs.select("item_id").distinct(), "item_id", "left_anti").select("item_id"))
    fresh, edges = founders, pairs.select("item_id", "other")
    for n in range(1, most):
        named = fresh.select(F.col("item_id").alias("other"))
        joined = edges.join(named, "other", "left_semi").select("item_id").distinct()
        # Whoever joins founds nothing, so its pairs with later items go, too; those of founders are done with.
        left = cut(f"open_{n}", edges.select("item_id").distinct().join(joined, "item_id", "left_anti"))
        if left.isEmpty():
            break
        edges = cut(f"edges_{n}", edges.join(left, "item_id", "left_semi").join(left.select(F.col("item_id").alias("other")), "other", "left_semi").select("item_id", "other"))
        fresh = cut(f"founders_{n}", left.join(edges.select("item_id").distinct(), "item_id", "left_anti"))
        founders = founders.unionByName(fresh)
    else:
        raise RuntimeError("commits did not settle")
    best = F.min(F.struct((-F.col("score")).alias("s"), "q", "other"))
    joins_ = pairs.join(founders, "item_id", "left_anti").join(founders.select(F.col("item_id").alias("other")), "other", "left_semi").groupBy("item_id").agg(best.alias("b"))
    return founders.select("item_id", F.col("item_id").alias("founder"), F.lit(1.0).alias("score")).unionByName(joins_.select("item_id", F.col("b.other").alias("founder"), (-F.col("b.s")).alias("score")))


def settle_alike(members: DataFrame, pairs: DataFrame, cut: Callable[[str, DataFrame], DataFrame]) -> DataFrame:
    """``settle`` of items many of which are alike: ``members(item_id, place, first)`` names the first, by place, of the
    items that are like an item, and ``pairs(item_id, other, score)`` are of firsts only, a first with itself included.

    A founder rules out all later items that it is related to, so the first of a kind decides for its kind: if it joins,
    all do; if it founds, the later ones join unless they are no match for it and nothing else was founded between. The
    founders that a kind can join become one list of those that were the best when they came, from which each member
    takes the last one before it; alike items are never paired with each other.
    """
    firsts = members.where(F.col("item_id") == F.col("first")).select("item_id", "place")
    settled = cut("settled_firsts", settle(firsts, pairs.where("item_id <> other"), cut))
    founds = settled.where(F.col("item_id") == F.col("founder")).select(F.col("item_id").alias("other")).join(firsts.select(F.col("item_id").alias("other"), F.col("place").alias("q")), "other")
    met = pairs.join(founds, "other").select(F.col("item_id").alias("first"), "score", "q", "other")
    so_far = Window.partitionBy("first").orderBy("q").rowsBetween(Window.unboundedPreceding, -1)
    record = met.withColumn("before", F.max("score").over(so_far)).where("before is null or score > before")
    lists = record.groupBy("first").agg(F.sort_array(F.collect_list(F.struct("q", "score", "other"))).alias("best"))
    last = F.element_at(F.filter("best", lambda x: x["q"] < F.col("place")), -1)
    # An empty list has no last element.
    chosen = members.join(lists, "first", "left").withColumn("b", F.when(F.exists("best", lambda x: x["q"] < F.col("place")), last))
    return chosen.select("item_id", F.coalesce("b.other", "item_id").alias("founder"), F.coalesce("b.score", F.lit(1.0)).alias("score"))


def decide(items: DataFrame, candidates: DataFrame, cfg: Config, replies: DataFrame | None = None) -> DataFrame:
    """``item_id, event_id (null: new event), confidence, decision, by``.

    The best candidate decides alone if it scores ``rule_merge_threshold`` with both text features; otherwise a reply
    (``item_id, decision, event_id, confidence``) does, if there is one; otherwise the event is new.
    """
    best = candidates.groupBy("item_id").agg(
        F.min(F.struct((-F.col("score")).alias("s"), "event_id", "features")).alias("b"), F.collect_set("event_id").alias("ids")
    )
    df = items.select("item_id").join(best, "item_id", "left")
    strong = (-F.col("b.s") >= cfg.rule_merge_threshold) & F.array_contains("b.features", "token_overlap") & F.array_contains("b.features", "char_ngram_jaccard")
    df = df.withColumn("rule", F.coalesce(strong, F.lit(False)))
    if replies is not None:
        df = df.join(replies.select("item_id", F.col("decision").alias("r_decision"), F.col("event_id").alias("r_event"), F.col("confidence").alias("r_conf")), "item_id", "left")
    else:
        df = df.withColumns({"r_decision": F.lit(None).cast("string"), "r_event": F.lit(None).cast("string"), "r_conf": F.lit(None).cast("double")})
    known = F.array_contains(F.coalesce("ids", strings([])), F.col("r_event").cast("string")) if dict(candidates.dtypes)["event_id"] == "string" else F.array_contains("ids", F.col("r_event"))
    least = F.when(F.col("r_decision") == "same_event", cfg.merge_threshold).when(F.col("r_decision") == "follow_up", cfg.stale_merge_threshold)
    merge = F.coalesce((F.col("r_conf") >= least) & known, F.lit(False))
    return df.select(
        "item_id", F.when(F.col("rule"), F.col("b.event_id")).when(merge, F.col("r_event")).alias("event_id"),
        F.when(F.col("rule"), -F.col("b.s")).when(merge, F.col("r_conf")).otherwise(1.0).alias("confidence"),
        F.when(F.col("rule"), "same_event").when(merge, F.col("r_decision")).otherwise("create_new").alias("decision"),
        F.when(F.col("rule"), "rule").when(F.col("r_decision").isNotNull(), "model").otherwise("none").alias("by"),
    )
