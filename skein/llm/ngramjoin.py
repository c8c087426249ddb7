"""Self-join of documents by n-gram Jaccard similarity, with prefix filters under several global orders.

Sets are the distinct 5-word shingles, as 64-bit hashes; equal sets are one class, and classes are joined.

With J(a, b) >= t, at most n - ceil(t n) shingles of either set are missing from the other. So under any global
order the first p(n) shingles of both hold the same first l = p(n) - n + ceil(t n) shared ones.

- Order 1 is the hash. Each set posts its first p(n) shingles: all of a small set, a quarter of a large one.
- Order 2 is (number of classes that post the shingle, hash): rare first, counted exactly over all postings. Among
  the posted shingles of a pair, m = the least l of any size that can be a partner's are shared, so the pair shares
  one of the first p(n) - m + 1 under order 2. Shingles that nobody else posts come first and can't be shared: a
  set with more of them than p(n) - m links with nothing, and leaves without any pair being formed. Passages that
  many documents share stand last and are not reached, unless a set consists of little else.
- Order 3 is the hash from its upper end. A pair shares one of its last n - ceil(t n) + 1 shingles.

A candidate shares a prefix shingle under order 2 inside its prefix under order 1, passes the length filter, and shares
a prefix shingle under order 3; what is left is verified exactly on the sets, which are made again from the text.

Only components are asked for, so no group of copies is expanded into all its pairs. First every class is tried with
one hub (the smallest class met most often in its lists). Lists that then still hold several components are refined:
their classes' whole sets are counted, and a shingle that no other component holds can't be part of a further link. A
set of n with k other shingles needs a partner of 2.25 k - n at most, which rules out the copies that have strayed too
far from all others, before any pair is formed. The rest is ordered anew by rarity (order 2 over whole sets, with its
prefix, length, position and count filters), tried with further hubs, and what still holds several components pair by
pair.

Defined results: null, empty or wordless text has an empty set and is linked with nothing; with fewer than five
words the whole sequence is one shingle; repeated rows fall into one class; a component's id is the smallest doc_id
(nulls aside) of its rows; an empty table gives no rows; extra columns are dropped. The input must be a
deterministic scan, because rows are numbered in reading order.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, components, read, semi_join_ids, small_batches

N = 5
#: Similarity as a fraction: 80 of 100.
PERCENT = 80
#: Sets up to this size post everything, larger ones SHARE percent but no less.
ALL, SHARE = 100, 25

_P = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * _M1
        h = (h ^ (h >> np.uint64(27))) * _M2
        return h ^ (h >> np.uint64(31))


_WORDS: dict[bytes, int] = {}


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hashes; those of the last hundred thousand different words are remembered."""
    import xxhash

    get, one = _WORDS.get, xxhash.xxh64_intdigest
    out = list(map(get, words))
    if None in out:
        if len(_WORDS) > 100_000:
            _WORDS.clear()
        for i, h in enumerate(out):
            if h is None:
                out[i] = _WORDS[words[i]] = one(words[i])
    return np.array(out, np.uint64)


def shingles(text: bytes | None, n: int = N) -> np.ndarray:
    """The sorted set of hashes of ``n`` consecutive words (of bytes, lower changes only A-Z, and split cuts at exactly
    the six ASCII spaces)."""
    words = text.lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    h = word_hashes(words)
    k = min(n, len(words))
    size = len(words) - k + 1
    out = np.full(size, k, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            out = mix(out * _P + h[j : j + size])
    return np.unique(out)


def least_shared(n: int, percent: int = PERCENT) -> int:
    return -(-percent * n // 100)


def posted(n: int) -> int:
    """p(n): how many shingles a set of n posts under order 1."""
    return min(n, max(n - least_shared(n) + 1, ALL, -(-SHARE * n // 100)))


def surely_shared(n: int, percent: int = PERCENT) -> int:
    """m(n): shared shingles among those posted by a set of n and by any partner of it."""
    low, high = -(-percent * n // 100), 100 * n // percent
    sizes = {low, high, n, *(s for s in (ALL, ALL * 100 // SHARE) if low <= s <= high), *(s + 1 for s in (ALL, ALL * 100 // SHARE) if low <= s + 1 <= high)}
    # l(s) is piecewise linear up to rounding, which the last term covers.
    return max(1, min(posted(s) - s + least_shared(s) for s in sizes) - 2)


def similar(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)) or not len(a):
        return False
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    same = int(np.count_nonzero(b[at] == a))
    return 100 * same >= percent * (len(a) + len(b) - same)


def sets(rows: DataFrame) -> DataFrame:
    """``rid, doc_id, n, key`` (128-bit hash of the set), ``reach`` (p - m + 1) and ``post`` (under order 1)."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            n, key, reach, post = [], [], [], []
            for t in batch.column(2):
                s = shingles(t.as_py())
                n.append(len(s))
                key.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                p = posted(len(s))
                reach.append(p - surely_shared(len(s)) + 1)
                # The hash order itself: np.unique has sorted.
                post.append(s[:p].view(np.int64))
            offsets = np.concatenate(([0], np.cumsum([len(x) for x in post]))).astype(np.int32)
            values = np.concatenate(post) if post else np.empty(0, np.int64)
            arrays = [batch.column(0), batch.column(1).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(key, pa.binary()), pa.array(reach, pa.int32())]
            yield pa.RecordBatch.from_arrays([*arrays, pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))], names=["rid", "doc_id", "n", "key", "reach", "post"])

    return rows.mapInArrow(run, "rid bigint, doc_id bigint, n bigint, key binary, reach int, post array<bigint>")


def candidates_lists(classes: DataFrame, scratch: Scratch) -> DataFrame:
    """``tok, c, n``: the classes that reach each posted shingle under order 2 and have company there."""
    # Only (shingle, class) is exchanged; sizes are joined to the few rows that are left.
    posts = classes.select("c", F.explode("post").alias("tok")).repartition("tok")
    counts = posts.groupBy("tok").agg(F.count("*").alias("df")).where("df > 1")
    shared = scratch.cut(posts.join(counts, "tok"))
    # Unshared shingles are the first of order 2: they are the p - (shared) ones that this table lacks.
    met = shared.groupBy("c").agg(F.count("*").alias("k")).join(classes.select("c", "n", F.size("post").alias("p"), "reach"), "c")
    met = met.withColumn("left", F.col("reach") - (F.col("p") - F.col("k"))).where("left > 0").select("c", "n", "left")
    ranked = shared.join(met, "c").withColumn("i", F.row_number().over(Window.partitionBy("c").orderBy("df", "tok")))
    near = scratch.cut(ranked.where("i <= left").select("tok", "c", "n"))
    alive = near.groupBy("tok").agg(F.count("*").alias("df")).where("df > 1")
    out = scratch.cut(near.join(alive.select("tok"), "tok", "left_semi"))
    scratch.drop(near, shared)
    return out


def verified(pairs: DataFrame, rows: DataFrame, scratch: Scratch) -> DataFrame:
    """The pairs ``a, b`` of classes whose sets are similar; a class's set is made from its first row's text. Pairs
    without a shared prefix shingle under order 3 can't be and aren't compared."""
    ids = pairs.select("a").unionByName(pairs.select(F.col("b").alias("a"))).distinct().withColumnRenamed("a", "rid")

    def make(batches):
        import pyarrow as pa

        for batch in batches:
            made = [shingles(t.as_py()) for t in batch.column(1)]
            last = [x[least_shared(len(x)) - 1 :].view(np.int64) if len(x) else x.view(np.int64) for x in made]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(last, pa.list_(pa.int64())), pa.array([x.tobytes() for x in made], pa.binary())], names=["rid", "last", "s"])

    made = scratch.cut(semi_join_ids(rows.select("rid", "t"), ids, "rid", scratch).mapInArrow(make, "rid bigint, last array<bigint>, s binary"))
    # Pairs grow with the input: sets meet them by exchange at every size, and AQE splits hot hubs.
    side = lambda c: made.select(F.col("rid").alias(c), F.col("last").alias(f"l{c}"), F.col("s").alias(f"s{c}")).hint("merge")
    both = pairs.join(side("a"), "a").join(side("b"), "b").where(F.arrays_overlap("la", "lb"))

    def test(batches):
        import pyarrow as pa

        for batch in batches:
            get = lambda x: np.frombuffer(x.as_py(), np.uint64)
            keep = pa.array([similar(get(x), get(y)) for x, y in zip(batch.column(2), batch.column(3))], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])

    out = scratch.cut(both.select("a", "b", "sa", "sb").mapInArrow(test, "a bigint, b bigint"))
    scratch.drop(made)
    return out


#: The length filter of a pair.
FITS = f"100 * least(na, nb) >= {PERCENT} * greatest(na, nb)"
#: Rounds of hubs beyond the first, hubs that a list offers in each, and hubs that a class tries in each.
ROUNDS, OFFERS, TRIES = 1, 4, 3


def comps_of(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``c, comp`` of the linked classes."""
    return components(edges.select(F.col("a").alias("src"), F.col("b").alias("dst")), scratch).withColumnRenamed("node", "c")


def still_open(lists: DataFrame, comp: DataFrame, tried: DataFrame, scratch: Scratch) -> DataFrame:
    """The lists (with ``comp``) whose classes aren't yet in one component, but for those of two classes that have been
    tried with each other (``tried`` has a < b)."""
    placed = lists.drop("comp").join(comp, "c", "left").withColumn("comp", F.coalesce("comp", "c"))
    open_ = placed.groupBy("tok").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min("c").alias("a"), F.max("c").alias("b"), F.count("*").alias("size")).where("lo < hi")
    # Lists of more classes stay open: they get a null pair, which nothing equals.
    pair = [F.when(F.col("size") == 2, F.col(x)).alias(x) for x in "ab"]
    open_ = open_.select("tok", *pair).join(tried, ["a", "b"], "left_anti").select("tok")
    return scratch.cut(placed.join(open_, "tok", "left_semi"))


#: Passes over the refined lists that drop what the passes before have made hopeless (any number is right).
PEELS = 3


def refined(placed: DataFrame, rows: DataFrame, scratch: Scratch) -> DataFrame:
    """``tok, c, n, comp, df, cap, least_low``: the shingles that several components hold, of the whole sets of the
    classes in open lists. ``cap`` is the largest partner that a class's shingles here allow, ``least_low`` the smallest
    one that it meets, ``df`` the number of classes with the shingle."""
    open_ = scratch.cut(placed.groupBy("c").agg(F.first("n").alias("n"), F.first("comp").alias("comp")))

    def make(batches):
        import pyarrow as pa

        for batch in batches:
            made = [shingles(t.as_py()).view(np.int64) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.list_(pa.int64()))], names=["c", "toks"])

    texts = semi_join_ids(rows.select("rid", "t"), open_.select(F.col("c").alias("rid")), "rid", scratch)
    full = scratch.cut(texts.mapInArrow(make, "c bigint, toks array<bigint>").join(open_, "c").select("c", "n", "comp", F.explode("toks").alias("tok")))
    least = F.ceil(F.lit(PERCENT) * F.col("n") / 100)
    for _ in range(PEELS):
        lists = full.groupBy("tok").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min("n").alias("low"), F.count("*").alias("df"))
        cross = full.join(lists.where("lo < hi").select("tok", "low", "df"), "tok")
        fate = cross.groupBy("c").agg(F.first("n").alias("n"), F.count("*").alias("shared"), F.min("low").alias("least_low"))
        fate = fate.withColumn("cap", F.floor(F.lit(100 + PERCENT) * F.col("shared") / PERCENT) - F.col("n")).where(F.col("cap") >= F.greatest(least, F.col("least_low")))
        kept = scratch.cut(cross.join(fate.select("c", "cap", "least_low"), "c").where("low <= cap").drop("low"))
        scratch.drop(full)
        full = kept.select("tok", "c", "n", "comp")
    return kept


def least_size():
    """The smallest partner that a class can have."""
    return F.greatest("least_low", F.ceil(F.lit(PERCENT) * F.col("n") / 100))


def prefixes(kept: DataFrame, scratch: Scratch) -> DataFrame:
    """Prefix lists under order 2 over whole sets: adds ``k``, the class's shingles in ``kept``, and the place ``i``."""
    by_class = Window.partitionBy("c")
    need = F.ceil(F.lit(PERCENT) * (F.col("n") + least_size()) / (100 + PERCENT))
    ranked = kept.withColumn("k", F.count("*").over(by_class)).withColumn("i", F.row_number().over(by_class.orderBy("df", "tok")))
    return scratch.cut(ranked.where(F.col("i") <= F.col("k") - need + 1))


#: Shingles beyond its prefix that a class is compared by before its set is (any number is right).
EXTRA = 256


def pairs_across(lists: DataFrame, kept: DataFrame) -> DataFrame:
    """``a, b``: pairs of different components in open lists that pass the length, position and count filters.

    A pair is formed at the first shingle that both have under order 2, so once. The count filter looks at the first
    shingles of both, ``EXTRA`` more than the prefixes: of the one whose part ends first, a shared shingle is either in
    both parts, or beyond that end, where only so many are left.
    """
    need = F.ceil(F.lit(PERCENT) * (F.col("n") + least_size()) / (100 + PERCENT))
    of = kept.join(lists.select("c").distinct(), "c", "left_semi").groupBy("c").agg(F.sort_array(F.collect_list(F.struct("df", "tok"))).alias("all"), F.first("n").alias("n"), F.first("least_low").alias("least_low"))
    of = of.withColumn("part", F.slice("all", 1, F.greatest(F.size("all") - need + 1 + EXTRA, F.lit(1)).cast("int")))
    of = of.select("c", F.transform("part", lambda x: x["tok"]).alias("part"), F.element_at("part", -1).alias("end"), (F.size("all") - F.size("part")).alias("rest"))
    lists = lists.withColumn("left", F.expr("k - i + 1")).join(of, "c")
    columns = ("c", "n", "comp", "cap", "left", "part", "end", "rest")
    x, y = (lists.select("tok", *[F.col(o).alias(n) for o, n in zip(columns, names)]) for names in (("a", "na", "ca", "capa", "la", "pa", "ea", "ra"), ("b", "nb", "cb", "capb", "lb", "pb", "eb", "rb")))
    enough = lambda shared: f"{100 + PERCENT} * ({shared}) >= {PERCENT} * (na + nb)"
    shared = "array_intersect(pa, pb)"
    count = f"get({shared}, 0) = tok and " + enough(f"size({shared}) + case when ea <= eb then ra else rb end")
    found = x.join(y, "tok").where("ca < cb").where(FITS).where(f"nb <= capa and na <= capb and {enough('least(la, lb)')}").where(count)
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def other_hubs(placed: DataFrame, seed: int) -> DataFrame:
    """``a, b``: each class with the hubs of lower components that it meets most often, a fixed number of them."""
    hash_ = lambda j: F.xxhash64(F.lit(seed * OFFERS + j), "c")
    offers = placed.groupBy("tok").agg(F.array_distinct(F.array(*[F.min(F.struct(hash_(j).alias("h"), F.col("c").alias("a"), F.col("n").alias("na"), F.col("comp").alias("ca"))) for j in range(OFFERS)])).alias("o"))
    met = placed.join(offers, "tok").select("c", "n", "comp", F.explode("o").alias("o")).where("o.ca < comp")
    met = met.where(f"100 * least(n, o.na) >= {PERCENT} * greatest(n, o.na)").groupBy("c", "o.a").count()
    w = Window.partitionBy("c").orderBy(F.desc("count"), "a")
    return met.withColumn("i", F.row_number().over(w)).where(f"i <= {TRIES}").select(F.least("a", "c").alias("a"), F.greatest("a", "c").alias("b")).distinct()


def jaccard_components(docs: DataFrame) -> DataFrame:
    """``rid, doc_id, n_shingles, comp, component_id, links`` for every row, rid being its number in reading order;
    ``comp`` is the component's first class, which null or repeated doc_ids can't confuse; ``links`` counts verified
    links of its class."""
    spark = docs.sparkSession
    small_batches(spark)
    scratch = Scratch(spark, "jaccard")
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("`doc_id`").cast("long").alias("doc_id"), F.col("`text`").cast("binary").alias("t"))
    made = scratch.cut(sets(rows))
    # A class is named by its first row; all rows of a class have the same shingles.
    classes = scratch.cut(made.groupBy("key").agg(F.min("rid").alias("c"), F.min("doc_id").alias("least"), F.first("n").alias("n")))
    firsts = semi_join_ids(made, classes.where("n > 0").select(F.col("c").alias("rid")), "rid", scratch).withColumnRenamed("rid", "c")
    lists = candidates_lists(firsts, scratch)
    hubs = lists.groupBy("tok").agg(F.min(F.struct("c", "n")).alias("h"))
    star = lists.join(hubs, "tok").select("c", F.col("n").alias("na"), F.col("h.c").alias("hub"), F.col("h.n").alias("nb")).where("c <> hub")
    star = star.where(FITS).groupBy("c", "hub").count()
    best = star.groupBy("c").agg(F.max(F.struct("count", F.col("hub").alias("a"))).alias("x"))
    tried = scratch.cut(best.select("x.a", F.col("c").alias("b")))
    edges = verified(tried, rows, scratch)

    # Copies of one text differ from each other more than from it, so one hub doesn't join them all: classes that
    # are still apart, and not ruled out, try the hubs that other hashes pick from their lists, TRIES a round.
    comp = comps_of(edges, scratch)
    kept = refined(still_open(lists, comp, tried, scratch), rows, scratch)
    lists = prefixes(kept, scratch)
    for seed in range(ROUNDS):
        placed = still_open(lists, comp, tried, scratch)
        if placed.isEmpty():
            break
        more = scratch.cut(other_hubs(placed, seed).join(tried, ["a", "b"], "left_anti"))
        edges = scratch.cut(edges.unionByName(verified(more, rows, scratch)))
        tried = scratch.cut(tried.unionByName(more))
        comp = comps_of(edges, scratch)
    # What even then is open is tried pair by pair.
    across = pairs_across(still_open(lists, comp, tried, scratch), kept).join(tried, ["a", "b"], "left_anti")
    edges = scratch.cut(edges.unionByName(verified(scratch.cut(across), rows, scratch)))
    comp = comps_of(edges, scratch)

    named = classes.join(comp, "c", "left").withColumn("comp", F.coalesce("comp", "c"))
    names = named.groupBy("comp").agg(F.min("least").alias("component_id"))
    links = edges.select(F.explode(F.array("a", "b")).alias("c")).groupBy("c").agg(F.count("*").alias("links"))
    named = scratch.cut(named.join(names, "comp").join(links, "c", "left").select("key", "n", "comp", "component_id", F.coalesce("links", F.lit(0)).alias("links")))
    scratch.keep(made, named)
    out = made.select("rid", "doc_id", "key").join(named, "key")
    alone = F.col("n") == 0
    return out.select("rid", "doc_id", F.col("n").alias("n_shingles"), "comp", F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), "links")


def dedup_documents(docs: DataFrame) -> DataFrame:
    """One document of each component stays: that of the smallest doc_id (then the first row); documents without
    shingles all stay. The columns are the input's."""
    found = jaccard_components(docs)
    first = found.where("n_shingles > 0").groupBy("comp").agg(F.min(F.struct("doc_id", "rid")).alias("f"))
    keep = first.select("f.rid").unionByName(found.where("n_shingles = 0").select("rid"))
    rows = docs.select(F.struct("*").alias("row"), F.monotonically_increasing_id().alias("rid"))
    return semi_join_ids(rows, keep, "rid", Scratch(docs.sparkSession, "kept")).select("row.*")


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(read(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


OP5_SQL = r"""
with recursive d as (select row_number() over () rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') ws from documents),
s as (select distinct doc_id, g from (select doc_id, unnest(list_transform(range(1, greatest(len(ws) - 4, 1) + 1), lambda k: array_to_string(ws[k:k+4], ' '))) g from d where len(ws) > 0)),
n as (select doc_id, count(*) n from s group by 1),
p as (select a.doc_id a, b.doc_id b, count(*) i from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
e as (select a, b from p join n x on a = x.doc_id join n y on b = y.doc_id where 100 * i >= 80 * (x.n + y.n - i)),
u as (select a x, b y from e union select b, a from e),
r as (select doc_id x, doc_id c from n union select u.y, r.c from r join u on u.x = r.x)
select d.doc_id, coalesce(n.n, 0)::bigint n_shingles, coalesce(m.c, d.doc_id) component_id
from d left join n on d.doc_id = n.doc_id left join (select x, min(c) c from r group by 1) m on d.doc_id = m.x
"""
