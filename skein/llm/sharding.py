"""Sharding by a hypergeometric communication matrix (native).

A uniformly random permutation of N rows cut into shards of exact sizes is drawn in four steps:

1. rows fall into blocks by a hash of id, text and place in the input, so that neither a hot id nor rows that are
   repeated a million times fill one block; blocks are counted;
2. the matrix "rows of block b that go to shard s" is drawn from the multivariate hypergeometric law whose
   margins are the block counts and the exact shard sizes;
3. inside each block, rows are ordered by a keyed hash and cut by the block's matrix row (local permutation);
4. after the exchange by shard, rows are ordered by a second keyed hash (the second permutation), and numbered
   without gaps by a two-level scan.

Only block counts (at most ``max_blocks``) and slice counts (shards * ``slices``) reach the driver or a
broadcast. Documents are read once; what is dealt is a written table of ids, sizes and hashes.

Defined results: null or empty text has 8 bytes and crc32 0; repeated rows (same id and text) are all kept and
take different slots; a null ``doc_id`` is hashed as an id of its own; an empty table gives no rows; extra
columns are dropped. The same input (files or a local table) and seed give the same shards on every run and after any
retry.
"""

from __future__ import annotations

import math
import random

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, clean_columns, read


def hypergeometric(rng: random.Random, good: int, bad: int, draws: int) -> int:
    """An exact draw of the number of good items among ``draws`` of ``good + bad``, by inversion from the mode.

    Expected steps are of the order of the standard deviation, so it serves populations of any size.
    """
    lo, hi = max(0, draws - bad), min(good, draws)
    if lo >= hi:
        return lo
    mode = min(hi, max(lo, (draws + 1) * (good + 1) // (good + bad + 2)))
    lc = lambda n, k: math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
    p_mode = math.exp(lc(good, mode) + lc(bad, draws - mode) - lc(good + bad, draws))
    u = rng.random() - p_mode
    up, down, p_up, p_down = mode, mode, p_mode, p_mode
    while u > 0 and (up < hi or down > lo):
        if up < hi:
            p_up *= (good - up) * (draws - up) / ((up + 1) * (bad - draws + up + 1))
            up += 1
            u -= p_up
            if u <= 0:
                return up
        if down > lo:
            p_down *= down * (bad - draws + down) / ((good - down + 1) * (draws - down + 1))
            down -= 1
            u -= p_down
            if u <= 0:
                return down
    return mode


def communication_matrix(blocks: list[int], shards: list[int], seed: int) -> list[list[int]]:
    """Counts by block and shard with exactly these margins, as a uniform permutation would deal them."""
    rng, left, out = random.Random(seed), list(shards), []
    for n in blocks:
        row, todo, rest = [], n, sum(left)
        for s, size in enumerate(left):
            take = hypergeometric(rng, size, rest - size, todo)
            row.append(take)
            rest -= size
            todo -= take
            left[s] -= take
        out.append(row)
    return out


def shard_rows(
    docs: DataFrame, shards: int = 24, seed: int = 20240229, rows_per_block: int = 4_000_000, max_blocks: int = 65_536, slices: int = 64
) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard``: law ``rows``, so counts differ by one at most."""
    if slices < 1 or slices & (slices - 1) or shards < 1:
        raise ValueError("slices must be a power of two, shards 1 or more")
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    base = clean_columns(docs, "doc_id", "text").select(
        F.col("doc_id"),
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.monotonically_increasing_id().alias("at"),
    )
    keys = [F.xxhash64(F.lit(seed + i), "doc_id", "text_crc32", "size", "at").alias(f"k{i}") for i in range(3)]
    keyed = Scratch(spark, "shards").cut(base.select("doc_id", "size", "text_crc32", *keys))
    n = keyed.count()
    n_blocks = min(max_blocks, max(64, -(-n // rows_per_block)))
    keyed = keyed.withColumn("block", F.pmod("k0", F.lit(n_blocks)).cast("int"))
    counts = {r["block"]: r["c"] for r in keyed.groupBy("block").agg(F.count("*").alias("c")).collect()}
    per_block = [counts.get(b, 0) for b in range(n_blocks)]
    sizes = [n // shards + (s < n % shards) for s in range(shards)]
    matrix = communication_matrix(per_block, sizes, seed)
    ends = []
    for row in matrix:
        total, cum = 0, []
        for c in row:
            total += c
            cum.append(total)
        ends.append(cum)
    table = spark.createDataFrame([(b, e) for b, e in enumerate(ends) if per_block[b]] or [(0, ends[0])], "block int, ends array<bigint>")

    local = Window.partitionBy("block").orderBy("k1", "doc_id", "text_crc32", "size")
    # The matrix has at most max_blocks rows of `shards` counts: a fixed bound, so it may be broadcast.
    dealt = (
        keyed.withColumn("r", F.row_number().over(local))
        .join(F.broadcast(table), "block")
        .withColumn("shard", F.size(F.filter("ends", lambda e: e < F.col("r"))).cast("int"))
        .withColumn("slice", (F.shiftrightunsigned("k2", 64 - int(math.log2(slices))) if slices > 1 else F.lit(0)).cast("int"))
    )
    tie = Window.partitionBy("shard", "slice").orderBy("k2", "doc_id", "text_crc32", "size")
    ranked = dealt.withColumn("i", F.row_number().over(tie))
    per_slice = dealt.groupBy("shard", "slice").agg(F.count("*").alias("c"))
    before = Window.partitionBy("shard").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    # shards * slices rows, whatever the input.
    offsets = per_slice.select("shard", "slice", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("o"))
    return ranked.join(F.broadcast(offsets), ["shard", "slice"]).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        (F.col("o") + F.col("i") - 1).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_rows(read(spark, sf_dir, "documents"))
