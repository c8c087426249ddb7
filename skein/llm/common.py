"""Shared helpers: table access, lineage cuts in the shared checkpoint folder, connected components."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.lineage import shared_dir

#: ASCII white space, as a character class body and as characters.
WS_CLASS = r"\x20\x09-\x0D"
WS_CHARS = " \t\n\x0b\x0c\r"
#: Everything in ASCII that is neither a lower-case letter nor a digit (words are cut from lower-cased text).
ALNUM_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Scratch:
    """Tables written to the shared folder to cut lineage: a lost executor costs a re-read, never a re-run.

    ``cut`` writes and rereads; ``drop`` deletes tables that nothing reads any more, ``keep`` all but some.
    """

    def __init__(self, spark: SparkSession, name: str, codec: str = "zstd"):
        self.spark, self.base, self.n, self.codec = spark, f"{shared_dir(spark)}/skein-{name}-{uuid.uuid4().hex[:12]}", 0, codec
        self.live: set[str] = set()

    def cut(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.base}/{self.n}"
        df.write.option("compression", self.codec).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._skein_path = path
        self.live.add(path)
        return out

    def _delete(self, path: str) -> None:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)
        self.live.discard(path)

    def drop(self, *dfs: DataFrame) -> None:
        for df in dfs:
            if path := getattr(df, "_skein_path", None):
                self._delete(path)

    def keep(self, *dfs: DataFrame) -> None:
        """Deletes every table but these, which the result still reads."""
        for path in self.live - {getattr(df, "_skein_path", None) for df in dfs}:
            self._delete(path)


def small_batches(spark: SparkSession, rows: int = 128) -> None:
    """Arrow batches of few rows: texts may be very long, and a batch must fit in a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def clean_columns(df: DataFrame, *names: str) -> DataFrame:
    """Only the columns that an operator needs, so that extra ones can't clash with its own."""
    return df.select(*[F.col(f"`{n}`") for n in names])


#: Ids up to this number (about 24 MB) may be broadcast; beyond it the join is by exchange.
BROADCAST_IDS = 1_000_000


def semi_join_ids(df: DataFrame, ids: DataFrame, key: str, scratch: Scratch) -> DataFrame:
    """Rows of ``df`` whose ``key`` (a long) is among ``ids`` (distinct), broadcast only if counted to be few."""
    ids = scratch.cut(ids)
    return df.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, key, "left_semi")


def components(edges: DataFrame, scratch: Scratch, max_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges(src, dst)`` (longs): ``node, comp`` with comp the smallest node.

    Alternating large-star and small-star steps; each is an aggregation and a join on the node, so no
    component is ever gathered in one task, and a round at least halves the height of every tree.
    """
    cur = scratch.cut(
        edges.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).where("u > v").distinct()
    )
    def print_of(df: DataFrame):
        """Changes with any edge (one pass over a written table)."""
        return df.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0)), F.coalesce(F.sum(F.xxhash64("v", "u") % 1_000_003), F.lit(0))).first()

    before = print_of(cur)
    if not before[0]:
        return cur.select(F.col("u").alias("node"), F.col("v").alias("comp"))
    for _ in range(max_rounds):
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u > v").distinct()
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low2, "u")
            .select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.*")
            .where("u > v")
            .distinct()
        )
        nxt = scratch.cut(small)
        scratch.drop(cur)
        # Both steps leave nothing but a set of stars, each around its smallest node, as it is.
        cur, after = nxt, print_of(nxt)
        if tuple(before) == tuple(after):
            return cur.select(F.col("u").alias("node"), F.col("v").alias("comp"))
        before = after
    raise RuntimeError("components did not settle")
