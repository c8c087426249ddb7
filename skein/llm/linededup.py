"""Line dedup with a suffix array over line-ID sequences, by distributed prefix doubling (native).

Each document is its sequence of lines that hold a word, as 128-bit line IDs. The suffixes that begin with a
repeated line are ranked, then ranks are doubled: after round k a suffix's rank orders it by its first 2^k lines, and
a class of equal ranks is an LCP interval of at least 2^k lines. A suffix whose run is unique leaves; so only
repeated runs are carried, and the rounds end after log2(longest repeated run). Rank r of a class is the number of
repeated suffixes before it, so a pair (rank, rank 2^k lines on) becomes a rank by one scan inside the old class.

A line's longest run is the longest one that begins there and also begins earlier, in order of (doc_id, row, line).
Its length n is read off the intervals: 2^k <= n < 2^(k+1) for the last round k in which the line's class has an
earlier member, and since a run of n lines is its first and its last 2^k lines, n is found bit by bit, by pairs of
ranks of round k at the distance that is tried; only classes in which a line tries a distance are looked at. Runs that
the run of the line before covers aren't maximal. Maximal runs of ``min_lines`` lines are deleted, and single lines of
``min_words`` words (a passage can stand on one line). Hot lines and thousands of copies are pre-aggregated counts and
minima in every exchange; the joins back to positions are plain equi-joins that AQE splits.

Defined results: null or empty text has one line without words and stays as it is; blank lines are no members of
runs and are never deleted; repeated rows are copies of the first; overlapping repeats inside one text count (of
"a a a a" the first line stays); rows of a null doc_id come first in order; an empty table gives no rows; the input's
columns come back in a struct, so extra ones can't clash. The input must be a deterministic scan (files or a local
table), because rows are numbered in reading order.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WS_CHARS, WS_CLASS, Scratch, read

BUCKETS = 1024
#: Runs of so many lines go, and single lines of so many words.
MIN_LINES, MIN_WORDS = 2, 10


def _scan(classes: DataFrame, part: list[str], bucket, order: list[str]) -> DataFrame:
    """Adds ``before``: the sum of ``cnt`` over rows earlier in ``order`` within ``part``. ``bucket`` grows with the
    order and cuts a part into at most ``BUCKETS`` pieces, so no part has to be scanned by one task."""
    c = classes.withColumn("bucket", bucket)
    sums = c.groupBy(*part, "bucket").agg(F.sum("cnt").alias("s"))
    prior = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.partitionBy(*part).orderBy("bucket") if part else Window.partitionBy(F.lit(0)).orderBy("bucket")
    sums = sums.select(*part, "bucket", F.coalesce(F.sum("s").over(prior(outer)), F.lit(0)).alias("o"))
    inner = F.sum("cnt").over(prior(Window.partitionBy(*part, "bucket").orderBy(*order)))
    return c.join(sums, [*part, "bucket"]).withColumn("before", F.col("o") + F.coalesce(inner, F.lit(0))).drop("bucket", "o")


def line_table(rows: DataFrame) -> DataFrame:
    """``rid, doc_id, seq, line, h1, h2`` of every line with a word (``rows``: rid, doc_id, text); seq counts only
    those."""
    lines = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x, i: F.struct(i.alias("line"), x.alias("s")))
    worded = F.filter(lines, lambda x: F.rlike(x["s"], F.lit(f"[^{WS_CLASS}]")))
    ids = F.transform(worded, lambda x: F.struct(x["line"].alias("line"), F.xxhash64(x["s"]).alias("h1"), F.xxhash64(F.lit(7), x["s"]).alias("h2")))
    return rows.select("rid", "doc_id", F.posexplode(ids).alias("seq", "x")).select("rid", "doc_id", "seq", "x.line", "x.h1", "x.h2")


def _order():
    return F.struct("doc_id", "rid", "seq")


def suffix_ranks(lines: DataFrame, scratch: Scratch) -> list[DataFrame]:
    """For each k: ``rid, doc_id, seq, r`` (k = 0: also line) of the suffixes whose first 2^k lines are repeated."""
    classes = lines.groupBy("h1", "h2").agg(F.count("*").alias("cnt")).where("cnt > 1")
    ranked = _scan(classes, [], F.shiftright("h1", 54), ["h1", "h2"]).select("h1", "h2", F.col("before").alias("r"))
    levels = [scratch.cut(lines.join(ranked, ["h1", "h2"]).select("rid", "doc_id", "seq", "line", "r"))]
    while n := levels[-1].count():
        size = 1 << (len(levels) - 1)
        active = levels[-1].select("rid", "doc_id", "seq", "r")
        after = active.select("rid", (F.col("seq") - size).alias("seq"), F.col("r").alias("r2"))
        pairs = active.join(after, ["rid", "seq"])
        classes = pairs.groupBy("r", "r2").agg(F.count("*").alias("cnt")).where("cnt > 1")
        shift = max(0, int(math.log2(n)) + 1 - int(math.log2(BUCKETS)))
        fresh = _scan(classes, ["r"], F.shiftright("r2", shift), ["r2"]).select("r", "r2", (F.col("r") + F.col("before")).alias("r3"))
        levels.append(scratch.cut(pairs.join(fresh, ["r", "r2"]).select("rid", "doc_id", "seq", F.col("r3").alias("r"))))
    return levels[:-1]


def repeated_runs(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """``rid, seq, line, run``: every line with the length of the longest run that begins there and earlier, if
    it has one. ``rows`` has rid, doc_id, text."""
    lines = scratch.cut(line_table(rows))
    levels = suffix_ranks(lines, scratch)
    scratch.drop(lines)
    if not levels:
        return rows.select("rid", *[F.lit(0).alias(x) for x in ("seq", "line", "run")]).where("false")

    def ranks_from(k: int) -> DataFrame:
        """``k, rid, doc_id, seq, r`` of the rounds from k on."""
        parts = [level.select(F.lit(k + i).alias("k"), "rid", "doc_id", "seq", "r") for i, level in enumerate(levels[k:])]
        return reduce(DataFrame.unionByName, parts)

    ranks = ranks_from(0)
    # Written, so that the join is one that AQE may split: a hot line's class is one row on this side.
    first = scratch.cut(ranks.groupBy("k", "r").agg(F.min(_order()).alias("first")))
    later = ranks.join(first, ["k", "r"]).where(_order() > F.col("first"))
    deepest = later.groupBy("rid", "seq").agg(F.max(F.struct("k", "r")).alias("x"))
    runs = scratch.cut(deepest.select("rid", "seq", "x.k", "x.r", F.lit(0).alias("d")))
    for j in reversed(range(len(levels) - 1)):
        # Only rounds beyond j are read, which get smaller fast.
        ranks = ranks_from(j + 1)
        there = ranks.select("k", "rid", F.col("seq").alias("at"), F.col("r").alias("r2"))
        tries = runs.where(F.col("k") > j).withColumn("t", F.col("d") + (1 << j))
        asked = tries.select("k", "r", "t").distinct()
        pairs = ranks.join(asked, ["k", "r"]).withColumn("at", F.col("seq") + F.col("t")).join(there, ["k", "rid", "at"])
        pairs = scratch.cut(pairs.select("k", "r", "t", "r2", "rid", "doc_id", "seq"))
        first = scratch.cut(pairs.groupBy("k", "r", "t", "r2").agg(F.min(_order()).alias("first"), F.count("*").alias("cnt")).where("cnt > 1").drop("cnt"))
        copies = pairs.join(first, ["k", "r", "t", "r2"]).where(_order() > F.col("first")).select("rid", "seq", "k", "t")
        grown = tries.join(copies, ["rid", "seq", "k", "t"], "left_semi").select("rid", "seq", "t")
        nxt = scratch.cut(runs.join(grown, ["rid", "seq"], "left").select("rid", "seq", "k", "r", F.coalesce("t", "d").alias("d")))
        scratch.drop(pairs, runs)
        runs = nxt
    out = scratch.cut(levels[0].select("rid", "seq", "line").join(runs.select("rid", "seq", (F.expr("shiftleft(1, k)") + F.col("d")).alias("run")), ["rid", "seq"]))
    scratch.drop(*levels, runs)
    return out


def dedup_lines(docs: DataFrame, min_lines: int = MIN_LINES, min_words: int = MIN_WORDS) -> DataFrame:
    """``row`` (a struct of the input's columns, with the lines of later copies cut out of ``text``), ``n_lines``,
    ``removed`` (array of line numbers), ``n_runs`` and ``longest_run`` (maximal runs that were deleted)."""
    if min_lines < 1 or min_words < 0:
        raise ValueError("min_lines must be 1 or more, min_words 0 or more")
    scratch = Scratch(docs.sparkSession, "lines", "snappy")
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    runs = repeated_runs(rows.select("rid", F.col("row.doc_id").alias("doc_id"), F.col("row.text").alias("text")), scratch)
    # Every line of a later copy begins a later copy itself, so all of a run's lines are in this table.
    by_row = Window.partitionBy("rid").orderBy("seq")
    long = F.col("run") >= min_lines
    runs = runs.withColumn("stop", F.when(long, F.col("seq") + F.col("run")))
    runs = runs.withColumn("covered", F.coalesce(F.max("stop").over(by_row.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)) > F.col("seq"))
    before = F.max("stop").over(by_row.rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.withColumn("maximal", long & (F.coalesce(before, F.lit(0)) < F.col("stop")))
    per_doc = runs.groupBy("rid").agg(
        F.collect_set(F.when(F.col("covered"), F.col("line"))).alias("covered"),
        F.collect_set(F.when(~F.col("covered"), F.col("line"))).alias("singles"),
        F.count_if("maximal").alias("n_long"),
        F.max(F.when(F.col("maximal"), F.col("run"))).cast("long").alias("longest"),
    )
    per_doc = scratch.cut(per_doc)
    scratch.keep(per_doc)
    none = F.array().cast("array<int>")
    lines = F.split(F.col("row.text"), "\n")
    words = lambda x: F.size(F.split(F.btrim(x, F.lit(WS_CHARS)), f"[{WS_CLASS}]+"))
    # Texts move once, by exchange, whatever the size of the other side, which grows with the input.
    out = rows.join(per_doc.hint("merge"), "rid", "left")
    out = out.withColumn("alone", F.when(F.size("singles") > 0, F.filter("singles", lambda i: words(F.get(lines, i)) >= min_words)).otherwise(none))
    out = out.withColumn("removed", F.when(F.col("rid").isNotNull() & F.col("covered").isNotNull(), F.sort_array(F.concat("covered", "alone"))).otherwise(none))
    kept = F.array_join(F.filter(lines, lambda x, i: ~F.array_contains("removed", i)), "\n")
    some = F.size("alone") > 0
    return out.select(
        F.when(F.size("removed") > 0, F.col("row").withField("text", kept)).otherwise(F.col("row")).alias("row"),
        F.size(F.split(F.coalesce(F.col("row.text"), F.lit("")), "\n")).cast("long").alias("n_lines"),
        "removed",
        (F.coalesce("n_long", F.lit(0)) + F.size("alone")).cast("long").alias("n_runs"),
        F.coalesce("longest", F.when(some, F.lit(1).cast("long")), F.lit(0).cast("long")).alias("longest_run"),
    )


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(
        "row.doc_id",
        "n_lines",
        F.size("removed").cast("long").alias("n_removed"),
        "n_runs",
        "longest_run",
        F.sha2(F.array_join(F.transform("removed", lambda i: i.cast("string")), ","), 256).alias("removed_sha256"),
        F.sha2(F.coalesce("row.text", F.lit("")), 256).alias("text_sha256"),
    )


#: Runs as islands on the diagonals of all pairs of equal lines, of which the second is earlier.
OP2_SQL = r"""
with d as (select doc_id, coalesce(text, '') t, string_split(coalesce(text, ''), chr(10)) ls from documents),
l as (select doc_id, unnest(range(0, len(ls))) line, unnest(ls) s from d),
w as (
  select doc_id, line, s, row_number() over (partition by doc_id order by line) - 1 seq, len(regexp_extract_all(s, '[^ 	-
]+')) words
  from l where regexp_matches(s, '[^ 	-
]')),
m as (select a.doc_id, a.seq, b.doc_id other, a.seq - b.seq diagonal from w a join w b on a.s = b.s and (b.doc_id, b.seq) < (a.doc_id, a.seq)),
i as (select *, seq - row_number() over (partition by doc_id, other, diagonal order by seq) island from m),
n as (select doc_id, seq, max(seq) over (partition by doc_id, other, diagonal, island) - seq + 1 run from i),
r as (select doc_id, seq, line, words, max(run) run from n join w using (doc_id, seq) group by all),
g as (select *, case when run >= 2 then seq + run when words >= 10 then seq + 1 end stop from r),
c as (
  select *, max(stop) over (partition by doc_id order by seq) > seq covered,
    stop is not null and coalesce(max(stop) over (partition by doc_id order by seq rows between unbounded preceding and 1 preceding), 0) < stop maximal from g),
p as (
  select doc_id, count(*) filter (covered) n_removed, string_agg(line::varchar, ',' order by line) filter (covered) removed,
    count(*) filter (maximal) n_runs, max(stop - seq) filter (maximal) longest_run from c group by doc_id),
kept as (select l.doc_id, string_agg(s, chr(10) order by l.line) t from l left join c on l.doc_id = c.doc_id and l.line = c.line and covered where c.line is null group by l.doc_id)
select d.doc_id, len(ls)::bigint n_lines, coalesce(n_removed, 0)::bigint n_removed, coalesce(n_runs, 0)::bigint n_runs, coalesce(longest_run, 0)::bigint longest_run,
  sha256(coalesce(removed, '')) removed_sha256, sha256(coalesce(kept.t, '')) text_sha256
from d left join p using (doc_id) left join kept using (doc_id)
"""
