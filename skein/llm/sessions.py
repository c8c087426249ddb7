"""Sessions of clicks: a Python UDTF over ``TABLE PARTITION BY client ORDER BY ts``, with hot clients cut into chunks.

``Sessions`` is the automaton: ``eval`` advances it over a client's clicks in order, late ones interleaved after timely
ones of the same time, ``terminate`` flushes the last session. It keeps the open session's counters and a running digest,
so its memory doesn't grow with a session.

A client may have a third of all clicks, so a partition is not a client but a chunk of one. A chunk begins where a session
begins whatever came before: ``hours`` has one row for each client and hour (at most 24 a day, however many clicks there
are), and an hour's first timely click is a *cut* if the click before it is final or a gap away. Chunks are runs of cuts
with about ``chunk_rows`` rows. Where a client goes on for more rows than that without a cut, session starts follow one
another only (``Exits``): for each hour a map from the session start that it may be entered with to the first start of the
next hour is made, and maps are composed by doubling, so that the true entry of each hour is known after log2(hours) rounds;
it is a cut, too. The smallest unit of work is thus an hour of one client, which one session may nearly fill.

Defined results: a click without click_id, client_id or ts is left out; of differing rows of one click_id the first by
(timely first, client_id, ts, not final first, cents) counts; without arrived_at a click is timely; without kind or value
it isn't final; a value that is null or not finite adds 0 cents and is not final. Late clicks before a client's first
session belong to none. Empty tables give no sessions. Other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampType

from .common import Scratch, read

MINUTE = 60_000_000
HOUR = 60 * MINUTE
TIMELY, LATE, PEEK = 0, 1, 2
SCHEMA = "client_id long, session_id long, start_us long, end_us long, n_clicks long, n_late long, value_cents long, closed_by string, path_sha256 string"


def micros(df: DataFrame, name: str) -> Column:
    """Microseconds since 1970 of a timestamp; one without a zone counts as UTC, whatever the session's zone is."""
    at = F.col(f"`{name}`")
    if isinstance(df.schema[name].dataType, TimestampType):
        return F.unix_micros(at)
    seconds = F.unix_date(at.cast("date")).cast("long") * 86_400 + F.hour(at) * 3_600 + F.minute(at) * 60
    return seconds * 1_000_000 + (F.extract(F.lit("SECOND"), at) * 1_000_000).cast("long")


def tidy(clicks: DataFrame, late_us: int, final_kind: str, final_value: float) -> DataFrame:
    """One row for each click_id: ``click_id, client_id, us, mark, final, cents``."""
    value = F.col("value").cast("double")
    finite = F.coalesce(F.abs(value) < float("inf"), F.lit(False))  # NaN is above infinity
    arrived, us = micros(clicks, "arrived_at"), micros(clicks, "ts")
    rows = clicks.select(
        F.col("click_id").cast("long").alias("click_id"), F.col("client_id").cast("long").alias("client_id"), us.alias("us"),
        F.when(arrived - us > late_us, LATE).otherwise(TIMELY).alias("mark"),
        F.coalesce(finite & (F.col("kind") == final_kind) & (value >= final_value), F.lit(False)).alias("final"),
        F.when(finite, F.floor(value * 100 + 0.5)).otherwise(0).cast("long").alias("cents"),
    ).where("click_id is not null and client_id is not null and us is not null")
    return rows.groupBy("click_id").agg(F.min(F.struct("mark", "client_id", "us", "final", "cents")).alias("r")).select("click_id", "r.*")


def by_hour(rows: DataFrame, gap_us: int) -> DataFrame:
    """Per client and hour: rows, first timely click, and where a session surely begins (``cut_us, cut_id``, else null)."""
    timely = F.col("mark") == TIMELY
    hours = rows.groupBy("client_id", F.expr(f"us div {HOUR} - if(us % {HOUR} < 0, 1, 0)").alias("hour")).agg(
        F.count("*").alias("n"), F.count_if(timely).alias("n_timely"),
        F.min(F.when(timely, F.col("us"))).alias("first_us"), F.max(F.when(timely, F.col("us"))).alias("last_us"),
        F.max(F.when(timely & ~F.col("final"), F.col("us"))).alias("plain_us"),
    )
    past = Window.partitionBy("client_id").orderBy("hour").rowsBetween(Window.unboundedPreceding, -1)
    hours = hours.withColumn("p", F.last(F.when(F.col("n_timely") > 0, F.struct("last_us", "plain_us")), ignorenulls=True).over(past))
    # Of equal times the last click may be either; only one that is surely final makes a cut.
    surely = F.col("p").isNull() | (F.col("first_us") - F.col("p.last_us") >= gap_us) | F.coalesce(F.col("p.plain_us") < F.col("p.last_us"), F.lit(True))
    cut = F.when((F.col("n_timely") > 0) & surely, F.col("first_us"))
    return hours.select("client_id", "hour", "n", "n_timely", cut.alias("cut_us"), F.when(cut.isNotNull(), F.lit(-(2**63))).alias("cut_id"))


def in_chunks(hours: DataFrame, chunk_rows: int) -> DataFrame:
    """Adds ``chunk`` (of what follows an hour's cut) and ``prev`` (of what precedes it)."""
    order = Window.partitionBy("client_id").orderBy("hour")
    before = F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    hours = hours.withColumn("at", F.when(F.col("cut_us").isNotNull(), before))
    hours = hours.withColumn("chunk", F.expr(f"max(at) over (partition by client_id order by hour rows unbounded preceding) div {chunk_rows}"))
    return hours.withColumn("prev", F.lag("chunk").over(order)).drop("at")


def exits(pdf: pd.DataFrame, gap_us: int, length_us: int) -> pd.DataFrame:
    """Of one hour and the one after it: for each start that the hour may be entered with, the next hour's first start (null: none)."""
    pdf = pdf.sort_values(["us", "click_id"], kind="stable")
    client, run, hour = pdf["client_id"].iloc[0], pdf["run"].iloc[0], pdf["frame"].iloc[0]
    us, ids, final = pdf["us"].to_numpy(), pdf["click_id"].to_numpy(), pdf["final"].to_numpy()
    n, m = len(us), int((pdf["hour"] == hour).sum())
    reset = np.r_[False, final[:-1] | (np.diff(us) >= gap_us)]
    marks = np.flatnonzero(reset)
    following = np.r_[marks, n][np.searchsorted(marks, np.arange(n), side="right")]
    jump = np.minimum(following, np.searchsorted(us, us + length_us, side="right"))
    out = jump.copy()
    for i in range(m - 1, -1, -1):
        if out[i] < m:
            out[i] = out[out[i]]
    # An entry lies within the length from the hour's begin, or is the first click beyond it; none lies after a reset.
    last = min(m - 1, int(np.searchsorted(us, hour * HOUR + length_us, side="right")), int(marks[0]) if len(marks) else m)
    take = np.arange(last + 1)
    none, to = out[take] >= n, np.minimum(out[take], n - 1)
    following = {"n_us": pd.arrays.IntegerArray(us[to], none), "n_id": pd.arrays.IntegerArray(ids[to], none)}
    return pd.DataFrame({"client_id": client, "run": run, "hour": hour, "us": us[take], "id": ids[take]} | following)


def long_runs(rows: DataFrame, hours: DataFrame, scratch: Scratch, gap_us: int, length_us: int, chunk_rows: int) -> DataFrame:
    """``hours`` with the entry of each hour as its cut wherever more than ``chunk_rows`` rows follow a cut without another."""
    runs = hours.withColumn("run", F.expr("max(if(cut_us is not null, hour, null)) over (partition by client_id order by hour rows unbounded preceding)")).where("n_timely > 0")
    size = runs.groupBy("client_id", "run").agg(F.sum("n").alias("rows"), F.count("*").alias("n_hours")).where(f"rows > {chunk_rows} and n_hours > 1")
    size = scratch.cut(size)
    span = size.agg(F.max("n_hours")).first()[0]
    if not span:
        return hours
    runs = scratch.cut(runs.join(size.select("client_id", "run"), ["client_id", "run"], "left_semi").select("client_id", "run", "hour", "cut_us"))
    timely = rows.where(f"mark = {TIMELY}").withColumn("hour", F.floor(F.col("us") / HOUR)).join(runs.select("client_id", "run", "hour"), ["client_id", "hour"])
    framed = timely.withColumn("frame", F.explode(F.array("hour", F.col("hour") - 1)))
    framed = framed.join(runs.select("client_id", "run", F.col("hour").alias("frame")), ["client_id", "run", "frame"])
    step = framed.groupBy("client_id", "run", "frame").applyInPandas(
        lambda pdf: exits(pdf, gap_us, length_us), "client_id long, run long, hour long, us long, id long, n_us long, n_id long"
    )
    head = Window.partitionBy("client_id", "run", "hour").orderBy("us", "id")
    step = scratch.cut(step)
    key = ["client_id", "run", "hour", "us", "id"]
    reached = scratch.cut(step.where("hour = run").withColumn("k", F.row_number().over(head)).where("k = 1").select(*key))
    ahead = 1
    while ahead < span:
        to = step.select("client_id", "run", (F.col("hour") + ahead).alias("hour"), F.col("n_us").alias("us"), F.col("n_id").alias("id"), *[F.col(c).alias(f"f_{c}") for c in ("hour", "us", "id")])
        to = to.where("us is not null")
        came = reached.select("client_id", "run", F.col("hour").alias("f_hour"), F.col("us").alias("f_us"), F.col("id").alias("f_id"))
        reached = scratch.cut(reached.unionByName(came.join(to, ["client_id", "run", "f_hour", "f_us", "f_id"]).select(*key)))
        ahead *= 2
        if ahead < span:
            nxt = step.select("client_id", "run", "hour", "us", "id", F.col("n_us").alias("m_us"), F.col("n_id").alias("m_id"), (F.col("hour") + ahead // 2).alias("m_hour"))
            then = step.select("client_id", "run", F.col("hour").alias("m_hour"), F.col("us").alias("m_us"), F.col("id").alias("m_id"), "n_us", "n_id")
            step = scratch.cut(nxt.join(then, ["client_id", "run", "m_hour", "m_us", "m_id"]).select(*key, "n_us", "n_id"))
    entry = reached.where("hour > run").select("client_id", "hour", F.col("us").alias("e_us"), F.col("id").alias("e_id"))
    hours = hours.join(entry, ["client_id", "hour"], "left")
    return hours.withColumn("cut_us", F.coalesce("cut_us", "e_us")).withColumn("cut_id", F.coalesce("cut_id", "e_id")).drop("e_us", "e_id")


class Sessions:
    """The automaton over one chunk's rows by (us, mark, click_id); a peek is the first click of the next chunk."""

    gap_us, length_us = 10 * MINUTE, 40 * MINUTE

    def __init__(self):
        self.open = False
        self.client = None

    def eval(self, batch: pa.RecordBatch):
        col = {n: batch.column(n).to_pylist() for n in ("us", "mark", "click_id", "final", "cents")}
        if self.client is None and batch.num_rows:
            self.client = batch.column("client_id")[0].as_py()
        done, ids = [], []
        for us, mark, click, final, cents in zip(col["us"], col["mark"], col["click_id"], col["final"], col["cents"], strict=True):
            if mark == LATE:
                self.late += self.open
                continue
            if self.open:
                reason = "end" if self.final else "gap" if us - self.end >= self.gap_us else "length" if us - self.start > self.length_us or mark == PEEK else None
                if reason:
                    self.add(ids)
                    done.append(self.close(reason))
                    ids = []
            if mark == PEEK:
                continue
            if not self.open:
                self.open, self.first, self.start, self.n, self.late, self.cents, self.sha = True, click, us, 0, 0, 0, hashlib.sha256()
            self.end, self.final = us, final
            self.cents += cents
            ids.append(click)
        self.add(ids)
        if done:
            yield self.table(done)

    late = 0

    def add(self, ids: list[int]) -> None:
        if ids:
            self.sha.update((("," if self.n else "") + ",".join(map(str, ids))).encode())
            self.n += len(ids)

    def close(self, reason: str) -> tuple:
        self.open = False
        return self.client, self.first, self.start, self.end, self.n, self.late, self.cents, reason, self.sha.hexdigest()

    @staticmethod
    def table(done: list[tuple]) -> pa.Table:
        names = [f.split()[0] for f in SCHEMA.split(", ")]
        kinds = [pa.string() if f.endswith("string") else pa.int64() for f in SCHEMA.split(", ")]
        return pa.table([pa.array(c, k) for c, k in zip(zip(*done, strict=True), kinds, strict=True)], names=names)

    def terminate(self):
        if self.open:
            yield self.table([self.close("end" if self.final else "none")])


def sessionize(
    clicks: DataFrame, gap_minutes: int = 10, length_minutes: int = 40, late_minutes: int = 360, final_kind: str = "error", final_value: float = 60.0, chunk_rows: int = 20_000
) -> DataFrame:
    """Sessions of ``clicks(click_id, ts, arrived_at, client_id, kind, value)``; a length must be 50 minutes at most with its gap."""
    if gap_minutes + length_minutes > 60 or min(gap_minutes, length_minutes, chunk_rows) <= 0:
        raise ValueError("gap and length must be positive and make up an hour at most, chunk_rows must be positive")
    gap_us, length_us = gap_minutes * MINUTE, length_minutes * MINUTE
    scratch = Scratch(clicks.sparkSession, "sessions")
    rows = scratch.cut(tidy(clicks, late_minutes * MINUTE, final_kind, final_value))
    hours = scratch.cut(by_hour(rows, gap_us))
    hours = in_chunks(long_runs(rows, hours, scratch, gap_us, length_us, chunk_rows), chunk_rows)
    hours = scratch.cut(hours.select("client_id", "hour", "cut_us", "cut_id", "chunk", "prev"))

    after = F.col("cut_us").isNull() | (F.col("us") > F.col("cut_us")) | ((F.col("us") == F.col("cut_us")) & ((F.col("mark") == LATE) | (F.col("click_id") >= F.col("cut_id"))))
    dealt = rows.withColumn("hour", F.expr(f"us div {HOUR} - if(us % {HOUR} < 0, 1, 0)")).join(hours, ["client_id", "hour"])
    dealt = dealt.withColumn("chunk", F.when(after, F.col("chunk")).otherwise(F.col("prev"))).where("chunk is not null")
    peeks = hours.where("cut_us is not null and prev is not null and chunk <> prev").select(
        "client_id", F.col("prev").alias("chunk"), F.col("cut_us").alias("us"), F.lit(PEEK).alias("mark"),
        F.lit(0).cast("long").alias("click_id"), F.lit(False).alias("final"), F.lit(0).cast("long").alias("cents"),
    )
    told = dealt.select(*peeks.columns).unionByName(peeks)
    automaton = type("ClientSessions", (Sessions,), {"gap_us": gap_us, "length_us": length_us})
    split = F.arrow_udtf(automaton, returnType=SCHEMA)
    return split(told.asTable().partitionBy("client_id", "chunk").orderBy("us", "mark", "click_id"))


def op12_gap_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessionize(read(spark, sf_dir, "clicks"))


#: Each click's next session start if one begins with it, then the chain of each client's starts.
OP12_SQL = r"""
WITH RECURSIVE raw AS (
  SELECT click_id, client_id, epoch_us(ts) AS us, coalesce(epoch_us(arrived_at) - epoch_us(ts) > 21600000000, false) AS late,
         coalesce(isfinite(value) AND kind = 'error' AND value >= 60, false) AS fin,
         CASE WHEN isfinite(value) THEN CAST(floor(100 * value + 0.5) AS BIGINT) ELSE 0 END AS cents
  FROM clicks WHERE click_id IS NOT NULL AND client_id IS NOT NULL AND ts IS NOT NULL),
one AS (SELECT * FROM raw QUALIFY row_number() OVER (PARTITION BY click_id ORDER BY late, client_id, us, fin, cents) = 1),
ordered AS (
  SELECT *, row_number() OVER w AS rn, lag(us) OVER w AS p_us, lag(fin) OVER w AS p_fin FROM one WHERE NOT late
  WINDOW w AS (PARTITION BY client_id ORDER BY us, click_id)),
far AS (SELECT client_id, us, min(rn) AS rn FROM ordered GROUP BY ALL),
resets AS (
  SELECT o.*, min(CASE WHEN p_fin OR us - p_us >= 600000000 THEN rn END)
    OVER (PARTITION BY client_id ORDER BY rn ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS reset_rn FROM ordered o),
hops AS (
  SELECT r.client_id, r.rn, least(coalesce(r.reset_rn, f.rn), coalesce(f.rn, r.reset_rn)) AS nxt
  FROM resets r ASOF LEFT JOIN far f ON r.client_id = f.client_id AND r.us + 2400000000 < f.us),
starts AS (
  SELECT client_id, rn, nxt FROM hops WHERE rn = 1
  UNION ALL
  SELECT h.client_id, h.rn, h.nxt FROM starts s JOIN hops h ON h.client_id = s.client_id AND h.rn = s.nxt),
spans AS (
  SELECT s.client_id, s.rn, s.nxt, o.us AS start_us, n.us AS next_us, o.click_id AS session_id, n.p_fin, n.us - n.p_us AS wait
  FROM starts s JOIN ordered o ON o.client_id = s.client_id AND o.rn = s.rn
  LEFT JOIN ordered n ON n.client_id = s.client_id AND n.rn = s.nxt),
sums AS (
  SELECT p.client_id, p.rn, max(o.us) AS end_us, count(*) AS n_clicks, CAST(sum(o.cents) AS BIGINT) AS value_cents, arg_max(o.fin, o.rn) AS fin,
         sha256(string_agg(CAST(o.click_id AS VARCHAR), ',' ORDER BY o.rn)) AS path_sha256
  FROM spans p JOIN ordered o ON o.client_id = p.client_id AND o.rn >= p.rn AND (p.nxt IS NULL OR o.rn < p.nxt) GROUP BY ALL),
last_starts AS (SELECT client_id, start_us, max(rn) AS rn FROM spans GROUP BY ALL),
lates AS (
  SELECT l.client_id, s.rn, count(*) AS n FROM one l ASOF JOIN last_starts s ON l.client_id = s.client_id AND l.us >= s.start_us WHERE l.late GROUP BY ALL)
SELECT p.client_id, p.session_id, p.start_us, s.end_us, s.n_clicks, coalesce(l.n, 0) AS n_late, s.value_cents,
       CASE WHEN s.fin THEN 'end' WHEN p.nxt IS NULL THEN 'none' WHEN p.wait >= 600000000 THEN 'gap' ELSE 'length' END AS closed_by, s.path_sha256
FROM spans p JOIN sums s ON s.client_id = p.client_id AND s.rn = p.rn LEFT JOIN lates l ON l.client_id = p.client_id AND l.rn = p.rn
"""
