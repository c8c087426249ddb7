"""The life of an event as keyed state: Active, Stale after a silence, Active again, Merged.

``transitions`` is the batch rule over all sightings; ``lifecycle_stream`` gives the same rows from a stream, with one state
and one event-time timer an event. A sighting sets the timer to its time plus the silence; when the watermark passes it, the
event is stale. A sighting after the silence brings it back, whether the timer has fired by then or not, so the transitions
don't depend on how sightings fall into batches. A merged event has no further transitions.

Sightings: ``event_id, seen_at timestamp, kind`` (``seen`` or ``merged``). Transitions: ``event_id, status, at, reason``
(``first``, ``stale``, ``reactivated``, ``merged``). Of rows at one time sightings come first. Late rows of a stream (older
than the event's last sighting) change nothing; rows without a time or key are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Times are microseconds inside, which no zone of a session or worker touches.
OUT = "event_id string, status string, us long, reason string"
STATE = "status string, last_us long"


def transitions(sightings: DataFrame, stale_hours: int, until: Column) -> DataFrame:
    """The transitions up to ``until``."""
    rows = sightings.where("event_id is not null and seen_at is not null").select(F.col("event_id").cast("string").alias("event_id"), "seen_at", (F.col("kind") == "merged").alias("gone"))
    merged = rows.where("gone").groupBy("event_id").agg(F.min("seen_at").alias("merged_at"))
    # One row a time; what comes after a merge doesn't count.
    seen = rows.where("not gone").select("event_id", "seen_at").distinct().join(merged, "event_id", "left").where("merged_at is null or seen_at <= merged_at")
    w = Window.partitionBy("event_id").orderBy("seen_at")
    end = F.coalesce(F.lead("seen_at").over(w), "merged_at")
    silent = F.timestamp_add("HOUR", F.lit(stale_hours), F.col("seen_at"))
    seen = seen.withColumns({"prev": F.lag("seen_at").over(w), "next": end, "silent": silent})
    back = F.timestamp_add("HOUR", F.lit(stale_hours), F.col("prev")) < F.col("seen_at")
    made = F.array_compact(
        F.array(
            F.when(F.col("prev").isNull(), F.struct(F.lit("Active").alias("status"), F.col("seen_at").alias("at"), F.lit("first").alias("reason"))),
            F.when(back, F.struct(F.lit("Active").alias("status"), F.col("seen_at").alias("at"), F.lit("reactivated").alias("reason"))),
            F.when(F.col("silent") < F.coalesce("next", until), F.struct(F.lit("Stale").alias("status"), F.col("silent").alias("at"), F.lit("stale").alias("reason"))),
        )
    )
    out = seen.select("event_id", F.explode(made).alias("t")).select("event_id", "t.*")
    return out.unionByName(merged.select("event_id", F.lit("Merged").alias("status"), F.col("merged_at").alias("at"), F.lit("merged").alias("reason")))


class Lifecycle(StatefulProcessor):
    """State and timer of one event."""

    def __init__(self, stale_hours: int):
        self.silence = stale_hours * 3_600_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("life", STATE)

    def set_timer(self, us: int) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer(-(-(us + self.silence) // 1000))

    def handleInputRows(self, key, rows, timerValues):
        from pyspark.sql import Row

        status, last = self.state.get() if self.state.exists() else (None, None)
        before = status, last
        for at, gone in sorted((r["us"], r["kind"] == "merged") for r in rows):
            if status == "Merged":
                break
            late = last is not None and at < last
            if not late and status is not None and at - last > self.silence and status == "Active":
                status = "Stale"
                yield Row(event_id=key[0], status=status, us=last + self.silence, reason="stale")
            if gone:
                status = "Merged"
                yield Row(event_id=key[0], status=status, us=at, reason="merged")
            elif not late:
                if status != "Active":
                    reason = "first" if status is None else "reactivated"
                    status = "Active"
                    yield Row(event_id=key[0], status=status, us=at, reason=reason)
                last = at
        if (status, last) != before:
            self.state.update((status, last))
            if status == "Active":
                self.set_timer(last)
            else:
                for t in list(self.handle.listTimers()):
                    self.handle.deleteTimer(t)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        from pyspark.sql import Row

        status, last = self.state.get()
        if status == "Active":
            self.state.update(("Stale", last))
            yield Row(event_id=key[0], status="Stale", us=last + self.silence, reason="stale")

    def close(self) -> None:
        pass


def lifecycle_stream(sightings: DataFrame, stale_hours: int, delay: str = "1 hour") -> DataFrame:
    """Transitions of a stream of sightings; needs the RocksDB state store."""
    rows = sightings.where("event_id is not null and seen_at is not null").select(F.col("event_id").cast("string").alias("event_id"), "seen_at", F.unix_micros("seen_at").alias("us"), "kind")
    out = rows.withWatermark("seen_at", delay).groupBy("event_id").transformWithState(Lifecycle(stale_hours), OUT, "Append", "EventTime")
    return out.select("event_id", "status", F.timestamp_micros("us").alias("at"), "reason")
