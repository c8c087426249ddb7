"""One digest slot over the store: candidates, blacklist, push log, report and its file, push, state. A slot that was
processed, or whose push log exists, isn't sent again; the log is written before the push, so a crash costs a digest and
never doubles one."""

from __future__ import annotations

import json
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import blacklist_keyword
from ..operators import digest, records
from ..sources import sinks
from ..sources.config import Config
from .pipeline import CONTENT, EVENT, EVENT_ITEM, EVENT_TAG, SCORE, SNAPSHOT


def _scores(store: records.Store) -> DataFrame:
    return store.read("score", SCORE).withColumnsRenamed({"id": "score_id", "current_stage": "score_stage"})


def entries(store: records.Store, chosen: DataFrame) -> list[str]:
    """The chosen events' paragraphs, in their order (a top-k, so few)."""
    rank = (
        store.read("event_item", EVENT_ITEM).where("is_active").select("event_id", "content_item_id")
        .join(store.read("snapshot", SNAPSHOT).select("content_item_id", "run_id", "rank"), "content_item_id")
        .join(chosen.select("event_id", "run_id"), ["event_id", "run_id"]).groupBy("event_id").agg(F.avg("rank").alias("avg_rank"))
    )
    marks = F.transform(F.coalesce("milestones", F.array().cast("array<string>")), lambda m: F.struct(F.lit(None).cast("timestamp_ntz").alias("time"), m.alias("label"), F.lit(None).cast("string").alias("source"), F.lit(None).cast("string").alias("summary")))
    order = Window.orderBy(F.desc("total_score"), F.desc("calculated_at"), F.desc("last_seen_at"), "event_id")  # a handful of rows
    rows = chosen.join(rank, "event_id", "left").withColumns({"avg_rank": F.coalesce("avg_rank", F.lit(0.0)), "milestones": marks, "place": F.row_number().over(order)})
    return [r["entry"] for r in rows.select("place", digest.digest_entry().alias("entry")).orderBy("place").collect()]


def make_report(store: records.Store, folder: str, date: str, slot: str, at: str, since: str, cfg: Config, address: str = "") -> str | None:
    """Writes the report's file and row; returns its link."""
    ntz = lambda t: F.lit(t).cast("timestamp_ntz")
    events = digest.report_events(_scores(store), store.read("event", EVENT), ntz(since), ntz(at), cfg.push_count)
    tags = store.read("event_tag", EVENT_TAG).join(store.read("tag", records.TAG).select(F.col("id").alias("tag_id"), F.col("display_name").alias("name")), "tag_id").select("event_id", "confidence", "name")
    contents = (
        store.read("event_item", EVENT_ITEM).where("is_active").select("event_id", F.col("content_item_id").alias("id")).join(store.read("content", CONTENT), "id")
        .select("event_id", F.col("last_seen_at").cast("timestamp").alias("last_seen_at"), F.col("last_seen_rank").alias("rank"), "title", "url", "source")
    )
    full = digest.report(events.select("event_id", F.col("canonical_title").alias("title"), "summary", "total_score"), tags, contents)
    found = [r.asDict(True) for r in full.orderBy(F.desc("total_score"), "event_id").collect()]
    path = sinks.write_report(found, folder, datetime.fromisoformat(at))
    link = f"{address.rstrip('/')}/{path.name}" if address else None
    spark = store.spark
    row = spark.createDataFrame([("digest", str(path), link, len(found), json.dumps({"events": [e["event_id"] for e in found]}))], "report_type string, file_path string, public_url string, event_count int, payload_json string")
    row = row.withColumns({"id": F.lit(None).cast("string"), "slot_time": F.lit(f"{date} {slot}:00").cast("timestamp"), "generated_at": F.lit(at).cast("timestamp")})
    store.update("report", records.REPORT, lambda t: records.report_rows(t, row))
    return link


def run_digest(spark: SparkSession, store: records.Store, date: str, slot: str, at: str, push: Callable[[dict], bool] | None, folder: str, cfg: Config = Config(), address: str = "") -> dict | None:  # noqa: B008
    """The digest of a local (date, slot) at the time ``at``; None if the slot was processed before."""
    key, state = digest.digest_key(date, slot), f"digest:processed:{date}:{slot}"
    if records.state_value(store.read("state", records.STATE), state) is not None:
        return None

    def processed(value: str) -> None:
        new = spark.createDataFrame([(state, value)], "key string, value string").withColumn("updated_at", F.lit(at).cast("timestamp"))
        store.update("state", records.STATE, lambda t: records.keyed_state(t, new))

    now = F.lit(at).cast("timestamp_ntz")
    since = F.timestamp_add("HOUR", F.lit(-max(1, cfg.history_hours)), now)
    events = store.read("event", EVENT)
    chosen = store.write("run_digest", digest.digest_candidates(_scores(store), events, since, max(1, cfg.push_count)))
    words = [w for w in cfg.blacklist if w.strip()]
    if words:
        # The cut came first, so a blacklisted candidate leaves its place empty.
        bad = store.write("run_digest_bad", chosen.where(blacklist_keyword("canonical_title", "summary", words).isNotNull()).select("event_id", F.lit(True).alias("is_blacklisted")))
        store.update("event", EVENT, lambda t: records.updated(t, bad, "event_id").select(*t.columns))
        chosen = chosen.join(bad.select("event_id"), "event_id", "left_anti")
    told = entries(store, chosen)
    text = lambda link: digest.digest_text(date, slot, told, link) if told else f"{date} {slot}"
    first = spark.createDataFrame([(None, "Digest", f"{date} {slot}", "digest" if told else "no_candidates", text(None), key)], "event_id string, push_type string, title string, reason string, content string, dedup_key string")
    log, todo = records.push_attempts(store.read("push_log", records.PUSH), first.withColumn("pushed_at", F.lit(at).cast("timestamp")))
    if todo.isEmpty():
        processed("push_log_exists")
        return {"dedup_key": key, "sent": False, "events": len(told)}
    store.write("push_log", log)
    link = make_report(store, folder, date, slot, at, str(spark.range(1).select(since.cast("string")).first()[0]), cfg, address) if told else None
    error = "no candidates" if not told else "no pusher" if push is None else None
    ok = error is None and bool(push({"dedup_key": key, "title": f"{date} {slot}", "content": text(link), "link": link}))
    error = error if ok or error else "push failed"
    done = spark.createDataFrame([(key, ok, None if ok else error, text(link))], "dedup_key string, success boolean, error string, content string")
    store.update("push_log", records.PUSH, lambda t: records.push_results(t, done))
    processed("success" if ok else f"skipped_or_failed:{error}")
    return {"dedup_key": key, "sent": ok, "events": len(told), "link": link}
