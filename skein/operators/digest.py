"""Digest and report: latest scores, top-k, nested read model, slots and messages; tagging and enrichment helpers."""

from __future__ import annotations

from datetime import datetime
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import distinct_ci, first_text, tag_display, tag_name, weak_tag
from .state import latest


def digest_candidates(score: DataFrame, event: DataFrame, since: Column, k: int) -> DataFrame:
    """The ``k`` best events: latest score of each live event, by total, time, last sighting and id. The cut comes
    before any later blacklist filter, so fewer may be sent."""
    live = event.where("status = 'Active' and not is_blacklisted").where(F.col("last_seen_at") >= since)
    rows = score.where(F.col("calculated_at") >= since).join(live, "event_id")
    last = latest(rows, ["event_id"], F.desc("calculated_at"), F.desc("total_score"), F.asc("score_id"))
    return last.orderBy(F.desc("total_score"), F.desc("calculated_at"), F.desc("last_seen_at"), "event_id").limit(k)


def report_events(score: DataFrame, event: DataFrame, since: Column, until: Column, k: int) -> DataFrame:
    """The report's events: latest score inside the window (bounded at both ends) of each live event that was last seen
    in it, the ``k`` best by total, heat, last sighting and id."""
    inside = lambda c: (F.col(c) >= since) & (F.col(c) <= until)
    live = event.where("status = 'Active' and not is_blacklisted").where(inside("last_seen_at"))
    last = latest(score.where(inside("calculated_at")).join(live, "event_id"), ["event_id"], F.desc("calculated_at"), F.desc("total_score"), F.asc("score_id"))
    return last.orderBy(F.desc("total_score"), F.desc("heat_value"), F.desc("last_seen_at"), "event_id").limit(max(1, k))


def one_line(text) -> Column:
    c = F.col(text) if isinstance(text, str) else text
    return F.when(F.trim(F.coalesce(c, F.lit(""))) == "", "暂无摘要").otherwise(F.trim(F.regexp_replace(c, r"\r\n|[\n\r\f\x85\u2028\u2029]", " ")))


def digest_entry() -> Column:
    """One event of a digest: title, summary, stage, progress, figures, sources and terms. Needs ``place, canonical_title,
    summary, current_stage, score_stage, progress_summary, milestones (time, label, source, summary), key_terms, entities,
    total_score, heat_value, sources, avg_rank``."""
    some = lambda c: F.nullif(F.trim(c), F.lit(""))
    newest = F.slice(F.reverse(F.array_sort(F.transform("milestones", lambda m: F.struct(m["time"].alias("t"), F.concat(m["label"], F.lit(": "), one_line(m["summary"])).alias("x"))))), 1, 2)
    progress = F.when(some("progress_summary").isNotNull(), one_line("progress_summary")).when(F.size(newest) == 0, "暂无进程摘要").otherwise(F.array_join(F.transform(newest, lambda x: x["x"]), "；"))
    few = lambda values, n, none: (lambda v: F.when(F.size(v) == 0, none).otherwise(F.array_join(v, ", ")))(F.slice(distinct_ci(values), 1, n))
    return F.concat(
        F.col("place").cast("string"), F.lit(". "), F.col("canonical_title"), F.lit("\n摘要："), one_line("summary"), F.lit("\n阶段："), F.coalesce(some("current_stage"), F.col("score_stage"), F.lit("Initial")),
        F.lit("\n进程："), progress, F.lit("\n热度：总分 "), F.format_string("%.1f", "total_score"), F.lit("，Heat "), F.format_string("%.2f", "heat_value"), F.lit("，来源数 "), F.col("sources").cast("string"),
        F.lit("，平均排名 "), F.format_string("%.1f", "avg_rank"), F.lit("。\n来源/术语："), few(F.transform("milestones", lambda m: m["source"]), 3, "未记录来源"), F.lit("；"),
        few(F.concat(F.coalesce("key_terms", F.array().cast("array<string>")), F.coalesce("entities", F.array().cast("array<string>"))), 5, "未记录术语"),
    )


def digest_text(date: str, slot: str, entries: list[str], link: str | None = None) -> str:
    """The digest of a slot from its entries (a top-k, so few)."""
    head = f"{date} {slot} 舆情摘要，共 {len(entries)} 个事件："
    return "\n".join([head, *([f"静态报告：{link}"] if link and link.strip() else []), *(f"\n{e}" for e in entries)]).rstrip()


def report(events: DataFrame, tags: DataFrame, contents: DataFrame, per_event: int = 8) -> DataFrame:
    """Events with their tags (by confidence, then name) and first ``per_event`` contents (latest, best rank, title)."""
    t = tags.groupBy("event_id").agg(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("confidence")).alias("c"), "name"))), lambda x: x["name"]).alias("tags"))
    order = F.struct((-F.unix_micros("last_seen_at")).alias("t"), F.coalesce("rank", F.lit(2147483647)).alias("r"), "title", "url", "source")
    c = contents.groupBy("event_id").agg(F.slice(F.sort_array(F.collect_list(order)), 1, per_event).alias("c"))
    items = F.transform("c", lambda x: F.struct(x["source"].alias("source"), x["title"].alias("title"), x["url"].alias("url")))
    return events.join(t, "event_id", "left").join(c, "event_id", "left").withColumn("content_items", items).drop("c")


def due_slot(at: datetime, times: tuple[str, ...], zone: str, done: set[str]) -> tuple[str, str] | None:
    """The (local date, slot) due at ``at`` unless its state key is among ``done``."""
    local = at.astimezone(ZoneInfo(zone))
    slot = f"{local:%H:%M}"
    return (f"{local:%Y-%m-%d}", slot) if slot in times and f"digest:processed:{local:%Y-%m-%d}:{slot}" not in done else None


def digest_key(date: str, slot: str) -> str:
    return f"digest:{date}:{slot}"


def local_slot(ts: Column, zone: str) -> Column:
    return F.date_format(F.from_utc_timestamp(ts, zone), "HH:mm")


def assign_tags(raw: DataFrame, key: str, tags: str, source: str) -> DataFrame:
    """Up to six distinct tags an owner, in order: ``key, name, display_name, category, confidence, source``."""
    rows = raw.select(key, F.posexplode(F.col(tags)).alias("i", "t")).select(key, "i", tag_display("t").alias("display_name"), tag_name("t").alias("name"))
    rows = latest(rows.where(~weak_tag("name")), [key, "name"], F.asc("i"))
    from pyspark.sql import Window

    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy(key).orderBy("i"))).where("n <= 6")
    return rows.select(key, "name", "display_name", F.lit("topic").alias("category"), F.lit(0.9 if source == "web_extract" else 0.7).alias("confidence"), F.lit(source).alias("source"))


def enrichment_candidates(content: DataFrame, run_id: str, at: Column, cooldown_hours: int, budget: int) -> DataFrame:
    ready = F.col("enrichment_tried_at").isNull() | (F.col("enrichment_tried_at") <= F.timestamp_add("HOUR", F.lit(-cooldown_hours), at))
    rows = content.where((F.col("last_seen_run_id") == run_id) & F.col("need_enrichment") & (F.col("enrichment_status") != "Succeeded")).where(ready)
    return rows.orderBy("last_seen_rank", "source", "title", "id").limit(max(0, budget))


def enrichment_outcome(todo: DataFrame, replies: DataFrame | None, at: Column) -> tuple[DataFrame, DataFrame | None]:
    """(changes by id, ``id, tags`` of the replies): a reply with a summary succeeds, another one fails, what wasn't asked
    for (``replies(id, body, success)`` lacks it, or there are none) is skipped. The feed's own summary stays before a
    fetched one; failed and skipped items fall back to it or to their title. Skipped ones haven't been tried."""
    from ..sources.feeds import web_extract

    own = (F.lower("summary_source") == "summarytext") & first_text("summary").isNotNull()
    base = todo.select("id", "title", "url", "summary", "summary_source")
    if replies is None:
        got = base.withColumns({"fetched": F.lit(None).cast("string"), "new_title": F.lit(None).cast("string"), "new_url": F.lit(None).cast("string"), "asked": F.lit(False)})
        tags = None
    else:
        read = web_extract(replies.select("id", "body"))
        both = F.from_json("body", "struct<title:string,url:string,data:struct<title:string,url:string>>")
        read = read.select("id", F.when(F.col("ok"), first_text("summary")).alias("fetched"), first_text(both["title"], both["data"]["title"]).alias("new_title"), first_text(both["url"], both["data"]["url"]).alias("new_url"), "insights")
        tags = read.where("fetched is not null").select("id", F.col("insights").alias("tags"))
        got = base.join(read.drop("insights").withColumn("asked", F.lit(True)), "id", "left").withColumn("asked", F.coalesce("asked", F.lit(False)))
    ok = F.col("fetched").isNotNull()
    title = F.when(ok, F.coalesce("new_title", "title")).otherwise(F.col("title"))
    summary = F.when(own, F.trim("summary")).when(ok, F.trim("fetched")).otherwise(F.trim(title))
    source = F.when(own, "SummaryText").when(ok, "Enrichment").otherwise("TitleOnly")
    status = F.when(ok, "Succeeded").when(F.col("asked"), "Failed").otherwise("Skipped")
    changed = got.select("id", title.alias("title"), F.when(ok, F.coalesce("new_url", "url")).otherwise(F.col("url")).alias("url"), summary.alias("summary"), source.alias("summary_source"), status.alias("enrichment_status"), F.when(F.col("asked"), at).alias("tried"))
    kept = todo.select("id", F.col("enrichment_tried_at").alias("was"))
    return changed.join(kept, "id").withColumn("enrichment_tried_at", F.coalesce("tried", "was")).drop("tried", "was"), tags


def preferred_summary(summary_text, enriched, title) -> Column:
    return F.coalesce(first_text(summary_text), first_text(enriched), first_text(title))


def run_status(ok: Column, total: Column) -> Column:
    return F.when((total > 0) & (ok == total), "Succeeded").when(ok > 0, "Partial").otherwise("Failed")


def embedding_todo(wanted: DataFrame, have: DataFrame, keys: list[str], budget: int) -> DataFrame:
    """Inputs whose text hash differs from the stored one (or has none), within the budget."""
    old = have.select(*keys, F.col("source_text_hash").alias("__h"))
    return wanted.join(old, keys, "left").where(~F.col("source_text_hash").eqNullSafe(F.col("__h"))).drop("__h").orderBy(*keys).limit(max(0, budget))
