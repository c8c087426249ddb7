"""Keyed, idempotent state on immutable tables: every write is a new version from (old, new)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.score import content_id
from ..functions.text import first_text

Rule = Callable[[Column, Column], Column]


def latest(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row a key: the first under ``order`` (a DISTINCT ON)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def merge_frames(old: DataFrame, new: DataFrame, keys: list[str], rules: dict[str, Rule] | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Upsert: rows of either side; where both have the key, ``rules`` fold a column from (old, new), columns in
    ``keep`` stay as they were, and all others are the new row's. ``new`` has a row a key. One join, by key."""
    rules = rules or {}
    o = old.select(*keys, F.struct(*[c for c in old.columns]).alias("o"))
    n = new.select(*keys, F.struct(*[c for c in new.columns]).alias("n"))
    df = o.join(n, keys, "full")
    both = F.col("o").isNotNull() & F.col("n").isNotNull()

    def value(c: str) -> Column:
        if c not in new.columns:
            return F.col(f"o.{c}")
        fresh, was = F.col(f"n.{c}"), F.col(f"o.{c}")
        folded = rules[c](was, fresh) if c in rules else was if c in keep else fresh
        return F.when(both, folded).otherwise(F.coalesce(fresh, was))

    return df.select(*keys, *[value(c).alias(c) for c in old.columns if c not in keys])


def insert_ignore(old: DataFrame, new: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """Old rows, and the new ones whose key is not there yet: the first of each key under ``order``, which must be
    given where keys can repeat."""
    first = latest(new, keys, *order) if order else new
    return old.unionByName(first.join(old.select(*keys).distinct(), keys, "left_anti"))


def inserted(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The new rows with ``inserted``: whether an insert-ignore would take them."""
    return new.join(old.select(*keys, F.lit(False).alias("__i")).distinct(), keys, "left").withColumn("inserted", F.coalesce("__i", F.lit(True))).drop("__i")


TAG_RULES: dict[str, Rule] = {
    "confidence": lambda o, n: F.greatest(o, n),
    "source": lambda o, n: F.when(o == "web_extract", o).otherwise(n),
}
EVENT_TAG_RULES: dict[str, Rule] = {
    "confidence": lambda o, n: F.greatest(o, n),
    "source": lambda o, n: F.when(o.isin("manual", "web_extract"), o).when((o == "llm") & (n == "rule"), o).otherwise(n),
}


def fold_tag_source(source: str) -> Column:
    """The strongest source of a group: web extract, then model, then rule."""
    return F.when(F.bool_or(F.col(source) == "web_extract"), "web_extract").when(F.bool_or(F.col(source) == "llm"), "llm").otherwise("rule")


def refresh_event_tags(event_item: DataFrame, content_tag: DataFrame, event_tag: DataFrame) -> DataFrame:
    """Event tags from their items' tags: highest confidence, strongest source, upserted under the event rules."""
    fresh = event_item.where("is_active").select("event_id", "content_item_id").join(content_tag, "content_item_id").groupBy("event_id", "tag_id").agg(F.max("confidence").alias("confidence"), fold_tag_source("source").alias("source"))
    return merge_frames(event_tag, fresh, ["event_id", "tag_id"], EVENT_TAG_RULES)


def dedup_key(given: Column, source_id: Column, item_id: Column) -> Column:
    return F.coalesce(F.nullif(F.lower(F.trim(given)), F.lit("")), F.lower(F.concat_ws("|", source_id, item_id)))


def ingest(old: DataFrame, batch: DataFrame, run_id: str, at: Column) -> DataFrame:
    """Content upsert. ``batch(order, dedup_key, source, source_item_id, title, url, summary, rank, need_enrichment)``, with
    ``category`` if it has one; the last row of a key in the batch updates it. Ids and creation times stay.

    An item without a summary has its title for one. Where ``old`` keeps a ``summary_source``, a summary that is blank or
    came from the feed (``TitleOnly``, ``SummaryText``) is refreshed and others stay; where it doesn't, a succeeded
    enrichment's stays. ``action`` is inserted, updated or kept.
    """
    new = latest(batch, ["dedup_key"], F.desc("order")).drop("order")
    o = old.select("dedup_key", F.struct(*old.columns).alias("o"))
    df = o.join(new, "dedup_key", "full")
    had, came = F.col("o").isNotNull(), F.col("source_item_id").isNotNull()
    done = F.coalesce(F.col("o.enrichment_status") == "Succeeded", F.lit(False))
    known = "summary_source" in old.columns
    stays = had & (~(first_text("o.summary").isNull() | F.coalesce(F.lower("o.summary_source").isin("titleonly", "summarytext"), F.lit(False))) if known else done)
    summary = F.when(stays, F.col("o.summary")).otherwise(F.coalesce(first_text("summary"), F.trim("title")))
    source = F.when(stays, F.col("o.summary_source") if known else F.lit(None)).when(first_text("summary").isNotNull(), "SummaryText").otherwise("TitleOnly")
    status = F.when(done & had, F.lit("Succeeded")).when(F.col("need_enrichment"), F.lit("Pending")).otherwise(F.lit("Skipped"))
    pick = lambda new_, old_: F.when(came, new_).otherwise(old_)
    category = F.col("category") if "category" in batch.columns else F.lit("")
    # Further columns that both have are refreshed, those of ``old`` alone stay.
    own = {"dedup_key", "id", "title", "url", "summary", "summary_source", "enrichment_status", "created_at", "last_seen_at", "last_seen_run_id", "last_seen_rank"}
    further = [pick(F.col(c), F.col(f"o.{c}")).alias(c) if c in batch.columns else F.col(f"o.{c}").alias(c) for c in old.columns if c not in own]
    return df.select(
        "dedup_key",
        F.coalesce(F.col("o.id"), content_id(category, "source", "source_item_id")).alias("id"),
        pick(F.col("title"), F.col("o.title")).alias("title"), pick(F.col("url"), F.col("o.url")).alias("url"), pick(summary, F.col("o.summary")).alias("summary"),
        pick(status, F.col("o.enrichment_status")).alias("enrichment_status"), F.coalesce(F.col("o.created_at"), at).alias("created_at"),
        pick(at, F.col("o.last_seen_at")).alias("last_seen_at"), pick(F.lit(run_id), F.col("o.last_seen_run_id")).alias("last_seen_run_id"),
        pick(F.coalesce("rank", F.lit(0)), F.col("o.last_seen_rank")).alias("last_seen_rank"), *further,
        *([pick(source, F.col("o.summary_source")).alias("summary_source")] if known else []),
        F.when(~had, "inserted").when(came, "updated").otherwise("kept").alias("action"),
    )


def mark_stale(events: DataFrame, at: Column, stale_hours: int) -> DataFrame:
    old = (F.col("status") == "Active") & (F.col("last_seen_at") < F.timestamp_add("HOUR", F.lit(-stale_hours), at))
    return events.withColumn("status", F.when(old, "Stale").otherwise(F.col("status")))


def touch(events: DataFrame, seen: DataFrame, at: Column, stale_hours: int) -> DataFrame:
    """Events that got an item: seen now, and if they had been silent too long, active and activated again."""
    df = events.join(seen.select("event_id", F.lit(True).alias("__s")).distinct(), "event_id", "left")
    hit = F.coalesce("__s", F.lit(False))
    back = hit & (F.col("last_seen_at") < F.timestamp_add("HOUR", F.lit(-stale_hours), at))
    df = df.withColumn("reactivated", back).withColumn("status", F.when(back, "Active").otherwise(F.col("status")))
    df = df.withColumn("last_activated_at", F.when(back, at).otherwise(F.col("last_activated_at")))
    return df.withColumn("last_seen_at", F.when(hit, at).otherwise(F.col("last_seen_at"))).drop("__s")


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Rows whose parent is gone (a foreign-key check)."""
    return child.join(parent.select(F.col(parent_key).alias(child_key)), child_key, "left_anti")
