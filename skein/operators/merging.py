"""Secondary merge: similar event pairs, hard filters, resolution without using an event twice, lineage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import append_unique, disjoint_ci
from ..sources.config import Config
from .recall import vector_topk


def hard_filter(a: str = "a", b: str = "b") -> Column:
    """The first reason, in order, that forbids merging two event structs; null if none does."""
    c = lambda s, n: F.col(f"{s}.{n}")
    overlap = (c(a, "first_seen_at") <= c(b, "last_seen_at")) & (c(b, "first_seen_at") <= c(a, "last_seen_at"))
    kinds = F.array(F.lower(c(a, "type")), F.lower(c(b, "type")))
    return (
        F.when(disjoint_ci(c(a, "entities"), c(b, "entities")), "entities_disjoint")
        .when(~overlap & (F.lower(c(a, "type")) != F.lower(c(b, "type"))), "time_and_type")
        .when(disjoint_ci(c(a, "places"), c(b, "places")), "places_disjoint")
        .when(F.array_contains(kinds, "newsevent") & F.array_contains(kinds, "topic"), "type_mismatch")
    )


def similar_pairs(events: DataFrame, cfg: Config, processed: DataFrame | None = None) -> DataFrame:
    """``source_id, target_id, similarity, target_last_seen_at``: each unordered pair once, the older event as target;
    pairs processed before (in either direction) are left out by their normalised key."""
    near = vector_topk(events.select(F.col("event_id").alias("query_id"), "v"), events, cfg.merge_candidate_limit + 1, cfg.merge_similarity)
    near = near.where("query_id <> event_id")
    key = near.select(F.least("query_id", "event_id").alias("lo"), F.greatest("query_id", "event_id").alias("hi"), "similarity").groupBy("lo", "hi").agg(F.max("similarity").alias("similarity"))
    if processed is not None:
        done = processed.select(F.least("source_id", "target_id").alias("lo"), F.greatest("source_id", "target_id").alias("hi")).distinct()
        key = key.join(done, ["lo", "hi"], "left_anti")
    at = lambda c, f, l: events.select(F.col("event_id").alias(c), F.col("first_seen_at").alias(f), F.col("last_seen_at").alias(l))  # noqa: E731, E741
    df = key.join(at("lo", "f1", "l1"), "lo").join(at("hi", "f2", "l2"), "hi")
    swap = F.col("f1") > F.col("f2")
    pick = lambda a, b: F.when(swap, F.col(a)).otherwise(F.col(b))
    return df.select(pick("lo", "hi").alias("source_id"), pick("hi", "lo").alias("target_id"), "similarity", pick("l2", "l1").alias("target_last_seen_at"))


def ordered_pairs(pairs: DataFrame, limit: int) -> DataFrame:
    """The best ``limit`` pairs with their ``place``."""
    order = (F.desc("similarity"), F.desc("target_last_seen_at"), F.asc("source_id"), F.asc("target_id"))
    top = pairs.orderBy(*order).limit(max(1, limit))
    # At most ``limit`` rows, a configured handful.
    return top.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)))


def resolve_pairs(pairs: DataFrame, limit: int) -> DataFrame:
    """Greedy best first with a consumed set, over the global top ``limit`` pairs (a configured handful, so on the
    driver), of equals the one whose target was seen last: an event that was merged away isn't used again."""
    top = ordered_pairs(pairs, limit).drop("place").orderBy(F.desc("similarity"), F.desc("target_last_seen_at"), "source_id", "target_id").collect()
    gone, kept = set(), []
    for r in top:
        if r["source_id"] in gone or r["target_id"] in gone:
            continue
        gone.add(r["source_id"])
        kept.append(tuple(r))
    return pairs.sparkSession.createDataFrame(kept, pairs.schema)


def fold_evidence(target: str = "t", source: str = "s") -> list[Column]:
    """The merged event's fields: longer title, both summaries, lists appended with caps, widest times."""
    c = lambda x, n: F.col(f"{x}.{n}")
    title = F.when(F.length(c(source, "canonical_title")) > F.length(c(target, "canonical_title")), c(source, "canonical_title")).otherwise(c(target, "canonical_title"))
    caps = {"aliases": 8, "entities": 8, "places": 8, "key_terms": 12, "representative_titles": 3}
    both = lambda n: F.array(c(target, n), c(source, n))
    from ..functions.text import distinct_ci

    return [
        title.alias("canonical_title"), F.array_join(distinct_ci(both("summary")), "\n").alias("summary"),
        *[append_unique(c(target, n), F.array_append(c(source, n), c(source, "canonical_title")) if n == "representative_titles" else c(source, n), k).alias(n) for n, k in caps.items()],
        F.least(c(target, "first_seen_at"), c(source, "first_seen_at")).alias("first_seen_at"),
        F.greatest(c(target, "last_seen_at"), c(source, "last_seen_at")).alias("last_seen_at"),
        F.greatest(c(target, "last_activated_at"), c(source, "last_activated_at")).alias("last_activated_at"),
        F.when(c(source, "status") == "Active", F.lit("Active")).otherwise(c(target, "status")).alias("status"),
    ]


def merge_id(source, target, at) -> Column:
    return F.concat(F.lit("emh:"), F.left(F.sha2(F.concat_ws("|", source.cast("string"), target.cast("string"), at.cast("string")), 256), F.lit(24)))


def migrate_evidence(event_item: DataFrame, merges: DataFrame, at: Column) -> DataFrame:
    """Points the sources' active items at their targets, matched now, and keeps the lineage in
    ``created_by_merge_id``; a source's inactive items stay with it."""
    m = merges.select(F.col("source_id").alias("event_id"), F.col("target_id").alias("__target"), merge_id(F.col("source_id"), F.col("target_id"), at).alias("__merge"))
    df = event_item.join(m, "event_id", "left")
    moved = F.col("__target").isNotNull() & F.col("is_active")
    new = {"created_by_merge_id": F.col("__merge"), "event_id": F.col("__target")}
    if "matched_at" in event_item.columns:
        new["matched_at"] = at
    return df.select(*[F.when(moved, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in event_item.columns])


def deactivate_items(event_item: DataFrame, merges: DataFrame) -> DataFrame:
    """Nothing that still points at a merged event is active."""
    gone = merges.select(F.col("source_id").alias("event_id"), F.lit(True).alias("__gone")).distinct()
    df = event_item.join(gone, "event_id", "left")
    return df.withColumn("is_active", F.col("is_active") & F.col("__gone").isNull()).select(*event_item.columns)


def fold_tags(event_tag: DataFrame, merges: DataFrame) -> DataFrame:
    """The target's tags take in the source's, under the rules of event tags."""
    from .state import EVENT_TAG_RULES, fold_tag_source, merge_frames

    m = merges.select(F.col("source_id").alias("event_id"), "target_id")
    fresh = event_tag.join(m, "event_id").groupBy(F.col("target_id").alias("event_id"), "tag_id").agg(F.max("confidence").alias("confidence"), fold_tag_source("source").alias("source"))
    return merge_frames(event_tag, fresh, ["event_id", "tag_id"], EVENT_TAG_RULES)


def fold_events(events: DataFrame, merges: DataFrame) -> DataFrame:
    """Targets take in their sources (in order of ``place``, where one has several), sources are marked as merged."""
    lists = ["aliases", "entities", "places", "key_terms", "representative_titles"]
    row = F.struct("event_id", "canonical_title", "summary", "status", "first_seen_at", "last_seen_at", "last_activated_at", *lists)
    s = events.join(merges.select(F.col("source_id").alias("event_id"), "target_id", "place"), "event_id").select("target_id", "place", row.alias("s"))
    place = 1
    # A target rarely has more than one source; each round folds the next of each.
    from pyspark.sql import Window

    s = s.withColumn("n", F.row_number().over(Window.partitionBy("target_id").orderBy("place")))
    rounds = s.agg(F.max("n")).first()[0] or 0
    out = events
    while place <= rounds:
        now = s.where(F.col("n") == place).select(F.col("target_id").alias("event_id"), "s")
        t = out.select("event_id", row.alias("t")).join(now, "event_id").select("event_id", *fold_evidence())
        changed = [c for c in t.columns if c != "event_id"]
        t = t.select("event_id", F.struct(*changed).alias("__new"))
        out = out.join(t, "event_id", "left").select(*[F.when(F.col("__new").isNotNull(), F.col(f"__new.{c}")).otherwise(F.col(c)).alias(c) if c in changed else F.col(c) for c in events.columns])
        place += 1
    return mark_merged(out, merges)


def secondary_merge(events: DataFrame, pairs: DataFrame, cfg: Config, replies: DataFrame | None = None) -> DataFrame:
    """``source_id, target_id, similarity, confidence, reason, place``: the pairs that are merged, best first, of the
    ``merge_candidate_limit`` best: none that a hard filter excludes, none without a reply (``source_id, target_id,
    decision, confidence, reason``) of at least the confidence, and no event that an earlier pair has merged away."""
    top = ordered_pairs(pairs, cfg.merge_candidate_limit)
    cols = ("event_id", "type", "entities", "places", "first_seen_at", "last_seen_at")
    side = lambda key, name: events.select(F.col("event_id").alias(key), F.struct(*cols).alias(name))
    fine = top.join(side("source_id", "a"), "source_id").join(side("target_id", "b"), "target_id").where(hard_filter("a", "b").isNull()).drop("a", "b")
    if replies is None:
        replies = events.sparkSession.createDataFrame([], f"source_id {dict(pairs.dtypes)['source_id']}, target_id {dict(pairs.dtypes)['target_id']}, decision string, confidence double, reason string")
    agreed = fine.join(replies, ["source_id", "target_id"]).where((F.col("decision") == "same_event") & (F.col("confidence") >= cfg.merge_confidence))
    agreed = agreed.select("source_id", "target_id", "similarity", "confidence", "reason", "place")
    # At most ``merge_candidate_limit`` rows, a configured handful.
    gone, kept = set(), []
    for r in agreed.orderBy("place").collect():
        if r["source_id"] not in gone and r["target_id"] not in gone:
            gone.add(r["source_id"])
            kept.append(tuple(r))
    return events.sparkSession.createDataFrame(kept, agreed.schema)


def mark_merged(events: DataFrame, merges: DataFrame) -> DataFrame:
    """Status and ``merged_into_event_id`` of events that were merged away; all other columns stay as they are."""
    m = merges.select(F.col("source_id").alias("event_id"), F.col("target_id").alias("__into"))
    df = events.join(m, "event_id", "left")
    gone = F.col("__into").isNotNull()
    return df.withColumn("status", F.when(gone, "Merged").otherwise(F.col("status"))).withColumn("merged_into_event_id", F.coalesce("__into", "merged_into_event_id")).drop("__into")
