"""One run over state, in ten stages: fetch, ingest, enrich, embed contents, match, tag, embed events, score (and push),
push (part of score, recorded as skipped), secondary merge. Models are pluggable callables over rows; without one, a
stage does what an unconfigured model means (a new event, a neutral judge, no tags, no vectors, nothing pushed)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions import score as S
from ..functions.score import hex_id, snapshot_id
from ..functions.text import anchors_all, blacklist_keyword, first_text, key_terms, need_enrichment, prepend_unique, strings
from ..operators import digest, merging, records, runs
from ..operators.models import call_all
from ..operators.recall import composite, decide, joins, recallable, rule_pairs, rule_recall, settle_alike, top_per, vector_topk
from ..operators.scoring import judge_promotes, score_run
from ..operators.lineage import cut_in
from ..operators.state import TAG_RULES, ingest, insert_ignore, latest, mark_stale, merge_frames, refresh_event_tags, touch
from ..sources.config import Config
from ..sources.feeds import cluster_reply, list_items, web_extract

EVENT = (
    "event_id string, type string, canonical_title string, summary string, status string, entities array<string>, aliases array<string>, places array<string>, key_terms array<string>, "
    "representative_titles array<string>, first_seen_at timestamp_ntz, last_seen_at timestamp_ntz, last_activated_at timestamp_ntz, is_blacklisted boolean, current_stage string, progress_summary string, "
    "milestones array<string>, push_count int, last_pushed_at timestamp_ntz, last_push_source_count bigint, last_push_rank_score double, last_push_score double, merged_into_event_id string"
)
CONTENT = (
    "dedup_key string, id string, category string, source string, title string, url string, mobile_url string, summary string, summary_source string, need_enrichment boolean, enrichment_status string, "
    "enrichment_tried_at timestamp_ntz, created_at timestamp_ntz, last_seen_at timestamp_ntz, last_seen_run_id string, last_seen_rank bigint"
)
SNAPSHOT = (
    "id string, run_id string, content_item_id string, visual_order int, source string, source_id string, content_kind string, rank int, source_list_size int, normalized_rank_score double, freshness_score double, "
    "captured_at timestamp_ntz, category string, title string"
)
EVENT_ITEM = "event_id string, content_item_id string, confidence double, matched_at timestamp_ntz, match_reason string, is_active boolean, created_by_merge_id string"
SCORE = "id string, event_id string, run_id string, calculated_at timestamp_ntz, total_score double, heat_value double, coverage double, rank_score double, trend double, persistence double, flash double, sources bigint, current_stage string, trigger_reasons array<string>"
HISTORY = "id string, source_id string, target_id string, confidence double, reason string, similarity double, created_at timestamp_ntz"
VECTOR = "owner string, model string, version string, dimensions int, v array<float>, source_text_hash string, updated_at timestamp_ntz"
RUN_SOURCE = "run_id string, source_id string, category string, source string, status string, error string, duration_ms bigint, created_at timestamp_ntz"
SOURCE = "id string, display_name string, provider string, category string, content_kind string, created_at timestamp_ntz"
CONTENT_TAG = "content_item_id string, tag_id string, confidence double, source string"
EVENT_TAG = "event_id string, tag_id string, confidence double, source string"
STAGE = "run_id string, stage string, started_at timestamp, finished_at timestamp, duration_ms bigint, status string, error string"


@dataclass
class RunResult:
    events: DataFrame
    mapping: DataFrame
    scores: DataFrame


@dataclass
class Models:
    """What a run may call; each takes a row as a dict and returns the reply's body."""

    fetch: Callable[[dict], str] | None = None
    extract: Callable[[dict], str] | None = None
    embed: Callable[[dict], str] | None = None
    cluster: Callable[[dict], str] | None = None
    tag: Callable[[dict], str] | None = None
    judge: Callable[[dict], str] | None = None
    merge: Callable[[dict], str] | None = None
    push: Callable[[dict], bool] | None = None


def update_matched(events: DataFrame, matched: DataFrame) -> DataFrame:
    """Events take in the items that were matched with them, in order of (rank, source, title): a reply's title and
    summary replace the event's, titles, terms, entities and aliases go to the front of their lists.

    ``matched``: event_id, title, summary, rank, source, reply_title, reply_summary.
    """
    order = F.struct(F.coalesce("rank", F.lit(2147483647)).alias("o"), "source", "title", "summary", first_text("reply_title").alias("rt"), first_text("reply_summary").alias("rs"))
    rows = matched.withColumns({"a": anchors_all(F.array("title", "summary")), "k": key_terms(F.concat_ws(" ", first_text("title"), first_text("summary")))})
    got = rows.groupBy("event_id").agg(F.sort_array(F.collect_list(F.struct(order.alias("o"), "a", "k"))).alias("x"))
    df = events.join(got, "event_id", "left")
    each = lambda f: F.transform("x", f)
    last = lambda f: F.element_at(F.concat(F.array(F.lit(None).cast("string")), F.filter(each(f), lambda y: y.isNotNull())), -1)
    title = F.coalesce(last(lambda x: x["o"]["rt"]), F.col("canonical_title"))
    # The title's and replies' anchors are aliases.
    df = df.withColumn("__alias", anchors_all(F.when(F.col("x").isNotNull(), F.concat(each(lambda x: x["o"]["title"]), F.array(last(lambda x: x["o"]["rt"]), last(lambda x: x["o"]["rs"]), title)))))
    new = {
        "canonical_title": title,
        "summary": F.coalesce(last(lambda x: x["o"]["rs"]), F.col("summary")),
        "representative_titles": prepend_unique("representative_titles", each(lambda x: x["o"]["title"]), 3),
        "key_terms": prepend_unique("key_terms", F.flatten(each(lambda x: x["k"])), 12),
        "entities": prepend_unique("entities", F.flatten(each(lambda x: x["a"])), 8),
        "aliases": prepend_unique("aliases", F.col("__alias"), 8),
    }
    return df.select(*[F.when(F.col("x").isNotNull(), new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in events.columns])


def candidates(items: DataFrame, events: DataFrame, at: Column, cfg: Config, vectors: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """``item_id, event_id, score, features``: both recalls' best; ``vectors`` are (item vectors, event vectors)."""
    cand = rule_recall(items, recallable(events, at, cfg), at, cfg)
    if vectors is None:
        return cand
    mine = vectors[1].join(recallable(events, at, cfg, skip_blacklisted=True).select("event_id", "last_seen_at"), "event_id")
    near = vector_topk(vectors[0].select(F.col("item_id").alias("query_id"), "v"), mine, cfg.vector_limit, cfg.vector_similarity)
    cand = composite(cand, near.withColumnRenamed("query_id", "item_id"))
    return top_per("item_id", cand, cfg.candidate_limit, F.desc("score"), F.asc("event_id"))


def born_events(fresh: DataFrame, at: Column) -> DataFrame:
    """The event that each item would found; a reply's title and summary come before the item's."""
    has = {"reply_title", "reply_summary"} <= set(fresh.columns)
    said = (F.col("reply_title"), F.col("reply_summary")) if has else (F.lit(None).cast("string"),) * 2
    title = first_text(said[0], "title", "summary", F.lit("未命名事件"))
    rows = fresh.select("item_id", "title", "summary", hex_id("evt", 20, "source", "source_item_id", "title").alias("event_id"), title.alias("t"), first_text(said[1], "summary", "title", title).alias("s"), said[0].alias("rt"))
    return rows.select(
        "item_id", "event_id", F.lit("NewsEvent").alias("type"), F.col("t").alias("canonical_title"), F.col("s").alias("summary"), F.lit("Active").alias("status"), at.alias("first_seen_at"), at.alias("last_seen_at"),
        at.alias("last_activated_at"), F.lit(False).alias("is_blacklisted"), key_terms(F.concat_ws(" ", "t", "s")).alias("key_terms"), F.when(first_text("title").isNull(), strings([])).otherwise(F.array(F.trim("title"))).alias("representative_titles"),
        F.lit(False).alias("reactivated"), anchors_all(F.array("t", "s", "title", "summary")).alias("entities"), anchors_all(F.array("title", "rt", "t")).alias("aliases"), strings([]).alias("places"), F.lit(0).alias("push_count"),
    )


def match_run(items: DataFrame, events: DataFrame, at: Column, cfg: Config, replies: DataFrame | None = None, vectors: tuple[DataFrame, DataFrame] | None = None, cand: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(events, mapping): events age first, then items are recalled against existing events (``cand``, if that has been
    done), set-based; matched events take their items in. Items that would found an event are recalled against those
    born in the run, in the order of (rank, source, title, id): a rule match joins it (``settle``). What they are compared
    with is an event as it was founded; titles that joined it since aren't."""
    cut = cut_in(items.sparkSession, "match")
    events = mark_stale(events, at, cfg.stale_hours)
    cand = candidates(items, events, at, cfg, vectors) if cand is None else cand
    found = cut("found", decide(items, cand, cfg, replies))
    fresh = items.join(found.where("event_id is null").select("item_id"), "item_id", "left_semi")
    said = replies is not None and {"reply_title", "reply_summary"} <= set(replies.columns)
    fresh = fresh.join(replies.select("item_id", "reply_title", "reply_summary"), "item_id", "left") if said else fresh
    born = cut("born", born_events(fresh, at))
    # An item's place is an order, not a number: no row needs to know how many came before it.
    order = fresh.select("item_id", F.struct(F.coalesce("rank", F.lit(2147483647)).alias("r"), "source", "title", "source_item_id", "item_id").alias("place"))
    mine = born.select("item_id", F.col("event_id").alias("born"))
    # What an item is compared by, and the event that it would found, come from these texts alone: equal ones are scored once.
    texts = [c for c in ("title", "summary", "reply_title", "reply_summary") if c in fresh.columns]
    alike = fresh.select("item_id", F.sha2(F.to_json(F.struct(*texts)), 256).alias("text")).join(order, "item_id")
    members = cut("members", alike.join(alike.groupBy("text").agg(F.min_by("item_id", "place").alias("first")), "text").select("item_id", "place", "first"))
    firsts = members.where(F.col("item_id") == F.col("first")).select("item_id")
    one, first_born = fresh.join(firsts, "item_id", "left_semi"), born.join(firsts, "item_id", "left_semi")
    pairs = joins(rule_pairs(one, first_born.drop("item_id"), at, 0, cfg.rule_merge_threshold - 0.00005), cfg).select("item_id", F.col("event_id").alias("born"), "score")
    pairs = pairs.join(mine.withColumnRenamed("item_id", "other"), "born").select("item_id", "other", "score")
    settled = settle_alike(members, cut("pairs", pairs), cut)
    placed = settled.join(mine.withColumnRenamed("item_id", "founder"), "founder").select("item_id", F.col("born").alias("event_id"), F.col("score").alias("confidence"), F.when(F.col("item_id") == F.col("founder"), "create_new").otherwise("same_event").alias("match_reason"))
    placed = cut("placed", placed)
    mapped = found.where("event_id is not null").select("item_id", "event_id", "confidence", F.col("decision").alias("match_reason")).unionByName(placed)
    aged = touch(events, found.where("event_id is not null").select("event_id"), at, cfg.stale_hours)
    new = born.join(placed.where("match_reason = 'create_new'").select("item_id"), "item_id", "left_semi").drop("item_id")
    aged = aged.unionByName(new.select(*[c for c in new.columns if c in aged.columns]), allowMissingColumns=True)
    took = mapped.where("match_reason <> 'create_new'").join(items, "item_id")
    if said:
        took = took.join(replies.select("item_id", "reply_title", "reply_summary"), "item_id", "left")
    else:
        took = took.withColumns({c: F.lit(None).cast("string") for c in ("reply_title", "reply_summary")})
    matched = took.select("event_id", "title", "summary", "rank", "source", "reply_title", "reply_summary")
    lists = {"entities", "aliases", "key_terms", "representative_titles", "canonical_title", "summary"} <= set(aged.columns)
    return update_matched(aged, matched) if lists else aged, mapped


def run_once(items: DataFrame, events: DataFrame, evidence: DataFrame, prior: DataFrame, at: Column, cfg: Config, replies: DataFrame | None = None) -> RunResult:
    """Match, then score: ``evidence`` is by ``item_id``; the mapping gives it its events."""
    events, mapping = match_run(items, events, at, cfg, replies)
    return RunResult(events, mapping, score_run(evidence.join(mapping.select("item_id", "event_id"), "item_id"), _scoring_state(events), prior, at, cfg))


def _scoring_state(events: DataFrame) -> DataFrame:
    have = set(events.columns)
    pushed = [F.coalesce("push_count", F.lit(0)).alias("push_count"), *[F.col(c) for c in ("last_push_source_count", "last_push_rank_score", "last_push_score")]]
    last = F.col("last_pushed_at") if "last_pushed_at" in have else F.col("first_seen_at")
    return events.select("event_id", "first_seen_at", F.coalesce("reactivated", F.lit(False)).alias("reactivated"), "is_blacklisted", last.alias("last_pushed_at"), *pushed)


def snapshot_rows(batch: DataFrame, run_id: str, at: Column) -> DataFrame:
    """A run's snapshot of each item, numbered in display order: rank and its place between 0 and 1 for ranked lists,
    freshness for flashes."""
    rows = batch.select(
        F.lit(run_id).alias("run_id"), F.col("item_id").alias("content_item_id"), "source", "source_id", "content_kind", F.col("rank").cast("int").alias("rank"),
        F.col("source_list_size").cast("int").alias("source_list_size"), F.when(F.col("rank").isNotNull(), S.normalized_rank("rank", "source_list_size")).alias("normalized_rank_score"),
        S.freshness(F.col("content_kind"), "published_at", at).alias("freshness_score"), at.alias("captured_at"), "category", "title",
    )
    rows = runs.visual_order(rows)
    return rows.withColumn("id", snapshot_id("run_id", "visual_order", "category", "source_id", "rank"))


def run_fetch(spark: SparkSession, store: records.Store, sources: list[runs.Source], models: Models, at: str, run_id: str, cfg: Config = Config()) -> dict:  # noqa: B008
    """A whole run on the tables of ``store``; returns its counts. All but fetch and ingest may fail alone."""
    now = F.lit(at).cast("timestamp_ntz")
    registry = runs.registry(spark, sources)
    stages = runs.Stages(run_id)
    enabled = sum(s.enabled for s in sources)
    start = spark.createDataFrame([(run_id, enabled)], "id string, source_count int").withColumn("started_at", F.lit(at).cast("timestamp"))
    store.update("fetch_run", records.RUN, lambda t: records.run_started(t, start))
    count: dict = {}

    def fetch() -> DataFrame:
        if models.fetch is None:
            return spark.createDataFrame([], "source_id string, status string, body string, error string, duration_ms bigint")
        got = store.write("run_body", runs.fetch_all(registry, models.fetch))
        known = registry.select(F.col("id").alias("source_id"), "category", F.col("display_name").alias("source"))
        outcome = got.join(known, "source_id").select(F.lit(run_id).alias("run_id"), "source_id", "category", "source", "status", "error", "duration_ms", now.alias("created_at"))
        store.put("fetch_run_source", RUN_SOURCE, "run_id", outcome)
        store.update("source", SOURCE, lambda t: records.source_dimension(t, registry.select("id", "display_name", "provider", "category", "content_kind", now.alias("created_at"))))
        count.update(ok=got.where("status = 'succeeded'").count(), failed=got.where("status = 'failed'").count())
        count["errors"] = [f"{r['source_id']}: {r['error']}" for r in got.where("status = 'failed'").select("source_id", "error").collect()]
        return got

    def read_items(bodies: DataFrame) -> DataFrame:
        s = registry.select(F.col("id").alias("source_id"), "external_id", "content_kind", "category", F.col("display_name").alias("source"))
        items = list_items(bodies.where("status = 'succeeded'").join(s.drop("source", "category"), "source_id"))
        items = items.join(s.select("source_id", "source", "category"), "source_id").withColumn("published_at", F.col("published_at").cast("timestamp_ntz"))
        key = F.lower(F.concat_ws(":", "source_id", "source_item_id"))
        need = need_enrichment("source", "title", F.coalesce("summary", F.lit("")), min_title=cfg.min_title_length)
        # Items are taken in by display order, and the last one of a key stands.
        order = F.struct(F.upper("category").alias("c"), F.upper("source_id").alias("s"), F.coalesce("rank", F.lit(2147483647)).alias("r"), F.upper("title").alias("t"), "source_item_id")
        return items.withColumns({"dedup_key": key, "need_enrichment": need, "order": order})

    def take_in(bodies: DataFrame) -> DataFrame:
        every = store.write("run_item", read_items(bodies))
        cols = ("order", "dedup_key", "category", "source_id", "source_item_id", "title", "url", "mobile_url", "summary", "rank", "need_enrichment")
        before = store.read("content", CONTENT)
        counted = Observation("ingest")
        change = ingest(before, every.select(*cols).withColumnRenamed("source_id", "source"), run_id, now)
        change = change.observe(counted, F.count_if(F.col("action") == "inserted").alias("inserted"), F.count_if(F.col("action") == "updated").alias("updated"))
        store.write("content", change.drop("action").select(*before.columns))
        # A run that is tried again takes the place of its own snapshots.
        ids = store.read("content", CONTENT).select("dedup_key", F.col("id").alias("item_id"))
        store.put("snapshot", SNAPSHOT, "run_id", snapshot_rows(every.join(ids, "dedup_key"), run_id, now))
        count.update(items=every.count(), **counted.get)
        return latest(every, ["dedup_key"], F.desc("order"))

    def enrich() -> None:
        """Candidates of the run are fetched as far as the budget goes; the rest is skipped until the next run."""
        content = store.read("content", CONTENT)
        todo = store.write("run_todo", digest.enrichment_candidates(content, run_id, now, cfg.retry_cooldown_hours, 2**31 - 1))
        ask = digest.enrichment_candidates(todo.where("trim(coalesce(url, '')) <> ''"), run_id, now, cfg.retry_cooldown_hours, cfg.enrichment_budget if models.extract else 0)
        # A call that failed was a try, too.
        got = called("enrichment", ask.select("id", "title", "url"), "id", models.extract, failed=True) if models.extract else None
        done, tags = digest.enrichment_outcome(todo, got, now)
        done = store.write("run_extract", done)
        store.update("content", CONTENT, lambda t: records.updated(t, done, "id").select(*t.columns))
        count["enriched"] = done.where("enrichment_status = 'Succeeded'").count()
        if tags is not None:
            add_tags(digest.assign_tags(tags.withColumnRenamed("id", "item_id"), "item_id", "tags", "web_extract"))

    def called(stage: str, rows: DataFrame, key: str, send: Callable[[dict], str], failed: bool = False) -> DataFrame:
        """A stage's model calls, whose usage and cost are kept."""
        got = store.write(f"run_call_{stage}", call_all(rows, key, send))
        store.put("llm_usage", records.USAGE, "call_set", records.usage_rows(got, key, run_id, stage, cfg, now))
        return got if failed else got.where("success")

    def add_tags(names: DataFrame) -> None:
        names = store.write("run_tag", names)
        tags = store.update("tag", records.TAG, lambda t: records.tag_dimension(t, names, F.lit(at).cast("timestamp")))
        rows = names.join(tags.select("name", F.col("id").alias("tag_id")), "name").select(F.col("item_id").alias("content_item_id"), "tag_id", "confidence", "source")
        store.update("content_tag", CONTENT_TAG, lambda t: merge_frames(t, rows, ["content_item_id", "tag_id"], TAG_RULES))

    def embed(kind: str, texts: DataFrame, budget: int) -> int:
        """Vectors of texts whose hash has changed, ``budget`` of them; returns how many were asked for."""
        if models.embed is None or budget < 1:
            return 0
        name = f"{kind}_vector"
        todo = store.write(f"run_{name}", digest.embedding_todo(texts.withColumn("source_text_hash", F.sha2("text", 256)), store.read(name, VECTOR), ["owner"], budget))
        got = called(f"embedding_{kind}", todo.select("owner", "text"), "owner", models.embed)
        got = got.select("owner", runs.vector_reply(F.col("body"), cfg.dimensions).alias("v")).where("v is not null").join(todo.select("owner", "source_text_hash"), "owner")
        got = got.select("owner", F.lit(cfg.embedding_model).alias("model"), F.lit(cfg.embedding_version).alias("version"), F.lit(cfg.dimensions).alias("dimensions"), "v", "source_text_hash", now.alias("updated_at"))
        store.update(name, VECTOR, lambda t: records.embedding_rows(t, got, "owner").select(*t.columns))
        return todo.count()

    def run_items(batch: DataFrame) -> DataFrame:
        c = store.read("content", CONTENT).where(F.col("last_seen_run_id") == run_id).select("dedup_key", F.col("id").alias("item_id"), F.col("summary").alias("s"))
        return batch.join(c, "dedup_key").select("item_id", "title", F.coalesce("s", F.lit("")).alias("summary"), "rank", "source", "source_item_id", "url")

    def match(batch: DataFrame) -> DataFrame:
        items = run_items(batch)
        mapped = store.read("event_item", EVENT_ITEM).where("is_active").select(F.col("content_item_id").alias("item_id")).distinct()
        items = store.write("run_match", items.join(mapped, "item_id", "left_anti"))
        events = store.read("event", EVENT)
        replies, vectors = None, None
        if models.embed is not None:
            vec = lambda t, key: store.read(t, VECTOR).select(F.col("owner").alias(key), "v")
            vectors = (vec("content_vector", "item_id").join(items.select("item_id"), "item_id", "left_semi"), vec("event_vector", "event_id"))
        cand = store.write("run_candidate", candidates(items, mark_stale(events, now, cfg.stale_hours), now, cfg, vectors))
        if models.cluster is not None:
            # What the rule merges isn't asked about; a reply may name any candidate of either recall.
            sure = decide(items, cand, cfg).where("by = 'rule'").select("item_id")
            per = cand.groupBy("item_id").agg(F.sort_array(F.collect_list("event_id")).alias("candidates")).join(sure, "item_id", "left_anti")
            asked = items.select("item_id", "title", "summary").join(per, "item_id")
            got = called("cluster", asked.withColumn("candidates", F.array_join("candidates", ",")), "item_id", models.cluster).join(per, "item_id")
            reply = cluster_reply(F.col("body"), F.col("candidates"))
            replies = store.write("run_reply", got.select("item_id", reply.alias("r")).select("item_id", "r.decision", "r.event_id", "r.confidence", F.col("r.title").alias("reply_title"), F.col("r.summary").alias("reply_summary")))
        changed, mapping = match_run(items, events, now, cfg, replies, vectors, cand)
        changed = store.write("run_event", changed)
        mapping = store.write("run_mapping", mapping)
        store.write("event", changed.select(*events.columns))
        rows = mapping.select("event_id", F.col("item_id").alias("content_item_id"), "confidence", now.alias("matched_at"), "match_reason", F.lit(True).alias("is_active"), F.lit(None).cast("string").alias("created_by_merge_id"))
        store.update("event_item", EVENT_ITEM, lambda t: insert_ignore(t, rows, ["event_id", "content_item_id"]))
        count["matched"] = mapping.count()
        return changed.select("event_id", "reactivated")

    def tag(batch: DataFrame) -> None:
        if models.tag is not None:
            # Tags are asked for once: content that has some is left alone.
            have = store.read("content_tag", CONTENT_TAG).select(F.col("content_item_id").alias("item_id")).distinct()
            got = called("tagging", run_items(batch).select("item_id", "title", "summary").join(have, "item_id", "left_anti"), "item_id", models.tag)
            add_tags(digest.assign_tags(got.select("item_id", runs.tag_reply(F.col("body")).alias("tags")), "item_id", "tags", "llm"))
        links, content_tags = store.read("event_item", EVENT_ITEM), store.read("content_tag", CONTENT_TAG)
        store.update("event_tag", EVENT_TAG, lambda t: refresh_event_tags(links, content_tags, t))

    def score(returned: DataFrame | None) -> None:
        word = blacklist_keyword("canonical_title", "summary", [k for k in cfg.blacklist if k.strip()])
        events = store.update("event", EVENT, lambda t: t.withColumn("is_blacklisted", word.isNotNull() | F.coalesce("is_blacklisted", F.lit(False))) if cfg.blacklist else t)
        back = events.select("event_id", F.lit(False).alias("reactivated")) if returned is None else returned
        snap = store.read("snapshot", SNAPSHOT).where(F.col("run_id") == run_id)
        links = store.read("event_item", EVENT_ITEM).where("is_active").select("content_item_id", "event_id")
        prior = store.read("score", SCORE)
        prior = prior.where(F.col("run_id") != run_id)
        part = (snap.join(links, "content_item_id"), _scoring_state(events.join(back, "event_id", "left")), prior, now, cfg, registry.select(F.col("id").alias("source"), "weight"))
        scored = store.write("run_score", score_run(*part))
        count["blacklisted"] = scored.where("is_blacklisted").count()
        if models.judge is not None:
            due = scored.where(F.col("judge_gate").isin("reactivated", "eligible_before_judge", "near_eligibility")).join(events.select("event_id", "canonical_title", "summary"), "event_id")
            got = called("judge", due.select("event_id", "canonical_title", "summary", "sources", "total", "heat", F.array_join("reasons", ",").alias("reasons")), "event_id", models.judge)
            judged = store.write("run_judge", got.select("event_id", runs.judge_reply(F.col("body")).alias("j")).select("event_id", "j.importance", "j.boost", F.col("j.stage").alias("judged_stage")))
            count.update(judged=judged.count(), promoted=judged.where(judge_promotes("importance", "boost")).count())
            scored = store.write("run_score", score_run(*part, judged))
        rows = scored.select("event_id", F.col("total").alias("total_score"), F.col("heat").alias("heat_value"), "coverage", "rank_score", "trend", "persistence", "flash", "sources", F.col("stage").alias("current_stage"), F.col("reasons").alias("trigger_reasons"))
        store.update("score", SCORE, lambda t: records.score_snapshots(t, rows, run_id, now))
        marks = scored.select("event_id", F.col("stage").alias("current_stage"), "milestones")
        events = store.update("event", EVENT, lambda t: records.updated(t, marks, "event_id").select(*t.columns))
        due = scored.where("push_reason is not null").join(events.select("event_id", "canonical_title", "summary", "progress_summary"), "event_id")
        names = snap.join(links, "content_item_id").groupBy("event_id").agg(F.array_sort(F.collect_set("source")).alias("names"))
        text = runs.push_message(F.col("stage"), F.col("progress_summary"), F.col("summary"), F.col("reason"), F.col("names"), F.col("total"), F.col("heat"))
        messages = due.join(names, "event_id").select(
            F.col("event_id").cast("string").alias("event_id"), F.lit("Instant").alias("push_type"), F.lit(at).cast("timestamp").alias("pushed_at"), F.col("canonical_title").alias("title"), F.col("reason"),
            text.alias("content"), runs.push_key(F.col("event_id"), F.lit(run_id), F.col("reason")).alias("dedup_key"),
        )
        log, todo = records.push_attempts(store.read("push_log", records.PUSH), messages)
        todo = store.write("run_push", todo)
        store.write("push_log", log)
        sent = [] if models.push is None else [(m["dedup_key"], bool(models.push(m.asDict()))) for m in todo.orderBy("dedup_key").toLocalIterator()]
        count["pushed"] = sum(ok for _, ok in sent)
        done = spark.createDataFrame([(k, ok, None if ok else "push failed") for k, ok in sent], "dedup_key string, success boolean, error string")
        store.update("push_log", records.PUSH, lambda t: records.push_results(t, done))
        # An attempt that was recorded counts, whether it succeeded or not.
        tried = todo.select("event_id").join(scored.select("event_id", "sources", "rank_score", "total"), "event_id")
        after = events.select("event_id", "push_count").join(tried, "event_id").select(
            "event_id", (F.coalesce("push_count", F.lit(0)) + 1).alias("push_count"), now.alias("last_pushed_at"), F.col("sources").alias("last_push_source_count"),
            F.col("rank_score").alias("last_push_rank_score"), F.col("total").alias("last_push_score"),
        )
        if models.push is not None:
            store.update("event", EVENT, lambda t: records.updated(t, after, "event_id").select(*t.columns))

    def merge() -> int:
        if models.embed is None:
            return 0
        events, history = store.read("event", EVENT), store.read("merge_history", HISTORY)
        live = recallable(events, now, cfg, skip_blacklisted=True).join(store.read("event_vector", VECTOR).select(F.col("owner").alias("event_id"), "v"), "event_id")
        pairs = store.write("run_pair", merging.similar_pairs(live, cfg, history.select("source_id", "target_id")))
        replies = None
        if models.merge is not None:
            text = events.select("event_id", F.concat_ws("\n", "canonical_title", "summary").alias("text"))
            asked = pairs.join(text.withColumnsRenamed({"event_id": "source_id", "text": "source_text"}), "source_id").join(text.withColumnsRenamed({"event_id": "target_id", "text": "target_text"}), "target_id")
            asked = asked.withColumn("pair", F.concat_ws("|", "source_id", "target_id")).drop("target_last_seen_at")
            got = called("merge", asked, "pair", models.merge)
            reply = cluster_reply(F.col("body"), F.array(F.element_at(F.split("pair", r"\|"), 2)))
            replies = got.select(F.element_at(F.split("pair", r"\|"), 1).alias("source_id"), F.element_at(F.split("pair", r"\|"), 2).alias("target_id"), reply.alias("r"))
            replies = store.write("run_verdict", replies.select("source_id", "target_id", "r.decision", "r.confidence", F.lit("model").alias("reason")))
        chosen = store.write("run_merge", merging.secondary_merge(live, pairs, cfg, replies))
        if chosen.isEmpty():
            return 0
        rows = chosen.select(merging.merge_id(F.col("source_id"), F.col("target_id"), now).alias("id"), "source_id", "target_id", "confidence", "reason", "similarity", now.alias("created_at"))
        store.update("merge_history", HISTORY, lambda t: insert_ignore(t, rows, ["id"]))
        store.update("event", EVENT, lambda t: merging.fold_events(t, chosen))
        store.update("event_item", EVENT_ITEM, lambda t: merging.deactivate_items(merging.migrate_evidence(t, chosen, now), chosen))
        store.update("event_tag", EVENT_TAG, lambda t: merging.fold_tags(t, chosen))
        store.update("score", SCORE, lambda t: records.merged_snapshots(t, chosen, run_id, now, F.timestamp_add("HOUR", F.lit(-max(1, cfg.trend_window_hours)), now)))
        return chosen.count()

    def event_texts() -> DataFrame:
        c = store.read("content", CONTENT).select("id", "title")
        e = store.read("event", EVENT).where("status <> 'Merged'")
        tags, links = store.read("tag", records.TAG), store.read("event_tag", EVENT_TAG)
        return runs.embedding_inputs(e, store.read("event_item", EVENT_ITEM), c, links, tags).select(F.col("event_id").alias("owner"), "text")

    status, error = "Failed", None
    try:
        bodies = stages.run("fetch", fetch)
        batch = stages.run("ingest", lambda: take_in(bodies))
        stages.run("enrich", enrich)
        content = store.read("content", CONTENT).where(F.col("last_seen_run_id") == run_id).select(F.col("id").alias("owner"), F.concat_ws("\n", "title", "summary").alias("text"))
        used = stages.run("embedding", lambda: embed("content", content, cfg.embedding_budget), 0)
        returned = stages.run("match", lambda: match(batch))
        stages.run("tagging", lambda: tag(batch))
        stages.run("embedding", lambda: embed("event", event_texts(), max(0, cfg.embedding_budget - used)), 0)
        stages.run("score", lambda: score(returned))
        stages.skip("push", "part of score")
        count["merged"] = stages.run("secondary_merge", merge, 0)
        ok, failed = count.get("ok", 0), count.get("failed", 0)
        status = "Succeeded" if ok and not failed else "Partial" if ok else "Failed"
    except Exception as e:  # noqa: BLE001  the run is completed as failed, then the error goes on
        error = e
    store.put("fetch_run_stage", STAGE, "run_id", stages.frame(spark))
    spent = store.read("llm_usage", records.USAGE).where(F.col("run_id") == run_id).agg(F.coalesce(F.sum("estimated_cost"), F.lit(0)).cast("decimal(18,8)")).first()[0]
    done = spark.createDataFrame(
        [(run_id, status, count.get("ok", 0), count.get("failed", 0), count.get("items", 0), count.get("enriched", 0), count.get("matched", 0), count.get("pushed", 0), count.get("errors", []) + ([str(error)] if error else []))],
        "id string, status string, success_source_count int, failure_source_count int, fetched_item_count bigint, enriched_item_count bigint, matched_event_count bigint, pushed_event_count bigint, errors array<string>",
    ).withColumns({"finished_at": F.current_timestamp(), "estimated_llm_cost": F.lit(spent).cast("decimal(18,8)")})
    store.update("fetch_run", records.RUN, lambda t: records.updated(t, done, "id").select(*t.columns))
    if error:
        raise error
    return count | {"status": status, "stages": {(r[1], r[5]) for r in stages.rows}}
