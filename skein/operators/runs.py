"""Run-level helpers: source registry, snapshot order, embedding inputs, usage summaries, rejection counts, stages, digest job."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import cap_text, distinct_ci, first_text
from ..sources.config import Config
from .digest import digest_key, due_slot


@dataclass(frozen=True)
class Source:
    provider: str
    category: str
    external_id: str
    content_kind: str = "ranked_news"
    weight: float = 1.0
    enabled: bool = True
    id: str = ""
    display_name: str = ""

    @property
    def key(self) -> str:
        return self.id or f"{self.provider}:{self.category}:{self.external_id}"


def registry(spark: SparkSession, sources: list[Source]) -> DataFrame:
    """The enabled sources as a frame; ids default to provider, category and external id."""
    rows = [(s.key, s.provider, s.category, s.external_id, s.content_kind, s.display_name or s.key, float(s.weight)) for s in sources if s.enabled]
    return spark.createDataFrame(rows, "id string, provider string, category string, external_id string, content_kind string, display_name string, weight double")


def fetch_all(sources: DataFrame, fetch: Callable[[dict], str], parallel: int = 4) -> DataFrame:
    """``source_id, status, body, error, duration_ms``: one call a source, at most ``parallel`` at a time; a failure is
    a row, not an exception."""
    cols = sources.columns

    def run(frames):
        import pandas as pd

        for pdf in frames:
            out = []
            for row in pdf.to_dict("records"):
                start = time.time()
                try:
                    out.append((row["id"], "succeeded", fetch({c: row[c] for c in cols}), None))
                except Exception as e:  # noqa: BLE001  isolated by contract
                    out.append((row["id"], "failed", None, f"{type(e).__name__}: {e}"))
                out[-1] += (int((time.time() - start) * 1000),)
            yield pd.DataFrame(out, columns=["source_id", "status", "body", "error", "duration_ms"])

    return sources.repartition(parallel).mapInPandas(run, "source_id string, status string, body string, error string, duration_ms bigint")


def visual_order(snapshot: DataFrame, run: str = "run_id") -> DataFrame:
    """Adds the running number of each snapshot in its run: by category, source, rank (none last) and title, case aside.

    Numbered on two levels: within (run, category, source), and by those groups' counts, so a run of any size isn't
    sorted in one task.
    """
    part = [F.upper("category").alias("__c"), F.upper("source").alias("__s")]
    rows = snapshot.select("*", *part)
    inner = Window.partitionBy(run, "__c", "__s").orderBy(F.coalesce("rank", F.lit(2147483647)), F.upper("title"), "content_item_id")
    outer = Window.partitionBy(run).orderBy("__c", "__s").rowsBetween(Window.unboundedPreceding, -1)
    groups = rows.groupBy(run, "__c", "__s").agg(F.count("*").alias("__n"))
    groups = groups.select(F.col(run).alias("__r"), F.col("__c").alias("__gc"), F.col("__s").alias("__gs"), F.coalesce(F.sum("__n").over(outer), F.lit(0)).alias("__o"))
    same = F.col(run).eqNullSafe(F.col("__r")) & F.col("__c").eqNullSafe(F.col("__gc")) & F.col("__s").eqNullSafe(F.col("__gs"))
    out = rows.withColumn("__i", F.row_number().over(inner)).join(groups, same)
    return out.withColumn("visual_order", (F.col("__o") + F.col("__i")).cast("int")).drop("__c", "__s", "__i", "__o", "__r", "__gc", "__gs")


def embedding_inputs(event: DataFrame, event_item: DataFrame, content: DataFrame, event_tag: DataFrame, tag: DataFrame, cap: int = 2000, titles: int = 3) -> DataFrame:
    """``event_id, text, source_text_hash`` from title, summary, latest item titles and tag names."""
    t = event_item.where("is_active").join(content.select(F.col("id").alias("content_item_id"), "title"), "content_item_id")
    newest = F.transform(F.sort_array(F.collect_list(F.struct((-F.unix_micros(F.col("matched_at").cast("timestamp"))).alias("t"), "title"))), lambda x: x["title"])
    t = t.groupBy("event_id").agg(F.slice(newest, 1, titles).alias("titles"))
    g = event_tag.join(tag.select(F.col("id").alias("tag_id"), "display_name"), "tag_id").groupBy("event_id").agg(F.array_sort(F.collect_set("display_name")).alias("tags"))
    df = event.join(t, "event_id", "left").join(g, "event_id", "left")
    text = cap_text("canonical_title", "summary", F.array_join("titles", "\n"), F.array_join("tags", " "), limit=cap)
    return df.select("event_id", text.alias("text")).withColumn("source_text_hash", F.sha2("text", 256))


def latest_title(items: DataFrame) -> DataFrame:
    """Each event's newest title that isn't blank."""
    return items.where(first_text("title").isNotNull()).groupBy("event_id").agg(F.max_by("title", F.struct("matched_at", "content_item_id")).alias("title"))


def first_link(evidence: Column) -> Column:
    """The first link in evidence order."""
    return F.get(F.filter(F.transform(evidence, lambda e: F.coalesce(F.nullif(F.trim(e["mobile_url"]), F.lit("")), F.nullif(F.trim(e["url"]), F.lit("")))), lambda x: x.isNotNull()), F.lit(0))


def reactivated(first_seen, last_activated, run_start, at) -> Column:
    return (F.col(first_seen) < run_start) & (F.col(last_activated) >= run_start) & (F.col(last_activated) <= at)


def usage_summary(usage: DataFrame) -> DataFrame:
    """Calls and decimal cost of each run."""
    return usage.groupBy("run_id").agg(F.count("*").alias("calls"), F.coalesce(F.sum("estimated_cost"), F.lit(0)).alias("cost"), F.count_if(~F.col("success")).alias("failed"))


def rejection_text(decisions: DataFrame, key: str = "run_id", reason: str = "reason") -> DataFrame:
    """Reasons and their counts by run, as sorted ``reason:count`` text."""
    n = decisions.groupBy(key, reason).agg(F.count("*").alias("n"))
    parts = F.array_sort(F.collect_list(F.concat_ws(":", reason, F.col("n").cast("string"))))
    return n.groupBy(key).agg(F.array_join(parts, ", ").alias("rejections"))


def push_message(stage, summary, fallback, reason, sources, total, heat) -> Column:
    """The pushed line: stage, summary (or the event's own), spelled reason, up to three sources, figures."""
    first = lambda c, other: F.when(F.trim(F.coalesce(c, F.lit(""))) == "", other).otherwise(c)
    names = F.array_join(F.slice(distinct_ci(sources), 1, 3), ", ")
    return F.concat(
        F.lit("["), first(stage, F.lit("Initial")), F.lit("] "), F.coalesce(first(summary, fallback), F.lit("")), F.lit(" WhyNow="), F.replace(reason, F.lit("_"), F.lit(" ")),
        F.lit(",Source="), names, F.lit(",Score="), F.format_string("%.1f", total), F.lit(",Heat="), F.format_string("%.2f", heat), F.lit("。"),
    )


def push_key(event_id, run_id, reason) -> Column:
    return F.concat_ws(":", F.lit("instant"), event_id, run_id, reason)


def judge_reply(content) -> Column:
    """``importance, boost, labels, stage``: boost from 0 to 1, stage in its known spelling or null."""
    from ..sources.feeds import clamped, unfence

    r = F.from_json(unfence(content), "struct<importance:string,boostScore:double,labels:array<string>,reason:string,summary:string,stage:string>")
    stages = F.array(*[F.lit(s) for s in ("Initial", "Expanding", "Escalating", "FollowUp", "Cooling")])
    stage = F.get(F.filter(stages, lambda s: F.lower(s) == F.lower(F.trim(r["stage"]))), F.lit(0))
    boost = clamped(r["boostScore"])
    return F.struct(F.coalesce(r["importance"], F.lit("normal")).alias("importance"), boost.alias("boost"), F.coalesce(r["labels"], F.array().cast("array<string>")).alias("labels"), stage.alias("stage"))


def tag_reply(content) -> Column:
    return F.filter(F.transform(F.split(content, r"\|"), lambda x: F.trim(x)), lambda x: x != "")


def vector_reply(text, dimensions: int) -> Column:
    """A JSON array as a vector; null unless it has exactly the dimensions."""
    v = F.from_json(text, "array<float>")
    return F.when(F.size(v) == dimensions, v)


@dataclass
class Stages:
    """Runs a pipeline's stages, times them, and isolates failures of all but the named ones."""

    run_id: str
    fatal: tuple[str, ...] = ("fetch", "ingest")
    rows: list[tuple] = field(default_factory=list)

    def run(self, name: str, work: Callable, default=None):
        start, out, error = datetime.now(), default, None
        try:
            out = work()
        except Exception as e:  # noqa: BLE001  isolated by contract
            error = e
        end = datetime.now()
        self.rows.append((self.run_id, name, start, end, int((end - start).total_seconds() * 1000), "failed" if error else "succeeded", str(error) if error else None))
        if error and name in self.fatal:
            raise error
        return out

    def skip(self, name: str, why: str) -> None:
        now = datetime.now()
        self.rows.append((self.run_id, name, now, now, 0, "skipped", why))

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, "run_id string, stage string, started_at timestamp, finished_at timestamp, duration_ms bigint, status string, error string")


def digest_job(candidates: Callable[[], DataFrame], at: datetime, cfg: Config, done: set[str], pushed: set[str], push: Callable[[dict], bool]) -> dict | None:
    """One digest slot: nothing if none is due or it was processed; a slot whose push log exists isn't sent again."""
    due = due_slot(at, cfg.push_times, cfg.time_zone, done)
    if due is None:
        return None
    key = digest_key(*due)
    if key in pushed:
        done.add(f"digest:processed:{due[0]}:{due[1]}")
        return {"dedup_key": key, "sent": False}
    events = [r.asDict(True) for r in candidates().collect()]
    pushed.add(key)
    ok = bool(push({"dedup_key": key, "events": events})) if events else True
    done.add(f"digest:processed:{due[0]}:{due[1]}")
    return {"dedup_key": key, "sent": bool(events), "success": ok, "events": len(events)}
