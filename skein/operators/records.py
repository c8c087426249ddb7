"""Records of runs, pushes, reports, tags and keys: every write is a new version of a small keyed table.

``Store`` keeps versions of tables as Parquet folders; the functions are pure (old, new) -> next version, so a
retried batch writes the same rows again.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.score import hex_id
from .state import insert_ignore, inserted, latest, merge_frames


class Store:
    """Named tables under one shared folder. ``write`` makes a new version and then names it as the current one, so a
    reader sees a whole version or the one before; the version before stays until the next write."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at, at.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _versions(self, name: str) -> list[int]:
        at, fs = self._fs(f"{self.root}/{name}")
        if not fs.exists(at):
            return []
        found = [s.getPath() for s in fs.listStatus(at)]
        # A version counts once its writer has committed it.
        return sorted(int(p.getName()[2:]) for p in found if p.getName().startswith("v=") and fs.exists(self._fs(f"{p}/_SUCCESS")[0]))

    def read(self, name: str, schema: str) -> DataFrame:
        """The current version, or an empty table."""
        at, fs = self._fs(f"{self.root}/{name}/parts")
        if fs.exists(at) and any(s.isDirectory() and "=" in s.getPath().getName() for s in fs.listStatus(at)):
            return self.spark.read.schema(schema).parquet(f"{self.root}/{name}/parts")
        v = self._versions(name)
        return self.spark.read.schema(schema).parquet(f"{self.root}/{name}/v={v[-1]}") if v else self.spark.createDataFrame([], schema)

    def write(self, name: str, df: DataFrame) -> DataFrame:
        v = self._versions(name)
        path = f"{self.root}/{name}/v={(v[-1] if v else 0) + 1}"
        df.write.mode("overwrite").parquet(path)
        for old in v[:-1]:
            at, fs = self._fs(f"{self.root}/{name}/v={old}")
            fs.delete(at, True)
        return self.spark.read.schema(df.schema).parquet(path)

    def put(self, name: str, schema: str, part: str, rows: DataFrame) -> None:
        """Replaces the partitions of ``part`` that ``rows`` has, and no other: a run that is tried again takes the place
        of its own rows, and what is written doesn't grow with the history. Such a table has no versions."""
        path = f"{self.root}/{name}/parts"
        kinds = self.spark.createDataFrame([], schema)
        rows = rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in kinds.schema])
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(part).parquet(path)

    def update(self, name: str, schema: str, change: Callable[[DataFrame], DataFrame]) -> DataFrame:
        return self.write(name, change(self.read(name, schema)))


RUN = (
    "id string, started_at timestamp, finished_at timestamp, status string, source_count int, success_source_count int, failure_source_count int, fetched_item_count bigint, "
    "enriched_item_count bigint, matched_event_count bigint, pushed_event_count bigint, estimated_llm_cost decimal(18,8), errors array<string>"
)
USAGE = (
    "call_set string, id string, run_id string, stage string, model string, owner string, input_tokens bigint, output_tokens bigint, cache_read_tokens bigint, estimated_cost decimal(18,8), "
    "duration_ms bigint, success boolean, retry_count int, error string, created_at timestamp_ntz"
)
STATE = "id string, key string, value string, updated_at timestamp"
PUSH = "id string, event_id string, push_type string, pushed_at timestamp, title string, reason string, content string, payload string, dedup_key string, success boolean, error string"
REPORT = "id string, report_type string, slot_time timestamp, generated_at timestamp, file_path string, public_url string, event_count int, payload_json string"
TAG = "id string, name string, display_name string, category string, created_at timestamp"


def run_id(at: datetime, unique: str) -> str:
    """``fr:``, the start to the millisecond, and the beginning of something unique: 31 characters."""
    return f"fr:{at:%Y%m%d%H%M%S}{at.microsecond // 1000:03d}:{unique}"[:31]


def run_started(runs: DataFrame, new: DataFrame) -> DataFrame:
    """Inserts runs as ``Running`` with nothing counted; ``new`` has id, started_at, source_count."""
    zero = {c: F.lit(0) for c in ("success_source_count", "failure_source_count", "fetched_item_count", "enriched_item_count", "matched_event_count", "pushed_event_count", "estimated_llm_cost")}
    rows = new.withColumns({**zero, "finished_at": F.lit(None), "status": F.lit("Running"), "errors": F.array()})
    rows = rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in runs.schema])
    return insert_ignore(runs, rows, ["id"])


def updated(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """An update by id: rows that aren't there are ignored, columns that aren't given stay."""
    here = new.join(old.select(key), key, "left_semi")
    return merge_frames(old, here, [key])


def keyed_state(state: DataFrame, new: DataFrame) -> DataFrame:
    """Upserts ``key, value, updated_at``; the id of a key is that of its first write."""
    rows = new.select(hex_id("as", 24, "key").alias("id"), "key", "value", "updated_at")
    return merge_frames(state, rows, ["key"], keep=("id",)).select(*state.columns)


def state_value(state: DataFrame, key: str) -> str | None:
    row = state.where(F.col("key") == key).select("value").first()
    return row[0] if row else None


def stage_rows(stages: DataFrame, new: DataFrame) -> DataFrame:
    """Upserts stages by id; run, name and start of a stage stay."""
    return merge_frames(stages, new, ["id"], keep=("run_id", "stage", "started_at"))


def source_rows(rows: DataFrame, new: DataFrame) -> DataFrame:
    """Upserts the outcome of a source in a run."""
    return merge_frames(rows, new, ["run_id", "source_id"], keep=tuple(c for c in ("category", "source") if c in rows.columns))


def source_dimension(sources: DataFrame, new: DataFrame) -> DataFrame:
    """Upserts sources by id; ``created_at`` stays."""
    return merge_frames(sources, new, ["id"], keep=("created_at",))


def push_attempts(log: DataFrame, messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(next log, messages to send): a message whose ``dedup_key`` is in the log isn't sent again; others enter it as
    pending before they are sent, so a crash in between costs a push and never doubles one."""
    first = latest(messages, ["dedup_key"], F.asc("pushed_at"), F.asc("title"))
    todo = inserted(log, first, ["dedup_key"]).where("inserted").drop("inserted")
    pending = todo.withColumns({"id": hex_id("pl", 24, "dedup_key"), "payload": F.lit("{}"), "success": F.lit(False), "error": F.lit("pending")})
    return log.unionByName(pending.select(*log.columns)), todo


def push_results(log: DataFrame, results: DataFrame) -> DataFrame:
    """Enters ``dedup_key, payload, success, error`` (and a final ``content``) of messages that were sent."""
    return updated(log, results, "dedup_key").select(*log.columns)


def report_rows(reports: DataFrame, new: DataFrame) -> DataFrame:
    """Upserts reports by type and slot; a blank payload is an empty object."""
    slot = F.date_format("slot_time", "yyyy-MM-dd'T'HH:mm:ss")
    rows = new.withColumn("id", F.concat(F.lit("report:"), F.col("report_type"), F.lit(":"), F.left(F.sha2(F.concat_ws("|", "report_type", slot), 256), F.lit(24))))
    rows = rows.withColumn("payload_json", object_if_blank("payload_json"))
    return merge_frames(reports, rows.select(*reports.columns), ["id"], keep=("report_type", "slot_time"))


def score_snapshots(snapshots: DataFrame, scores: DataFrame, run: str, at: Column) -> DataFrame:
    """Upserts a run's scores under ``ess:{run}:{event}``."""
    rows = scores.withColumns({"id": F.concat(F.lit(f"ess:{run}:"), F.col("event_id").cast("string")), "run_id": F.lit(run), "calculated_at": at})
    return merge_frames(snapshots, rows.select(*snapshots.columns), ["id"])


def merged_snapshots(snapshots: DataFrame, merged: DataFrame, run: str, at: Column, since: Column) -> DataFrame:
    """A merge's target gets a copy of its latest score in the window, marked by its id and a reason."""
    mine = snapshots.join(merged.select(F.col("target_id").alias("event_id")).distinct(), "event_id", "left_semi").where(F.col("calculated_at") >= since)
    last = latest(mine, ["event_id"], F.desc("calculated_at"), F.asc("id"))
    reasons = F.when(F.exists("trigger_reasons", lambda x: F.lower(x) == "secondary_merge"), F.col("trigger_reasons")).otherwise(F.array_append("trigger_reasons", F.lit("secondary_merge")))
    rows = last.withColumns({"id": F.concat(F.lit(f"ess:{run}:"), F.col("event_id").cast("string"), F.lit(":secondary_merge")), "run_id": F.lit(run), "calculated_at": at, "trigger_reasons": reasons})
    return merge_frames(snapshots, rows.select(*snapshots.columns), ["id"])


def tag_dimension(tags: DataFrame, new: DataFrame, at: Column) -> DataFrame:
    """Upserts tags by name: display name and category are refreshed, id and creation stay."""
    rows = new.select(hex_id("tag", 24, F.lower(F.trim(F.col("name")))).alias("id"), "name", "display_name", "category", at.alias("created_at"))
    return merge_frames(tags, rows.dropDuplicates(["name"]), ["name"], keep=("id", "created_at")).select(*tags.columns)


def usage_rows(calls: DataFrame, key: str, run: str, stage: str, cfg, at: Column) -> DataFrame:
    """A row a model call, from what its body says of tokens, at the configured prices; ``call_set`` is run and stage."""
    from ..functions.score import estimated_cost
    from ..sources.feeds import token_usage

    n = token_usage(F.col("body"))
    model, prices = cfg.models.get(stage, stage), cfg.prices.get(cfg.models.get(stage, stage), ("0", "0", "0"))
    cost = estimated_cost(n["prompt"], n["completion"], n["cached"], *prices)
    return calls.select(
        F.lit(f"{run}:{stage}").alias("call_set"), hex_id("lu", 24, F.lit(run), F.lit(stage), F.col(key)).alias("id"), F.lit(run).alias("run_id"), F.lit(stage).alias("stage"), F.lit(model).alias("model"),
        F.col(key).cast("string").alias("owner"), n["prompt"].alias("input_tokens"), n["completion"].alias("output_tokens"), n["cached"].alias("cache_read_tokens"), cost.alias("estimated_cost"),
        "duration_ms", "success", "retry_count", "error", at.alias("created_at"),
    )


def embedding_rows(vectors: DataFrame, new: DataFrame, owner: str) -> DataFrame:
    """Upserts vectors by owner, model, version and dimensions."""
    return merge_frames(vectors, new, [owner, "model", "version", "dimensions"])


def without_parents(child: DataFrame, gone: DataFrame, child_key: str, parent_key: str, set_null: bool = False) -> DataFrame:
    """What deleting the parents ``gone`` leaves of a child table: rows go with them, or lose the reference."""
    dead = gone.select(F.col(parent_key).alias(child_key)).distinct()
    if not set_null:
        return child.join(dead, child_key, "left_anti").select(*child.columns)
    marked = child.join(dead.withColumn("__gone", F.lit(True)), child_key, "left")
    return marked.withColumn(child_key, F.when(F.col("__gone"), None).otherwise(F.col(child_key))).select(*child.columns)


def event_ids_by_tag(event_tag: DataFrame, tag: DataFrame, name: str) -> DataFrame:
    """Events that carry the tag, most certain first (the order is for presentation)."""
    mine = event_tag.join(tag.where(F.col("name") == name).select(F.col("id").alias("tag_id")), "tag_id", "left_semi")
    return mine.select("event_id", "confidence").orderBy(F.desc("confidence"), "event_id")


def backfill(rows: DataFrame, dimension: DataFrame, on: dict[str, str], column: str, value: str) -> DataFrame:
    """Fills nulls of ``column`` with ``value`` of the dimension row whose columns equal the row's (``on``: row to
    dimension); of several such rows the least value."""
    d = dimension.groupBy(*[F.col(b).alias(f"__{a}") for a, b in on.items()]).agg(F.min(value).alias("__v"))
    cond = [F.col(a) == F.col(f"__{a}") for a in on]
    df = rows.join(d, cond, "left")
    return df.withColumn(column, F.coalesce(column, "__v")).select(*rows.columns)


def object_if_blank(text) -> Column:
    """JSON text, or an empty object where there is none."""
    c = F.col(text) if isinstance(text, str) else text
    return F.when(F.trim(F.coalesce(c, F.lit(""))) == "", F.lit("{}")).otherwise(c)


def json_list(text) -> Column:
    """A JSON list of strings; blank or broken text is an empty list."""
    c = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.from_json(F.nullif(F.trim(c), F.lit("")), "array<string>"), F.array().cast("array<string>"))
