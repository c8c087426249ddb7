"""Reference-shaped frames made from the benchmark tables; the registered queries run the operators on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fetch_runs(orders: DataFrame) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", "Succeeded").when(F.col("o_orderstatus") == "O", "Partial").otherwise("Failed")
    return orders.select(
        F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("started_at"), F.col("o_orderdate").alias("finished_at"), status.alias("status"),
        F.lit(3).alias("source_count"), (F.col("o_custkey") % 50).alias("fetched_item_count"), F.col("o_totalprice").cast("decimal(18,8)").alias("estimated_llm_cost"),
    )


def run_sources(events: DataFrame) -> DataFrame:
    status = F.when(F.col("event_type") == "error", "failed").otherwise("succeeded")
    return events.select(F.col("user_id").cast("string").alias("source_id"), status.alias("status"), F.when(F.col("event_type") == "error", F.col("props")).alias("error"), F.col("ts").alias("created_at"))


def sources(customer: DataFrame) -> DataFrame:
    return customer.select(F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("display_name"), F.col("c_mktsegment").alias("provider"), F.lit("ranked_news").alias("content_kind"))


def run_stages(events: DataFrame) -> DataFrame:
    skipped = F.when(F.col("user_id") % 10 == 0, "skipped").otherwise("succeeded")
    return events.select(F.to_date("ts").cast("string").alias("run_id"), F.col("event_type").alias("stage"), F.col("ts").alias("started_at"), F.col("value").alias("duration_ms"), skipped.alias("status"))


def usage(lineitem: DataFrame) -> DataFrame:
    return lineitem.select(
        F.col("l_returnflag").alias("stage"), F.col("l_linestatus").alias("model"), F.col("l_shipdate").alias("created_at"), F.col("l_partkey").alias("input_tokens"),
        F.col("l_suppkey").alias("output_tokens"), F.col("l_linenumber").alias("cache_read_tokens"), F.col("l_extendedprice").cast("decimal(18,8)").alias("estimated_cost"),
        F.col("l_quantity").cast("int").alias("duration_ms"), (F.col("l_linenumber") < 5).alias("success"),
    )


def news_events(events: DataFrame) -> DataFrame:
    kind = F.when(F.col("user_id") % 2 == 0, "NewsEvent").otherwise("Topic")
    at = lambda t: F.when(F.col("event_type") == t, F.col("ts"))
    return events.where(F.col("event_type").isin("signup", "purchase")).select(
        F.col("event_id").alias("id"), kind.alias("type"), F.when(F.col("user_id") % 13 == 0, "Merged").otherwise("Active").alias("status"), at("signup").alias("first_seen_at"), at("purchase").alias("last_pushed_at")
    )


def pushes(events: DataFrame) -> DataFrame:
    return events.where(F.col("event_type").isin("click", "view")).select(
        F.col("ts").alias("pushed_at"), F.when(F.col("event_type") == "click", "Instant").otherwise("Digest").alias("push_type"), (F.col("user_id") % 4 != 0).alias("success")
    )


def daily_runs(events: DataFrame) -> DataFrame:
    day = F.to_date("ts").cast("string")
    return events.groupBy(day.alias("id")).agg(
        F.min("ts").alias("started_at"), F.max("ts").alias("finished_at"), F.lit("Succeeded").alias("status"), F.count_distinct("user_id").alias("source_count"),
        F.count("*").alias("fetched_item_count"), F.sum(F.col("value").cast("decimal(18,8)")).alias("estimated_llm_cost"),
    )


def stage_totals(events: DataFrame) -> DataFrame:
    return events.groupBy(F.to_date("ts").cast("string").alias("run_id"), F.col("event_type").alias("stage")).agg(F.count("*").alias("duration_ms"))


def snapshots(events: DataFrame) -> DataFrame:
    """Each event as a content snapshot: views and clicks are ranks, errors and signups flashes, purchases topics."""
    kind = F.when(F.col("event_type").isin("view", "click"), "ranked_news").when(F.col("event_type").isin("error", "signup"), "flash_feed").otherwise("topic")
    rank = F.when(F.col("event_type").isin("view", "click"), (F.col("event_id") % 21 + 1).cast("int"))
    flash = F.col("event_type").isin("error", "signup")
    last = F.lit("2024-01-31").cast("date")
    return events.select(
        F.col("event_id").alias("content_item_id"), F.col("user_id").alias("event_id"), "ts", F.to_date("ts").alias("day"),
        F.concat_ws("-", "event_type", (F.col("event_id") % 5).cast("string")).alias("source"), kind.alias("content_kind"), rank.alias("rank"),
        F.when(rank.isNotNull(), (F.lit(1.0) - (rank - 1) / F.lit(20.0))).alias("normalized_rank_score"),
        F.when(flash, F.lit(1.0) / (F.lit(1.0) + F.abs(F.datediff(last, "ts")).cast("double"))).otherwise(0.0).alias("freshness_score"),
    )


def event_state(events: DataFrame) -> DataFrame:
    u = F.col("event_id")
    return events.groupBy(F.col("user_id").alias("event_id")).agg(F.min("ts").alias("first_seen_at")).select(
        "event_id", "first_seen_at", F.when(u % 9 > 0, F.col("first_seen_at")).alias("last_pushed_at"), (u % 7 == 0).alias("reactivated"), (u % 11 == 0).alias("is_blacklisted"), (u % 3).alias("push_count"),
        F.when(u % 5 > 0, u % 4).alias("last_push_source_count"), F.when(u % 2 == 0, F.lit(0.5)).alias("last_push_rank_score"), F.when(u % 3 > 0, F.lit(60.0)).alias("last_push_score"),
    )
