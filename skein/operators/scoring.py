"""Event scoring for one run: evidence, heat series, components, triggers, push decision, stage, milestones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import score as S
from ..functions.text import strings
from ..sources.config import Config


def scoring_inputs(snapshot: DataFrame, event_item: DataFrame, event: DataFrame, content: DataFrame, run_id: str) -> DataFrame:
    """Evidence of one run by event (active items of events that aren't merged), sorted by rank, nulls last."""
    s = snapshot.where(F.col("run_id") == run_id)
    rows = (
        s.join(event_item.where("is_active").select("event_id", "content_item_id", "matched_at"), "content_item_id")
        .join(event.where("status <> 'Merged'").select(F.col("id").alias("event_id")), "event_id")
        .join(content.select(F.col("id").alias("content_item_id"), "title", "url"), "content_item_id")
    )
    item = F.struct(
        F.coalesce("rank", F.lit(2147483647)).alias("order"), "content_item_id", "source", "source_id", "content_kind", "rank", "normalized_rank_score", "freshness_score", "matched_at", "title", "url"
    )
    return rows.groupBy("event_id").agg(F.sort_array(F.collect_list(item)).alias("evidence"))


def evidence_totals(evidence: DataFrame, key: str, cfg: Config, weights: DataFrame | None = None) -> DataFrame:
    """Per event: source counts (case aside), ranks, heat and flash parts. Topics count for nothing."""
    kind = F.col("content_kind")
    ranked = (kind == "ranked_news") & F.col("rank").isNotNull() & F.col("normalized_rank_score").isNotNull()
    flash, src = kind == "flash_feed", F.lower("source")
    fresh = S.clamp("freshness_score")
    if weights is not None:
        # Named by a source's id or else by its name; Spark broadcasts the list if its size allows that.
        by = lambda c, n: weights.select(F.col("source").alias(c), F.col("weight").alias(n))
        evidence = evidence.join(by("source", "w_name"), "source", "left")
        if "source_id" in evidence.columns:
            evidence = evidence.join(by("source_id", "w_id"), "source_id", "left")
        evidence = evidence.withColumn("weight", F.coalesce(*[F.col(c) for c in ("w_id", "w_name") if c in evidence.columns]))
    weight = F.coalesce(F.max("weight"), F.lit(1.0)) if weights is not None else F.lit(1.0)
    dec = lambda c: c.cast("decimal(20,10)")
    zero = lambda c: F.coalesce(c.cast("double"), F.lit(0.0))
    return evidence.groupBy(key).agg(
        F.count_distinct(F.when(ranked | flash, src)).alias("sources"),
        F.count_distinct(F.when(ranked, src)).alias("ranked_sources"),
        F.count_distinct(F.when(flash, src)).alias("flash_sources"),
        F.count_if(flash).alias("n_flash"),
        zero(F.sum(dec(F.when(ranked, F.col("normalized_rank_score")))) / F.greatest(F.count_if(ranked), F.lit(1))).alias("avg_rank_score"),
        zero(F.avg(F.when(ranked, F.col("rank")))).alias("avg_rank"),
        zero(F.sum(dec(F.when(flash, fresh))) / F.greatest(F.count_if(flash), F.lit(1))).alias("freshness"),
        zero(F.coalesce(F.sum(dec(F.when(ranked, F.col("normalized_rank_score")))), F.lit(0)) + F.coalesce(F.sum(dec(F.when(flash, fresh))), F.lit(0))).alias("heat"),
        weight.alias("max_weight"),
    )


def heat_series(current: DataFrame, prior: DataFrame, key: str, at: Column, cfg: Config) -> DataFrame:
    """Adds ``series``: heats of prior snapshots inside the trend window, oldest first, then the current heat.

    Snapshots that a secondary merge wrote again (ids ending in ``:secondary_merge``) are no samples.
    """
    if "id" in prior.columns:
        prior = prior.where(~F.col("id").endswith(":secondary_merge"))
    inside = F.col("calculated_at") >= F.timestamp_add("HOUR", F.lit(-max(1, cfg.trend_window_hours)), at)
    old = prior.where(inside).groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("calculated_at", "heat_value"))), lambda x: x["heat_value"]).alias("past"))
    return current.join(old, key, "left").withColumn("past", F.coalesce("past", F.array().cast("array<double>"))).withColumn("series", F.array_append("past", F.col("heat")))


def components(df: DataFrame, at: Column, cfg: Config, llm: str | float = 0.0) -> DataFrame:
    """Adds the score's parts and the total. Needs the totals, ``series``, ``first_seen_at`` and ``reactivated``."""
    llm = F.lit(llm) if isinstance(llm, float) else F.col(llm)
    df = df.withColumn("smoothed", S.ewma("series"))
    df = df.select(
        "*",
        S.clamp(F.col("sources") / F.lit(float(max(1, cfg.source_count)))).alias("coverage"),
        S.clamp("avg_rank_score").alias("rank_score"),
        S.trend("smoothed").alias("trend"),
        S.clamp(S.hours_between(at, "first_seen_at") / F.lit(float(max(1, cfg.history_hours)))).alias("persistence"),
        S.flash_score("n_flash", "freshness", "flash_sources", cfg.source_count).alias("flash"),
        F.when(F.col("reactivated"), 10.0).otherwise(0.0).alias("bonus"),
        F.size("series").alias("samples"),
        F.element_at("smoothed", -1).alias("smoothed_heat"),
        llm.alias("llm_boost"),
    )
    return df.withColumn("total", S.total_score("coverage", "rank_score", "trend", "persistence", "llm_boost", "flash", "bonus"))


def series_sum() -> Column:
    return F.aggregate("series", F.lit(0.0), lambda a, x: a + x)


def triggers(cfg: Config) -> Column:
    """Trigger reasons, in order."""
    need = cfg.source_count
    gate = F.col("flash") >= cfg.rank_threshold
    rising = (F.col("samples") >= cfg.min_trend_samples) & (series_sum() >= cfg.min_trend_heat) & (F.col("trend") > 0)
    return F.array_compact(
        F.array(
            F.when((F.col("ranked_sources") >= need) & (F.col("rank_score") >= cfg.rank_threshold), "coverage_rank"),
            F.when(gate & (F.col("flash_sources") >= need), "flash_multi_source"),
            F.when(gate & (F.col("n_flash") >= need), "flash_repeated"),
            F.when(gate & F.col("reactivated") & (F.col("flash_sources") > 0), "flash_follow_up"),
            F.when(gate & (F.col("max_weight") > 1.0), "flash_trusted_source"),
            F.when(rising, "rising_trend"),
            F.when(F.col("reactivated"), "reactivation"),
        )
    )


def eligible(reasons: str = "reasons") -> Column:
    return ~F.col("is_blacklisted") & F.arrays_overlap(reasons, strings(S.ELIGIBLE))


def near_eligible(cfg: Config) -> Column:
    return (F.col("sources") >= max(1, cfg.source_count - 1)) | (F.col("heat") >= cfg.min_trend_heat) | (F.col("flash") >= cfg.rank_threshold)


def judge_gate_reason(cfg: Config) -> Column:
    """Why a judge may be asked about an event, or why not."""
    return (
        F.when(F.col("reactivated"), "reactivated")
        .when(F.col("sources") < cfg.source_count, "source_count_below_threshold")
        .when(eligible(), "eligible_before_judge")
        .when(near_eligible(cfg), "near_eligibility")
        .otherwise("not_near_eligibility")
    )


def judge_gate(cfg: Config) -> Column:
    """Which events a judge may be asked about."""
    return judge_gate_reason(cfg).isin("reactivated", "eligible_before_judge", "near_eligibility")


def judge_promotes(importance: str, boost: str) -> Column:
    return (F.col(boost) >= 0.5) | F.lower(importance).isin("high", "critical", "breaking")


def push_reason(cfg: Config) -> Column:
    """The reason that a push is due for, or null: first push, then what improved since the last one."""
    first = (F.col("push_count") == 0) | F.col("last_pushed_at").isNull()
    any_flash = F.arrays_overlap("reasons", strings([r for r in S.REASON_PRIORITY if r.startswith("flash_")]))
    return (
        F.when(F.col("is_blacklisted") | ~eligible(), None)
        .when(first & ((F.col("sources") >= cfg.source_count) | any_flash), "first_push")
        .when(first, None)
        .when(F.col("last_push_source_count").isNull() | (F.col("sources") - F.col("last_push_source_count") >= cfg.repeat_source_add), "source_increase")
        .when((F.col("ranked_sources") > 0) & (F.col("last_push_rank_score").isNull() | (F.col("rank_score") - F.col("last_push_rank_score") >= cfg.repeat_rank_improve)), "rank_improvement")
        .when(F.col("last_push_score").isNull() | (F.col("total") - F.col("last_push_score") >= cfg.repeat_score_improve), "score_improvement")
    )


def stage(cfg: Config, judged: str | None = None) -> Column:
    """Progress stage: a judge's, else by reactivation, trend, spread and cooling."""
    previous = F.coalesce(F.get("past", F.size("past") - 1), F.lit(0.0))
    own = (
        F.when(F.col("reactivated"), "FollowUp")
        .when((F.col("trend") >= 0.35) & (F.col("rank_score") >= cfg.rank_threshold), "Escalating")
        .when((F.col("sources") >= cfg.source_count) | (F.col("trend") > 0), "Expanding")
        .when((previous > F.col("heat")) & (F.col("samples") >= cfg.min_trend_samples), "Cooling")
        .otherwise("Initial")
    )
    return F.coalesce(F.col(judged), own) if judged else own


def milestones() -> Column:
    """Up to three: first seen, spread over more than one source, return, and a rise where there is room for it."""
    sure = F.array_compact(F.array(F.lit("first_seen"), F.when(F.col("sources") > 1, "source_expansion"), F.when(F.col("reactivated"), "reactivation")))
    rising = (F.size(sure) < 3) & (F.col("trend") > 0)
    return F.slice(F.when(rising, F.array_append(sure, F.lit("heat_rising"))).otherwise(sure), 1, 3)


def score_run(evidence: DataFrame, events: DataFrame, prior: DataFrame, at: Column, cfg: Config, weights: DataFrame | None = None, judged: DataFrame | None = None) -> DataFrame:
    """All of the above for every event with evidence; one shuffle by event for the totals, joins by event after it.

    ``events`` needs ``event_id, first_seen_at, reactivated, is_blacklisted, push_count, last_pushed_at, last_push_*``.
    ``judged(event_id, importance, boost, judged_stage)`` are a judge's replies, which add to the total, may promote an
    event and name its stage.
    """
    totals = evidence_totals(evidence, "event_id", cfg, weights)
    df = heat_series(totals, prior, "event_id", at, cfg).join(events, "event_id")
    if judged is None:
        df = components(df, at, cfg).withColumn("reasons", triggers(cfg))
    else:
        df = df.join(judged, "event_id", "left").withColumn("boost", F.coalesce("boost", F.lit(0.0)))
        df = components(df, at, cfg, "boost").withColumn("reasons", triggers(cfg))
        promoted = F.coalesce(judge_promotes("importance", "boost"), F.lit(False))
        df = df.withColumn("reasons", F.when(promoted, F.array_append("reasons", F.lit("judge_high_importance"))).otherwise(F.col("reasons")))
    df = df.withColumn("push_reason", push_reason(cfg)).withColumn("stage", stage(cfg, "judged_stage" if judged is not None else None)).withColumn("milestones", milestones())
    return df.withColumn("eligible", eligible()).withColumn("near_eligible", near_eligible(cfg)).withColumn("judge_gate", judge_gate_reason(cfg)).withColumn("reason", S.pick_reason(F.when(F.col("push_reason").isNotNull(), F.array_append("reasons", F.col("push_reason"))).otherwise(F.col("reasons"))))
