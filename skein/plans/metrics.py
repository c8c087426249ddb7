"""Operational metrics views and alert queries over run telemetry.

Every view takes its tables as DataFrames and ``as_of`` as a one-row DataFrame (no wall clock), so windows such as
"the last 30 days" are relative to it. Statuses are compared in lower case; rates are doubles with two decimals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The order in which a view is shown; views themselves carry none.
VIEW_ORDER = {
    "run_success_rate": lambda: [F.desc("run_date")],
    "run_source_failure_rate": lambda: [F.desc("fetch_date"), F.desc("failure_rate_pct"), F.asc("source_id")],
    "run_stage_duration": lambda: [F.desc("run_date"), F.asc("stage")],
    "llm_daily_cost": lambda: [F.desc("usage_date"), F.asc("stage"), F.asc("model")],
    "event_daily_counts": lambda: [F.desc("event_date")],
    "event_tag_distribution": lambda: [F.desc("event_count"), F.asc("category"), F.asc("tag_name")],
}


def placed(view: DataFrame, *order: Column) -> DataFrame:
    """A view's rows with their ``place`` in an order of presentation (views are aggregates, so few rows)."""
    return view.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)))



def _sql(text: str, **frames: DataFrame) -> DataFrame:
    return next(iter(frames.values())).sparkSession.sql(text, **frames)


def _rate(n: str, m: str = "count(*)") -> str:
    return f"cast(round(100.0 * {n} / nullif({m}, 0), 2) as double)"


def run_success_rate(fetch_run: DataFrame, as_of: DataFrame) -> DataFrame:
    """M1: runs by day, their outcome and cost, over 30 days."""
    return _sql(
        f"""select to_date(finished_at) run_date, count(*) total_runs, count_if(lower(status) = 'succeeded') succeeded_runs,
          count_if(lower(status) = 'partial') partial_runs, count_if(lower(status) = 'failed') failed_runs,
          {_rate("count_if(lower(status) in ('succeeded', 'partial'))")} success_rate_pct,
          cast(coalesce(sum(estimated_llm_cost), 0) as double) total_llm_cost
        from {{t}} where finished_at is not null and finished_at >= (select * from {{a}}) - interval 30 days group by 1""",
        t=fetch_run, a=as_of,
    )


def run_source_failure_rate(fetch_run_source: DataFrame, source: DataFrame, as_of: DataFrame) -> DataFrame:
    """M2: fetches by source and day with failure rate and the distinct errors."""
    return _sql(
        f"""select f.source_id, coalesce(s.display_name, f.source_id) display_name, s.provider, s.content_kind, to_date(f.created_at) fetch_date,
          count(*) total_fetches, count_if(f.status = 'succeeded') succeeded_fetches, count_if(f.status = 'failed') failed_fetches,
          {_rate("count_if(f.status = 'failed')")} failure_rate_pct,
          nullif(array_join(array_sort(collect_set(case when f.status = 'failed' then f.error end)), '; '), '') recent_errors
        from {{f}} f left join {{s}} s on f.source_id = s.id where f.created_at >= (select * from {{a}}) - interval 30 days
        group by f.source_id, s.display_name, s.provider, s.content_kind, to_date(f.created_at)""",
        f=fetch_run_source, s=source, a=as_of,
    )


def run_stage_duration(fetch_run_stage: DataFrame, as_of: DataFrame) -> DataFrame:
    """M3: durations of stages that weren't skipped, by day, with exact percentiles."""
    return _sql(
        """select stage, to_date(started_at) run_date, count(*) stage_count, cast(round(avg(cast(duration_ms as decimal(18, 4)))) as double) avg_duration_ms,
          percentile_cont(0.5) within group (order by duration_ms) p50_duration_ms, percentile_cont(0.95) within group (order by duration_ms) p95_duration_ms,
          min(duration_ms) min_duration_ms, max(duration_ms) max_duration_ms
        from {t} where started_at >= (select * from {a}) - interval 30 days and status != 'skipped' group by 1, 2""",
        t=fetch_run_stage, a=as_of,
    )


def llm_daily_cost(llm_usage: DataFrame, as_of: DataFrame) -> DataFrame:
    """M4: calls, tokens and cost by stage, model and day."""
    return _sql(
        """select stage, model, to_date(created_at) usage_date, count(*) call_count, coalesce(sum(input_tokens), 0) total_input_tokens,
          coalesce(sum(output_tokens), 0) total_output_tokens, coalesce(sum(cache_read_tokens), 0) total_cache_read_tokens,
          cast(sum(estimated_cost) as double) total_estimated_cost, cast(round(avg(duration_ms)) as double) avg_duration_ms, count_if(not success) failed_calls
        from {t} where created_at >= (select * from {a}) - interval 30 days group by 1, 2, 3""",
        t=llm_usage, a=as_of,
    )


def llm_cost_trend(llm_usage: DataFrame, as_of: DataFrame, days: int = 7) -> DataFrame:
    """M5: cost by day over a week."""
    return _sql(
        f"""select to_date(created_at) usage_date, count(*) call_count, cast(sum(estimated_cost) as double) total_estimated_cost,
          coalesce(sum(input_tokens), 0) total_input_tokens, coalesce(sum(output_tokens), 0) total_output_tokens
        from {{t}} where created_at >= (select * from {{a}}) - interval {days} days group by 1""",
        t=llm_usage, a=as_of,
    )


def llm_stage_cost_share(llm_usage: DataFrame) -> DataFrame:
    """M6: each stage's share of all cost. Stages are grouped before the total is taken, so no scan is repeated."""
    return _sql(
        f"""with s as (select stage, sum(estimated_cost) c, count(*) n from {{t}} group by stage)
        select stage, cast(c as double) total_cost, n call_count, {_rate("c", "(select sum(c) from s)")} cost_pct from s""",
        t=llm_usage,
    )


def event_daily_counts(event: DataFrame, push_log: DataFrame, as_of: DataFrame) -> DataFrame:
    """M7: new events, pushed events and pushes by day, over 30 days."""
    return _sql(
        """with n as (select to_date(first_seen_at) d, count(*) new_events, count_if(type = 'NewsEvent') news_events, count_if(type = 'Topic') topic_events
            from {e} where status != 'Merged' and first_seen_at >= (select * from {a}) - interval 30 days group by 1),
          p as (select to_date(last_pushed_at) d, count(*) pushed_events from {e}
            where status != 'Merged' and last_pushed_at >= (select * from {a}) - interval 30 days group by 1),
          l as (select to_date(pushed_at) d, count_if(push_type = 'Instant') instant_pushes, count_if(push_type = 'Digest') digest_pushes
            from {l} where success and pushed_at >= (select * from {a}) - interval 30 days group by 1)
        select coalesce(n.d, p.d, l.d) event_date, coalesce(new_events, 0) new_events, coalesce(news_events, 0) news_events, coalesce(topic_events, 0) topic_events,
          coalesce(pushed_events, 0) pushed_events, coalesce(instant_pushes, 0) instant_pushes, coalesce(digest_pushes, 0) digest_pushes
        from n full join p on n.d = p.d full join l on coalesce(n.d, p.d) = l.d""",
        e=event, l=push_log, a=as_of,
    )


_BUCKET = "case when total_score < 30 then '0-30' when total_score < 60 then '30-60' when total_score < 80 then '60-80' else '80-100' end"


def event_score_distribution(score: DataFrame, event: DataFrame, fetch_run: DataFrame) -> DataFrame:
    """M8: score buckets of the latest finished run."""
    avg = lambda c, d=2: f"cast(round(avg(cast(s.{c} as decimal(18, 6))), {d}) as double)"
    return _sql(
        f"""select {_BUCKET} score_bucket, count(*) event_count, {avg("total_score", 1)} avg_total_score, {avg("coverage_score")} avg_coverage, {avg("rank_score")} avg_rank,
          {avg("trend_score")} avg_trend, {avg("persistence_score")} avg_persistence
        from {{s}} s join {{e}} e on s.event_id = e.id
        where s.run_id = (select max_by(id, struct(finished_at, id)) from {{r}} where finished_at is not null) and not e.is_blacklisted and e.status != 'Merged' group by 1""",
        s=score, e=event, r=fetch_run,
    )


def event_tag_distribution(event_tag: DataFrame, tag: DataFrame, event: DataFrame) -> DataFrame:
    """M9: events by tag, with mean confidence."""
    return _sql(
        """select t.category, t.display_name tag_name, count(distinct et.event_id) event_count, cast(round(avg(cast(et.confidence as decimal(18, 6))), 2) as double) avg_confidence
        from {et} et join {t} t on et.tag_id = t.id join {e} e on et.event_id = e.id where e.status != 'Merged' group by 1, 2""",
        et=event_tag, t=tag, e=event,
    )


def latest_run_summary(fetch_run: DataFrame, fetch_run_stage: DataFrame, stages: list[str]) -> DataFrame:
    """M10: the latest finished run with a column for each stage's duration."""
    pivot = ", ".join(f"coalesce(max(case when stage = '{s}' then duration_ms end), 0) {s}_ms" for s in stages)
    names = ", ".join(f"coalesce(p.{s}_ms, 0) {s}_ms" for s in stages)
    return _sql(
        f"""with r as (select * from {{r}} where finished_at is not null order by finished_at desc, id limit 1),
          p as (select g.run_id, {pivot} from {{g}} g left semi join r on g.run_id = r.id group by g.run_id)
        select r.id run_id, r.status, r.source_count, r.fetched_item_count, cast(r.estimated_llm_cost as double) llm_cost,
          cast(round(cast(timestampdiff(second, r.started_at, r.finished_at) as decimal(18, 2)) / 60, 1) as double) duration_minutes, {names}
        from r left join p on r.id = p.run_id""",
        r=fetch_run, g=fetch_run_stage,
    )


def health_snapshot(fetch_run: DataFrame, llm_usage: DataFrame, event: DataFrame, push_log: DataFrame, as_of: DataFrame) -> DataFrame:
    """M11: one row of totals over 7 days, there even if every table is empty."""
    since = "(select * from {a}) - interval 7 days"
    per_run = lambda x, d: f"cast(coalesce(round({x}, {d}), 0) as double)"
    return _sql(
        f"""with r as (select count(*) total_runs, {_rate("count_if(lower(status) in ('succeeded', 'partial'))")} success_rate_pct, coalesce(sum(estimated_llm_cost), 0) cost,
              avg(cast(timestampdiff(microsecond, started_at, finished_at) as decimal(28, 0))) mean_us, min(finished_at) window_start, max(finished_at) window_end
              from {{r}} where finished_at is not null and finished_at >= {since}),
          l as (select count(*) llm_calls, count_if(not success) llm_failures from {{l}} where created_at >= {since}),
          e as (select count(*) new_events from {{e}} where status != 'Merged' and first_seen_at >= {since}),
          x as (select count_if(status = 'Active') active_events from {{e}}),
          p as (select count(*) total_pushes, count_if(push_type = 'Instant') instant_pushes, count_if(push_type = 'Digest') digest_pushes from {{p}} where pushed_at >= {since})
        select total_runs, success_rate_pct, cast(cost as double) total_llm_cost, {per_run("cost / nullif(total_runs, 0)", 6)} avg_llm_cost_per_run,
          {per_run("mean_us / 60000000", 1)} avg_run_duration_minutes, new_events, active_events, {per_run("cast(new_events as decimal(28, 6)) / nullif(total_runs, 0)", 1)} avg_new_events_per_run,
          total_pushes, instant_pushes, digest_pushes, llm_calls, llm_failures, window_start, window_end
        from r cross join l cross join e cross join x cross join p""",
        r=fetch_run, l=llm_usage, e=event, p=push_log, a=as_of,
    )


def cost_alert(llm_usage: DataFrame, as_of: DataFrame, factor: float = 2.0) -> DataFrame:
    """Today's cost against the mean day of the seven before, flagged above ``factor`` times it."""
    return _sql(
        f"""with d as (select to_date(created_at) day, sum(estimated_cost) c from {{t}}
            where created_at >= date_trunc('day', (select * from {{a}})) - interval 7 days group by 1),
          s as (select coalesce(sum(case when day = to_date((select * from {{a}})) then c end), 0) today,
            avg(case when day < to_date((select * from {{a}})) then c end) mean_before from d)
        select cast(today as double) today_cost, cast(cast(mean_before as decimal(28, 6)) as double) mean_cost, coalesce(today > {factor} * mean_before, false) alert from s""",
        t=llm_usage, a=as_of,
    )


def failing_days_alert(fetch_run_source: DataFrame, days: int = 3) -> DataFrame:
    """Sources with ``days`` days or more on which every fetch failed."""
    return _sql(
        f"""select source_id, count(*) failing_days, max(day) last_day from (
            select source_id, to_date(created_at) day, count(*) n, count_if(status = 'failed') f from {{t}} group by 1, 2) where n = f
        group by source_id having count(*) >= {days}""",
        t=fetch_run_source,
    )


def low_success_alert(fetch_run: DataFrame, days: int = 3) -> DataFrame:
    """The lowest success rate of the last ``days`` days that had runs."""
    return _sql(
        f"""select cast(min(rate) as double) min_rate, count(*) days from (
            select to_date(finished_at) day, round(100.0 * count_if(lower(status) = 'succeeded') / count(*), 2) rate from {{t}}
            where finished_at is not null group by 1 order by 1 desc limit {days})""",
        t=fetch_run,
    )
