"""Registered queries (named by their operator ids) over the benchmark tables, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import score as S
from ..functions import text as X
from ..operators import digest, merging, recall, runs, scoring, state
from ..sources.config import Config
from . import bindings as B
from . import metrics as M

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
#: Trend windows and thresholds that suit the benchmark's month of events.
CFG = Config(trend_window_hours=24 * 40, history_hours=24 * 40, source_count=3, rank_threshold=0.45)
AS_OF = "2024-01-31 23:59:59"


def query(sql: str | None = None):
    def add(f):
        QUERIES["q_" + f.__name__] = f
        if sql:
            SQL["q_" + f.__name__] = sql
        return f

    return add


def _as_of(df: DataFrame, col: str) -> DataFrame:
    return df.agg(F.max(col))


def _at():
    return F.lit(AS_OF).cast("timestamp_ntz")


def _rate(n: str, m: str = "count(*)") -> str:
    """A percentage rounded half up to two places, in whole numbers."""
    return f"(((20000 * ({n}) + ({m})) // (2 * ({m}))) / 100.0)::double"


# Metrics views ------------------------------------------------------------------------------------------------------


@query(
    f"""select o_orderdate::date run_date, count(*) total_runs, count(*) filter (o_orderstatus = 'F') succeeded_runs, count(*) filter (o_orderstatus = 'O') partial_runs,
    count(*) filter (o_orderstatus = 'P') failed_runs, {_rate("count(*) filter (o_orderstatus in ('F', 'O'))")} success_rate_pct, sum(o_totalprice::decimal(18, 8))::double total_llm_cost
    from orders where o_orderdate >= (select max(o_orderdate) from orders) - interval 30 days group by 1"""
)
def m1_success_rate(spark, d):
    o = B.table(spark, d, "orders")
    return M.run_success_rate(B.fetch_runs(o), _as_of(o, "o_orderdate"))


@query(
    f"""select user_id::varchar source_id, coalesce(c_name, user_id::varchar) display_name, c_mktsegment provider, case when c_custkey is not null then 'ranked_news' end content_kind, ts::date fetch_date,
    count(*) total_fetches, count(*) filter (event_type <> 'error') succeeded_fetches, count(*) filter (event_type = 'error') failed_fetches, {_rate("count(*) filter (event_type = 'error')")} failure_rate_pct,
    string_agg(distinct props, '; ' order by props) filter (event_type = 'error') recent_errors
    from events left join customer on user_id = c_custkey where ts >= (select max(ts) from events) - interval 30 days group by 1, 2, 3, 4, 5"""
)
def m2_source_failure(spark, d):
    e = B.table(spark, d, "events")
    return M.run_source_failure_rate(B.run_sources(e), B.sources(B.table(spark, d, "customer")), _as_of(e, "ts"))


@query(
    """select event_type stage, ts::date run_date, count(*) stage_count, round(avg(value::decimal(18, 4)))::double avg_duration_ms, quantile_cont(value, 0.5) p50_duration_ms,
    quantile_cont(value, 0.95) p95_duration_ms, min(value) min_duration_ms, max(value) max_duration_ms
    from events where ts >= (select max(ts) from events) - interval 30 days and user_id % 10 <> 0 group by 1, 2"""
)
def m3_stage_duration(spark, d):
    e = B.table(spark, d, "events")
    return M.run_stage_duration(B.run_stages(e), _as_of(e, "ts"))


@query(
    """select l_returnflag stage, l_linestatus model, l_shipdate::date usage_date, count(*) call_count, sum(l_partkey)::bigint total_input_tokens, sum(l_suppkey)::bigint total_output_tokens,
    sum(l_linenumber)::bigint total_cache_read_tokens, sum(l_extendedprice::decimal(18, 8))::double total_estimated_cost, round(avg(l_quantity::int))::double avg_duration_ms, count(*) filter (l_linenumber >= 5) failed_calls
    from lineitem where l_shipdate >= (select max(l_shipdate) from lineitem) - interval 30 days group by 1, 2, 3"""
)
def m4_daily_cost(spark, d):
    t = B.table(spark, d, "lineitem")
    return M.llm_daily_cost(B.usage(t), _as_of(t, "l_shipdate"))


@query(
    """select l_shipdate::date usage_date, count(*) call_count, sum(l_extendedprice::decimal(18, 8))::double total_estimated_cost, sum(l_partkey)::bigint total_input_tokens, sum(l_suppkey)::bigint total_output_tokens
    from lineitem where l_shipdate >= (select max(l_shipdate) from lineitem) - interval 7 days group by 1"""
)
def m5_cost_trend_7d(spark, d):
    t = B.table(spark, d, "lineitem")
    return M.llm_cost_trend(B.usage(t), _as_of(t, "l_shipdate"))


@query(
    """with s as (select l_returnflag stage, sum(l_extendedprice::decimal(18, 2)) c, count(*) n from lineitem group by 1), t as (select sum(c) a from s)
    select stage, c::double total_cost, n call_count, (((20000 * (c * 100)::hugeint + (a * 100)::hugeint) // (2 * (a * 100)::hugeint)) / 100.0)::double cost_pct from s, t"""
)
def m6_cost_share(spark, d):
    return M.llm_stage_cost_share(B.usage(B.table(spark, d, "lineitem")))


@query(
    """with b as (select max(ts) - interval 30 days since from events),
    n as (select ts::date d, count(*) a, count(*) filter (user_id % 2 = 0) b, count(*) filter (user_id % 2 = 1) c from events, b where event_type = 'signup' and user_id % 13 <> 0 and ts >= since group by 1),
    p as (select ts::date d, count(*) a from events, b where event_type = 'purchase' and user_id % 13 <> 0 and ts >= since group by 1),
    l as (select ts::date d, count(*) filter (event_type = 'click') a, count(*) filter (event_type = 'view') b from events, b where event_type in ('click', 'view') and user_id % 4 <> 0 and ts >= since group by 1)
    select coalesce(n.d, p.d, l.d) event_date, coalesce(n.a, 0) new_events, coalesce(n.b, 0) news_events, coalesce(n.c, 0) topic_events, coalesce(p.a, 0) pushed_events, coalesce(l.a, 0) instant_pushes, coalesce(l.b, 0) digest_pushes
    from n full join p on n.d = p.d full join l on coalesce(n.d, p.d) = l.d"""
)
def m7_daily_counts(spark, d):
    e = B.table(spark, d, "events")
    return M.event_daily_counts(B.news_events(e), B.pushes(e), _as_of(e, "ts"))


@query(
    """with s as (select value::decimal(18, 6) v from events where ts::date = (select max(ts)::date from events) and user_id % 11 <> 0 and user_id % 13 <> 0)
    select case when v < 30 then '0-30' when v < 60 then '30-60' when v < 80 then '60-80' else '80-100' end score_bucket, count(*) event_count, round(sum(v)::decimal(38, 6) / count(*), 1)::double avg_total_score,
    round(avg(0.5), 2)::double avg_coverage, round(avg(0.25), 2)::double avg_rank, 0.0::double avg_trend, 1.0::double avg_persistence from s group by 1"""
)
def m8_score_distribution(spark, d):
    e = B.table(spark, d, "events")
    const = {"coverage_score": 0.5, "rank_score": 0.25, "trend_score": 0.0, "persistence_score": 1.0}
    score = e.select(F.col("user_id").alias("event_id"), F.to_date("ts").cast("string").alias("run_id"), F.col("value").alias("total_score"), *[F.lit(v).alias(k) for k, v in const.items()])
    users = e.select(F.col("user_id").alias("id"), (F.col("user_id") % 11 == 0).alias("is_blacklisted"), F.when(F.col("user_id") % 13 == 0, "Merged").otherwise("Active").alias("status")).distinct()
    return M.event_score_distribution(score, users, B.daily_runs(e))


@query(
    """select lang category, 'quality-' || quality tag_name, count(distinct doc_id) event_count, round(avg((case when toxic = 1 then 0.5 else 0.75 end)::decimal(18, 6))::decimal(20, 10), 2)::double avg_confidence
    from labels join documents using (doc_id) where doc_id % 13 <> 0 group by 1, 2"""
)
def m9_tag_distribution(spark, d):
    rows = B.table(spark, d, "labels").join(B.table(spark, d, "documents").select("doc_id", "lang"), "doc_id")
    key = F.concat_ws("-", "lang", F.col("quality").cast("string"))
    et = rows.select(F.col("doc_id").alias("event_id"), key.alias("tag_id"), F.when(F.col("toxic") == 1, 0.5).otherwise(0.75).alias("confidence"))
    tag = rows.select(key.alias("id"), F.col("lang").alias("category"), F.concat(F.lit("quality-"), F.col("quality").cast("string")).alias("display_name")).distinct()
    ev = rows.select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 13 == 0, "Merged").otherwise("Active").alias("status")).distinct()
    return M.event_tag_distribution(et, tag, ev)


STAGES = ["click", "error", "purchase", "signup", "view"]


@query(
    f"""with e as (select * from events where ts::date = (select max(ts)::date from events))
    select max(ts)::date::varchar run_id, 'Succeeded' status, count(distinct user_id) source_count, count(*) fetched_item_count, sum(value::decimal(18, 8))::double llm_cost,
    (((date_sub('second', min(ts), max(ts)) * 10 + 30) // 60) / 10.0)::double duration_minutes, {", ".join(f"count(*) filter (event_type = '{s}') {s}_ms" for s in STAGES)} from e"""
)
def m10_latest_pivot(spark, d):
    e = B.table(spark, d, "events")
    return M.latest_run_summary(B.daily_runs(e), B.stage_totals(e), STAGES)


@query(
    f"""with a as (select max(o_orderdate) - interval 7 days since from orders),
    r as (select count(*) total_runs, {_rate("count(*) filter (o_orderstatus in ('F', 'O'))")} success_rate_pct, coalesce(sum(o_totalprice::decimal(18, 8)), 0) cost, min(o_orderdate + interval (o_orderkey % 3000) second) window_start,
      max(o_orderdate + interval (o_orderkey % 3000) second) window_end, sum(o_orderkey % 3000) secs from orders, a where o_orderdate + interval (o_orderkey % 3000) second >= since),
    l as (select count(*) llm_calls, count(*) filter (l_linenumber >= 5) llm_failures from lineitem, a where l_shipdate >= since),
    e as (select count(*) filter (event_type = 'signup' and user_id % 13 <> 0 and ts >= since) new_events, count(*) filter (event_type in ('signup', 'purchase') and user_id % 13 <> 0) active_events,
      count(*) filter (event_type in ('click', 'view') and ts >= since) total_pushes, count(*) filter (event_type = 'click' and ts >= since) instant_pushes, count(*) filter (event_type = 'view' and ts >= since) digest_pushes from events, a)
    select total_runs, success_rate_pct, cost::double total_llm_cost, (floor(cost::double / total_runs * 1e6 + 0.5) / 1e6)::double avg_llm_cost_per_run, (floor(secs::double / total_runs / 60 * 10 + 0.5) / 10)::double avg_run_duration_minutes,
      new_events, active_events, ((20 * new_events + total_runs) // (2 * total_runs) / 10.0)::double avg_new_events_per_run, total_pushes, instant_pushes, digest_pushes, llm_calls, llm_failures, window_start, window_end from r, l, e"""
)
def m11_health(spark, d):
    e, o = B.table(spark, d, "events"), B.table(spark, d, "orders")
    run = B.fetch_runs(o).withColumn("finished_at", F.timestamp_add("SECOND", (F.col("id") % 3000).cast("int"), F.col("started_at")))
    return M.health_snapshot(run, B.usage(B.table(spark, d, "lineitem")), B.news_events(e), B.pushes(e), _as_of(o, "o_orderdate"))


@query(
    """with a as (select max(l_shipdate) m from lineitem), d as (select l_shipdate::date dd, sum(l_extendedprice::decimal(18, 8)) c from lineitem, a where l_shipdate >= date_trunc('day', m) - interval 7 days group by 1),
    s as (select coalesce(sum(c) filter (dd = m::date), 0) t, sum(c) filter (dd < m::date) b, count(*) filter (dd < m::date) n from d, a)
    select t::double today_cost, round(b / n, 6)::double mean_cost, coalesce(t * n > 2 * b, false) alert from s"""
)
def d24_alert(spark, d):
    t = B.table(spark, d, "lineitem")
    return M.cost_alert(B.usage(t), _as_of(t, "l_shipdate"))


@query(
    """select user_id::varchar source_id, count(*) failing_days, max(d) last_day from (select user_id, ts::date d, count(*) n, count(*) filter (event_type = 'error') f from events group by 1, 2) where n = f
    group by 1 having count(*) >= 3"""
)
def d25_having(spark, d):
    return M.failing_days_alert(B.run_sources(B.table(spark, d, "events")))


@query(
    f"""select min(r) min_rate, count(*) "days" from (select o_orderdate::date d, {_rate("count(*) filter (o_orderstatus = 'F')")} r from orders group by 1 order by 1 desc limit 3)"""
)
def d26_min_success(spark, d):
    return M.low_success_alert(B.fetch_runs(B.table(spark, d, "orders")))


@query("select props, count(*) n from events group by props having count(*) > 1")
def d16_duplicates(spark, d):
    return B.table(spark, d, "events").groupBy("props").agg(F.count("*").alias("n")).where("n > 1")


@query(
    """select d::date run_day, count(*) n_sources, count(*) filter (ok) n_ok, case when count(*) = count(*) filter (ok) then 'Succeeded' when count(*) filter (ok) > 0 then 'Partial' else 'Failed' end status
    from (select ts::date d, event_type, bool_and(user_id % 3 > 0 or value < 50) ok from events group by 1, 2) group by 1"""
)
def d22_run_status(spark, d):
    per = B.table(spark, d, "events").groupBy(F.to_date("ts").alias("run_day"), "event_type").agg(F.bool_and((F.col("user_id") % 3 > 0) | (F.col("value") < 50)).alias("ok"))
    out = per.groupBy("run_day").agg(F.count("*").alias("n_sources"), F.count_if("ok").alias("n_ok"))
    return out.withColumn("status", digest.run_status(F.col("n_ok"), F.col("n_sources")))


# Expressions --------------------------------------------------------------------------------------------------------


@query(
    """with x as (select event_id e, user_id u, event_id % 4 = 0 flash, json_extract_string(props, '$.k') k from events where event_id % 5 <> 4),
    i as (select *, unnest([1, 2, 3]) pos from x)
    select 's' || e source_id, case when flash then 'flash_feed' else 'ranked_news' end content_kind, case when pos = 1 then 'a' || e else sha256('x' || (u % 7) || '|' || case when pos = 2 then 'https://h.example/' || u else 'only ' || coalesce(k, '') end) end source_item_id,
      case pos when 1 then 'title ' || e when 2 then '' else 'only ' || coalesce(k, '') end title, case when pos = 2 then 'https://h.example/' || u end url, case when pos = 1 then 'hover ' || u end summary,
      case when not flash then case pos when 3 then 4 else pos end end::int "rank", case when not flash then 4 end::int source_list_size from i"""
)
def a1_json_parse(spark, d):
    """List bodies of four entries, of which one has neither title nor url; every fifth source has failed."""
    from ..sources.feeds import list_items

    e = B.table(spark, d, "events")
    s = lambda c: F.col(c).cast("string")
    k = F.coalesce(F.get_json_object("props", "$.k"), F.lit(""))
    entries = F.concat(
        F.lit('[{"id": "a'), s("event_id"), F.lit('", "title": " title '), s("event_id"), F.lit('", "extra": {"hover": "hover '), s("user_id"), F.lit('"}}, {"mobileUrl": "https://h.example/'), s("user_id"),
        F.lit('"}, {"id": "none"}, {"name": "only '), k, F.lit('"}]'),
    )
    body = F.concat(F.lit('{"status": "'), F.when(F.col("event_id") % 5 == 4, "error").otherwise("success"), F.lit('", "items": '), entries, F.lit("}"))
    kind = F.when(F.col("event_id") % 4 == 0, "flash_feed").otherwise("ranked_news")
    bodies = e.select(F.concat(F.lit("s"), s("event_id")).alias("source_id"), F.concat(F.lit("x"), (F.col("user_id") % 7).cast("string")).alias("external_id"), kind.alias("content_kind"), body.alias("body"))
    return list_items(bodies).select("source_id", "content_kind", "source_item_id", "title", "url", "summary", "rank", "source_list_size")


@query(
    """with r as (select user_id, event_id, row_number() over (partition by user_id, ts::date order by value desc, event_id) rk, count(*) over (partition by user_id, ts::date) n from events)
    select event_id, rk::int "rank", n source_list_size, case when n <= 1 then 1.0 else greatest(0.0, least(1.0, 1.0 - (rk - 1) / (n - 1)::double)) end::double normalized_rank from r"""
)
def b2_normalized_rank(spark, d):
    w = Window.partitionBy("user_id", F.to_date("ts"))
    e = B.table(spark, d, "events").select("event_id", F.row_number().over(w.orderBy(F.desc("value"), "event_id")).alias("rank"), F.count("*").over(w).alias("source_list_size"))
    return e.withColumn("normalized_rank", S.normalized_rank("rank", "source_list_size"))


@query(
    f"""select event_id, case when event_type in ('error', 'signup') then greatest(0.0, least(1.0, 1.0 / (1.0 + greatest(0.0, (epoch_us(timestamp '{AS_OF}') - epoch_us(ts)) / 3600000000.0::double) / 24.0::double))) else 0.0 end::double freshness from events"""
)
def b3_freshness(spark, d):
    kind = F.when(F.col("event_type").isin("error", "signup"), "flash_feed").otherwise("topic")
    return B.table(spark, d, "events").select("event_id", S.freshness(kind, "ts", _at()).alias("freshness"))


_TOKENS = "list_distinct(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{Nd}]+'), lambda x: length(x) >= 2 and not list_contains([" + ", ".join(f"'{w}'" for w in X.STOP_WORDS) + "], x)))"


@query(f"select doc_id, len({_TOKENS})::int n_tokens, array_to_string(list_sort({_TOKENS})[1:5], ' ') head from documents")
def i1_tokens(spark, d):
    # The tokens are named inside the expression, so that both outputs take them from one evaluation.
    both = F.get(F.transform(F.array(X.tokenize("text")), lambda t: F.struct(F.size(t).alias("n_tokens"), F.array_join(F.slice(F.array_sort(t), 1, 5), " ").alias("head"))), F.lit(0))
    return B.table(spark, d, "documents").select("doc_id", both.alias("x")).select("doc_id", "x.*")


_LETTERS = "regexp_replace(lower(title), '[^\\p{L}\\p{Nd}]', '', 'g')"
_GRAMS = "list_distinct(list_concat(list_transform(range(1, length(l)), lambda i: substring(l, i, 2)), list_transform(range(1, length(l) - 1), lambda i: substring(l, i, 3))))"


@query(f"with t as (select doc_id, coalesce(text, '') title from documents), l as (select doc_id, {_LETTERS} l from t) select doc_id, l normal, len({_GRAMS})::int n_grams from l")
def i3_ngrams(spark, d):
    t = B.table(spark, d, "documents")
    return X.with_ngram_count(t.select("doc_id", X.letters_and_digits("text").alias("normal")), "normal", "n_grams")


@query(
    f"""with t as (select doc_id, {_TOKENS} tok from documents) select doc_id, array_to_string(list_transform(list_sort(list_transform(tok, lambda x: {{'n': -length(x), 'w': x}})), lambda s: s.w)[1:12], ' ') key_terms from t"""
)
def i7_key_terms(spark, d):
    return B.table(spark, d, "documents").select("doc_id", F.array_join(X.key_terms("text"), " ").alias("key_terms"))


@query(
    """with t as (select conv_id, turn, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') ls from conversations)
    select conv_id, turn, regexp_replace(left(array_to_string(ls, chr(10)), 80), '\\s+$', '') head, sha256(regexp_replace(left(array_to_string(ls, chr(10)), 80), '\\s+$', '')) hash from t"""
)
def i19_embedding_text(spark, d):
    t = X.cap_text("text", limit=80)
    return B.table(spark, d, "conversations").select("conv_id", "turn", t.alias("head"), F.sha2(t, 256).alias("hash"))


@query(
    """with t as (select doc_id, string_split(lang || ' Tag-' || source || ',#' || lang || '. x', ' ') raw from documents), u as (select doc_id, unnest(range(len(raw))) i, unnest(raw) r from t),
    n as (select doc_id, i, trim(trim(r, '#＃，,。.：: ')) disp from u), m as (select doc_id, i, disp, trim(regexp_replace(regexp_replace(regexp_replace(lower(disp), '[\\s\\-_.]+', '-', 'g'), '[^\\p{L}\\p{Nd}-]', '', 'g'), '-+', '-', 'g'), '-') nm from n),
    k as (select *, row_number() over (partition by doc_id, nm order by i) c from m where length(nm) between 2 and 32 and nm not in ('http', 'https', 'www', 'com', 'news', 'the', 'and', 'with', 'from'))
    select doc_id, nm as name, disp display_name, 'topic' category, 0.9::double confidence, 'web_extract' source from k where c = 1 qualify row_number() over (partition by doc_id order by i) <= 6"""
)
def i15_tags(spark, d):
    raw = F.concat("lang", F.lit(" Tag-"), "source", F.lit(",#"), "lang", F.lit(". x"))
    return digest.assign_tags(B.table(spark, d, "documents").select("doc_id", F.split(raw, " ").alias("tags")), "doc_id", "tags", "web_extract")


@query(
    """select l_orderkey, l_linenumber, round(l_partkey::decimal(18, 0) * 3 / 1000000 + l_suppkey::decimal(18, 0) * 12 / 1000000 + l_linenumber::decimal(18, 0) * 0.3 / 1000000, 8)::decimal(18, 8)::double cost from lineitem"""
)
def i24_cost(spark, d):
    cost = S.estimated_cost("l_partkey", "l_suppkey", "l_linenumber", "3", "12", "0.3")
    return B.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", cost.cast("double").alias("cost"))


@query(
    """select c_custkey, 'evt:' || left(sha256(trim(c_name || '|' || c_mktsegment)), 20) event_id, md5(c_name) item_md5, coalesce(nullif(trim(regexp_replace(lower(trim(c_name)), '[^\\p{L}\\p{Nd}]', '-', 'g'), '-'), ''), 'unknown') safe_part,
    coalesce(nullif(trim(regexp_replace(lower(trim(c_name || ' -- ' || c_mktsegment)), '[^\\p{L}\\p{Nd}]', '-', 'g'), '-'), ''), 'unknown') safe_run, case when c_custkey % 2 = 0 then 'unknown' else 'n' || c_custkey end safe_blank,
    'ci:' || lower(c_mktsegment) || ':' || regexp_replace(lower(c_name), '[^\\p{L}\\p{Nd}]', '-', 'g') || ':' || left(sha256(c_custkey::varchar), 16) content_id,
    'run-1:snap:' || lpad(c_custkey::varchar, greatest(5, length(c_custkey::varchar))::int, '0') || ':' || lower(c_mktsegment) || ':unknown:r' || lpad((c_custkey % 7)::varchar, 4, '0') snapshot_id, coalesce(nullif(lower(trim(c_name)), ''), '') dedup_key from customer"""
)
def i11_ids(spark, d):
    return B.table(spark, d, "customer").select(
        "c_custkey", S.hex_id("evt", 20, "c_name", "c_mktsegment").alias("event_id"), F.md5(F.col("c_name").cast("binary")).alias("item_md5"), X.safe_id_part("c_name").alias("safe_part"),
        X.safe_id_part(F.concat("c_name", F.lit(" -- "), "c_mktsegment")).alias("safe_run"), X.safe_id_part(F.when(F.col("c_custkey") % 2 == 0, " #/ ").otherwise(F.concat(F.lit(" N"), F.col("c_custkey").cast("string")))).alias("safe_blank"),
        S.content_id("c_mktsegment", "c_name", F.col("c_custkey").cast("string")).alias("content_id"), S.snapshot_id(F.lit("run-1"), "c_custkey", "c_mktsegment", F.lit("--"), F.col("c_custkey") % 7).alias("snapshot_id"),
        state.dedup_key(F.col("c_name"), F.col("c_mktsegment"), F.col("c_name")).alias("dedup_key"),
    )


@query(
    """with t as (select doc_id, source, trim(regexp_replace(split_part(text, chr(10), 1), '\\s+', ' ', 'g')) t, trim(regexp_replace(text, '\\s+', ' ', 'g')) s from documents)
    select doc_id, case when source = 'src1' then false when source = 'src2' then true when length(s) >= 40 and regexp_matches(s, '[\\x{4E00}-\\x{9FFF}]{2,}|[A-Z][A-Za-z0-9_-]{2,}') then false when length(t) < 14 then true
    else not regexp_matches(t, '[\\x{4E00}-\\x{9FFF}]{2,}|[A-Z][A-Za-z0-9_-]{2,}') end need from t"""
)
def b7_need_enrichment(spark, d):
    t = B.table(spark, d, "documents")
    return t.select("doc_id", X.need_enrichment("source", F.split_part("text", F.lit("\n"), F.lit(1)), F.col("text"), ["src2"], ["src1"]).alias("need"))


@query(
    """with k as (select doc_id, case when contains(lower(text), 'gnu general') then 'GNU general' when contains(lower(text), 'apache') then 'Apache' when contains(lower(text), 'mit license') then 'mit LICENSE' end kw from documents)
    select doc_id, kw keyword, '匹配到黑名单关键词: ' || kw reason from k where kw is not null"""
)
def b8_blacklist(spark, d):
    kw = X.blacklist_keyword(F.lit(""), "text", ["GNU general", "Apache", "mit LICENSE"])
    return B.table(spark, d, "documents").select("doc_id", kw.alias("keyword")).where("keyword is not null").withColumn("reason", X.blacklist_reason("keyword"))


@query(
    """with o as (select c_custkey k, min(o_orderdate) f, max(o_orderdate) l, c_mktsegment seg, list_sort(list_distinct(list(o_orderpriority))) p from customer join orders on c_custkey = o_custkey group by 1, 4)
    select a.k a_id, b.k b_id, case when not list_has_any(a.p, b.p) then 'entities_disjoint' when not (a.f <= b.l and b.f <= a.l) and a.seg <> b.seg then 'time_and_type' when not list_has_any(a.p[1:1], b.p[1:1]) then 'places_disjoint' end reason
    from o a join o b on b.k = a.k + 1"""
)
def b13_hard_filters(spark, d):
    o = B.table(spark, d, "customer").join(B.table(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"))
    o = o.groupBy("c_custkey", "c_mktsegment").agg(F.min("o_orderdate").alias("f"), F.max("o_orderdate").alias("l"), F.array_sort(F.collect_set("o_orderpriority")).alias("p"))
    s = F.struct(F.col("f").alias("first_seen_at"), F.col("l").alias("last_seen_at"), F.col("c_mktsegment").alias("type"), F.col("p").alias("entities"), F.slice("p", 1, 1).alias("places"))
    a, b = o.select(F.col("c_custkey").alias("a_id"), s.alias("a")), o.select((F.col("c_custkey") - 1).alias("a_id"), F.col("c_custkey").alias("b_id"), s.alias("b"))
    return a.join(b, "a_id").select("a_id", "b_id", merging.hard_filter().alias("reason"))


# Joins and recall ---------------------------------------------------------------------------------------------------


@query(
    """with l as (select l_orderkey, l_linenumber, min(l_returnflag) l_returnflag, min(l_suppkey) l_suppkey, min(l_quantity) l_quantity from lineitem group by 1, 2),
    i as (select o_custkey event_id, l_orderkey * 10 + l_linenumber item, o_orderpriority source, case when l_returnflag = 'R' then l_suppkey end rk, l_quantity q from l join orders on l_orderkey = o_orderkey
      where o_orderstatus = 'F' and l_linenumber < 6 and o_custkey % 10 > 0)
    select event_id, count(*) n_evidence, count(distinct lower(source)) sources, count(rk) n_ranked, min(rk) best_rank, sum(q::decimal(18, 2))::double heat, arg_min('t-' || item, (coalesce(rk, 2147483647), item)) first_title from i group by 1"""
)
def c1_scoring_inputs(spark, d):
    """Line items as content, customers as events: items of open orders belong to other runs, sixth lines are inactive,
    every tenth event is merged away."""
    li, o, c = (B.table(spark, d, t) for t in ("lineitem", "orders", "customer"))
    li = li.groupBy("l_orderkey", "l_linenumber").agg(*[F.min(x).alias(x) for x in ("l_returnflag", "l_suppkey", "l_quantity", "l_shipdate")])
    item = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    rows = li.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    snap = rows.select(
        F.when(F.col("o_orderstatus") == "F", "r1").otherwise("r2").alias("run_id"), item.alias("content_item_id"), F.col("o_orderpriority").alias("source"), F.col("o_orderpriority").alias("source_id"),
        F.lit("ranked_news").alias("content_kind"), F.when(F.col("l_returnflag") == "R", F.col("l_suppkey").cast("int")).alias("rank"), F.col("l_quantity").cast("double").alias("normalized_rank_score"), F.lit(0.0).alias("freshness_score"),
    )
    event_item = rows.select(F.col("o_custkey").alias("event_id"), item.alias("content_item_id"), F.col("l_shipdate").alias("matched_at"), (F.col("l_linenumber") < 6).alias("is_active"))
    content = li.select(item.alias("id"), F.concat(F.lit("t-"), item.cast("string")).alias("title"), F.lit(None).cast("string").alias("url"))
    events = c.select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 10 == 0, "Merged").otherwise("Active").alias("status"))
    out = scoring.scoring_inputs(snap, event_item, events, content, "r1")
    heat = F.aggregate("evidence", F.lit(0).cast("decimal(28,2)"), lambda a, x: (a + x["normalized_rank_score"].cast("decimal(18,2)")).cast("decimal(28,2)"))
    ranked = F.filter("evidence", lambda x: x["rank"].isNotNull())
    return out.select(
        "event_id", F.size("evidence").cast("long").alias("n_evidence"), F.size(F.array_distinct(F.transform("evidence", lambda x: F.lower(x["source"])))).cast("long").alias("sources"), F.size(ranked).cast("long").alias("n_ranked"),
        F.get(ranked, F.lit(0))["rank"].cast("long").alias("best_rank"), heat.cast("double").alias("heat"), F.get("evidence", F.lit(0))["title"].alias("first_title"),
    )


@query("select 'documents' kind, doc_id id from documents where doc_id not in (select doc_id from labels) union all select 'customers', c_custkey from customer where c_custkey not in (select o_custkey from orders)")
def c2_unmapped(spark, d):
    docs = state.orphans(B.table(spark, d, "documents").select("doc_id"), B.table(spark, d, "labels"), "doc_id", "doc_id")
    cust = state.orphans(B.table(spark, d, "customer").select("c_custkey"), B.table(spark, d, "orders"), "c_custkey", "o_custkey")
    return docs.select(F.lit("documents").alias("kind"), F.col("doc_id").alias("id")).unionByName(cust.select(F.lit("customers").alias("kind"), F.col("c_custkey").alias("id")))


def _vectors(spark, d):
    e = B.table(spark, d, "embeddings")
    return e.select(F.col("vec_id").alias("event_id"), F.col("embedding").alias("v"), (F.col("vec_id") % 7).alias("last_seen_at"), "label")


_UNIT = "with n as (select vec_id, label, list_transform(embedding, lambda x: x::double) v from embeddings), u as (select vec_id, label, list_transform(v, lambda x: x / sqrt(list_reduce(list_transform(v, lambda y: y * y), lambda a, b: a + b))) v from n)"
_DOT = "list_reduce(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2]), lambda x, y: x + y)"


@query(
    _UNIT + f""", s as (select a.vec_id query_id, b.vec_id event_id, {_DOT} sim from u a, u b where a.vec_id % 20 = 0)
    select query_id, event_id, round(sim, 6) similarity from s where sim >= 0.1 qualify row_number() over (partition by query_id order by sim desc, event_id % 7 desc, event_id) <= 10"""
)
def c6_vector_topk(spark, d):
    v = _vectors(spark, d)
    out = recall.vector_topk(v.where("event_id % 20 = 0").select(F.col("event_id").alias("query_id"), "v"), v, 10, 0.1)
    return out.select("query_id", "event_id", F.round("similarity", 6).alias("similarity"))


@query(
    _UNIT + f""", s as (select a.vec_id q, b.vec_id e, {_DOT} sim from u a, u b), k as (select q, e, sim from s where sim >= 0.3 qualify row_number() over (partition by q order by sim desc, e % 7 desc, e) <= 16),
    p as (select least(q, e) lo, greatest(q, e) hi, max(sim) sim from k where q <> e group by 1, 2)
    select case when lo % 50 > hi % 50 then lo else hi end source_id, case when lo % 50 > hi % 50 then hi else lo end target_id, round(sim, 6) similarity from p"""
)
def c7_pairs(spark, d):
    v = _vectors(spark, d).withColumn("first_seen_at", F.col("event_id") % 50)
    return merging.similar_pairs(v, Config(merge_similarity=0.3)).select("source_id", "target_id", F.round("similarity", 6).alias("similarity"))


_C7 = _UNIT + f""", s as (select a.vec_id q, b.vec_id e, {_DOT} sim from u a, u b), k as (select q, e, sim from s where sim >= 0.3 qualify row_number() over (partition by q order by sim desc, e % 7 desc, e) <= 16),
    p as (select least(q, e) lo, greatest(q, e) hi, max(sim) sim from k where q <> e group by 1, 2)"""


@query(
    _C7 + """, d as (select vec_id a, vec_id + 1 + vec_id % 40 b from embeddings union all select vec_id + 1 + vec_id % 30, vec_id from embeddings where vec_id % 3 = 0)
    select case when lo % 50 > hi % 50 then lo else hi end source_id, case when lo % 50 > hi % 50 then hi else lo end target_id from p where not exists (select 1 from d where (a = lo and b = hi) or (a = hi and b = lo))"""
)
def c8_pair_exclusion(spark, d):
    v = _vectors(spark, d).withColumn("first_seen_at", F.col("event_id") % 50)
    e = F.col("event_id")
    done = v.select(e.alias("source_id"), (e + 1 + e % 40).alias("target_id")).unionByName(v.where("event_id % 3 = 0").select((e + 1 + e % 30).alias("source_id"), e.alias("target_id")))
    return merging.similar_pairs(v, Config(merge_similarity=0.3), done).select("source_id", "target_id")


@query(
    _C7 + """, r as (select case when lo % 50 > hi % 50 then lo else hi end s, case when lo % 50 > hi % 50 then hi else lo end t, sim from p), o as (select *, row_number() over (order by sim desc, t % 7 desc, s, t) i from r qualify i <= 15)
    select s source_id, t target_id, i::int place from o"""
)
def f5_pair_topk(spark, d):
    """The pairs that resolution looks at, in its order."""
    v = _vectors(spark, d).withColumn("first_seen_at", F.col("event_id") % 50)
    return merging.ordered_pairs(merging.similar_pairs(v, Config(merge_similarity=0.3)), Config().merge_candidate_limit).select("source_id", "target_id", "place")


_SQL_TOK = lambda c: "list_distinct(list_filter(regexp_split_to_array(lower(" + c + "), '[^\\p{L}\\p{Nd}]+'), lambda x: length(x) >= 2 and not list_contains([" + ", ".join(f"'{w}'" for w in X.STOP_WORDS) + "], x)))"
_SQL_NORM = lambda c: "regexp_replace(lower(" + c + "), '[^\\p{L}\\p{Nd}]', '', 'g')"
_SQL_GRAM = lambda l: f"list_distinct(list_concat(list_transform(range(1, length({l})), lambda i: substring({l}, i, 2)), list_transform(range(1, length({l}) - 1), lambda i: substring({l}, i, 3))))"


@query(
    f"""with i as (select item_id, {_SQL_TOK("text")} t, {_SQL_NORM("text")} l from benchmark), i2 as (select item_id, t, {_SQL_GRAM("l")} g from i),
    e as (select doc_id, {_SQL_TOK("text")} t, {_SQL_NORM("text")} l, doc_id % 2 = 0 act, (doc_id % 48)::double h from documents), e2 as (select doc_id, t, {_SQL_GRAM("l")} g, act, h from e),
    j as (select item_id, doc_id, len(list_intersect(i2.t, e2.t)) ti, len(i2.t) ta, len(e2.t) tb, len(list_intersect(i2.g, e2.g)) gi, len(i2.g) ga, len(e2.g) gb, case when act then greatest(0.0, least(1.0, 1.0 - h / 168.0)) else 0.8 * greatest(0.0, least(1.0, 1.0 - h / 720.0)) end rec from i2, e2),
    s as (select item_id, doc_id, case when ta = 0 or tb = 0 then 0.0 else ti / (ta + tb - ti)::double end tok, case when ga = 0 or gb = 0 then 0.0 else gi / (ga + gb - gi)::double end gram, rec from j),
    r as (select *, round_even(0.35::double * tok + 0.35::double * gram + 0.15::double * 0.0 + 0.10::double * 0.0 + 0.05::double * rec, 4) score from s)
    select item_id, doc_id event_id, score, array_to_string(list_filter([case when tok >= 0.12 then 'token_overlap' end, case when gram >= 0.18 then 'char_ngram_jaccard' end, case when rec >= 0.5 then 'recent_event' end], lambda x: x is not null), ',') features
    from r where score > 0.08 qualify row_number() over (partition by item_id order by score desc, doc_id % 48, doc_id) <= 20"""
)
def c9_rule_recall(spark, d):
    items = B.table(spark, d, "benchmark").select("item_id", F.lit("").alias("title"), F.col("text").alias("summary"))
    none = F.array().cast("array<string>")
    ev = B.table(spark, d, "documents").select(
        F.col("doc_id").alias("event_id"), F.lit("").alias("canonical_title"), F.col("text").alias("summary"), *[none.alias(c) for c in ("entities", "representative_titles", "key_terms", "aliases")],
        F.when(F.col("doc_id") % 2 == 0, "Active").otherwise("Stale").alias("status"), F.timestamp_add("HOUR", -(F.col("doc_id") % 48).cast("int"), _at()).alias("last_seen_at"),
    )
    out = recall.rule_recall(items, ev, _at(), Config())
    return out.select("item_id", "event_id", "score", F.array_join("features", ",").alias("features"))


# Scoring ------------------------------------------------------------------------------------------------------------


@query("select user_id, event_id, ts, value from events qualify row_number() over (partition by user_id order by ts desc, value desc, event_id) = 1")
def e1_latest_score(spark, d):
    return state.latest(B.table(spark, d, "events").select("user_id", "event_id", "ts", "value"), ["user_id"], F.desc("ts"), F.desc("value"), F.asc("event_id"))


@query(
    """with l as (select user_id, event_id, ts, value from events where user_id % 11 <> 0 qualify row_number() over (partition by user_id order by ts desc, value desc, event_id) = 1) select user_id event_id, value total_score, ts calculated_at from l order by value desc, ts desc, user_id limit 5"""
)
def f1_digest_topk(spark, d):
    e = B.table(spark, d, "events")
    score = e.select(F.col("user_id").alias("event_id"), F.col("event_id").alias("score_id"), F.col("value").alias("total_score"), F.col("ts").alias("calculated_at"))
    ev = e.groupBy(F.col("user_id").alias("event_id")).agg(F.max("ts").alias("last_seen_at")).withColumn("status", F.lit("Active")).withColumn("is_blacklisted", F.col("event_id") % 11 == 0)
    return digest.digest_candidates(score, ev, F.lit("2000-01-01").cast("timestamp_ntz"), 5).select("event_id", "total_score", "calculated_at")


_SERIES = "with h as (select user_id, ts::date dd, sum(value::decimal(18, 4))::double heat from events group by 1, 2), s as (select user_id, list(heat order by dd) x from h group by 1)"
_SMOOTH = "list_transform(range(1, len(x) + 1), lambda i: list_reduce(x[1:i], lambda a, b: 0.5::double * b + 0.5::double * a))"


def _daily_series(spark, d):
    h = B.table(spark, d, "events").groupBy("user_id", F.to_date("ts").alias("dd")).agg(F.sum(F.col("value").cast("decimal(18,4)")).cast("double").alias("heat"))
    return h.groupBy("user_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("dd", "heat"))), lambda x: x["heat"]).alias("x"))


@query(_SERIES + f" select user_id, len(x)::int samples, ({_SMOOTH})[-1] smoothed_heat from s")
def e4_ewma(spark, d):
    return _daily_series(spark, d).select("user_id", F.size("x").alias("samples"), F.element_at(S.ewma("x"), -1).alias("smoothed_heat"))


@query(
    _SERIES + f""", w as (select user_id, {_SMOOTH} w from s), m as (select user_id, w, len(w) // 2 m from w)
    select user_id, case when len(w) < 3 then 0.0 else greatest(0.0, least(1.0, (list_avg(w[m + 1:]) - list_avg(w[1:m])) / greatest(list_avg(w[1:m]), 0.2))) end::double trend from m"""
)
def e5_trend(spark, d):
    return _daily_series(spark, d).select("user_id", S.ewma("x").alias("w")).select("user_id", S.trend("w").alias("trend"))


def scored(spark, d):
    e = B.table(spark, d, "events")
    snap = B.snapshots(e)
    last = e.agg(F.max(F.to_date("ts")).alias("last_day"))
    marked = snap.join(F.broadcast(last), F.lit(True))
    now, before = marked.where("day = last_day").drop("last_day"), marked.where("day < last_day").drop("last_day")
    prior = before.groupBy("event_id", "day").agg(F.coalesce(F.sum(F.col("normalized_rank_score").cast("decimal(20,10)")), F.lit(0)).cast("double").alias("heat_value")).withColumn("calculated_at", F.col("day").cast("timestamp_ntz"))
    weights = spark.createDataFrame([("error-1", 1.5), ("signup-2", 1.2), ("view-3", 0.5)], "source string, weight double")
    return scoring.score_run(now, B.event_state(e), prior, _at(), CFG, weights)


_SCORED = f"""
with s as (select user_id, event_id, ts, ts::date dd, event_type || '-' || (event_id % 5)::varchar src, event_type in ('view', 'click') ranked, event_type in ('error', 'signup') flash,
    case when event_type in ('view', 'click') then (event_id % 21 + 1) end rk, case when event_type in ('view', 'click') then 1.0::double - (event_id % 21) / 20.0::double end nrs,
    case when event_type in ('error', 'signup') then 1.0::double / (1.0::double + abs(datediff('day', ts::date, date '2024-01-31'))::double) else 0.0::double end fr from events),
b as (select max(dd) ld from s),
t as (select user_id, coalesce(max(case src when 'error-1' then 1.5 when 'signup-2' then 1.2 when 'view-3' then 0.5 end), 1.0) mw, count(distinct case when ranked or flash then src end) sources, count(distinct case when ranked then src end) rsrc, count(distinct case when flash then src end) fsrc, count(*) filter (flash) nf,
    coalesce((sum(case when ranked then nrs::decimal(20, 10) end)::double / greatest(count(*) filter (ranked), 1)), 0.0) avgn, coalesce((sum(case when flash then fr::decimal(20, 10) end)::double / greatest(count(*) filter (flash), 1)), 0.0) fresh,
    (coalesce(sum(case when ranked then nrs::decimal(20, 10) end), 0) + coalesce(sum(case when flash then fr::decimal(20, 10) end), 0))::double heat from s, b where dd = ld group by 1),
p as (select user_id, list(h order by dd) past from (select user_id, dd, coalesce(sum(nrs::decimal(20, 10)), 0)::double h from s, b where dd < ld and dd >= timestamp '{AS_OF}' - interval 960 hours group by 1, 2) group by 1),
f as (select user_id, min(ts) first_seen from s group by 1),
q as (select t.*, coalesce(past, []::double[]) past, list_append(coalesce(past, []::double[]), heat) x, first_seen, user_id % 7 = 0 react, user_id % 11 = 0 black, user_id % 3 pc, user_id % 9 = 0 never, case when user_id % 5 > 0 then user_id % 4 end lsc,
    case when user_id % 2 = 0 then 0.5::double end lrs, case when user_id % 3 > 0 then 60.0::double end lps from t left join p using (user_id) join f using (user_id)),
w as (select *, {_SMOOTH} w from q), m as (select *, len(w) // 2 m from w),
c as (select *, greatest(0.0, least(1.0, sources / 3.0::double)) cov, greatest(0.0, least(1.0, avgn)) rank_score, case when len(w) < 3 then 0.0 else greatest(0.0, least(1.0, (list_avg(w[m + 1:]) - list_avg(w[1:m])) / greatest(list_avg(w[1:m]), 0.2))) end::double trend,
    greatest(0.0, least(1.0, ((epoch_us(timestamp '{AS_OF}') - epoch_us(first_seen)) / 3600000000.0::double) / 960.0::double)) pers,
    case when nf = 0 then 0.0 else greatest(0.0, least(1.0, 0.55::double * fresh + 0.30::double * greatest(0.0, least(1.0, fsrc / 3.0::double)) + 0.15::double * case when nf <= 1 then 0.0 else greatest(0.0, least(1.0, (nf - 1) / 2.0::double)) end)) end::double flash,
    case when react then 10.0 else 0.0 end bonus, list_reduce(x, lambda a, b: a + b) xs from m),
d as (select *, 100.0::double * (0.35::double * cov + 0.25::double * rank_score + 0.20::double * trend + 0.10::double * pers + 0.10::double * 0.0) + 15.0::double * flash + bonus total from c),
r as (select *, list_filter([case when rsrc >= 3 and rank_score >= 0.45 then 'coverage_rank' end, case when flash >= 0.45 and fsrc >= 3 then 'flash_multi_source' end, case when flash >= 0.45 and nf >= 3 then 'flash_repeated' end,
    case when flash >= 0.45 and react and fsrc > 0 then 'flash_follow_up' end, case when flash >= 0.45 and mw > 1 then 'flash_trusted_source' end, case when len(w) >= 3 and xs >= 1.5 and trend > 0 then 'rising_trend' end, case when react then 'reactivation' end], lambda z: z is not null) reasons from d),
g as (select *, not black and len(reasons) > 0 elig from r),
k as (select *, case when not elig then null when (pc = 0 or never) and (sources >= 3 or list_has_any(reasons, ['flash_multi_source', 'flash_repeated', 'flash_follow_up', 'flash_trusted_source'])) then 'first_push' when pc = 0 or never then null
    when lsc is null or sources - lsc >= 2 then 'source_increase' when rsrc > 0 and (lrs is null or rank_score - lrs >= 0.15) then 'rank_improvement' when lps is null or total - lps >= 12.0 then 'score_improvement' end push_reason,
    case when react then 'FollowUp' when trend >= 0.35 and rank_score >= 0.45 then 'Escalating' when sources >= 3 or trend > 0 then 'Expanding' when coalesce(past[-1], 0.0) > heat and len(w) >= 3 then 'Cooling' else 'Initial' end stage from g)
"""


@query(_SCORED + "select user_id event_id, sources, rsrc ranked_sources, fsrc flash_sources, nf n_flash, heat, cov coverage, rank_score, trend, pers persistence, flash, total from k")
def l4_score_run(spark, d):
    return scored(spark, d).select("event_id", "sources", "ranked_sources", "flash_sources", "n_flash", "heat", "coverage", "rank_score", "trend", "persistence", "flash", "total")


@query(_SCORED + "select user_id event_id, array_to_string(reasons, ',') reasons, elig eligible, (sources >= 2 or heat >= 1.5 or flash >= 0.45) near_eligible from k")
def l5_triggers(spark, d):
    return scored(spark, d).select("event_id", F.array_join("reasons", ",").alias("reasons"), "eligible", "near_eligible")


@query(_SCORED + "select user_id event_id, push_reason, pc push_count from k where push_reason is not null")
def l6_should_push(spark, d):
    return scored(spark, d).where("push_reason is not null").select("event_id", "push_reason", "push_count")


@query(_SCORED + "select user_id event_id, stage, array_to_string(list_filter(['first_seen', case when sources > 1 then 'source_expansion' end, case when react then 'reactivation' end, case when trend > 0 and not (sources > 1 and react) then 'heat_rising' end], lambda z: z is not null), ',') milestones from k")
def l7_stage(spark, d):
    return scored(spark, d).select("event_id", "stage", F.array_join("milestones", ",").alias("milestones"))


@query(
    _SCORED + """select user_id event_id, case when react then 'reactivated' when sources < 3 then 'source_count_below_threshold' when elig then 'eligible_before_judge'
    when sources >= 2 or heat >= 1.5 or flash >= 0.45 then 'near_eligibility' else 'not_near_eligibility' end gate from k"""
)
def b20_judge_gate(spark, d):
    return scored(spark, d).select("event_id", F.col("judge_gate").alias("gate"))


# State --------------------------------------------------------------------------------------------------------------


@query(
    """select coalesce(n.o_orderkey, o.o_orderkey) o_orderkey, coalesce(n.o_totalprice, o.o_totalprice) o_totalprice, case when o.o_orderkey is not null then o.o_orderstatus else n.o_orderstatus end o_orderstatus,
    greatest(coalesce(o.o_orderdate, n.o_orderdate), coalesce(n.o_orderdate, o.o_orderdate)) o_orderdate
    from (select * from orders where o_orderkey % 3 < 2) o full join (select o_orderkey, o_totalprice * 2 o_totalprice, 'N' o_orderstatus, o_orderdate + interval 1 day o_orderdate from orders where o_orderkey % 3 > 0) n on o.o_orderkey = n.o_orderkey"""
)
def h3_upsert(spark, d):
    o = B.table(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus", "o_orderdate")
    new = o.where("o_orderkey % 3 > 0").select("o_orderkey", (F.col("o_totalprice") * 2).alias("o_totalprice"), F.lit("N").alias("o_orderstatus"), F.timestamp_add("DAY", F.lit(1), F.col("o_orderdate")).alias("o_orderdate"))
    return state.merge_frames(o.where("o_orderkey % 3 < 2"), new, ["o_orderkey"], {"o_orderdate": lambda a, b: F.greatest(a, b)}, keep=("o_orderstatus",))


@query(
    """with n as (select user_id k, event_id, event_type from events qualify row_number() over (partition by user_id order by ts, event_id) = 1)
    select user_id k, min(event_id) event_id, 'old' event_type from events where user_id % 2 = 0 group by 1 union all select k, event_id, event_type from n where k % 2 = 1"""
)
def h2_insert_ignore(spark, d):
    e = B.table(spark, d, "events")
    old = e.where("user_id % 2 = 0").groupBy(F.col("user_id").alias("k")).agg(F.min("event_id").alias("event_id")).withColumn("event_type", F.lit("old"))
    new = state.insert_ignore(old.withColumn("ts", F.lit(None).cast("timestamp_ntz")), e.select(F.col("user_id").alias("k"), "event_id", "event_type", F.col("ts").cast("timestamp_ntz").alias("ts")), ["k"], F.asc("ts"), F.asc("event_id"))
    return new.drop("ts")


@query(
    """select event_id::varchar dedup_key, 'ci:unknown:' || lower(event_type) || ':' || left(sha256(event_id::varchar), 16) id, case when event_id % 3 = 0 then 'new ' else 'old ' end || coalesce(props, '') title,
    case when event_id % 2 = 0 and event_id % 7 = 0 then 'enriched' when event_id % 3 = 0 then 's-' || user_id else 'before' end summary,
    case when event_id % 2 = 0 and event_id % 7 = 0 then 'Succeeded' when event_id % 2 = 0 and event_id % 3 > 0 then 'Pending' when user_id % 2 = 0 then 'Pending' else 'Skipped' end enrichment_status,
    case when event_id % 2 = 0 then 'r1' else 'r2' end created_in, case when event_id % 3 = 0 then 'r2' else 'r1' end last_seen_run_id, case when event_id % 3 = 0 then user_id else 0 end last_seen_rank,
    case when event_id % 2 = 1 then 'inserted' when event_id % 3 = 0 then 'updated' else 'kept' end action from events where event_id % 2 = 0 or event_id % 3 = 0"""
)
def h1_content_upsert(spark, d):
    """Two runs; of the first one's items, some have been enriched in between."""
    e = B.table(spark, d, "events")
    key = F.col("event_id").cast("string")
    t0 = F.lit("2024-01-01").cast("timestamp_ntz")
    empty = spark.createDataFrame([], "dedup_key string, id string, title string, url string, summary string, enrichment_status string, created_at timestamp_ntz, last_seen_at timestamp_ntz, last_seen_run_id string, last_seen_rank bigint")

    def batch(rows, title, summary, rank, need):
        return rows.select(
            F.col("event_id").alias("order"), key.alias("dedup_key"), F.col("event_type").alias("source"), key.alias("source_item_id"), F.concat(F.lit(title), F.coalesce("props", F.lit(""))).alias("title"),
            F.lit(None).cast("string").alias("url"), summary.alias("summary"), rank.alias("rank"), need.alias("need_enrichment"),
        )

    old = state.ingest(empty, batch(e.where("event_id % 2 = 0"), "old ", F.lit("before"), F.lit(None).cast("bigint"), F.lit(True)), "r1", t0).drop("action")
    done = F.col("dedup_key").cast("bigint") % 7 == 0
    old = old.withColumn("summary", F.when(done, "enriched").otherwise(F.col("summary"))).withColumn("enrichment_status", F.when(done, "Succeeded").otherwise(F.col("enrichment_status")))
    new = batch(e.where("event_id % 3 = 0"), "new ", F.concat(F.lit("s-"), F.col("user_id").cast("string")), F.col("user_id"), F.col("user_id") % 2 == 0)
    out = state.ingest(old, new, "r2", _at())
    return out.select("dedup_key", "id", "title", "summary", "enrichment_status", F.when(F.col("created_at") == t0, "r1").otherwise("r2").alias("created_in"), "last_seen_run_id", F.col("last_seen_rank").cast("bigint").alias("last_seen_rank"), "action")


@query(
    """with e as (select *, 'T ' || event_id t0, 'U ' || event_id t1, case when event_id % 5 = 0 then null when event_id % 5 = 1 then ' ' else 's0' end s0, case when user_id % 3 = 0 then null else ' s1 ' end s1 from events),
    f as (select *, event_id % 2 = 0 had, event_id % 3 > 0 came, event_id % 2 = 0 and event_id % 11 = 0 rich from e where event_id % 2 = 0 or event_id % 3 > 0)
    select event_id::varchar dedup_key, case when not came then case when rich then 'from the page' else coalesce(nullif(trim(s0), ''), t0) end when rich then 'from the page' else coalesce(nullif(trim(s1), ''), t1) end summary,
    case when rich then 'Enrichment' when not came then case when trim(coalesce(s0, '')) = '' then 'TitleOnly' else 'SummaryText' end when s1 is null then 'TitleOnly' else 'SummaryText' end summary_source,
    case when rich then 'Succeeded' when came then 'Skipped' else 'Pending' end enrichment_status, case when not had then 'inserted' when came then 'updated' else 'kept' end action from f"""
)
def h1_summary_source(spark, d):
    """Blank summaries give way to titles, summaries of the feed are refreshed, those of an enrichment stay."""
    e = B.table(spark, d, "events")
    key, n = F.col("event_id").cast("string"), F.col("event_id")
    empty = spark.createDataFrame([], "dedup_key string, id string, title string, url string, summary string, summary_source string, enrichment_status string, created_at timestamp_ntz, last_seen_at timestamp_ntz, last_seen_run_id string, last_seen_rank bigint")

    def batch(rows, title, summary, need):
        return rows.select(
            n.alias("order"), key.alias("dedup_key"), F.col("event_type").alias("source"), key.alias("source_item_id"), F.concat(F.lit(title), key).alias("title"), F.lit(None).cast("string").alias("url"),
            summary.alias("summary"), F.lit(1).alias("rank"), F.lit(need).alias("need_enrichment"),
        )

    old = state.ingest(empty, batch(e.where(n % 2 == 0), "T ", F.when(n % 5 == 0, None).when(n % 5 == 1, " ").otherwise("s0"), True), "r1", _at()).drop("action")
    rich = F.col("dedup_key").cast("bigint") % 11 == 0
    old = old.withColumns({c: F.when(rich, v).otherwise(F.col(c)) for c, v in (("summary", "from the page"), ("summary_source", "Enrichment"), ("enrichment_status", "Succeeded"))})
    out = state.ingest(old, batch(e.where(n % 3 > 0), "U ", F.when(F.col("user_id") % 3 == 0, None).otherwise(" s1 "), False), "r2", _at())
    return out.select("dedup_key", "summary", "summary_source", "enrichment_status", "action")


@query(
    """with o as (select doc_id, max(quality) q, case when max(toxic) = 1 then 'web_extract' else 'llm' end s from labels where doc_id % 2 = 0 group by 1), n as (select doc_id, 0.5::double c from labels where doc_id % 3 = 0 group by 1)
    select coalesce(o.doc_id, n.doc_id) doc_id, greatest(coalesce(q::double, c), coalesce(c, q::double)) confidence, case when o.doc_id is null then 'rule' when n.doc_id is null then s when s = 'web_extract' then s else 'rule' end source from o full join n on o.doc_id = n.doc_id"""
)
def h7_tag_merge(spark, d):
    lb = B.table(spark, d, "labels")
    old = lb.where("doc_id % 2 = 0").groupBy("doc_id").agg(F.max("quality").cast("double").alias("confidence"), F.when(F.max("toxic") == 1, "web_extract").otherwise("llm").alias("source"))
    new = lb.where("doc_id % 3 = 0").select("doc_id", F.lit(0.5).alias("confidence"), F.lit("rule").alias("source")).distinct()
    return state.merge_frames(old, new, ["doc_id"], state.TAG_RULES)


@query(
    """with f as (select user_id event_id, event_type tag_id, max(value) confidence, case when bool_or(event_id % 10 = 0) then 'web_extract' when bool_or(event_id % 4 = 0) then 'llm' else 'rule' end source from events group by 1, 2),
    o as (select distinct user_id event_id, 'click' tag_id, 50.0::double confidence, case user_id % 3 when 0 then 'manual' when 1 then 'llm' else 'rule' end source from events)
    select event_id, tag_id, greatest(coalesce(f.confidence, o.confidence), coalesce(o.confidence, f.confidence)) confidence,
    case when o.source is null then f.source when f.source is null then o.source when o.source = 'manual' then 'manual' when o.source = 'llm' and f.source = 'rule' then 'llm' else f.source end source
    from f full join o using (event_id, tag_id)"""
)
def h8_tag_precedence(spark, d):
    e = B.table(spark, d, "events")
    items = e.select(F.col("user_id").alias("event_id"), F.col("event_id").alias("content_item_id"), F.lit(True).alias("is_active"))
    tags = e.select(F.col("event_id").alias("content_item_id"), F.col("event_type").alias("tag_id"), F.col("value").alias("confidence"), F.when(F.col("event_id") % 10 == 0, "web_extract").when(F.col("event_id") % 4 == 0, "llm").otherwise("rule").alias("source"))
    u = F.col("user_id") % 3
    old = e.select(F.col("user_id").alias("event_id"), F.lit("click").alias("tag_id"), F.lit(50.0).alias("confidence"), F.when(u == 0, "manual").when(u == 1, "llm").otherwise("rule").alias("source")).distinct()
    return state.refresh_event_tags(items, tags, old)


@query(
    """with s as (select o_custkey, max(o_orderdate) l from orders group by 1), b as (select max(o_orderdate) - interval 720 hours t from orders)
    select o_custkey event_id, case when l < t then 'Stale' else 'Active' end status from s, b"""
)
def j3_lifecycle(spark, d):
    o = B.table(spark, d, "orders")
    ev = o.groupBy(F.col("o_custkey").alias("event_id")).agg(F.max("o_orderdate").alias("last_seen_at")).withColumn("status", F.lit("Active"))
    now = o.agg(F.max("o_orderdate").alias("now"))
    return state.mark_stale(ev.join(F.broadcast(now), F.lit(True)), F.col("now"), 720).select("event_id", "status")


@query(
    """with c as (select c_custkey, c_name, c_mktsegment from customer order by c_acctbal desc, c_custkey limit 20),
    o as (select o_custkey, o_orderkey, o_orderstatus, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey, o_orderpriority) i from orders)
    select c_custkey event_id, c_name title, c_mktsegment tag, i::int i, 'order-' || o_orderkey content_title, o_orderstatus source from c join o on c_custkey = o_custkey where i <= 8"""
)
def l10_report(spark, d):
    """Flattened, for comparison; the operator's frame is nested."""
    c = B.table(spark, d, "customer").orderBy(F.desc("c_acctbal"), "c_custkey").limit(20).select(F.col("c_custkey").alias("event_id"), F.col("c_name").alias("title"), "c_mktsegment")
    tags = c.select("event_id", F.col("c_mktsegment").alias("name"), F.lit(1.0).alias("confidence"))
    o = B.table(spark, d, "orders").join(c.select(F.col("event_id").alias("o_custkey")), "o_custkey", "left_semi")
    items = o.select(F.col("o_custkey").alias("event_id"), F.col("o_orderdate").cast("timestamp").alias("last_seen_at"), F.col("o_orderkey").cast("int").alias("rank"), F.concat(F.lit("order-"), F.col("o_orderkey").cast("string")).alias("title"), F.lit(None).cast("string").alias("url"), F.col("o_orderstatus").alias("source"))
    out = digest.report(c.drop("c_mktsegment"), tags, items)
    return out.select("event_id", "title", F.get("tags", F.lit(0)).alias("tag"), F.posexplode("content_items").alias("i", "x")).select("event_id", "title", "tag", (F.col("i") + 1).alias("i"), F.col("x.title").alias("content_title"), F.col("x.source").alias("source"))


_SQL_CJK = r"[\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{3040}-\x{30FF}\x{AC00}-\x{D7AF}]"
_SQL_STABLE = f"""(length(w) >= 2 and lower(w) not in ({", ".join(f"'{w}'" for w in X.ANCHOR_STOP_WORDS)}) and case when regexp_matches(w, '{_SQL_CJK}') then len(regexp_extract_all(w, '{_SQL_CJK}')) >= 2
    or (length(w) <= 4 and regexp_matches(w, '[0-9A-Za-z]')) else regexp_matches(w, '\\p{{Nd}}') or len(regexp_extract_all(w, '\\p{{Lu}}')) >= 2 or (regexp_matches(w, '\\p{{Lu}}') and regexp_matches(w, '\\p{{Ll}}')) end)"""
_SQL_ADD = lambda x: f"(case when list_contains(list_transform(a.anchors, lambda y: lower(y)), lower({x})) then a.anchors else list_concat([{x}], a.anchors)[1:8] end)"


@query(
    f"""with t as (select doc_id, list_append(list_transform(regexp_extract_all(coalesce(text, ''), '[\\p{{L}}\\p{{N}}](?:[\\p{{L}}\\p{{N}}''&.-]*[\\p{{L}}\\p{{N}}])?'), lambda w: {{'w': w, 'ok': {_SQL_STABLE}}}), {{'w': '', 'ok': false}}) ws from documents),
    r as (select doc_id, list_reduce(list_transform(ws, lambda x: {{'run': [x.w], 'anchors': [x.w], 'ok': x.ok}}), lambda a, x: case when x.ok then {{'run': list_concat(a.run, x.run), 'anchors': {_SQL_ADD("x.run[1]")}, 'ok': true}}
      else {{'run': []::varchar[], 'anchors': case when len(a.run) >= 2 then {_SQL_ADD("array_to_string(a.run, ' ')")} else a.anchors end, 'ok': false}} end, {{'run': []::varchar[], 'anchors': []::varchar[], 'ok': false}}) z from t)
    select doc_id, array_to_string(z.anchors, '|') anchors from r"""
)
def i8_anchors(spark, d):
    return B.table(spark, d, "documents").select("doc_id", F.array_join(X.anchors("text"), "|").alias("anchors"))


@query(
    """with r as (select doc_id item_id, doc_id // 10 event_id, (doc_id % 90) / 100.0::double score from documents), v as (select doc_id item_id, doc_id // 20 event_id, (doc_id % 70) / 100.0::double score from documents where doc_id % 2 = 0)
    select item_id, event_id, max(score) score, count(*) n_lists from (select * from r union all select item_id, event_id, round_even(score, 4) from v) group by 1, 2"""
)
def c23_composite(spark, d):
    t = B.table(spark, d, "documents").select(F.col("doc_id").alias("item_id"))
    r = t.select("item_id", F.floor(F.col("item_id") / 10).alias("event_id"), ((F.col("item_id") % 90) / F.lit(100.0)).alias("score"), F.array(F.lit("token_overlap")).alias("features"))
    v = t.where("item_id % 2 = 0").select("item_id", F.floor(F.col("item_id") / 20).alias("event_id"), ((F.col("item_id") % 70) / F.lit(100.0)).alias("similarity"))
    out = recall.composite(r, v)
    return out.select("item_id", "event_id", "score", (F.when(F.array_contains("features", "token_overlap"), 1).otherwise(0) + F.when(F.array_contains("features", "vector_cosine_similarity"), 1).otherwise(0)).cast("long").alias("n_lists"))


@query(
    """with r as (select doc_id item_id, doc_id // 10 event_id, (doc_id % 90) / 100.0::double score, doc_id % 3 > 0 strong from documents)
    select item_id, case when score >= 0.55 and strong then event_id when item_id % 2 = 0 and 0.9 >= 0.82 then event_id end event_id, case when score >= 0.55 and strong then score when item_id % 2 = 0 then 0.9 else 1.0 end::double confidence,
    case when (score >= 0.55 and strong) or item_id % 2 = 0 then 'same_event' else 'create_new' end decision, case when score >= 0.55 and strong then 'rule' when item_id % 2 = 0 then 'model' else 'none' end "by" from r"""
)
def l1_decide(spark, d):
    t = B.table(spark, d, "documents").select(F.col("doc_id").alias("item_id"))
    ev = F.floor(F.col("item_id") / 10)
    feats = F.when(F.col("item_id") % 3 > 0, F.array(F.lit("token_overlap"), F.lit("char_ngram_jaccard"))).otherwise(F.array(F.lit("token_overlap")))
    cand = t.select("item_id", ev.alias("event_id"), ((F.col("item_id") % 90) / F.lit(100.0)).alias("score"), feats.alias("features"))
    replies = t.where("item_id % 2 = 0").select("item_id", F.lit("same_event").alias("decision"), ev.alias("event_id"), F.lit(0.9).alias("confidence"))
    return recall.decide(t, cand, Config(), replies)


@query(
    """select user_id source_item, case when value > 50 then value else null end v, case when coalesce(nullif(trim(event_type), ''), 'x') = 'click' then 'c' else event_type end t, strftime(ts + interval 8 hours, '%H:%M') slot from events"""
)
def i28_slots(spark, d):
    e = B.table(spark, d, "events")
    return e.select(F.col("user_id").alias("source_item"), F.when(F.col("value") > 50, F.col("value")).alias("v"), F.when(X.first_text("event_type") == "click", "c").otherwise(F.col("event_type")).alias("t"), digest.local_slot(F.col("ts").cast("timestamp"), "Asia/Shanghai").alias("slot"))


# Runs ---------------------------------------------------------------------------------------------------------------


@query(
    """select ts::date::varchar run_id, event_id content_item_id, row_number() over (partition by ts::date order by upper(event_type), upper(props), coalesce(case when event_id % 3 > 0 then user_id end, 2147483647), event_id)::int visual_order from events"""
)
def e3_visual_order(spark, d):
    e = B.table(spark, d, "events").select(
        F.to_date("ts").cast("string").alias("run_id"), F.col("event_id").alias("content_item_id"), F.col("event_type").alias("category"), F.col("props").alias("source"),
        F.when(F.col("event_id") % 3 > 0, F.col("user_id")).alias("rank"), F.lit("").alias("title"),
    )
    return runs.visual_order(e).select("run_id", "content_item_id", "visual_order")


@query(
    """select run_id, string_agg(event_type || ':' || n, ', ' order by event_type || ':' || n) rejections from (select ts::date::varchar run_id, event_type, count(*) n from events group by 1, 2) group by 1"""
)
def d21_rejections(spark, d):
    e = B.table(spark, d, "events").select(F.to_date("ts").cast("string").alias("run_id"), F.col("event_type").alias("reason"))
    return runs.rejection_text(e)


@query(
    """select l_shipdate::date::varchar run_id, count(*) calls, sum(l_extendedprice::decimal(18, 8))::double cost, count(*) filter (l_linenumber >= 5) failed from lineitem group by 1"""
)
def d23_usage(spark, d):
    u = B.usage(B.table(spark, d, "lineitem")).withColumn("run_id", F.to_date("created_at").cast("string"))
    return runs.usage_summary(u).withColumn("cost", F.col("cost").cast("double"))


@query(
    """with n as (select o_custkey event_id, list(o_orderpriority order by o_orderdate desc, o_orderpriority)[1:3] titles from orders group by 1),
    t as (select c_custkey event_id, c_name || chr(10) || c_mktsegment || coalesce(chr(10) || array_to_string(titles, chr(10)), '') || case when c_nationkey % 2 = 0 then chr(10) || 'nation-' || c_nationkey else '' end txt from customer left join n on c_custkey = event_id)
    select event_id, txt as text, sha256(txt) source_text_hash from t"""
)
def c5_embedding_inputs(spark, d):
    c = B.table(spark, d, "customer")
    ev = c.select(F.col("c_custkey").alias("event_id"), F.col("c_name").alias("canonical_title"), F.col("c_mktsegment").alias("summary"))
    o = B.table(spark, d, "orders")
    items = o.select(F.col("o_custkey").alias("event_id"), F.col("o_orderkey").alias("content_item_id"), F.col("o_orderdate").cast("timestamp").alias("matched_at"), F.lit(True).alias("is_active"))
    content = o.select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("title"))
    tag = c.where("c_nationkey % 2 = 0").select(F.col("c_nationkey").alias("id"), F.concat(F.lit("nation-"), F.col("c_nationkey").cast("string")).alias("display_name")).distinct()
    et = c.select(F.col("c_custkey").alias("event_id"), F.col("c_nationkey").alias("tag_id"))
    return runs.embedding_inputs(ev, items, content, et, tag)


@query("select doc_id from documents where doc_id % 4 = 0 or contains(text, chr(10)) order by doc_id limit 50")
def c4_embedding_todo(spark, d):
    t = B.table(spark, d, "documents")
    want = t.select("doc_id", F.sha2("text", 256).alias("source_text_hash"))
    have = t.where("doc_id % 4 > 0").select("doc_id", F.sha2(F.replace("text", F.lit("\n"), F.lit("")), 256).alias("source_text_hash"))
    return digest.embedding_todo(want, have, ["doc_id"], 50).select("doc_id")


@query("select user_id event_id, arg_max(event_type, (ts, event_id)) title from events where event_id % 4 > 0 group by 1")
def e10_latest_title(spark, d):
    e = B.table(spark, d, "events")
    return runs.latest_title(e.select(F.col("user_id").alias("event_id"), F.when(F.col("event_id") % 4 > 0, F.col("event_type")).otherwise(" ").alias("title"), F.col("ts").alias("matched_at"), F.col("event_id").alias("content_item_id")))


@query(
    """with e as (select o_custkey event_id, max(o_orderdate) l, o_custkey % 3 = 0 b, case when o_custkey % 2 = 0 then 'Active' else 'Stale' end s from orders group by 1), m as (select max(o_orderdate) t from orders)
    select event_id, s status, not b vector_recall from e, m where (s = 'Active' and l >= t - interval 480 hours) or (s = 'Stale' and l >= t - interval 60 days)"""
)
def b4_recall_window(spark, d):
    o = B.table(spark, d, "orders")
    c = F.col("event_id")
    e = o.groupBy(F.col("o_custkey").alias("event_id")).agg(F.max("o_orderdate").alias("last_seen_at")).withColumn("status", F.when(c % 2 == 0, "Active").otherwise("Stale")).withColumn("is_blacklisted", c % 3 == 0)
    e = e.join(F.broadcast(o.agg(F.max("o_orderdate").alias("now"))), F.lit(True))
    return recall.recallable(e, F.col("now"), Config(history_hours=480, archive_recall_days=60)).select("event_id", "status", (~F.col("is_blacklisted")).alias("vector_recall"))


@query(
    """select user_id event_id, min(ts) < timestamp '2024-01-29' and max(ts) >= timestamp '2024-01-29' and max(ts) <= timestamp '2024-01-31 12:00:00' reactivated, count(*) n from events group by 1"""
)
def b17_reactivated(spark, d):
    e = B.table(spark, d, "events").groupBy(F.col("user_id").alias("event_id")).agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.count("*").alias("n"))
    ntz = lambda t: F.lit(t).cast("timestamp_ntz")
    return e.select("event_id", runs.reactivated("first", "last", ntz("2024-01-29"), ntz("2024-01-31 12:00:00")).alias("reactivated"), "n")


@query(
    """select event_id, '[' || case when user_id % 3 = 0 then 'Initial' else 'Expanding' end || '] ' || case when user_id % 2 = 0 then coalesce(props, '') else 'now ' || user_id end || ' WhyNow=' || case when user_id % 5 = 0 then 'first push' else 'source increase' end
    || ',Source=' || event_type || ', src-' || user_id || ',Score=' || printf('%.1f', (user_id % 100)::double) || ',Heat=' || printf('%.2f', (user_id % 7)::double / 4) || '。' message,
    'instant:' || event_id || ':run-' || (event_id % 3) || ':' || case when user_id % 5 = 0 then 'first_push' else 'source_increase' end dedup_key from events"""
)
def i39_messages(spark, d):
    e = B.table(spark, d, "events")
    u = F.col("user_id")
    stage, summary = F.when(u % 3 == 0, F.lit(" ")).otherwise("Expanding"), F.when(u % 2 == 1, F.concat(F.lit("now "), u.cast("string")))
    reason = F.when(u % 5 == 0, "first_push").otherwise("source_increase")
    sources = F.array(F.col("event_type"), F.upper("event_type"), F.concat(F.lit("src-"), u.cast("string")))
    msg = runs.push_message(stage, summary, F.col("props"), reason, sources, (u % 100).cast("double"), (u % 7) / F.lit(4.0))
    return e.select("event_id", msg.alias("message"), runs.push_key(F.col("event_id").cast("string"), F.concat(F.lit("run-"), (F.col("event_id") % 3).cast("string")), reason).alias("dedup_key"))
