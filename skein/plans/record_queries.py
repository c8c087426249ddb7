"""Registered queries over records of runs, pushes, reports, tags and replies, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import score as S
from ..operators import digest, merging, recall, records, runs
from ..operators.state import latest
from ..operators.lineage import cut_in
from ..sources import feeds
from ..sources.config import Config
from . import bindings as B
from . import metrics as M
from .queries import _at, query


def _text(c) -> F.Column:
    return F.col(c).cast("string")


@query(
    """select o_orderkey::varchar id, case when o_orderkey % 3 = 0 then 'Running' when o_orderstatus = 'F' then 'Succeeded' else 'Partial' end status, (o_custkey % 7)::int source_count, case when o_orderkey % 3 = 0 then 0 else o_custkey % 50 end::bigint fetched_item_count,
    o_orderkey % 3 = 0 open from orders"""
)
def a15_run_complete(spark, d):
    """Runs are started, started again by a retry, and two of three completed; a run that never started isn't there."""
    o = B.table(spark, d, "orders")
    new = o.select(_text("o_orderkey").alias("id"), F.col("o_orderdate").cast("timestamp").alias("started_at"), (F.col("o_custkey") % 7).cast("int").alias("source_count"))
    t = records.run_started(records.run_started(spark.createDataFrame([], records.RUN), new), new.where("try_cast(id as bigint) % 2 = 0"))
    done = o.where("o_orderkey % 3 > 0").select(_text("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "F", "Succeeded").otherwise("Partial").alias("status"), (F.col("o_custkey") % 50).cast("bigint").alias("fetched_item_count"), F.col("o_orderdate").cast("timestamp").alias("finished_at"))
    stray = done.limit(1).withColumn("id", F.lit("none"))
    out = records.updated(t, done.unionByName(stray), "id")
    return out.select("id", "status", "source_count", "fetched_item_count", F.col("finished_at").isNull().alias("open"))


@query(
    """with l as (select user_id % 40 k, event_type || event_id v, ts from events qualify row_number() over (partition by user_id % 40 order by ts desc, event_id desc) = 1)
    select 'digest:' || k as key, case when k % 4 = 0 then 'kept' else v end as value, 'as:' || left(sha256('digest:' || k), 24) id from l"""
)
def a16_kv(spark, d):
    e = B.table(spark, d, "events")
    k = F.col("user_id") % 40
    key = F.concat(F.lit("digest:"), k.cast("string"))
    old = e.select(key.alias("key"), F.lit("kept").alias("value"), F.lit("2024-01-01").cast("timestamp").alias("updated_at")).distinct()
    t = records.keyed_state(spark.createDataFrame([], records.STATE), old)
    new = latest(e.where(k % 4 > 0).select(key.alias("key"), F.concat("event_type", _text("event_id")).alias("value"), F.col("ts").cast("timestamp").alias("updated_at"), "event_id"), ["key"], F.desc("updated_at"), F.desc("event_id"))
    return records.keyed_state(t, new).select("key", "value", "id")


@query(
    """with r as (select o_orderpriority t, o_orderdate::date dd, count(*) n, count(*) filter (o_orderkey % 2 = 0) m from orders group by 1, 2)
    select 'report:' || t || ':' || left(sha256(t || '|' || strftime(dd, '%Y-%m-%dT%H:%M:%S')), 24) id, t report_type, (case when m > 0 then m else n end)::int event_count, case when m > 0 then '{}' else '[' || n || ']' end payload_json from r"""
)
def a17_report(spark, d):
    """A report a priority and day; where there are even orders, a second write replaces the first with a blank payload."""
    o = B.table(spark, d, "orders")
    day = F.to_date("o_orderdate").cast("timestamp")

    def rows(df, payload):
        g = df.groupBy(F.col("o_orderpriority").alias("report_type"), day.alias("slot_time")).agg(F.count("*").cast("int").alias("event_count"))
        return g.select("*", F.col("slot_time").alias("generated_at"), F.lit("f").alias("file_path"), F.lit(None).cast("string").alias("public_url"), payload.alias("payload_json"))

    t = records.report_rows(spark.createDataFrame([], records.REPORT), rows(o, F.concat(F.lit("["), F.col("event_count").cast("string"), F.lit("]"))))
    return records.report_rows(t, rows(o.where("o_orderkey % 2 = 0"), F.lit(" "))).select("id", "report_type", "event_count", "payload_json")


@query("select user_id event_id, max(value) confidence from events where event_type = 'click' group by 1")
def c19_events_by_tag(spark, d):
    e = B.table(spark, d, "events")
    et = e.groupBy(F.col("user_id").alias("event_id"), F.md5(F.col("event_type").cast("binary")).alias("tag_id")).agg(F.max("value").alias("confidence"))
    tag = e.select(F.md5(F.col("event_type").cast("binary")).alias("id"), F.col("event_type").alias("name")).distinct()
    return records.event_ids_by_tag(et, tag, "click")


@query(
    """with s as (select n_regionkey r, n_name nm, min(n_nationkey) v from nation group by 1, 2)
    select c_custkey, coalesce(case when c_custkey % 3 = 0 then c_nationkey end, v) nationkey from customer join nation on c_nationkey = n_nationkey left join s on n_regionkey = r and n_name = nm and r <> 2"""
)
def c20_backfill(spark, d):
    """Two of three customers have lost their nation's key; it is found by region and name, but for one region's."""
    c, n = B.table(spark, d, "customer"), B.table(spark, d, "nation")
    rows = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, F.col("c_nationkey")).alias("nationkey"), F.col("n_regionkey").alias("region"), F.col("n_name").alias("nation"))
    return records.backfill(rows, n.where("n_regionkey <> 2"), {"region": "n_regionkey", "nation": "n_name"}, "nationkey", "n_nationkey").select("c_custkey", "nationkey")


_WINDOW = ("2024-01-10", "2024-01-20 12:00:00")


@query(
    f"""with w as (select * from events where ts between timestamp '{_WINDOW[0]}' and timestamp '{_WINDOW[1]}'), v as (select user_id, arg_max(ts, (ts, event_id)) seen from events where event_id % 7 = 0 group by 1),
    l as (select user_id, event_id, ts, value, seen from w join v using (user_id) where seen between timestamp '{_WINDOW[0]}' and timestamp '{_WINDOW[1]}' and user_id % 11 <> 0 qualify row_number() over (partition by user_id order by ts desc, value desc, event_id) = 1)
    select user_id event_id, value total_score, (row_number() over (order by value desc, user_id % 5 desc, seen desc, user_id))::int place from l qualify place <= 12"""
)
def e2_report_window(spark, d):
    """Latest scores inside a window that is bounded at both ends, in the report's own order (also F2)."""
    e = B.table(spark, d, "events")
    score = e.select(F.col("user_id").alias("event_id"), F.col("event_id").alias("score_id"), F.col("value").alias("total_score"), (F.col("user_id") % 5).cast("double").alias("heat_value"), F.col("ts").alias("calculated_at"))
    ev = e.where("event_id % 7 = 0").groupBy(F.col("user_id").alias("event_id")).agg(F.max("ts").alias("last_seen_at")).withColumns({"status": F.lit("Active"), "is_blacklisted": F.col("event_id") % 11 == 0})
    ntz = lambda t: F.lit(t).cast("timestamp_ntz")
    top = digest.report_events(score, ev, ntz(_WINDOW[0]), ntz(_WINDOW[1]), 12)
    return M.placed(top, F.desc("total_score"), F.desc("heat_value"), F.desc("last_seen_at"), F.asc("event_id")).select("event_id", "total_score", "place")


@query(
    """with b as (select o_orderdate::date run_date, count(*) n from orders where o_orderdate >= (select max(o_orderdate) from orders) - interval 30 days group by 1)
    select run_date, n total_runs, (row_number() over (order by run_date desc))::int place from b"""
)
def f9_view_order(spark, d):
    o = B.table(spark, d, "orders")
    view = M.run_success_rate(B.fetch_runs(o), o.agg(F.max("o_orderdate")))
    return M.placed(view, *M.VIEW_ORDER["run_success_rate"]()).select("run_date", "total_runs", "place")


@query(
    """select 'ess:r2:' || user_id id, user_id event_id, case when user_id % 2 = 0 then 2.0 else 1.0 end::double total_score from (select distinct user_id from events) where user_id % 3 > 0
    union all select 'ess:r1:' || user_id, user_id, 1.0::double from (select distinct user_id from events)"""
)
def h5_score_snapshots(spark, d):
    """One run's scores, a second run's, and a retry of it that has other totals for even events."""
    ids = B.table(spark, d, "events").select(F.col("user_id").alias("event_id")).distinct()
    empty = spark.createDataFrame([], "id string, event_id bigint, run_id string, calculated_at timestamp_ntz, total_score double")
    one = records.score_snapshots(empty, ids.withColumn("total_score", F.lit(1.0)), "r1", _at())
    two = records.score_snapshots(one, ids.where("event_id % 3 > 0").withColumn("total_score", F.lit(1.0)), "r2", _at())
    again = ids.where("event_id % 3 > 0 and event_id % 2 = 0").withColumn("total_score", F.lit(2.0))
    return records.score_snapshots(two, again, "r2", _at()).select("id", "event_id", "total_score")


@query(
    """with k as (select 'instant:' || user_id || ':' || event_type as dedup_key, arg_min('t' || event_id, (ts, 't' || event_id)) title, min(event_id % 2) old from events group by 1)
    select dedup_key, 'pl:' || left(sha256(dedup_key), 24) id, title, old = 1 sent_now, case when old = 1 then length(dedup_key) % 3 > 0 else false end success, case when old = 1 and length(dedup_key) % 3 > 0 then null when old = 1 then 'failed' else 'pending' end error from
    (select k.dedup_key, coalesce(o.title, k.title) title, case when o.dedup_key is null then 1 else 0 end old from k left join
      (select 'instant:' || user_id || ':' || event_type as dedup_key, arg_min('t' || event_id, (ts, 't' || event_id)) title from events where event_id % 2 = 0 group by 1) o using (dedup_key))"""
)
def h6_push_log(spark, d):
    """Two batches of messages: what the first has entered isn't sent by the second, whose results are entered."""
    e = B.table(spark, d, "events")
    key = F.concat_ws(":", F.lit("instant"), _text("user_id"), "event_type")
    msg = e.select(_text("user_id").alias("event_id"), F.lit("Instant").alias("push_type"), F.col("ts").cast("timestamp").alias("pushed_at"), F.concat(F.lit("t"), _text("event_id")).alias("title"), F.lit("first_push").alias("reason"), F.lit("c").alias("content"), key.alias("dedup_key"), (F.col("event_id") % 2).alias("odd"))
    one, _ = records.push_attempts(spark.createDataFrame([], records.PUSH), msg.where("odd = 0").drop("odd"))
    two, todo = records.push_attempts(one, msg.drop("odd"))
    ok = F.length("dedup_key") % 3 > 0
    sent = todo.select("dedup_key", ok.alias("success"), F.when(~ok, "failed").alias("error"))
    out = records.push_results(two, sent)
    return out.join(todo.select("dedup_key", F.lit(True).alias("sent_now")), "dedup_key", "left").select("dedup_key", "id", "title", F.coalesce("sent_now", F.lit(False)).alias("sent_now"), "success", "error")


@query("""select lang as name, 'tag:' || left(sha256(lang), 24) id, case when count(*) filter (doc_id % 50 = 0) > 0 then upper(lang) else lang end display_name, case when count(*) filter (doc_id % 50 = 0) > 0 then 'field' else 'topic' end category from documents group by 1""")
def h9_tag_dimension(spark, d):
    t = B.table(spark, d, "documents")
    empty = spark.createDataFrame([], records.TAG)
    one = records.tag_dimension(empty, t.select(F.col("lang").alias("name"), F.col("lang").alias("display_name"), F.lit("topic").alias("category")).distinct(), F.lit(None).cast("timestamp"))
    new = t.where("doc_id % 50 = 0").select(F.col("lang").alias("name"), F.upper("lang").alias("display_name"), F.lit("field").alias("category")).distinct()
    return records.tag_dimension(one, new, _at().cast("timestamp")).select("name", "id", "display_name", "category")


@query(
    """with m as (select distinct user_id s, user_id + 1 t from events where user_id % 10 = 3), i as (select event_id item, user_id, event_id % 4 > 0 act from events)
    select item content_item_id, case when act and s is not null then t else user_id end event_id, act and (s is null or t is not null) is_active, act and s is not null moved from (select i.*, s, t from i left join m on user_id = s)"""
)
def h12_migrate_evidence(spark, d):
    e = B.table(spark, d, "events")
    items = e.select(F.col("user_id").alias("event_id"), F.col("event_id").alias("content_item_id"), (F.col("event_id") % 4 > 0).alias("is_active"), F.lit(None).cast("string").alias("created_by_merge_id"))
    m = e.where("user_id % 10 = 3").select(F.col("user_id").alias("source_id"), (F.col("user_id") + 1).alias("target_id")).distinct()
    out = merging.deactivate_items(merging.migrate_evidence(items, m, _at()), m)
    return out.select("content_item_id", "event_id", "is_active", F.col("created_by_merge_id").isNotNull().alias("moved"))


@query(
    """select c_custkey event_id, case when c_custkey % 10 = 3 and exists (select 1 from customer x where x.c_custkey = c.c_custkey + 1) then 'Merged' else 'Active' end status, case when c_custkey % 10 = 3 and exists (select 1 from customer x where x.c_custkey = c.c_custkey + 1) then c_custkey + 1 end merged_into_event_id,
    case when p.k is not null and length(p.n) > length(c_name) then p.n else c_name end canonical_title, case when p.k is not null and p.a <> c_address then c_address || chr(10) || p.a else c_address end summary from
    (select c_custkey, 'n' || c_acctbal::int c_name, c_mktsegment c_address from customer) c left join (select c_custkey k, 'n' || c_acctbal::int n, c_mktsegment a from customer where c_custkey % 10 = 3) p on p.k + 1 = c_custkey"""
)
def h13_fold_events(spark, d):
    """Every event whose number ends in 3 is merged into the next one, which takes in its longer title and its summary."""
    c = B.table(spark, d, "customer")
    none, t = F.array().cast("array<string>"), _at()
    lists = [none.alias(x) for x in ("aliases", "entities", "places", "key_terms", "representative_titles")]
    ev = c.select(F.col("c_custkey").alias("event_id"), F.concat(F.lit("n"), F.bround("c_acctbal", 0).cast("int").cast("string")).alias("canonical_title"), F.col("c_mktsegment").alias("summary"), F.lit("Active").alias("status"), *lists, *[t.alias(x) for x in ("first_seen_at", "last_seen_at", "last_activated_at")], F.lit(None).cast("bigint").alias("merged_into_event_id"))
    m = c.where("c_custkey % 10 = 3").select(F.col("c_custkey").alias("source_id"), (F.col("c_custkey") + 1).alias("target_id"))
    m = m.join(ev.select(F.col("event_id").alias("target_id")), "target_id", "left_semi").withColumn("place", F.lit(1))
    return merging.fold_events(ev, m).select("event_id", "status", "merged_into_event_id", "canonical_title", "summary")


@query("select o_orderkey, case when o_custkey % 10 <> 0 then o_custkey end o_custkey from orders where o_custkey % 10 <> 1")
def h16_cascade(spark, d):
    """Orders go with one tenth of the customers, and lose the reference to another."""
    o, c = B.table(spark, d, "orders").select("o_orderkey", "o_custkey"), B.table(spark, d, "customer")
    left = records.without_parents(o, c.where("c_custkey % 10 = 1"), "o_custkey", "c_custkey")
    return records.without_parents(left, c.where("c_custkey % 10 = 0"), "o_custkey", "c_custkey", set_null=True)


@query("""select event_id, case event_id % 4 when 0 then event_type || ',' || user_id else '' end items, case event_id % 4 when 3 then '{"a": 1}' when 0 then '["' || event_type || '", "' || user_id || '"]' when 1 then '{}' else 'broken' end obj from events""")
def i41_json_lists(spark, d):
    r = F.col("event_id") % 4
    text = F.when(r == 0, F.concat(F.lit('["'), F.col("event_type"), F.lit('", "'), _text("user_id"), F.lit('"]'))).when(r == 1, F.lit(" ")).when(r == 2, F.lit("broken")).otherwise(F.lit('{"a": 1}'))
    e = B.table(spark, d, "events").withColumn("t", text)
    return e.select("event_id", F.array_join(records.json_list("t"), ",").alias("items"), records.object_if_blank("t").alias("obj"))


@query("select distinct doc_id item_id from documents where doc_id % 3 > 0 and doc_id % 5 = 0")
def j7_revalidate(spark, d):
    """Candidates of every fifth item have changed since; two of three items would found a new event."""
    t = B.table(spark, d, "documents").select(F.col("doc_id").alias("item_id"))
    cand = t.select("item_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("event_id"), (F.col("item_id") % 7 / F.lit(10.0)).alias("score"), F.array(F.lit("a"), F.lit("b")).alias("features"))
    after = cand.select("item_id", "event_id", F.when((F.col("item_id") % 5 == 0) & (F.col("event_id") == 2), F.col("score") + 0.01).otherwise(F.col("score")).alias("score"), F.array(F.lit("b"), F.lit("a")).alias("features"))
    found = t.select("item_id", F.when(F.col("item_id") % 3 == 0, F.lit(1)).alias("event_id"))
    return recall.revalidate(cand, after, found)


@query(
    """select event_id, case when event_id % 5 = 0 then 'unrelated' when event_id % 3 = 0 and user_id % 2 = 1 then 'unrelated' when event_id % 3 = 0 then 'same_event' else 'related_but_distinct' end decision,
    case when event_id % 5 > 0 and event_id % 3 = 0 and user_id % 2 = 0 then 'evt-' || user_id end known_id, case when event_id % 5 = 0 then 0.0 else least(1.0, greatest(0.0, (user_id - 20) / 100.0::double)) end::double confidence, user_id::bigint prompt, (user_id % 9)::bigint cached from events"""
)
def i32_replies(spark, d):
    """Fenced and plain replies; a known decision needs a known event; numbers are held between 0 and 1. Usage in two shapes."""
    u, e = F.col("user_id"), F.col("event_id")
    decision = F.when(e % 3 == 0, "same_event").otherwise("related_but_distinct")
    obj = F.concat(F.lit('{"decision": "'), decision, F.lit('", "eventId": "evt-'), u.cast("string"), F.lit('", "confidence": '), ((u - 20) / F.lit(100.0)).cast("string"), F.lit("}"))
    reply = F.when(e % 5 == 0, F.lit("no json")).when(e % 2 == 0, F.concat(F.lit("```json\n"), obj, F.lit("\n```"))).otherwise(obj)
    known = F.array(F.lit("evt-x"), F.when(u % 2 == 0, F.concat(F.lit("evt-"), u.cast("string"))))
    usage = F.when(e % 2 == 0, F.concat(F.lit('{"usage": {"prompt_tokens": '), u.cast("string"), F.lit(', "prompt_tokens_details": {"cached_tokens": '), (u % 9).cast("string"), F.lit("}}}"))).otherwise(
        F.concat(F.lit('{"usage": {"input_tokens": '), u.cast("string"), F.lit(', "cache_read_input_tokens": '), (u % 9).cast("string"), F.lit("}}"))
    )
    rows = B.table(spark, d, "events").select("event_id", feeds.cluster_reply(reply, known).alias("r"), usage.alias("body"))
    n = feeds.token_usage(F.col("body"))
    return rows.select("event_id", "r.decision", F.col("r.event_id").alias("known_id"), "r.confidence", n["prompt"].alias("prompt"), n["cached"].alias("cached"))


@query(
    """select event_id, case when event_id % 3 = 0 then 'plain ' || user_id when event_id % 3 = 1 then 'inner ' || user_id else 'one two ONE' end summary, event_id % 3 <> 1 or user_id % 2 = 0 ok, (case when event_id % 3 = 2 then 2 else 0 end)::int n_insights from events"""
)
def i33_web_extract(spark, d):
    u, e = F.col("user_id").cast("string"), F.col("event_id")
    body = F.when(e % 3 == 0, F.concat(F.lit(" plain  "), u)).when(e % 3 == 1, F.concat(F.lit('{"data": {"success": '), (F.col("user_id") % 2 == 0).cast("string"), F.lit(', "summary": "inner '), u, F.lit('"}}'))).otherwise(F.lit('{"success": true, "insights": ["one", "two", "ONE"]}'))
    out = feeds.web_extract(B.table(spark, d, "events").select("event_id", body.alias("body")))
    return out.select("event_id", "summary", "ok", F.size("insights").alias("n_insights"))


@query(
    """select event_id, case when event_id % 2 = 0 then 'high' else 'normal' end importance, case when event_id % 6 = 0 then 0.0 else least(1.0, greatest(0.0, (user_id - 30) / 50.0::double)) end::double boost, case when event_id % 3 = 0 then 'FollowUp' end stage,
    'a|b ' || user_id tags, case when event_id % 4 > 0 then 3 end::int dims from events"""
)
def i35_judge_and_tags(spark, d):
    u, e = F.col("user_id"), F.col("event_id")
    imp = F.when(e % 2 == 0, F.lit('"importance": "high", ')).otherwise(F.lit(""))
    boost = F.when(e % 6 > 0, F.concat(F.lit('"boostScore": '), ((u - 30) / F.lit(50.0)).cast("string"), F.lit(", "))).otherwise(F.lit(""))
    judge = F.concat(F.lit("{"), imp, boost, F.lit('"stage": "'), F.when(e % 3 == 0, " followup ").otherwise("odd"), F.lit('"}'))
    tags = F.concat(F.lit(" a | b "), u.cast("string"), F.lit(" || "))
    vec = F.when(e % 4 > 0, F.lit("[1, 2.5, 3]")).otherwise(F.lit("[1, 2]"))
    rows = B.table(spark, d, "events").select("event_id", runs.judge_reply(judge).alias("j"), F.array_join(runs.tag_reply(tags), "|").alias("tags"), F.size(runs.vector_reply(vec, 3)).alias("n"))
    return rows.select("event_id", "j.importance", "j.boost", "j.stage", "tags", F.when(F.col("n") > 0, F.col("n")).alias("dims"))


@query(
    """with c as (select event_id id, event_id % 3 > 0 need, case when event_id % 7 = 0 then 'Succeeded' else 'Pending' end st, user_id rk, event_type src, case when event_id % 4 = 0 then timestamp '2024-01-31 20:00:00' when event_id % 4 = 1 then timestamp '2024-01-01' end tried, event_id % 2 = 0 cur from events)
    select id from c where need and st <> 'Succeeded' and cur and (tried is null or tried <= timestamp '2024-01-31 23:59:59' - interval 12 hours) order by rk, src, id limit 25"""
)
def b6_enrichment_candidates(spark, d):
    e = B.table(spark, d, "events")
    r = F.col("event_id") % 4
    ntz = lambda t: F.lit(t).cast("timestamp_ntz")
    c = e.select(
        F.col("event_id").alias("id"), (F.col("event_id") % 3 > 0).alias("need_enrichment"), F.when(F.col("event_id") % 7 == 0, "Succeeded").otherwise("Pending").alias("enrichment_status"), F.col("user_id").alias("last_seen_rank"),
        F.col("event_type").alias("source"), F.lit("t").alias("title"), F.when(r == 0, ntz("2024-01-31 20:00:00")).when(r == 1, ntz("2024-01-01")).alias("enrichment_tried_at"), F.when(F.col("event_id") % 2 == 0, "r2").otherwise("r1").alias("last_seen_run_id"),
    )
    return digest.enrichment_candidates(c, "r2", _at(), 12, 25).select("id")


_NAME = "p_name || ' ' || p_type || ' ' || p_brand"
_TOK = "list_distinct(list_filter(regexp_split_to_array(lower(t), '[^\\p{L}\\p{Nd}]+'), lambda x: length(x) >= 2))"
_GRAM = "list_distinct(list_concat(list_transform(range(1, length(l)), lambda i: substring(l, i, 2)), list_transform(range(1, length(l) - 1), lambda i: substring(l, i, 3))))"


@query(
    f"""with i as (select p_partkey id, {_NAME} t from part), n as (select id, {_TOK} k, regexp_replace(lower(t), '[^\\p{{L}}\\p{{Nd}}]', '', 'g') l from i), g as (select id, k, {_GRAM} x from n),
    u as (select k, x, dense_rank() over (order by k, x) c, id from g), cl as (select c, any_value(k) k, any_value(x) x from u group by c),
    j as (select a.c ca, b.c cb, len(list_intersect(a.k, b.k)) kn, len(a.k) ka, len(b.k) kb, len(list_intersect(a.x, b.x)) xn, len(a.x) xa, len(b.x) xb from cl a, cl b where a.c <= b.c and list_has_any(a.k, b.k)),
    sc as (select ca, cb, kn / (ka + kb - kn)::double tj, xn / (xa + xb - xn)::double gj from j), ok as (select ca, cb, round_even(0.35::double * tj + 0.35::double * gj + 0.05::double, 4) s from sc where tj >= 0.12 and gj >= 0.18),
    rel as (select ca, cb, s from ok where s >= 0.55 union select cb, ca, s from ok where s >= 0.55),
    e as (select a.id, list(b.id order by b.id) filter (b.id is not null) r from u a left join (rel join u b on rel.cb = b.c) on rel.ca = a.c and b.id < a.id group by a.id),
    z as (select list_reduce(list({{'f': [id], 'r': coalesce(r, [])}} order by id), lambda acc, x: {{'f': case when list_has_any(acc.f, x.r) then acc.f else list_concat(acc.f, x.f) end, 'r': acc.r}}).f f from e),
    fo as (select unnest(f) id from z),
    m as (select a.id, arg_min(b.id, (-rel.s, b.id)) b, max(rel.s) s from u a join rel on rel.ca = a.c join u b on b.c = rel.cb and b.id < a.id join fo on fo.id = b.id where a.id not in (select id from fo) group by 1)
    select id item_id, b founder, s score from m union all select id, id, 1.0 from fo"""
)
def j7_ordered_commit(spark, d):
    """A batch whose later items join the events that earlier ones found, as if they were committed one by one."""
    cut = cut_in(spark, "commit")
    p = B.table(spark, d, "part").select(F.col("p_partkey").alias("item_id"), F.lit("").alias("title"), F.concat_ws(" ", "p_name", "p_type", "p_brand").alias("summary"))
    # Parts of the same words are scored once.
    texts = cut("texts", p.groupBy("summary").agg(F.min("item_id").alias("first")))
    one = texts.select(F.col("first").alias("item_id"), F.lit("").alias("title"), "summary")
    none = F.array().cast("array<string>")
    born = one.select(
        F.col("item_id").alias("event_id"), F.lit("").alias("canonical_title"), "summary", *[none.alias(c) for c in ("entities", "representative_titles", "key_terms", "aliases")], F.lit("Active").alias("status"), _at().alias("last_seen_at")
    )
    cfg = Config()
    pairs = recall.joins(recall.rule_pairs(one, born, _at(), 0, cfg.rule_merge_threshold - 0.00005), cfg).select("item_id", F.col("event_id").alias("other"), "score")
    return recall.settle_alike(p.join(texts, "summary").select("item_id", F.col("item_id").alias("place"), "first"), cut("pairs", pairs), cut)


@query("""select event_id, case when event_id % 3 = 0 then 'https://m.example/' || user_id when event_id % 3 = 1 then 'http://w.example/' || user_id end link from events""")
def e12_first_link(spark, d):
    u, r = F.col("user_id").cast("string"), F.col("event_id") % 3
    item = lambda m, w: F.struct(m.cast("string").alias("mobile_url"), w.cast("string").alias("url"))
    ev = F.array(item(F.lit(" "), F.lit(None)), item(F.when(r == 0, F.concat(F.lit("https://m.example/"), u)), F.when(r < 2, F.concat(F.lit("http://w.example/"), u))), item(F.lit(None), F.lit(" ")))
    return B.table(spark, d, "events").select("event_id", runs.first_link(ev).alias("link"))


@query(
    """with r as (select event_id, list_filter([case when user_id % 2 = 0 then 'rising_trend' end, case when user_id % 3 = 0 then 'coverage_rank' end, case when user_id % 5 = 0 then 'judge_high_importance' end, case when user_id % 7 = 0 then 'other' end, case when event_id % 11 = 0 then 'flash_repeated' end], lambda x: x is not null) x from events)
    select event_id, coalesce(list_filter(['flash_multi_source', 'flash_repeated', 'flash_follow_up', 'flash_trusted_source', 'coverage_rank', 'rising_trend', 'judge_high_importance', 'reactivation', 'source_increase', 'rank_improvement', 'score_improvement', 'first_push'], lambda p: list_contains(x, p))[1], x[-1], 'eligible') reason from r"""
)
def i40_pick_reason(spark, d):
    """The reason that is told: of highest priority, else the last, else none in particular."""
    n, u = F.col("event_id"), F.col("user_id")
    some = [(u % 2 == 0, "rising_trend"), (u % 3 == 0, "coverage_rank"), (u % 5 == 0, "judge_high_importance"), (u % 7 == 0, "other"), (n % 11 == 0, "flash_repeated")]
    return B.table(spark, d, "events").select("event_id", S.pick_reason(F.array_compact(F.array(*[F.when(c, r) for c, r in some]))).alias("reason"))


@query(
    """with c as (select event_id::varchar id, case when event_id % 2 = 0 then ' T ' || event_id else 'T ' || event_id end title, case when event_id % 3 = 0 then 'feed ' || user_id when event_id % 3 = 1 then 'old' else null end summary,
    case when event_id % 3 = 0 then 'SummaryText' else 'TitleOnly' end src, event_id % 4 asked from events)
    select id, case when src = 'SummaryText' then summary when asked = 1 then 'page ' || id when asked = 2 then 'new ' || id else trim(title) end summary,
    case when src = 'SummaryText' then src when asked in (1, 2) then 'Enrichment' else 'TitleOnly' end summary_source, case when asked = 2 then 'N ' || id else title end title,
    case when asked in (1, 2) then 'Succeeded' when asked = 3 then 'Failed' else 'Skipped' end enrichment_status, asked > 0 tried from c"""
)
def l13_enrichment_states(spark, d):
    """What a run makes of its enrichment candidates: fetched, failed, or not asked for."""
    e, n = B.table(spark, d, "events"), F.col("event_id")
    key = _text("event_id")
    todo = e.select(
        key.alias("id"), F.when(n % 2 == 0, F.concat(F.lit(" T "), key)).otherwise(F.concat(F.lit("T "), key)).alias("title"), F.lit("u").alias("url"),
        F.when(n % 3 == 0, F.concat(F.lit("feed "), _text("user_id"))).when(n % 3 == 1, "old").alias("summary"), F.when(n % 3 == 0, "SummaryText").otherwise("TitleOnly").alias("summary_source"), F.lit(None).cast("timestamp_ntz").alias("enrichment_tried_at"),
    )
    body = F.when(n % 4 == 1, F.concat(F.lit("page "), key)).when(n % 4 == 2, F.to_json(F.struct(F.struct(F.concat(F.lit("new "), key).alias("summary"), F.concat(F.lit("N "), key).alias("title")).alias("data"))))
    replies = e.where(n % 4 > 0).select(key.alias("id"), body.alias("body"), body.isNotNull().alias("success"))
    done, _ = digest.enrichment_outcome(todo, replies, _at())
    return done.select("id", "summary", "summary_source", "title", "enrichment_status", F.col("enrichment_tried_at").isNotNull().alias("tried"))


@query(
    """with s as (select distinct user_id e, ts t from events where event_id % 5 > 0), m as (select user_id e, min(ts) m from events where event_id % 95 = 0 group by 1), x as (select s.e, t, m from s left join m on s.e = m.e where m is null or t <= m),
    w as (select e, t, lag(t) over (partition by e order by t) p, coalesce(lead(t) over (partition by e order by t), m, timestamp '2024-03-01') n from x)
    select e::varchar event_id, 'Active' status, t::timestamp at_, 'first' reason from w where p is null union all select e::varchar, 'Active', t, 'reactivated' from w where p + interval 24 hours < t
    union all select e::varchar, 'Stale', t + interval 24 hours, 'stale' from w where t + interval 24 hours < n union all select e::varchar, 'Merged', m, 'merged' from m"""
)
def j3_transitions(spark, d):
    """The life of each event: first seen, stale after a silence, back again, merged."""
    from ..streaming.lifecycle import transitions

    e = B.table(spark, d, "events")
    at = F.col("ts").cast("timestamp")
    seen = e.where("event_id % 5 > 0").select(F.col("user_id").alias("event_id"), at.alias("seen_at"), F.lit("seen").alias("kind"))
    gone = e.where("event_id % 95 = 0").select(F.col("user_id").alias("event_id"), at.alias("seen_at"), F.lit("merged").alias("kind"))
    out = transitions(seen.unionByName(gone), 24, F.lit("2024-03-01").cast("timestamp"))
    return out.select("event_id", "status", F.col("at").cast("timestamp_ntz").alias("at_"), "reason")


@query(
    """with x as (select event_id e, user_id u, event_id % 4 = 0 flash from events where event_id % 5 <> 4), i as (select *, unnest([1, 2, 3]) pos from x)
    select 's' || e source_id, case when flash then 'flash_feed' else 'ranked_news' end content_kind, case when pos = 1 then 'a' || e else sha256('x' || (u % 7) || '|' || case when pos = 2 then 'https://h.example/' || u else 'only' || e end) end source_item_id,
      case pos when 1 then 'title ' || e else '' end title, case when pos = 2 then 'https://h.example/' || u end url, case pos when 1 then 'told ' || u when 3 then 'only' || e end summary,
      case when not flash then case pos when 3 then 4 else pos end end::int "rank", case when not flash then 4 end::int source_list_size,
      case when flash and pos = 1 then make_timestamp((1700000000 + e) * 1000000) when flash and pos = 2 then make_timestamp((1700000000000 + e) * 1000) end published_at from i"""
)
def a2_second_shape(spark, d):
    """Bodies of the second shape: a code instead of a status, summaries that alone make an entry, times in seconds and milliseconds."""
    e, s = B.table(spark, d, "events"), _text
    entries = F.concat(
        F.lit('[{"id": "a'), s("event_id"), F.lit('", "title": " title '), s("event_id"), F.lit('", "desc": "told '), s("user_id"), F.lit('", "pubDate": "'), (F.col("event_id") + 1_700_000_000).cast("string"), F.lit('"}, {"mobileUrl": "https://h.example/'), s("user_id"),
        F.lit('", "date": "'), (F.col("event_id") + 1_700_000_000_000).cast("string"), F.lit('"}, {"id": "none"}, {"summary": "only'), s("event_id"), F.lit('"}]'),
    )
    code = F.when(F.col("event_id") % 5 == 4, '"code": 500, ').when(F.col("event_id") % 5 == 3, '"code": 200, ').otherwise("")
    body = F.concat(F.lit("{"), code, F.lit('"data": '), entries, F.lit("}"))
    kind = F.when(F.col("event_id") % 4 == 0, "flash_feed").otherwise("ranked_news")
    bodies = e.select(F.concat(F.lit("s"), s("event_id")).alias("source_id"), F.concat(F.lit("x"), (F.col("user_id") % 7).cast("string")).alias("external_id"), kind.alias("content_kind"), body.alias("body"))
    out = feeds.list_items(bodies, 2)
    return out.select("source_id", "content_kind", "source_item_id", "title", "url", "summary", "rank", "source_list_size", F.col("published_at").cast("timestamp_ntz").alias("published_at"))
