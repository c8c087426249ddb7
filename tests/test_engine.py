"""Operators on small frames with values worked out by hand."""

import os
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from skein.functions import score as S
from skein.functions import text as X
from skein.operators import digest, merging, recall, scoring, state
from skein.sources import feeds, sinks
from skein.sources.config import Config

AT = "2026-05-05 08:00:00"
CFG = Config(source_count=3, rank_threshold=0.7, min_trend_heat=1.0)


def at():
    return F.lit(AT).cast("timestamp")


def value(spark, col):
    return spark.range(1).select(col.alias("v")).first()["v"]


def evidence(spark, kind, n=3, nrs=0.9, fresh=1.0):
    rows = [("e", f"s{i}", kind, 1 if kind == "ranked_news" else None, nrs if kind == "ranked_news" else None, fresh if kind == "flash_feed" else 0.0) for i in range(n)]
    return spark.createDataFrame(rows, "event_id string, source string, content_kind string, rank int, normalized_rank_score double, freshness_score double")


def events(spark, push_count=0, sources=None, blacklisted=False):
    rows = [("e", datetime(2026, 5, 5, 5), False, blacklisted, push_count, datetime(2026, 5, 5, 6) if push_count else None, sources, None, None)]
    return spark.createDataFrame(rows, "event_id string, first_seen_at timestamp, reactivated boolean, is_blacklisted boolean, push_count int, last_pushed_at timestamp, last_push_source_count int, last_push_rank_score double, last_push_score double")


def prior(spark, heats=()):
    rows = [("e", datetime(2026, 5, 5, 4 + i), h) for i, h in enumerate(heats)]
    return spark.createDataFrame(rows, "event_id string, calculated_at timestamp, heat_value double")


def test_ranked_scoring(spark):
    r = scoring.score_run(evidence(spark, "ranked_news"), events(spark), prior(spark, [0.1, 0.4]), at(), CFG).first()
    assert r["sources"] == 3 and r["samples"] == 3
    assert r["heat"] == pytest.approx(2.7) and r["smoothed"] == pytest.approx([0.1, 0.25, 1.475])
    assert r["rank_score"] == pytest.approx(0.9) and r["trend"] == 1.0 and r["persistence"] == pytest.approx(0.125)
    assert r["reasons"] == ["coverage_rank", "rising_trend"] and r["push_reason"] == "first_push"
    assert r["stage"] == "Escalating" and r["total"] == pytest.approx(78.75)


def test_flash_scoring(spark):
    r = scoring.score_run(evidence(spark, "flash_feed"), events(spark), prior(spark), at(), CFG).first()
    assert r["flash"] == pytest.approx(1.0) and r["rank_score"] == 0
    assert r["reasons"] == ["flash_multi_source", "flash_repeated"] and r["push_reason"] == "first_push" and r["reason"] == "flash_multi_source"


def test_topics_count_for_nothing(spark):
    r = scoring.score_run(evidence(spark, "topic", nrs=1.0), events(spark), prior(spark), at(), CFG).first()
    assert r["heat"] == 0 and not r["eligible"] and r["push_reason"] is None


def test_repeat_push_and_blacklist(spark):
    r = scoring.score_run(evidence(spark, "ranked_news", 5), events(spark, 1, 3), prior(spark), at(), CFG).first()
    assert r["push_reason"] == "source_increase"
    r = scoring.score_run(evidence(spark, "ranked_news", 5), events(spark, 0, None, True), prior(spark), at(), CFG).first()
    assert r["push_reason"] is None and not r["eligible"]


def test_secondary_merge_snapshots_are_no_samples(spark):
    p = prior(spark, [1.0, 2.0]).withColumn("id", F.lit("ess:r:e:secondary_merge"))
    assert scoring.score_run(evidence(spark, "ranked_news"), events(spark), p, at(), CFG).first()["samples"] == 1


def test_documented_total(spark):
    assert value(spark, S.total_score(F.lit(1.0), F.lit(0.5), F.lit(0.25), F.lit(0.5), F.lit(0.2), F.lit(0.0), F.lit(0.0))) == pytest.approx(59.5)


@pytest.mark.parametrize("rank,size,want", [(2, 4, 2 / 3), (1, 1, 1.0), (None, 4, None), (9, 4, 0.0)])
def test_normalized_rank(spark, rank, size, want):
    got = value(spark, S.normalized_rank(F.lit(rank).cast("int"), F.lit(size)))
    assert got == (pytest.approx(want) if want is not None else None)


def test_cost(spark):
    assert float(value(spark, S.estimated_cost(F.lit(1000), F.lit(500), F.lit(200), "1", "1", "1"))) == 0.0017


def test_text_cap(spark):
    assert value(spark, X.cap_text(F.lit("  标题  "), F.lit("第一段\n\n第二段"), limit=6)) == "标题\n第一段"


def test_tags(spark):
    raw = spark.createDataFrame([("c", ["#AI", " AI ", "监管", "金融", "政策", "风险", "市场", "extra", " "])], "owner string, tags array<string>")
    got = digest.assign_tags(raw, "owner", "tags", "web_extract").collect()
    assert len(got) == 6 and {r["name"] for r in got} >= {"ai", "监管"} and all(r["confidence"] == 0.9 for r in got)
    assert value(spark, X.tag_name(F.lit("宏观 风险"))) == "宏观-风险"


def test_enrichment(spark):
    rows = [("forced", "一个足够长的标题内容在这里", None), ("disabled", "短", None), ("x", "短", None), ("x", "一个足够长的标题内容在这里已经完整", "这是"), ("x", "突发 Breaking 一个足够长的标题内容在这里", None)]
    df = spark.createDataFrame(rows, "s string, t string, m string")
    got = [r[0] for r in df.select(X.need_enrichment("s", "t", "m", ["forced"], ["disabled"], 10)).collect()]
    assert got == [True, False, True, False, True]


def test_blacklist(spark):
    df = spark.createDataFrame([("广告事件", None), ("News", "an AD here"), ("fine", "")], "t string, s string")
    assert [r[0] for r in df.select(X.blacklist_keyword("t", "s", ["广告", "ad"])).collect()] == ["广告", "ad", None]


def test_bounded_lists(spark):
    old, new = F.array(F.lit("A"), F.lit("b")), F.array(F.lit("B"), F.lit("c"))
    assert value(spark, X.prepend_unique(old, new, 3)) == ["c", "A", "b"]
    assert value(spark, X.append_unique(old, new, 3)) == ["A", "b", "c"]


def test_anchors(spark):
    assert X.anchors_of("OpenAI GPT-5 model in Paris") == ["Paris", "OpenAI GPT-5", "GPT-5", "OpenAI"]
    assert X.anchors_of("It said On 4th") == ["On 4th", "4th", "On", "It"] and X.anchors_of("a an if x") == []
    assert X.anchors_of(" ".join(f"A{i} and" for i in range(12))) == [f"A{i}" for i in range(11, 3, -1)]
    assert X.anchors_of("Bell Labs", "Labs bell") == ["Bell Labs", "Labs", "Bell"]
    assert X.anchors_of(None) == []
    df = spark.createDataFrame([("EU AI Act",), (None,)], "t string")
    assert df.select(X.anchors("t")).first()[0][0] == "EU AI Act"


def test_rule_recall_finds_what_brute_force_finds(spark):
    items = spark.createDataFrame([("i", "OpenAI releases a new model", "the model is fast")], "item_id string, title string, summary string")
    rows = [("event-ai", "OpenAI model release", "new model", ["model"], ["OpenAI new model"]), ("event-eu", "EU law passed", "law", ["law"], []), ("event-wx", "storm", "zzz", [], [])]
    ev = spark.createDataFrame([(a, b, c, [], t, k, [], "Active", datetime(2026, 5, 5, 7)) for a, b, c, k, t in rows], "event_id string, canonical_title string, summary string, entities array<string>, representative_titles array<string>, key_terms array<string>, aliases array<string>, status string, last_seen_at timestamp")
    got = recall.rule_recall(items, ev, at(), Config()).orderBy(F.desc("score")).collect()
    assert got[0]["event_id"] == "event-ai" and "char_ngram_jaccard" in got[0]["features"]
    plan = recall.rule_recall(items, ev, at(), Config())._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_decisions(spark):
    items = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "item_id string")
    cand = spark.createDataFrame([("a", "e1", 0.6, ["token_overlap", "char_ngram_jaccard"]), ("b", "e1", 0.6, ["token_overlap"]), ("c", "e2", 0.3, [])], "item_id string, event_id string, score double, features array<string>")
    replies = spark.createDataFrame([("b", "same_event", "e1", 0.93), ("c", "follow_up", "e9", 0.95)], "item_id string, decision string, event_id string, confidence double")
    got = {r["item_id"]: (r["event_id"], r["by"]) for r in recall.decide(items, cand, Config(), replies).collect()}
    assert got == {"a": ("e1", "rule"), "b": ("e1", "model"), "c": (None, "model"), "d": (None, "none")}


def test_vector_blocks_agree(spark):
    rows = [(i, [float(i % 5), 1.0, float(i % 3)], i) for i in range(40)]
    ev = spark.createDataFrame(rows, "event_id long, v array<float>, last_seen_at long")
    q = ev.where("event_id < 7").select(F.col("event_id").alias("query_id"), "v")
    unit = lambda v: [x / sum(y * y for y in v) ** 0.5 for x in v]
    sims = {(a, b): round(sum(x * y for x, y in zip(unit(v), unit(w))), 9) for a, v, _ in rows[:7] for b, w, _ in rows}
    want = {(a, b) for a in range(7) for b in sorted((b for b in range(40) if sims[a, b] >= 0.5), key=lambda b: (-sims[a, b], -b))[:5]}
    for size in (1024, 3):
        got = recall.vector_topk(q, ev, 5, 0.5, size).collect()
        assert {(r["query_id"], r["event_id"]) for r in got} == want and len(got) == 35
        assert all(round(r["similarity"], 9) == sims[r["query_id"], r["event_id"]] for r in got)


def _event(entities, places, kind, first, last):
    return (entities, places, kind, datetime(2026, 5, first), datetime(2026, 5, last))


@pytest.mark.parametrize(
    "a,b,want",
    [
        (_event(["X"], [], "NewsEvent", 1, 2), _event(["y"], [], "NewsEvent", 1, 2), "entities_disjoint"),
        (_event(["X"], [], "NewsEvent", 1, 2), _event(["x"], [], "NewsEvent", 1, 2), None),
        (_event([], [], "A", 1, 2), _event([], [], "B", 3, 4), "time_and_type"),
        (_event([], [], "A", 1, 3), _event([], [], "B", 3, 4), None),
        (_event([], ["P"], "A", 1, 2), _event([], ["Q"], "A", 1, 2), "places_disjoint"),
        (_event([], [], "NewsEvent", 1, 2), _event([], [], "Topic", 1, 2), "type_mismatch"),
    ],
)
def test_hard_filters(spark, a, b, want):
    t = "struct<entities:array<string>,places:array<string>,type:string,first_seen_at:timestamp,last_seen_at:timestamp>"
    df = spark.createDataFrame([(a, b)], f"a {t}, b {t}")
    assert df.select(merging.hard_filter()).first()[0] == want


def test_merge_resolution_and_lineage(spark):
    pairs = spark.createDataFrame([("b", "a", 0.9, 1), ("c", "b", 0.8, 1), ("d", "a", 0.75, 1), ("e", "f", 0.75, 2)], "source_id string, target_id string, similarity double, target_last_seen_at int")
    kept = merging.resolve_pairs(pairs, 15)
    assert [(r[0], r[1]) for r in kept.collect()] == [("b", "a"), ("e", "f"), ("d", "a")]
    assert [r["source_id"] for r in merging.ordered_pairs(pairs, 3).orderBy("place").collect()] == ["b", "c", "e"]
    items = spark.createDataFrame([("b", "c1", None, True), ("z", "c2", None, True), ("b", "c3", None, False)], "event_id string, content_item_id string, created_by_merge_id string, is_active boolean")
    got = {r["content_item_id"]: (r["event_id"], r["created_by_merge_id"] is not None) for r in merging.migrate_evidence(items, kept, at()).collect()}
    assert got == {"c1": ("a", True), "c2": ("z", False), "c3": ("b", False)}


def test_secondary_merge_and_folding(spark):
    from skein.sources.config import Config

    row = lambda i, title, first, last, ents: (i, "NewsEvent", title, f"sum {i}", "Active", ents, [], [], ["k" + i], [title], datetime(2026, 5, first), datetime(2026, 5, last), datetime(2026, 5, last), None)
    events = spark.createDataFrame(
        [row("a", "short", 1, 4, ["X"]), row("b", "a longer title", 2, 5, ["x", "Y"]), row("c", "c", 3, 5, ["Q"]), row("d", "d", 3, 6, ["x"])],
        "event_id string, type string, canonical_title string, summary string, status string, entities array<string>, aliases array<string>, places array<string>, key_terms array<string>, representative_titles array<string>, "
        "first_seen_at timestamp, last_seen_at timestamp, last_activated_at timestamp, merged_into_event_id string",
    )
    pairs = spark.createDataFrame([("b", "a", 0.9, 1), ("c", "a", 0.8, 1), ("d", "a", 0.7, 1), ("d", "b", 0.65, 1)], "source_id string, target_id string, similarity double, target_last_seen_at int")
    verdict = lambda *r: spark.createDataFrame([(s, t, "same_event", c, "r") for s, t, c in r], "source_id string, target_id string, decision string, confidence double, reason string")
    assert merging.secondary_merge(events, pairs, Config()).isEmpty()
    chosen = merging.secondary_merge(events, pairs, Config(), verdict(("b", "a", 0.9), ("c", "a", 0.9), ("d", "a", 0.5), ("d", "b", 0.9)))
    assert [(r["source_id"], r["target_id"]) for r in chosen.collect()] == [("b", "a")]  # c: other entities; d-a: unsure; d-b: b is gone
    both = merging.secondary_merge(events, pairs, Config(), verdict(("b", "a", 0.9), ("d", "a", 0.9)))
    out = {r["event_id"]: r for r in merging.fold_events(events, both).collect()}
    a = out["a"]
    assert (a["canonical_title"], a["entities"], a["key_terms"], a["summary"]) == ("a longer title", ["X", "Y"], ["ka", "kb", "kd"], "sum a\nsum b\nsum d")
    assert (a["first_seen_at"].day, a["last_seen_at"].day, a["status"], a["representative_titles"]) == (1, 6, "Active", ["short", "a longer title", "d"])
    assert [(out[i]["status"], out[i]["merged_into_event_id"]) for i in "bd"] == [("Merged", "a")] * 2 and out["c"]["status"] == "Active"
    items = spark.createDataFrame([("b", "i", True, None), ("b", "j", False, None)], "event_id string, content_item_id string, is_active boolean, created_by_merge_id string")
    left = {r["content_item_id"]: (r["event_id"], r["is_active"]) for r in merging.deactivate_items(merging.migrate_evidence(items, both, at()), both).collect()}
    assert left == {"i": ("a", True), "j": ("b", False)}


def test_matched_events_take_items_in(spark):
    from skein.plans.pipeline import update_matched

    ev = spark.createDataFrame([("e", "Old", "was", ["t1"], ["k1"], ["Ent"], []), ("f", "F", "f", [], [], [], [])], "event_id string, canonical_title string, summary string, representative_titles array<string>, key_terms array<string>, entities array<string>, aliases array<string>")
    m = spark.createDataFrame([("e", "Beta News", "x", 2, "s", None, None), ("e", "Alpha Corp", "ENT", 1, "s", " New ", "fresh")], "event_id string, title string, summary string, rank int, source string, reply_title string, reply_summary string")
    out = {r["event_id"]: r for r in update_matched(ev, m).collect()}
    e = out["e"]
    assert (e["canonical_title"], e["summary"], e["representative_titles"]) == ("New", "fresh", ["Beta News", "Alpha Corp", "t1"])
    assert e["entities"] == ["Beta", "Alpha", "Corp", "Alpha Corp", "Ent"] and e["key_terms"][-1] == "k1" and "beta" in e["key_terms"] and "New" in e["aliases"]
    assert out["f"].asDict() == ev.where("event_id = 'f'").first().asDict()


def test_records(spark, tmp_path):
    from skein.operators import records as R

    t = datetime(2026, 5, 5, 12, 0, 0, 123000)
    assert R.run_id(t, "abcdef0123456789") == "fr:20260505120000123:abcdef0123"
    store = R.Store(spark, str(tmp_path / "s"))
    new = spark.createDataFrame([("r1", t, 3)], "id string, started_at timestamp, source_count int")
    runs_ = store.update("run", R.RUN, lambda x: R.run_started(x, new))
    assert runs_.first()["status"] == "Running" and store.update("run", R.RUN, lambda x: R.run_started(x, new)).count() == 1
    done = spark.createDataFrame([("r1", "Partial"), ("r9", "Failed")], "id string, status string")
    row = store.update("run", R.RUN, lambda x: R.updated(x, done, "id").select(*x.columns)).collect()
    assert [(r["id"], r["status"], r["source_count"]) for r in row] == [("r1", "Partial", 3)]
    kv = lambda v, at_: spark.createDataFrame([("k", v, at_)], "key string, value string, updated_at timestamp")
    s = store.update("state", R.STATE, lambda x: R.keyed_state(x, kv("1", t)))
    first = s.first()["id"]
    s = store.update("state", R.STATE, lambda x: R.keyed_state(x, kv("2", t)))
    assert R.state_value(s, "k") == "2" and R.state_value(s, "none") is None and s.first()["id"] == first and first.startswith("as:")
    msg = spark.createDataFrame([("e", "Instant", t, "a", "r", "c", "k1"), ("e", "Instant", t, "b", "r", "c", "k1"), ("f", "Instant", t, "f", "r", "c", "k2")], "event_id string, push_type string, pushed_at timestamp, title string, reason string, content string, dedup_key string")
    log, todo = R.push_attempts(store.read("push", R.PUSH), msg)
    assert sorted(r["title"] for r in todo.collect()) == ["a", "f"] and {r["error"] for r in log.collect()} == {"pending"}
    log = store.write("push", log)
    assert R.push_attempts(log, msg)[1].isEmpty()
    got = {r["dedup_key"]: (r["success"], r["error"], r["title"]) for r in R.push_results(log, spark.createDataFrame([("k1", True, None), ("k9", True, None)], "dedup_key string, success boolean, error string")).collect()}
    assert got == {"k1": (True, None, "a"), "k2": (False, "pending", "f")}
    rep = lambda n, p: spark.createDataFrame([("daily", t, t, f"f{n}", None, n, p)], "report_type string, slot_time timestamp, generated_at timestamp, file_path string, public_url string, event_count int, payload_json string")
    reports = store.update("report", R.REPORT, lambda x: R.report_rows(x, rep(1, " ")))
    assert reports.first()["payload_json"] == "{}" and reports.first()["id"].startswith("report:daily:")
    assert [(r["event_count"], r["file_path"]) for r in store.update("report", R.REPORT, lambda x: R.report_rows(x, rep(2, "[]"))).collect()] == [(2, "f2")]
    tags = R.tag_dimension(spark.createDataFrame([], R.TAG), spark.createDataFrame([("ai", "AI", "topic")], "name string, display_name string, category string"), at())
    again = R.tag_dimension(tags, spark.createDataFrame([("ai", "A.I.", "field")], "name string, display_name string, category string"), F.lit(None).cast("timestamp")).first()
    assert (again["display_name"], again["category"], again["id"]) == ("A.I.", "field", tags.first()["id"]) and again["created_at"] is not None
    child = spark.createDataFrame([("x", "p1"), ("y", "p2")], "id string, parent string")
    gone = spark.createDataFrame([("p1",)], "pid string")
    assert [r["id"] for r in R.without_parents(child, gone, "parent", "pid").collect()] == ["y"]
    assert {r["id"]: r["parent"] for r in R.without_parents(child, gone, "parent", "pid", True).collect()} == {"x": None, "y": "p2"}
    j = spark.createDataFrame([("[\"a\"]",), (" ",), (None,), ("oops",)], "t string").select(R.json_list("t").alias("l"), R.object_if_blank("t").alias("o")).collect()
    assert [r["l"] for r in j] == [["a"], [], [], []] and [r["o"] for r in j] == ['["a"]', "{}", "{}", "oops"]


def test_model_calls_are_tried_again(spark):
    from skein.operators import models as M

    tries = []

    def flaky():
        tries.append(1)
        if len(tries) < 3:
            raise M.BadStatus("HTTP 500")
        return "7"

    assert M.with_retries(flaky, int, None) == (7, True, None, 2, "7")
    assert M.with_retries(lambda: "x", int, -1)[:4] == (-1, False, "invalid literal for int() with base 10: 'x'", 3)
    with pytest.raises(RuntimeError):
        M.with_retries(lambda: (_ for _ in ()).throw(RuntimeError("bug")), int, None)

    def send(row):
        if row["id"] == "b":
            raise OSError("down")
        return f"reply {row['id']}"

    got = {r["id"]: (r["body"], r["success"], r["error"], r["retry_count"]) for r in M.call_all(spark.createDataFrame([("a",), ("b",)], "id string"), "id", send).collect()}
    assert got == {"a": ("reply a", True, None, 0), "b": (None, False, "down", 3)}


def test_config_file(tmp_path):
    pytest.importorskip("yaml")
    from skein.sources.config import load_config

    path = tmp_path / "c.yaml"
    path.write_text("analysis:\n  historyHours: 48\n  push:\n    pushTime: ['08:00']\n  event:\n    sourceCount: 2\nenrichment:\n  web_extract_url: x\n  maxRequestsPerRun: 7\nother: 1\n")
    cfg = load_config(str(path))
    assert (cfg.history_hours, cfg.push_times, cfg.source_count, cfg.enrichment_budget, cfg.stale_hours) == (48, ("08:00",), 2, 7, 24)
    path.write_text("system:\n  maxParallelLlm: 2\n")
    with pytest.raises(ValueError, match="maxParallelLlm"):
        load_config(str(path))
    path.write_text("analysis:\n  event:\n    sourceCount: 0\n")
    with pytest.raises(ValueError, match="source_count"):
        load_config(str(path))


def test_report_window_and_digest_text(spark):
    d = lambda n: datetime(2026, 5, n)
    ev = spark.createDataFrame([("a", "Active", False, d(3)), ("b", "Active", False, d(9)), ("c", "Active", True, d(3)), ("e", "Active", False, d(4))], "event_id string, status string, is_blacklisted boolean, last_seen_at timestamp")
    sc = spark.createDataFrame([("a", "1", d(2), 50.0, 1.0), ("a", "2", d(3), 40.0, 1.0), ("a", "3", d(9), 90.0, 1.0), ("b", "4", d(3), 99.0, 1.0), ("c", "5", d(3), 99.0, 1.0), ("e", "6", d(3), 40.0, 2.0)], "event_id string, score_id string, calculated_at timestamp, total_score double, heat_value double")
    out = digest.report_events(sc, ev, F.lit(d(1)), F.lit(d(5)), 5).collect()
    assert [(r["event_id"], r["score_id"]) for r in out] == [("e", "6"), ("a", "2")]
    m = "array<struct<time:timestamp,label:string,source:string,summary:string>>"
    rows = spark.createDataFrame(
        [(1, "T", "a\r\nb", " ", "Expanding", None, [(d(1), "L1", "s1", "x"), (d(2), "L2", "S1", None)], ["k"], ["K", "e"], 61.25, 1.5, 3, 2.0), (2, "U", None, "Cooling", None, "p\nq", [], None, None, 1.0, 0.0, 0, 0.0)],
        f"place int, canonical_title string, summary string, current_stage string, score_stage string, progress_summary string, milestones {m}, key_terms array<string>, entities array<string>, total_score double, heat_value double, sources int, avg_rank double",
    )
    got = [r[0] for r in rows.select(digest.digest_entry()).collect()]
    assert got[0].split("\n") == ["1. T", "摘要：a b", "阶段：Expanding", "进程：L2: 暂无摘要；L1: x", "热度：总分 61.3，Heat 1.50，来源数 3，平均排名 2.0。", "来源/术语：s1；k, e"]
    assert got[1].split("\n")[1:4] == ["摘要：暂无摘要", "阶段：Cooling", "进程：p q"] and got[1].endswith("未记录来源；未记录术语")
    text = digest.digest_text("2026-05-05", "09:20", got, "http://r")
    assert text.split("\n")[:3] == ["2026-05-05 09:20 舆情摘要，共 2 个事件：", "静态报告：http://r", ""]


def test_revalidation(spark):
    t = "item_id string, event_id string, score double, features array<string>"
    before = spark.createDataFrame([("i", "e", 0.5, ["b", "a"]), ("j", "e", 0.4, ["a"]), ("k", "e", 0.4, ["a"])], t)
    after = spark.createDataFrame([("i", "e", 0.5, ["a", "b"]), ("j", "e", 0.45, ["a"]), ("k", "e", 0.9, ["a"]), ("l", "e", 0.9, ["a"])], t)
    found = spark.createDataFrame([("i", None), ("j", None), ("k", "e"), ("l", None)], "item_id string, event_id string")
    assert sorted(r[0] for r in recall.revalidate(before, after, found).collect()) == ["j", "l"]


def test_a_whole_run_twice(spark, tmp_path):
    import json as j

    from skein.operators.records import RUN, PUSH, Store
    from skein.operators.runs import Source
    from skein.plans.pipeline import Models, run_fetch
    from skein.sources.config import Config

    sources = [Source("p", "c", f"s{i}", display_name=f"Source {i}") for i in range(4)]

    def fetch(row):
        if row["external_id"] == "s3":
            raise OSError("down")
        # Titles as near as "Market s0 Rally ..." and "Market s1 Rally ..." are one event by the rule.
        other = {"s0": "Market Rally Ends Today", "s1": "New Telescope Finds Water", "s2": "Football Cup Final Postponed"}[row["external_id"]]
        return j.dumps({"status": "success", "items": [{"id": f"q-{row['external_id']}", "title": "Quake Hits Japan Coast", "url": "http://x/1"}, {"id": f"m-{row['external_id']}", "title": other, "url": "http://x/2"}]})

    sent = []
    models = Models(
        fetch=fetch, embed=lambda r: j.dumps([1.0, float(len(r["text"]) % 3)]), tag=lambda r: "disaster | asia" if "Quake" in r["title"] else "market",
        push=lambda m: sent.append(m["dedup_key"]) is None, merge=lambda r: j.dumps({"decision": "unrelated", "confidence": 1.0}),
    )
    cfg = Config(dimensions=2, source_count=3, rank_threshold=0.5)
    store = Store(spark, str(tmp_path / "store"))
    one = run_fetch(spark, store, sources, models, "2026-05-05 09:00:00", "r1", cfg)
    from skein.plans.pipeline import STAGE

    assert [(r["stage"], r["error"]) for r in store.read("fetch_run_stage", STAGE).where("status = 'failed'").collect()] == []
    assert one["status"] == "Partial" and one["items"] == 6 and one["matched"] == 6 and one["pushed"] == 1
    assert {s for s, _ in one["stages"]} == {"fetch", "ingest", "enrich", "embedding", "match", "tagging", "score", "push", "secondary_merge"} and {x for _, x in one["stages"]} == {"succeeded", "skipped"}
    events = store.read("event", __import__("skein.plans.pipeline", fromlist=["EVENT"]).EVENT).collect()
    quake = [e for e in events if e["canonical_title"].startswith("Quake")]
    assert len(quake) == 1 and quake[0]["push_count"] == 1 and len(events) == 4
    two = run_fetch(spark, store, sources, models, "2026-05-05 10:00:00", "r2", cfg)
    assert two["matched"] == 0 and two["pushed"] == 0 and len(sent) == 1
    assert {r["id"]: r["status"] for r in store.read("fetch_run", RUN).collect()} == {"r1": "Partial", "r2": "Partial"} and store.read("push_log", PUSH).count() == 1


def test_a_run_with_judge_blacklist_enrichment_and_a_retry(spark, tmp_path):
    import json as j

    from skein.operators import records
    from skein.operators.runs import Source
    from skein.plans import pipeline as P
    from skein.sources.config import Config

    titles = {"s0": "Harbour Fire Spreads Quickly Tonight", "s1": "Harbour Fire Spreads Quickly", "s2": "Harbour Fire Spreads Quickly Now"}
    sources = [Source("p", "c", f"s{i}", display_name=f"Source {i}") for i in range(3)]
    fail = {"extract": False}

    def fetch(row):
        x = row["external_id"]
        items = [{"id": "f1", "title": titles[x], "url": "http://x/f"}, {"id": f"c-{x}", "title": f"Casino advert of {x}", "url": "http://x/c"}, {"id": "A1", "title": "?"}, {"id": "a1", "title": "!", "url": "http://x/last"}]
        return j.dumps({"status": "success", "items": items})

    def extract(row):
        if fail["extract"]:
            raise OSError("down")
        return j.dumps({"summary": f"page {row['url']}", "insights": ["Fire Service"]})

    asked = {"judge": [], "tag": [], "extract": 0}
    tokens = {"usage": {"prompt_tokens": 1000, "completion_tokens": 100}}
    models = P.Models(fetch=fetch, extract=extract, judge=lambda r: j.dumps({"importance": "high", "boostScore": 0.4, "stage": "escalating"} | tokens), tag=lambda r: "fire", push=lambda m: True)
    cfg = Config(source_count=3, rank_threshold=0.5, blacklist=("casino",), enrichment_budget=1, models={"judge": "big"}, prices={"big": ("3", "15", "0")})
    store = records.Store(spark, str(tmp_path / "store"))
    for _ in range(2):  # the second one is a retry of the first
        out = P.run_fetch(spark, store, sources, models, "2026-05-05 09:00:00", "r1", cfg)
        assert [r["error"] for r in store.read("fetch_run_stage", P.STAGE).where("status = 'failed'").collect()] == []
    assert asked["extract"] == 0 and out["status"] == "Succeeded" and out["updated"] == 9 and out["inserted"] == 0 and out["items"] == 12
    snaps = store.read("snapshot", P.SNAPSHOT).collect()
    assert len(snaps) == 12 and sorted(s["visual_order"] for s in snaps) == list(range(1, 13)) and all(s["id"].startswith(f"r1:snap:{s['visual_order']:05d}:c:p-c-s") for s in snaps)
    content = {r["dedup_key"]: r for r in store.read("content", P.CONTENT).collect()}
    # The last row of a key stands: "A1" and "a1" are one item, ranked 3 and 4.
    assert len(content) == 9 and content["p:c:s0:a1"]["title"] in ("!",) and content["p:c:s0:f1"]["id"].startswith("ci:c:p-c-s0:")
    states = {k: r["enrichment_status"] for k, r in content.items()}
    assert set(states.values()) <= {"Succeeded", "Skipped"} and sum(v == "Succeeded" for v in states.values()) == 2  # one a try
    assert all(r["summary_source"] == ("Enrichment" if r["enrichment_status"] == "Succeeded" else "TitleOnly") for r in content.values())
    events = {r["event_id"]: r for r in store.read("event", P.EVENT).collect()}
    fire = [e for e in events.values() if e["canonical_title"].startswith("Harbour")]
    assert len(fire) == 1 and fire[0]["push_count"] == 1 and fire[0]["current_stage"] == "Escalating"
    casino = [e for e in events.values() if "Casino" in e["canonical_title"]]
    assert casino and all(e["is_blacklisted"] and not e["push_count"] for e in casino)
    # Items without any term don't share an event.
    assert sum(e["canonical_title"] in ("?", "!") for e in events.values()) == 3
    scores = store.read("score", P.SCORE).where(F.col("event_id") == fire[0]["event_id"]).collect()
    assert len(scores) == 1 and "judge_high_importance" in scores[0]["trigger_reasons"]
    usage = store.read("llm_usage", records.USAGE).where("stage = 'judge'").collect()
    assert usage and all(u["model"] == "big" and float(u["estimated_cost"]) == 0.0045 for u in usage)
    run = store.read("fetch_run", records.RUN).first()
    assert float(run["estimated_llm_cost"]) == round(0.0045 * len(usage), 8)
    assert store.read("fetch_run_source", P.RUN_SOURCE).count() == 3 and store.read("source", P.SOURCE).count() == 3
    tags = {(r["content_item_id"], r["source"]) for r in store.read("content_tag", P.CONTENT_TAG).collect()}
    # All nine have tags; the two that were fetched have the page's, and one of them had been asked about before.
    assert len({c for c, _ in tags}) == 9 and [sum(s == k for _, s in tags) for k in ("web_extract", "llm")] == [2, 8]
    # A fetch that fails is tried again after the cooldown only.
    fail["extract"] = True
    P.run_fetch(spark, store, sources, models, "2026-05-05 10:00:00", "r2", cfg)
    failed = store.read("content", P.CONTENT).where("enrichment_status = 'Failed'")
    assert failed.count() > 0 and failed.where("summary_source <> 'TitleOnly' or enrichment_tried_at is null").count() == 0
    before = {r["id"] for r in failed.collect()}
    P.run_fetch(spark, store, sources, models, "2026-05-05 11:00:00", "r3", cfg)
    again = store.read("content", P.CONTENT).where("enrichment_tried_at = timestamp_ntz'2026-05-05 11:00:00'")
    assert not before & {r["id"] for r in again.collect()}
    assert store.read("snapshot", P.SNAPSHOT).groupBy("run_id").count().where("count <> 12").count() == 0


def test_ingest_is_idempotent(spark):
    empty = spark.createDataFrame([], "dedup_key string, id string, title string, url string, summary string, enrichment_status string, created_at timestamp, last_seen_at timestamp, last_seen_run_id string, last_seen_rank int")
    batch = spark.createDataFrame([(1, "k", "s", "1", "t", None, "sum", 1, True), (2, "k", "s", "1", "t2", None, None, 2, True)], "`order` int, dedup_key string, source string, source_item_id string, title string, url string, summary string, rank int, need_enrichment boolean")
    one = state.ingest(empty, batch, "r1", at())
    r = one.first()
    assert (r["action"], r["title"], r["enrichment_status"]) == ("inserted", "t2", "Pending")
    two = state.ingest(one.drop("action"), batch, "r1", at()).collect()
    assert len(two) == 1 and two[0]["action"] == "updated" and two[0]["id"] == r["id"]
    done = one.drop("action").withColumn("enrichment_status", F.lit("Succeeded")).withColumn("summary", F.lit("kept"))
    r = state.ingest(done, batch, "r2", at()).first()
    assert (r["enrichment_status"], r["summary"]) == ("Succeeded", "kept")


def test_lifecycle(spark):
    ev = spark.createDataFrame([("a", "Active", datetime(2026, 5, 4), datetime(2026, 5, 4)), ("b", "Active", datetime(2026, 5, 5, 7), datetime(2026, 5, 1))], "event_id string, status string, last_seen_at timestamp, last_activated_at timestamp")
    aged = state.mark_stale(ev, at(), 24)
    assert {r["event_id"]: r["status"] for r in aged.collect()} == {"a": "Stale", "b": "Active"}
    seen = spark.createDataFrame([("a",)], "event_id string")
    r = state.touch(aged, seen, at(), 24).where("event_id = 'a'").first()
    assert r["status"] == "Active" and r["reactivated"]


def test_feed_one(spark):
    body = '{"status":"success","items":[{"id":"1","title":"A","url":"u"},"bad",{"title":" ","url":""},{"title":"B","url":"http://b","pubDate":1710000000}]}'
    rows = [("s", "ext", k, body) for k in ("ranked_news", "flash_feed")]
    got = feeds.list_items(spark.createDataFrame(rows, "source_id string, external_id string, content_kind string, body string")).collect()
    ranked = [r for r in got if r["content_kind"] == "ranked_news"]
    assert [r["rank"] for r in ranked] == [1, 4] and {r["source_list_size"] for r in ranked} == {4} and len(ranked[1]["source_item_id"]) == 64
    flash = [r for r in got if r["content_kind"] == "flash_feed"][1]
    assert flash["rank"] is None and flash["published_at"] == datetime(2024, 3, 9, 16, 0)


def test_feed_two(spark):
    body = '{"data":[{"name":"N","link":"l","description":"d"},{"desc":"only"}]}'
    df = spark.createDataFrame([("s", "e", "ranked_news", body), ("s", "e", "ranked_news", '{"code":500,"data":[{"title":"x"}]}')], "source_id string, external_id string, content_kind string, body string")
    got = feeds.list_items(df, 2).collect()
    assert [(r["title"], r["url"], r["summary"]) for r in got] == [("N", "l", "d"), ("", None, "only")]


def test_replies_and_extracts(spark):
    assert value(spark, feeds.unfence(F.lit('```json\n{"a":1}\n```'))) == '{"a":1}'
    r = value(spark, feeds.cluster_reply(F.lit('{"decision":"same_event","eventId":"e9","confidence":2}'), F.array(F.lit("e1"))))
    assert (r["decision"], r["event_id"]) == ("unrelated", None)
    df = spark.createDataFrame([('{"data":{"success":true,"insights":["a","A","b"]}}',), ("plain  text",), ('{"success":false}',)], "body string")
    got = feeds.web_extract(df).collect()
    assert got[0]["insights"] == ["a", "b"] and got[1]["summary"] == "plain text" and got[2]["ok"] is False


def test_report_sink_escapes(tmp_path):
    p = sinks.write_report([{"title": "<script>", "content_items": [{"title": "t", "url": "javascript:x"}, {"title": "u", "url": "https://ok"}]}], str(tmp_path), datetime(2026, 5, 5, 8, 20))
    text = p.read_text()
    assert p.name == "digest-20260505-082000.html" and "&lt;script&gt;" in text and "javascript" not in text and 'href="https://ok"' in text


def test_slots():
    from datetime import timezone

    t = datetime(2026, 5, 5, 1, 20, tzinfo=timezone.utc)
    assert digest.due_slot(t, ("09:20",), "Asia/Shanghai", set()) == ("2026-05-05", "09:20")
    assert digest.due_slot(t, ("09:20",), "Asia/Shanghai", {"digest:processed:2026-05-05:09:20"}) is None
    assert digest.digest_key("2026-05-05", "08:20") == "digest:2026-05-05:08:20"


def test_config():
    assert Config().validate() == []
    assert len(Config(rank_threshold=2, push_times=("25:00",), candidate_limit=0).validate()) == 3


def test_stream_is_idempotent(spark, tmp_path):
    from skein.streaming.microbatch import feed_stream, run_stream

    src = tmp_path / "in"
    src.mkdir()
    (src / "a.json").write_text('{"source_id":"s","external_id":"e","content_kind":"ranked_news","body":"{\\"status\\":\\"success\\",\\"items\\":[{\\"id\\":\\"1\\",\\"title\\":\\"A\\"}]}"}\n')
    seen = []
    for _ in range(2):
        run_stream(feed_stream(spark, str(src)), lambda df, i: seen.append(feeds.list_items(df).count()), str(tmp_path / "cp")).awaitTermination()
    assert sum(seen) == 1


def test_registry_and_isolated_fetches(spark):
    from skein.operators import runs

    reg = runs.registry(spark, [runs.Source("p", "c", "1"), runs.Source("p", "c", "2", id="own"), runs.Source("p", "c", "3", enabled=False)])
    assert sorted(r["id"] for r in reg.collect()) == ["own", "p:c:1"]

    def fetch(row):
        if row["external_id"] == "2":
            raise ValueError("down")
        return "body"

    got = {r["source_id"]: (r["status"], r["error"]) for r in runs.fetch_all(reg, fetch).collect()}
    assert got == {"p:c:1": ("succeeded", None), "own": ("failed", "ValueError: down")}


def test_stages_isolate_failures(spark):
    from skein.operators import runs

    s = runs.Stages("r")
    assert s.run("match", lambda: 1 / 0, default=7) == 7 and s.run("score", lambda: 3) == 3
    with pytest.raises(ZeroDivisionError):
        s.run("fetch", lambda: 1 / 0)
    assert [r["status"] for r in s.frame(spark).collect()] == ["failed", "succeeded", "failed"]


def test_digest_job_runs_once_a_slot(spark):
    from datetime import timezone

    from skein.operators import runs

    sent, done, pushed = [], set(), set()
    t = datetime(2026, 5, 5, 1, 20, tzinfo=timezone.utc)
    job = lambda: runs.digest_job(lambda: spark.createDataFrame([("e", 88.0)], "event_id string, total double"), t, Config(), done, pushed, lambda m: sent.append(m) or True)
    assert job()["sent"] and job() is None and len(sent) == 1 and pushed == {"digest:2026-05-05:09:20"}
    done.clear()
    assert job() == {"dedup_key": "digest:2026-05-05:09:20", "sent": False} and len(sent) == 1


def test_model_replies(spark):
    from skein.operators import runs

    r = value(spark, runs.judge_reply(F.lit('```json\n{"importance":"High","boostScore":3,"stage":"expanding"}\n```')))
    assert (r["boost"], r["stage"], r["labels"]) == (1.0, "Expanding", [])
    assert value(spark, runs.tag_reply(F.lit(" a | b || c"))) == ["a", "b", "c"]
    assert value(spark, runs.vector_reply(F.lit("[1, 2]"), 2)) == [1.0, 2.0] and value(spark, runs.vector_reply(F.lit("[1]"), 2)) is None


def test_pipeline_run(spark):
    from skein.plans.pipeline import run_once

    t = datetime(2026, 5, 5, 7)
    ev = spark.createDataFrame(
        [("evt:old", "OpenAI releases new model", "the model", [], ["OpenAI releases new model"], ["model", "openai"], [], "Active", t, t, t, False, 0, None, None, None)],
        "event_id string, canonical_title string, summary string, entities array<string>, representative_titles array<string>, key_terms array<string>, aliases array<string>, status string, first_seen_at timestamp, last_seen_at timestamp, last_activated_at timestamp, is_blacklisted boolean, push_count int, last_push_source_count int, last_push_rank_score double, last_push_score double",
    )
    items = spark.createDataFrame(
        [("i1", "OpenAI releases new model", "the model", "s1", "1", 1), ("i2", "storm hits coast", "", "s1", "2", 2), ("i3", "storm hits coast", "", "s2", "9", 1)],
        "item_id string, title string, summary string, source string, source_item_id string, rank int",
    )
    seen = spark.createDataFrame([(i, f"s{i}", "ranked_news", 1, 0.9, 0.0) for i in ("i1", "i2", "i3")], "item_id string, source string, content_kind string, rank int, normalized_rank_score double, freshness_score double")
    out = run_once(items, ev, seen, spark.createDataFrame([], "event_id string, calculated_at timestamp, heat_value double"), at(), CFG)
    m = {r["item_id"]: r["event_id"] for r in out.mapping.collect()}
    assert m["i1"] == "evt:old" and m["i2"] == m["i3"] != "evt:old"
    assert out.events.count() == 2
    assert {r["event_id"]: r["sources"] for r in out.scores.collect()} == {"evt:old": 1, m["i2"]: 2}


def test_lines_out(spark):
    from skein.operators.models import BadStatus
    from skein.sources import sinks

    at_, headers, body = sinks.webhook_request({"title": "T", "content": "m", "link": "l"}, " http://p/x?a=1 ", " k ", "a b", " ")
    assert at_ == "http://p/x?a=1&channels=a%20b" and headers["Push-Key"] == "k"
    assert __import__("json").loads(body) == {"cate": "default", "title": "T", "msg": "m", "link": "l"}
    seen = []
    assert sinks.webhook("http://p", "k", send=lambda *a: seen.append(a) or "")({"title": "T"}) and len(seen) == 1
    assert not sinks.webhook("", "k", send=lambda *a: 1 / 0)({}) and not sinks.webhook("http://p", "k", send=lambda *a: (_ for _ in ()).throw(BadStatus("HTTP 500")))({})
    assert sinks.feed_address("http://n/", "a b") == "http://n/api/s?id=a%20b" and sinks.feed_address("http://n", "hot", 2) == "http://n/hot"
    rows = spark.createDataFrame([("a", '{"title": "A|B", "total": "3"}', None), ("b", '{"name": "x", "data": []}', None), ("c", None, "down")], "source_id string, body string, error string")
    got = [r.asDict() for r in sinks.source_health(rows).orderBy("source_id").collect()]
    assert [(r["name"], r["total"], r["status"]) for r in got] == [("A|B", 3, "OK"), ("x", 0, "Empty"), (None, None, "Unknown")]
    assert sinks.markdown(got, ["source_id", "name", "error"], 6).split("\n") == ["| source_id | name | error |", "| --- | --- | --- |", "| a | A\\|B |  |", "| b | x |  |", "| c |  | down |"]


def test_vector_search_skips_far_blocks_and_stays_exact(spark):
    """Clusters on the sphere: pivots' bounds rule most pairs out, and what is left equals brute force."""
    import numpy as np

    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 16))
    v = centres[rng.integers(0, 12, 900)] + 0.05 * rng.normal(size=(900, 16))
    rows = [(i, [float(x) for x in w], i % 5) for i, w in enumerate(v)] + [(5000, [0.0] * 16, 1), (5001, None, 1), (5002, [1.0, 2.0], 3), (5003, [2.0, 4.0], 3)]
    ev = spark.createDataFrame(rows, "event_id long, v array<double>, last_seen_at long")
    looked, made = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)

    def stats(pairs, products):
        looked.add(pairs)
        made.add(products)

    got = recall.vector_topk(ev.select(F.col("event_id").alias("query_id"), "v"), ev, 4, 0.6, 40, stats).collect()
    unit = v / np.linalg.norm(v, axis=1)[:, None]
    sim = np.round(unit @ unit.T, 12)
    want = {(i, int(j)) for i in range(900) for j in sorted(np.flatnonzero(sim[i] >= 0.6), key=lambda j: (-sim[i, j], -(j % 5), j))[:4]}
    assert {(r["query_id"], r["event_id"]) for r in got if r["query_id"] < 5000} == want
    assert {(r["query_id"], r["event_id"]) for r in got if r["query_id"] >= 5000} == {(a, b) for a in (5002, 5003) for b in (5002, 5003)}
    assert made.value <= looked.value < 0.5 * 900 * 900


def test_rule_recall_bounds_skip_pairs_and_stay_exact(spark):
    """Every item's best events as without any bound; few pairs are scored in full."""
    import random

    rng = random.Random(8)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 6))) for _ in range(90)] + ["the", "更新中", "地震"]
    text = lambda n: " ".join(rng.choices(words, k=n))
    items = [(f"i{k}", text(rng.randint(0, 6)), rng.choice([None, "", text(12)])) for k in range(25)]
    rows = []
    for k in range(400):
        lists = [[text(2)] if rng.random() < 0.3 else [] for _ in range(4)]
        rows.append((f"e{k}", text(rng.randint(0, 4)), text(rng.choice([0, 8, 60])), *lists, rng.choice(["Active", "Stale"]), datetime(2026, 5, rng.randint(1, 5), rng.randrange(8))))
    ev = spark.createDataFrame(rows, "event_id string, canonical_title string, summary string, entities array<string>, representative_titles array<string>, key_terms array<string>, aliases array<string>, status string, last_seen_at timestamp")
    it = spark.createDataFrame(items, "item_id string, title string, summary string")
    scored, looked = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)

    def stats(pairs, full):
        looked.add(pairs)
        scored.add(full)

    got = recall.rule_recall(it, ev, at(), Config(candidate_limit=3), stats=stats).select("item_id", "event_id", "score", "features").collect()
    src, cand = F.concat_ws(" ", F.trim("title"), F.trim("summary")), F.concat_ws(" ", "canonical_title", "e_summary", F.concat_ws(" ", "entities"), F.concat_ws(" ", "representative_titles"), F.concat_ws(" ", "key_terms"), F.concat_ws(" ", "aliases"))
    every = it.crossJoin(ev.withColumnRenamed("summary", "e_summary"))
    tok, gram = X.jaccard(X.tokenize(src), X.tokenize(cand)), X.jaccard(X.char_ngrams(src), X.char_ngrams(cand))
    rep = F.coalesce(F.array_max(F.transform("representative_titles", lambda t: X.jaccard(X.char_ngrams(src), X.char_ngrams(t)))), F.lit(0.0))
    hit = F.size(F.filter("key_terms", lambda k: F.array_contains(X.tokenize(src), F.lower(F.trim(k)))))
    every = every.select("item_id", "event_id", "last_seen_at", tok.alias("tok"), gram.alias("gram"), rep.alias("rep"), F.when(F.size("key_terms") > 0, hit / F.size("key_terms")).otherwise(0.0).alias("key"), S.recency("status", "last_seen_at", at()).alias("rec"))
    every = every.withColumn("score", S.recall_score("tok", "gram", "rep", "key", "rec")).withColumn("features", S.recall_features("tok", "gram", "rep", "key", "rec")).where("score > 0.08")
    want = recall.top_per("item_id", every, 3, F.desc("score"), F.desc("last_seen_at"), F.asc("event_id")).select("item_id", "event_id", "score", "features").collect()
    assert sorted(map(str, got)) == sorted(map(str, want)) and len(got) > 60
    assert looked.value == 25 * 400 and scored.value < 0.5 * looked.value


def _commit_one_by_one(place, related):
    """Founder and score of each item, in the order of places; ``related(i, j)`` is the score of i with j's event or None."""
    out, founders = {}, []
    for i in sorted(place, key=place.get):
        best = min(((-s, place[j], j) for j in founders if (s := related(i, j)) is not None), default=None)
        out[i] = (i, 1.0) if best is None else (best[2], -best[0])
        if best is None:
            founders.append(i)
    return out


def test_settle_takes_few_rounds_for_items_that_are_all_related(spark, tmp_path):
    from skein.operators.lineage import cut_in

    order = spark.createDataFrame([(i, i) for i in range(12)], "item_id long, place long")
    pairs = spark.createDataFrame([(i, j, 0.9 - 0.01 * j) for i in range(12) for j in range(12) if i != j], "item_id long, other long, score double")
    got = recall.settle(order, pairs, cut_in(spark, "test"), 4).collect()
    assert {(r["item_id"], r["founder"]) for r in got} == {(i, 0) for i in range(12)} and len(got) == 12


@pytest.mark.parametrize("seed", range(4))
def test_alike_items_settle_as_one_by_one(spark, seed):
    """Kinds that match themselves and kinds that don't, against a plain loop over all items."""
    import random

    from skein.operators.lineage import cut_in

    rng = random.Random(seed)
    kinds, n = 9, 60
    rel = {(a, b): round(rng.choice([0.6, 0.7, 0.8]), 4) for a in range(kinds) for b in range(kinds) if rng.random() < (0.6 if a == b else 0.25)}
    kind, place = [rng.randrange(kinds) for _ in range(n)], dict(enumerate(rng.sample(range(1000), n)))
    want = _commit_one_by_one(place, lambda i, j: rel.get((kind[i], kind[j])))
    first = {k: min((i for i in range(n) if kind[i] == k), key=place.get) for k in set(kind)}
    members = spark.createDataFrame([(i, place[i], first[kind[i]]) for i in range(n)], "item_id long, place long, first long")
    pairs = spark.createDataFrame([(first[a], first[b], s) for (a, b), s in rel.items() if a in first and b in first], "item_id long, other long, score double")
    got = {r["item_id"]: (r["founder"], r["score"]) for r in recall.settle_alike(members, pairs, cut_in(spark, "test")).collect()}
    assert got == want


def test_ngram_counts_equal_the_sets_and_make_no_strings(spark):
    from skein.plans import queries as Q

    texts = [None, "", "!", "a", "ab", "aab aab", "地震 地震！", "𝒳𝒴𝒳𝒴 é", "abc" * 50, "x" * 1000, "Σίσυφος 123 Σίσυφος"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    want = {r["doc_id"]: r["n"] for r in df.select("doc_id", F.size(X.char_ngrams("text")).alias("n")).collect()}
    got = X.with_ngram_count(df.select("doc_id", X.letters_and_digits("text").alias("normal")), "normal", "n")
    assert {r["doc_id"]: r["n"] for r in got.collect()} == want and got.columns == ["doc_id", "normal", "n"]
    if os.path.isdir("/root/testdata/sf0.001"):
        plan = Q.QUERIES["q_i3_ngrams"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "array_distinct" not in plan and plan.count("regexp_replace") == 1


@pytest.mark.parametrize("copies", [1, 400])
def test_vector_search_sends_vectors_a_fixed_number_of_times_and_keeps_k_of_equals(spark, copies):
    """Copies of vectors, so that most neighbours are equal: the order of equals holds, and tasks give k rows a query."""
    import numpy as np

    rng = np.random.default_rng(5)
    base = rng.normal(size=(1200 // copies, 4))
    v = np.tile(base, (copies, 1))
    ev = spark.createDataFrame([(i, [float(x) for x in w], i % 3) for i, w in enumerate(v)], "event_id long, v array<double>, last_seen_at long")
    df = recall.vector_topk(ev.select(F.col("event_id").alias("query_id"), "v"), ev, 3, 0.2, 50)
    unit = v / np.linalg.norm(v, axis=1)[:, None]
    sim = np.round(unit @ unit.T, 12)
    want = {(i, int(j)) for i in range(len(v)) for j in np.lexsort((np.arange(len(v)), -(np.arange(len(v)) % 3), -sim[i]))[:3] if sim[i, j] >= 0.2}
    assert {(r["query_id"], r["event_id"]) for r in df.collect()} == want
    nodes = str(df._jdf.queryExecution().executedPlan().toString())
    assert "Join" not in nodes.replace("BroadcastHashJoin", ""), "blocks meet in tiles, not pair by pair"


def test_tiles_hold_no_more_than_the_best_of_equals():
    import numpy as np

    best = recall.Best(4, 2, 0.5)
    rank = np.arange(3000)[::-1].copy()
    for start in (0, 1000, 2000):
        best.add(np.arange(4), np.ones((4, 1000)), start, rank)
        assert len(best.kept[0]) <= 8 and best.size <= 8
    row, sim, place = best.rows()
    assert sorted(zip(row.tolist(), place.tolist())) == [(r, p) for r in range(4) for p in (2998, 2999)] and (sim == 1).all()


def test_rule_recall_deals_the_events_of_few_items_to_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(recall, "BLOCK_BYTES", 4096)
    items = spark.createDataFrame([("i1", "quick brown fox", "jumps"), ("i2", "lazy dog", None)], "item_id string, title string, summary string")
    rows = [(f"e{k:03}", f"quick fox {k} {'pad ' * 30}", datetime(2026, 5, 1)) for k in range(300)]
    none = F.array().cast("array<string>")
    ev = spark.createDataFrame(rows, "event_id string, summary string, last_seen_at timestamp").select("*", F.lit("").alias("canonical_title"), F.lit("Active").alias("status"), *[none.alias(c) for c in ("entities", "representative_titles", "key_terms", "aliases")])
    parts = spark.sparkContext.accumulator(0)
    pairs = recall.rule_pairs(items, ev, at(), 0, 0.0)

    def count(rows):
        if any(True for _ in rows):
            parts.add(1)

    pairs.foreachPartition(count)
    assert pairs.select("event_id").distinct().count() == 300 and parts.value > 4


def test_vector_search_orders_equals_of_string_ids_and_missing_times(spark):
    seen = {"b": datetime(2026, 5, 2), "a": datetime(2026, 5, 2), "é": datetime(2026, 5, 3), "z": None, "𝒳": None, "c": datetime(2026, 5, 1)}
    ev = spark.createDataFrame([(i, [1.0, 2.0], t) for i, t in seen.items()], "event_id string, v array<double>, last_seen_at timestamp")
    for k in range(1, 7):
        got = recall.vector_topk(ev.where("event_id = 'a'").select(F.col("event_id").alias("query_id"), "v"), ev, k, 0.5, 2).collect()
        assert {r["event_id"] for r in got} == set(["é", "a", "b", "c", "z", "𝒳"][:k])
    none = ev.where("false")
    assert recall.vector_topk(none.select(F.col("event_id").alias("query_id"), "v"), ev, 2, 0.5).count() == 0
    assert recall.vector_topk(ev.select(F.col("event_id").alias("query_id"), "v"), none, 2, 0.5).count() == 0
