"""A digest slot over the store: one push, one report, a blacklisted candidate, a crash before the push."""

import json

from skein.operators import records
from skein.operators.runs import Source
from skein.plans import pipeline as P
from skein.plans.digest_run import run_digest
from skein.sources.config import Config

TITLES = ["Harbour Fire Spreads Quickly", "Casino Advert Of The Week"]


def test_a_slot_is_sent_once_with_its_report(spark, tmp_path):
    store, sent = records.Store(spark, str(tmp_path / "store")), []
    items = [{"id": f"i{k}", "title": t, "url": f"http://x/{k}"} for k, t in enumerate(TITLES)]
    cfg = Config(source_count=2, push_count=2)
    models = P.Models(fetch=lambda r: json.dumps({"status": "success", "items": items}), tag=lambda r: "fire" if "Fire" in r["title"] else "")
    P.run_fetch(spark, store, [Source("p", "c", f"s{i}", display_name=f"Source {i}") for i in range(2)], models, "2026-05-05 09:00:00", "r1", cfg)
    cfg = Config(source_count=2, push_count=2, blacklist=("casino",))

    def slot(name, push=lambda m: sent.append(m) is None):
        return run_digest(spark, store, "2026-05-05", name, "2026-05-05 09:20:00", push, str(tmp_path), cfg, "https://reports.example")

    one = slot("09:20")
    assert one["sent"] and one["events"] == 1 and slot("09:20") is None and len(sent) == 1
    assert TITLES[0] in sent[0]["content"] and TITLES[1] not in sent[0]["content"] and one["link"] in sent[0]["content"]
    page = (tmp_path / one["link"].rsplit("/", 1)[1]).read_text()
    assert TITLES[0] in page and "http://x/0" in page and TITLES[1] not in page
    report = store.read("report", records.REPORT).collect()
    assert len(report) == 1 and report[0]["event_count"] == 1 and report[0]["public_url"] == one["link"]
    assert store.read("event", P.EVENT).where("is_blacklisted").count() == 1
    # A crash after the log was written: the slot is closed and nothing is sent.
    try:
        slot("18:20", lambda m: 1 / 0)
    except ZeroDivisionError:
        pass
    again = slot("18:20")
    assert again == {"dedup_key": "digest:2026-05-05:18:20", "sent": False, "events": 1} and len(sent) == 1
    state = {r["key"]: r["value"] for r in store.read("state", records.STATE).collect()}
    assert state == {"digest:processed:2026-05-05:09:20": "success", "digest:processed:2026-05-05:18:20": "push_log_exists"}
