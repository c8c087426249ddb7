"""The feed data source: a partition a source, failures as rows, offsets of a stream."""

import json

import pytest

from skein.sources.feed_source import FeedSource
from skein.sources.feeds import list_items


def body(*titles):
    return json.dumps({"status": "success", "items": [{"id": t.lower(), "title": t} for t in titles]})


@pytest.fixture
def root(spark, tmp_path):
    spark.dataSource.register(FeedSource)
    for source, n, text in [("a", 1, body("One")), ("a", 2, body("Two", "Three")), ("b/c", 2, "{broken")]:
        at = tmp_path / "feeds" / source.replace("/", "%2F")
        at.mkdir(parents=True, exist_ok=True)
        (at / f"{n}.json").write_text(text)
    (tmp_path / "feeds" / "single.json").write_text(body("Alone"))
    return str(tmp_path / "feeds")


SOURCES = json.dumps([{"id": "p:a", "external_id": "a"}, {"id": "p:b", "external_id": "b/c", "content_kind": "flash_feed"}, {"id": "p:s", "external_id": "single"}, {"id": "p:none", "external_id": "none"}])


def test_a_batch_has_the_newest_body_of_each_source_and_failures_as_rows(spark, root):
    df = spark.read.format("skein_feeds").option("root", root).option("sources", SOURCES).load()
    got = {r["source_id"]: r for r in df.collect()}
    assert df.rdd.getNumPartitions() == 4
    assert [got[k]["status"] for k in ("p:a", "p:b", "p:s", "p:none")] == ["succeeded", "succeeded", "succeeded", "failed"]
    assert got["p:a"]["poll"] == 2 and got["p:none"]["body"] is None and "FileNotFoundError" in got["p:none"]["error"]
    items = list_items(df.where("status = 'succeeded'")).collect()
    assert sorted(r["title"] for r in items) == ["Alone", "Three", "Two"]


def test_a_stream_reads_each_body_once_over_restarts(spark, root, tmp_path):
    def run():
        stream = spark.readStream.format("skein_feeds").option("root", root).option("sources", SOURCES).load()
        q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()
        return sorted((r["source_id"], r["poll"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    assert run() == [("p:a", 1), ("p:a", 2), ("p:b", 2)]
    (tmp_path / "feeds" / "a" / "3.json").write_text(body("Four"))
    assert run() == [("p:a", 1), ("p:a", 2), ("p:a", 3), ("p:b", 2)]
    assert run() == [("p:a", 1), ("p:a", 2), ("p:a", 3), ("p:b", 2)]


def test_options_are_checked(spark, root):
    with pytest.raises(Exception, match="root must name"):
        spark.read.format("skein_feeds").option("sources", SOURCES).load().collect()
    with pytest.raises(ValueError, match="folder"):
        FeedSource({"root": "http://x/", "sources": "[]"}).streamReader(None)
