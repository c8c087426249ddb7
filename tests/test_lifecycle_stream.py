"""The streamed lifecycle gives the transitions of the batch rule, however sightings fall into batches."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from skein.streaming.lifecycle import lifecycle_stream, transitions

SCHEMA = "event_id string, seen_at timestamp, kind string"
BEGIN = datetime(2026, 5, 1)


def brute(rows, hours, until):
    out, silence = set(), timedelta(hours=hours)
    for e in {r[0] for r in rows}:
        times = sorted((t, k == "merged") for x, t, k in rows if x == e)
        last = None
        for t, gone in times:
            if last is not None and t - last > silence:
                out.add((e, "Stale", last + silence, "stale"))
            if gone:
                out.add((e, "Merged", t, "merged"))
                last = None
                break
            if last is None or t - last > silence:
                out.add((e, "Active", t, "first" if last is None else "reactivated"))
            last = t
        if last is not None and last + silence < until:
            out.add((e, "Stale", last + silence, "stale"))
    return out


@pytest.mark.parametrize("batches", [1, 4])
def test_stream_and_batch_rule_agree(spark, tmp_path, batches):
    rng = random.Random(6)
    rows = [(f"e{i}", BEGIN + timedelta(hours=rng.randrange(400)), "seen") for i in range(12) for _ in range(rng.randint(1, 14))]
    rows += [(f"e{i}", BEGIN + timedelta(hours=rng.randrange(100, 300), minutes=30), "merged") for i in range(4)]
    until = BEGIN + timedelta(hours=1000)
    want = brute(rows, 24, until)
    df = spark.createDataFrame(rows, SCHEMA)
    got = {tuple(r) for r in transitions(df, 24, F.lit(until)).collect()}
    assert got == want and {r[3] for r in want} == {"first", "stale", "reactivated", "merged"}

    rows.sort(key=lambda r: r[1])
    src = tmp_path / "in"
    size = -(-len(rows) // batches)
    for n in range(batches):
        spark.createDataFrame(rows[n * size : (n + 1) * size], SCHEMA).coalesce(1).write.parquet(str(tmp_path / f"b{n}"))
    # A sighting of another event moves the watermark past the end; one more batch lets the timers fire.
    for n, t in ((batches, until + timedelta(hours=2)), (batches + 1, until + timedelta(hours=3))):
        spark.createDataFrame([("tick", t, "seen")], SCHEMA).coalesce(1).write.parquet(str(tmp_path / f"b{n}"))
    src.mkdir()
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for n in range(batches + 2):  # a start for each batch: state and timers outlive the query
            for p in (tmp_path / f"b{n}").glob("*.parquet"):
                (src / f"{n}-{p.name}").write_bytes(p.read_bytes())
            stream = spark.readStream.schema(SCHEMA).parquet(str(src))
            q = lifecycle_stream(stream, 24).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
            q.awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    streamed = [tuple(r) for r in spark.read.schema("event_id string, status string, at timestamp, reason string").parquet(str(tmp_path / "out")).where("event_id <> 'tick'").collect()]
    assert set(streamed) == want and len(streamed) == len(want)
