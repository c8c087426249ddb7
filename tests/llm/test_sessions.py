"""Sessions against a brute-force automaton: hot clients, chunks, runs without a cut, ties, odd rows."""

import hashlib
import math
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import types as T

from skein.llm import sessions

BEGIN, MINUTE = datetime(2024, 1, 1), 60_000_000
FIELDS = "click_id client_id ts arrived_at kind value".split()
KINDS = [T.LongType(), T.LongType(), T.TimestampNTZType(), T.TimestampNTZType(), T.StringType(), T.DoubleType()]
SCHEMA = T.StructType([T.StructField(n, k) for n, k in zip(FIELDS, KINDS, strict=True)] + [T.StructField(n, T.StringType()) for n in ("us", "chunk", "hour", "r", "mark")])


def at(us):
    return None if us is None else BEGIN + timedelta(microseconds=us)


def brute(rows, gap=10 * MINUTE, length=40 * MINUTE):
    base = int((BEGIN - datetime(1970, 1, 1)).total_seconds()) * 1_000_000
    one = {}
    for click, client, us, arrived, kind, value in rows:
        if click is None or client is None or us is None:
            continue
        ok = value is not None and math.isfinite(value)
        late = arrived is not None and arrived - us > 360 * MINUTE
        row = (late, client, us, ok and kind == "error" and value >= 60, math.floor(100 * value + 0.5) if ok else 0)
        one[click] = min(one.get(click, row), row)
    out = []
    for client in {r[1] for r in one.values()}:
        timely = sorted((r[2], c, r[3], r[4]) for c, r in one.items() if r[1] == client and not r[0])
        cur = []
        for us, c, fin, cents in timely:
            if cur and (why := "end" if cur[-1][-1][2] else "gap" if us - cur[-1][-1][0] >= gap else "length" if us - cur[-1][0][0] > length else None):
                cur[-1] = (cur[-1], why)
                cur.append([(us, c, fin, cents)])
            elif cur:
                cur[-1].append((us, c, fin, cents))
            else:
                cur.append([(us, c, fin, cents)])
        if cur:
            cur[-1] = (cur[-1], "end" if cur[-1][-1][2] else "none")
        for i, (s, why) in enumerate(cur):
            until = cur[i + 1][0][0][0] if i + 1 < len(cur) else math.inf
            n_late = sum(r[0] and r[1] == client and s[0][0] <= r[2] < until for r in one.values())
            path = hashlib.sha256(",".join(str(x[1]) for x in s).encode()).hexdigest()
            out.append((client, s[0][1], s[0][0] + base, s[-1][0] + base, len(s), n_late, sum(x[3] for x in s), why, path))
    return sorted(out)


def table(spark, tmp_path, rows, name="c"):
    full = [(c, k, at(us), at(a), kind, v, "x", "x", "x", "x", "x") for c, k, us, a, kind, v in rows]
    spark.createDataFrame(full, SCHEMA).repartition(3).write.parquet(str(tmp_path / name))
    return spark.read.parquet(str(tmp_path / name))


def made(seed, dense):
    rnd, rows, click = random.Random(seed), [], 0
    for client in range(4):
        us = rnd.randrange(10**9)
        for _ in range(rnd.choice([1, 30, 300])):
            us += rnd.choice([0, 0, MINUTE, 3 * MINUTE, 9 * MINUTE] if dense else [0, 1, MINUTE, 10 * MINUTE - 1, 10 * MINUTE, 90 * MINUTE])
            late = rnd.random() < 0.1
            rows.append((click, client, us, us + 360 * MINUTE + late if rnd.random() < 0.9 else None, rnd.choice(["error", "view", None]) if not dense or rnd.random() < 0.02 else "view", rnd.choice([None, 60.0, 59.99, -1.234, 0.005])))
            click += 1
    return rows


@pytest.mark.parametrize("dense", [False, True])
@pytest.mark.parametrize("chunk_rows", [1, 7, 20_000])
def test_sessions_equal_brute_force(spark, tmp_path, dense, chunk_rows):
    rows = made(chunk_rows, dense)
    rows += [rows[5], rows[9], (None, 1, 5, 5, "view", 1.0), (900, None, 5, 5, "view", 1.0), (901, 1, None, 5, "view", 1.0), (902, 77, 5, 6 * 10**10, "view", 1.0), (903, 78, -5, 6, "error", float("nan")), (903, 78, -5, 6 * 10**10, "error", 70.0), (904, 78, -4, 6, "error", float("inf"))]
    got = sessions.sessionize(table(spark, tmp_path, rows), chunk_rows=chunk_rows).collect()
    assert sorted(tuple(r) for r in got) == brute(rows)


@pytest.mark.parametrize("every", [30, 61, 599])
def test_a_client_without_any_reset_is_cut_into_chunks(spark, tmp_path, every):
    """Clicks in one rhythm never let sessions of different phases meet, so that each hour's entry depends on all before it."""
    rnd = random.Random(every)
    rows = [(i, 5, 37_000_000 + i * every * 1_000_000 + (rnd.randrange(900_000) if every == 61 else 0), None, "view", 1.0) for i in range(40 * 3600 // every)]
    rows += [(100_000 + i, 5, i * 17 * MINUTE, i * 17 * MINUTE + 400 * MINUTE, "view", 2.0) for i in range(170)]
    rows += [(200_000, 6, 5, 5, "error", 99.0), (200_001, 6, 5, 5, "view", 0.0)]
    got = sessions.sessionize(table(spark, tmp_path, rows), chunk_rows=20).collect()
    assert sorted(tuple(r) for r in got) == brute(rows)


def test_times_dont_depend_on_the_sessions_zone(spark, tmp_path):
    rows = made(3, False)
    df, before = table(spark, tmp_path, rows), spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        got = sessions.sessionize(df).collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert sorted(tuple(r) for r in got) == brute(rows)


def test_no_clicks(spark, tmp_path):
    assert sessions.sessionize(table(spark, tmp_path, [])).collect() == []
    assert sessions.sessionize(table(spark, tmp_path, [(1, 1, 5, 10**12, "view", 1.0)], "l")).collect() == []
    with pytest.raises(ValueError):
        sessions.sessionize(table(spark, tmp_path, [], "p"), gap_minutes=30, length_minutes=40)
