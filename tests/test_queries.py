"""Every registered query against its SQL, on the smallest tables."""

import os

import duckdb
import pytest

from skein.plans import queries as Q
from skein.plans import record_queries  # noqa: F401  registers its queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    if isinstance(v, float):
        return round(v, 9)
    return str(v) if v is not None and not isinstance(v, (int, bool)) else v


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_matches_sql(spark, name):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = c.execute(Q.SQL[name])
    cols = [x[0] for x in want.description]
    want = [dict(zip(cols, r)) for r in want.fetchall()]
    got = [r.asDict() for r in Q.QUERIES[name](spark, SF).collect()]
    key = lambda r: repr([norm(r[k]) for k in sorted(r)])
    assert sorted(map(key, got)) == sorted(map(key, want))
