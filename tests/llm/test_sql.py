"""The operators' queries against their SQL, on the smallest tables."""

import os
from collections import Counter

import duckdb
import pytest

from skein.llm.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = c.execute(SQL[name])
    cols = [x[0] for x in want.description]
    got = Counter(tuple(r[x] for x in cols) for r in QUERIES[name](spark, SF).collect())
    assert got == Counter(want.fetchall())
