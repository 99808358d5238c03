"""Every registered query against its SQL form on the smallest tables."""

import math
import os
from collections import Counter

import duckdb
import pytest

from kbspark.plans import registry

ROOT = os.environ.get("KBSPARK_TEST_DIR", "/root/testdata/sf0.001")
TABLES = "documents embeddings pages benchmark labels conversations events".split()
CHECKS = registry.all_checks()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{ROOT}/{t}.parquet'")
    return con


def _cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    return v


@pytest.mark.parametrize("name", sorted(registry.all_queries()))
def test_query(name, spark, duck):
    df = registry.all_queries()[name](spark, ROOT)
    cols = sorted(df.columns)
    got = Counter(repr([_cell(r[c]) for c in cols]) for r in df.collect())
    if name not in CHECKS:
        assert got
        return
    rel = duck.execute(CHECKS[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    want = Counter(repr([_cell(r[i]) for i in at]) for r in rel.fetchall())
    assert got == want
