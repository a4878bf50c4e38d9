"""Every registered query with SQL against DuckDB at the smallest scale."""

import math
import os
import re
from difflib import SequenceMatcher

import duckdb
import pytest

import __spark_entry__ as entry
from vacantry.operators import match as M
from vacantry.plans import queries as Q


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for f in os.listdir(sf):
        c.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{f}'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_query(spark, sf, duck, name):
    df = Q.QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    rows = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    if name in Q.SQL:
        found = duck.sql(Q.SQL[name])
        assert sorted(found.columns) == cols
        at = [found.columns.index(c) for c in cols]
        assert rows == sorted((tuple(plain(r[k]) for k in at) for r in found.fetchall()), key=repr)


def test_fuzzy_skills_equal_brute_force(spark, sf):
    """Every pair of part type and part name, by the similarity as it is defined."""
    part = spark.read.parquet(f"{sf}/part.parquet").collect()
    words = lambda k: [w for w in dict.fromkeys(re.findall(r"[a-z0-9+#.]+", k)) if w not in M.STOP_WORDS]

    def similarity(a, b):
        ratio, x, y = SequenceMatcher(None, a, b).ratio(), words(a), words(b)
        if a == b:
            return 1.0
        if not x or not y:
            return ratio * 0.9
        both = len(set(x) & set(y))
        contained = 0.8 if both in (len(x), len(y)) else 0.55 * both / min(len(x), len(y))
        return max(both / len(set(x) | set(y)), contained, ratio * 0.85)

    want = {}
    for a in {p.p_type.lower() for p in part}:
        for b in {p.p_name.lower() for p in part}:
            if round(similarity(a, b), 4) >= 0.75:
                want[a, b] = pytest.approx(similarity(a, b), abs=1e-4)
    assert {(r.req_key, r.cand_key): r.sim for r in Q.fuzzy_skills(spark, sf).collect()} == want


def test_saved_postings_reach_all_orders(spark, sf):
    jobs = [r.job_id for r in Q.clicks(spark, sf).select("job_id").distinct().collect()]
    n = spark.read.parquet(f"{sf}/orders.parquet").count()
    assert max(jobs) > 0.95 * n and len(jobs) > 100


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_oracles_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
