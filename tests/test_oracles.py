"""Every query outside the llm subpackage runs on the smallest tables, and equals its SQL where it has one."""

import os

import duckdb
import pandas as pd
import pytest

from tessera.jobs.registry import ORACLE_SQL, QUERIES

#: Queries that try many models or plans take too long for every run of the tests; test_slow runs them if asked.
SLOW = {"m12_anneal", "m13_genetic", "m21_evolve", "m4_mds", "m14_nmf", "m15_nmf_projected", "a42_kmeans_total"}


def rows_of(df):
    columns = sorted(df.columns)
    out = []
    for r in df[columns].astype(object).itertuples(index=False, name=None):
        out.append(tuple("null" if v is None or v is pd.NA or v != v else f"{v:.4f}" if isinstance(v, float) else str(v) for v in r))
    return columns, sorted(out)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - SLOW))
def test_query(spark, sf_dir, name):
    got = QUERIES[name](spark, sf_dir).toPandas()
    if name not in ORACLE_SQL:
        assert len(got.columns)
        return
    con = duckdb.connect()
    for file in os.listdir(sf_dir):
        con.sql(f"create view {file.split('.')[0]} as select * from '{sf_dir}/{file}'")
    (c1, r1), (c2, r2) = rows_of(got), rows_of(con.sql(ORACLE_SQL[name]).df())
    assert c1 == c2 and len(r1) == len(r2)
    different = [(a, b) for a, b in zip(r1, r2) if a != b and not all(x == y or _close(x, y) for x, y in zip(a, b))]
    assert not different, different[:3]


def _close(a, b):
    try:
        return abs(float(a) - float(b)) <= 2e-4 * max(1.0, abs(float(a)))
    except ValueError:
        return False


@pytest.mark.skipif("TEST_SLOW" not in os.environ, reason="set TEST_SLOW to run")
@pytest.mark.parametrize("name", sorted(SLOW))
def test_slow(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_every_oracle_has_a_query():
    assert set(ORACLE_SQL) <= set(QUERIES)
