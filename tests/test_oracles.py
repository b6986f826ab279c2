"""Every query with SQL, against DuckDB on the smallest tables."""

import math

import duckdb
import pytest

from lumenweave import plans

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    cell = lambda v: "null" if v is None or (isinstance(v, float) and math.isnan(v)) else f"{v:.6f}" if isinstance(v, float) else str(v)
    return [names[i] for i in order], sorted(tuple(cell(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_query_matches_sql(spark, sf_dir, duck, name):
    df = plans.queries()[name](spark, sf_dir)
    want = duck.execute(plans.oracle_sql()[name])
    names = [d[0] for d in want.description]
    ours = plain([tuple(r) for r in df.collect()], df.columns)
    assert ours == plain(want.fetchall(), names)
    assert ours[1]


def test_every_query_has_sql():
    assert set(plans.queries()) - set(plans.oracle_sql()) == {"binary_scan"}  # reads files, see test_sources.py
    assert set(plans.oracle_sql()) < set(plans.queries())
