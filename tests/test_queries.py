"""Every registered query of the library's own operators against its SQL, and plans without pitfalls."""

import os

import pytest

from rastermill.plans import queries as own

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def _plain(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, list):
        return [_plain(x) for x in v]
    return v


@pytest.fixture(scope="module")
def con():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for t in os.listdir(SF):
        c.execute(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{t}'")
    return c


@pytest.mark.parametrize("name", sorted(own.oracle_sql()))
def test_matches_sql(spark, con, name):
    got = own.queries()[name](spark, SF)
    cur = con.execute(own.oracle_sql()[name])
    names = [c[0] for c in cur.description]
    columns = sorted(names)
    assert sorted(got.columns) == columns
    want = [dict(zip(names, r, strict=True)) for r in cur.fetchall()]
    assert sorted(repr([_plain(r[c]) for c in columns]) for r in got.collect()) == sorted(repr([_plain(r[c]) for c in columns]) for r in want)


@pytest.mark.parametrize("name", ["plan_batch", "dedupe_content", "merge_status", "tile_neighbours", "regions_to_pixels", "own_overlap", "cache_lookup"])
def test_plans_have_no_nested_loops(spark, name):
    plan = own.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan and "Python" not in plan


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 1
