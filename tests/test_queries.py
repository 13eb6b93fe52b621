"""Registered queries against their SQL, on the smallest tables."""

import math
import os

import duckdb
import pytest

from tickforge.operators import data, relational, timeseries  # noqa: F401
from tickforge.operators.registry import ORACLE_SQL, QUERIES, TABLES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def same(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return (math.isnan(a) and math.isnan(b)) or math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)
    return a == b


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    found = sorted((tuple(r) for r in got.select(*columns).collect()), key=str)
    if name not in ORACLE_SQL:
        assert found
        return
    wanted = duck.sql(ORACLE_SQL[name])
    assert sorted(wanted.columns) == columns
    wanted = sorted(duck.sql(f"SELECT {', '.join(columns)} FROM ({ORACLE_SQL[name]})").fetchall(), key=str)
    assert len(found) == len(wanted)
    assert all(same(x, y) for a, b in zip(found, wanted) for x, y in zip(a, b)), next((a, b) for a, b in zip(found, wanted) if not all(map(same, a, b)))


@pytest.mark.parametrize("name", ["topk", "bottom"])
def test_selectors_with_ties(spark, tmp_path, name):
    """Equal values over several files, the larger ids in the files read first."""
    rows = [(i, float(i % 3)) for i in reversed(range(600))] + [(600, None)]
    spark.createDataFrame(rows, "event_id long, value double").repartition(5, "event_id").write.parquet(f"{tmp_path}/events.parquet")
    wanted = duckdb.sql(ORACLE_SQL[name].replace("events", f"'{tmp_path}/events.parquet/*.parquet'")).fetchall()
    assert [tuple(r) for r in QUERIES[name](spark, str(tmp_path)).collect()] == wanted
