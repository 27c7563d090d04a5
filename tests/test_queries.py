"""Every SQL-expressible query against its SQL in DuckDB, over the smallest tables; the others must run."""

import glob
import os

import duckdb
import pytest

from tempora.plans.queries import QUERIES, SQL


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def _rows(columns, rows):
    cell = lambda v: "" if v is None or v != v else round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return sorted((tuple(cell(r[c]) for c in columns) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    got = [r.asDict() for r in df.collect()]
    if name not in SQL:
        assert got
        return
    rel = duck.sql(SQL[name])
    want = [dict(zip(rel.columns, r, strict=True)) for r in rel.fetchall()]
    columns = sorted(rel.columns)
    assert columns == sorted(df.columns)
    assert _rows(columns, got) == _rows(columns, want)


def test_no_nested_loops(spark, sf_dir):
    for name in ("align_segments", "evidence_frames", "assign_reps", "overlap_semi", "force_include"):
        plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan, name
