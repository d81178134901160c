"""Every core query with SQL, against DuckDB on the smallest tables."""

import glob
import os

import pytest

duckdb = pytest.importorskip("duckdb")
from vecloom.plans.queries import QUERIES, SQL  # noqa: E402

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def _rows(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(f"{r[i]:.5g}" if isinstance(r[i], float) else str(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    want = duck.sql(SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert _rows(df.collect(), df.columns) == _rows(want.fetchall(), want.columns)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_without_sql(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0


def test_whole_query_set(spark):
    """Every id divisible by 100 is a query, against all rows but itself; decoding has all rows."""
    ids = {r["vec_id"] for r in spark.read.parquet(f"{DATA}/embeddings.parquet").select("vec_id").collect()}
    pairs = {(q, v) for q in ids if q % 100 == 0 for v in ids if q != v}
    for name in ("sym_m_to_n_whole", "compare_modes_whole"):
        assert {(r["query_id"], r["vec_id"]) for r in QUERIES[name](spark, DATA).collect()} == pairs
    found = QUERIES["exact_l2_topk_whole"](spark, DATA).collect()
    assert {(r["query_id"], r["rank"]) for r in found} == {(q, k) for q in ids if q % 100 == 0 for k in range(1, 11)}
    assert {r["vec_id"] for r in QUERIES["decode_values_whole"](spark, DATA).select("vec_id").distinct().collect()} == ids


@pytest.mark.parametrize("name", ["rmse_by_mode_whole", "compare_modes_whole"])
def test_estimates_side_by_side_without_a_shuffle_of_pairs(spark, name):
    plan = QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "hashpartitioning(query_id" not in plan
