"""Every registered core query with SQL against DuckDB on the smallest tables; skipped where they are missing."""

import importlib
import os

import pytest
from parity import compare, views

FOLDER = "/root/testdata/sf0.001"
MODULES = ["data_quality", "scalars", "relational", "spatial", "survey", "publish", "composed"]
ALL = [(m, q) for m in MODULES for q in importlib.import_module(f"grovekit.plans.{m}").QUERIES]


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
@pytest.mark.parametrize("module,query", ALL)
def test_query(spark, module, query):
    m = importlib.import_module(f"grovekit.plans.{module}")
    if query not in m.SQL:
        pytest.skip("see test_query_without_sql")
    _, _, why = compare(spark, views(FOLDER), query, m.QUERIES[query], m.SQL[query], FOLDER)
    assert not why, why


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
@pytest.mark.parametrize("module,query", [(m, q) for m, q in ALL if q not in importlib.import_module(f"grovekit.plans.{m}").SQL])
def test_query_without_sql(spark, module, query):
    """Rows come out and no row comes twice, beside the brute-force tests of the operators."""
    got = importlib.import_module(f"grovekit.plans.{module}").QUERIES[query](spark, FOLDER).toPandas()
    assert len(got) > 0 and len(got.columns) == len(set(got.columns))
    assert not got.astype(str).duplicated().any()


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_near_numbers_of_every_customer(spark):
    from grovekit.functions import ids
    from grovekit.plans import scalars

    n = scalars._numbers(spark, FOLDER).selectExpr("k", "concat('T', payload, '7') n")
    invalid = {r["k"] for r in n.where(~ids.valid_number(n["n"])).collect()}
    assert {r["k"] for r in scalars.near_number_candidates(spark, FOLDER).collect()} == invalid and any(k % 10 for k in invalid)


def test_contract():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) > 150
