"""The registered queries against their SQL, on the smallest tables."""

import pytest
from compare import compare, duck_connection

import __spark_entry__ as E
from govlens.llm import oracle, queries

SF = "/root/testdata/sf0.001"


def test_one_query_for_each_operator():
    assert sorted(int(q.split("_")[0][2:]) for q in queries.QUERIES) == list(range(1, 14))
    assert set(queries.QUERIES) | {"pipeline"} <= set(E.queries())


@pytest.mark.parametrize("name", sorted(oracle.SQL))
def test_query_matches_sql(spark, name):
    r = compare(queries.QUERIES[name](spark, SF), duck_connection(SF), oracle.SQL[name])
    assert r["columns_match"] and r["exact_match"], {k: str(v)[:500] for k, v in r.items()}


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(oracle.SQL)))
def test_query_without_sql_runs(spark, name):
    df = queries.QUERIES[name](spark, SF)
    assert df.columns[0] in ("doc_id", "query_id") and df.count() > 0
