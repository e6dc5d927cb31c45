"""Every registered query of the engine runs, and equals its SQL in DuckDB."""

import os

import duckdb
import pytest

from colstrata.plans import catalog

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in os.listdir(sf):
        c.execute(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{t}'")
    return c


def _rows(df):
    df = df[sorted(df.columns)]
    return list(df.columns), [str(t) for t in df.dtypes], sorted(tuple(map(str, r)) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, sf, duck):
    got = QUERIES[name](spark, sf).toPandas()
    if name in SQL:
        assert _rows(got) == _rows(duck.execute(SQL[name]).df())
    else:
        assert len(got)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_entry_without_the_data_preparation_folder(monkeypatch):
    import sys

    import __spark_entry__ as e

    monkeypatch.setitem(sys.modules, "colstrata.llm", None)
    monkeypatch.setitem(sys.modules, "colstrata.llm.queries", None)
    assert set(e.queries()) == set(QUERIES) and set(e.oracle_sql()) == set(SQL)


def test_explain(spark, sf):
    from colstrata.plans import explain

    li = spark.read.parquet(f"{sf}/lineitem.parquet")
    o = spark.read.parquet(f"{sf}/orders.parquet")
    found = [s for s, _ in explain.steps(li.where("l_quantity > 3").join(o.hint("merge"), li.l_orderkey == o.o_orderkey).groupBy("o_orderstatus").count())]
    assert found.count("scan") == 2 and "join" in found and "shuffle" in found and "pushed" in found


def test_plan_equals_its_sql_over_many_vectors(spark, tmp_path):
    spark.range(150_000).selectExpr("id AS vec_id", "array(cast(id AS float)) AS embedding", "cast(id % 10 AS int) AS label").write.parquet(f"{tmp_path}/embeddings.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    assert _rows(QUERIES["knn_plan"](spark, str(tmp_path)).toPandas()) == _rows(c.execute(SQL["knn_plan"]).df())
