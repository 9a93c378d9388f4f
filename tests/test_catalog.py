"""Every registered query against its SQL counterpart, over the whole tables."""

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as contract
from stratamem import catalog

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


@pytest.fixture(scope="module")
def con(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def canonical(df: pd.DataFrame) -> pd.DataFrame:
    def cell(v):
        if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
            return "\0"
        return repr(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    out = df[sorted(df.columns)].astype(object).map(cell)
    return out.sort_values(list(out.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, sf, con, name):
    got = catalog.queries()[name](spark, sf).toPandas()
    assert len(got) > 0
    sql = catalog.oracle_sql().get(name)
    if sql:
        pd.testing.assert_frame_equal(canonical(got), canonical(con.execute(sql).df()))


def test_entry(spark):
    assert contract.entry(spark).columns[:3] == ["query_id", "result_rank", "id"]


def test_counterparts_belong_to_queries():
    assert set(catalog.queries()) <= set(contract.queries())
    assert set(contract.oracle_sql()) <= set(contract.queries())
