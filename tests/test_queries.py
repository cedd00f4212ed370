"""Every query with SQL equals DuckDB's result on the smallest tables."""

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from tandemlake.plans import registry

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "embeddings"):
        con.sql(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return con


def plain(df: pd.DataFrame) -> list[tuple]:
    def text(v):
        return "" if v is None or v != v else f"{float(v):.6g}" if isinstance(v, float) else str(v)

    columns = sorted(df.columns)
    rows = df[columns].astype(object).where(df[columns].notna(), None)
    return sorted(tuple(text(float(v) if isinstance(v, (float, int)) and not isinstance(v, bool) else v) for v in r) for r in rows.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    got = registry.QUERIES[name](spark, FOLDER).toPandas()
    if name in registry.ORACLE_SQL:
        want = duck.sql(registry.ORACLE_SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert plain(got) == plain(want)


def test_entry(spark):
    assert entry.entry(spark).count() == 7
    assert set(entry.oracle_sql()) <= set(entry.queries())
