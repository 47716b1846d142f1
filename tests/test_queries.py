"""Every registered query against its DuckDB SQL, on the smallest data."""

import math

import duckdb
import pandas as pd
import pytest
from logsluice.plans import registry

AT = "/root/testdata/sf0.001"
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{AT}/{t}.parquet'")
    return con


def rows(frame: pd.DataFrame) -> list[tuple]:
    def plain(x):
        if x is None or x is pd.NA or isinstance(x, float) and math.isnan(x):
            return "null"
        if isinstance(x, bool) or type(x).__name__ == "bool":
            return str(bool(x))
        try:
            return f"{float(x):.5f}"
        except (TypeError, ValueError):
            return str(x)

    frame = frame[sorted(frame.columns)]
    return sorted(tuple(map(plain, r)) for r in frame.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    found = registry.QUERIES[name](spark, AT).toPandas()
    if name not in registry.ORACLES:
        assert len(found)
        return
    expected = duck.sql(registry.ORACLES[name]).df()
    assert sorted(found.columns) == sorted(expected.columns)
    assert rows(found) == rows(expected)
