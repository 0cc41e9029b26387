"""Every registered query against its SQL twin in DuckDB on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from freshet.plans import REGISTRY

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


def cell(x) -> str:
    if x is None or x is pd.NA or x is pd.NaT or x != x:
        return "-"
    if isinstance(x, bool) or type(x).__name__ in ("bool", "bool_"):
        return str(bool(x))
    try:
        return repr(round(float(x), 7) + 0.0)
    except (TypeError, ValueError):
        return str(x)


def rows(df: pd.DataFrame) -> list[tuple[str, ...]]:
    return sorted(tuple(map(cell, r)) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(n for n, q in REGISTRY.items() if q.oracle))
def test_same_rows_as_sql(spark, duck, name):
    got = REGISTRY[name].run(spark, DATA).toPandas()
    want = duck.sql(REGISTRY[name].oracle).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(n for n, q in REGISTRY.items() if not q.oracle))
def test_rows_without_twin(spark, name):
    assert REGISTRY[name].run(spark, DATA).count() > 0


def test_flagship(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
