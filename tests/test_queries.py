"""Every registered query against its oracle SQL on the small tables."""

from pathlib import Path

import pandas as pd
import pytest

from tramline.plans import catalogue

duckdb = pytest.importorskip("duckdb")
SF = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="needs the test tables")


def shown(value) -> str:
    if value is None or value is pd.NaT or value is pd.NA or value != value:
        return "null"
    if isinstance(value, float) or "float" in type(value).__name__:
        return str(int(value)) if value == int(value) else f"{value:.12g}"
    return str(value).replace(" 00:00:00", "")


def table(df: pd.DataFrame) -> list[tuple[str, ...]]:
    cols = sorted(df.columns)
    return sorted(tuple(map(shown, r)) for r in df[cols].astype(object).itertuples(index=False))


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, db, name):
    got = catalogue.queries()[name](spark, SF).toPandas()
    sql = catalogue.oracle_sql().get(name)
    if sql is None:
        assert len(got.columns)
        return
    want = db.sql(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert table(got) == table(want)
