"""Every query with SQL gives the rows that DuckDB finds for it."""

import numbers

import duckdb
import pandas as pd
import pytest

from condensa.plans.oracle import ORACLE
from condensa.plans.queries import QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(df: pd.DataFrame) -> list[tuple]:
    def value(v):
        if v is None or (pd.api.types.is_scalar(v) and pd.isna(v)):
            return None
        return round(float(v), 6) if isinstance(v, numbers.Number) and not isinstance(v, bool) else str(v)

    rows = [tuple(value(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False)]
    return sorted(rows, key=str)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_rows(spark, duck, sf_dir, name):
    got, want = QUERIES[name](spark, sf_dir).toPandas(), duck.execute(ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)


def test_entry_runs(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
