"""Every query against its SQL in DuckDB on the smallest tables, also in the types that come out."""

from pathlib import Path

import pandas as pd
import pytest

import __spark_entry__ as entry
from stakewise import plans

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for path in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_query_equals_its_sql(spark, duck, name):
    got, want = plans.QUERIES[name](spark, SF).toPandas(), duck.execute(plans.SQL[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    got, want = (x[columns].sort_values(columns, ignore_index=True) for x in (got, want))
    kinds = {c: (got[c].dtype.kind, want[c].dtype.kind) for c in columns if len(want) and not want[c].isna().all()}
    assert all(a == b for a, b in kinds.values()), kinds
    pd.testing.assert_frame_equal(got, want, check_dtype=False, atol=2e-6)


def test_entry_and_registry(spark):
    assert entry.entry(spark).count() > 0
    assert set(plans.SQL) <= set(plans.QUERIES) and set(plans.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_state_values_have_rows(spark):
    assert plans.QUERIES["m2_bellman_values"](spark, SF).filter("marginal_1 >= 0 AND arrival_k2 >= arrival_k1 - 1e-9").count() > 10
