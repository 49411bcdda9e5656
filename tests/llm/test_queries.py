"""The text queries that SQL can express, against DuckDB; and that the others give one row per document."""

from pathlib import Path

import pandas as pd
import pytest

from stakewise.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for path in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, duck, name):
    got, want = QUERIES[name](spark, SF).toPandas(), duck.execute(ORACLE_SQL[name]).df()
    columns = sorted(want.columns)
    got, want = (x[columns].sort_values(columns, ignore_index=True) for x in (got, want))
    pd.testing.assert_frame_equal(got, want, check_dtype=False)


@pytest.mark.parametrize("name", ["op1_quality", "op5_sharding", "op6_pseudonyms", "op8_scoring", "op10_lines", "op13_toxicity"])
def test_one_row_per_document(spark, duck, name):
    ids = sorted(r.doc_id for r in QUERIES[name](spark, SF).select("doc_id").collect())
    assert ids == [x for (x,) in duck.execute("SELECT doc_id FROM documents ORDER BY 1").fetchall()]
