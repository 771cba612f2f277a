"""Every query with SQL against DuckDB on the smallest tables, and that all others run."""

import math
from pathlib import Path

import duckdb
import pytest

from braidwork.plans import more  # noqa: F401  registers its queries
from braidwork.plans.queries import ORACLE, QUERIES

SF = Path("/root/testdata/sf0.001")


def _rows(df):
    def value(x):
        if x is None or (isinstance(x, float) and math.isnan(x)):
            return None
        return round(float(x), 5) + 0.0 if isinstance(x, (int, float)) or type(x).__module__ == "numpy" and not isinstance(x, str) else x

    return sorted((tuple(map(value, r)) for r in df[sorted(df.columns)].itertuples(index=False)), key=str)


@pytest.mark.skipif(not SF.exists(), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    got = QUERIES[name](spark, str(SF)).toPandas()
    if name not in ORACLE:
        assert len(got)
        return
    con = duckdb.connect()
    for t in SF.glob("*.parquet"):
        con.execute(f"create view {t.stem} as select * from '{t}'")
    want = con.execute(ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and _rows(got) == _rows(want)
