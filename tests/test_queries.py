"""Every query with SQL gives the rows that the SQL gives on DuckDB."""

import math
from pathlib import Path

import duckdb
import pytest

from corvane.plans import registry


def rows(frame):
    columns = sorted(frame.columns)
    show = lambda v: "null" if v is None or v != v else f"{v:.6f}" if isinstance(v, float) or hasattr(v, "dtype") and v.dtype.kind == "f" and math.isfinite(v) else str(v)
    return columns, sorted(tuple(show(v) for v in r) for r in frame[columns].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, sf, name):
    got = registry.queries()[name](spark, sf).toPandas()
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert len(got) >= 1
        return
    con = duckdb.connect()
    for p in Path(sf).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    assert rows(got) == rows(con.sql(sql).df())
