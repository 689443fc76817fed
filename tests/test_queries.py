"""Every registered scene query against its DuckDB SQL, on the smallest tables."""

import math
import os
from pathlib import Path

import duckdb
import pytest
from tessera.plans import registry, surveys  # noqa: F401

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_matches_sql(spark, con, name):
    df = registry.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    key = lambda r: tuple((x is None, x) for x in r)
    got = sorted((tuple(r) for r in df.select(*cols).collect()), key=key)
    want = sorted(con.execute(f"SELECT {', '.join(chr(34) + c + chr(34) for c in cols)} FROM ({registry.SQL[name]})").fetchall(), key=key)
    assert len(got) == len(want) > 0
    for a, b in zip(got, want, strict=True):
        assert all(x == y or isinstance(x, float) and math.isclose(x, y, abs_tol=2e-6) for x, y in zip(a, b, strict=True)), (a, b)
