"""Every query with a DuckDB equivalent against it, on the smallest test tables."""

import math
import os

import duckdb
import pytest

from stackweave import catalog
from stackweave.lens import BASE

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")


def compare(df, sql, sf_dir):
    """Equal column names and equal rows, floats to 1e-12."""
    con = duckdb.connect()
    for t in BASE:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    want = con.execute(sql)
    names = [d[0] for d in want.description]
    want = want.fetchall()
    assert sorted(df.columns) == sorted(names)
    got = [tuple(r[n] for n in sorted(names)) for r in df.collect()]
    at = [names.index(n) for n in sorted(names)]
    want = [tuple(r[i] for i in at) for r in want]
    norm = lambda v: round(float(v), 9) if isinstance(v, float) or type(v).__name__ == "Decimal" else v
    key = lambda r: tuple((v is None, str(type(v).__name__ in ("int", "float")), str(norm(v))) for v in r)
    got, want = sorted(got, key=key), sorted(want, key=key)
    assert len(got) == len(want), (len(got), len(want), got[:3], want[:3])
    for a, b in zip(got, want):
        assert all(x == y or isinstance(x, float) and isinstance(y, (float, int)) and math.isclose(x, y, rel_tol=1e-12, abs_tol=1e-12) for x, y in zip(a, b)), (a, b)
    return len(got)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_its_oracle(spark, name):
    compare(catalog.QUERIES[name](spark, SF), catalog.ORACLES[name], SF)
