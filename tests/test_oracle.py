"""Every registered query with an oracle matches DuckDB on the smallest
tables (row count, column names, order-insensitive values)."""
import math

import pytest

import __spark_entry__ as E
from conftest import SF_SMALL


def _norm(v):
    if v is None:
        return "None"
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{round(v, 6):.6f}"
    return str(v)


def _rows(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted("|".join(_norm(r[i]) for i in order) for r in rows)


SQL = E.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_oracle(spark, duck, name):
    sdf = E.queries()[name](spark, SF_SMALL)
    got = _rows([tuple(r) for r in sdf.collect()], sdf.columns)
    res = duck.execute(SQL[name])
    cols = [d[0] for d in res.description]
    want = _rows(res.fetchall(), cols)
    assert sorted(sdf.columns) == sorted(cols)
    assert got == want


def test_every_oracle_has_a_query():
    assert set(SQL) <= set(E.queries())


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert df.columns[0] == "column_name"
