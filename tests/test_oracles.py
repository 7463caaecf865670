"""Every query with SQL gives what DuckDB gives."""

import pytest

from glossalake import plans


def _value(v):
    if isinstance(v, float):
        return round(v, 9)
    if type(v).__name__ == "Decimal":
        return float(v)
    return tuple(v) if isinstance(v, list) else v


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_oracle(spark, duck, data, name):
    df = plans.QUERIES[name](spark, data)
    want = duck.sql(plans.ORACLES[name])
    assert sorted(df.columns) == sorted(want.columns)
    order = sorted(df.columns)
    got = sorted(str(tuple(_value(r[c]) for c in order)) for r in df.collect())
    at = [want.columns.index(c) for c in order]
    assert got == sorted(str(tuple(_value(r[k]) for k in at)) for r in want.fetchall())
