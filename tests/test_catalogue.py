"""Every query of the engine against its SQL twin."""

from __future__ import annotations

import math
import numbers

import pytest

from quillon.plans.catalogue import ORACLES, QUERIES


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, numbers.Number):
        return round(float(value), 6)
    return str(value)


def rows(columns, records):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted((tuple(plain(r[i]) for i in order) for r in records), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, duck, name):
    found = QUERIES[name](spark, sf)
    got = found.collect()
    if name not in ORACLES:
        assert got
        return
    want = duck.execute(ORACLES[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(found.columns)
    assert rows(found.columns, got) == rows(columns, want.fetchall())
