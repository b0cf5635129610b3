"""Every query of the engine beside its SQL twin on the smallest tables."""

import pytest

from mapstats.plans.catalog import ORACLES, QUERIES

from .compare import differences

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    if name in ORACLES:
        assert differences(spark, QUERIES[name], ORACLES[name], SF) is None
    else:
        assert QUERIES[name](spark, SF).count() > 0


def test_entry():
    import __spark_entry__ as entry

    assert set(ORACLES) <= set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
