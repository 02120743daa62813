"""Every registered career query against its SQL on the smallest folder."""

import pytest

from helpers import assert_same, tables
from talentgrid.plans import catalog

ORACLES = catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, sf, name):
    assert assert_same(catalog.queries()[name](spark, sf), tables(sf), ORACLES[name]) > 0


def test_entry_has_rows(spark, sf):
    assert catalog.entry(spark, sf).count() > 0
