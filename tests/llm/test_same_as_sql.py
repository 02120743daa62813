"""Numbered queries against their SQL on the smallest folder."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
from helpers import assert_same, tables  # noqa: E402

from talentgrid.llm import catalog  # noqa: E402

ORACLES = catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, sf, name):
    assert assert_same(catalog.queries()[name](spark, sf), tables(sf), ORACLES[name]) > 0
