"""Every registered query against its SQL twin on the smallest tables."""

from __future__ import annotations

import pytest
from compare import check, open_tables

from reviewatlas.plans import registry

SF_DIR = "/root/testdata/sf0.001"
TABLE = registry.load()
# too few rows at this size for the condition to hold anywhere
MAY_BE_EMPTY = {"unscraped_parents", "search_evidence_product"}


@pytest.fixture(scope="module")
def con():
    return open_tables(SF_DIR)


@pytest.mark.parametrize("name", sorted(TABLE))
def test_query(spark, con, name):
    problem = check(spark, con, (registry.runner(name), TABLE[name].oracle), SF_DIR)
    if name in MAY_BE_EMPTY and problem == "both sides empty":
        return
    assert problem is None, problem


def test_every_query_has_a_check():
    assert [n for n, q in TABLE.items() if q.oracle is None] == []
