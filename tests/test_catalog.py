from __future__ import annotations

import pytest

from quillframe.plans import catalog
from tests.oracle import compare

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_matches_sql(spark, name):
    assert not compare(spark, catalog.queries()[name], catalog.oracle_sql()[name], SF)


def test_entry_point_imports():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
