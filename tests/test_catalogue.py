from __future__ import annotations

import pytest

from marginalia.plans.catalogue import ORACLES, QUERIES
from tests.parity import difference

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_agrees_with_sql(spark, name):
    assert difference(spark, name, QUERIES[name], ORACLES[name], SF) == ""


def test_entry_has_rows(spark):
    import __spark_entry__ as registry

    assert registry.entry(spark).count() > 0 and set(registry.oracle_sql()) <= set(registry.queries())
