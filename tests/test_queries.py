"""Every query of the library against its SQL, at the smallest size; the rest must give rows."""

import pytest

from auditloom import registry
from tests.oracle import compare

SF = "/root/testdata/sf0.001"
#: Their inputs have no case of it at this size.
MAY_BE_EMPTY = {"compound_injection_leak"}


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_against_sql(spark, name):
    _, diff = compare(registry.queries()[name](spark, SF), registry.oracle_sql()[name], SF)
    assert not diff


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_without_sql(spark, name):
    assert registry.queries()[name](spark, SF).count() > 0


def test_entry_has_a_stable_schema(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).schema == entry.entry(spark).schema
    assert set(entry.oracle_sql()) <= set(entry.queries())
