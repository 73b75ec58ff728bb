"""The number of blamed risks is counted without finding whom to blame."""

import __spark_entry__ as entry
from auditloom.operators import risks as R
from tests.oracle import compare

SF = "/root/testdata/sf0.001"


def test_compliance_blames_nobody(spark, monkeypatch):
    monkeypatch.setattr(R, "blame", lambda *a: 1 / 0)
    _, diff = compare(entry.queries()["compliance_scores"](spark, SF), entry.oracle_sql()["compliance_scores"], SF)
    assert not diff
