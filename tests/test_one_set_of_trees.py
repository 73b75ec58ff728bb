"""Commitment and reveal number the entries once and build one set of trees."""

from auditloom import registry
from auditloom.functions import ordered
from auditloom.operators import commitments as C
from tests.oracle import compare


def test_commit_reveal_writes_one_numbering_and_one_tree(spark, monkeypatch):
    seen = []
    for m in (ordered, C):
        monkeypatch.setattr(m, "written", lambda df, label, plain=m.written: (seen.append(label), plain(df, label))[1])
    n, diff = compare(registry.queries()["commit_reveal"](spark, "/root/testdata/sf0.001"), registry.oracle_sql()["commit_reveal"], "/root/testdata/sf0.001")
    assert n and not diff and seen.count("numbered") == seen.count("merkle-0") == 1, (seen, diff)
