"""What a query reads or moves once."""

import __spark_entry__ as entry
from auditloom.operators import detectors as D
from auditloom.operators import memory as M
from auditloom.operators import tenants as N

SF = "/root/testdata/sf0.001"


def test_each_tag_pattern_is_tried_once(spark):
    plan = entry.queries()["lexical_tags"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RLIKE") <= len(M._TAGS)


def test_what_an_agent_receives_is_moved_once(spark):
    rows = [("1", "a", "x", ["health"]), ("2", "b", "x", ["identity", "location"]), ("3", None, "x", ["identity"]), ("4", "a", "y", ["health"])]
    e = spark.createDataFrame(rows, "edge_id string, from_agent string, to_agent string, domains array<string>")
    r = D.quasi_identifiers(e, ["health", "identity", "location"])
    assert r._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    got = {(tuple(x.agents), tuple(x.edges), x.severity) for x in r.collect()}
    assert got == {(("x", "a", "b"), ("1", "2", "3"), 0.7), (("x", "a", "b"), ("1", "2"), 0.7), (("x", "a", "b"), ("1", "2", "2", "3"), 0.95)}


def test_a_report_is_made_once(spark, monkeypatch):
    made, plain = [], N.report
    monkeypatch.setattr(N, "report", lambda *a: (made.append(a), plain(*a))[1])
    assert entry.queries()["tenant_attestations"](spark, SF).where("accepted <> (from_agent like 'cust:%')").count() == 0
    assert len(made) == 1
