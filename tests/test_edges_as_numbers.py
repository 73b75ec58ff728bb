"""The steps that run on numbers give what they gave on strings."""

from pyspark.sql import functions as F

from auditloom.operators import graph as G
from auditloom.operators import risks as R
from auditloom.sources.interaction import as_edges, edges, items, last_edges, pair_edges
from tests.oracle import rows

SF = "/root/testdata/sf0.001"


def _same(a, b) -> bool:
    return rows(a.columns, a.collect()) == rows(a.columns, b.select(a.columns).collect())


def test_last_edges_are_pair_edges(spark):
    read = items(spark, SF).where("l_orderkey % 5 = 0")
    once = {(r.l_orderkey, r.l_linenumber, r.l_partkey, r.l_suppkey): r for r in read.collect()}  # of one id and time SQL takes any
    some = spark.createDataFrame(list(once.values()), read.schema)
    later = some.withColumns({"l_linenumber": F.col("l_linenumber") + 10, "l_shipdate": F.when(F.col("l_orderkey") % 2 == 0, F.col("l_shipdate"))})  # ties in time, and none
    twice = some.union(later.select(some.columns)).union(some.withColumns({"l_linenumber": F.col("l_linenumber") + 20, "l_returnflag": F.lit(None).cast("string")}))
    assert _same(pair_edges(as_edges(twice)), last_edges(twice))


def test_pairs_are_chosen_in_one_exchange(spark):
    plan = last_edges(spark.createDataFrame(items(spark, SF).limit(50).collect(), items(spark, SF).schema))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and "SortAggregate" not in plan


def test_components_when_two_names_have_one_number(spark, monkeypatch):
    pairs = edges(spark, SF).where("edge_id like '%7'").select("from_agent", "to_agent")
    want = G.components(pairs)
    monkeypatch.setattr(G, "_number", lambda name: F.length(name).cast("bigint"))
    assert _same(want, G.components(pairs))
    monkeypatch.setattr(G, "FEW", 0)  # in rounds
    assert _same(want, G.components(pairs))
    monkeypatch.undo()
    monkeypatch.setattr(G, "FEW", 0)
    assert _same(want, G.components(pairs))


def test_hops_follow_the_list(spark):
    risks = spark.createDataFrame([("a", ["x", "y", "z"]), ("b", ["x", "z", "y"]), ("c", ["x"]), ("d", [])], "risk_id string, agents array<string>")
    pairs = spark.createDataFrame([("x", "y", "1", 4, True, ["health"]), ("y", "z", "2", 1, True, ["health"]), ("z", "x", "3", 1, False, ["social"])], "from_agent string, to_agent string, edge_id string, sens int, violation boolean, domains array<string>")
    got = {r["risk_id"]: (r["blame_agent"], r["blame_hop"], r["reason"]) for r in R.blame(risks, pairs).collect()}
    assert got == {"a": ("y", 1, "violation"), "b": ("x", 0, "source")}
