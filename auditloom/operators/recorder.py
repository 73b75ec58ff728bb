"""The recorder's log of handoffs and internal actions (trace, seq, kind, agent, to, action, domains, sens, local_action) and what is read from it; it has no raw text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EVENT = ["trace", "seq", "kind", "agent", "to", "action", "domains", "sens", "local_action"]


def record(handoffs: DataFrame, internal: DataFrame) -> DataFrame:
    """One log: handoffs have from_agent and to_agent, internal actions an agent."""
    h = handoffs.select("trace", "seq", F.lit("handoff").alias("kind"), F.col("from_agent").alias("agent"), F.col("to_agent").alias("to"), "action", "domains", "sens", "local_action")
    i = internal.select("trace", "seq", F.lit("internal").alias("kind"), "agent", F.lit("").alias("to"), "action", "domains", "sens", "local_action")
    return h.unionByName(i)


def register_agents(registrations: DataFrame) -> DataFrame:
    """The first registration of each agent, by seq: a later one changes nothing."""
    cols = [c for c in registrations.columns if c not in ("agent", "seq")]
    return registrations.groupBy("agent").agg(F.min("seq").alias("seq"), F.min_by(F.struct(*cols), "seq").alias("r")).select("agent", "seq", "r.*")


def timeline(log: DataFrame) -> DataFrame:
    return log.select(*EVENT).orderBy("trace", "seq")


def agent_summary(log: DataFrame) -> DataFrame:
    """(trace, agent, sent, received, internal, domains): what an agent did and got in a trace, and the domains of what it did."""
    one = lambda k: F.lit(k).cast("bigint")
    did = log.select("trace", "agent", F.when(F.col("kind") == "handoff", 1).otherwise(0).cast("bigint").alias("sent"), one(0).alias("received"), F.when(F.col("kind") == "internal", 1).otherwise(0).cast("bigint").alias("internal"), "domains")
    got = log.where("kind = 'handoff' and to <> ''").select("trace", F.col("to").alias("agent"), one(0).alias("sent"), one(1).alias("received"), one(0).alias("internal"), F.array().cast("array<string>").alias("domains"))
    domains = F.array_sort(F.array_distinct(F.flatten(F.collect_set("domains"))))  # sets of a small vocabulary
    return did.union(got).groupBy("trace", "agent").agg(F.sum("sent").alias("sent"), F.sum("received").alias("received"), F.sum("internal").alias("internal"), domains.alias("domains"))


def trace_summary(log: DataFrame) -> DataFrame:
    """(trace, n_agents, n_handoffs, n_internal, domains)."""
    each = log.withColumn("who", F.explode(F.when(F.col("to") != "", F.array("agent", "to")).otherwise(F.array("agent"))))
    n = each.groupBy("trace").agg(F.count_distinct("who").alias("n_agents"))
    domains = F.array_sort(F.array_distinct(F.flatten(F.collect_set("domains"))))
    k = log.groupBy("trace").agg(F.count_if(F.col("kind") == "handoff").alias("n_handoffs"), F.count_if(F.col("kind") == "internal").alias("n_internal"), domains.alias("domains"))
    return n.join(k, "trace")


def export(log: DataFrame) -> DataFrame:
    """(trace, seq, event): a line of JSON for each event, to be written in order; a trace of any length is many rows, never one."""
    return log.select("trace", "seq", F.to_json(F.struct(*EVENT)).alias("event"))
