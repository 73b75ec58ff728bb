"""The first phase as one operator: entries in; gate, tiers, injection and refusal checks; edges without content, receipts and one report for each agent out.

Entries: trace, seq, entry_id, agent, to_agent (null for an internal action), action, input_text, output_text, sens, domains, ts, subject. A policy is configuration (what must not be shared, abstractions, canaries); which agent has
which is data, joined by agent; an agent without one is only recorded. Nothing here is collected: an entry is a row all the way.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditloom.functions.patterns import STRUCTURED
from auditloom.operators import text as T
from auditloom.operators.commitments import merkle_roots
from auditloom.operators.controls import SENSITIVE


@dataclass
class Policy:
    name: str
    rules: list[str]
    abstractions: dict[str, str] = field(default_factory=dict)
    canaries: list[str] = field(default_factory=list)


def with_policy(entries: DataFrame, policies: DataFrame) -> DataFrame:
    """entries with the name of their agent's policy, '' without one. policies: (agent, policy); how they are joined is Spark's choice by their size."""
    p = policies.select(F.col("agent").alias("__agent"), F.col("policy").alias("policy"))
    return entries.join(p, F.col("agent") == F.col("__agent"), "left").drop("__agent").withColumn("policy", F.coalesce("policy", F.lit("")))


def _apart(df: DataFrame) -> DataFrame:
    """df, with its columns made before what reads them: a generator of one row keeps the optimizer from writing a column's whole expression into each of its uses, of which a text has a hundred here."""
    return df.withColumn("__one", F.explode(F.array(F.lit(1)))).drop("__one")


def _with_field(df: DataFrame, text: str) -> DataFrame:
    """df with __field: whether a text holds a structured field."""
    hits = T.matches(F.col(text), [*STRUCTURED.values()], F.col("__may"))
    each = [h & (F.size(T.structured_fields(F.col(text), k)) > 0) if k == "credit_card" else h for k, h in zip(STRUCTURED, hits)]
    return df.withColumn("__may", T.may_match(F.col(text), [*STRUCTURED.values()])).withColumn("__field", reduce(lambda a, b: a | b, each)).drop("__may")


def audited(entries: DataFrame, policies: list[Policy], judge: Column | None = None) -> DataFrame:
    """entries (with ``policy``) and what the audit finds: gate ('allow' or 'redact'), matched (rules and PII kinds), final (the text that leaves: redacted, empty where the tiers block), level, act, violation, warned, injected, pii, refusal (the domain that a refusal gives away), content_hash.

    The gate always redacts, so a block comes from the tiers only, which see the redacted text. For an internal action, a redaction is a violation too, and tiers count where the gate found nothing.
    """
    raw = F.coalesce(F.col("output_text"), F.lit(""))
    matched, shown, df = F.lit(0), raw, entries
    for k, p in enumerate(policies):
        df = T.with_matched(df, raw, p.rules, f"__found{k}")
        hits = F.size(f"__found{k}")
        matched = F.when(F.col("policy") == p.name, hits).otherwise(matched)
        shown = F.when((F.col("policy") == p.name) & (hits > 0), T.redacted(raw, p.rules, p.abstractions)).otherwise(shown)
    out = F.col("to_agent").isNotNull()
    df = df.withColumn("matched", matched).withColumns({"gate": F.when(F.col("matched") > 0, "redact").otherwise("allow"), "shown": F.when(out, shown).otherwise(raw)})
    df = _with_field(_apart(df), "shown")
    names = [c for c in df.columns]
    levels = F.lit("none")
    for k, p in enumerate([*policies, Policy("", [])]):
        df = T.protected_level(df, "shown", p.rules, p.canaries, F.col("__field"), judge=judge).withColumnsRenamed({"level": f"__level{k}", "top": f"__top{k}"})
        levels = F.when(F.col("policy") == p.name, F.col(f"__level{k}")).otherwise(levels)
    df = df.select(*names, levels.alias("level"))
    full, partial = F.col("level") == "full", F.col("level") == "partial"
    df = df.withColumn("final", F.when(out & full, "").otherwise(F.col("shown")))
    df = _apart(df)
    df = T.injection(df, "final", F.lit("agent")).withColumnRenamed("detected", "__a").drop("confidence", "kind", "patterns")
    df = df.withColumn("__in", F.coalesce(F.col("input_text"), F.lit("")))
    df = T.injection(df, "__in", F.lit("agent")).withColumnRenamed("detected", "__b").drop("confidence", "kind", "patterns")
    redacted = F.col("gate") != "allow"
    act = F.when(full, "block").otherwise(F.col("gate"))
    inferred = F.array_min(F.array_intersect("domains", F.array(*map(F.lit, SENSITIVE))))
    return df.select(
        *entries.columns, "gate", F.col("matched").cast("int").alias("matched"), "final", "level", F.when(out, act).alias("act"),
        F.when(out, full).otherwise(redacted | full | partial).alias("violation"), (out & partial).alias("warned"), (out & (F.col("__a") | F.col("__b"))).alias("injected"),
        (~out & (redacted | full | partial)).alias("pii"), F.when(~out & (F.col("action") == "refusal"), inferred).alias("refusal"), F.sha2("final", 256).alias("content_hash"),
    )


def edges_of(found: DataFrame) -> DataFrame:
    """Edges without content of the outgoing entries: a redacted or blocked one has a local violation."""
    return found.where("to_agent is not null").select(
        F.col("entry_id").alias("edge_id"), "trace", "seq", F.col("agent").alias("from_agent"), "to_agent", "ts", T.message_type(F.col("domains"), False).alias("message_type"), "sens", "domains",
        (F.col("act") != "allow").alias("violation"), "act", "content_hash", "injected", "subject", (F.col("act") == "block").alias("blocked"),
    )


def receipts_of(edges: DataFrame) -> DataFrame:
    """What recipients log of the edges that reached them."""
    return edges.where("not blocked").select("from_agent", "to_agent", "content_hash", "domains")


def with_taint(edges: DataFrame, owners: DataFrame) -> DataFrame:
    """edges with the taint that travels with them: t_domains, t_subject, t_principal, t_hops, t_risk. owners: (agent, owner)."""
    from auditloom.operators.sequence import propagate_taint

    o = owners.select(F.col("agent").alias("__a"), F.col("owner").alias("principal"))
    h = edges.join(o, F.col("from_agent") == F.col("__a"), "left").select("trace", "seq", "from_agent", "to_agent", "domains", "sens", F.coalesce("subject", F.lit("")).alias("subject"), "blocked", F.coalesce("principal", F.lit("")).alias("principal"))
    t = propagate_taint(h, owners=True)
    return edges.join(t.drop("t_sens"), ["trace", "seq"]).withColumn("t_domains", F.split("t_domains", ",")).withColumn("t_hops", F.col("t_hops").cast("int"))


def reports_of(found: DataFrame, declared: DataFrame | None = None) -> DataFrame:
    """(agent, total, violations, redactions, rate, edges, received, refusals, domains, merkle_root), a row for each agent that has done something. declared: (agent, domains) of agents that say what they work in."""
    tags = F.array_sort(F.array_distinct(F.flatten(F.collect_set("domains"))))  # sets of a small vocabulary
    r = found.groupBy("agent").agg(
        F.count("*").alias("total"), F.count_if("violation").alias("violations"), F.sum(F.when(F.col("to_agent").isNotNull() & (F.col("gate") == "redact"), F.col("matched")).otherwise(0)).alias("redactions"),
        F.count_if(F.col("to_agent").isNotNull()).alias("edges"), F.count_if(F.col("refusal").isNotNull()).alias("refusals"), tags.alias("domains"),
    )
    if declared is not None:
        d = declared.select(F.col("agent").alias("__a"), F.col("domains").alias("__d"))
        r = r.join(d, F.col("agent") == F.col("__a"), "left").withColumn("domains", F.array_sort(F.array_union("domains", F.coalesce("__d", F.array().cast("array<string>"))))).drop("__a", "__d")
    got = receipts_of(edges_of(found)).groupBy(F.col("to_agent").alias("__r")).agg(F.count("*").alias("received"))
    root = merkle_roots(found.select("agent", "trace", "seq", F.concat_ws("|", "entry_id", "action", "content_hash").alias("body")), "agent", ["trace", "seq"], "body")
    j = r.join(got, F.col("agent") == F.col("__r"), "left").join(root.select(F.col("agent").alias("__m"), "root"), F.col("agent") == F.col("__m"))
    return j.select("agent", "total", "violations", "redactions", (F.col("violations") / F.col("total")).alias("rate"), "edges", F.coalesce("received", F.lit(0)).alias("received"), "refusals", "domains", F.col("root").alias("merkle_root"))
