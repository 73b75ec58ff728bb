"""Access control, channel audits, negative inference: ordered CASE expressions over requests, channel events and responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SENSITIVE = ("health", "finance", "legal", "identity")
EXCLUSIONS = ["except", "excluding", "other than", "apart from", "not including", "with the exception of", "but not", "cannot share", "cannot disclose", "unable to share"]


def check_access(requests: DataFrame, clearances: DataFrame) -> DataFrame:
    """Decision and escalation of each request, by the first rule that it breaks: no read up, no write down, domains, owner, tools, delegation.

    Requests: agent, action, level, domains, owner, tool, target. Of an agent with several clearances, any one of the last registered counts.
    """
    c = clearances.withColumnRenamed("agent", "c_agent")
    t = clearances.select(F.col("agent").alias("t_agent"), F.col("max_level").alias("t_level"))
    j = requests.join(c, F.col("agent") == F.col("c_agent"), "left").join(t, F.col("target") == F.col("t_agent"), "left")
    at = F.col("action")
    no_tool = (F.col("tool") != "") & (F.size("allowed_tools") > 0) & ~F.array_contains("allowed_tools", F.col("tool"))
    bad_delegate = ~F.col("can_delegate") | ((F.col("tool") != "") & ~F.array_contains("delegatable_tools", F.col("tool"))) | F.coalesce(F.col("t_level") > F.col("max_level"), F.lit(False))
    kind = (
        F.when(F.col("c_agent").isNull(), "none")
        .when((at == "read") & (F.col("level") > F.col("max_level")), "vertical")
        .when((at == "write") & (F.col("level") < F.col("max_level")), "vertical")
        .when(F.size(F.array_except("domains", "allowed_domains")) > 0, "vertical")
        .when((F.col("owner") != "") & (F.col("owner") != F.col("user_id")), "horizontal")
        .when((at == "execute") & no_tool, "vertical")
        .when((at == "delegate") & bad_delegate, "delegation")
        .otherwise("none")
    )
    j = j.withColumn("escalation", kind)
    decision = F.when(F.col("c_agent").isNull(), "deny").when(F.col("escalation") != "none", "escalation_blocked").otherwise("allow")
    return j.withColumn("decision", decision).select(*requests.columns, "decision", "escalation")


def audit_channels(events: DataFrame, blocked_tools: list[str] = (), allowed_keys: list[str] | None = None, allowed_paths: list[str] | None = None) -> DataFrame:
    """events with ``act``: lists come before the detector's level; a full leak is blocked in tool arguments (C3), memory (C5) and artifacts (C7) and redacted in tool returns (C4) and telemetry (C6)."""
    ch = F.col("channel")
    listed = (ch == "C3") & F.col("tool").isin(*blocked_tools) if blocked_tools else F.lit(False)
    if allowed_keys is not None:
        listed = listed | ((ch == "C5") & ~F.col("memory_key").isin(*allowed_keys))
    if allowed_paths is not None:
        inside = F.lit(False)
        for p in allowed_paths:
            inside = inside | F.col("path").startswith(p)
        listed = listed | ((ch == "C7") & ~inside)
    full = F.col("level") == "full"
    act = F.when(listed | (full & ch.isin("C3", "C5", "C7")), "block").when(full, "redact").when(F.col("level") == "partial", "warn").otherwise("allow")
    return events.withColumn("act", act)


def _inferred(domains: Column) -> Column:
    """The first of the sensitive domains by name; null if there is none."""
    return F.array_min(F.array_intersect(domains, F.array(*map(F.lit, SENSITIVE))))


def refusal_leaks(e: DataFrame) -> DataFrame:
    """What a refusal or a silence tells about the query's domains."""
    one = (F.size("domains") == 1).cast("int") * 0.2
    rows = e.where(F.col("response").isin("refusal", "silence")).withColumn("inferred", _inferred(F.col("domains"))).where("inferred is not null")
    return rows.withColumn("confidence", F.least(F.lit(1.0), F.when(F.col("response") == "refusal", 0.7).otherwise(0.5) + one))


def delay_leaks(e: DataFrame, factor: float = 3.0) -> DataFrame:
    """Responses that took several times as long as expected; an expectation of zero or less tells nothing."""
    rows = e.where("expected > 0").withColumn("ratio", F.col("actual") / F.col("expected")).withColumn("inferred", _inferred(F.col("domains")))
    return rows.where((F.col("ratio") >= factor) & F.col("inferred").isNotNull()).withColumn("confidence", F.least(F.lit(1.0), 0.3 + 0.1 * F.col("ratio")))


def differential_responses(e: DataFrame, least: float = 3.0) -> DataFrame:
    """Pairs of responses of one group whose lengths differ by that factor."""
    b = e.select("grp", F.col("item").alias("item_b"), F.col("length").alias("n_b"), F.col("domains").alias("d_b"))
    p = e.select("grp", F.col("item").alias("item_a"), F.col("length").alias("n_a"), F.col("domains").alias("d_a")).join(b, "grp").where("item_a < item_b and n_a > 0 and n_b > 0")
    p = p.withColumn("ratio", F.greatest("n_a", "n_b") / F.least("n_a", "n_b")).withColumn("inferred", _inferred(F.array_union("d_a", "d_b")))
    return p.where((F.col("ratio") >= least) & F.col("inferred").isNotNull()).withColumn("confidence", F.least(F.lit(0.8), 0.3 + 0.1 * F.col("ratio")))


def partial_answers(e: DataFrame, exclusions: list[str] = EXCLUSIONS) -> DataFrame:
    """Answers that name some of the expected items only, or exclude something in words; a partial answer goes before an exclusion."""
    low = F.lower("text")
    n = F.size("items")
    named = F.size(F.filter("items", lambda i: low.contains(F.lower(i))))
    partial = (n >= 2) & (named > 0) & (named < n)
    excluded = F.lit(False)
    for x in exclusions:
        excluded = excluded | low.contains(x)
    rows = e.withColumn("kind", F.when(partial, "partial_answer").when(excluded, "exclusion_leak")).withColumn("inferred", _inferred(F.col("domains")))
    return rows.where("kind is not null and inferred is not null").withColumn("confidence", F.when(partial, F.least(F.lit(0.9), 0.4 + (n - named) * 0.1)).otherwise(0.65))


def response_times(e: DataFrame) -> DataFrame:
    """(agent, responses, average): mean time of the responses."""
    return e.groupBy("agent").agg(F.count("actual").alias("responses"), F.avg("actual").alias("average"))


def register_clearances(registrations: DataFrame) -> DataFrame:
    """The last clearance that each agent has registered, by seq."""
    cols = [c for c in registrations.columns if c not in ("agent", "seq")]
    return registrations.groupBy("agent").agg(F.max_by(F.struct(*cols), "seq").alias("r")).select("agent", "r.*")


def access_log(checked: DataFrame, order: str) -> DataFrame:
    """The log of what ``check_access`` decided: who asked for what and how it ended, with a running number of the agent's refusals."""
    w = Window.partitionBy("agent").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return checked.select("agent", order, "action", "level", "decision", "escalation", F.count_if(F.col("decision") != "allow").over(w).alias("refused_so_far"))
