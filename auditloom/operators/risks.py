"""What is done with risks: alert levels, suppression, scenario, blame, scores, incidents, compliance, confusion matrices."""

from __future__ import annotations

from collections import Counter
from itertools import chain

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditloom.operators.graph import components


def alert_level(severity: Column) -> Column:
    return F.when(severity >= 0.8, "critical").when(severity >= 0.5, "high").when(severity >= 0.3, "medium").otherwise("low")


def with_ids(risks: DataFrame) -> DataFrame:
    """risks with risk_id: a hash of type, agents and edges, so it is the same in every run."""
    return risks.withColumn("risk_id", F.substring(F.sha2(F.concat_ws("|", "risk_type", F.array_join("agents", ","), F.array_join("edges", ","), "source_domain", "target_domain"), 256), 1, 16))


def suppress(risks: DataFrame, rules: DataFrame) -> DataFrame:
    """risks without those that a rule (risk_type, agent_pattern, action) suppresses; other actions than 'suppress' do nothing. The rules are a short list from an operator."""
    r = rules.where("action = 'suppress'").select(F.col("risk_type").alias("r_type"), F.col("agent_pattern").alias("r_pattern"))
    hit = (F.coalesce("r_type", F.lit("")).isin("") | (F.col("r_type") == F.col("risk_type"))) & (F.coalesce("r_pattern", F.lit("")).isin("") | F.exists("agents", lambda a: F.regexp(a, F.col("r_pattern"))))
    return risks.join(r, hit, "left_anti")


def classify(risks: DataFrame, pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """risks (with risk_id) with ``scenario`` by the first rule that holds: CD, CM, HS, GC, MC, CU, else AM."""
    p = pairs.select("from_agent", "to_agent").distinct()
    degree = p.select(F.col("from_agent").alias("agent"), F.lit(0).alias("i"), F.lit(1).alias("o")).union(p.select("to_agent", F.lit(1), F.lit(0))).groupBy("agent").agg(F.sum("i").alias("i"), F.sum("o").alias("o"))
    each = risks.select("risk_id", F.posexplode("agents").alias("pos", "agent"))
    per = each.join(degree, "agent", "left").join(nodes.select("agent", "user_id"), "agent", "left").groupBy("risk_id").agg(F.max("i").alias("most_in"), F.max("o").alias("most_out"), F.count_distinct(F.nullif("user_id", F.lit(""))).alias("users"))
    nxt = each.select("risk_id", (F.col("pos") - 1).alias("pos"), F.col("agent").alias("next"))
    either = p.select(F.col("from_agent").alias("agent"), F.col("to_agent").alias("next")).union(p.select("to_agent", "from_agent")).distinct().withColumn("linked", F.lit(True))
    chain = each.join(nxt, ["risk_id", "pos"]).join(either, ["agent", "next"], "left").groupBy("risk_id").agg(F.bool_and(F.coalesce("linked", F.lit(False))).alias("chained"))
    j = risks.join(per, "risk_id", "left").join(chain, "risk_id", "left")
    known = (F.col("source_domain") != "") & (F.col("target_domain") != "")
    scenario = (
        F.when(known & (F.col("source_domain") != F.col("target_domain")), "CD")
        .when(F.col("risk_type").isin("compound_scope_escalation", "compound_injection_leak"), "CM")
        .when(F.col("most_in") >= 3, "HS")
        .when(F.col("most_out") >= 3, "GC")
        .when((F.size("agents") >= 3) & F.col("chained"), "MC")
        .when(F.col("users") > 1, "CU")
        .otherwise("AM")
    )
    return j.withColumn("scenario", scenario).select(*risks.columns, "scenario")


def blame(risks: DataFrame, pairs: DataFrame) -> DataFrame:
    """(risk_id, blame_agent, blame_hop, reason, confidence): the last hop of the agents' chain with a violation, a rise in sensitivity to 3 or more, or a new domain; else the source.

    A hop without an edge is passed over. The edge into a sender that it is compared with is its most sensitive one, the last by id of several.
    """
    best = pairs.groupBy(F.col("to_agent").alias("src")).agg(F.max_by(F.struct("sens", "domains"), F.struct("sens", "edge_id")).alias("inc"))
    chained = F.arrays_zip(F.slice("agents", 1, F.size("agents") - 1).alias("src"), F.slice("agents", 2, F.size("agents") - 1).alias("dst"))
    each = risks.where("size(agents) >= 2").select("risk_id", F.posexplode(chained).alias("hop", "x")).select("risk_id", "hop", "x.src", "x.dst")
    edge = pairs.select(F.col("from_agent").alias("src"), F.col("to_agent").alias("dst"), "violation", "sens", "domains")
    hops = each.join(edge, ["src", "dst"]).join(best, "src", "left")
    before = F.array_intersect(F.coalesce("inc.domains", F.array().cast("array<string>")), F.array(*map(F.lit, ("health", "finance", "legal", "identity"))))
    reason = (
        F.when(F.col("violation"), "violation")
        .when((F.col("sens") > F.coalesce("inc.sens", F.lit(0))) & (F.col("sens") >= 3), "amplified")
        .when(F.size(F.array_except("domains", before)) > 0, "new_domains")
    )
    hit = hops.withColumn("reason", reason).where("reason is not null").groupBy("risk_id").agg(F.max_by(F.struct("src", "hop", "reason"), "hop").alias("b"))
    first = risks.where("size(agents) >= 2").select("risk_id", F.element_at("agents", 1).alias("source"))
    confidence = F.when(F.col("b.reason") == "violation", 0.9).when(F.col("b.reason") == "amplified", 0.7).when(F.col("b.reason") == "new_domains", 0.6).otherwise(0.3)
    return first.join(hit, "risk_id", "left").select("risk_id", F.coalesce("b.src", "source").alias("blame_agent"), F.coalesce("b.hop", F.lit(0)).alias("blame_hop"), F.coalesce("b.reason", F.lit("source")).alias("reason"), confidence.alias("confidence"))


def agent_scores(risks: DataFrame, pairs: DataFrame, leakage: DataFrame, blamed: DataFrame | None = None, paths: DataFrame | None = None, hub_rows: DataFrame | None = None) -> DataFrame:
    """(agent, score): contributions summed and divided by the largest. Only agents of the graph count; leakage has (agent, rate)."""
    p = pairs.select("from_agent", "to_agent").distinct()
    nodes = p.select(F.explode(F.array("from_agent", "to_agent")).alias("agent")).distinct()
    indeg = p.groupBy(F.col("to_agent").alias("agent")).agg(F.count("*").alias("n")).where("n >= 3").select("agent", (0.3 * (F.col("n") - 2)).alias("x"))
    parts = [risks.select(F.explode("agents").alias("agent"), F.col("severity").alias("x")), indeg, leakage.select("agent", F.col("rate").alias("x"))]
    if blamed is not None:
        parts.append(blamed.select(F.col("blame_agent").alias("agent"), F.lit(0.4).alias("x")))
    if paths is not None:
        parts += [paths.select(F.explode("path").alias("agent"), F.lit(0.2).alias("x")), paths.where("amplified").select(F.col("source").alias("agent"), F.lit(0.5).alias("x"))]
    if hub_rows is not None:
        parts.append(hub_rows.select("agent", (F.col("betweenness") * 0.5).alias("x")))
    every = parts[0]
    for x in parts[1:]:
        every = every.union(x)
    s = nodes.join(every.groupBy("agent").agg(F.sum("x").alias("x")), "agent", "left").select("agent", F.coalesce("x", F.lit(0.0)).alias("x"))
    top = s.agg(F.max("x").alias("top"))  # one row
    return s.crossJoin(top).select("agent", F.when(F.col("top") > 0, F.least(F.lit(1.0), F.col("x") / F.col("top"))).otherwise(F.col("x")).alias("score"))


ACTIONS = {
    "cross_domain_leak": "Restrict what crosses between these domains.", "aggregation_leak": "Limit how much of one domain converges on an agent.", "taint_spreading": "Contain the subject's data at its origin.",
    "cascading_infection": "Quarantine the first agent and those it reached.",
}
_INCIDENT = "incident_id string, alert_level string, risk_type string, source_domain string, target_domain string, agents array<string>, risks int, severity double, scenario string, blamed array<string>, root_cause string, recommended string"


def _clusters(each: list, least: float) -> list[tuple[set, list[int]]]:
    """(agents, members) of greedy clusters of agent sets, in their order. What a set shares with a cluster is counted through the clusters that its agents are in, so no two sets are compared as a whole."""
    clusters: list[tuple[set, list[int]]] = []
    of: dict[str, list[int]] = {}  # the clusters that an agent is in: only they can resemble a set with it
    bare = None  # the first cluster without agents: sets without agents are alike
    for i, agents in enumerate(each):
        mine = set(agents)
        shared = Counter(chain.from_iterable(of.get(a, ()) for a in mine))
        k = min((k for k, n in shared.items() if n / (len(clusters[k][0]) + len(mine) - n) > least), default=None) if mine else bare
        if k is None:
            k = len(clusters)
            clusters.append((set(), []))
            if not mine:
                bare = k
        held, members = clusters[k]
        for a in mine - held:
            of.setdefault(a, []).append(k)
        held |= mine
        members.append(i)
    return clusters


def incidents(risks: DataFrame, least: float = 0.3) -> DataFrame:
    """Greedy clusters of risks of one type and source domain: a risk joins the first cluster whose agents it resembles by more than ``least``, in order of risk_id.

    Risks that share no agent can't meet in a cluster, so each connected group of risks of a type and domain is a task's input, not the whole of them. risks can have scenario and blame_agent.
    """

    names = [c.split()[0] for c in _INCIDENT.split(", ")]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        """Of some groups, each by itself."""
        rows = pdf.sort_values(["__g", "risk_id"])
        col = {c: rows[c].tolist() for c in ("__g", "agents", *some)}
        out, at = [], 0
        while at < len(rows):
            end = at + 1
            while end < len(rows) and col["__g"][end] == col["__g"][at]:
                end += 1
            for held, members in _clusters(col["agents"][at:end], least):
                of = lambda c: [col[c][at + i] for i in members]  # noqa: B023, E731
                worst = min(1.0, float(max(of("severity"))))
                level = "critical" if worst >= 0.8 else "high" if worst >= 0.5 else "medium" if worst >= 0.3 else "low"
                named = Counter(x for x in of("scenario") if x) if "scenario" in col else {}
                kind, source, target = of("risk_type")[0], of("source_domain")[0], of("target_domain")[0]
                blamed = sorted({b for b in of("blame_agent") if b}) if "blame_agent" in col else []
                cause = f"{len(members)} {kind} risk(s) of {len(held)} agents" + (f", from {source} to {target}" if target else "")
                most = min(named, key=lambda x: (-named[x], x)) if named else ""  # noqa: B023
                out.append((of("risk_id")[0], level, kind, source, target, sorted(held), len(members), worst, most, blamed, cause, ACTIONS.get(kind, "Review these agents and what they exchange.")))
            at = end
        return pd.DataFrame(out, columns=names)

    links = risks.select(F.concat_ws("|", "risk_type", "source_domain", "risk_id").alias("from_agent"), F.explode("agents").alias("a"), "risk_type", "source_domain").select("from_agent", F.concat_ws("|", "risk_type", "source_domain", "a").alias("to_agent"))
    group = components(links).select(F.col("agent").alias("__r"), F.col("component").alias("__g"))
    keyed = risks.withColumn("__k", F.concat_ws("|", "risk_type", "source_domain", "risk_id")).join(group, F.col("__k") == F.col("__r"), "left").withColumn("__g", F.coalesce("__g", F.concat_ws("|", "risk_type", "source_domain")))
    some = ["risk_id", "risk_type", "source_domain", "target_domain", "severity", *[c for c in ("scenario", "blame_agent") if c in risks.columns]]
    deal = max(4 * risks.sparkSession.sparkContext.defaultParallelism, keyed.count() // 4096)  # groups are many and mostly small: a task is dealt some of them
    return keyed.select("__g", "agents", *some).withColumn("__b", F.pmod(F.xxhash64("__g"), F.lit(deal))).repartition(min(deal, 2000), "__b").groupBy("__b").applyInPandas(run, _INCIDENT)


def by_severity(found: DataFrame) -> DataFrame:
    """Incidents, the worst first."""
    return found.orderBy(F.desc("severity"), "incident_id")


SECURITY = ("compound_injection_leak", "cascading_infection", "prompt_injection_propagation")


def compliance(risks: DataFrame, pairs: DataFrame, blamed: int, amplified: int, topology: bool, scenarios: bool, california: bool = True, children: bool = True) -> DataFrame:
    """(regulation, article, score, status), from one pass of conditional counts. blamed: risks with attribution; amplified: amplifying paths."""
    n = risks.agg(
        F.count("*").alias("n"), F.count_if(F.col("severity") >= 0.7).alias("high"), F.count_if(F.col("risk_type").isin(*SECURITY)).alias("security"), F.count_if(F.col("risk_type").isin("cross_domain_leak", "compositional_quasi_id")).alias("crossing"),
        F.count_if(F.col("risk_type") == "aggregation_leak").alias("aggregated"), F.count_if((F.col("source_domain") == "children") | (F.col("target_domain") == "children")).alias("minors"),
    ).crossJoin(pairs.agg(F.count("*").alias("edges")))
    c, some = F.col, F.col("edges") > 0
    scores = [
        ("EU_AI_ACT", "Art. 9", F.when((c("n") == 0) & some, 0.8).otherwise(1.0 - 0.1 * c("high") - 0.05 * (c("n") - blamed))),
        ("EU_AI_ACT", "Art. 12", F.when(some, 0.5).otherwise(0.0) + 0.25 * topology + 0.25 * scenarios),
        ("EU_AI_ACT", "Art. 14", F.when(some, 0.7).otherwise(0.4) + (0.3 if blamed else 0.0)),
        ("EU_AI_ACT", "Art. 15", 0.8 - 0.15 * c("security") - (0.2 if amplified else 0.0)),
        ("GDPR", "Art. 5(1)(c)", 0.8 - 0.1 * c("crossing") - 0.1 * c("aggregated")),
        ("GDPR", "Art. 25", F.when(some, 0.8).otherwise(0.6) + 0.1 * topology + 0.1 * scenarios),
        ("GDPR", "Art. 35", F.when(some, 0.7).otherwise(0.3) + F.when(c("high") > 0, -0.1).otherwise(0.1)),
    ]
    if california:
        scores.append(("CA_SB_243", "Sec. 1", F.when(some, 0.9).otherwise(0.7)))
    if children:
        scores.append(("COPPA", "Rule 312", F.when(c("minors") > 0, 0.5 - 0.15 * c("minors")).otherwise(0.8)))
    rows = F.array(*[F.struct(F.lit(r).alias("regulation"), F.lit(a).alias("article"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), s.cast("double"))).alias("score")) for r, a, s in scores])
    x = n.select(F.explode(rows).alias("r")).select("r.*")
    return x.withColumn("status", F.when(F.round("score", 9) >= 0.8, "compliant").when(F.round("score", 9) >= 0.5, "partial").otherwise("non_compliant"))


def by_regulation(articles: DataFrame) -> DataFrame:
    """(regulation, score, articles, gaps, status): the mean of a regulation's articles."""
    g = articles.groupBy("regulation").agg(F.avg("score").alias("score"), F.count("*").alias("articles"), F.count_if(F.col("status") == "non_compliant").alias("gaps"))
    return g.withColumn("status", F.when(F.round("score", 9) >= 0.8, "compliant").when(F.round("score", 9) >= 0.5, "partial").otherwise("non_compliant"))


def compliance_overall(articles: DataFrame) -> DataFrame:
    return articles.agg(F.bround(F.avg("score"), 3).alias("overall"), F.count_if(F.col("status") == "non_compliant").alias("gaps"))


def confusion(rows: DataFrame, truth: Column, said: Column) -> DataFrame:
    """tp, fp, tn, fn, precision, recall, specificity, F1 of precision and recall, and that of recall and specificity; an empty denominator counts as 1."""
    g = rows.agg(F.count_if(truth & said).alias("tp"), F.count_if(~truth & said).alias("fp"), F.count_if(~truth & ~said).alias("tn"), F.count_if(truth & ~said).alias("fn"))
    return rates(g)


def rates(g: DataFrame) -> DataFrame:
    part = lambda a, b: F.when(F.col(a) + F.col(b) > 0, F.col(a) / (F.col(a) + F.col(b))).otherwise(1.0)
    g = g.withColumns({"precision": part("tp", "fp"), "recall": part("tp", "fn"), "specificity": part("tn", "fp")})
    mean = lambda a, b: F.when(F.col(a) + F.col(b) > 0, 2 * F.col(a) * F.col(b) / (F.col(a) + F.col(b))).otherwise(0.0)
    return g.withColumns({"f1": mean("precision", "recall"), "f1_specificity": mean("recall", "specificity")})
