"""Desensitization of edges, differential privacy and what it leaves to be learnt."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditloom.functions import noise

PARENTS = {"health": "personal", "finance": "personal", "legal": "personal", "schedule": "contextual", "social": "contextual"}
KNOWN_DOMAINS = ("finance", "general", "health", "legal", "schedule", "social")
MESSAGE_TYPES = ("", "financial_info", "general", "health_info", "legal_info", "schedule_info", "social_info")
DELTA = 1e-5


@dataclass
class Epsilons:
    """Budgets of one mechanism each."""

    edge: float = 1.0
    sensitivity: float = 1.0
    stats: float = 1.0
    domains: float = 1.0


@dataclass
class Config:
    """salt and bits of the content hash, minutes of a time bucket, k and parents of domains, and the budgets (None: no noise)."""

    salt: str
    bits: int = 128
    minutes: int = 5
    k: int = 3
    parents: dict[str, str] = field(default_factory=lambda: dict(PARENTS))
    epsilons: Epsilons | None = None


def salted_hash(content: Column, salt: str | Column, bits: int = 128) -> Column:
    salt = F.lit(salt) if isinstance(salt, str) else salt
    return F.substring(F.sha2(F.concat_ws(":", salt, content), 256), 1, bits // 4)


def time_bucket(ts: Column, minutes: int) -> Column:
    """Floored within its day; a size of zero or less changes nothing."""
    if minutes <= 0:
        return ts
    day = F.date_trunc("day", ts)
    passed = F.unix_timestamp(ts) - F.unix_timestamp(day)
    return F.timestamp_seconds(F.unix_timestamp(day) + F.floor(passed / (minutes * 60)) * (minutes * 60))


def pseudonym(agent: Column, salt: str) -> Column:
    return F.concat(F.lit("node_"), F.substring(F.sha2(F.concat_ws(":", F.lit(salt), agent), 256), 1, 12))


def pseudonym_or_pass(name: Column, salt: str) -> Column:
    """Subjects and principals: an empty name, a null one and 'multi' stay."""
    return F.when(name.isNull() | (name == "") | (name == "multi"), name).otherwise(pseudonym(name, salt))


def reverse_map(agents: DataFrame, column: str, salt: str) -> DataFrame:
    """(pseudonym, agent): for the edge's own side only."""
    return agents.select(pseudonym(F.col(column), salt).alias("pseudonym"), F.col(column).alias("agent")).distinct()


def epoch_salt(secret: str, epoch: Column) -> Column:
    return F.sha2(F.concat_ws(":", F.lit(secret), epoch.cast("string")), 256)


def domain_counts(edges: DataFrame) -> DataFrame:
    """(domain, agents that report it)."""
    return edges.select("from_agent", F.explode("domains").alias("domain")).groupBy("domain").agg(F.countDistinct("from_agent").alias("agents"))


def frequent_domains(edges: DataFrame, k: int) -> list[str]:
    """At most as many as there are domains in the vocabulary, so they come to the driver."""
    return sorted(r["domain"] for r in domain_counts(edges).where(F.col("agents") >= k).collect())


def generalized(domains: Column, keep: list[str], parents: dict[str, str]) -> Column:
    """Rare domains become their parents, each parent once; none at all is 'general'."""
    known = F.create_map(*[F.lit(x) for kv in sorted(parents.items()) for x in kv]) if parents else None

    def step(out: Column, d: Column) -> Column:
        parent = F.coalesce(F.try_element_at(known, d), F.lit("general")) if known is not None else F.lit("general")
        return F.when(d.isin(keep), F.concat(out, F.array(d))).when(F.array_contains(out, parent), out).otherwise(F.concat(out, F.array(parent)))

    found = F.aggregate(domains, F.array().cast("array<string>"), step)
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("general")))


def desensitize(edges: DataFrame, config: Config, keep: list[str] | None = None) -> DataFrame:
    """edge_id, content_hash, ts, from_agent, to_agent, domains, sens, violation: hash, bucket, pseudonyms, k-anonymous domains, noise. One narrow pass; without counts (keep None) domains stay.

    What the edges have of injected, t_domains, t_hops and t_risk stays as it is, and t_subject and t_principal become pseudonyms of the same salt, so the central audit can still compare them.
    """
    has = set(edges.columns)
    kept = [c for c in ("injected", "t_domains", "t_hops", "t_risk") if c in has]
    names = [pseudonym_or_pass(F.col(c), config.salt).alias(c) for c in ("t_subject", "t_principal") if c in has]
    e = config.epsilons
    u = lambda what: noise.uniform(f"{config.salt}:{what}", F.col("edge_id"))
    sens = F.least(F.lit(5), noise.noisy_count(F.col("sens"), u("sens"), e.sensitivity)).cast("int") if e else F.col("sens")
    return edges.select(
        "edge_id", salted_hash(F.col("content"), config.salt, config.bits).alias("content_hash"), time_bucket(F.col("ts"), config.minutes).alias("ts"),
        pseudonym(F.col("from_agent"), config.salt).alias("from_agent"), pseudonym(F.col("to_agent"), config.salt).alias("to_agent"),
        (F.col("domains") if keep is None else generalized(F.col("domains"), keep, config.parents)).alias("domains"), sens.alias("sens"),
        (noise.response(F.col("violation"), u("violation"), e.edge) if e else F.col("violation")).alias("violation"), *kept, *names,
    )


def response_domains(domains: Column, key: Column, seed: str, epsilon: float) -> Column:
    """Randomized response on each known domain; it destroys what the audit looks for, so it is asked for by name."""
    each = [F.when(noise.response(F.array_contains(domains, d), noise.uniform(f"{seed}:{d}", key), epsilon), F.lit(d)) for d in KNOWN_DOMAINS]
    return F.array_compact(F.array(*each))


def dummies_wanted(n_edges: int, share: float = 0.2) -> int:
    """How many made-up edges go with a report."""
    return max(1, int(n_edges * share)) if n_edges > 0 else 0


def desensitize_taint(edges: DataFrame, salt: str) -> DataFrame:
    """edges with t_subject and t_principal as eight digits of a salted hash ('' and 'multi' stay) and t_risk to one decimal."""
    h = lambda c: F.when((c == "") | (c == "multi"), c).otherwise(F.substring(F.sha2(F.concat_ws(":", F.lit(salt), c), 256), 1, 8))
    return edges.withColumns({"t_subject": h(F.col("t_subject")), "t_principal": h(F.col("t_principal")), "t_risk": F.bround("t_risk", 1)})


def audit_modes(totals: DataFrame, e: Epsilons | None = None, text_length: int = 200) -> DataFrame:
    """(mode, privacy, detection) of a central, a local and a federated audit, from rows of (agents, edges, risks): what share of the content stays, and of the risks is seen."""
    content = F.col("agents") * F.col("edges") * F.lit(text_length * 4.5)
    leaked = F.col("edges") * F.lit(80.0)
    if e is not None:
        per_report = F.floor(F.col("edges") / F.greatest(F.col("agents"), F.lit(1))) * (e.edge + e.sensitivity + e.domains) + 4 * e.stats
        leaked = leaked * F.least(F.lit(1.0), per_report / 10.0)
    alone = F.when(F.col("edges") > 0, F.greatest(F.lit(0), F.col("edges") - F.col("risks")) / F.col("edges")).otherwise(1.0)
    joined = F.least(F.lit(1.0), alone + F.when(F.col("edges") > 0, F.col("risks") / F.col("edges")).otherwise(0.0))
    kept = F.when(content > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - leaked / content))).otherwise(1.0)
    rows = [("centralized", F.lit(0.0), F.lit(1.0)), ("local_only", F.lit(1.0), alone), ("federated", kept, joined)]
    return totals.select(F.inline(F.array(*[F.struct(F.lit(m).alias("mode"), p.cast("double").alias("privacy"), d.cast("double").alias("detection")) for m, p, d in rows])))


def dummy_edges(spark: SparkSession, agents: list[str], n: int, salt: str) -> DataFrame:
    """n made-up edges between distinct agents of a list, of sensitivity 0 to 2 and the general domain."""
    if len(agents) < 2 or n <= 0:
        return spark.createDataFrame([], "edge_id string, from_agent string, to_agent string, content_hash string, sens int, domains array<string>, violation boolean")
    names, m = F.array(*map(F.lit, agents)), len(agents)
    u = lambda what: noise.uniform(f"{salt}:{what}", F.col("id"))
    a, b = F.floor(u("from") * m).cast("int"), F.floor(u("to") * (m - 1)).cast("int")
    rows = spark.range(n).withColumns({"a": a, "b": b}).withColumn("b", F.col("b") + F.when(F.col("b") >= F.col("a"), 1).otherwise(0))
    return rows.select(
        F.concat(F.lit("d_"), F.substring(F.sha2(F.concat_ws(":", F.lit(salt), "id"), 256), 1, 8)).alias("edge_id"),
        pseudonym(F.element_at(names, F.col("a") + 1), salt).alias("from_agent"), pseudonym(F.element_at(names, F.col("b") + 1), salt).alias("to_agent"),
        salted_hash(F.concat(F.lit("dummy_"), F.col("id"), F.lit(f"_{salt}")), salt).alias("content_hash"), F.floor(u("sens") * 3).cast("int").alias("sens"),
        F.array(F.lit("general")).alias("domains"), F.lit(False).alias("violation"),
    )


def perturb_reports(reports: DataFrame, epsilon: float, seed: str) -> DataFrame:
    """Noise on total, violations and redactions, and on the rate; all other columns stay."""
    u = lambda what: noise.uniform(f"{seed}:{what}", F.col("agent"))
    b = F.lit(1.0) / F.greatest(F.col("total"), F.lit(1)) / F.lit(float(epsilon))
    wave = -b * F.signum(u("rate") - 0.5) * F.ln(1 - 2 * F.abs(u("rate") - 0.5))
    return reports.withColumns(
        {c: noise.noisy_count(F.col(c), u(c), epsilon) for c in ("total", "violations", "redactions")} | {"rate": F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("rate") + wave))}
    )


def budget_ledger(spends: DataFrame, limit: float) -> DataFrame:
    """(owner, granted, refused, spent): requests in order of ``seq``; one that would go beyond the limit is refused and costs nothing."""
    start = F.struct(F.lit(0).cast("bigint").alias("granted"), F.lit(0).cast("bigint").alias("refused"), F.lit(0.0).alias("spent"))

    def step(s: Column, x: Column) -> Column:
        ok = s.spent + x.epsilon <= limit + 1e-12
        return F.struct((s.granted + ok.cast("bigint")).alias("granted"), (s.refused + (~ok).cast("bigint")).alias("refused"), (s.spent + F.when(ok, x.epsilon).otherwise(0.0)).alias("spent"))

    held = spends.groupBy("owner").agg(F.array_sort(F.collect_list(F.struct("seq", "epsilon"))).alias("x"))
    return held.select("owner", F.aggregate("x", start, step).alias("s")).select("owner", "s.*")


def composition(reports: DataFrame, e: Epsilons) -> DataFrame:
    """Basic and advanced composition (whichever is less) for rows of (n_edges, n_reports)."""
    each = e.edge + e.sensitivity + e.domains
    top = max(e.edge, e.sensitivity, e.domains, e.stats)
    basic = F.col("n_reports") * (F.col("n_edges") * each + 4 * e.stats)
    k = F.col("n_reports") * (F.col("n_edges") + 4)
    advanced = F.when(k > 0, F.sqrt(2 * k * math.log(1 / DELTA)) * top + k * (top * (math.exp(top) - 1))).otherwise(basic)
    return reports.withColumns({"per_report": F.col("n_edges") * each + F.lit(4 * e.stats), "basic": basic.cast("double"), "advanced": F.least(advanced, basic).cast("double")})


def field_retention(entries: DataFrame) -> DataFrame:
    """(entry_id, field, original_bits, retained_bits, ratio): text and metadata go, levels, tags, agent and time stay, the action becomes one of six types."""
    n = F.greatest(F.size("tags"), F.lit(1)).cast("double")
    six = math.log2(6)
    rows = [
        ("output_text", F.length("output_text") * 4.5, 0.0, 0.0), ("input_text", F.length("input_text") * 4.5, 0.0, 0.0), ("sensitivity_level", six, six, 1.0),
        ("tags", n, F.size("tags").cast("double"), 1.0), ("agent_id", 16.0, 16.0, 1.0), ("action", 8.0, six, six / 8), ("timestamp", 32.0, 32.0, 1.0), ("metadata", 64.0, 0.0, 0.0),
    ]
    double = lambda x: x.cast("double") if isinstance(x, Column) else F.lit(float(x))
    each = F.array(*[F.struct(F.lit(f).alias("field"), double(a).alias("original_bits"), double(b).alias("retained_bits"), double(r).alias("ratio")) for f, a, b, r in rows])
    return entries.select("entry_id", F.inline(each))


def noise_bits(e: Epsilons | None) -> float:
    """Bits that the noise of one report takes away."""
    if e is None:
        return 0.0
    p = noise.truth_share(e.edge)
    h = -p * math.log2(p) - (1 - p) * math.log2(1 - p) if 0 < p < 1 else 0.0
    return 1 + math.log2(2 / e.sensitivity) + 7 * h + 4 * (1 + math.log2(2 / e.stats))


def reconstruction_bound(entries: DataFrame, e: Epsilons | None = None) -> DataFrame:
    """(entry_id, original_bits, retained_bits, noise_bits, ratio) of what a central auditor could rebuild at most."""
    sums = field_retention(entries).groupBy("entry_id").agg(F.sum("original_bits").alias("original_bits"), F.sum("retained_bits").alias("retained_bits"))
    bits = noise_bits(e)
    left = F.greatest(F.lit(0.0), F.col("retained_bits") - bits)
    return sums.withColumns({"noise_bits": F.lit(bits), "ratio": F.when(F.col("original_bits") > 0, left / F.col("original_bits")).otherwise(0.0)})


def tree_counter(counts: DataFrame, epsilon: float, seed: str, levels: int = 20) -> DataFrame:
    """(owner, t, noisy, exact): running counts of (owner, t, n), t = 1, 2, ...: a prefix is the sum of the dyadic blocks by the bits of t, and every complete block has one noise."""
    at = F.col("t") - 1
    blocks = counts.select("owner", F.explode(F.sequence(F.lit(0), F.lit(levels))).alias("level"), at.alias("i"), "n")
    width = F.expr("shiftleft(1L, level)")
    blocks = blocks.groupBy("owner", "level", F.floor(F.col("i") / width).alias("block")).agg(F.sum("n").alias("n"))
    u = noise.uniform(seed, F.col("owner"), F.col("level"), F.col("block"))
    blocks = blocks.withColumn("noisy", F.col("n") + noise.laplace(u, levels / epsilon))
    need = counts.select("owner", "t", F.explode(F.expr(f"filter(sequence(0, {levels}), l -> shiftright(t, l) % 2 = 1)")).alias("level"))
    need = need.withColumn("block", F.expr("(shiftright(cast(t as bigint), level + 1) * 2)"))
    return need.join(blocks, ["owner", "level", "block"]).groupBy("owner", "t").agg(F.sum("noisy").alias("noisy"), F.sum("n").alias("exact"))


def verify_desensitized(edges: DataFrame) -> DataFrame:
    """edges with ``problems``: a hash that isn't 64 long, a type that reads like text, a level out of range, unknown domains."""
    odd = F.array_except("domains", F.array(*map(F.lit, KNOWN_DOMAINS)))
    wordy = ~F.col("message_type").isin(*MESSAGE_TYPES) & (F.size(F.split(F.trim("message_type"), "\\s+")) > 2)
    return edges.withColumn(
        "problems",
        F.array_compact(
            F.array(
                F.when((F.col("content_hash") != "") & (F.length("content_hash") != 64), F.lit("hash_length")), F.when(wordy, F.lit("message_type")),
                F.when(~F.col("sens").between(0, 5), F.lit("level")), F.when(F.size(odd) > 0, F.lit("domains")),
            )
        ),
    )
