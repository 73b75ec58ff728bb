"""Queries of desensitization and differential privacy over the interaction graph, documents and events."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditloom.functions.noise import laplace_sql, noisy_count_sql, response_sql, truth_share, uniform_sql
from auditloom.operators import privacy as P
from auditloom.registry import query
from auditloom.sources.interaction import CTES, edges
from auditloom.sources.tables import table

SALT = "epoch-1"
EPS = P.Epsilons()


def _h(x: str, n: int) -> str:
    return f"substr(sha256('{SALT}:' || {x}), 1, {n})"


def _node(x: str) -> str:
    return f"'node_' || {_h(x, 12)}"


_U = lambda what, key="edge_id": uniform_sql(f"{SALT}:{what}", key)
_PARENT = "CASE d " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in P.PARENTS.items()) + " ELSE 'general' END"
_KEEP = "(SELECT list(d) FROM (SELECT d FROM (SELECT from_agent, unnest(domains) AS d FROM edges) GROUP BY d HAVING count(DISTINCT from_agent) >= 500))"
#: Parents come at the place of the first rare domain that has them.
_GENERAL = f"""list_reduce(list_prepend([], list_transform(domains, lambda d: [CASE WHEN list_contains(k.keep, d) THEN d ELSE {_PARENT} END])),
    lambda a, b: CASE WHEN list_contains(a, b[1]) AND NOT list_contains(k.keep, b[1]) THEN a ELSE list_concat(a, b) END)"""


@query(
    CTES + f""", k AS MATERIALIZED (SELECT coalesce({_KEEP}, []) AS keep), g AS (SELECT edges.*, {_GENERAL} AS gd FROM edges, k)
    SELECT edge_id, {_h('edge_id', 32)} AS content_hash, CAST(date_trunc('day', ts) AS TIMESTAMP) AS ts, {_node('from_agent')} AS from_agent, {_node('to_agent')} AS to_agent,
    array_to_string(CASE WHEN len(gd) > 0 THEN gd ELSE ['general'] END, ',') AS domains, CAST(least(5, {noisy_count_sql('sens', _U('sens'), 1.0)}) AS INTEGER) AS sens, {response_sql('violation', _U('violation'), 1.0)} AS violation FROM g"""
)
def desensitized_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All edges as a central auditor gets them; k = 500 agents, as every domain here has hundreds."""
    e = edges(spark, sf_dir).withColumn("content", F.col("edge_id"))
    out = P.desensitize(e, P.Config(SALT, minutes=1440, epsilons=EPS), P.frequent_domains(e, 500))
    return out.select("edge_id", "content_hash", "ts", "from_agent", "to_agent", F.array_join("domains", ",").alias("domains"), "sens", "violation")


@query(
    f"""SELECT 'd_' || {_h('CAST(id AS VARCHAR)', 8)} AS edge_id, {_node('names[a + 1]')} AS from_agent, {_node('names[b + 1]')} AS to_agent, {_h(f"'dummy_' || id || '_{SALT}'", 32)} AS content_hash, s AS sens FROM (
    SELECT id, names, a, CASE WHEN b >= a THEN b + 1 ELSE b END AS b, s FROM (SELECT id, names, CAST(floor({_U('from', 'id')} * len(names)) AS INTEGER) AS a, CAST(floor({_U('to', 'id')} * (len(names) - 1)) AS INTEGER) AS b,
    CAST(floor({_U('sens', 'id')} * 3) AS INTEGER) AS s FROM (SELECT unnest(range(0, 500)) AS id), (SELECT list('tenant:' || n_nationkey ORDER BY n_nationkey) AS names FROM nation)))"""
)
def dummy_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = [f"tenant:{r[0]}" for r in table(spark, sf_dir, "nation").select("n_nationkey").orderBy("n_nationkey").collect()]  # 25 rows
    return P.dummy_edges(spark, names, 500, SALT).drop("domains", "violation")


_RU = lambda what: uniform_sql(f"{SALT}:{what}", "agent")
_RATE_U = _RU("rate")


@query(
    CTES + f""", r AS (SELECT from_agent AS agent, count(*) AS total, count(*) FILTER (WHERE violation) AS violations, count(*) FILTER (WHERE sens >= 4) AS redactions FROM edges GROUP BY 1)
    SELECT agent, {', '.join(f"{noisy_count_sql(c, _RU(c), 1.0)} AS {c}" for c in ('total', 'violations', 'redactions'))},
    round(greatest(0.0, least(1.0, CAST(violations AS DOUBLE) / total + {laplace_sql(_RATE_U, 1.0)} / greatest(total, 1))), 6) AS rate FROM r"""
)
def noisy_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = edges(spark, sf_dir).groupBy(F.col("from_agent").alias("agent")).agg(F.count("*").alias("total"), F.count_if("violation").alias("violations"), F.count_if(F.col("sens") >= 4).alias("redactions"))
    return P.perturb_reports(r.withColumn("rate", F.col("violations") / F.col("total")), 1.0, SALT).withColumn("rate", F.round("rate", 6))


def _responses(seed: str) -> str:
    return "[" + ", ".join(f"CASE WHEN {response_sql(f'list_contains(domains, {d!r})', uniform_sql(f'{seed}:{d}', 'edge_id'), 1.0)} THEN '{d}' END" for d in P.KNOWN_DOMAINS) + "]"


@query(CTES + f"SELECT d AS domain, count(*) AS edges FROM (SELECT unnest({_responses(SALT)}) AS d FROM edges) WHERE d IS NOT NULL GROUP BY 1")
def randomized_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many edges report each domain after a randomized response."""
    d = P.response_domains(F.col("domains"), F.col("edge_id"), SALT, 1.0)
    return edges(spark, sf_dir).select(F.explode(d).alias("domain")).groupBy("domain").agg(F.count("*").alias("edges"))


@query()
def budget_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event asks for as many hundredths of a budget of 20 as its value has tens."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("owner"), F.struct("ts", "event_id").alias("seq"), (F.floor(F.col("value") / 10) / 100).alias("epsilon"))
    return P.budget_ledger(e, 20.0).withColumn("spent", F.round("spent", 6))


@query(
    f"""SELECT n_edges, n_reports, n_edges * 3 + 4.0 AS per_report, CAST(n_reports * (n_edges * 3 + 4.0) AS DOUBLE) AS basic,
    round(least(CASE WHEN n_reports > 0 THEN sqrt(2 * n_reports * (n_edges + 4) * {math.log(1e5)!r}) + n_reports * (n_edges + 4) * {math.e - 1!r} ELSE 0 END, n_reports * (n_edges * 3 + 4.0)), 6) AS advanced
    FROM (SELECT CAST(o_custkey AS BIGINT) AS c, count(*) AS n_reports FROM orders GROUP BY 1), (SELECT unnest([1, 10, 100]) AS n_edges) GROUP BY n_edges, n_reports"""
)
def composition_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For the numbers of reports that customers have sent."""
    n = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n_reports")).select("n_reports").distinct()
    return P.composition(n.withColumn("n_edges", F.explode(F.array(F.lit(1), F.lit(10), F.lit(100)))), EPS).withColumn("advanced", F.round("advanced", 6))


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("entry_id"), F.col("text").alias("output_text"), F.col("source").alias("input_text"), F.array(F.col("lang"), F.col("source")).alias("tags"))


_P = truth_share(1.0)
_BITS = P.noise_bits(EPS)
_KEPT = 2 * math.log2(6) + 48 + 2
_ORIG = f"(length(text) * 4.5 + length(source) * 4.5 + {math.log2(6) + 2 + 16 + 8 + 32 + 64!r})"


@query(f"SELECT doc_id AS entry_id, round({_ORIG}, 4) AS original_bits, round({_KEPT!r}, 4) AS retained_bits, round({_BITS!r}, 4) AS noise_bits, round(greatest(0.0, {_KEPT!r} - {_BITS!r}) / {_ORIG}, 6) AS ratio FROM documents")
def reconstruction_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = P.reconstruction_bound(_entries(spark, sf_dir), EPS)
    return r.select("entry_id", *[F.round(c, 4).alias(c) for c in ("original_bits", "retained_bits", "noise_bits")], F.round("ratio", 6).alias("ratio"))


@query(
    f"""SELECT field, count(*) AS entries, round(sum(o), 2) AS original_bits, round(sum(r), 2) AS retained_bits FROM (
    SELECT unnest(['output_text', 'input_text', 'sensitivity_level', 'tags', 'agent_id', 'action', 'timestamp', 'metadata']) AS field,
    unnest([length(text) * 4.5, length(source) * 4.5, {math.log2(6)!r}, 2.0, 16.0, 8.0, 32.0, 64.0]) AS o, unnest([0.0, 0.0, {math.log2(6)!r}, 2.0, 16.0, {math.log2(6)!r}, 32.0, 0.0]) AS r FROM documents) GROUP BY field"""
)
def field_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = P.field_retention(_entries(spark, sf_dir))
    return f.groupBy("field").agg(F.count("*").alias("entries"), F.round(F.sum("original_bits"), 2).alias("original_bits"), F.round(F.sum("retained_bits"), 2).alias("retained_bits"))


_TU = uniform_sql(SALT, "owner", "level", "block")


@query(
    f"""WITH d AS (SELECT user_id AS owner, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) + 1 AS t, count(*) AS n FROM events GROUP BY 1, 2),
    f AS (SELECT o.owner, x.t, coalesce(d.n, 0) AS n FROM (SELECT DISTINCT owner FROM d) o CROSS JOIN (SELECT unnest(range(1, 33)) AS t) x LEFT JOIN d ON d.owner = o.owner AND d.t = x.t),
    b AS (SELECT owner, level, (t - 1) // (1 << level) AS block, sum(n) AS n FROM f, (SELECT unnest(range(0, 6)) AS level) GROUP BY 1, 2, 3),
    z AS (SELECT *, n + {laplace_sql(_TU, 5.0)} AS noisy FROM b)
    SELECT f.owner, f.t, round(sum(z.noisy), 6) AS noisy, CAST(sum(z.n) AS BIGINT) AS exact FROM f, (SELECT unnest(range(0, 6)) AS l) JOIN z ON z.owner = f.owner AND z.level = l AND (f.t >> l) % 2 = 1 AND z.block = (f.t >> (l + 1)) * 2 GROUP BY 1, 2"""
)
def tree_counter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running counts of events by day, for 32 days."""
    e = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("owner"), (F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")) + 1).alias("t")).agg(F.count("*").alias("n"))
    days = e.select("owner").distinct().withColumn("t", F.explode(F.sequence(F.lit(1), F.lit(32))))
    full = days.join(e, ["owner", "t"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("bigint")))
    return P.tree_counter(full, 1.0, SALT, 5).withColumn("noisy", F.round("noisy", 6))


@query(
    CTES + """SELECT p AS problem, count(*) AS edges FROM (SELECT unnest([CASE WHEN sens >= 4 THEN 'hash_length' END, CASE WHEN sens = 3 THEN 'message_type' END,
    CASE WHEN len(list_filter(domains, lambda d: d NOT IN ('finance', 'general', 'health', 'legal', 'schedule', 'social'))) > 0 THEN 'domains' END]) AS p FROM edges) WHERE p IS NOT NULL GROUP BY 1"""
)
def desensitization_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges whose hashes were cut from level 4 on and whose type is text at level 3."""
    h = F.sha2("edge_id", 256)
    e = edges(spark, sf_dir).withColumns({"content_hash": F.when(F.col("sens") >= 4, F.substring(h, 1, 32)).otherwise(h), "message_type": F.when(F.col("sens") == 3, "ask the doctor about it").otherwise("general")})
    return P.verify_desensitized(e).select(F.explode("problems").alias("problem")).groupBy("problem").agg(F.count("*").alias("edges"))
