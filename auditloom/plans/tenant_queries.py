"""Queries of tenant audits, commitments and memory audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditloom.operators import commitments as C
from auditloom.operators import memory as M
from auditloom.operators import tenants as A
from auditloom.plans.text_queries import lit
from auditloom.registry import query
from auditloom.sources.interaction import CTES, as_edges, edges, items, nodes, numbered_nodes, receiver
from auditloom.sources.tables import table


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tainted edges as labelled parts. The owner's neighbour (tenant + 1 of 25) may receive; quiet parts hint at their domains, health strongly."""
    to = numbered_nodes(spark, sf_dir).select("number", F.col("owner").alias("to_principal"))
    e = as_edges(items(spark, sf_dir).where("l_returnflag <> 'N'").join(to, receiver() == F.col("number")), "to_principal")
    k = F.regexp_extract("t_principal", "[0-9]+", 0).cast("int")
    return e.select(
        F.col("edge_id").alias("message_id"), "ts", "from_agent", "to_agent", "to_principal", F.col("t_subject").alias("subject"), F.col("t_principal").alias("owner"), "sens",
        F.when(F.col("sens") >= 3, F.col("domains")).otherwise(F.array().cast("array<string>")).alias("category"), F.when(F.col("sens") < 3, F.col("domains")).otherwise(F.array().cast("array<string>")).alias("inferred"),
        F.create_map(F.lit("health"), F.lit(9.0)).alias("lambdas"), F.array(F.concat(F.lit("tenant:"), (k + 1) % 25)).alias("allowed"), F.slice("domains", 1, 1).alias("purpose"), F.lit(2).alias("ttl"),
        F.concat_ws("/", "t_subject", F.get("domains", F.lit(0))).alias("provenance"), F.md5("edge_id").alias("content_hash"),
    )


LB = CTES + """, lb AS MATERIALIZED (SELECT edge_id AS message_id, ts, from_agent, to_agent, n.owner AS to_principal, t_subject AS subject, t_principal AS owner, sens, CASE WHEN sens >= 3 THEN domains ELSE [] END AS category,
  CASE WHEN sens < 3 THEN domains ELSE [] END AS inferred, ['tenant:' || ((CAST(substr(t_principal, 8) AS INTEGER) + 1) % 25)] AS allowed, domains[1:1] AS purpose, n.scope AS purposes,
  concat_ws('/', t_subject, domains[1]) AS provenance, md5(edge_id) AS content_hash FROM edges JOIN nodes n ON n.agent = to_agent WHERE t_subject IS NOT NULL) """
_V = "message_id, subject, owner, to_principal AS recipient"


def _six(df: DataFrame) -> DataFrame:
    return df.withColumn("severity", F.round("severity", 6))


@query(LB + f"SELECT 'cross_tenant_disclosure' AS violation, {_V}, round(least(1.0, sens / 5.0), 6) AS severity FROM lb WHERE to_principal <> owner AND NOT list_contains(allowed, to_principal) AND sens >= 3")
def tenant_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _six(A.disclosure(labels(spark, sf_dir)))


@query(LB + f"SELECT 'purpose_violation' AS violation, {_V}, round(least(1.0, greatest(sens, 2) / 5.0), 6) AS severity FROM lb WHERE len(purpose) > 0 AND len(purposes) > 0 AND NOT list_has_any(purpose, purposes)")
def tenant_purpose(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _six(A.purpose(labels(spark, sf_dir), nodes(spark, sf_dir).select("agent", F.col("scope").alias("purposes"))))


@query(LB + f"SELECT 'ttl_violation' AS violation, {_V}, round(least(1.0, 0.4 + 0.2 * (hop - 2)), 6) AS severity FROM (SELECT *, row_number() OVER (PARTITION BY provenance ORDER BY ts, message_id) AS hop FROM lb) WHERE hop > 2")
def tenant_ttl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _six(A.time_to_live(A.hops(labels(spark, sf_dir))))


@query(
    LB + f""", told AS (SELECT DISTINCT to_principal, subject, unnest(category) AS c FROM lb WHERE to_principal = owner OR list_contains(allowed, to_principal)),
    fr AS (SELECT to_principal, subject, c, content_hash, max(CASE WHEN c = 'health' THEN 9.0 ELSE 3.0 END) AS r FROM (SELECT *, unnest(inferred) AS c FROM lb) WHERE c IN {A.SENSITIVE} GROUP BY 1, 2, 3, 4),
    g AS (SELECT to_principal, subject, c, count(*) AS fragments, 1 - 1 / (1 + 0.1 / 0.9 * product(CAST(r AS DOUBLE))) - 0.1 AS gain FROM fr GROUP BY 1, 2, 3)
    SELECT to_principal AS recipient, subject, c AS category, fragments, round(gain, 6) AS gain, round(least(1.0, gain + 0.1), 6) AS severity FROM g WHERE gain >= 0.3 AND NOT EXISTS (SELECT 1 FROM told t WHERE t.to_principal = g.to_principal AND t.subject = g.subject AND t.c = g.c)"""
)
def tenant_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _six(A.inference(labels(spark, sf_dir))).withColumn("gain", F.round("gain", 6))


def _ps(x: str) -> str:
    return f"'ps:' || substr(sha256('s:' || {x}), 1, 12)"


@query(LB + f"SELECT message_id, {_ps('subject')} AS subject, {_ps('owner')} AS owner, {_ps('to_principal')} AS to_principal, {_ps('allowed[1]')} AS allowed FROM lb")
def tenant_hardened(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = A.harden(labels(spark, sf_dir), "s")
    return h.select("message_id", "subject", "owner", "to_principal", F.get("allowed", F.lit(0)).alias("allowed"))


@query("SELECT k, round(1 - 1 / (1 + 0.1 / 0.9 * pow(3, k)), 6) AS posterior, round(1 - 1 / (1 + 0.1 / 0.9 * pow(3, k)) - 0.1, 6) AS gain, k >= 2 AS fires FROM (SELECT DISTINCT CAST(n_nationkey AS BIGINT) AS k FROM nation)")
def inference_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("bigint").alias("k")).distinct()
    g = A.gain(F.col("k"))
    return k.select("k", F.round(g + A.PRIOR, 6).alias("posterior"), F.round(g, 6).alias("gain"), (F.col("k") >= A.fragments_to_fire()).alias("fires"))


_TOK = "list_distinct(list_filter(regexp_extract_all(lower(text), '([a-z0-9]+)', 1), lambda w: length(w) >= 4))"


@query(
    f"""WITH w AS (SELECT doc_id AS message_id, unnest({_TOK}) AS word FROM documents), v AS (SELECT DISTINCT unnest({_TOK}) AS word FROM benchmark), l AS (SELECT DISTINCT lower(source) AS word FROM documents)
    SELECT DISTINCT message_id FROM w WHERE word IN (SELECT word FROM v) AND word NOT IN (SELECT word FROM l WHERE word IS NOT NULL)"""
)
def tenant_raw_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of which a word is among those of the benchmark items, which stand for the center's view."""
    docs = table(spark, sf_dir, "documents")
    view = table(spark, sf_dir, "benchmark").select(F.explode(A.content_tokens(F.col("text"))).alias("word"))
    return A.raw_leaks(docs.select(F.col("doc_id").alias("message_id"), "text"), view, docs.select(F.lower("source").alias("word")))


@query(
    """WITH RECURSIVE l AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, sha256(CAST(event_id AS VARCHAR)) AS h, count(*) OVER (PARTITION BY user_id) AS n FROM events
    UNION ALL SELECT user_id, i // 2, sha256(h || coalesce(nx, h)), (n + 1) // 2 FROM (SELECT *, lead(h) OVER (PARTITION BY user_id ORDER BY i) AS nx FROM l WHERE n > 1) WHERE i % 2 = 0),
    c AS (SELECT user_id, count(*) AS leaves FROM events GROUP BY 1)
    SELECT user_id, h AS root, CAST(leaves AS INTEGER) AS leaves FROM l JOIN c USING (user_id) WHERE n = 1"""
)
def merkle_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.merkle_roots(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "event_id")


@query("SELECT user_id, count(*) AS proofs, true AS all_valid FROM events GROUP BY 1")
def merkle_proofs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A proof of every event verifies against its root."""
    p = C.merkle_proofs(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "event_id")
    ok = C.verify_proof(F.col("leaf"), F.col("proof"), F.col("root"))
    return p.groupBy("user_id").agg(F.count("*").alias("proofs"), F.bool_and(ok).alias("all_valid"))


KEY = b"attestation"


def _reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    e = table(spark, sf_dir, "events")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return e.select(F.col("user_id").alias("agent"), F.row_number().over(w).alias("seq"), F.sha2(F.col("event_id").cast("string"), 256).alias("digest"))


@query(
    f"""WITH r AS (SELECT user_id AS agent, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, sha256(CAST(event_id AS VARCHAR)) AS digest FROM events),
    p AS (SELECT *, coalesce(lag(digest) OVER (PARTITION BY agent ORDER BY seq), 'genesis') AS previous FROM r)
    SELECT agent, CAST(seq AS INTEGER) AS seq, sha256(CAST('{"".join(f"\\x{b ^ 0x5C:02X}" for b in KEY.ljust(64, b"\0"))}' AS BLOB) || unhex(sha256(CAST('{"".join(f"\\x{b ^ 0x36:02X}" for b in KEY.ljust(64, b"\0"))}' AS BLOB) || encode(concat_ws('|', agent, seq, digest, previous))))) AS signature FROM p"""
)
def attested_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.attest(_reports(spark, sf_dir), KEY, "agent", "seq", "digest").select("agent", "seq", "signature")


@query(
    """WITH r AS (SELECT user_id AS agent, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq FROM events)
    SELECT CASE WHEN seq % 11 = 0 THEN 'chain' WHEN seq % 7 = 0 THEN 'signature' ELSE 'ok' END AS verdict, count(*) AS reports FROM r GROUP BY 1"""
)
def attestation_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh signature is false, and every eleventh predecessor."""
    a = C.attest(_reports(spark, sf_dir), KEY, "agent", "seq", "digest")
    bad = a.withColumns({"signature": F.when(F.col("seq") % 7 == 0, "forged").otherwise(F.col("signature")), "previous": F.when(F.col("seq") % 11 == 0, "other").otherwise(F.col("previous"))})
    return C.verify_attested(bad, KEY, "agent", "seq", "digest").groupBy("verdict").agg(F.count("*").alias("reports"))


@query(CTES + "SELECT edge_count_ok, violations_ok, count(*) AS agents FROM (SELECT from_agent, count(*) = count(*) FILTER (WHERE sens < 5) AS edge_count_ok, count(*) FILTER (WHERE violation) <= count(*) FILTER (WHERE violation AND sens > 0) AS violations_ok FROM edges GROUP BY 1) GROUP BY 1, 2")
def container_challenges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agents that leave out edges of level 5 and violations of level 0 from what they claim."""
    e = edges(spark, sf_dir)
    r = e.groupBy(F.col("from_agent").alias("agent")).agg(F.count_if(F.col("sens") < 5).alias("claimed_edges"), F.count_if(F.col("violation") & (F.col("sens") > 0)).alias("claimed_violations"))
    return C.challenges(r, e).groupBy("edge_count_ok", "violations_ok").agg(F.count("*").alias("agents"))


@query(CTES + "SELECT to_agent, count(*) AS missing FROM edges a WHERE NOT EXISTS (SELECT 1 FROM edges b WHERE NOT b.violation AND a.from_agent = b.from_agent AND a.to_agent = b.to_agent AND a.edge_id = b.edge_id) GROUP BY 1")
def unmatched_receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Senders that report no edge with a violation."""
    e = edges(spark, sf_dir).withColumn("content_hash", F.sha2("edge_id", 256))
    return C.unmatched_receipts(e.select("from_agent", "to_agent", "content_hash"), e.where("not violation")).groupBy("to_agent").agg(F.count("*").alias("missing"))


@query(CTES + "SELECT b.sens <> 5 AS same, count(*) AS edges FROM edges a JOIN edges b ON a.edge_id = b.edge_id AND NOT b.violation GROUP BY 1")
def peer_verification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Receivers know no edge with a violation, and other hashes at level 5."""
    e = edges(spark, sf_dir).withColumn("content_hash", F.sha2("edge_id", 256))
    theirs = e.where("not violation").withColumn("content_hash", F.when(F.col("sens") == 5, F.lit("other")).otherwise(F.col("content_hash")))
    return C.peer_verified(e, theirs).groupBy("same").agg(F.count("*").alias("edges"))


@query("SELECT doc_id, sha256('{\"doc_id\":' || doc_id || ',\"lang\":\"' || lang || '\",\"source\":\"' || source || '\"}') AS token FROM documents")
def verification_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", C.token(["doc_id", "lang", "source"]).alias("token"))


_N = lambda ps: " + ".join(f"CAST(regexp_matches(text, {lit(p)}) AS INTEGER)" for p in ps)


@query(
    f"""SELECT entry_id, kind, matches, round(least(1.0, CASE kind WHEN 'injection_attempt' THEN matches * 0.25 + 0.2 ELSE matches * 0.2 + 0.3 END), 6) AS severity FROM (
    SELECT doc_id AS entry_id, 'injection_attempt' AS kind, {_N(M.INJECTION)} AS matches FROM documents UNION ALL SELECT doc_id, 'extraction_probe', {_N(M.EXTRACTION)} FROM documents) WHERE matches > 0"""
)
def memory_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document both as a memory write and as a read."""
    e = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("entry_id"), F.col("source").alias("agent"), F.explode(F.array(F.lit("memory_write"), F.lit("memory_read"))).alias("action"), F.col("text").alias("output_text"), F.lit("").alias("input_text"))
    return _six(M.memory_findings(e)).drop("agent")


@query(CTES + "SELECT d AS domain, count(*) AS edges FROM (SELECT unnest(list_filter(domains, lambda x: x NOT IN ('health', 'social'))) AS d FROM edges WHERE sens >= 1) GROUP BY 1")
def memory_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges above level 0 as memory writes that are authorized for health and social domains."""
    e = edges(spark, sf_dir).select(F.col("edge_id").alias("entry_id"), F.col("from_agent").alias("agent"), F.when(F.col("sens") >= 1, "memory_write").otherwise("tool_call").alias("action"), "domains")
    return M.scope_violations(e, ["health", "social"]).select(F.explode("outside").alias("domain")).groupBy("domain").agg(F.count("*").alias("edges"))


def _sql_cats(t: dict) -> str:
    return ", ".join(f"CASE WHEN regexp_matches(lower(text), {lit(M.whole(v))}) THEN {lit(k)} END" for k, v in sorted(t.items()))


@query(
    f"""WITH t AS (SELECT doc_id, list_distinct(list_filter([{_sql_cats(M.STATED | M.NEUTRAL)}], lambda x: x IS NOT NULL)) AS c, list_filter([{_sql_cats(M.HINTED)}], lambda x: x IS NOT NULL) AS h, [{_sql_cats(M.STRONG)}] AS s FROM documents),
    u AS (SELECT doc_id, c, list_filter(h, lambda x: NOT list_contains(c, x)) AS i, s FROM t)
    SELECT doc_id, array_to_string(list_sort(c), ',') AS category, array_to_string(list_sort(i), ',') AS inferred, array_to_string(list_sort(list_filter(i, lambda x: list_contains(s, x))), ',') AS strong FROM u"""
)
def lexical_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array(M.tag_bits(F.col("text")))).alias("bits"))
    return d.select("doc_id", *[F.array_join(v, ",").alias(k) for k, v in M.tags_of(F.col("bits")).items()])
