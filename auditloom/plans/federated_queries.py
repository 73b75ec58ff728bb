"""Queries of both phases end to end: turns of conversations as entries, their audit, edges and reports, and the central audit over them; and of the recorder's log.

An agent is a role in a conversation; a turn goes to the role of the next turn, and the last turn is an internal action. System agents have no policy.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from auditloom.functions.patterns import DOMAINS, GATE_PII, INJECTION, STRUCTURED
from auditloom.functions.shared import written
from auditloom.operators import detectors as D
from auditloom.operators import hooks as H
from auditloom.operators import local_audit as L
from auditloom.operators import recorder as R
from auditloom.operators import text as T
from auditloom.operators.risks import alert_level
from auditloom.plans.graph_queries import _FP, SUITE_SQL
from auditloom.plans.text_queries import _LUHN, ABSTRACTIONS, RULES, _sql_grams, _sql_hit, _sql_jaccard, _sql_words, lit
from auditloom.registry import query
from auditloom.sources.interaction import pair_edges
from auditloom.sources.tables import table

POLICY = L.Policy("guarded", RULES, ABSTRACTIONS, ["onesen", "blueprint"])


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text", F.lead("role").over(w).alias("next"))
    name = lambda role: F.concat_ws(":", role, F.col("conv_id").cast("string"))
    out = F.col("next").isNotNull()
    e = c.select(
        F.col("conv_id").alias("trace"), F.col("turn").alias("seq"), F.concat_ws("-", "conv_id", "turn").alias("entry_id"), name(F.col("role")).alias("agent"), F.when(out, name(F.col("next"))).alias("to_agent"),
        F.when(out, "outbound_message").when(F.col("role") == "assistant", "refusal").otherwise("tool_call").alias("action"), F.lit("").alias("input_text"), F.col("text").alias("output_text"),
        T.domain_tags(F.col("text")).alias("domains"), F.timestamp_seconds(F.lit(1704067200) + F.col("conv_id") * 3600 + F.col("turn")).alias("ts"),
        F.when(F.col("role") == "user", F.concat_ws(":", F.lit("subj"), F.col("conv_id").cast("string"))).otherwise("").alias("subject"), "role",
    )
    return e.withColumn("sens", T.sensitivity(F.col("domains"), F.lit(False)))


def audited(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = entries(spark, sf_dir)
    policies = e.where("role <> 'system'").select("agent", F.lit(POLICY.name).alias("policy")).distinct()
    return L.audited(L.with_policy(e, policies), [POLICY])


def _sql_item(item: str) -> str:
    x = T.item_terms(item)
    lits = lambda xs: "[" + ", ".join(map(lit, xs)) + "]" if xs else "CAST([] AS VARCHAR[])"
    dot = " + ".join(f"len(list_filter(w, lambda z: z = {lit(k)})) * {c}" for k, c in x["count"].items()) or "0"
    cosine = f"CASE WHEN nn > 0 THEN CAST({dot} AS DOUBLE) / (nn * {x['norm']!r}) ELSE 0.0 END" if x["norm"] else "0.0"
    near = " OR ".join(f"contains(low, {lit(t)})" for t in x["group"]) or "false"
    return f"CASE WHEN contains(low, {lit(x['low'])}) THEN 1.0 WHEN {near} THEN 0.85 ELSE 0.3 * {_sql_jaccard('g', lits(x['grams']))} + 0.3 * {_sql_jaccard('dd', lits(x['words']))} + 0.4 * ({cosine}) END"


def sql_injection(ids: str, rel: str, col: str, source: str) -> str:
    """CTEs iv (ids, confidence, detected, kind) of a column of a relation; source is an expression over it."""
    count = {k: " + ".join(f"CASE WHEN {_sql_hit(p, col)} THEN 1 ELSE 0 END" for p in ps) for k, ps in INJECTION.items()}
    outside, by_tool = "src IN ('web', 'file', 'mcp', 'tool_return')", "src IN ('tool_return', 'mcp')"
    return f"""ie AS (SELECT {ids}, coalesce(-sum(p * log2(p)), 0) AS h FROM (SELECT {ids}, CAST(count(*) AS DOUBLE) / max(n) AS p FROM (SELECT {ids}, length({col}) AS n, unnest(string_split({col}, '')) AS ch FROM {rel}) GROUP BY {ids}, ch) GROUP BY {ids}),
    ic AS (SELECT {ids}, src, {', '.join(f'{c} AS {k}' for k, c in count.items())}, length({col}) > 50 AND abs(coalesce(h, 0) - 4.5) > 1.5 AS odd FROM (SELECT *, {source} AS src FROM {rel}) LEFT JOIN ie USING ({ids})),
    iv AS (SELECT {ids}, src, least(1.0, round(least(1.0, greatest(CASE WHEN role_override > 0 THEN 0.4 + 0.15 * role_override ELSE 0 END, CASE WHEN delimiter_escape > 0 THEN 0.6 + 0.1 * delimiter_escape ELSE 0 END,
      CASE WHEN indirect > 0 THEN CASE WHEN {outside} THEN 0.7 ELSE 0.3 END + 0.1 * indirect ELSE 0 END, CASE WHEN tool_injection > 0 THEN CASE WHEN {by_tool} THEN 0.6 + 0.1 * tool_injection ELSE 0.3 END ELSE 0 END,
      CASE WHEN exfiltration > 0 THEN 0.75 + 0.1 * exfiltration ELSE 0 END, CASE WHEN prompt_infection > 0 THEN CASE WHEN src = 'agent' THEN 0.7 ELSE 0.5 END + 0.15 * prompt_infection ELSE 0 END,
      CASE WHEN memory_attack > 0 THEN 0.5 + 0.1 * memory_attack ELSE 0 END, CASE WHEN encoding_evasion > 0 THEN 0.45 + 0.15 * encoding_evasion ELSE 0 END, CASE WHEN cross_agent_forgery > 0 THEN 0.55 + 0.1 * cross_agent_forgery ELSE 0 END)) + CASE WHEN odd THEN 0.1 ELSE 0 END, 9)) AS confidence,
      CASE WHEN cross_agent_forgery > 0 THEN 'indirect' WHEN memory_attack > 0 THEN 'direct' WHEN prompt_infection > 0 OR exfiltration > 0 THEN 'indirect' WHEN tool_injection > 0 AND {by_tool} THEN 'tool_mediated'
        WHEN indirect > 0 AND {outside} THEN 'indirect' WHEN delimiter_escape > 0 THEN 'delimiter_escape' ELSE 'direct' END AS kind,
      {' + '.join(INJECTION)} + CASE WHEN odd THEN 1 ELSE 0 END AS patterns FROM ic)"""


def _sql_redact(col: str) -> str:
    out = col
    for r in RULES:
        out = f"regexp_replace({out}, {lit(T.rule_pattern(r))}, {lit(ABSTRACTIONS.get(r, '[REDACTED]'))}, 'g')"
    for k in T.active_pii(RULES):
        out = f"regexp_replace({out}, {lit(GATE_PII[k][0])}, {lit(f'[{k.upper()}]')}, 'g')"
    return out


_M = "list_filter([" + ", ".join(f"CASE WHEN {_sql_hit(p)} THEN 1 END" for p in [T.rule_pattern(r) for r in RULES] + [GATE_PII[k][0] for k in T.active_pii(RULES)]) + "], lambda x: x IS NOT NULL)"
_FIELD = " OR ".join(f"len(list_filter(regexp_extract_all(shown, {lit(p)}), lambda m: {_LUHN})) > 0" if k == "credit_card" else _sql_hit(p, "shown") for k, p in STRUCTURED.items())
_TAGS = f"list_filter([{', '.join(f'CASE WHEN {_sql_hit(p)} THEN {lit(k)} END' for k, p in DOMAINS.items())}], lambda x: x IS NOT NULL)"
EN = f"""WITH RECURSIVE e0 AS (SELECT *, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS nxt, {_TAGS} AS tg FROM conversations),
e1 AS (SELECT conv_id AS trace, turn AS seq, conv_id || '-' || turn AS entry_id, role || ':' || conv_id AS agent, nxt || ':' || conv_id AS to_agent, nxt IS NOT NULL AS out_, role, text,
  CASE WHEN text = '' THEN [] WHEN len(tg) > 0 THEN tg ELSE ['general'] END AS domains, CAST(to_timestamp(1704067200 + conv_id * 3600 + turn) AS TIMESTAMP) AS ts FROM e0),
e2 AS (SELECT *, len(list_intersect(domains, ['health', 'finance', 'legal', 'identity'])) AS high FROM e1),
en AS (SELECT *, CAST(CASE WHEN high >= 2 THEN 5 WHEN high = 1 THEN 4 WHEN list_contains(domains, 'schedule') THEN 2 ELSE 1 END AS INTEGER) AS sens, role <> 'system' AS guarded FROM e2)"""
FOUND = (
    EN + f""", a1 AS (SELECT *, {_M} AS m FROM en), a2 AS (SELECT *, CASE WHEN guarded AND len(m) > 0 THEN 'redact' ELSE 'allow' END AS gate, CASE WHEN guarded THEN len(m) ELSE 0 END AS matched, CASE WHEN guarded AND len(m) > 0 AND out_ THEN {_sql_redact('text')} ELSE text END AS shown FROM a1),
    a3 AS (SELECT *, {_sql_grams('shown')} AS g, {_sql_words('shown')} AS w, lower(shown) AS low, {_FIELD} AS fld FROM a2), a4 AS (SELECT *, list_distinct(w) AS dd FROM a3),
    a5 AS (SELECT *, sqrt(coalesce(list_sum(list_transform(dd, lambda q: pow(len(list_filter(w, lambda z: z = q)), 2))), 0)) AS nn FROM a4),
    a6 AS (SELECT *, CASE WHEN guarded THEN greatest({', '.join(map(_sql_item, RULES))}, 0.0) ELSE 0.0 END AS top, guarded AND ({' OR '.join(f'contains(shown, {lit(c)})' for c in POLICY.canaries)}) AS canary FROM a5),
    a7 AS (SELECT *, CASE WHEN shown = '' THEN 'none' WHEN canary OR fld OR top >= 0.72 THEN 'full' WHEN top >= 0.45 THEN 'partial' ELSE 'none' END AS level FROM a6),
    a8 AS (SELECT *, CASE WHEN out_ AND level = 'full' THEN '' ELSE shown END AS final FROM a7), """
    + sql_injection("entry_id", "a8", "final", "'agent'")
    + """, fd AS MATERIALIZED (SELECT trace, seq, entry_id, agent, to_agent, role, out_, domains, sens, ts, gate, matched, level, final, CASE WHEN NOT out_ THEN NULL WHEN level = 'full' THEN 'block' ELSE gate END AS act,
      CASE WHEN out_ THEN level = 'full' ELSE gate <> 'allow' OR level <> 'none' END AS violation, out_ AND level = 'partial' AS warned, out_ AND coalesce(confidence, 0) >= 0.4 AS injected, NOT out_ AND (gate <> 'allow' OR level <> 'none') AS pii,
      CASE WHEN NOT out_ AND role = 'assistant' THEN list_min(list_intersect(domains, ['health', 'finance', 'legal', 'identity'])) END AS refusal, sha256(final) AS content_hash FROM a8 LEFT JOIN iv USING (entry_id))"""
)


@query(FOUND + " SELECT entry_id, gate, CAST(matched AS INTEGER) AS matched, level, act, violation, warned, injected, pii, refusal, content_hash FROM fd")
def local_audit_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn through the first phase: gate, tiers, injection and refusal checks."""
    return audited(spark, sf_dir).select("entry_id", "gate", "matched", "level", "act", "violation", "warned", "injected", "pii", "refusal", "content_hash")


_FALLBACK = "CASE WHEN list_contains(domains, 'health') THEN 'health_info' WHEN list_contains(domains, 'finance') THEN 'financial_info' WHEN list_contains(domains, 'schedule') THEN 'schedule_info' WHEN list_contains(domains, 'social') THEN 'social_info' ELSE 'general' END"


@query(FOUND + f" SELECT entry_id AS edge_id, agent AS from_agent, to_agent, ts, {_FALLBACK} AS message_type, sens, array_to_string(list_sort(domains), ',') AS domains, act <> 'allow' AS violation, act, content_hash, injected FROM fd WHERE out_")
def local_audit_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edges without content that the first phase sends to the center."""
    e = L.edges_of(audited(spark, sf_dir)).withColumn("domains", F.array_join(F.array_sort("domains"), ","))
    return e.select("edge_id", "from_agent", "to_agent", "ts", "message_type", "sens", "domains", "violation", "act", "content_hash", "injected")


@query(
    FOUND + """, lv AS (SELECT agent, row_number() OVER (PARTITION BY agent ORDER BY trace, seq) - 1 AS i, sha256(entry_id || '|' || CASE WHEN out_ THEN 'outbound_message' WHEN role = 'assistant' THEN 'refusal' ELSE 'tool_call' END || '|' || content_hash) AS h, count(*) OVER (PARTITION BY agent) AS n FROM fd
    UNION ALL SELECT agent, i // 2, sha256(h || coalesce(nx, h)), (n + 1) // 2 FROM (SELECT *, lead(h) OVER (PARTITION BY agent ORDER BY i) AS nx FROM lv WHERE n > 1) WHERE i % 2 = 0),
    rc AS (SELECT to_agent AS agent, count(*) AS received FROM fd WHERE out_ AND act <> 'block' GROUP BY 1),
    rp AS (SELECT agent, count(*) AS total, count(*) FILTER (WHERE violation) AS violations, CAST(coalesce(sum(matched) FILTER (WHERE out_ AND gate = 'redact'), 0) AS BIGINT) AS redactions, count(*) FILTER (WHERE out_) AS edges,
      count(refusal) AS refusals, array_to_string(list_sort(list_distinct(flatten(list(domains)))), ',') AS domains FROM fd GROUP BY 1)
    SELECT rp.*, round(CAST(violations AS DOUBLE) / total, 6) AS rate, coalesce(received, 0) AS received, h AS merkle_root FROM rp JOIN lv ON lv.agent = rp.agent AND lv.n = 1 LEFT JOIN rc ON rc.agent = rp.agent"""
)
def local_audit_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One report for each agent, with the root over all its entries."""
    return L.reports_of(written(audited(spark, sf_dir).drop("output_text", "input_text", "final"), "audited")).withColumns({"rate": F.round("rate", 6), "domains": F.array_join("domains", ",")})


def _nodes(found: DataFrame) -> DataFrame:
    kind, conv = F.split_part("agent", F.lit(":"), F.lit(1)), F.split_part("agent", F.lit(":"), F.lit(2)).cast("bigint")
    scope = F.array_sort(F.array_distinct(F.flatten(F.collect_set("domains"))))
    n = found.groupBy("agent").agg(scope.alias("scope"))
    return n.select("agent", "scope", F.concat(F.lit("tenant:"), conv % 7).alias("owner"), F.concat(F.lit("user:"), conv % 5).alias("user_id"), F.when(kind == "user", "slack").when(kind == "assistant", "discord").otherwise("email").alias("platform"))


def two_phases(spark: SparkSession, sf_dir: str, taint: bool) -> tuple[DataFrame, DataFrame]:
    """(edges, nodes) of the central audit as the first phase reports them."""
    found = written(audited(spark, sf_dir).drop("output_text", "input_text", "final"), "audited")  # once, without text: every detector reads it
    n, e = _nodes(found), L.edges_of(found)
    if taint:
        return L.with_taint(e, n), n
    none = {"t_domains": "array<string>", "t_subject": "string", "t_principal": "string", "t_hops": "int", "t_risk": "double"}
    return e.withColumns({k: F.lit(None).cast(v) for k, v in none.items()}), n


_TWO = FOUND + """, edges AS MATERIALIZED (SELECT entry_id AS edge_id, agent AS from_agent, to_agent, ts, sens, domains, act <> 'allow' AS violation, injected, CAST(NULL AS VARCHAR[]) AS t_domains, CAST(NULL AS VARCHAR) AS t_subject, CAST(NULL AS VARCHAR) AS t_principal,
  CAST(NULL AS INTEGER) AS t_hops, CAST(NULL AS DOUBLE) AS t_risk FROM fd WHERE out_),
nodes AS MATERIALIZED (SELECT agent, list_sort(list_distinct(flatten(list(domains)))) AS scope, 'tenant:' || (any_value(trace) % 7) AS owner, 'user:' || (any_value(trace) % 5) AS user_id, CASE any_value(role) WHEN 'user' THEN 'slack' WHEN 'assistant' THEN 'discord' ELSE 'email' END AS platform FROM fd GROUP BY 1),
pe AS MATERIALIZED (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY from_agent, to_agent ORDER BY ts DESC, edge_id DESC) AS rn FROM edges) WHERE rn = 1)"""


@query(
    _TWO + _FP + f""" SELECT CASE WHEN severity >= 0.8 THEN 'critical' WHEN severity >= 0.5 THEN 'high' WHEN severity >= 0.3 THEN 'medium' ELSE 'low' END AS alert_level, risk_type,
    count(*) AS risks, round(max(severity), 6) AS worst FROM ({SUITE_SQL}) GROUP BY 1, 2"""
)
def two_phase_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From text to alerts: the first phase over every turn, the central suite over its edges. Taint depends on order and is in ``two_phase_taint``."""
    e, n = two_phases(spark, sf_dir, taint=False)
    pe = pair_edges(e)
    r = D.union(
        D.cross_domain(pe, n), D.cross_owner(e, n), D.aggregation(pe), D.taint_spreading(e), D.long_distance(e), D.inference_accumulation(e),
        D.injection_leak(e), D.collusion(e), D.quasi_identifiers(e), D.k_anonymity(e), D.platform_leakage(e, n), D.behavioral_correlation(e, n),
    )
    return r.groupBy(alert_level(F.round("severity", 6)).alias("alert_level"), "risk_type").agg(F.count("*").alias("risks"), F.round(F.max("severity"), 6).alias("worst"))


@query()
def two_phase_taint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The risks that need the taint of the first phase; the taint itself is tested against a plain loop."""
    e, n = two_phases(spark, sf_dir, taint=True)
    r = D.union(D.cross_owner(e, n), D.taint_spreading(e), D.long_distance(e), D.inference_accumulation(e))
    each = e.select("edge_id", F.array_join("t_domains", ",").alias("t_domains"), "t_subject", "t_principal", "t_hops", "t_risk")
    hit = r.select(F.explode("edges").alias("edge_id"), "risk_type").groupBy("edge_id").agg(F.array_join(F.array_sort(F.collect_set("risk_type")), ",").alias("risks"))
    return each.join(hit, "edge_id", "left").withColumn("risks", F.coalesce("risks", F.lit("")))


# ---- injection from all sources, and a judge ----

_PAGES = "ps AS (SELECT page_id * 4 + k AS pk, page_id, html, ['web', 'agent', 'tool_return', 'user'][k + 1] AS source FROM pages, (SELECT unnest([0, 1, 2, 3]) AS k))"


def _page_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.injection_by_source(table(spark, sf_dir, "pages").select("page_id", "html"), "html", ("web", "agent", "tool_return", "user"))


_IV = "WITH " + _PAGES + ", " + sql_injection("pk", "ps", "html", "source")


@query(_IV + " SELECT page_id, source, round(CAST(confidence AS DOUBLE), 6) AS confidence, confidence >= 0.4 AS detected, CASE WHEN confidence >= 0.4 THEN kind ELSE 'none' END AS kind, patterns FROM iv JOIN ps USING (pk)")
def injection_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The injection verdict on each web page as if it came from the web, an agent, a tool or a user, entropy included."""
    return _page_verdicts(spark, sf_dir).select("page_id", "source", F.round("confidence", 6).alias("confidence"), "detected", "kind", F.col("patterns").cast("int").alias("patterns"))


def stub_judge(texts):  # noqa: ANN001, ANN201  a pandas series to one of answers
    """Stands for a model: the score is the share of the letter e, times five."""
    return texts.map(lambda t: f'```json\n{{"score": {round(min(1.0, 5 * t.count("e") / max(1, len(t))), 6)}, "verdict": "x"}}\n```')


_J = "round(least(1.0, 5 * (length(html) - length(replace(html, 'e', ''))) / CAST(greatest(1, length(html)) AS DOUBLE)), 6)"


@query(
    _IV + f""", jd AS (SELECT page_id, source, confidence AS c, CASE WHEN confidence >= 0.4 THEN kind ELSE 'none' END AS kind, {_J} AS j, confidence BETWEEN 0.2 AND 0.5 AS unsure FROM iv JOIN ps USING (pk))
    SELECT page_id, source, round(CAST(CASE WHEN unsure AND j >= 0.6 THEN greatest(c, j) WHEN unsure AND j < 0.3 THEN least(c, j) ELSE c END AS DOUBLE), 6) AS confidence, CASE WHEN unsure AND j >= 0.6 THEN true WHEN unsure AND j < 0.3 THEN false ELSE c >= 0.4 END AS detected,
    CASE WHEN unsure AND j >= 0.6 AND kind = 'none' THEN 'direct' WHEN unsure AND j < 0.3 THEN 'none' ELSE kind END AS kind FROM jd"""
)
def injection_judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts after a judge, which is a stub here."""
    v = H.judged(_page_verdicts(spark, sf_dir), "html", stub_judge)
    return T.judged_injection(v, F.col("judge")).select("page_id", "source", F.round("confidence", 6).alias("confidence"), "detected", "kind")


@query(f"SELECT doc_id, CASE WHEN len(m) > 0 THEN 'block' WHEN j >= 0.65 THEN 'judge_block' ELSE 'allow' END AS decision FROM (SELECT doc_id, {_M} AS m, {_J.replace('html', 'text')} AS j FROM documents)")
def firewall_judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The firewall in block mode, then a judge (a stub) on what the gate allows."""
    d = H.judged(table(spark, sf_dir, "documents").withColumn("gate", T.gate_decision(F.col("text"), RULES, "block")), "text", stub_judge)
    return d.select("doc_id", F.when(F.col("gate") == "block", "block").when(F.col("judge") >= 0.65, "judge_block").otherwise("allow").alias("decision"))


@query("""WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), i AS (SELECT label, min(vec_id) AS item, arg_min(v, vec_id) AS w FROM e GROUP BY 1)
SELECT vec_id, item, round(greatest(0, list_cosine_similarity(v, w)), 6) AS score FROM e JOIN i USING (label)""")
def embedding_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector against the item of its label, which is the label's first vector."""
    e = table(spark, sf_dir, "embeddings")
    items = e.groupBy("label").agg(F.min("vec_id").alias("item"), F.min_by("embedding", "vec_id").alias("w"))
    return e.join(items, "label").select("vec_id", "item", F.round(H.embedding_cosine(F.col("embedding"), F.col("w")), 6).alias("score"))


# ---- the recorder's log ----


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = entries(spark, sf_dir).withColumns({"local_action": F.when(F.col("sens") >= 5, "redact").otherwise("allow"), "domains": F.array_sort("domains")})
    out = e.where("to_agent is not null").withColumn("from_agent", F.col("agent"))
    return R.record(out, e.where("to_agent is null"))


LOG = EN + """, lg AS (SELECT trace, seq, CASE WHEN out_ THEN 'handoff' ELSE 'internal' END AS kind, agent, coalesce(to_agent, '') AS "to", CASE WHEN out_ THEN 'outbound_message' WHEN role = 'assistant' THEN 'refusal' ELSE 'tool_call' END AS action,
  list_sort(domains) AS domains, sens, CASE WHEN sens >= 5 THEN 'redact' ELSE 'allow' END AS local_action FROM en)"""


@query(LOG + """ SELECT trace, seq, kind, agent, "to", action, array_to_string(domains, ',') AS domains, sens, local_action FROM lg""")
def trace_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.timeline(_log(spark, sf_dir)).withColumn("domains", F.array_join("domains", ","))


@query(
    LOG + """, bth AS (SELECT trace, agent, CASE kind WHEN 'handoff' THEN 1 ELSE 0 END AS s, 0 AS r, CASE kind WHEN 'internal' THEN 1 ELSE 0 END AS i, domains FROM lg UNION ALL SELECT trace, "to", 0, 1, 0, [] FROM lg WHERE kind = 'handoff')
    SELECT trace, agent, CAST(sum(s) AS BIGINT) AS sent, CAST(sum(r) AS BIGINT) AS received, CAST(sum(i) AS BIGINT) AS internal, array_to_string(list_sort(list_distinct(flatten(list(domains)))), ',') AS domains FROM bth GROUP BY 1, 2"""
)
def trace_agents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per agent of a trace: sent, received, internal, domains."""
    return R.agent_summary(_log(spark, sf_dir)).withColumn("domains", F.array_join("domains", ","))


@query(
    LOG + """, who AS (SELECT trace, agent AS a FROM lg UNION SELECT trace, "to" FROM lg WHERE "to" <> '')
    SELECT lg.trace, any_value(n) AS n_agents, count(*) FILTER (WHERE kind = 'handoff') AS n_handoffs, count(*) FILTER (WHERE kind = 'internal') AS n_internal, array_to_string(list_sort(list_distinct(flatten(list(domains)))), ',') AS domains
    FROM lg JOIN (SELECT trace, count(*) AS n FROM who GROUP BY 1) USING (trace) GROUP BY lg.trace"""
)
def trace_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.trace_summary(_log(spark, sf_dir)).withColumn("domains", F.array_join("domains", ","))


@query(LOG + """ SELECT trace, seq, to_json({'trace': trace, 'seq': seq, 'kind': kind, 'agent': agent, 'to': "to", 'action': action, 'domains': domains, 'sens': sens, 'local_action': local_action}) AS event FROM lg""")
def trace_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log as lines of JSON."""
    return R.export(_log(spark, sf_dir))


@query("SELECT CAST(o_custkey AS VARCHAR) AS agent, min(o_orderkey) AS seq, arg_min(o_orderpriority, o_orderkey) AS policy, arg_min(o_orderstatus, o_orderkey) AS owner FROM orders GROUP BY 1")
def registered_agents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as registrations of customers: the first counts."""
    r = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("agent"), F.col("o_orderkey").alias("seq"), F.col("o_orderpriority").alias("policy"), F.col("o_orderstatus").alias("owner"))
    return R.register_agents(r)
