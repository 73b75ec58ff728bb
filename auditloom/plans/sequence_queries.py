"""Queries of the ordered operators over events and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditloom.operators import sequence as S
from auditloom.registry import query
from auditloom.sources.tables import table

ACTIONS = {"click": "memory_write", "view": "memory_read", "signup": "summary_write", "purchase": "outbound_message", "error": "refusal"}
STAGES = {"signup": "initiated", "view": "executing", "click": "failed", "error": "retrying", "purchase": "completed"}
DOMS = [["health"], ["health", "social"], ["social"], ["finance", "legal"]]
_SEN = ["health", "finance", "legal", "identity"]
SECRET = "chain"


def _map(c, pairs: dict):
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])[c]


def _sql_map(c: str, pairs: dict) -> str:
    return f"CASE {c} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in pairs.items()) + " END"


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").cast("string").alias("agent"), "event_id", "ts", _map(F.col("event_type"), ACTIONS).alias("action"), (F.col("value") >= 80).alias("pii"), "event_type", "value")


EN = f"WITH en AS (SELECT CAST(user_id AS VARCHAR) AS agent, event_id, ts, {_sql_map('event_type', ACTIONS)} AS action, value >= 80 AS pii, event_type, value FROM events) "


@query(
    EN + """, w AS (SELECT agent, ts, count(*) OVER (PARTITION BY agent ORDER BY epoch_us(ts) RANGE BETWEEN CURRENT ROW AND 21600000000 FOLLOWING) AS writes FROM en WHERE action IN ('memory_write', 'summary_write'))
    SELECT agent, min(ts) AS ts, arg_min(writes, ts) AS writes, round(least(1.0, arg_min(writes, ts) / 3.0 * 0.5 + 0.3), 6) AS severity FROM w WHERE writes >= 3 GROUP BY agent"""
)
def write_burst(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three writes in six hours: the events are sparser than an agent's memory."""
    return S.write_bursts(entries(spark, sf_dir), 3, 21600).withColumn("severity", F.round("severity", 6))


@query(
    EN + """, f AS (SELECT *, min(CASE WHEN action IN ('memory_write', 'summary_write') THEN ts END) OVER (PARTITION BY agent) AS w FROM en),
    g AS (SELECT agent, count(*) FILTER (WHERE ts < w) AS n0, count(*) FILTER (WHERE ts > w) AS n1, avg(CASE WHEN ts < w THEN CAST(pii AS INTEGER) END) AS p0, avg(CASE WHEN ts > w THEN CAST(pii AS INTEGER) END) AS p1 FROM f WHERE w IS NOT NULL GROUP BY agent),
    z AS (SELECT agent, abs(p1 - p0) / greatest(0.01, sqrt(p0 * (1 - p0) / n0)) AS z FROM g WHERE n0 >= 3 AND n1 >= 3)
    SELECT agent, round(z, 6) AS z, round(least(1.0, z / 5), 6) AS severity FROM z WHERE z >= 2"""
)
def behavioral_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.behavioral_shift(entries(spark, sf_dir)).select("agent", F.round("z", 6).alias("z"), F.round("severity", 6).alias("severity"))


def _sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = entries(spark, sf_dir).withColumn("session", F.date_trunc("week", "ts"))
    return e.groupBy("agent", "session").agg(F.count("*").alias("interactions"), F.count_if(F.col("event_type") == "error").alias("violations"), F.count_if(F.col("action").isin(*S.WRITES)).alias("writes"), F.count_if(F.col("action").isin(*S.READS)).alias("reads"))


_SES = EN + """, s AS (SELECT agent, date_trunc('week', ts) AS session, count(*) AS interactions, count(*) FILTER (WHERE event_type = 'error') AS violations,
  count(*) FILTER (WHERE action IN ('memory_write', 'summary_write')) AS writes, count(*) FILTER (WHERE action = 'memory_read') AS reads FROM en GROUP BY 1, 2) """


@query(
    _SES + """, b AS (SELECT agent, CAST(violations AS DOUBLE) / greatest(interactions, 1) AS rate, row_number() OVER (PARTITION BY agent ORDER BY session DESC) AS back FROM s)
    SELECT agent, coalesce(round_even(abs(avg(rate) FILTER (WHERE back <= 3) - avg(rate) FILTER (WHERE back > 3)) / greatest(stddev_pop(rate) FILTER (WHERE back > 3), 0.01), 3), 0.0) AS drift FROM b GROUP BY agent"""
)
def session_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.session_drift(_sessions(spark, sf_dir))


@query(
    EN + """, d AS (SELECT agent, date_trunc('day', ts) AS epoch, count(*) FILTER (WHERE event_type = 'error') AS v, count(*) AS e FROM en GROUP BY 1, 2),
    b AS (SELECT *, row_number() OVER (PARTITION BY agent ORDER BY epoch DESC) AS back FROM d),
    r AS (SELECT agent, count(*) AS epochs, CAST(sum(v) FILTER (WHERE back <= 5) AS DOUBLE) / greatest(sum(e) FILTER (WHERE back <= 5), 1) AS r1, CAST(sum(v) AS DOUBLE) / greatest(sum(e), 1) AS r FROM b GROUP BY agent HAVING count(*) >= 7)
    SELECT agent, epochs, round(CASE WHEN r > 0 THEN abs(r1 - r) / greatest(r, 0.01) ELSE 0 END, 6) AS deviation, CASE WHEN r > 0 THEN abs(r1 - r) / greatest(r, 0.01) > 2 ELSE r1 > 0 END AS anomalous FROM r"""
)
def trend_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = entries(spark, sf_dir).groupBy("agent", F.date_trunc("day", "ts").alias("epoch")).agg(F.count_if(F.col("event_type") == "error").alias("violations"), F.count("*").alias("edges"))
    return S.trend(d).withColumn("deviation", F.round("deviation", 6))


@query(
    _SES + """SELECT agent, session, round(w, 6) AS avg_writes, round(r, 6) AS avg_reads, round(w / greatest(r, 1.0), 6) AS write_read_ratio FROM (
    SELECT agent, session, avg(writes) OVER x AS w, avg(reads) OVER x AS r FROM s WINDOW x AS (PARTITION BY agent ORDER BY session ROWS UNBOUNDED PRECEDING))"""
)
def memory_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = S.memory_profile(_sessions(spark, sf_dir))
    return p.select("agent", "session", *[F.round(c, 6).alias(c) for c in ("avg_writes", "avg_reads", "write_read_ratio")])


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("action"), "ts", F.col("event_id").alias("ord"), _map(F.col("event_type"), STAGES).alias("to_stage"))
    from pyspark.sql import Window

    w = Window.partitionBy("action").orderBy("ts", "ord")
    return e.withColumn("from_stage", F.coalesce(F.lag("to_stage").over(w), F.lit("initiated")))


_LOG = f"WITH l AS (SELECT user_id AS action, ts, event_id AS ord, {_sql_map('event_type', STAGES)} AS to_stage FROM events), f AS (SELECT *, coalesce(lag(to_stage) OVER (PARTITION BY action ORDER BY ts, ord), 'initiated') AS from_stage FROM l) "
_ALLOWED = "(" + ", ".join(f"('{k}', '{x}')" for k, v in S.TRANSITIONS.items() for x in v.split()) + ")"


@query(
    _LOG + f"""SELECT action, CAST(count(*) FILTER (WHERE illegal) AS BIGINT) AS illegal, CAST(count(*) FILTER (WHERE r > 3 AND to_stage = 'retrying') AS BIGINT) AS over_retried FROM (
    SELECT action, to_stage, (from_stage, to_stage) NOT IN {_ALLOWED} AS illegal, count(*) FILTER (WHERE to_stage = 'retrying') OVER (PARTITION BY action ORDER BY ts, ord ROWS UNBOUNDED PRECEDING) AS r FROM f) GROUP BY action"""
)
def lifecycle_conformance(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = S.lifecycle(_log(spark, sf_dir)).groupBy("action")
    return g.agg(F.count_if("illegal").alias("illegal"), F.count_if("over_retried").alias("over_retried"))


@query(_LOG + "SELECT action, arg_max(to_stage, {'t': ts, 'o': ord}) AS stage, count(*) AS steps, round((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6, 6) AS seconds, arg_max(to_stage, {'t': ts, 'o': ord}) IN ('completed', 'rejected', 'cancelled') AS terminal FROM f GROUP BY action")
def lifecycle_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.action_states(_log(spark, sf_dir)).withColumn("seconds", F.round("seconds", 6))


@query("""WITH RECURSIVE p AS (SELECT CAST(user_id AS VARCHAR) AS agent, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, event_id || ':' || event_type AS payload FROM events),
c AS (SELECT agent, seq, sha256(':' || payload) AS h FROM p WHERE seq = 1 UNION ALL SELECT p.agent, p.seq, sha256(c.h || ':' || p.payload) FROM c JOIN p ON p.agent = c.agent AND p.seq = c.seq + 1)
SELECT agent, count(*) AS links, CAST(0 AS BIGINT) AS broken, arg_max(h, seq) AS head FROM c GROUP BY agent""")
def hash_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Append every agent's entries to its chain, then verify the chain by the row before."""
    from pyspark.sql import Window

    seq = F.row_number().over(Window.partitionBy("agent").orderBy("ts", "event_id")).cast("bigint")
    e = entries(spark, sf_dir).select("agent", seq.alias("seq"), F.concat_ws(":", "event_id", "event_type").alias("payload"))
    return S.verify_chain(S.append_chain(e))


@query(
    f"""WITH d AS (SELECT DISTINCT CAST(user_id AS VARCHAR) AS agent, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS INTEGER) AS epoch FROM events)
    SELECT agent, epoch, sha256(sha256('{SECRET}:' || agent || ':' || (epoch - 1)) || ':' || sha256('{SECRET}:' || agent || ':' || epoch)) AS commitment FROM d"""
)
def epoch_commitments(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = entries(spark, sf_dir).select("agent", F.datediff(F.to_date("ts"), F.lit("2024-01-01")).alias("epoch")).distinct()
    return S.epoch_tokens(d, SECRET).select("agent", "epoch", "commitment")


# ---- access control, channels, negative inference ----


_ACCESS = (
    """WITH r AS (SELECT o_orderkey, o_custkey, CASE o_orderkey % 4 WHEN 0 THEN 'read' WHEN 1 THEN 'write' WHEN 2 THEN 'execute' ELSE 'delegate' END AS action, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS level,
      CASE WHEN o_orderkey % 3 = 0 THEN 'tenant:' || (o_orderkey % 25) ELSE '' END AS owner, 'tool:' || (o_orderkey % 5) AS tool, (o_custkey + 1) % 2000 AS target FROM orders),
    c AS (SELECT c_custkey, c_nationkey % 5 + 1 AS lvl, 'tenant:' || c_nationkey AS u, c_custkey % 3 = 0 AS deleg FROM customer WHERE c_acctbal >= 0),
    j AS (SELECT r.*, c.*, t.lvl AS tl FROM r LEFT JOIN c ON o_custkey = c.c_custkey LEFT JOIN c t ON target = t.c_custkey)
    SELECT o_orderkey, CASE WHEN c_custkey IS NULL THEN 'deny' WHEN e <> 'none' THEN 'escalation_blocked' ELSE 'allow' END AS decision, e AS escalation FROM (
      SELECT *, CASE WHEN c_custkey IS NULL THEN 'none' WHEN action = 'read' AND level > lvl THEN 'vertical' WHEN action = 'write' AND level < lvl THEN 'vertical' WHEN owner <> '' AND owner <> u THEN 'horizontal'
        WHEN action = 'execute' AND tool NOT IN ('tool:0', 'tool:1') THEN 'vertical' WHEN action = 'delegate' AND (NOT deleg OR tool <> 'tool:3' OR coalesce(tl > lvl, false)) THEN 'delegation' ELSE 'none' END AS e FROM j)"""
)


@query(_ACCESS)
def access_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests are orders, clearances are customers; those whose account is overdrawn are not registered."""
    return checked(spark, sf_dir).select("o_orderkey", "decision", "escalation")


ACCESS_LOG = "WITH lg AS (SELECT a.*, CAST(o_custkey AS VARCHAR) AS agent FROM (" + _ACCESS + ") a JOIN orders USING (o_orderkey)) "


def checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every request with its decision."""
    from auditloom.operators.controls import check_access

    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    action = F.element_at(F.array(*map(F.lit, ("read", "write", "execute", "delegate"))), (k % 4 + 1).cast("int"))
    requests = o.select(
        k.alias("request"), F.col("o_custkey").cast("string").alias("agent"), action.alias("action"), F.substring("o_orderpriority", 1, 1).cast("int").alias("level"), F.array().cast("array<string>").alias("domains"),
        F.when(k % 3 == 0, F.concat(F.lit("tenant:"), k % 25)).otherwise("").alias("owner"), F.concat(F.lit("tool:"), k % 5).alias("tool"), ((F.col("o_custkey") + 1) % 2000).cast("string").alias("target"),
    )
    c = table(spark, sf_dir, "customer").where("c_acctbal >= 0")  # registration is a property of the data here
    clearances = c.select(
        F.col("c_custkey").cast("string").alias("agent"), (F.col("c_nationkey") % 5 + 1).alias("max_level"), F.array().cast("array<string>").alias("allowed_domains"), F.concat(F.lit("tenant:"), F.col("c_nationkey")).alias("user_id"),
        F.array(F.lit("tool:0"), F.lit("tool:1")).alias("allowed_tools"), (F.col("c_custkey") % 3 == 0).alias("can_delegate"), F.array(F.lit("tool:3")).alias("delegatable_tools"),
    )
    return check_access(requests, clearances).withColumnRenamed("request", "o_orderkey")


@query(f"SELECT escalation, count(*) AS n FROM ({_ACCESS}) WHERE escalation <> 'none' GROUP BY escalation")
def escalation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return access_decisions(spark, sf_dir).where("escalation <> 'none'").groupBy("escalation").agg(F.count("*").alias("n"))


def _doms(n) -> F.Column:
    return F.element_at(F.array(*[F.array(*map(F.lit, d)) for d in DOMS]), (n % 4 + 1).cast("int"))


_SQL_DOMS = "[" + ", ".join(str(d) for d in DOMS) + "]"


@query(
    f"""SELECT event_id, inferred, round(least(1.0, CASE event_type WHEN 'error' THEN 0.7 ELSE 0.5 END + CASE WHEN len(d) = 1 THEN 0.2 ELSE 0 END), 6) AS confidence FROM (
    SELECT event_id, event_type, d, list_min(list_intersect(d, {_SEN})) AS inferred FROM (SELECT *, {_SQL_DOMS}[user_id % 4 + 1] AS d FROM events) WHERE event_type IN ('error', 'view')) WHERE inferred IS NOT NULL"""
)
def refusal_leak(spark: SparkSession, sf_dir: str) -> DataFrame:
    from auditloom.operators.controls import refusal_leaks

    e = table(spark, sf_dir, "events").select("event_id", _doms(F.col("user_id")).alias("domains"), F.when(F.col("event_type") == "error", "refusal").when(F.col("event_type") == "view", "silence").otherwise("answer").alias("response"))
    return refusal_leaks(e).select("event_id", "inferred", F.round("confidence", 6).alias("confidence"))


@query(
    f"""SELECT event_id, inferred, round(least(1.0, 0.3 + 0.1 * ratio), 6) AS confidence FROM (SELECT event_id, value / 20.0 AS ratio, list_min(list_intersect({_SQL_DOMS}[user_id % 4 + 1], {_SEN})) AS inferred FROM events) WHERE ratio >= 3 AND inferred IS NOT NULL"""
)
def delay_leak(spark: SparkSession, sf_dir: str) -> DataFrame:
    from auditloom.operators.controls import delay_leaks

    e = table(spark, sf_dir, "events").select("event_id", _doms(F.col("user_id")).alias("domains"), F.lit(20.0).alias("expected"), F.col("value").alias("actual"))
    return delay_leaks(e).select("event_id", "inferred", F.round("confidence", 6).alias("confidence"))


@query(
    f"""WITH t AS (SELECT conv_id, turn, length(text) AS n, {_SQL_DOMS}[turn % 4 + 1] AS d FROM conversations WHERE role = 'assistant')
    SELECT a.conv_id, a.turn AS turn_a, b.turn AS turn_b, list_min(list_intersect(list_concat(a.d, b.d), {_SEN})) AS inferred, round(least(0.8, 0.3 + 0.1 * (CAST(greatest(a.n, b.n) AS DOUBLE) / least(a.n, b.n))), 6) AS confidence
    FROM t a JOIN t b ON a.conv_id = b.conv_id AND a.turn < b.turn WHERE least(a.n, b.n) > 0 AND CAST(greatest(a.n, b.n) AS DOUBLE) / least(a.n, b.n) >= 3 AND list_has_any(list_concat(a.d, b.d), {_SEN})"""
)
def differential_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    from auditloom.operators.controls import differential_responses

    c = table(spark, sf_dir, "conversations").where("role = 'assistant'").select(F.col("conv_id").alias("grp"), F.col("turn").alias("item"), F.length("text").alias("length"), _doms(F.col("turn")).alias("domains"))
    return differential_responses(c).select(F.col("grp").alias("conv_id"), F.col("item_a").alias("turn_a"), F.col("item_b").alias("turn_b"), "inferred", F.round("confidence", 6).alias("confidence"))


ITEMS = ["the", "und", "que"]


@query(
    f"""SELECT conv_id, turn, kind, round(confidence, 6) AS confidence FROM (SELECT conv_id, turn, CASE WHEN m > 0 AND m < 3 THEN 'partial_answer' WHEN ex THEN 'exclusion_leak' END AS kind, CASE WHEN m > 0 AND m < 3 THEN least(0.9, 0.4 + (3 - m) * 0.1) ELSE 0.65 END AS confidence
    FROM (SELECT conv_id, turn, len(list_filter({ITEMS}, lambda w: contains(lower(text), w))) AS m, contains(lower(text), 'except') OR contains(lower(text), 'but not') AS ex, {_SQL_DOMS}[conv_id % 4 + 1] AS d FROM conversations) WHERE list_has_any(d, {_SEN})) WHERE kind IS NOT NULL"""
)
def partial_answer_leak(spark: SparkSession, sf_dir: str) -> DataFrame:
    from auditloom.operators.controls import partial_answers

    c = table(spark, sf_dir, "conversations").withColumns({"domains": _doms(F.col("conv_id")), "items": F.array(*map(F.lit, ITEMS))})
    return partial_answers(c, exclusions=["except", "but not"]).select("conv_id", "turn", "kind", F.round("confidence", 6).alias("confidence"))


@query(
    """SELECT channel, count(*) AS total, count(*) FILTER (WHERE act <> 'allow') AS leaked, count(*) FILTER (WHERE act IN ('block', 'redact')) AS blocked FROM (
    SELECT channel, CASE WHEN (channel = 'C3' AND role = 'system') OR (channel = 'C5' AND conv_id % 7 = 0) OR (channel = 'C7' AND conv_id % 5 = 0) THEN 'block' WHEN full_ AND channel IN ('C3', 'C5', 'C7') THEN 'block' WHEN full_ THEN 'redact' ELSE 'allow' END AS act
    FROM (SELECT *, 'C' || (turn % 5 + 3) AS channel, contains(lower(text), 'that') AS full_ FROM conversations)) GROUP BY channel"""
)
def channel_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as channel events, with a word of the corpus as the protected item and the level by the tiers."""
    from auditloom.operators.controls import audit_channels
    from auditloom.operators.text import protected_level

    c = protected_level(table(spark, sf_dir, "conversations"), "text", ["that"], [], F.lit(False))
    ev = c.select(
        F.concat(F.lit("C"), F.col("turn") % 5 + 3).alias("channel"), "level", F.col("role").alias("tool"),
        F.concat(F.lit("key:"), F.col("conv_id") % 7).alias("memory_key"), F.concat(F.lit("/area"), F.col("conv_id") % 5, F.lit("/file")).alias("path"),
    )
    acts = audit_channels(ev, blocked_tools=["system"], allowed_keys=[f"key:{i}" for i in range(1, 7)], allowed_paths=[f"/area{i}/" for i in range(1, 5)])
    return acts.groupBy("channel").agg(F.count("*").alias("total"), F.count_if(F.col("act") != "allow").alias("leaked"), F.count_if(F.col("act").isin("block", "redact")).alias("blocked"))


def _handoffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("turn")
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("trace"), F.col("turn").alias("seq"), F.concat_ws(":", "role", (F.col("turn") % 3).cast("string")).alias("from_agent"), F.lead(F.concat_ws(":", "role", (F.col("turn") % 3).cast("string"))).over(w).alias("to_agent"), _doms(F.col("turn")).alias("domains"))
    return c.where("to_agent is not null").select("*", (F.col("seq") % 6).cast("int").alias("sens"), F.when(F.col("seq") % 2 == 0, F.concat(F.lit("subj:"), F.col("seq") % 4)).otherwise("").alias("subject"), (F.col("seq") % 5 == 4).alias("blocked"))


@query()
def taint_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Taint along the turns of each conversation; it depends on order, so it is tested against a plain loop."""
    return S.propagate_taint(_handoffs(spark, sf_dir))


@query("""WITH h AS (SELECT conv_id, turn, role AS a, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM conversations)
SELECT agent, CAST(sum(s) AS BIGINT) AS sent, CAST(sum(r) AS BIGINT) AS received FROM (SELECT a AS agent, 1 AS s, 0 AS r FROM h WHERE b IS NOT NULL UNION ALL SELECT b, 0, 1 FROM h WHERE b IS NOT NULL) GROUP BY agent""")
def agent_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Handoffs that each agent sent and received."""
    from pyspark.sql import Window

    h = table(spark, sf_dir, "conversations").select(F.col("role").alias("a"), F.lead("role").over(Window.partitionBy("conv_id").orderBy("turn")).alias("b")).where("b is not null")
    both = h.select(F.explode(F.array(F.struct(F.col("a").alias("agent"), F.lit(1).alias("s"), F.lit(0).alias("r")), F.struct(F.col("b").alias("agent"), F.lit(0).alias("s"), F.lit(1).alias("r")))).alias("x"))
    return both.groupBy("x.agent").agg(F.sum("x.s").alias("sent"), F.sum("x.r").alias("received"))


@query("""SELECT conv_id, turn, a AS from_agent, role AS to_agent FROM (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS a FROM conversations) WHERE a IS NOT NULL AND a <> role""")
def node_handoffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("run"), F.col("turn").alias("ts"), F.col("turn").alias("ord"), F.col("role").alias("node"))
    return S.node_handoffs(c).select(F.col("run").alias("conv_id"), F.col("ord").alias("turn"), "from_agent", "to_agent")
