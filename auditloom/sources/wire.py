"""Reports on the wire: JSON with a fixed schema, both ways, rejects apart; and traces of other tools."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TAINT = "struct<domains:array<string>,max_sensitivity:int,origin_boundary:string,origin_principal:string,hop_count:int,inference_risk:double>"
EDGE = f"struct<edge_id:string,trace_id:string,from_agent:string,to_agent:string,timestamp:timestamp,message_type:string,sensitivity_level:int,domains:array<string>,local_violation:boolean,local_action:string,content_hash:string,taint:{TAINT},injection_detected:boolean>"
REPORT = f"agent_id string, user_id string, owner_principal string, report_id string, timestamp timestamp, edges array<{EDGE}>, total_interactions int, violations_blocked int, pii_instances_redacted int, leakage_rate double, merkle_root string, domains array<string>"


def _top(struct: str) -> str:
    """The fields of a struct's type as a schema: colons of the outer level become blanks."""
    out, depth = [], 0
    for c in struct[len("struct<") : -1]:
        depth += (c == "<") - (c == ">")
        out.append(" " if c == ":" and not depth else c)
    return "".join(out)


RISK = "struct<risk_type:string,agents:array<string>,edges:array<string>,severity:double,source_domain:string,target_domain:string,scenario:string,blame_agent:string>"
#: What travels: (the schema of a body, the field that a body must have).
KINDS = {
    "report": (REPORT, "agent_id"),
    "edge": (_top(EDGE), "edge_id"),
    "result": (f"audit_id string, timestamp timestamp, total_agents int, total_edges int, risks array<{RISK}>, agent_scores map<string,double>, scenario_summary map<string,int>", "audit_id"),
    "challenge": ("challenger_id string, target_agent_id string, trace_id string, entry_ids array<string>, reason string", "trace_id"),
    "incident": ("incident_id string, alert_level string, risk_type string, source_domain string, target_domain string, agents array<string>, risks int, severity double, scenario string, blamed array<string>, root_cause string, recommended string", "incident_id"),
}


def serialize(rows: DataFrame, kind: str = "report") -> DataFrame:
    """(the kind's key, body): reports, edges, audit results, incidents or challenges as JSON, null fields included. The key of a report is its report_id."""
    key = "report_id" if kind == "report" else KINDS[kind][1]
    return rows.select(key, F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("body"))


def deserialize(bodies: DataFrame, column: str = "body", kind: str = "report") -> tuple[DataFrame, DataFrame]:
    """(rows, rejects): a body that isn't one of the kind with its key is rejected and kept as it came."""
    schema, key = KINDS[kind]
    parsed = bodies.withColumn("__r", F.from_json(column, schema, {"mode": "PERMISSIVE"}))
    good = F.coalesce(F.col(f"__r.{key}"), F.lit("")) != ""
    return parsed.where(good).select("__r.*"), parsed.where(~good).drop("__r")


def edges_of(reports: DataFrame) -> DataFrame:
    """The edges of the last report of each agent (by time, then id), with the agent's owner."""
    last = reports.groupBy("agent_id").agg(F.max_by(F.struct("owner_principal", "user_id", "edges"), F.struct("timestamp", "report_id")).alias("r"))
    return last.select("agent_id", F.col("r.owner_principal").alias("owner"), F.col("r.user_id").alias("user_id"), F.inline("r.edges"))


#: Where other tools' JSON traces keep the ends and the content of a message.
TRACE_KEYS = {"source": ["from_agent", "source", "sender", "src"], "target": ["to_agent", "target", "recipient", "dst"], "content": ["content", "message", "text", "output"], "leak": ["label", "is_leak", "leaked", "violation"]}


def external_traces(lines: DataFrame, column: str = "value") -> DataFrame:
    """(source, target, content, leak) of JSON lines in any of the known layouts; lines without content go."""
    pick = lambda keys: F.coalesce(*[F.get_json_object(column, f"$.{k}") for k in keys])
    out = lines.select(*[pick(v).alias(k) for k, v in TRACE_KEYS.items()])
    return out.where("content is not null").withColumn("leak", F.coalesce(F.lower("leak").isin("1", "leak", "true", "yes"), F.lit(False)))
