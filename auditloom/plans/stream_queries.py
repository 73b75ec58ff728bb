"""Streaming queries over the events table, run to its end."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditloom.functions.shared import shared_dir
from auditloom.operators.sequence import TRANSITIONS
from auditloom.plans.sequence_queries import STAGES, _map, _sql_map
from auditloom.registry import query
from auditloom.streaming import audit

_EVENTS = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.read(spark, f"{sf_dir}/[e]vents.parquet", _EVENTS)  # a pattern, as a stream's path can't be one file


@query("SELECT CAST(user_id AS VARCHAR) AS agent, date_trunc('day', ts) AS epoch, count(*) AS entries, count(*) FILTER (WHERE event_type = 'error') AS violations FROM events GROUP BY 1, 2")
def stream_epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily epochs; in update mode the last state of an epoch counts."""
    e = _events(spark, sf_dir).select(F.col("user_id").cast("string").alias("agent"), "ts", (F.col("event_type") == "error").alias("violation"))
    out = audit.run_to_end(audit.epochs(e, "1 day", "2 days"), "epochs", "update")
    return out.groupBy("agent", "epoch").agg(F.max_by("entries", "batch").alias("entries"), F.max_by("violations", "batch").alias("violations"))


_OK = "(" + ", ".join(f"('{k}', '{x}')" for k, v in TRANSITIONS.items() for x in v.split()) + ")"


@query(
    f"""WITH f AS (SELECT CAST(user_id AS VARCHAR) AS action, ts, event_id, {_sql_map('event_type', STAGES)} AS t FROM events),
    g AS (SELECT *, coalesce(lag(t) OVER (PARTITION BY action ORDER BY ts, event_id), 'initiated') AS p FROM f)
    SELECT action, arg_max(t, (ts, event_id)) AS stage, count(*) AS seen, count(*) FILTER (WHERE (p, t) NOT IN {_OK}) AS illegal FROM g GROUP BY 1"""
)
def stream_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir).select(F.col("user_id").cast("string").alias("action"), "ts", F.col("event_id").alias("ord"), _map(F.col("event_type"), STAGES).alias("to_stage"))
    out = audit.run_to_end(audit.lifecycle(e), "lifecycle", "update")
    return out.groupBy("action").agg(F.max_by(F.struct("stage", "seen", "illegal"), "batch").alias("s")).select("action", "s.*")


@query(
    """WITH w AS (SELECT CAST(user_id AS VARCHAR) AS agent, unnest([date_trunc('hour', ts), date_trunc('hour', ts) - INTERVAL 1 HOUR]) AS start FROM events)
    SELECT agent, start, count(*) AS writes FROM w GROUP BY 1, 2 HAVING count(*) >= 3"""
)
def stream_bursts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three events or more in sliding windows of two hours; the last state of a window counts."""
    e = _events(spark, sf_dir).select(F.col("user_id").cast("string").alias("agent"), "ts")
    out = audit.run_to_end(audit.bursts(e, "2 hours", "1 hour", "1 day", 3), "bursts", "update")
    return out.groupBy("agent", "start").agg(F.max_by("writes", "batch").alias("writes"))


@query(
    """WITH g AS (SELECT CAST(user_id AS VARCHAR) AS agent, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events),
    s AS (SELECT *, sum(fresh) OVER (PARTITION BY agent ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
    SELECT agent, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS "end", count(*) AS entries FROM s GROUP BY agent, k"""
)
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions that end after six quiet hours."""
    e = _events(spark, sf_dir).select(F.col("user_id").cast("string").alias("agent"), "ts")
    out = audit.run_to_end(audit.sessions(e, "6 hours", "1 day"), "sessions", "complete")
    return out.join(out.agg(F.max("batch").alias("batch")), "batch").select("agent", "start", "end", "entries")  # the last batch has them all


@query("SELECT CASE event_type WHEN 'error' THEN 'not a report' WHEN 'signup' THEN 'underreported_edges' ELSE 'accepted' END AS outcome, count(*) AS reports FROM events GROUP BY 1")
def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports as they come: broken ones, and those that claim more than they have, go to quarantine with the reason."""
    e = spark.readStream.schema(_EVENTS).parquet(f"{sf_dir}/[e]vents.parquet")
    body = F.to_json(F.struct(F.col("user_id").cast("string").alias("agent_id"), F.col("event_id").cast("string").alias("report_id"), F.when(F.col("event_type") == "signup", 3).otherwise(0).alias("total_interactions"), F.lit(0.0).alias("leakage_rate")))
    bodies = e.select(F.when(F.col("event_type") == "error", "{broken").otherwise(body).alias("body"))
    at = f"{shared_dir(spark)}/auditloom/stream-ingest-{uuid.uuid4().hex}"
    short = F.greatest(F.coalesce(F.size("edges"), F.lit(0)), F.lit(0)) < F.col("total_interactions")
    audit.ingest(bodies, f"{at}/reports", f"{at}/quarantine", f"{at}/checkpoint", lambda r: r.withColumn("reason", F.when(F.coalesce(short, F.lit(False)), "underreported_edges").otherwise(""))).awaitTermination()
    good = spark.read.parquet(f"{at}/reports").select(F.lit("accepted").alias("outcome"))
    return good.union(spark.read.parquet(f"{at}/quarantine").select("reason")).groupBy("outcome").agg(F.count("*").alias("reports"))
