"""Structured Streaming: reports and events as they come, epochs with a watermark, per-key state and an idempotent sink."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from auditloom.functions.shared import shared_dir
from auditloom.operators.sequence import TRANSITIONS
from auditloom.sources import wire

_ALLOWED = {(a, b) for a, to in TRANSITIONS.items() for b in to.split()}


def read(spark: SparkSession, path: str, schema: str, files_per_batch: int = 100) -> DataFrame:
    """A stream of the Parquet files of a folder or pattern."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def epochs(entries: DataFrame, width: str, late: str) -> DataFrame:
    """(agent, epoch, entries, violations) by tumbling windows of ``ts``; what comes later than the watermark is dropped."""
    w = F.window("ts", width)
    return entries.withWatermark("ts", late).groupBy("agent", w.alias("w")).agg(F.count("*").alias("entries"), F.count_if("violation").alias("violations")).select("agent", F.col("w.start").alias("epoch"), "entries", "violations")


def bursts(writes: DataFrame, window: str, slide: str, late: str, least: int) -> DataFrame:
    """(agent, start, writes): sliding windows with that many writes; the exact look-ahead is a batch operator."""
    w = F.window("ts", window, slide)
    return writes.withWatermark("ts", late).groupBy("agent", w.alias("w")).agg(F.count("*").alias("writes")).where(F.col("writes") >= least).select("agent", F.col("w.start").alias("start"), "writes")


def sessions(entries: DataFrame, gap: str, late: str) -> DataFrame:
    w = F.session_window("ts", gap)
    return entries.withWatermark("ts", late).groupBy("agent", w.alias("w")).agg(F.count("*").alias("entries")).select("agent", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "entries")


def _advance(key: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    stage, seen, illegal = state.get if state.exists else ("initiated", 0, 0)
    rows = pd.concat(list(batches)).sort_values(["ts", "ord"], kind="stable")
    for to in rows["to_stage"]:
        illegal += (stage, to) not in _ALLOWED
        seen, stage = seen + 1, to
    state.update((stage, seen, illegal))
    yield pd.DataFrame({"action": [key[0]], "stage": [stage], "seen": [seen], "illegal": [illegal]})


def lifecycle(transitions: DataFrame) -> DataFrame:
    """(action, stage, seen, illegal) of (action, ts, ord, to_stage): each action's stage is kept between batches, and a batch is taken in order of time."""
    return transitions.groupBy("action").applyInPandasWithState(_advance, "action string, stage string, seen bigint, illegal bigint", "stage string, seen bigint, illegal bigint", "update", GroupStateTimeout.NoTimeout)


def into_table(stream: DataFrame, path: str, checkpoint: str, change: Callable[[DataFrame], DataFrame] | None = None, mode: str = "append") -> Any:
    """Start a query that writes every batch to its own folder of a table, so a batch that is run again replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        (change(batch) if change else batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingest(bodies: DataFrame, path: str, quarantine: str, checkpoint: str, verdict: Callable[[DataFrame], DataFrame] | None = None) -> Any:
    """Start a query that takes reports as JSON (a stream with ``body``) into a table, and what is no report, or has a verdict other than '', into quarantine with the reason. verdict adds ``reason`` to reports.

    Both tables are written by batch, so a batch that is run again replaces itself.
    """

    def write(batch: DataFrame, number: int) -> None:
        good, bad = wire.deserialize(batch.select("body"))
        checked = verdict(good) if verdict else good.withColumn("reason", F.lit(""))
        held = checked.where("reason <> ''").select(F.to_json(F.struct(*good.columns)).alias("body"), "reason")
        checked.where("reason = ''").drop("reason").write.mode("overwrite").parquet(f"{path}/batch={number}")
        bad.withColumn("reason", F.lit("not a report")).unionByName(held).write.mode("overwrite").parquet(f"{quarantine}/batch={number}")

    return bodies.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_to_end(stream: DataFrame, label: str, mode: str = "append") -> DataFrame:
    """All that is there now, through the sink and read back."""
    spark = stream.sparkSession
    at = f"{shared_dir(spark)}/auditloom/stream-{label}-{uuid.uuid4().hex}"
    into_table(stream, f"{at}/table", f"{at}/checkpoint", mode=mode).awaitTermination()
    return spark.read.parquet(f"{at}/table")
