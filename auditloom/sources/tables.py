"""The input tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Bytes below which a table isn't worth dealing out.
SMALL = 1 << 20


def spread(df: DataFrame) -> DataFrame:
    """df on all cores: a table of some size whose files give fewer splits than there are cores (one file with one row group, say) is dealt out once; one with more splits is left as it is."""
    plan, cores = df._jdf.queryExecution(), df.sparkSession.sparkContext.defaultParallelism
    if plan.optimizedPlan().stats().sizeInBytes() < SMALL or plan.toRdd().getNumPartitions() >= cores:
        return df
    return df.repartition(cores)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables."""
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))
