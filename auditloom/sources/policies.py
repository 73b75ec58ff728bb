"""Policies as JSON or YAML files, and what is wrong with them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "agent_id string, must_not_share array<string>, acceptable_abstractions map<string,string>, sensitivity_threshold int"
_CORRUPT = "_corrupt"


def _defaults(df: DataFrame) -> DataFrame:
    return df.select(
        F.coalesce("agent_id", F.lit("")).alias("agent_id"), F.coalesce("must_not_share", F.array().cast("array<string>")).alias("must_not_share"),
        F.coalesce("acceptable_abstractions", F.create_map().cast("map<string,string>")).alias("acceptable_abstractions"), F.coalesce("sensitivity_threshold", F.lit(3)).alias("sensitivity_threshold"),
    )


def from_dicts(spark: SparkSession, policies: list[dict]) -> DataFrame:
    keys = [c.split()[0] for c in SCHEMA.split(", ")]
    return _defaults(spark.createDataFrame([tuple(p.get(k) for k in keys) for p in policies], SCHEMA))


def load_json(spark: SparkSession, path: str) -> DataFrame:
    """One policy to a file; path can be a folder or a pattern. Files that aren't JSON are left out."""
    rows = spark.read.schema(f"{SCHEMA}, {_CORRUPT} string").option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", _CORRUPT).option("pathGlobFilter", "*.json").json(path)
    return _defaults(rows.where(F.col(_CORRUPT).isNull()))


def load_folder(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(policies, warnings): the JSON files of a folder, and (file, warning) of those that are left out, as no JSON or without an agent."""
    rows = spark.read.schema(f"{SCHEMA}, {_CORRUPT} string").option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", _CORRUPT).option("pathGlobFilter", "*.json").json(path).withColumn("file", F.element_at(F.split(F.input_file_name(), "/"), -1))
    why = F.when(F.col(_CORRUPT).isNotNull(), "not JSON").when(F.coalesce("agent_id", F.lit("")) == "", "no agent_id")
    return _defaults(rows.where(why.isNull())), rows.where(why.isNotNull()).select("file", why.alias("warning"))


def load_yaml(spark: SparkSession, texts: list[str]) -> DataFrame:
    """Policies are few and small, so YAML is read on the driver; it needs the yaml package."""
    import yaml

    return from_dicts(spark, [p for p in map(yaml.safe_load, texts) if isinstance(p, dict)])


def validate(policies: DataFrame) -> DataFrame:
    """policies with ``warnings``; none is a valid policy."""
    short = F.transform(F.filter("must_not_share", lambda t: F.length(t) < 2), lambda t: F.concat(F.lit("short term: "), t))
    loose = F.transform(F.array_except(F.map_keys("acceptable_abstractions"), F.col("must_not_share")), lambda t: F.concat(F.lit("abstraction without a rule: "), t))
    level = F.col("sensitivity_threshold")
    own = F.array_compact(
        F.array(
            F.when(F.col("agent_id") == "", "agent_id is empty"), F.when(F.size("must_not_share") == 0, "nothing is blocked"),
            F.when(level < 1, "threshold below 1: everything is blocked").when(level > 5, "threshold above 5: nothing is blocked"),
        )
    )
    return policies.withColumn("warnings", F.concat(own, short, loose))


def save(policies: DataFrame, path: str) -> None:
    policies.write.mode("error").json(path)
