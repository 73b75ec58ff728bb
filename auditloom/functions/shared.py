"""Tables in the cluster's shared folder, to cut the lineage of loops. The folder is the session's spark.checkpoint.dir; a local one is made only where that is unset and the master is local, as in tests."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
_left: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="auditloom-")
    return _own[app]


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a table of ours from the shared folder."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


@atexit.register
def _sweep() -> None:
    for spark, path in _left:
        try:
            drop_path(spark, path)
        except Exception:  # the session is gone, and its folder is the cluster's to clear
            return


def written(df: DataFrame, label: str) -> DataFrame:
    """df, computed once and read back from the shared folder; deleted when the driver ends."""
    path = f"{shared_dir(df.sparkSession)}/auditloom/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _left.append((df.sparkSession, path))
    return df.sparkSession.read.parquet(path)
