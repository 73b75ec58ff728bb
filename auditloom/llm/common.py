"""What the corpus operators share: tables in the cluster's shared folder, and column hygiene.

Intermediate results that must outlive an executor are written as Parquet into the folder named by
``spark.checkpoint.dir`` (read from the session). Only where that is unset and the master is local, as in tests, a local
folder is made.
"""

from __future__ import annotations

import atexit
import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditloom.functions.shared import drop_path, shared_dir
from auditloom.sources.tables import table

__all__ = ["Table", "drop_path", "frugal", "shared_dir", "table", "text_or_empty", "unit_hash"]

_left: list[tuple[SparkSession, str]] = []


@atexit.register
def _sweep() -> None:
    for spark, path in _left:
        try:
            drop_path(spark, path)
        except Exception:  # the session is gone, and its folder is the cluster's to clear
            return


class Table:
    """A DataFrame that was written once to the shared folder and is read from there."""

    def __init__(self, df: DataFrame, label: str):
        self.spark = df.sparkSession
        self.path = f"{shared_dir(self.spark)}/auditloom/{label}-{uuid.uuid4().hex}"
        df.write.parquet(self.path)
        _left.append((self.spark, self.path))

    @property
    def df(self) -> DataFrame:
        return self.spark.read.parquet(self.path)

    def drop(self) -> None:
        """To be called when nothing will read the table again."""
        drop_path(self.spark, self.path)
        _left.remove((self.spark, self.path))


def unit_hash(seed: int, *cols) -> F.Column:
    """A number in (0, 1) from 52 bits of MD5 over the seed and the columns; a null counts as '~'."""
    parts = [F.lit(str(seed))] + [F.coalesce(c.cast("string"), F.lit("~")) for c in cols]
    digits = F.substring(F.md5(F.concat_ws(":", *parts)), 1, 13)
    return (F.conv(digits, 16, 10).cast("bigint") + F.lit(0.5)) / F.lit(float(2**52))


def text_or_empty(col: str = "text") -> F.Column:
    return F.coalesce(F.col(col), F.lit(""))


def frugal(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for mapInArrow that gives memory back when its task ends: workers are kept for later tasks, of other operators too."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
        if trim is not None:
            trim(0)

    return wrapped
