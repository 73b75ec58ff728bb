"""Embeddings as checked rows and as numpy arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditloom.llm.common import unit_hash


def clean(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", dim: int | None = None) -> DataFrame:
    """(id, v) of the rows that can be searched, each id once.

    Left out: null ids and those that are no whole number, null or empty vectors, vectors with null, NaN or infinite members, and those whose dimension is not ``dim``; where that
    isn't named, it is the commonest of the table (the smaller one on a tie). ``rejected`` lists what is left out. Of an id with several vectors the smallest by array order stays.
    """
    v = F.col(f"`{vec_col}`").cast("array<float>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    ident = F.col(f"`{id_col}`").try_cast("bigint")
    rows = df.where(ident.isNotNull() & (F.size(v) > 0) & ~bad).select(ident.alias("id"), v.alias("v"))
    if dim is None:
        sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
        if sizes is None:
            return rows
        dim = sizes["d"]
    return rows.where(F.size("v") == dim).groupBy("id").agg(F.min("v").alias("v"))


def rejected(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", dim: int | None = None) -> DataFrame:
    """(id, dimension) of the ids none of whose vectors ``clean`` keeps; null ids as one row."""
    ids = df.select(F.col(f"`{id_col}`").try_cast("bigint").alias("id"), F.size(F.col(f"`{vec_col}`")).alias("dimension")).groupBy("id").agg(F.max("dimension").alias("dimension"))
    return ids.join(clean(df, id_col, vec_col, dim).select("id"), "id", "left_anti")


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """(rows, dimension) of an Arrow list column without nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks)
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float32, copy=False).reshape(n, -1)


def lists(x: np.ndarray) -> pa.ListArray:
    """A matrix as an Arrow list column."""
    n, d = x.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, n * d + 1, d, dtype=np.int32)), pa.array(np.ascontiguousarray(x).reshape(-1)))


def pivots(rows: DataFrame, n: int, per_shard: int, seed: int) -> np.ndarray:
    """About n / per_shard vectors, drawn by a hash of the id: 64 vectors for a million rows at the usual size, so the driver can hold them."""
    want = max(1, -(-n // per_shard))
    share = min(1.0, (want + 4 * want**0.5 + 8) / max(1, n))
    drawn = rows.withColumn("u", unit_hash(seed, F.col("id"))).where(F.col("u") < share).orderBy("u", "id").limit(want).collect()
    x = np.array([r["v"] for r in drawn], np.float32)
    return np.unique(x, axis=0) if len(x) else x


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared Euclidean distances of the rows of a and b, not below zero."""
    d = a @ b.T
    d *= -2
    d += (a * a).sum(1)[:, None]
    d += (b * b).sum(1)[None, :]
    return np.maximum(d, 0, out=d)
