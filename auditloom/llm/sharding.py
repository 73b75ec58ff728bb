"""Sharding by a two-pass external shuffle.

Pass 1 scatters the rows uniformly into buckets that fit in memory, by a seeded hash of their content; rows that are repeated are told apart by their place in the
written input, so a group of copies is spread like any other rows. Pass 2 puts each bucket in the order of the hashes and permutes it by a Fisher-Yates shuffle seeded
with the bucket's number. The input is written to the shared folder first, so a task that runs again sees the same places and writes the same rows in the same order.
The number of buckets follows the bytes of all columns of the input. ``write_shards`` writes every bucket as a folder of its own.

Defined results: rows are kept whatever they hold: nulls, empty and very long texts, columns of any name and kind; a table needs no column of a certain name. Rows without repetition have one order for any partitioning
of the input; where rows are repeated, the order is one for each partitioning. An
empty table gives no rows. The new columns are named ``shard`` and ``position``; where the input has such a column, it stays, and the new one is ``shard_1`` or ``position_1``, and so on (``new_names``).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditloom.llm.common import Table, frugal

SEED = 77
#: Bytes of a bucket.
BUCKET_BYTES = 24 << 20


def fisher_yates(n: int, seed: int) -> np.ndarray:
    """The permutation of 0..n-1 by Durstenfeld's form of the shuffle."""
    order = list(range(n))
    draws = np.random.Generator(np.random.PCG64(seed)).random(n)
    for i in range(n - 1, 0, -1):
        j = int(draws[i] * (i + 1))
        order[i], order[j] = order[j], order[i]
    return np.asarray(order, dtype=np.int64)


def bucket_seed(seed: int, bucket: int) -> int:
    return seed * 1_000_003 + bucket


def new_names(columns: list[str]) -> tuple[str, str]:
    """Names of the two new columns that no column has, whatever its case."""
    taken = {c.lower() for c in columns}
    free = lambda name: next(x for x in (name, *(f"{name}_{k}" for k in range(1, len(taken) + 2))) if x not in taken)
    return free("shard"), free("position")


def _bytes(field: T.StructField, col: F.Column) -> F.Column:
    """Bytes of a value, as text for a nested one."""
    if isinstance(field.dataType, (T.StringType, T.BinaryType)):
        return F.octet_length(col)
    if isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
        return F.octet_length(F.to_json(F.struct(col.alias("x"))))
    return F.lit(8)


def _hashed(field: T.StructField, col: F.Column) -> F.Column:
    """Something of a column that can be hashed: maps can't be."""
    return F.to_json(F.struct(col.alias("x"))) if "map<" in field.dataType.simpleString() else col


def shard(docs: DataFrame, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """docs with the new columns first: the bucket, and the position (0, 1, ...) in it."""
    fields, (shard_name, position_name) = docs.schema.fields, new_names(docs.columns)
    cols = [F.col(f"`{f.name}`") for f in fields]
    mine = [f"c{k}" for k in range(len(fields))]  # no name of docs can clash with ours
    h = F.xxhash64(F.lit(seed), *[_hashed(f, c) for f, c in zip(fields, cols)])
    size = sum((F.coalesce(_bytes(f, c), F.lit(0)) for f, c in zip(fields, cols)), F.lit(16))
    rows = Table(docs.select(*[c.alias(m) for c, m in zip(cols, mine)], h.alias("h"), size.cast("bigint").alias("s"), F.monotonically_increasing_id().alias("r")), "shard-input")
    total = rows.df.agg(F.sum("s")).first()[0] or 0
    n = max(1, math.ceil(total / bucket_bytes))
    repeated = Table(rows.df.groupBy(F.col("h").alias("again")).agg(F.count("*").alias("k")).where("k > 1").select("again"), "shard-repeated")
    place = F.when(F.col("again").isNull(), F.xxhash64(F.lit(seed + 1), "h")).otherwise(F.xxhash64(F.lit(seed + 1), "h", "r"))
    scattered = rows.df.join(repeated.df, F.col("h") == F.col("again"), "left").withColumn("b", F.pmod(place, F.lit(n)).cast("int")).select(*mine, "h", "r", "b").repartitionById(n, F.col("b"))
    names = [shard_name, position_name, *docs.columns]
    schema = T.StructType([T.StructField(shard_name, T.IntegerType()), T.StructField(position_name, T.LongType()), *[T.StructField(f.name, f.dataType, True) for f in fields]])

    def shuffle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = [b for b in batches if b.num_rows]
        if not whole:
            return
        t = pa.Table.from_batches(whole)
        for b in sorted(pc.unique(t["b"]).to_pylist()):
            part = t.filter(pc.equal(t["b"], b))
            first = np.lexsort((part["r"].to_numpy(), part["h"].to_numpy()))
            order = first[fisher_yates(part.num_rows, bucket_seed(seed, b))]
            for at in range(0, len(order), 2000):
                out = part.take(pa.array(order[at : at + 2000])).combine_chunks()
                new = [pa.array(np.full(out.num_rows, b, np.int32)), pa.array(np.arange(at, at + out.num_rows, dtype=np.int64))]
                new += [out[c].combine_chunks() if out[c].num_chunks != 1 else out[c].chunk(0) for c in mine]
                yield pa.RecordBatch.from_arrays(new, names=names)

    return scattered.mapInArrow(frugal(shuffle), schema)


def write_shards(docs: DataFrame, path: str, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> None:
    """Writes the buckets as Parquet under path, a folder ``<shard>=<number>`` for each, its rows in shuffled order."""
    shard(docs, seed, bucket_bytes).write.partitionBy(new_names(docs.columns)[0]).parquet(path)
