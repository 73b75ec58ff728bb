"""Order without a hot group in one task's memory: numbering by ranges, and state machines that read sorted rows as a stream."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from auditloom.functions.shared import written


def numbered(df: DataFrame, group: list[str], order: list[str], name: str = "idx", total: str = "n") -> DataFrame:
    """df with the row's number in its group (from 0, by order) and the group's size.

    Rows are cut into ranges of (group, order), so one group of any size is spread over tasks; a number is the place in the range plus what earlier ranges hold of the group.
    """
    t = written(df.repartitionByRange(*group, *order).sortWithinPartitions(*group, *order).withColumns({"__p": F.spark_partition_id(), "__m": F.monotonically_increasing_id()}), "numbered")
    seg = t.groupBy(*group, "__p").agg(F.min("__m").alias("__first"), F.count("*").alias("__k"))
    w = Window.partitionBy(*group).orderBy("__p")  # a row for each range that the group is in
    before = F.coalesce(F.sum("__k").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    seg = seg.withColumns({"__off": before, total: F.sum("__k").over(Window.partitionBy(*group))}).drop("__k")
    j = t.alias("t").join(seg.alias("s"), [F.col(f"t.{c}").eqNullSafe(F.col(f"s.{c}")) for c in (*group, "__p")])
    return j.select(*[F.col(f"t.{c}") for c in df.columns], (F.col("__m") - F.col("__first") + F.col("__off")).alias(name), F.col(f"s.{total}"))


def in_order(df: DataFrame, key: str, order: list[str], start: Callable[[], Any], step: Callable[[Any, Any], tuple], schema: str) -> DataFrame:
    """step(state, row) -> output row, over the rows of each key in order; start() makes the state of a new key.

    Rows come sorted through the task as a stream of batches, so what is held is one key's state, however many rows it has.
    """
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now: Any = object()
        state: Any = None
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                k = getattr(r, key)
                if k != now:
                    now, state = k, start()
                out.append(step(state, r))
            if out:
                yield pd.DataFrame(out, columns=names)

    return df.where(F.col(key).isNotNull()).repartition(key).sortWithinPartitions(key, *order).mapInPandas(run, schema)
