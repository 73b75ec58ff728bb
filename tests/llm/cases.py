"""Rows that every corpus operator must take: nulls, empty and very long texts, ties, repeated rows, columns with odd names."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

WORDS = "river stone garden window letter winter summer bridge forest market silver copper candle basket thunder meadow harbour village captain kitchen".split()
SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
        # names that the operators use inside
        *[T.StructField(c, T.StringType()) for c in ("shard", "position", "set_id", "grams", "a", "b", "root", "w", "k", "n", "key", "id", "x", "start", "__mix_n", "copies")],
    ]
)
EXTRA = [f.name for f in SCHEMA.fields[5:]]


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + str(rng.randrange(50)) for _ in range(n))


def rows() -> list[tuple]:
    base = [
        (1, prose(1, 60), "en", "web"), (2, prose(1, 60), "en", "web"), (3, prose(3, 60), "de", "books"), (3, prose(3, 60), "de", "books"),
        (4, None, None, None), (5, "", "en", "web"), (6, "   \n\t ", "en", "web"), (None, prose(7, 40), "en", None), (None, None, None, None),
        (8, prose(8, 30_000), "en", "web"), (9, "one", "en", "web"), (10, "two words", None, "books"), (11, "x" * 300_000, "en", "web"), (12, "日本語のテキスト é ß \U0001f600 " * 20, "ja", "web"),
    ]
    return [(i, t, lang, src, None if t is None else len(t), *["?"] * len(EXTRA)) for i, t, lang, src in base]


def docs(spark: SparkSession, data: list[tuple] | None = None) -> DataFrame:
    return spark.createDataFrame(rows() if data is None else data, SCHEMA)


def plain(spark: SparkSession, pairs: list[tuple]) -> DataFrame:
    """(doc_id, text) rows, with the columns of documents."""
    return spark.createDataFrame([(i, t, "en", "web", None if t is None else len(t)) for i, t in pairs], T.StructType(SCHEMA.fields[:5]))
