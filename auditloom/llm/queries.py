"""The corpus operators as queries over whole tables, with DuckDB SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditloom.llm import bpe, chosen_path, flat_graph, langid, license_scan, mixing, secret_scan, sharding, vptree, warc_index
from auditloom.llm.common import table


def op1_warc_index_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_index.merge_index(table(spark, sf_dir, "pages"))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chosen_path.classes(table(spark, sf_dir, "documents"))


def op3_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_table(table(spark, sf_dir, "documents"))


def op4_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat_graph.near_duplicates(table(spark, sf_dir, "embeddings"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(table(spark, sf_dir, "documents"))


def op8_vptree_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The queries are the vectors whose id is divisible by 20, held against all vectors."""
    found = vptree.neighbours(table(spark, sf_dir, "embeddings"), asked=lambda i: i % vptree.EVERY == 0)
    each = found.select("vec_id", F.posexplode(F.arrays_zip(F.col("neighbours").alias("n"), F.col("distances").alias("d"))).alias("rank", "z"))
    return each.select("vec_id", (F.col("rank") + 1).alias("rank"), F.col("z.n").alias("neighbour"), F.round("z.d", 6).alias("distance"))


def op9_shard_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


_ALL = (
    op1_warc_index_merge, op2_ngram_jaccard_join, op3_bpe_codec, op4_embedding_near_dedup, op5_license_scan,
    op6_mix_sources, op7_secret_scan, op8_vptree_neighbours, op9_shard_shuffle, op10_language_id,
)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in _ALL}

#: The approximate operators 2, 4 and 8 have SQL for the exact result.
ORACLE: dict[str, str] = {
    "op1_warc_index_merge": warc_index.SQL,
    "op2_ngram_jaccard_join": chosen_path.SQL,
    "op4_embedding_near_dedup": flat_graph.SQL,
    "op6_mix_sources": mixing.SQL,
    "op8_vptree_neighbours": vptree.SQL,
}
