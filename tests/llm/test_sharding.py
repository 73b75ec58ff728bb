from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from auditloom.llm import sharding
from tests.llm.cases import docs, plain, prose


def test_fisher_yates_is_a_permutation_and_uniform():
    seen = Counter(tuple(sharding.fisher_yates(3, s).tolist()) for s in range(6000))
    assert len(seen) == 6 and all(850 < n < 1150 for n in seen.values())
    assert sorted(sharding.fisher_yates(1000, 1).tolist()) == list(range(1000))


def plain_fisher_yates(items, seed):
    """Written out again, with its own swaps."""
    draws, items = np.random.Generator(np.random.PCG64(seed)).random(len(items)), list(items)
    i = len(items)
    while i > 1:
        i -= 1
        j = int(draws[i] * (i + 1))
        items[i], items[j] = items[j], items[i]
    return items


def test_against_a_plain_two_pass_shuffle(spark):
    df = plain(spark, [(i, prose(i, 30)) for i in range(400)])
    got = {}
    for r in sharding.shard(df, seed=5, bucket_bytes=20_000).collect():
        got.setdefault(r.shard, {})[r.position] = r.doc_id
    hashed = [(r.h, r.p, r.doc_id) for r in df.select("doc_id", F.xxhash64(F.lit(5), *df.columns).alias("h")).withColumn("p", F.xxhash64(F.lit(6), "h")).collect()]
    buckets = {b: [] for b in range(max(got) + 1)}
    for h, p, i in sorted(hashed):
        buckets[p % len(buckets)].append(i)
    want = {b: dict(enumerate(plain_fisher_yates(ids, 5 * 1_000_003 + b))) for b, ids in buckets.items() if ids}
    assert len(want) > 3 and got == want


def test_all_rows_and_columns_stay_and_positions_are_whole(spark):
    df = docs(spark)
    assert sharding.new_names(df.columns) == ("shard_1", "position_1")
    out = sharding.shard(df, bucket_bytes=50_000)
    assert out.columns == ["shard_1", "position_1", *df.columns]
    got = out.collect()
    assert Counter(tuple(r)[2:] for r in got) == Counter(map(tuple, df.collect()))
    by = {}
    for r in got:
        by.setdefault(r.shard_1, []).append(r.position_1)
    assert all(sorted(p) == list(range(len(p))) for p in by.values())
    assert len(by) > 3


def test_tables_of_other_columns(spark):
    df = spark.createDataFrame([({"a": 1}, [1.5, None], "x"), ({}, None, None)] * 20, "m map<string, int>, v array<double>, `odd name` string")
    got = sharding.shard(df, bucket_bytes=500)
    assert got.columns == ["shard", "position", "m", "v", "odd name"]
    assert Counter(map(str, got.select("m", "v", "odd name").collect())) == Counter(map(str, df.collect())) and len({r.shard for r in got.collect()}) > 2


def test_repeated_rows_are_scattered_like_others(spark):
    df = spark.range(20_000).selectExpr("1L doc_id", "repeat('same text ', 100) text")
    sizes = Counter(r.shard for r in sharding.shard(df, bucket_bytes=1 << 20).select("shard").collect())
    assert len(sizes) == 20 and sum(sizes.values()) == 20_000 and max(sizes.values()) < 1200 and min(sizes.values()) > 800


def test_same_order_for_any_partitioning_of_the_input(spark):
    df = plain(spark, [(i, prose(i, 30)) for i in range(500)])
    key = lambda d: sorted((r.shard, r.position, r.doc_id) for r in sharding.shard(d, bucket_bytes=20_000).collect())
    assert key(df.repartition(7)) == key(df.coalesce(1))


def test_shuffle_leaves_no_order(spark):
    got = sorted((r.position, r.doc_id) for r in sharding.shard(plain(spark, [(i, "x") for i in range(2000)])).collect())
    ids = [i for _, i in got]
    rises = sum(a < b for a, b in zip(ids, ids[1:]))
    assert 900 < rises < 1100


def test_shards_are_written_in_order(spark, tmp_path):
    df = plain(spark, [(i, prose(i, 30)) for i in range(300)])
    sharding.write_shards(df, f"file://{tmp_path}/out", bucket_bytes=20_000)
    back = spark.read.parquet(f"file://{tmp_path}/out/shard=1").collect()
    want = sorted((r.position, r.doc_id) for r in sharding.shard(df, bucket_bytes=20_000).where("shard = 1").collect())
    assert [(r.position, r.doc_id) for r in back] == want and want


def test_empty_table(spark):
    assert sharding.shard(docs(spark, [])).count() == 0
