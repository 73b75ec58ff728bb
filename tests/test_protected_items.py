"""The tiered detector on messages, tier by tier."""

from pyspark.sql import functions as F

from auditloom import registry
from auditloom.operators import text as T

SALARY = "the board has agreed that margaret holds the northern account until the spring audit ends"
CASES = {
    1: ("we heard that " + SALARY + " and more", ("full", 1)), 2: ("write to bob@example.com about it", ("full", 2)), 3: ("they are on six figures over there", ("full", 3)),
    4: ("the board has agreed that margaret holds the northern account until the autumn", ("full", 3)), 5: ("the board agreed margaret keeps the northern account until the spring, says bob", ("partial", 3)), 6: ("nothing to be seen here", ("none", None)),
}


def test_each_tier_and_the_score_of_every_pair(spark):
    m = spark.createDataFrame([(k, t) for k, (t, _) in CASES.items()], "message int, text string")
    items = spark.createDataFrame([(1, SALARY), (2, "salary")], "item_id int, item string")
    got = {r.message: r for r in T.detect_items(m, items, F.size(T.structured_fields(F.col("text"), "email")) > 0).collect()}
    assert {k: (r.level, r.tier) for k, r in got.items()} == {k: want for k, (_, want) in CASES.items()}
    assert got[3].best_item == 2 and got[3].score == 0.85 and got[4].best_item == got[5].best_item == 1 and got[6].best_item is None
    slow = m.crossJoin(items).groupBy("message").agg(F.max(T.synonym_score(F.col("text"), F.col("item"), T.synonym_group(F.col("item")))).alias("s"))
    assert all(abs(got[r.message].score - r.s) < 1e-9 for r in slow.collect() if got[r.message].tier not in (1, 2))
    none = T.detect_items(m, items.limit(0), F.lit(False)).collect()
    assert len(none) == len(CASES) and {r.level for r in none} == {"none"}


def test_every_turn_is_reported(spark):
    sf = "/root/testdata/sf0.001"
    assert registry.queries()["protected_items"](spark, sf).count() == spark.read.parquet(f"{sf}/conversations.parquet").count()
