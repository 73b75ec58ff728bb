"""The tiered detector meets items through lists of grams and words, not pair by pair, and scores as synonym_score does."""

from pyspark.sql import functions as F

from auditloom.operators import text as T

TEXTS = ["", "a", "  Ab ", "the salary of bob", "Bob's INCOME is high", "x" * 700, "bob bob alice", "ALICE met bob bob", None, "né à Paris  "]
ITEMS = ["salary", "bob", "alice met bob", "", None, "zz", " ab", "Paris à né"]


def test_scores_of_odd_texts_in_several_passes(spark, monkeypatch):
    monkeypatch.setattr(T, "ITEMS", 3)
    m = spark.createDataFrame(list(enumerate(TEXTS)), "message int, text string")
    for some in (ITEMS, [x for x in ITEMS if x]):
        i = spark.createDataFrame(list(enumerate(some)), "item_id int, item string")
        df = T.detect_items(m, i, F.lit(False), partial=0.2)
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan
        got = {r.message: r for r in df.collect()}
        pairs = m.crossJoin(i).select("message", "item_id", F.coalesce(F.contains("text", "item"), F.lit(False)).alias("canary"), T.synonym_score(F.col("text"), F.col("item"), T.synonym_group(F.col("item"))).alias("s"))
        want = {r.message: r for r in pairs.groupBy("message").agg(F.bool_or("canary").alias("canary"), F.max("s").alias("s"), F.max_by("item_id", F.struct("s", -F.col("item_id"))).alias("best"), F.count_if(F.col("s") >= 0.2).alias("near")).collect()}
        for k, w in want.items():
            g = got[k]
            assert (g.tier == 1) == w.canary and (w.canary or (abs(g.score - w.s) < 1e-9 and g.matches == w.near and g.best_item == (w.best if w.s >= 0.2 else None))), (k, g, w)
