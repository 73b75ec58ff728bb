"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

A document's key is ``-ln(u) / w``: ``u`` is a seeded hash of its id and ``w`` its quality weight, so
ascending keys are a weighted sample without replacement. Within a source the documents are put in
key order and their tokens prefix-summed. A source whose target is above its own size is repeated for
as many complete epochs as fit; the rest of the target is filled from the front of the key order with
documents whose inclusive prefix sum stays within it.

No source is sorted in one task. Keys are cut into ranges by a monotone map into ``buckets``, the
ranges' token totals are accumulated, and only the one range in which the target falls is
ordered exactly, so a hot source is no straggler. The decision is then a comparison with one boundary for each
source: the documents are shuffled once, by id, to meet their weights, and not at all if there are no labels.

Defined results: a null source is a source of its own, with its name staying null. A null or blank text has 0 tokens; it
costs nothing and is taken with its neighbours in key order; rows of a source without any token are taken once. A null id counts as one id. Equal keys are
ordered by id (nulls first), then token count; rows that repeat an id and a text share one decision only if both are
within the target. A null or non-positive weight counts as 1. An empty table gives an empty result.
Extra columns are kept by ``mix`` whatever their names: a row travels as one struct.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from auditloom.llm.common import Table, unit_hash

SEED = 20240607
#: Target shares are in proportion to tokens ** TEMPERATURE.
TEMPERATURE = 0.7
#: Ranges of keys in each source.
BUCKETS = 4096


def token_count(col: str = "text") -> Column:
    """Runs of characters other than blank, tab, line feed and carriage return."""
    return F.coalesce(F.regexp_count(F.col(col), F.lit("[^ \\t\\n\\r]+")), F.lit(0)).cast("bigint")


def quality_weights(labels: DataFrame) -> DataFrame:
    """(__mix_id, __mix_w): 2 for quality 1, 0.5 for quality 0, a quarter of it for toxic documents.

    Several labels of one id count as their largest quality and toxicity; labels without an id go.
    """
    per = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("__mix_id")).agg(F.max("quality").alias("q"), F.max("toxic").alias("t"))
    w = F.when(F.col("q") == 1, 2.0).when(F.col("q") == 0, 0.5).otherwise(1.0) * F.when(F.col("t") == 1, 0.25).otherwise(1.0)
    return per.select("__mix_id", w.alias("__mix_w"))


def keyed(docs: DataFrame, labels: DataFrame | None, seed: int) -> DataFrame:
    """__mix_row (the row of docs as it is, so no column of docs can clash), source, __mix_id, __mix_n (tokens), __mix_w (weight) and __mix_key."""
    out = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__mix_row"), "source", F.col("doc_id").alias("__mix_id"), token_count().alias("__mix_n"))
    if labels is not None:
        # One plan at every size: weights grow with the documents, so they aren't broadcast while they happen to be few.
        out = out.join(quality_weights(labels).hint("merge"), "__mix_id", "left")
    else:
        out = out.withColumn("__mix_w", F.lit(1.0))
    out = out.withColumn("__mix_w", F.when(F.col("__mix_w") > 0, F.col("__mix_w")).otherwise(1.0))
    return out.withColumn("__mix_key", -F.ln(unit_hash(seed, F.col("__mix_id"))) / F.col("__mix_w"))


def _range(buckets: int) -> Column:
    return F.floor((1 - F.exp(-F.col("__mix_key"))) * buckets).cast("int")


def boundaries(slim: DataFrame, budget: int | None, temperature: float, buckets: int) -> DataFrame:
    """One row for each source: __mix_src, __mix_epochs and the last (key, id, tokens) taken in part, null if none."""
    src = F.col("source").alias("__mix_src")
    hist = Table(slim.groupBy(src, _range(buckets).alias("b")).agg(F.sum("__mix_n").alias("tokens")), "mix-histogram")
    by_source = hist.df.groupBy("__mix_src").agg(F.sum("tokens").alias("have"))
    share = F.pow(F.col("have").cast("double"), F.lit(temperature))
    total = by_source.agg(F.sum("have").alias("all_tokens"), F.sum(share).alias("all_share"))
    goal = F.floor((F.lit(float(budget)) if budget is not None else F.col("all_tokens")) * share / F.col("all_share"))
    targets = (
        by_source.crossJoin(total)  # one row
        .withColumn("target", F.coalesce(goal, F.lit(0)).cast("bigint"))
        .withColumn("epochs", F.when(F.col("have") > 0, F.floor(F.col("target") / F.col("have"))).otherwise(1).cast("int"))
        .withColumn("rest", F.col("target") - F.col("epochs") * F.col("have"))
        .select("__mix_src", "have", "target", "epochs", "rest")
    )
    before = F.sum("tokens").over(Window.partitionBy("__mix_src").orderBy("b").rowsBetween(Window.unboundedPreceding, -1))
    open_ranges = (
        hist.df.withColumn("before", F.coalesce(before, F.lit(0)))
        .withColumnsRenamed({"__mix_src": "s"})
        .join(targets, F.col("s").eqNullSafe(F.col("__mix_src")))
        .where("before <= rest and before + tokens > rest")  # where the target falls; one range, and zero-token ranges before it are whole
        .select("s", "b", "before", "rest")
    )
    rows = slim.select(F.col("source").alias("src"), _range(buckets).alias("r"), "__mix_key", "__mix_id", "__mix_n")
    order = Window.partitionBy("src", "r").orderBy("__mix_key", "__mix_id", "__mix_n")
    inside = (
        rows.join(open_ranges, F.col("src").eqNullSafe(F.col("s")) & (F.col("r") == F.col("b")))
        .withColumn("upto", F.col("before") + F.sum("__mix_n").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .where("upto <= rest")
        .groupBy("src")
        .agg(F.max(F.struct("__mix_key", "__mix_id", "__mix_n")).alias("last"))
    )
    cut = open_ranges.select(F.col("s").alias("cut_src"), F.col("b").alias("cut_b"))
    return (
        targets.join(cut, F.col("__mix_src").eqNullSafe(F.col("cut_src")), "left")
        .join(inside, F.col("__mix_src").eqNullSafe(F.col("src")), "left")
        .select("__mix_src", F.col("epochs").alias("__mix_epochs"), F.col("rest").alias("__mix_rest"), F.coalesce("cut_b", F.lit(-1)).alias("__mix_cut"), F.col("last").alias("__mix_last"))
    )


def decide(docs: DataFrame, labels: DataFrame | None = None, budget: int | None = None, temperature: float = TEMPERATURE, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """The columns of ``keyed`` and __mix_copies: how often the mixture takes each row, 0 included.

    budget: tokens of the mixture; all tokens of docs if None.
    """
    rows = keyed(docs, labels, seed)
    slim = Table(rows.select("source", "__mix_key", "__mix_id", "__mix_n"), "mix-keys")
    edge = Table(boundaries(slim.df, budget, temperature, buckets), "mix-boundaries")
    slim.drop()
    at = F.struct("__mix_key", "__mix_id", "__mix_n")
    inside = (_range(buckets) < F.col("__mix_cut")) | ((_range(buckets) == F.col("__mix_cut")) & F.coalesce(at <= F.col("__mix_last"), F.lit(False)))
    return (
        rows.join(edge.df, F.col("source").eqNullSafe(F.col("__mix_src")))
        .withColumn("__mix_copies", F.col("__mix_epochs") + F.when(inside, 1).otherwise(0))
        .drop("__mix_src", "__mix_epochs", "__mix_rest", "__mix_cut", "__mix_last")
    )


def mix(docs: DataFrame, labels: DataFrame | None = None, budget: int | None = None, temperature: float = TEMPERATURE, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """The mixture: the rows and columns of docs, each row as often as it is taken."""
    taken = decide(docs, labels, budget, temperature, buckets, seed).where("__mix_copies > 0")
    again = taken.withColumn("__mix_again", F.explode(F.sequence(F.lit(1), F.col("__mix_copies"))))
    return again.select("__mix_row.*")


def report(docs: DataFrame, labels: DataFrame | None = None, **kw) -> DataFrame:
    """One row for each row of docs: doc_id, source, n_tokens, weight, copies."""
    return decide(docs, labels, **kw).select(F.col("__mix_id").alias("doc_id"), "source", F.col("__mix_n").alias("n_tokens"), F.col("__mix_w").alias("weight"), F.col("__mix_copies").alias("copies"))


SQL = f"""
WITH w AS (
  SELECT doc_id AS id, (CASE max(quality) WHEN 1 THEN 2.0 WHEN 0 THEN 0.5 ELSE 1.0 END)
         * (CASE max(toxic) WHEN 1 THEN 0.25 ELSE 1.0 END) AS w
  FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\r]+')) AS BIGINT) AS n_tokens,
         CAST(coalesce(w.w, 1.0) AS DOUBLE) AS weight,
         -ln((CAST(('0x' || substr(md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '~')), 1, 13)) AS BIGINT) + 0.5) / 4503599627370496.0)
           / CAST(coalesce(w.w, 1.0) AS DOUBLE) AS k
  FROM documents LEFT JOIN w ON w.id = documents.doc_id),
s AS (SELECT source, sum(n_tokens) AS have FROM d GROUP BY source),
t AS (
  SELECT source, have, CAST(floor(CAST(sum(have) OVER () AS DOUBLE) * pow(CAST(have AS DOUBLE), {TEMPERATURE})
         / sum(pow(CAST(have AS DOUBLE), {TEMPERATURE})) OVER ()) AS BIGINT) AS target FROM s),
e AS (SELECT source, have, target, CASE WHEN have > 0 THEN CAST(floor(target / have) AS INTEGER) ELSE 0 END AS epochs FROM t),
p AS (
  SELECT d.*, sum(n_tokens) OVER (PARTITION BY source ORDER BY k, doc_id NULLS FIRST, n_tokens ROWS UNBOUNDED PRECEDING) AS upto FROM d)
SELECT p.doc_id, p.source, p.n_tokens, p.weight,
       e.epochs + CASE WHEN p.upto <= e.target - e.epochs * e.have THEN 1 ELSE 0 END AS copies
FROM p JOIN e ON p.source IS NOT DISTINCT FROM e.source
"""
