"""Where a model can be plugged in: similarity, judge, tagger and embeddings as pandas UDFs over whole Arrow batches. None is built in, as there is no network; the operators work without them."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Judge = Callable[[pd.Series], pd.Series]


def similarity(score: Callable[[pd.Series, pd.Series], pd.Series]) -> Callable[[Column, Column], Column]:
    """A similarity of two texts in 0 to 1; a null text or result counts as 0."""

    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(score(a.fillna(""), b.fillna(""))).astype("float64").fillna(0.0)

    return F.pandas_udf(run, "double")


def parse_response(text: str | None) -> float | None:
    """The score of a judge's answer: the number under "score" of its JSON, with or without a fence around it, else the first number from 0 to 1; null if there is none."""
    if not text:
        return None
    body = re.search(r"\{.*\}", text, re.S)
    if body:
        try:
            score = json.loads(body.group())["score"]
            return min(1.0, max(0.0, float(score)))
        except (ValueError, KeyError, TypeError):
            pass
    found = re.search(r"(?<![\d.])(?:0(?:\.\d+)?|1(?:\.0+)?)(?!\.?\d)", text)
    return float(found.group()) if found else None


def judged(df: DataFrame, text: str, answer: Judge, name: str = "judge", cap: int | None = None) -> DataFrame:
    """df with the score of a judge (texts to answers, as a model gives them): equal texts are asked about once, which is what a cache is for. cap: characters that a judge is shown, all of them if None."""
    shown = F.col(text) if cap is None else F.substring(text, 1, cap)
    ask = F.pandas_udf(lambda s: answer(s).map(parse_response).astype("float64"), "double")
    keyed = df.withColumn("__k", F.sha2(shown, 256))
    each = keyed.where(F.col(text).isNotNull()).select("__k", shown.alias("__t")).dropDuplicates(["__k"]).select("__k", ask(F.col("__t")).alias(name))
    return keyed.join(each, "__k", "left").drop("__k")


def tagged(df: DataFrame, text: str, tagger: Callable[[pd.Series], pd.Series], floor: dict[str, Column]) -> DataFrame:
    """df with category and inferred: a tagger's categories (texts to JSON with "category" and "inferred") over the lexical ones, which are never lost; what is a category is not inferred."""
    ask = F.pandas_udf(lambda s: tagger(s).astype("string"), "string")
    said = F.from_json(ask(F.coalesce(F.col(text), F.lit(""))), "category array<string>, inferred array<string>")
    df = df.withColumns({"__s": said, "__c": floor["category"], "__i": floor["inferred"]})
    none = F.array().cast("array<string>")
    category = F.array_sort(F.array_union("__c", F.coalesce("__s.category", none)))
    inferred = F.array_sort(F.array_except(F.array_union("__i", F.coalesce("__s.inferred", none)), category))
    return df.withColumns({"category": category, "inferred": inferred}).drop("__s", "__c", "__i")


def embedding_cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors, clipped to 0 to 1 as a similarity; 0 if one is zero, null or of another size."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    ok = (F.size(a) == F.size(b)) & (norm(a) > 0) & (norm(b) > 0)
    return F.when(ok, F.greatest(F.lit(0.0), F.least(F.lit(1.0), dot / (norm(a) * norm(b))))).otherwise(0.0)


def precomputed(items: DataFrame, text: str, embed: Callable[[pd.Series], pd.Series]) -> DataFrame:
    """items with ``vector``: embeddings made once, for distinct texts."""
    ask = F.pandas_udf(lambda s: embed(s).map(lambda v: [float(x) for x in v]), "array<double>")
    each = items.select(text).where(F.col(text).isNotNull()).distinct().select(F.col(text).alias("__t"), ask(F.col(text)).alias("vector"))
    return items.join(each, F.col(text) == F.col("__t"), "left").drop("__t")
