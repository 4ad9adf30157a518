"""Hit rate, precision, recall and reciprocal rank of ranked results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def mean_or_null(c: Column) -> Column:
    return F.avg(F.when(~F.isnan(c), c))


def retrieval_metrics(found: DataFrame, expected: DataFrame, query: str, id_: str) -> DataFrame:
    """Per question: hits, hit, precision over distinct results, recall over distinct expected ids (null without any),
    reciprocal rank of the first hit."""
    wanted = expected.select(query, id_).distinct()
    totals = wanted.groupBy(query).agg(F.count(F.lit(1)).alias("expected"))
    first = found.groupBy(query, id_).agg(F.min("rank").alias("rank"))
    marked = first.join(wanted.withColumn("good", F.lit(True)), [query, id_], "left")
    per = marked.groupBy(query).agg(F.count("good").alias("hits"), F.count(F.lit(1)).alias("results"), F.min(F.when(F.col("good"), F.col("rank"))).alias("at"))
    out = per.join(totals, query, "full_outer")
    hits = F.coalesce("hits", F.lit(0))
    return out.select(query, hits.alias("hits"), (hits > 0).alias("hit"), F.coalesce(hits / F.col("results"), F.lit(0.0)).alias("precision"), (hits / F.col("expected")).alias("recall"), F.coalesce(1.0 / F.col("at"), F.lit(0.0)).alias("mrr"))


def summary(per_query: DataFrame) -> DataFrame:
    return per_query.groupBy("backend").agg(F.count(F.lit(1)).alias("samples"), F.avg(F.col("hit").cast("int")).alias("hit_rate"), F.avg("precision").alias("precision"), F.avg("recall").alias("recall"), F.avg("mrr").alias("mrr"))
