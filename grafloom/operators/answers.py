"""What an answer rests on: sources that are checked, those out of force left out, and whether a cached answer still holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grafloom.operators import merge, records

#: Laws that are checked for one question.
LAWS = 16


def laws_of(sources: DataFrame, query: str, limit: int = LAWS) -> DataFrame:
    """(query, code, title, place): the first distinct laws that the sources (query, rank, citation, title, doc_id) name."""
    named = sources.select(query, "rank", records.law_identity(F.col("citation"), F.col("title"), F.col("doc_id").cast("string")).alias("law"))
    first = named.groupBy(query, F.col("law.code").alias("code")).agg(F.min("rank").alias("rank"), F.min_by("law.title", "rank").alias("title"))
    place = F.row_number().over(Window.partitionBy(query).orderBy("rank", "code"))
    return first.withColumn("place", place).filter(F.col("place") <= limit).drop("rank")


def verified(laws: DataFrame, registry: DataFrame, query: str, as_of: Column, hours: int = 24) -> tuple[DataFrame, DataFrame]:
    """(items, reports) of laws (query, code) by a registry (code, status, verified_at): items are (query, code, status,
    fresh), UNKNOWN where the registry has no state; a report says of each question whether all its laws were checked
    within ``hours`` and whether all are in force."""
    known = registry.select("code", F.col("status").alias("state"), "verified_at")
    joined = laws.join(known, "code", "left")
    recent = F.coalesce(F.col("verified_at") >= as_of - F.make_dt_interval(hours=F.lit(hours)), F.lit(False))
    items = joined.select(query, "code", F.coalesce("state", F.lit("UNKNOWN")).alias("status"), recent.alias("fresh"))
    reports = items.groupBy(query).agg(F.count(F.lit(1)).alias("n_laws"), F.bool_and("fresh").alias("checked"), (F.bool_and("fresh") & F.bool_and(F.col("status").isin(*merge.CURRENT))).alias("all_current"))
    return items, reports


def usable(sources: DataFrame, items: DataFrame, query: str) -> DataFrame:
    """Sources whose label names no law of their question that is out of force or unknown, ranked and named anew; a
    question of which no source is left has no row."""
    blocked = items.filter(F.col("status").isin(*merge.BLOCKED)).groupBy(query).agg(F.collect_set(F.upper("code")).alias("blocked"))
    label = F.upper(F.concat(F.coalesce("citation", F.lit("")), F.lit(" "), F.coalesce("title", F.lit(""))))
    # At most LAWS codes a question.
    kept = sources.join(blocked, query, "left").filter(~F.coalesce(F.exists("blocked", lambda c: F.contains(label, c)), F.lit(False))).drop("blocked")
    place = F.row_number().over(Window.partitionBy(query).orderBy("rank"))
    return kept.withColumn("rank", place).withColumn("source_id", F.concat(F.lit("S"), F.col("rank").cast("string")))


def resolved(sources: DataFrame, registry: DataFrame, query: str, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """(sources, reports): sources are checked, those out of force dropped and the rest renumbered; a report adds whether
    any source is left (``answerable``)."""
    items, reports = verified(laws_of(sources, query), registry, query, as_of)
    kept = usable(sources, items, query)
    left = kept.select(query).distinct().withColumn("answerable", F.lit(True))
    return kept, reports.join(left, query, "left").withColumn("answerable", F.coalesce("answerable", F.lit(False)))


def decided(hits: DataFrame, cache: DataFrame, reports: DataFrame, prints: DataFrame, query: str) -> DataFrame:
    """(query, mode, cache_id, invalidate) for the results of a cache lookup (query, cache_id, kind).

    An entry holds if its laws were checked, all are in force, and the fingerprint of its sources and their states
    (prints: cache_id, fingerprint) is the one it was stored with (cache: id, law_fingerprint).  An exact hit that holds
    answers, a near one is a draft; an entry that does not hold ends, and its question counts as missed.
    """
    stored = cache.select(F.col("id").alias("cache_id"), "law_fingerprint")
    joined = hits.select(query, "cache_id", "kind").join(stored, "cache_id", "left").join(prints, "cache_id", "left").join(reports.select("cache_id", "checked", "all_current"), "cache_id", "left")
    holds = F.coalesce(F.col("checked") & F.col("all_current") & (F.col("fingerprint") == F.col("law_fingerprint")), F.lit(False))
    found = F.col("cache_id").isNotNull()
    mode = F.when(found & holds, F.when(F.col("kind") == "exact", "exact").otherwise("semantic_draft")).otherwise("miss")
    return joined.select(query, mode.alias("mode"), "cache_id", (found & ~holds).alias("invalidate"))
