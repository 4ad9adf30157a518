"""Keyed merges, versions, registries and caches as snapshots: each returns the table as it is after the change."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grafloom.operators.search import containing

#: States of a law that count as in force, and those whose sources are not used.
CURRENT = ("IN_FORCE", "PARTIALLY_IN_FORCE", "AMENDED")
BLOCKED = ("EXPIRED", "REPLACED", "UNKNOWN")


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of ``new`` replace those of ``old`` with their key."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def upsert_columns(old: DataFrame, new: DataFrame, key: str, keep: tuple[str, ...]) -> DataFrame:
    """As ``upsert``, but columns in ``keep`` stay as they were where the key was known."""
    both = old.alias("o").join(new.alias("n"), F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer")
    known, fresh = F.col(f"o.{key}").isNotNull(), F.col(f"n.{key}").isNotNull()

    def pick(c: str) -> Column:
        o, n = F.col(f"o.{c}"), F.col(f"n.{c}")
        return F.when(known & (~fresh if c not in keep else F.lit(True)), o).otherwise(n)

    return both.select(*[F.coalesce(f"o.{c}", f"n.{c}").alias(c) if c == key else pick(c).alias(c) for c in old.columns])


def versions(registry: DataFrame, candidates: DataFrame) -> DataFrame:
    """(code, checksum, version, status, changed) after candidates (code, checksum, status): an equal checksum changes
    the status only, another one makes the next version, a code without one keeps its version."""
    both = registry.alias("o").join(candidates.alias("n"), "code", "full_outer")
    old, new = F.col("o.checksum"), F.col("n.checksum")
    changed = new.isNotNull() & ~old.eqNullSafe(new)
    version = F.when(changed & old.isNotNull(), F.col("o.version") + 1).otherwise(F.coalesce("o.version", F.lit(1)))
    return both.select("code", F.coalesce(new, old).alias("checksum"), version.alias("version"), F.coalesce("n.status", "o.status").alias("status"), F.coalesce(changed, F.lit(False)).alias("changed"))


def apply_verdicts(registry: DataFrame, verdicts: DataFrame) -> DataFrame:
    """The registry (code, status, replaced_by, verified_at) after verdicts (code, status, replacement_code,
    checked_at), and the candidate that each verdict names for indexing."""
    both = registry.alias("o").join(verdicts.alias("v"), "code", "full_outer")
    seen = F.col("v.status").isNotNull()
    over = F.col("v.status").isin("EXPIRED", "REPLACED")
    return both.select(
        "code",
        F.coalesce("v.status", "o.status").alias("status"),
        F.when(seen, F.col("v.replacement_code")).otherwise(F.col("o.replaced_by")).alias("replaced_by"),
        F.coalesce("v.checked_at", "o.verified_at").alias("verified_at"),
        F.when(over, F.col("v.replacement_code")).when(seen, F.col("code")).alias("candidate_code"),
    )


def fresh(registry: DataFrame, as_of: Column, hours: int = 24) -> DataFrame:
    """Rows that were verified within the last ``hours``."""
    return registry.filter(F.col("verified_at") >= as_of - F.make_dt_interval(hours=F.lit(hours)))


def without_blocked(sources: DataFrame, registry: DataFrame) -> DataFrame:
    """Sources (citation, title) whose label holds no code of a law that is out of force, as a substring in any case.
    Codes that are null or empty block nothing."""
    blocked = registry.filter(F.col("status").isin(*BLOCKED)).select(F.upper("code").alias("code"))
    label = F.upper(F.concat_ws(" ", "citation", "title"))
    bad = containing(sources.select(label.alias("bad")).distinct(), "bad", "bad", blocked, "code").select("bad").distinct()
    return sources.join(bad, label == F.col("bad"), "left_anti")


def fingerprint(sources: Column, items: Column) -> Column:
    """Digest of what an answer rests on: sorted distinct sources (doc_id, citation, source_url) and states (code,
    status, replacement_code, source_url); when it was checked plays no part."""
    text = lambda x, c: F.coalesce(x[c].cast("string"), F.lit(""))
    rows = lambda a, names: F.array_sort(F.array_distinct(F.transform(a, lambda x: F.array(*[text(x, n) for n in names]))))
    held = F.struct(rows(sources, ("doc_id", "citation", "source_url")).alias("sources"), rows(items, ("code", "status", "replacement_code", "source_url")).alias("verification"))
    return F.sha2(F.to_json(held), 256)


def cache_lookup(asked: DataFrame, cache: DataFrame, as_of: Column, model: str, prompt: str, least: float = 0.96) -> DataFrame:
    """(query_id, cache_id, similarity, kind) for questions (query_id, query_hash, vector): the entry with the same
    hash, else the nearest by cosine if it is near enough.  Only questions without an exact hit are compared."""
    from grafloom.operators.dense import similarities

    active = cache.filter((F.col("expires_at") > as_of) & (F.col("model_name") == model) & (F.col("prompt_version") == prompt))
    exact = asked.join(active.select("query_hash", F.col("id").alias("cache_id")), "query_hash").select("query_id", "cache_id")
    missed = asked.join(exact.select("query_id"), "query_id", "left_anti")
    near = similarities(active.select("id", "vector"), missed.select("query_id", "vector"), 1, "id", "vector", "query_id")
    near = near.filter(F.col("score") >= least).select("query_id", F.col("id").alias("cache_id"), F.col("score").alias("similarity"), F.lit("semantic").alias("kind"))
    hits = exact.select("query_id", "cache_id", F.lit(1.0).alias("similarity"), F.lit("exact").alias("kind")).unionByName(near)
    return asked.select("query_id").join(hits, "query_id", "left").withColumn("kind", F.coalesce("kind", F.lit("miss")))


def unique(df: DataFrame, *key: str) -> DataFrame:
    """Keys that are not unique."""
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def with_vectors(df: DataFrame, dim: int, column: str = "vector") -> DataFrame:
    """Vectors of the declared length; others are null, and so take no part in searches."""
    return df.withColumn(column, F.when(F.size(column) == dim, F.col(column)))


def assert_compatible(meta: dict, wanted: dict) -> None:
    """An index of another model, revision or dimension is not opened."""
    wrong = {k: (meta.get(k), v) for k, v in wanted.items() if str(meta.get(k)) != str(v)}
    if wrong:
        raise ValueError(f"the index does not fit: {wrong}")
