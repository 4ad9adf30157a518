"""Re-verification of a registry, oldest first, in waves.

A wave takes the laws that were verified longest ago (those never verified before all), asks for their verdicts and puts
these into the registry, of which only the touched buckets are written.  A job that breaks is started again and goes on
with what is still due; laws whose verdict failed stay as they were, are counted, and are asked again by the next job
only.  A wave is a bounded number of rows; how many waves there are follows the registry.

Cases: a law without a code is not verified; of several verdicts for a law the latest holds; verdicts for other laws are
added to the registry, as a replaced law's successor may not be known; an empty registry gives zeros.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from grafloom.operators.merge import apply_verdicts
from grafloom.sources.shared import kept
from grafloom.sources.store import Store, Table, hashed

SCHEMA = "code string, status string, replaced_by string, verified_at timestamp"
WAVE = 10_000


def registry_store(spark: SparkSession, path: str, parts: int = 64) -> Store:
    return Store(spark, path, {"laws": Table(SCHEMA, hashed("code", parts))})


@dataclass
class Report:
    checked: int = 0
    updated: int = 0
    failed: int = 0


def waves(laws: DataFrame, before: Column, size: int):
    """Blocks of at most ``size`` laws that were last verified before a time, oldest first."""
    due = laws.filter(F.col("code").isNotNull() & (F.col("verified_at").isNull() | (F.col("verified_at") < before)))
    order = F.struct(F.col("verified_at").isNotNull().alias("a"), F.coalesce(F.col("verified_at"), F.lit(0).cast("timestamp")).alias("b"), F.col("code").alias("c"))
    last = None
    while True:
        rest = due if last is None else due.filter(order > F.struct(F.lit(last.a).alias("a"), F.lit(last.b).cast("timestamp").alias("b"), F.lit(last.c).alias("c")))
        block = kept(rest.withColumn("place", order).orderBy("place").limit(size))
        end = block.agg(F.max("place").alias("place")).first().place
        if end is None:
            return
        last = end
        yield block.drop("place")


def reverify(store: Store, verify: Callable[[DataFrame], DataFrame], before: Column, size: int = WAVE) -> Report:
    """Verifies all laws of ``store`` that are due; ``verify`` takes laws and gives (code, status, replacement_code,
    checked_at), with a null status where it failed."""
    report = Report()
    for block in waves(store.read("laws"), before, size):
        verdicts = kept(verify(block).select("code", "status", "replacement_code", "checked_at"))
        found = verdicts.filter("status is not null").groupBy("code").agg(F.max(F.struct("checked_at", "status", "replacement_code")).alias("v")).select("code", "v.*")
        asked = block.join(found.select("code", F.col("status").alias("new"), F.col("replacement_code").alias("over")), "code", "left")
        differs = ~F.col("new").eqNullSafe(F.col("status")) | ~F.col("over").eqNullSafe(F.col("replaced_by"))
        counts = asked.agg(F.count("new").alias("checked"), F.count_if(F.col("new").isNotNull() & differs).alias("updated"), F.count_if(F.col("new").isNull()).alias("failed")).first()
        known = store.read("laws", store.touched("laws", found)).join(found.select("code"), "code", "left_semi")
        now = apply_verdicts(known, found).select("code", "status", "replaced_by", "verified_at")
        store.upsert("laws", kept(now), "code")
        report.checked += counts.checked
        report.updated += counts.updated
        report.failed += counts.failed
    return report
