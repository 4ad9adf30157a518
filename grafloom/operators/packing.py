"""Packing of ranked blocks into a length budget."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def within_budget(blocks: DataFrame, key: str, order: str, block: str, budget: int) -> DataFrame:
    """``blocks`` with ``size``, their running length: those before the first that overflows.  Lengths are not
    negative, so that equals the blocks whose running length fits."""
    running = F.sum(F.length(block)).over(Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return blocks.withColumn("size", running).filter(F.col("size") <= budget)
