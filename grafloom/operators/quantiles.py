"""Exact quantiles of groups without holding a group: counts of distinct values, dealt by ranges of (group, value).

Equal values are counted where they are read, so what is exchanged is one row for each distinct value and task.  Ranges are
sorted, and a value's place is its place in its range plus what the ranges before hold of its group.  A group of any size
lies in as many ranges as it needs; per range and group one total meets the others.

Cases: null values and NaN do not count; a group without any value has null quantiles; a null group is a group; an empty
table gives an empty result.  Between two places the quantile is between their values in proportion.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grafloom.sources.shared import kept


def quantiles(rows: DataFrame, group: str, value: str, shares: list[float]) -> DataFrame:
    """(group, n, least, most, quantiles): ``quantiles`` has one number for each of ``shares``."""
    number = F.when(~F.isnan(F.col(value).cast("double")), F.col(value).cast("double"))
    counts = rows.select(F.struct(F.col(group)).alias("g"), number.alias("v")).groupBy("g", "v").agg(F.count(F.lit(1)).alias("n"))
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = kept(kept(counts).repartitionByRange(tasks, "g", "v").withColumn("part", F.spark_partition_id()))
    valued = ranged.filter("v is not null")
    # Of each range and group the values before it: as many rows as there are ranges and groups.
    totals = valued.groupBy("g", "part").agg(F.sum("n").alias("here"))
    earlier = Window.partitionBy("g").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("g", "part", F.coalesce(F.sum("here").over(earlier), F.lit(0)).alias("offset"))
    sizes = totals.groupBy("g").agg(F.sum("here").alias("size"))
    within = Window.partitionBy("g", "part").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = valued.withColumn("upto", F.sum("n").over(within)).join(offsets, ["g", "part"]).join(sizes, "g")
    last, first = F.col("offset") + F.col("upto") - 1, F.col("offset") + F.col("upto") - F.col("n")

    def at(place: Column) -> Column:
        return F.max(F.when((first <= place) & (place <= last), F.col("v")))

    def quantile(share: float) -> tuple[Column, Column, Column]:
        place = (F.col("size") - 1) * F.lit(share)
        return at(F.floor(place)), at(F.ceil(place)), F.max(place - F.floor(place))

    parts = {f"{name}{k}": c for k, share in enumerate(shares) for name, c in zip(("low", "high", "rest"), quantile(share))}
    found = placed.groupBy("g").agg(F.max("size").alias("n"), F.min("v").alias("least"), F.max("v").alias("most"), *(c.alias(name) for name, c in parts.items()))
    between = [F.col(f"low{k}") + (F.col(f"high{k}") - F.col(f"low{k}")) * F.col(f"rest{k}") for k in range(len(shares))]
    every = ranged.select("g").distinct().join(found, "g", "left")
    return every.select(F.col("g").getField(group).alias(group), F.coalesce("n", F.lit(0)).alias("n"), "least", "most", F.array(*between).alias("quantiles"))
