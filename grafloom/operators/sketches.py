"""Summaries that are stored by day and group and merge: how many different keys, and how values are spread.

A day's rows are read once; a report over any days merges their sketches and reads no rows.  A sketch has a bounded size
(4 KB of registers at ``LG_K`` 12, some KB of quantiles), so merging carries days times groups of these.

Cases: null keys and null or NaN values do not count; a group of nulls only has 0 keys and null quantiles; a null day or
group is one of its own; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Registers as a power of two (a relative error near 0.8 / sqrt(2^12) = 1.3 %), and the size that sets the rank error of quantiles (near 0.8 %).
LG_K, KLL = 12, 400


def by_day(rows: DataFrame, ts: str, group: str, key: str, value: str) -> DataFrame:
    """(day, group, n, keys, spread) of rows."""
    number = F.when(~F.isnan(F.col(value).cast("double")), F.col(value).cast("double"))
    sketched = rows.select(F.to_date(ts).alias("day"), group, F.col(key).alias("_k"), number.alias("_v"))
    return sketched.groupBy("day", group).agg(F.count(F.lit(1)).alias("n"), F.hll_sketch_agg("_k", LG_K).alias("keys"), F.kll_sketch_agg_double("_v", KLL).alias("spread"))


def merged(stored: DataFrame, group: str, shares: list[float]) -> DataFrame:
    """(group, n, keys, quantiles) from the sketches of several days; ``keys`` is an estimate."""
    sums = stored.groupBy(group).agg(F.sum("n").alias("n"), F.hll_union_agg("keys").alias("k"), F.kll_merge_agg_double("spread").alias("s"))
    found = F.array(*[at(F.col("s"), share) for share in shares])
    return sums.select(group, "n", F.hll_sketch_estimate("k").alias("keys"), F.when(F.kll_sketch_get_n_double("s") > 0, found).alias("quantiles"))


def at(sketch: Column, share: float) -> Column:
    """The value at a rank; null where the sketch is empty, which is an error of the function otherwise."""
    return F.when(F.kll_sketch_get_n_double(sketch) > 0, F.kll_sketch_get_quantile_double(sketch, F.lit(share)))
