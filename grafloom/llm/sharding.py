"""Operator 7: contiguous, balanced shards from global byte-size prefix sums.

Documents are ordered by id.  They are dealt by range into partitions, each partition's total of bytes and rows gives
the offsets of all partitions (one small row each), and a running sum within the partition gives every document its
global byte position and row number.  The bytes are cut at equal targets: a document goes to the shard in which the
middle of its bytes lies.  The texts themselves are not shuffled, only (id, size, checksum).

Shards are contiguous in the order of ids, so equal texts of different ids may lie in different shards.

Cases: a null or empty text has only the overhead as size and checksum 0 (without overhead, a table of such texts is one
shard); null ids sort first; ties and repeated rows
are ordered by checksum and size and are otherwise alike; an empty table gives an empty result; other columns are not
read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from grafloom.llm.shared import materialize, task_count

OVERHEAD = 16


def shard_by_bytes(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text", overhead: int = OVERHEAD) -> DataFrame:
    """(id, size, text_crc32, law, shard, slot, grown_shard) of each row; slots count from 0 within each shard."""
    spark = docs.sparkSession
    rows = docs.select(
        docs[id_col].alias("i"),
        (F.coalesce(F.octet_length(docs[text_col]), F.lit(0)) + F.lit(overhead)).cast("long").alias("size"),
        F.crc32(F.coalesce(docs[text_col], F.lit("")).cast("binary")).alias("crc"),
    )
    # Rows that are alike in all that counts may fall on several ranges, in any order.
    rows = rows.withColumn("tie", F.monotonically_increasing_id())
    dealt = materialize(rows.repartitionByRange(task_count(spark), "i", "crc", "size", "tie").drop("tie").withColumn("part", F.spark_partition_id()), "ranged")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # One row a partition: as many rows as shuffle partitions, whatever the input.
    totals = dealt.groupBy("part").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))
    totals = totals.select(
        "part",
        F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows_before"),
        F.sum("bytes").over(Window.partitionBy()).alias("all_bytes"),
    )
    inside = Window.partitionBy("part").orderBy(F.col("i").asc_nulls_first(), "crc", "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = dealt.join(F.broadcast(totals), "part").select(
        "i",
        "size",
        "crc",
        (F.sum("size").over(inside) + F.col("bytes_before") - F.col("size")).alias("start"),
        (F.count(F.lit(1)).over(inside) + F.col("rows_before") - 1).alias("row"),
        "all_bytes",
    )
    placed = materialize(placed.select("i", "size", "crc", "row", F.least(F.lit(shards - 1), F.expr(f"(start * 2 + size) * {shards} div greatest(2 * all_bytes, 1)")).cast("int").alias("shard")), "placed")
    firsts = placed.groupBy("shard").agg(F.min("row").alias("first"))
    return placed.join(F.broadcast(firsts), "shard").select(
        F.col("i").alias(id_col),
        "size",
        F.col("crc").alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("row") - F.col("first")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
