"""Results that a plan needs more than once, written to the folder that all executors see and read again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, kind: str) -> str:
    """A new folder below ``spark.checkpoint.dir`` and the application's id.  Where that is unset, one below the warehouse
    is taken, but only if executors share the driver's machine."""
    found = spark.conf.get("spark.checkpoint.dir", "")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors see")
        found = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
    return f"{found.rstrip('/')}/{kind}/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def kept(df: DataFrame) -> DataFrame:
    """``df`` computed once: cuts its lineage and survives lost executors."""
    path = shared_folder(df.sparkSession, "kept")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt to all cores if its input has fewer splits than these can take; a large input stays where it is."""
    many = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(many) if df.rdd.getNumPartitions() < 2 * many else df


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` by keys in as many partitions as are set; where rows are few but dear, Spark would put them together."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
