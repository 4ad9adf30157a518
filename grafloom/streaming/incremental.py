"""Change-driven indexing: candidates come as a stream, each batch adds what it changes to a log of the registry or to an
index that follows its documents."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grafloom.operators.live_index import PARTS, LiveIndex
from grafloom.operators.merge import versions

SCHEMA = "code string, checksum string, version int, status string, seq long, changed boolean"


def registry(spark: SparkSession, path: str, but: str | None = None) -> DataFrame:
    """(code, checksum, version, status, seq, changed): the last entry of each code in the log, less one batch's if asked."""
    try:
        log = spark.read.schema(SCHEMA + ", run string, batch long").parquet(path)
    except Exception:  # nothing is written yet
        return spark.createDataFrame([], SCHEMA)
    if but is not None:
        log = log.filter(F.concat_ws("/", "run", F.col("batch").cast("string")) != but)
    return log.groupBy("code").agg(F.max_by(F.struct("checksum", "version", "status", "seq", "changed"), "seq").alias("x")).select("code", "x.*")


def registry_writer(spark: SparkSession, path: str, checkpoint: str):
    """A ``foreachBatch`` function that adds to the log in ``path`` the entries of each batch's codes.

    Only the batch's codes are looked up and written.  A batch that runs again replaces its own entries, and a stream
    with another checkpoint, whose batches count from 0 anew, adds to what earlier ones have written.
    """
    run = hashlib.sha256(checkpoint.encode()).hexdigest()[:16]

    def write(batch: DataFrame, number: int) -> None:
        old = registry(spark, path, f"{run}/{number}")
        known = old.join(batch.select("code").distinct(), "code", "left_semi").select("code", "checksum", "version", "status")
        merged = versions(known, batch.select("code", "checksum", "status"))
        seq = (old.agg(F.max("seq")).first()[0] or 0) + 1
        rows = merged.select("code", "checksum", F.col("version").cast("int").alias("version"), "status", F.lit(seq).cast("long").alias("seq"), "changed")
        rows.write.mode("overwrite").parquet(f"{path}/run={run}/batch={number}")

    return write


def index_writer(spark: SparkSession, path: str, checkpoint: str, parts: int = PARTS):
    """A ``foreachBatch`` function that takes a stream of versions (doc_id, seq, text, removed) into the live index in
    ``path``.  A batch that runs again after a crash has either been published whole, and is then passed over, or not at
    all."""
    run = hashlib.sha256(checkpoint.encode()).hexdigest()[:16]

    def write(batch: DataFrame, number: int) -> None:
        LiveIndex(spark, path, parts).apply(batch, (run, number))

    return write
