"""What the operators of this subpackage share on the cluster side: the shared folder, written stages, batches.

Every stage that is read more than once is written as Parquet below ``spark.checkpoint.dir`` and read again, which
cuts lineage and survives the loss of any executor.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that one vectorised step works on; a single longer text is a step of its own.
STEP_BYTES = 1 << 19


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see.  Without ``spark.checkpoint.dir``, one below the warehouse is set, but only where
    executors share the driver's machine (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", "")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors see")
        found = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back.  All stages of an application lie below a folder of its id,
    which can go when it has ended."""
    path = f"{shared_dir(df.sparkSession)}/grafloom/{df.sparkSession.sparkContext.applicationId}/{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Bits of the sketch by which rows are told that need no join; at most BITS / 64 small rows are sent.
BITS = 1 << 24


def parted(rows: DataFrame, key: str, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``rows`` that may have their key in ``ids`` (one column), and those that surely have not.

    The ids' hashes are marked in a bitmap of fixed size, which is small enough to broadcast whatever the input; it only
    errs by sending rows to the first part, so what is not in it needs no exchange for a join with ``ids``.
    """
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(BITS))
    name = ids.columns[0]
    marks = ids.select(place(F.col(name)).alias("_p")).groupBy(F.shiftright("_p", 6).cast("int").alias("_w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(_p & 63 as int))")).alias("_b"))
    marks = materialize(marks, "marks")
    spread = rows.withColumn("_p", place(F.col(key).cast(ids.schema[name].dataType)))
    found = spread.join(F.broadcast(marks), F.shiftright("_p", 6).cast("int") == F.col("_w"), "left")
    marked = F.coalesce(F.expr("shiftright(_b, cast(_p & 63 as int)) & 1 = 1"), F.lit(False))
    return found.filter(marked).select(*rows.columns), found.filter(~marked).select(*rows.columns)


#: Rows of a key that one task takes at least; a key with more is dealt to several.
SHARE = 512


def spread_join(rows: DataFrame, side: DataFrame, keys: list[str], by: str) -> DataFrame:
    """``rows`` joined with ``side``, a written table with one row a key and the number ``n`` of its rows.

    The rows of a key that has far more than its share are dealt to several tasks by ``by``, and its row in ``side`` is
    copied to these.  There are no more such keys than sixteen a task, so their list is small.
    """
    tasks = task_count(rows.sparkSession)
    total = side.agg(F.sum("n")).first()[0] or 0
    share = max(SHARE, -(-total // (16 * tasks)))
    hot = F.broadcast(side.filter(F.col("n") > share).select(*keys, F.ceil(F.col("n") / share).cast("int").alias("_parts")))  # 16 a task at most
    dealt = rows.join(hot, keys, "left").withColumn("_part", F.coalesce(F.pmod(F.xxhash64(by), F.col("_parts")), F.lit(0)).cast("int")).drop("_parts")
    copies = side.drop("n").join(hot, keys, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts")
    return dealt.join(copies, [*keys, "_part"]).drop("_part")


def task_count(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def steps(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in runs whose texts hold at most ``limit`` bytes (one row at least)."""
    import numpy as np

    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        ends = np.cumsum(lengths(batch.column(column)))
        start = 0
        while start < n:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def lengths(array: pa.Array):
    """UTF-8 bytes of each text, a null counting as empty."""
    import numpy as np
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(array), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def flat(array: pa.Array):
    """(bytes, offsets) of a text column as NumPy arrays, nulls as empty texts."""
    import numpy as np
    import pyarrow.compute as pc

    array = pc.fill_null(array, b"" if pa.types.is_binary(array.type) or pa.types.is_large_binary(array.type) else "")
    wide = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
    if not len(array):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = array.buffers()
    offs = np.frombuffer(offs, np.int64 if wide else np.int32)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offs - offs[0]


def ints(array: pa.Array, null: int = 0):
    import numpy as np
    import pyarrow.compute as pc

    return pc.fill_null(array, null).to_numpy(zero_copy_only=False).astype(np.int64)


_MODEL: dict = {}


def worker_model(key, make):
    """``make()``, kept by this Python worker until another operator's task runs in it; one is held at a time."""
    if key not in _MODEL:
        release_model()
        _MODEL[key] = make()
    return _MODEL[key]


def release_model() -> None:
    """Gives back what an operator that ran in this worker before has held."""
    if _MODEL:
        import ctypes
        import gc

        _MODEL.clear()
        gc.collect()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except AttributeError:  # a C library without it keeps the memory for itself
            pass
