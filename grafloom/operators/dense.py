"""Exact vector search for batches of questions, as matrix products of blocks of questions and vectors.

While the questions are few (counted), they are sent to the vectors, which stay where they are and are scanned once.
More questions than that meet the vectors in cells: runs of vectors and blocks of questions of one length are rows, every
block is copied to every run, and a cell keeps the k best of each question; few runs are copied, so that all tasks have
work.  Either way the results, k a question
and run, meet in one window per question.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grafloom.operators.lexical import is_small, top
from grafloom.sources.shared import kept

#: Questions in a product, questions that are sent whole, vectors in a run.
BLOCK = 1024
SENT = 8192
RUN = 4096


def usable(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, v, dim) of the rows whose vector has no null and is not null itself."""
    v = F.col(vector).cast("array<double>")
    return df.filter(F.col(vector).isNotNull() & ~F.exists(F.col(vector), lambda x: x.isNull())).select(key, v.alias("v"), F.size(v).alias("dim"))


def matrix(column, dim: int):
    import numpy as np

    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), dim)


def by_length(names: pa.Array, vectors: pa.Array, dims: pa.Array) -> Iterator[tuple]:
    """(length, names, unit vectors) of the vectors of each length that are not zero."""
    import numpy as np

    dims = dims.to_numpy(zero_copy_only=False)
    for dim in np.unique(dims).tolist():
        on = pa.array(dims == dim)
        v = matrix(vectors.filter(on), dim)
        size = np.linalg.norm(v, axis=1)
        ok = size > 0
        if ok.any():
            yield dim, names.filter(on).filter(pa.array(ok)).to_numpy(zero_copy_only=False), v[ok] / size[ok, None]


def best(names, q, ids, v, k: int) -> tuple:
    """(questions, ids, similarities) of the k best of each question; equal ones (to nine places) by id."""
    import numpy as np

    sim = q @ v.T
    order = np.lexsort((np.broadcast_to(ids, sim.shape), -np.round(sim, 9)), axis=1)[:, :k]
    row = np.repeat(np.arange(len(names)), order.shape[1])
    return names[row], ids[order.ravel()], sim[row, order.ravel()]


def runs(df: DataFrame, key: str, rows: int) -> DataFrame:
    """(part, dim, names, v): runs of at most ``rows`` unit vectors of one length, and the task that made them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                cut = batch.slice(at, rows)
                for dim, names, v in by_length(cut.column(key), cut.column("v"), cut.column("dim")):
                    yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([dim], pa.int32()), pa.array([names.tolist()], pa.list_(cut.column(key).type)), pa.array([v.tobytes()], pa.binary())], names=["part", "dim", "names", "v"])

    return df.mapInArrow(run, f"part int, dim int, names array<{df.schema[key].dataType.simpleString()}>, v binary")


def similarities(vectors: DataFrame, asked: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding", query_col: str = "item_id") -> DataFrame:
    """(query, id, score, rank): the k most similar vectors of each question by cosine; vectors of another length than the
    question's, zero vectors, and those with nulls take no part."""
    q, v = usable(asked, query_col, vector_col), usable(vectors, id_col, vector_col)
    kinds = f"{query_col} {asked.schema[query_col].dataType.simpleString()}, {id_col} {vectors.schema[id_col].dataType.simpleString()}, score double"
    q_type = pa.int64() if asked.schema[query_col].dataType.simpleString() == "bigint" else None

    def rows(names, ids, sim) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(names, q_type), pa.array(ids), pa.array(sim)], names=[query_col, id_col, "score"])

    if is_small(q, SENT):
        held = q.toArrow().combine_chunks()
        column = lambda c: held.column(c).combine_chunks()
        sent = vectors.sparkSession.sparkContext.broadcast({dim: (n, u) for dim, n, u in by_length(column(query_col), column("v"), column("dim"))} if held.num_rows else {})

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for dim, ids, own in by_length(batch.column(id_col), batch.column("v"), batch.column("dim")):
                    names, u = sent.value.get(dim, ((), None))
                    for at in range(0, len(names), BLOCK):
                        yield rows(*best(names[at : at + BLOCK], u[at : at + BLOCK], ids, own, k))

        return top(v.mapInArrow(run, kinds), k, query_col, id_col)

    parts = max(1, -(-v.count() // RUN))
    shelves = kept(runs(v.repartition(parts), id_col, RUN)).withColumn("ask", F.lit(False))
    asks = kept(runs(q, query_col, BLOCK))
    # Where runs are fewer than tasks, a run's blocks are dealt to several, each of which has the run.
    tasks = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salts = max(1, min(asks.count(), -(-tasks // parts)))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    shelves = shelves.withColumn("salt", every(salts))
    blocks = asks.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(salts)).cast("int")).withColumn("part", every(parts)).withColumn("ask", F.lit(True))
    blocks = blocks.withColumnRenamed("names", "asked").withColumn("names", F.lit(None).cast(shelves.schema["names"].dataType))
    shelves = shelves.withColumn("asked", F.lit(None).cast(blocks.schema["asked"].dataType))
    cells = shelves.unionByName(blocks).repartition(max(tasks, min(parts * salts, 8 * tasks)), "part", "salt").sortWithinPartitions("part", "salt", "ask")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        part, held = None, []
        for batch in batches:
            for r in range(batch.num_rows):
                at, dim, ask = (batch.column("part")[r].as_py(), batch.column("salt")[r].as_py()), *(batch.column(c)[r].as_py() for c in ("dim", "ask"))
                names = np.array(batch.column("asked" if ask else "names")[r].as_py())
                own = np.frombuffer(batch.column("v")[r].as_py()).reshape(len(names), dim)
                if at != part:
                    part, held = at, []
                if not ask:
                    held.append((dim, names, own))
                    continue
                for d, ids, u in held:
                    if d == dim:
                        yield rows(*best(names, own, ids, u, k))

    return top(cells.mapInArrow(meet, kinds), k, query_col, id_col)
