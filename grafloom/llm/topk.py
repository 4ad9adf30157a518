"""Operator 9: exact top-k inner products by no-random-access aggregation.

Vectors are turned into integers and dealt into shards; each shard keeps one list per component, sorted by value.  A
query reads the lists from the end that is good for its sign, all lists to the same depth, which doubles in each round.
What is read adds to the candidates' partial scores; the lists are not read elsewhere, and no candidate is looked up.
Each candidate has a lower and an upper bound: components not yet read count as the list's far end or as the last value
read.  The k-th best lower bound is the threshold; candidates whose upper bound is below it, also those not read at all,
cannot qualify.  When few are left, their final scores are resolved; if the lists are read to their ends before that,
the partial scores are the final ones.

Queries come in blocks, and every block goes to every shard: a (shard, block) cell is worked on by itself, its bounds
as matrix products over what was read in the round.  Cells are dealt by shard and, where a shard has many blocks, by a
part of these.  The cells' results, k a query, meet per query.  Nothing passes the driver or a broadcast.

Cases: vectors that are null or hold a null, NaN or infinity, and rows with a null id take no part; vectors of other
lengths than the query's are no candidates of it; other rows with the query's own id are not its candidates either;
ties go to the smaller id; repeated query rows are answered each; other columns are not read; an empty table gives an
empty result.  Components so large that a score or a bound might not fit 64 bits (4 * length * largest square of 256 x
at 2**62 or more) are an error, which is raised before any search.  Ids are read as long.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grafloom.llm.shared import materialize, release_model, task_count

#: Vectors in a shard, queries in a block, blocks of a shard that are dealt to one task together.
SHARD = 8192
BLOCK = 128
TOGETHER = 32
#: Shares of each list that are read by the end of each round.
ROUNDS = (0.125, 0.25, 0.5, 1.0)
#: Share of a cell's candidates that may be left for final scores.
FEW = 0.04


def quantised(batch):
    """Integer components, one row a vector."""
    import numpy as np

    n = batch.num_rows
    flat = batch.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1)
    return np.floor(256.0 * flat)


def narrow(values):
    import numpy as np

    top = np.abs(values).max(initial=0)
    return values.astype(np.int16 if top < 1 << 15 else np.int64)


def blocks(vectors: DataFrame, rows: int) -> DataFrame:
    """(part, dim, n, ids blob, kind, values blob): runs of at most ``rows`` vectors of one length, and their task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        from pyspark import TaskContext

        release_model()
        part, held = TaskContext.get().partitionId(), {}

        def out(dim):
            ids, values = (np.concatenate(x) for x in zip(*held.pop(dim)))
            values = narrow(values)
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([dim], pa.int32()), pa.array([len(ids)], pa.int32()), pa.array([ids.tobytes()], pa.binary()), pa.array([values.dtype.str]), pa.array([values.tobytes()], pa.binary())], names=["part", "dim", "n", "ids", "kind", "v"])

        for batch in batches:
            dims = batch.column("dim").to_numpy(zero_copy_only=False)
            for dim in np.unique(dims).tolist():
                own = batch.filter(pa.array(dims == dim))
                for at in range(0, own.num_rows, rows):
                    cut = own.slice(at, rows)
                    have = sum(len(x[0]) for x in held.get(dim, []))
                    if have and have + cut.num_rows > rows:
                        yield out(dim)
                    held.setdefault(dim, []).append((cut.column("id").to_numpy(zero_copy_only=False).astype(np.int64), quantised(cut)))
        for dim in list(held):
            yield out(dim)

    return vectors.mapInArrow(run, "part int, dim int, n int, ids binary, kind string, v binary")


def exact_kind(largest: float, dim: int):
    """The fastest number type in which scores and bounds of components up to ``largest`` are exact."""
    import numpy as np

    limit = 4.0 * max(1, dim) * max(1.0, largest) ** 2
    return np.float32 if limit < 1 << 24 else np.float64 if limit < 2.0**53 else np.int64


class Lists:
    """A shard's sorted lists: for each component its vectors' numbers and its values, the largest value first."""

    def __init__(self, ids, values):
        import numpy as np

        self.ids, self.values, n = ids, values, len(values)
        self.numbers = np.argsort(-values, axis=0, kind="stable")
        self.sorted = np.take_along_axis(values, self.numbers, axis=0)
        self.depths = [n if share == 1 else max(1, round(n * share)) for share in ROUNDS]

    def read(self, a: int, b: int, kind):
        """What places a to b of every list hold: (vector, component) values, 0 where none, and where they are."""
        import numpy as np

        values, there = np.zeros(self.values.shape, kind), np.zeros(self.values.shape, kind)
        np.put_along_axis(values, self.numbers[a:b], self.sorted[a:b].astype(kind), axis=0)
        np.put_along_axis(there, self.numbers[a:b], 1, axis=0)
        return values, there


def search(queries, query_ids, lists: Lists, k: int):
    """(query, candidate, score) of the k best candidates of each query in one cell."""
    import numpy as np

    n, dim = lists.values.shape
    kind = exact_kind(max(float(np.abs(x).max(initial=0)) for x in (lists.values, queries)), dim)
    nothing = -np.inf if kind is not np.int64 else -(1 << 62)
    q = queries.astype(kind)
    up, down = np.maximum(q, 0), np.minimum(q, 0)
    own = query_ids[:, None] == lists.ids[None, :]
    best, worst = lists.sorted[0].astype(kind), lists.sorted[-1].astype(kind)
    seen = np.zeros((len(q), n), kind)  # partial scores
    far = np.zeros((len(q), n), kind)  # what the components read would count as, at the far end of their lists
    read_top, read_low, before = np.zeros((n, dim), kind), np.zeros((n, dim), kind), 0
    for depth in lists.depths:
        if depth > before:
            for share, read, end, (values, there) in ((up, read_top, worst, lists.read(before, depth, kind)), (down, read_low, best, lists.read(n - depth, n - before, kind))):
                seen += share @ values.T
                far += (share * end) @ there.T
                read += there
        before = depth
        lower = seen - far + (up @ worst + down @ best)[:, None]
        if depth < n:
            top, low = lists.sorted[depth - 1].astype(kind), lists.sorted[n - depth].astype(kind)
            upper = seen - (up * top) @ read_top.T - (down * low) @ read_low.T + (up @ top + down @ low)[:, None]
        else:
            upper = lower = seen
        lower = np.where(own, nothing, lower)
        tau = np.partition(lower, n - k, axis=1)[:, n - k] if n > k else np.full(len(q), nothing, kind)
        alive = (upper >= tau[:, None]) & ~own
        if alive.sum() <= FEW * alive.size:
            break
    row, col = np.nonzero(alive)
    if before == n:
        score = seen[row, col].astype(np.int64)
    else:
        score = np.empty(len(row), np.int64)
        for a in range(0, len(row), 1 << 16):
            s = slice(a, a + (1 << 16))
            score[s] = (queries[row[s]].astype(np.int64) * lists.values[col[s]].astype(np.int64)).sum(axis=1)
    order = np.lexsort((lists.ids[col], -score, row))
    row, col, score = row[order], col[order], score[order]
    keep = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[keep], col[keep], score[keep]


def top_products(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) of the k best of each row for which ``is_query`` holds."""
    tasks = task_count(vectors.sparkSession)
    v = vectors[vector_col].cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.filter(vectors[id_col].isNotNull() & v.isNotNull() & finite).select(vectors[id_col].cast("long").alias("id"), v.alias("v"), F.size(v).alias("dim"), F.coalesce(is_query, F.lit(False)).alias("q"))
    # The largest magnitude before rounding down, which adds 1 at most.
    size = F.aggregate(F.col("v"), F.lit(0.0), lambda most, x: F.greatest(most, F.abs(x * 256)))
    n, asked, largest, longest = rows.agg(F.count(F.lit(1)), F.count_if("q"), F.max(size), F.max("dim")).first()
    if n and 4.0 * max(1, longest) * (largest + 1) * (largest + 1) >= 2.0**62:
        raise ValueError(f"components of up to {largest / 256:g} in vectors of {longest} may exceed 64-bit scores")
    parts = max(1, -(-n // SHARD))
    shards = materialize(blocks(rows.repartition(parts), SHARD), "shards")
    asks = materialize(blocks(rows.filter("q").repartition(max(1, -(-asked // BLOCK))), BLOCK), "asks")
    # Every shard meets every block, in as many tasks as have work, and TOGETHER blocks at most in one.
    salts = max(-(-asked // (BLOCK * TOGETHER)), min(-(-asked // BLOCK), -(-tasks // parts)), 1)
    numbered = asks.select("part", F.monotonically_increasing_id().alias("b"), "dim", "n", "ids", "kind", "v")
    salted = lambda c: F.explode(F.sequence(F.lit(0), F.lit(c - 1)))
    to_shards = numbered.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(salts)).cast("int")).withColumn("part", salted(parts)).withColumn("ask", F.lit(True))
    columns = ["part", "salt", "ask", "b", "dim", "n", "ids", "kind", "v"]
    copies = shards.withColumn("salt", salted(salts)).withColumn("ask", F.lit(False)).withColumn("b", F.lit(-1).cast("long"))
    cells = copies.select(columns).unionByName(to_shards.select(columns)).repartition(max(tasks, min(parts * salts, 8 * tasks)), "part", "salt").sortWithinPartitions("part", "salt", "ask")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        release_model()
        cell, held = None, []
        for batch in batches:
            for r in range(batch.num_rows):
                part, salt, ask, b, dim, n, ids, kind, values = (batch.column(c)[r].as_py() for c in columns)
                if (part, salt) != cell:
                    cell, held = (part, salt), []
                ids, values = np.frombuffer(ids, np.int64), np.frombuffer(values, kind).reshape(n, dim)
                if not ask:
                    held.append(Lists(ids, values))
                    continue
                for lists in held:
                    if lists.values.shape[1] == dim:
                        row, col, score = search(values, ids, lists, k)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(row), b)), pa.array(row), pa.array(ids[row]), pa.array(lists.ids[col]), pa.array(score)], names=["b", "r", "query_id", "vec_id", "score"])

    found = cells.mapInArrow(run, "b long, r long, query_id long, vec_id long, score long")
    best = Window.partitionBy("b", "r").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
