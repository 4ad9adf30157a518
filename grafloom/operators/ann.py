"""Approximate vector search by an inverted file: lists round centres, residual product codes, exact scores at the end.

The centres and codes are fitted on a bounded sample (``SAMPLE`` vectors, those with the least digests of their ids), in
one task; every vector is then put into the list of its nearest centre, whatever the sample was.  Lists are cut into
blocks of at most ``BLOCK`` vectors, which lie in folders by groups of lists and sorted by list within, so a batch of
questions opens the folders of the lists that it probes.  A block row holds ids, codes (one byte for each part of a
vector's rest after its centre) and the vectors.

A question probes the lists of its nearest centres, as many as the sample says hold ``TARGET`` of its nearest vectors.  In a block its products with all codes are sums from a small table;
the best ``REFINE`` times k by these are scored exactly.  While questions are few (counted), they are sent to the blocks;
many meet the blocks by list, where a list with many blocks is dealt to several tasks.

Cases: vectors that are null, hold a null or are zero, and those of another length than the index, take no part, as
questions neither; equal scores (to nine places) go by id; rows that share an id are found each; an empty table gives an
index without lists, which finds nothing.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grafloom.operators.dense import by_length, usable
from grafloom.operators.lexical import is_small, top
from grafloom.sources.shared import kept, shared_folder

SAMPLE, LISTS, ROUNDS = 20_000, 4096, 10
BLOCK, SENT, TOGETHER, REFINE = 4096, 8192, 512, 4
#: Share of a question's nearest vectors that the probed lists should hold.
TARGET = 0.97
#: Components of a part that has one code; folders that lists are dealt to.
PART, FOLDERS = 4, 64


def nearest(points, centres, many: int = 1):
    """The numbers of the nearest centres of each point, the nearest first, equal ones by number."""
    import numpy as np

    near = np.round(points @ centres.T - (centres**2).sum(axis=1) / 2, 12)
    return np.argsort(-near, axis=1, kind="stable")[:, :many]


def means(points, n: int, rounds: int):
    """At most ``n`` centres: the first points, moved to the means of what is nearest to them ``rounds`` times."""
    import numpy as np

    centres = points[:n].copy()
    for _ in range(rounds):
        at = nearest(points, centres)[:, 0]
        many = np.bincount(at, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, at, points)
        on = many > 0
        centres[on] = sums[on] / many[on, None]
    return centres


class Model:
    def __init__(self, points, lists: int, rounds: int, coded: bool):
        import numpy as np

        self.dim = points.shape[1]
        self.centres = means(points, lists, rounds)
        self.parts = np.array_split(np.arange(self.dim), max(1, self.dim // PART)) if coded and len(points) else []
        rest = points - self.centres[nearest(points, self.centres)[:, 0]] if len(points) else points
        self.books = [means(rest[:, p], 256, rounds) for p in self.parts]
        self.probes = self.enough(points)

    def enough(self, points, share: float = TARGET, k: int = 10) -> int:
        """How many lists a question must probe to meet ``share`` of its k nearest vectors, by sampled ones as questions
        among the sample."""
        import numpy as np

        asked = points[:512]
        if len(points) < 2:
            return len(self.centres)
        near = np.argpartition(-(asked @ points.T), min(k, len(points) - 1), axis=1)[:, : k + 1]
        place = np.argsort(nearest(asked, self.centres, len(self.centres)), axis=1)  # of each list, for each question
        at = nearest(points, self.centres)[:, 0]
        seen = np.sort(np.take_along_axis(place, at[near], axis=1).ravel())
        return int(seen[min(len(seen) - 1, math.ceil(share * len(seen)))]) + 1

    def encode(self, points, at):
        import numpy as np

        rest = points - self.centres[at]
        return np.stack([nearest(rest[:, p], book)[:, 0] for p, book in zip(self.parts, self.books)], axis=1).astype(np.uint8) if self.parts else np.zeros((len(points), 0), np.uint8)

    def guessed(self, asked, at: int, codes):
        """The products of questions with the coded vectors of a list."""
        import numpy as np

        out = np.repeat((asked @ self.centres[at])[:, None], len(codes), axis=1)
        for k, (p, book) in enumerate(zip(self.parts, self.books)):
            out += (asked[:, p] @ book.T)[:, codes[:, k]]
        return out

    def best(self, names, asked, at: int, ids, codes, vectors, k: int):
        """(names, ids, scores) of the k best of each question in a block; exact scores of the best by their codes."""
        import numpy as np

        if self.parts and len(ids) > REFINE * k:
            some = np.argpartition(-self.guessed(asked, at, codes), REFINE * k - 1, axis=1)[:, : REFINE * k]
        else:
            some = np.broadcast_to(np.arange(len(ids)), (len(names), len(ids)))
        score = np.einsum("qd,qnd->qn", asked, vectors[some])
        order = np.lexsort((ids[some], -np.round(score, 9)), axis=1)[:, :k]
        row = np.repeat(np.arange(len(names)), order.shape[1])
        return names[row], np.take_along_axis(ids[some], order, 1).ravel(), np.take_along_axis(score, order, 1).ravel()


def fit(rows: DataFrame, id_col: str, lists: int | None, sample: int, rounds: int, coded: bool) -> Model | None:
    """The model of usable rows (id, v, dim); the length is the one that the most sampled rows have."""
    n = rows.count()
    if not n:
        return None
    lists = lists or max(1, min(LISTS, round(math.sqrt(n))))
    chosen = rows.withColumn("m", F.md5(F.col(id_col).cast("string"))).orderBy("m", id_col).limit(sample).coalesce(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        held: dict[int, list] = {}
        for batch in batches:
            batch = batch.take(pa.array(np.argsort(batch.column("m").to_numpy(zero_copy_only=False), kind="stable")))
            for dim, _, v in by_length(batch.column(id_col), batch.column("v"), batch.column("dim")):
                held.setdefault(dim, []).append(v)
        if held:
            points = np.concatenate(max(held.values(), key=lambda x: sum(map(len, x))))
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(Model(points, lists, rounds, coded))], pa.binary())], names=["m"])

    found = chosen.mapInArrow(run, "m binary").first()
    return pickle.loads(found.m) if found else None


def listed(rows: DataFrame, id_col: str, model: Model) -> DataFrame:
    """(folder, list, n, ids, codes, v): all rows in blocks of one list."""
    spark = rows.sparkSession
    kind = rows.schema[id_col].dataType.simpleString()
    sent = spark.sparkContext.broadcast(model)  # LISTS centres and 256 codes a part at most

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        model = sent.value
        for batch in batches:
            for dim, ids, v in by_length(batch.column(id_col), batch.column("v"), batch.column("dim")):
                if dim == model.dim:
                    at = nearest(v, model.centres)[:, 0]
                    codes = model.encode(v, at)
                    raw = [x.tobytes() for x in v]
                    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(ids), pa.array([x.tobytes() for x in codes], pa.binary()), pa.array(raw, pa.binary())], names=["list", "id", "code", "v"])

    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    single = kept(rows.mapInArrow(put, f"list int, id {kind}, code binary, v binary")).withColumn("folder", F.pmod("list", F.lit(FOLDERS)))
    sorted_ = single.repartitionByRange(tasks, "folder", "list", "id").sortWithinPartitions("folder", "list", "id")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            at = batch.column("list").to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(at[1:] != at[:-1]) + 1).tolist(), len(at)] if len(at) else []
            for a, b in zip(cuts, cuts[1:]):
                for x in range(a, b, BLOCK):
                    part = batch.slice(x, min(BLOCK, b - x))
                    joined = lambda c: pa.array([b"".join(part.column(c).to_pylist())], pa.binary())  # noqa: E731, B023
                    ids = pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column("id"))
                    yield pa.RecordBatch.from_arrays([part.column("folder").slice(0, 1), part.column("list").slice(0, 1), pa.array([part.num_rows], pa.int32()), ids, joined("code"), joined("v")], names=["folder", "list", "n", "ids", "codes", "v"])

    return sorted_.mapInArrow(pack, f"folder int, list int, n int, ids array<{kind}>, codes binary, v binary")


@dataclass
class VectorIndex:
    model: Model | None
    blocks: DataFrame | None
    id_col: str
    id_type: str

    @classmethod
    def build(cls, vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", lists: int | None = None, sample: int = SAMPLE, rounds: int = ROUNDS, coded: bool = True, path: str | None = None) -> VectorIndex:
        """An index of all usable rows, written to ``path`` or the shared folder."""
        spark = vectors.sparkSession
        path = path or shared_folder(spark, "vectors")
        rows = usable(vectors, id_col, vector_col)
        model = fit(rows, id_col, lists, sample, rounds, coded)
        if model:
            listed(rows, id_col, model).write.mode("overwrite").partitionBy("folder").parquet(f"{path}/blocks")
        kind = vectors.schema[id_col].dataType.simpleString()
        spark.createDataFrame([(pickle.dumps(model), id_col, kind)], "model binary, id_col string, id_type string").coalesce(1).write.mode("overwrite").parquet(f"{path}/model")
        return cls.open(spark, path)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> VectorIndex:
        row = spark.read.parquet(f"{path}/model").first()
        model = pickle.loads(row.model)
        return cls(model, spark.read.parquet(f"{path}/blocks") if model else None, row.id_col, row.id_type)

    def probed(self, asked: DataFrame, query_col: str, probes: int) -> DataFrame:
        """(query, list, u): the lists that each question probes, with its unit vector."""
        sent = asked.sparkSession.sparkContext.broadcast(self.model)
        kind = asked.schema[query_col].dataType.simpleString()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            import numpy as np

            for batch in batches:
                for dim, names, u in by_length(batch.column(query_col), batch.column("v"), batch.column("dim")):
                    if dim == sent.value.dim:
                        at = nearest(u, sent.value.centres, probes)
                        row = np.repeat(np.arange(len(names)), at.shape[1])
                        raw = [x.tobytes() for x in u]
                        yield pa.RecordBatch.from_arrays([pa.array(names[row]), pa.array(at.ravel().astype(np.int32)), pa.array([raw[r] for r in row.tolist()], pa.binary())], names=[query_col, "list", "u"])

        return asked.mapInArrow(run, f"{query_col} {kind}, list int, u binary")

    def opened(self, probes: DataFrame) -> DataFrame:
        """The blocks of the lists that are probed, from the folders of these alone."""
        lists = sorted(r.list for r in probes.select("list").distinct().collect())  # LISTS at most
        return self.blocks.filter(F.col("folder").isin(sorted({x % FOLDERS for x in lists})) & F.col("list").isin(lists))

    def search(self, asked: DataFrame, k: int, query_col: str = "item_id", vector_col: str = "embedding", probes: int | None = None) -> DataFrame:
        """(query, id, score, rank): by cosine, the k best that the probed lists hold for each question."""
        spark = asked.sparkSession
        kinds = f"{query_col} {asked.schema[query_col].dataType.simpleString()}, {self.id_col} {self.id_type}, score double"
        if self.model is None:
            return spark.createDataFrame([], f"{kinds}, rank int")
        rows = usable(asked, query_col, vector_col)
        asks = kept(self.probed(rows, query_col, probes or self.model.probes))
        blocks, model, names_of = self.opened(asks), spark.sparkContext.broadcast(self.model), (query_col, self.id_col)

        def scored(held, batch, r):
            import numpy as np

            names, u = held
            ids = batch.column("ids")[r].values.to_numpy(zero_copy_only=False)
            codes = np.frombuffer(batch.column("codes")[r].as_py(), np.uint8).reshape(len(ids), -1)
            v = np.frombuffer(batch.column("v")[r].as_py()).reshape(len(ids), -1)
            for a in range(0, len(names), TOGETHER):
                q, found, score = model.value.best(names[a : a + TOGETHER], u[a : a + TOGETHER], batch.column("list")[r].as_py(), ids, codes, v, k)
                yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(found), pa.array(score)], names=[*names_of, "score"])

        if is_small(asks, SENT):
            held = group(asks.toArrow(), query_col, self.model.dim)
            sent = spark.sparkContext.broadcast(held)

            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    for r in range(batch.num_rows):
                        if (mine := sent.value.get(batch.column("list")[r].as_py())) is not None:
                            yield from scored(mine, batch, r)

            return top(blocks.mapInArrow(run, kinds), k, query_col, self.id_col)

        # A list's blocks are dealt to as many tasks as the longest list has blocks for; its questions go to each.
        most = blocks.groupBy("list").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 1
        salts = min(int(spark.conf.get("spark.sql.shuffle.partitions")), most)
        null = lambda c: F.lit(None).cast(blocks.schema[c].dataType).alias(c)
        left = asks.select("list", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), F.lit(0).alias("kind"), query_col, "u", *(null(c) for c in ("ids", "codes", "v")))
        right = blocks.select("list", F.pmod(F.xxhash64("ids"), F.lit(salts)).cast("int").alias("salt"), F.lit(1).alias("kind"), F.lit(None).cast(asks.schema[query_col].dataType).alias(query_col), F.lit(None).cast("binary").alias("u"), "ids", "codes", "v")
        cells = left.unionByName(right).repartition("list", "salt").sortWithinPartitions("list", "salt", "kind")
        dim = self.model.dim

        def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            cell, waiting, mine = None, [], None
            for batch in batches:
                for r in range(batch.num_rows):
                    key = (batch.column("list")[r].as_py(), batch.column("salt")[r].as_py())
                    if key != cell:
                        cell, waiting, mine = key, [], None
                    if batch.column("kind")[r].as_py() == 0:
                        waiting.append(batch.select(["list", query_col, "u"]).slice(r, 1))
                        continue
                    if mine is None and waiting:
                        mine = group(pa.Table.from_batches(waiting), query_col, dim)[key[0]]
                    if mine is not None:
                        yield from scored(mine, batch, r)

        return top(cells.mapInArrow(meet, kinds), k, query_col, self.id_col)

    def share_read(self, asked: DataFrame, query_col: str = "item_id", vector_col: str = "embedding", probes: int | None = None) -> float:
        """The share of all vectors that lie in the lists a question probes, on average."""
        sizes = self.blocks.groupBy("list").agg(F.sum("n").alias("n"))
        asks = self.probed(usable(asked, query_col, vector_col), query_col, probes or self.model.probes)
        total = sizes.agg(F.sum("n")).first()[0]
        read, questions = asks.join(sizes, "list").agg(F.sum("n"), F.countDistinct(query_col)).first()
        return read / (total * questions) if questions else 0.0


def group(asks: pa.Table, query_col: str, dim: int) -> dict:
    """The names and unit vectors of the questions of each list."""
    import numpy as np

    out: dict[int, list] = {}
    for at, name, u in zip(*(asks.column(c).to_pylist() for c in ("list", query_col, "u"))):
        out.setdefault(at, []).append((name, u))
    return {at: (np.array([n for n, _ in rows]), np.frombuffer(b"".join(u for _, u in rows)).reshape(-1, dim)) for at, rows in out.items()}
