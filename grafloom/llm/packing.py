"""Operator 6: token ids packed into rows of fixed length by best-fit decreasing.

Documents are encoded; whole runs of ``capacity`` tokens of a long document fill rows of their own, and the remainders,
longest first, each go to the fullest row that still has room.  Rows are found by a segment tree over the capacities
left: the least capacity that is large enough and that some row has.  No token is lost, and no document is cut unless
it is longer than a row.

Each task packs the documents of its own input split, ``WINDOW`` tokens at a time, so nothing is shuffled, memory is
bounded, and a lost task makes the same rows again.  Rows come as little-endian id matrices of one row each, padded
with ``pad``, with cumulative segment lengths and the positions at which position ids start again.

Cases: null and empty texts have no tokens and are in no row; a null id is kept in the lists; repeated rows are packed
each; other columns are not read; an empty table gives an empty result.  Ids of documents are read as long.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grafloom.llm.shared import flat, steps, worker_model

#: Tokens that a task holds before it packs them.
WINDOW = 4_000_000
#: Pieces whose ids a worker remembers; the cache is emptied when it is full.
CACHE = 200_000


class Capacities:
    """Open rows by capacity left; ``fit`` takes the fullest that has room."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.tree = [0] * (2 * self.leaves)  # open rows below each node
        self.rows: list[list[int]] = [[] for _ in range(capacity + 1)]

    def add(self, left: int, row: int) -> None:
        self.rows[left].append(row)
        at = self.leaves + left
        while at:
            self.tree[at] += 1
            at >>= 1

    def fit(self, size: int) -> tuple[int, int] | None:
        """(capacity left, row) of the row with the least capacity of ``size`` or more, which is taken out."""
        at = self.leaves + size
        if not self.tree[at]:
            while at > 1 and (at & 1 or not self.tree[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.leaves:
                at = 2 * at if self.tree[2 * at] else 2 * at + 1
        left = at - self.leaves
        row = self.rows[left].pop()
        while at:
            self.tree[at] -= 1
            at >>= 1
        return left, row


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Which items each row holds; sizes are 1 to ``capacity``."""
    rows: list[list[int]] = []
    open_rows = Capacities(capacity)
    for item in sorted(range(len(sizes)), key=lambda k: (-sizes[k], k)):
        found = open_rows.fit(sizes[item])
        if found is None:
            left, row = capacity, len(rows)
            rows.append([])
        else:
            left, row = found
        rows[row].append(item)
        if left > sizes[item]:
            open_rows.add(left - sizes[item], row)
    return rows


class Encoder:
    """The library's merges on distinct pieces, its pattern on whole batches."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
        self.library = tiktoken.Encoding("packing", pat_str=r"[\s\S]", mergeable_ranks=ranks, special_tokens={})
        self.kind = "<u2" if max(ranks.values()) < 1 << 16 else "<u4"
        self.cache: dict[bytes, list[int]] = {}

    def encode(self, raw, offsets):
        """(ids, where each text's begin and end)."""
        import numpy as np

        from grafloom.llm.hashing import ragged
        from grafloom.llm.pieces import code_points, cut, distinct_slices

        points, places = code_points(raw)
        heads = np.searchsorted(places, offsets)
        start, end = cut(points, heads[:-1], spaced=True)
        if not len(start):
            return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
        a, b = places[start], places[end]
        first, codes = distinct_slices(raw, a, b)
        data, cache, merge, known = raw.tobytes(), self.cache, self.library._core_bpe.encode_single_piece, []
        for x, y in zip(a[first].tolist(), b[first].tolist()):
            piece = data[x:y]
            ids = cache.get(piece)
            if ids is None:
                if len(cache) >= CACHE:
                    cache.clear()
                ids = cache[piece] = merge(piece)
            known.append(ids)
        size = np.fromiter(map(len, known), np.int64, len(known))
        every = np.fromiter((i for ids in known for i in ids), np.int64, int(size.sum()))
        return every[ragged((np.cumsum(size) - size)[codes], size[codes])], np.append(0, np.cumsum(size[codes]))[np.searchsorted(start, heads)]


SCHEMA = "pack_id long, n_tokens int, ids binary, doc_ids array<long>, doc_offsets array<int>, cu_seqlens array<int>, position_resets array<int>"


def packed(docs: DataFrame, vocabulary: str, capacity: int = 2048, pad: int = 50256, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per packed sequence: its ids (``capacity`` of them, uint16, or uint32 where the
    vocabulary has larger ids), the document of each segment and where in
    the document it begins, cumulative segment lengths from 0, and where positions start from 0 again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        from pyspark import TaskContext

        encoder, serial = worker_model(("packing", vocabulary), lambda: Encoder(vocabulary)), TaskContext.get().partitionId() << 33
        held: list = []
        tokens = 0

        def out():
            nonlocal serial
            sizes, origin = [], []
            for d, (_, ids) in enumerate(held):
                for at in range(0, len(ids), capacity):
                    sizes.append(min(capacity, len(ids) - at))
                    origin.append((d, at))
            rows = best_fit(sizes, capacity)
            for a in range(0, len(rows), 2048):
                cols: list[list] = [[] for _ in range(7)]
                for items in rows[a : a + 2048]:
                    line = np.full(capacity, pad, encoder.kind)
                    ends = [0]
                    for item in items:
                        d, at = origin[item]
                        line[ends[-1] : ends[-1] + sizes[item]] = held[d][1][at : at + sizes[item]]
                        ends.append(ends[-1] + sizes[item])
                    for col, x in zip(cols, (serial, ends[-1], line.tobytes(), [held[origin[i][0]][0] for i in items], [origin[i][1] for i in items], ends, ends[:-1])):
                        col.append(x)
                    serial += 1
                kinds = [pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int32())]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["pack_id", "n_tokens", "ids", "doc_ids", "doc_offsets", "cu_seqlens", "position_resets"])

        for part in steps(batches, "t"):
            ids, bounds = encoder.encode(*flat(part.column("t")))
            ids, ends = ids.astype(encoder.kind), bounds.tolist()
            for k, i in enumerate(part.column("i").to_pylist()):
                if ends[k + 1] > ends[k]:
                    held.append((i, ids[ends[k] : ends[k + 1]]))
            tokens += len(ids)
            if tokens >= WINDOW:
                yield from out()
                held, tokens = [], 0
        yield from out()

    return docs.select(docs[id_col].cast("long").alias("i"), docs[text_col].alias("t")).mapInArrow(run, SCHEMA)


def position_ids(packs: DataFrame) -> DataFrame:
    """``packs`` with position_ids array<int>: positions within each segment."""
    sizes = F.zip_with(F.slice("cu_seqlens", 2, F.size("cu_seqlens") - 1), "position_resets", lambda b, a: b - a)
    return packs.withColumn("position_ids", F.flatten(F.transform(sizes, lambda n: F.sequence(F.lit(0), n - 1))))


def write_packed(packs: DataFrame, path: str) -> None:
    """Writes the rows as Parquet: id matrices, cumulative lengths and resets beside each other."""
    packs.write.mode("overwrite").parquet(path)
