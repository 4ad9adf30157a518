"""Operator 11: ranked lexical search by Block-Max WAND.

The index is dealt by document: a task turns the texts that it reads into shards of at most ``SHARD`` documents, numbered
by ascending id.  A shard has a posting list for each term, cut into blocks of ``BLOCK`` postings; a block's gaps and term
frequencies are byte-packed, and beside it stand its first and last document and its maximum impacts: for each class of
frequencies (``CLASSES``) the largest frequency and the shortest document.  Scores depend on corpus statistics that are only
known when all shards are built, and grow with frequency and fall with length, so these pairs bound a block's scores
under any statistics.  Where the questions have no more than ``TERMS`` terms, only these enter the lists.

Questions come in blocks that meet each shard.  All questions of a block advance together, each by the rules of the
method: lists are ordered by their current document, the pivot is the first at which the sum of the lists' maxima passes
the threshold (the k-th best score so far); blocks that hold the pivot are found by a shallow move, which reads the
table of blocks only; if the sum of their maximum impacts stays below the threshold, all lists move beyond the nearest end
of these blocks without unpacking anything; else the blocks are unpacked (once a shard) and the pivot is scored in full.
The best k of each shard meet by question.

Terms are told apart by two hashes of 61 bits.  Scores are integers: ``weight`` and ``length_factor`` state them.

Cases: a null or empty text has no terms and is no document; questions without terms that occur, and those with null
texts, have no rows; rows of either table whose id is null take no part, in the statistics neither; documents that share
an id are ranked each, as are questions; equal scores go by ascending id; other columns are not read; an empty table on
either side gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grafloom.llm.shared import flat, ints, materialize, release_model, steps, task_count

#: Documents and postings of a shard, postings of a block.
SHARD = 1 << 15
POSTINGS = 1 << 22
BLOCK = 128
#: Classes of term frequencies end with these; the last has no end.
CLASSES = (1, 2, 4, 8)
#: Terms of all questions that may be sent to the tasks that build shards (8 bytes each).
TERMS = 1 << 20
#: Questions times terms of a block of questions, and blocks that meet a shard in one task.
CELL = 1 << 14
TOGETHER = 32
#: Documents are numbered below this.
FAR = 1 << 40


def words_of(part, column: str):
    from grafloom.llm.hashing import LETTERS, Words

    return Words(*flat(part.column(column)), LETTERS, True)


def weight(n: Column, df: Column) -> Column:
    """A term's weight from the number of documents and of those that hold it."""
    return F.floor(F.lit(1000.0) * F.log((2 * n + 2).cast("double") / (2 * df + 1).cast("double"))).cast("long")


def length_factor(n, documents: int, terms: int):
    """What a document of ``n`` terms counts as beside the mean length."""
    import numpy as np

    if 90 * documents * int(n.max(initial=0)) >= 1 << 62:
        return 10 + np.array([90 * int(x) * documents // terms for x in n], np.int64)
    return 10 + 90 * n.astype(np.int64) * documents // max(terms, 1)


def impact(tf, m):
    """A posting's score before the term's weight."""
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


def pack(values, width):
    """Values of ``width`` bytes each, one after the other."""
    import numpy as np

    raw = np.ascontiguousarray(values.astype("<u4")).view(np.uint8).reshape(-1, 4)
    return raw[np.arange(4) < width[:, None]]


def widths(most):
    """Bytes that the largest value of each block needs."""
    import numpy as np

    return np.where(most < 1 << 8, 1, np.where(most < 1 << 16, 2, 4)).astype(np.uint8)


#: A shard's arrays, in the order in which its row holds them.
ARRAYS = {"ids": "<i8", "length": "<i4", "h1": "<u8", "h2": "<u8", "head": "<i4", "first": "<i4", "last": "<i4", "size": "<u1", "most": "<i4", "least": "<i4", "gap_bytes": "<u1", "tf_bytes": "<u1", "gaps": "<u1", "tfs": "<u1"}
SHARD_SCHEMA = "shard long, n long, terms long, df array<int>, " + ", ".join(f"{c} binary" for c in ARRAYS)


def blocks_of(ids, length, doc, h1, h2, tf) -> dict:
    """The arrays of a shard from its documents and its postings (document's place, term's hashes, frequency)."""
    import numpy as np

    order = np.argsort(ids, kind="stable")
    place = np.empty(len(ids), np.int64)
    place[order] = np.arange(len(ids))
    doc = place[doc]
    by_term = np.lexsort((doc, h2, h1))
    doc, h1, h2, tf = doc[by_term], h1[by_term], h2[by_term], tf[by_term]
    n = len(doc)
    new = np.ones(n, bool)
    new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
    start = np.flatnonzero(new)
    within = np.arange(n) - np.repeat(start, np.diff(np.append(start, n)))
    cut = within % BLOCK == 0
    heads = np.flatnonzero(cut)
    size = np.diff(np.append(heads, n))
    gap = np.diff(doc, prepend=0)
    gap[heads] = 0
    most, least = [], []
    for low, high in zip((0, *CLASSES), (*CLASSES, 1 << 31)):
        mine = (tf > low) & (tf <= high)
        if n:
            most.append(np.maximum.reduceat(np.where(mine, tf, 0), heads))
            least.append(np.minimum.reduceat(np.where(mine, length[order][doc], (1 << 31) - 1), heads))
    gap_bytes, tf_bytes = (widths(np.maximum.reduceat(x, heads) if n else np.zeros(0, np.int64)) for x in (gap, tf))
    return {
        "ids": ids[order], "length": length[order], "h1": h1[start], "h2": h2[start], "head": np.searchsorted(heads, np.append(start, n)), "first": doc[heads], "last": doc[np.append(heads[1:], n)[: len(heads)] - 1], "size": size - 1,
        "most": np.concatenate(most) if n else np.zeros(0), "least": np.concatenate(least) if n else np.zeros(0), "gap_bytes": gap_bytes, "tf_bytes": tf_bytes, "gaps": pack(gap, np.repeat(gap_bytes, size)), "tfs": pack(tf, np.repeat(tf_bytes, size)),
    }


def build_shards(docs: DataFrame, wanted=None) -> DataFrame:
    """The shards of (i, t): rows of ``SHARD_SCHEMA``.  ``wanted`` are the sorted first hashes of the terms to keep, or None
    for all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import pandas as pd
        from pyspark import TaskContext

        from grafloom.llm.hashing import Sums, byte_values, mix

        release_model()
        number, held, size = TaskContext.get().partitionId() << 32, [], [0, 0, 0, 0]

        def out():
            ids, length, doc, h1, h2, tf = (np.concatenate(x) for x in zip(*held))
            arrays = blocks_of(ids, length, doc, h1, h2, tf)
            blobs = [pa.array([arrays[c].astype(kind).tobytes()], pa.binary()) for c, kind in ARRAYS.items()]
            many = np.add.reduceat(arrays["size"] + 1, arrays["head"][:-1]) if len(arrays["h1"]) else np.zeros(0, np.int64)
            rest = [pa.array([number], pa.int64()), pa.array([size[2]], pa.int64()), pa.array([size[3]], pa.int64()), pa.array([many.astype(np.int32)], pa.list_(pa.int32()))]
            return pa.RecordBatch.from_arrays([*rest, *blobs], names=["shard", "n", "terms", "df", *ARRAYS])

        for part in steps(batches, "t"):
            words = words_of(part, "t")
            length = np.diff(words.first)
            one = words.hashes(0)
            keep = np.arange(len(one))
            if wanted is not None and len(wanted):
                at = np.searchsorted(wanted, one)
                keep = np.flatnonzero(wanted[np.minimum(at, len(wanted) - 1)] == one)
            elif wanted is not None:
                keep = keep[:0]
            one, doc = one[keep], words.doc[keep]
            two = Sums(byte_values()[words.data], 1).of(words.start[keep], words.end[keep])
            codes, _ = pd.factorize(one ^ mix(two))
            key, at, tf = np.unique(doc * (len(one) + 1) + codes, return_index=True, return_counts=True)
            if size[0] and (size[0] + part.num_rows > SHARD or size[1] + len(key) > POSTINGS):
                yield out()
                number, size[:] = number + 1, [0, 0, 0, 0]
                held.clear()
            held.append((ints(part.column("i")), length, doc[at] + size[0], one[at], two[at], tf))
            for k, more in enumerate((part.num_rows, len(key), int((length > 0).sum()), int(length.sum()))):
                size[k] += more
        if size[0]:
            yield out()

    return docs.mapInArrow(run, SHARD_SCHEMA)


class Lists:
    """A shard's posting lists under given statistics."""

    def __init__(self, row: dict, documents: int, terms: int):
        import numpy as np

        for c, kind in ARRAYS.items():
            setattr(self, c, np.frombuffer(row[c], kind).astype(np.uint64 if kind == "<u8" else np.uint8 if c in ("gaps", "tfs") else np.int64))
        self.size += 1
        n = len(self.first)
        self.m = length_factor(self.length, documents, terms)
        most, least = self.most.reshape(-1, n), self.least.reshape(-1, n)
        self.bound = impact(most, length_factor(least.ravel(), documents, terms).reshape(-1, n) if n else least).max(axis=0, initial=0)
        self.begin = np.append(0, np.cumsum(self.size))  # a block's first posting
        self.term = np.repeat(np.arange(len(self.h1)), np.diff(self.head))
        self.ends = self.term * FAR + self.last  # ascending over all blocks
        self.gap_at, self.tf_at = (np.append(0, np.cumsum(self.size * w))[:-1] for w in (self.gap_bytes, self.tf_bytes))
        self.open = np.zeros(n, bool)
        # A closed block's postings stand at its end, so that the keys ascend whatever is open.
        self.key = np.repeat(self.ends, self.size)
        self.score = np.zeros(len(self.key), np.int64)

    def find(self, h1, h2):
        """The number of each term, or -1."""
        import numpy as np

        at = np.searchsorted(self.h1, h1)
        out = np.full(len(h1), -1)
        for step in range(8):  # terms that share the first hash stand together
            here = np.minimum(at + step, len(self.h1) - 1)
            same = (self.h1[here] == h1) & (self.h2[here] == h2) & (at + step < len(self.h1))
            out[same] = here[same]
            if not (self.h1[here] == h1).any():
                break
        return out

    def unpack(self, blocks) -> None:
        """Opens the blocks."""
        import numpy as np

        from grafloom.llm.hashing import ragged

        size = self.size[blocks]
        to = ragged(self.begin[blocks], size)
        within = ragged(np.zeros(len(blocks), np.int64), size)

        def values(data, at, width):
            w = np.repeat(width[blocks], size)
            a = np.repeat(at[blocks], size) + within * w
            out = np.zeros(len(a), np.int64)
            for k in range(4):
                use = w > k
                out[use] |= data[a[use] + k].astype(np.int64) << (8 * k)
            return out

        gaps = np.cumsum(values(self.gaps, self.gap_at, self.gap_bytes))
        heads = np.cumsum(size) - size
        doc = gaps - np.repeat(gaps[heads], size) + np.repeat(self.first[blocks], size)
        self.key[to] = np.repeat(self.term[blocks], size) * FAR + doc
        self.score[to] = impact(values(self.tfs, self.tf_at, self.tf_bytes), self.m[doc])
        self.open[blocks] = True


def search(lists: Lists, first, h1, h2, w, k: int, counted: dict | None = None):
    """(question, document's place, score) of the k best of each question; the terms of question q are first[q] to
    first[q + 1] of the other arrays."""
    import numpy as np

    many = np.diff(first)
    q, t = len(many), int(many.max(initial=0))
    rows = np.repeat(np.arange(q), many)
    columns = np.arange(len(rows)) - np.repeat(first[:-1], many)
    term = np.full((q, t), -1)
    term[rows, columns] = lists.find(h1, h2) if len(lists.h1) else -1
    weights = np.zeros((q, t), np.int64)
    weights[rows, columns] = w
    there = term >= 0
    live = np.flatnonzero(there.any(axis=1))
    term, weights, there = term[live], np.where(there, weights, 0)[live], there[live]
    if not len(live):
        return (np.zeros(0, np.int64),) * 3
    top = np.maximum.reduceat(lists.bound, lists.head[:-1])
    block = np.where(there, lists.head[term], 0)  # the block at the cursor, and one past the list's last
    stop = np.where(there, lists.head[term + 1], 0)
    cur = np.where(there, lists.first[block], FAR)
    at = np.where(there, lists.begin[block], -1)  # the cursor's posting, or -1 if only its block is known
    most = weights * np.where(there, top[term], 0)
    best, where = np.zeros((q, k), np.int64), np.full((q, k), -1)
    n_blocks = len(lists.first)
    while len(live):
        bar, width = best[live, k - 1], term.shape[1]
        order = np.argsort(cur, axis=1)
        order += (np.arange(len(live)) * width)[:, None]
        passed = np.cumsum(most.take(order), axis=1) > bar[:, None]
        pivot = cur.take(order[np.arange(len(live)), passed.argmax(axis=1)])
        going = passed[:, -1] & (pivot < FAR)
        if not going.all():
            live, term, weights, block, stop, cur, at, most, bar, pivot = (x[going] for x in (live, term, weights, block, stop, cur, at, most, bar, pivot))
            if not len(live):
                break
        # Shallow move: the blocks that hold the pivot or are the next after it.
        ahead = cur > pivot[:, None]
        x = np.flatnonzero(~ahead)  # the lists at or before the pivot
        r = x // width
        p, b, end, doc, place, own, base = pivot[r], block.take(x), stop.take(x), cur.take(x), at.take(x), weights.take(x), term.take(x) * FAR
        behind = np.flatnonzero(lists.last[b] < p)
        if len(behind):
            b[behind] = np.searchsorted(lists.ends, base[behind] + p[behind])
            place[behind] = -1
        gone = b >= end
        here = np.minimum(b, n_blocks - 1)
        first_doc, last_doc = lists.first[here], lists.last[here]
        holds = ~gone & (first_doc <= p)
        may = np.bincount(r, np.where(holds, own * lists.bound[here], 0), minlength=len(live)).astype(np.int64)
        enter = may > bar
        deep = enter[r]
        to = p
        if not enter.all():
            # Below the threshold: beyond the nearest end of these blocks, or to the next list.
            over = np.where(ahead, cur, FAR).min(axis=1)
            np.minimum.at(over, r, np.where(gone, FAR, np.where(holds, last_doc + 1, first_doc)))
            to = np.where(deep, p, over[r])
            past = ~gone & (last_doc < to)
            b += past
            place[past] = -1
            gone |= b >= end
            here = np.minimum(b, n_blocks - 1)
            first_doc = lists.first[here]
        # A cursor that does not rest on a posting at the target stands at its block's head or somewhere inside it.
        moves = np.flatnonzero((place < 0) | (doc < to))
        head = first_doc[moves] >= to[moves]
        place[moves] = np.where(head, lists.begin[here[moves]], -1)
        doc[moves] = np.where(head, first_doc[moves], to[moves])
        inside = np.flatnonzero(deep & holds)
        shut = here[inside]
        shut = shut[~lists.open[shut]]
        if len(shut):
            lists.unpack(np.unique(shut))
        seek = inside[place[inside] < 0]
        if len(seek):
            found = np.searchsorted(lists.key, base[seek] + p[seek])
            place[seek], doc[seek] = found, lists.key[found] - base[seek]
        hit = inside[doc[inside] == p[inside]]
        if len(hit):
            score = np.bincount(r[hit], own[hit] * lists.score[place[hit]], minlength=len(live)).astype(np.int64)
            for q_at in np.flatnonzero(score > bar).tolist():
                row, y = best[live[q_at]], score[q_at]
                j = int(np.searchsorted(-row, -y, "right"))  # after equal scores, which have smaller ids
                row[j + 1 :], where[live[q_at], j + 1 :] = row[j:-1].copy(), where[live[q_at], j:-1].copy()
                row[j], where[live[q_at], j] = y, pivot[q_at]
            follow = place[hit] + 1
            leave = follow >= lists.begin[here[hit] + 1]
            place[hit] = follow
            doc[hit] = lists.key[np.minimum(follow, len(lists.key) - 1)] - base[hit]
            left = hit[leave]
            b[left] += 1
            gone[left] = b[left] >= end[left]
            doc[left] = lists.first[np.minimum(b[left], n_blocks - 1)]
        doc[gone] = FAR
        np.put(block, x, np.minimum(b, n_blocks - 1))
        np.put(at, x, place)
        np.put(cur, x, doc)
        if counted is not None:
            counted["steps"] = counted.get("steps", 0) + len(live)
            counted["scored"] = counted.get("scored", 0) + int(enter.sum())
    found = best > 0
    row, _ = np.nonzero(found)
    return row, where[found], best[found]


def questions(items: DataFrame) -> DataFrame:
    """(no, id, h1, h2): the terms of each item, once each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        release_model()
        for part in steps(batches, "t"):
            words = words_of(part, "t")
            one, two = words.hashes(0), words.hashes(1)
            order = np.lexsort((two, one, words.doc))
            doc, one, two = words.doc[order], one[order], two[order]
            new = np.ones(len(doc), bool)
            new[1:] = (doc[1:] != doc[:-1]) | (one[1:] != one[:-1]) | (two[1:] != two[:-1])
            yield pa.RecordBatch.from_arrays([part.column("no").take(pa.array(doc[new])), part.column("i").take(pa.array(doc[new])), pa.array(one[new].view(np.int64)), pa.array(two[new].view(np.int64))], names=["no", "i", "h1", "h2"])

    return items.mapInArrow(run, "no long, i long, h1 long, h2 long")


def question_blocks(weighted: DataFrame) -> DataFrame:
    """(b, no blob, first blob, h1 blob, h2 blob, w blob) from (no, h1, h2, w): blocks of at most ``CELL`` cells."""
    lists = weighted.groupBy("no").agg(F.collect_list(F.struct("h1", "h2", "w")).alias("x"))
    rows = lists.select("no", F.size("x").alias("n"), "x.h1", "x.h2", "x.w").sortWithinPartitions("n", "no")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        release_model()
        held: list = []

        def out():
            no, many, *rest = zip(*held)
            blobs = [np.array(no, np.int64), np.append(0, np.cumsum(many)).astype(np.int64), *(np.concatenate(x).astype(np.int64) for x in rest)]
            return pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in blobs], names=["no", "first", "h1", "h2", "w"])

        for batch in batches:
            for no, n, *rest in zip(*(batch.column(c) for c in ("no", "n", "h1", "h2", "w"))):
                if held and (len(held) + 1) * n.as_py() > CELL:
                    yield out()
                    held.clear()
                held.append((no.as_py(), n.as_py(), *(x.values.to_numpy(zero_copy_only=False) for x in rest)))
        if held:
            yield out()

    return rows.mapInArrow(run, "no binary, first binary, h1 binary, h2 binary, w binary").withColumn("b", F.monotonically_increasing_id())


def ranked(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(item, rank, id, score) of the k best documents of each item."""
    import numpy as np

    spark = docs.sparkSession
    source = docs.filter(docs[id_col].isNotNull()).select(docs[id_col].cast("long").alias("i"), docs[text_col].alias("t"))
    asked = items.filter(items[item_col].isNotNull()).select(items[item_col].cast("long").alias("i"), items[item_text].alias("t"))
    terms = materialize(questions(asked.withColumn("no", F.monotonically_increasing_id())), "questions")
    known = terms.select("h1").distinct()
    wanted = None
    if known.count() <= TERMS:
        wanted = np.sort(known.toPandas()["h1"].to_numpy(np.int64).view(np.uint64))
    shards = materialize(build_shards(source, wanted), "shards")
    n_shards, documents, total = shards.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("terms"), F.lit(0))).first()
    heads = shards.select("h1", "h2", "df").mapInArrow(_term_rows, "h1 long, h2 long, df long")
    df = heads.groupBy("h1", "h2").agg(F.sum("df").alias("df"))
    weighted = terms.select("no", "h1", "h2").join(df, ["h1", "h2"]).withColumn("w", weight(F.lit(documents), F.col("df"))).filter("w > 0")
    asks = materialize(question_blocks(weighted.select("no", "h1", "h2", "w")), "asks")
    # Every block of questions meets every shard.  A cell has some shards and at most TOGETHER blocks; the blocks come first.
    cells, salts = max(1, n_shards), max(1, -(-asks.count() // TOGETHER))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    blank = F.lit(None).cast("binary")
    left = asks.select(F.pmod(F.xxhash64("b"), F.lit(salts)).cast("int").alias("salt"), F.lit(-1).cast("long").alias("shard"), "no", "first", F.col("h1").alias("q1"), F.col("h2").alias("q2"), "w", *(blank.alias(c) for c in ARRAYS if c != "first"), blank.alias("from")).withColumn("cell", every(cells))
    right = shards.select("shard", *(F.lit(None).cast("binary").alias(c) for c in ("no", "q1", "q2", "w")), F.lit(None).cast("binary").alias("first"), *(c for c in ARRAYS if c != "first"), F.col("first").alias("from")).withColumn("cell", F.pmod(F.xxhash64("shard"), F.lit(cells)).cast("int")).withColumn("salt", every(salts))
    columns = ["cell", "salt", "shard", "no", "first", "q1", "q2", "w", "from", *(c for c in ARRAYS if c != "first")]
    tasks = max(1, min(cells * salts, max(8 * task_count(spark), 1)))
    met = left.select(columns).unionByName(right.select(columns)).repartition(tasks, "cell", "salt").sortWithinPartitions("cell", "salt", "shard")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        release_model()
        cell, held = None, []
        for batch in batches:
            for row in (batch.slice(r, 1) for r in range(batch.num_rows)):
                key = tuple(row.column(c)[0].as_py() for c in ("cell", "salt"))
                if key != cell:
                    cell, held = key, []
                if row.column("shard")[0].as_py() < 0:
                    no, first, h1, h2, w = (np.frombuffer(row.column(c)[0].as_py(), kind) for c, kind in (("no", np.int64), ("first", np.int64), ("q1", np.uint64), ("q2", np.uint64), ("w", np.int64)))
                    held.append((no, first, h1, h2, w))
                    continue
                if not held or not row.column("h1")[0].as_py():
                    continue
                lists = Lists({c: row.column("from" if c == "first" else c)[0].as_py() for c in ARRAYS}, documents, total)
                for no, *question in held:
                    q, place, score = search(lists, *question, k)
                    yield pa.RecordBatch.from_arrays([pa.array(no[q]), pa.array(lists.ids[place]), pa.array(score)], names=["no", "id", "score"])

    found = met.mapInArrow(run, "no long, id long, score long")
    best = Window.partitionBy("no").orderBy(F.desc("score"), "id")
    top = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    names = terms.select("no", "i").distinct()
    return top.join(names, "no").select(F.col("i").alias(item_col), "rank", F.col("id").alias(id_col), "score")


def _term_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h1, h2, df) of every term of the shards."""
    import numpy as np

    for batch in batches:
        for r in range(batch.num_rows):
            h1, h2 = (np.frombuffer(batch.column(c)[r].as_py(), np.int64) for c in ("h1", "h2"))
            yield pa.RecordBatch.from_arrays([pa.array(h1), pa.array(h2), batch.column("df")[r].values.cast(pa.int64())], names=["h1", "h2", "df"])
