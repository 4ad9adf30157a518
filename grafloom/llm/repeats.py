"""Operator 5: passages that repeat across documents, by level-wise doubling of repeated windows.

Level lengths are ``window`` halved while it stays at ``SHORTEST`` words or more, the shortest first.

1. The first level counts windows of the shortest length.  Not all are: a pre-filter takes the one with the least hash
   of all that lie within each window of full length (its anchor).  Equal full windows have equal anchors, so a full
   window can only repeat if its anchor does, and a small share of the positions stands for all.  An anchor carries the
   range of the full windows that it stands for (its run), and a hash of all words that these cover.
2. Anchors that are in one document alone drop out; the others are the candidates of the next level.
3. At each further level the candidates are extended to twice the length and counted; those in one document alone drop
   out, and the levels end early when none survive.  At full length, a run whose whole extent (by anchor, place and
   extent; two hashes of different bases) is that of other runs is extended as one: in all documents but the one with the least id
   its windows go.  Where an anchor has several different runs, their windows are extended one by one, hashed from the
   texts (128 bits), and each window's least document id decides.

Counting takes the least and the largest document id per hash, with partial results on the map side, so a passage that
is in very many documents is not gathered in one place.  Texts are exchanged only for documents that a bitmap of fixed
size does not rule out.  Places are kept as ranges: neighbours are put together before a document's list is made.

Cases: a null or empty text has no words; texts of fewer words than a window lose nothing; rows that share an id are one
document, so neither removes from the other, and each loses what its own words repeat; rows with a null id remove
nothing and lose nothing; repeated rows give a row each; other columns are not read; an empty table gives an empty
result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from grafloom.llm.shared import flat, ints, materialize, parted, release_model, spread_join, steps

SHORTEST = 16


def level_lengths(window: int) -> list[int]:
    out = [window]
    while out[0] // 2 >= SHORTEST and out[0] % 2 == 0:
        out.insert(0, out[0] // 2)
    return out


def anchors(words, values, window: int, length: int):
    """(first words of all windows of full length, their anchor's first word, hash of the anchor)."""
    import numpy as np

    if len(values) < window:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),)
    from grafloom.llm.hashing import Sums

    start = np.arange(len(values) - length + 1)
    h = Sums(values).of(start, start + length)
    span, have = window - length + 1, 1
    least, where = h, start
    while have < span:  # the least of twice as many places, the leftmost of equals
        step = min(have, span - have)
        a, b = least[: len(least) - step], least[step:]
        right = b < a
        least, where = np.where(right, b, a), np.where(right, where[step:], where[: len(where) - step])
        have += step
    full = np.arange(len(values) - window + 1)
    ok = words.doc[full] == words.doc[full + window - 1]
    return full[ok], where[full[ok]], least[full[ok]]


def of_texts(part, text="t"):
    from grafloom.llm.hashing import NOT_SPACE, Words

    return Words(*flat(part.column(text)), NOT_SPACE, False)


def anchor_rows(docs: DataFrame, window: int, length: int) -> DataFrame:
    """(h, s, doc, lo, hi) of the anchors of each row: hashes of the anchor and of its run, and the first words of
    the run's first and last window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        from grafloom.llm.hashing import Sums, mix

        release_model()
        for part in steps(batches, "t"):
            words = of_texts(part)
            values = words.hashes()
            full, where, least = anchors(words, values, window, length)
            new = np.append(True, where[1:] != where[:-1]) if len(where) else np.zeros(0, bool)
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(full)) - 1 if len(full) else first
            lo, hi, at, d = full[first], full[last], where[first], words.doc[full[first]]
            # Where the anchor lies in its run is part of what runs must share.
            span = mix(Sums(words.hashes(1), 1).of(lo, hi + window) + mix(((at - lo) * 64 + (hi - lo)).astype(np.uint64)))
            base = words.first[d]
            yield pa.RecordBatch.from_arrays([pa.array(least[first].view(np.int64)), pa.array(span.view(np.int64)), pa.array(ints(part.column("i"))[d]), pa.array((lo - base).astype(np.int32)), pa.array((hi - base).astype(np.int32))], names=["h", "s", "doc", "lo", "hi"])

    return docs.mapInArrow(run, "h long, s long, doc long, lo int, hi int")


def extended(docs: DataFrame, places: DataFrame, window: int, length: int) -> DataFrame:
    """(h1, h2, doc, pos) of the windows of ``length`` words at the candidate places (doc, lo, hi: arrays)."""
    some, _ = parted(docs, "i", places.select("doc"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        from grafloom.llm.hashing import Sums, ragged

        release_model()
        for part in steps(batches, "t"):
            words = of_texts(part)
            owner, lo, hi = listed(part)
            start = np.unique(ragged(words.first[owner] + lo, hi - lo + 1))
            # Rows that share an id have places of each other: what runs over the end is not theirs.
            start = start[start + window <= len(words.doc)]
            start = start[words.doc[start] == words.doc[start + window - 1]]
            d = words.doc[start]
            h1 = Sums(words.hashes(0), 0).of(start, start + length)
            h2 = Sums(words.hashes(1), 1).of(start, start + length)
            yield pa.RecordBatch.from_arrays([pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), pa.array(ints(part.column("i"))[d]), pa.array((start - words.first[d]).astype(np.int32))], names=["h1", "h2", "doc", "pos"])

    joined = some.join(places, some["i"] == places["doc"]).select("i", "t", "lo", "hi")
    return joined.mapInArrow(run, "h1 long, h2 long, doc long, pos int")


def listed(part):
    """(text's number, first and last place) of all ranges in the columns lo and hi."""
    import numpy as np

    lo, hi = (c.fill_null([]) if c.null_count else c for c in (part.column("lo"), part.column("hi")))
    owner = np.repeat(np.arange(part.num_rows), np.diff(lo.offsets.to_numpy()))
    return owner, *(c.flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in (lo, hi))


def by_document(ranges: DataFrame) -> DataFrame:
    """(doc, lo, hi) with arrays of each document's ranges, of which those that touch are one."""
    before = Window.partitionBy("doc").orderBy("lo", "hi").rowsBetween(Window.unboundedPreceding, -1)
    so_far = Window.partitionBy("doc").orderBy("lo", "hi").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    apart = F.coalesce(F.col("lo") > F.max("hi").over(before) + 1, F.lit(True))
    rows = ranges.withColumn("apart", apart).withColumn("n", F.count_if("apart").over(so_far))
    whole = rows.groupBy("doc", "n").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    both = whole.groupBy("doc").agg(F.collect_list(F.struct("lo", "hi")).alias("r"))
    return both.select("doc", F.col("r.lo").alias("lo"), F.col("r.hi").alias("hi"))


def in_several(rows: DataFrame, *keys: str) -> DataFrame:
    """(keys, least, n) of the hashes that are in more than one document: its least id, and how many rows there are."""
    ends = rows.groupBy(*keys).agg(F.min("doc").alias("least"), F.max("doc").alias("most"), F.count(F.lit(1)).alias("n"))
    return materialize(ends.filter("least < most").drop("most"), "several")


def repeated_places(docs: DataFrame, window: int) -> DataFrame:
    """(doc, lo, hi): ranges of the first words of windows that also start in a document with a smaller id."""
    lengths = level_lengths(window)
    rows = materialize(anchor_rows(docs, window, lengths[0]), f"level{lengths[0]}")
    alive = materialize(spread_join(rows, in_several(rows, "h").drop("least"), ["h"], "doc"), f"alive{lengths[0]}")
    # Runs that are alike as a whole are extended to full length as one; where an anchor has different runs, the least of
    # each kind goes on by its windows, as these may be in runs of another kind.
    runs = alive.groupBy("h", "s").agg(F.min("doc").alias("least"), F.count(F.lit(1)).alias("n"))
    kinds = runs.groupBy("h").agg(F.count(F.lit(1)).alias("kinds"))
    runs = materialize(runs.join(kinds, "h"), "runs")
    whole = spread_join(alive, runs, ["h", "s"], "doc")
    gone = whole.filter("doc > least").select("doc", "lo", "hi")
    places = whole.filter("doc = least and kinds > 1").select("doc", "lo", "hi")
    for length in lengths[1:]:
        places = materialize(by_document(places), f"places{length}")
        if places.isEmpty():
            break
        found = materialize(extended(docs, places, window, length), f"level{length}")
        kept = spread_join(found, in_several(found, "h1", "h2"), ["h1", "h2"], "doc")
        places = kept.select("doc", F.col("pos").alias("lo"), F.col("pos").alias("hi"))
        if length == window:
            gone = gone.unionByName(kept.filter("doc > least").select("doc", F.col("pos").alias("lo"), F.col("pos").alias("hi")))
    return gone


def without_repeats(docs: DataFrame, window: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_removed, text): the words left of each row, joined by one space."""
    source = docs.select(docs[id_col].cast("long").alias("i"), docs[text_col].alias("t"))
    places = materialize(by_document(repeated_places(source.filter("i is not null"), window)), "gone")
    some, others = parted(source, "i", places.select("doc"))
    joined = some.join(places, some["i"] == places["doc"], "left").select("i", "t", "lo", "hi")
    none = F.lit(None).cast("array<int>")
    joined = joined.unionByName(others.select("i", "t", none.alias("lo"), none.alias("hi")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        from grafloom.llm.hashing import ragged

        release_model()
        for part in steps(batches, "t"):
            words = of_texts(part)
            n = len(words.start)
            change = np.zeros(n + 1, np.int64)
            owner, lo, hi = listed(part)
            start, stop = words.first[owner] + lo, words.first[owner] + hi + window
            ok = stop <= words.first[owner + 1]
            np.add.at(change, start[ok], 1)
            np.add.at(change, stop[ok], -1)
            gone = np.cumsum(change[:-1]) > 0
            kept = np.flatnonzero(~gone)
            removed = np.bincount(words.doc[gone], minlength=part.num_rows)
            a, size = words.start[kept], words.end[kept] - words.start[kept]
            padded = np.append(words.raw, np.uint8(0x20))
            out = padded[ragged(a, size + 1)]
            ends = np.cumsum(size + 1)
            out[ends - 1] = 0x20
            many = np.bincount(words.doc[kept], minlength=part.num_rows)
            stop = np.append(0, ends)[np.cumsum(many)]
            begin = np.append(0, stop[:-1])
            data = out.tobytes()
            texts = [data[x : y - 1] if y > x else b"" for x, y in zip(begin.tolist(), stop.tolist())]
            yield pa.RecordBatch.from_arrays([part.column("i"), pa.array(np.diff(words.first)), pa.array(removed), pa.array(texts, pa.binary()).cast(pa.string())], names=["i", "n_words", "n_removed", "text"])

    return joined.mapInArrow(run, "i long, n_words long, n_removed long, text string").withColumnRenamed("i", id_col)
