"""Operator 2: lines that occur in many documents, dropped by probing a sharded minimal perfect hash.

1. The 128-bit hashes of all long enough line keys are counted, once a document, with partial sums on the map side.  A
   hash that is in one document only needs no entry: what the index does not hold has the count 1.
2. The distinct hashes with a higher count are dealt to shards of about ``SHARD_KEYS`` keys.  Each shard's keys get a
   minimal perfect hash (levels of bit arrays; a key rests on the first level where it is alone), which numbers compact
   arrays of fingerprints, counts and owners (the largest document id).
3. Documents probe the arrays: a line goes if its count is high enough and its owner is another document.  While all
   shards together hold ``INDEX_BYTES`` at most, they are sent to every executor, and a document's task looks its lines
   up in place; nothing is joined and no text is exchanged.
4. A larger index stays where it is, and the documents' hashes (not their texts) are routed to the shards' arrays.  A
   shard's arrays are copied once for every ``PROBES`` hashes that are to come, by the counts in the index, and a line's
   probes are dealt over these by document, so that a line that is in every document does not meet in one task.  The
   hits, gathered per document, then meet the texts once.

Cases: a null or empty text is one empty line; rows count as documents, also those that share an id, and of these all
keep a line that their id owns; rows with a null id are left whole and count for nothing; repeated rows give a row
each; other columns are kept by ``drop_lines`` and are not read otherwise; an empty table gives an empty result.  Ids are
compared as long.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grafloom.llm.shared import flat, ints, materialize, release_model, steps, task_count, worker_model

SHARD_KEYS = 1 << 15
#: Shards at most; with more keys, shards get larger.
SHARDS = 1 << 16
#: Bytes of an index that every executor gets whole.
INDEX_BYTES = 64 << 20
#: Hashes that one copy of a shard is probed with.
PROBES = 1 << 21
LEVELS = 24


def split_lines(raw, offsets):
    """(start, end, text's number) of all lines of raw[offsets[k]:offsets[k + 1]], and where each text's lines begin."""
    import numpy as np

    breaks = np.flatnonzero(raw == 0x0A)
    inside = np.searchsorted(breaks, offsets)
    first = inside + np.arange(len(offsets))
    n = int(first[-1])
    start, end = np.empty(n, np.int64), np.empty(n, np.int64)
    of = np.repeat(np.arange(len(offsets) - 1), np.diff(inside))
    at = np.arange(len(breaks)) + of
    start[first[:-1]] = offsets[:-1]
    start[at + 1] = breaks + 1
    end[first[1:] - 1] = offsets[1:]
    end[at] = breaks
    return start, end, np.repeat(np.arange(len(offsets) - 1), np.diff(first)), first


def line_keys(raw, start, end, least: int):
    """(which lines have a key of at least ``least`` code points, two hashes of each such key)."""
    import numpy as np

    from grafloom.llm.hashing import LOWER, NOT_SPACE, Sums, byte_values

    solid = np.flatnonzero(NOT_SPACE[raw])
    i, j = np.searchsorted(solid, start), np.searchsorted(solid, end)
    some = np.flatnonzero(i < j)
    a, b = solid[i[some]], solid[j[some] - 1] + 1
    points = np.append(0, np.cumsum((raw & 0xC0) != 0x80))
    keep = points[b] - points[a] >= least
    some, a, b = some[keep], a[keep], b[keep]
    low = LOWER[raw]
    return some, Sums(byte_values()[low], 0).of(a, b), Sums(byte_values()[low], 1).of(a, b)


def build(one, two):
    """(levels of bit arrays, number of each key, keys that found no place) of a minimal perfect hash."""
    import numpy as np

    from grafloom.llm.hashing import mix

    key = one ^ mix(two)
    number, left, levels, done = np.full(len(key), -1, np.int64), np.arange(len(key)), [], 0
    while len(left) and len(levels) < LEVELS:
        size = 2 * len(left) + 1
        at = (mix(key[left] + np.uint64(len(levels))) % np.uint64(size)).astype(np.int64)
        alone = np.bincount(at, minlength=size) == 1
        levels.append(alone)
        rank = np.cumsum(alone) - 1 + done
        fits = alone[at]
        number[left[fits]] = rank[at[fits]]
        done += int(fits.sum())
        left = left[~fits]
    return levels, number, left


class Shard:
    """The arrays of one shard, as made by ``pack``."""

    def __init__(self, blob: bytes):
        import numpy as np

        head = np.frombuffer(blob, np.int64, 3)
        n, left, k = (int(x) for x in head)
        sizes = np.frombuffer(blob, np.int64, k, 24)
        at = 24 + 8 * k
        self.levels, done = [], 0
        for s in sizes.tolist():
            bits = np.unpackbits(np.frombuffer(blob, np.uint8, (s + 7) // 8, at), count=s).astype(bool)
            at += (s + 7) // 8
            self.levels.append((bits, np.cumsum(bits, dtype=np.int32) - 1 + done))
            done += int(bits.sum())
        self.prints = np.frombuffer(blob, np.uint64, n, at)
        self.owners = np.frombuffer(blob, np.int64, n, at + 8 * n)
        self.counts = np.frombuffer(blob, np.uint32, n, at + 16 * n)
        self.rest = np.frombuffer(blob, np.uint64, left, at + 20 * n)
        self.filled = n - left

    def probe(self, one, two):
        """The number of each key in the arrays, -1 for keys that are not there."""
        import numpy as np

        from grafloom.llm.hashing import mix

        key = one ^ mix(two)
        out, left = np.full(len(key), -1, np.int64), np.arange(len(key))
        for level, (bits, rank) in enumerate(self.levels):
            at = (mix(key[left] + np.uint64(level)) % np.uint64(len(bits))).astype(np.int64)
            hit = bits[at]
            out[left[hit]] = rank[at[hit]]
            left = left[~hit]
        for k, other in enumerate(self.rest.tolist()):
            out[left[key[left] == np.uint64(other)]] = self.filled + k
        found = np.flatnonzero(out >= 0)
        out[found[self.prints[out[found]] != two[found]]] = -1
        return out


def pack(one, two, counts, owners) -> bytes:
    import numpy as np

    from grafloom.llm.hashing import mix

    levels, number, left = build(one, two)
    number[left] = len(one) - len(left) + np.arange(len(left))
    prints, own, cnt = np.empty(len(one), np.uint64), np.empty(len(one), np.int64), np.empty(len(one), np.uint32)
    prints[number], own[number], cnt[number] = two, owners, np.minimum(counts, 0xFFFFFFFF)
    parts = [np.array([len(one), len(left), len(levels), *map(len, levels)], np.int64).tobytes()]
    parts += [np.packbits(bits).tobytes() for bits in levels]
    return b"".join([*parts, prints.tobytes(), own.tobytes(), cnt.tobytes(), (one ^ mix(two))[left].tobytes()])


def line_hashes(docs: DataFrame, least: int, id_col: str, text_col: str) -> DataFrame:
    """(h1, h2, doc): each long enough line key of each row, once a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        release_model()
        for part in steps(batches, "t"):
            raw, offsets = flat(part.column("t"))
            start, end, of, _ = split_lines(raw, offsets)
            some, one, two = line_keys(raw, start, end, least)
            own = of[some]
            order = np.lexsort((two, one, own))
            own, one, two = own[order], one[order], two[order]
            new = np.ones(len(own), bool)
            new[1:] = (own[1:] != own[:-1]) | (one[1:] != one[:-1]) | (two[1:] != two[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(one[new].view(np.int64)), pa.array(two[new].view(np.int64)), pa.array(ints(part.column("i"))[own[new]])], names=["h1", "h2", "doc"])

    return docs.filter(docs[id_col].isNotNull()).select(docs[id_col].cast("long").alias("i"), docs[text_col].alias("t")).mapInArrow(run, "h1 long, h2 long, doc long")


def line_index(lines: DataFrame) -> tuple[DataFrame, int]:
    """((shard, blob, hashes) of the keys found in two rows or more, number of shards); ``hashes`` is how many rows have
    a key of the shard's arrays."""
    keys = materialize(lines.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.max("doc").alias("owner")).filter("n > 1"), "keys")
    shards = min(SHARDS, max(1, -(-keys.count() // SHARD_KEYS)))

    def one(batch):
        import numpy as np
        import pandas as pd

        u = lambda c: batch[c].to_numpy(np.int64).view(np.uint64)
        return pd.DataFrame({"shard": batch["shard"].iloc[:1], "blob": [pack(u("h1"), u("h2"), batch["n"].to_numpy(), batch["owner"].to_numpy(np.int64))], "hashes": [batch["n"].sum()]})

    packed = keys.withColumn("shard", F.pmod("h1", F.lit(shards)).cast("int")).groupBy("shard").applyInPandas(one, "shard int, blob binary, hashes long")
    return materialize(packed, "index"), shards


def routed(lines: DataFrame, index: DataFrame, shards: int, documents: int) -> DataFrame:
    """(doc, h1s, h2s): the keys of the lines that each document loses, by probes that are sent to the shards."""
    spark = lines.sparkSession
    # Hashes of one row only fall on all shards alike; their number a shard is not known, that of all rows is.
    alike = -(-lines.count() // shards)
    salts = index.select("shard", F.ceil((F.col("hashes") + alike) / PROBES).cast("int").alias("salts"))
    no = F.lit(0).cast("long")
    sent = index.join(salts, "shard").select("shard", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("kind"), "blob", no.alias("h1"), no.alias("h2"), no.alias("doc"))
    probes = lines.withColumn("shard", F.pmod("h1", F.lit(shards)).cast("int")).join(F.broadcast(salts), "shard")  # SHARDS rows at most
    probes = probes.select("shard", F.pmod(F.xxhash64("doc"), F.col("salts")).cast("int").alias("salt"), F.lit(1).alias("kind"), F.lit(None).cast("binary").alias("blob"), "h1", "h2", "doc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        release_model()
        at, shard = None, None
        for batch in batches:
            place = ints(batch.column("shard")) << 32 | ints(batch.column("salt"))
            kind = ints(batch.column("kind"))
            cuts = np.flatnonzero((place[1:] != place[:-1]) | (kind[1:] != kind[:-1])) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(place)]):
                if a == b:
                    continue
                if kind[a] == 0:
                    at, shard = int(place[a]), Shard(batch.column("blob")[a].as_py())
                    continue
                if place[a] != at:
                    continue
                cut = batch.slice(a, b - a)
                one, two, doc = (ints(cut.column(c)) for c in ("h1", "h2", "doc"))
                lose = lost(shard, one.view(np.uint64), two.view(np.uint64), doc, documents)
                yield pa.RecordBatch.from_arrays([pa.array(doc[lose]), pa.array(one[lose]), pa.array(two[lose])], names=["doc", "h1", "h2"])

    hits = sent.unionByName(probes).repartition(task_count(spark), "shard", "salt").sortWithinPartitions("shard", "salt", "kind").mapInArrow(run, "doc long, h1 long, h2 long")
    return hits.distinct().groupBy("doc").agg(F.collect_list(F.struct("h1", "h2")).alias("keys")).select("doc", F.col("keys.h1").alias("h1s"), F.col("keys.h2").alias("h2s"))


def lost(shard: Shard, one, two, doc, documents: int):
    """Which probes find a line of so many documents that is owned by another one."""
    import numpy as np

    found = shard.probe(one, two)
    at = np.flatnonzero(found >= 0)
    number = found[at]
    return at[(shard.counts[number] >= documents) & (shard.owners[number] != doc[at])]


class Index:
    """All shards of an index."""

    def __init__(self, blobs: list[tuple[int, bytes]], shards: int):
        self.shards, self.of = shards, {k: Shard(blob) for k, blob in blobs}

    def lost(self, one, two, doc, documents: int):
        import numpy as np

        at = (one.view(np.int64) % self.shards).astype(np.int64)
        order = np.argsort(at, kind="stable")
        cuts = np.searchsorted(at[order], np.arange(self.shards + 1)).tolist()
        out = [np.zeros(0, np.int64)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            if a < b and k in self.of:
                own = order[a:b]
                out.append(own[lost(self.of[k], one[own], two[own], doc[own], documents)])
        return np.concatenate(out)


def without(text: pa.Array, raw, start, end, first, of, gone) -> pa.Array:
    """The texts less the lines whose numbers are in ``gone``."""
    import numpy as np

    kept = np.ones(len(start), bool)
    kept[gone] = False
    data, out = raw.tobytes(), text.to_pylist()
    for k in np.unique(of[gone]).tolist():
        own = slice(first[k], first[k + 1])
        out[k] = b"\n".join([data[a:b] for a, b, keep in zip(start[own].tolist(), end[own].tolist(), kept[own].tolist()) if keep]).decode("utf-8")
    return pa.array(out, text.type)


def drop_lines(docs: DataFrame, least: int = 20, documents: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the text less its repeated lines, and then the columns n_lines and n_dropped (which replace any
    of these names).  A line is repeated if it is in ``documents`` rows, two at least."""
    if documents < 2:
        raise ValueError("a line repeats in two documents at least")
    docs = docs.drop("n_lines", "n_dropped")
    names = docs.columns
    spark, text_at = docs.sparkSession, names.index(text_col)
    index, shards = line_index(line_hashes(docs, least, id_col, text_col))
    size = index.agg(F.sum(F.octet_length("blob"))).first()[0] or 0
    given = docs.select(*[docs[c].alias(f"c{k}") for k, c in enumerate(names)], docs[id_col].cast("long").alias("doc"))
    sent, key = None, ("lines", uuid.uuid4().hex)
    if size <= INDEX_BYTES:
        sent = spark.sparkContext.broadcast([(r.shard, bytes(r.blob)) for r in index.select("shard", "blob").toLocalIterator()])
    else:
        drops = routed(materialize(line_hashes(docs, least, id_col, text_col), "lines"), index, shards, documents)
        given = given.join(drops.withColumnRenamed("doc", "loser"), F.col("doc") == F.col("loser"), "left").drop("loser")

    def probed(part, one, two, of):
        index = worker_model(key, lambda: Index(sent.value, shards))  # unpacked once in each worker
        return index.lost(one, two, ints(part.column("doc"))[of], documents)

    def listed(part, one, two, of):
        """The same from the lists that came with the rows."""
        import numpy as np

        from grafloom.llm.hashing import mix

        h1s, h2s = part.column("h1s"), part.column("h2s")
        if h1s.null_count == part.num_rows:
            return np.zeros(0, np.int64)
        lists = np.array([len(x) if x.is_valid else 0 for x in h1s])
        owner = np.repeat(np.arange(part.num_rows), lists)
        d1, d2 = (c.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) for c in (h1s, h2s))
        ours, theirs = mix(one + mix(of.astype(np.uint64))), mix(d1 + mix(owner.astype(np.uint64)))
        order = np.argsort(theirs)
        theirs, d2, owner = theirs[order], d2[order], owner[order]
        at = np.minimum(np.searchsorted(theirs, ours), len(theirs) - 1)
        return np.flatnonzero((theirs[at] == ours) & (d2[at] == two) & (owner[at] == of))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        if sent is None:
            release_model()
        for part in steps(batches, f"c{text_at}"):
            text = part.column(text_at)
            raw, offsets = flat(text)
            start, end, of, first = split_lines(raw, offsets)
            some, one, two = line_keys(raw, start, end, least)
            named = np.flatnonzero(part.column("doc").is_valid().to_numpy(zero_copy_only=False)[of[some]])
            some, one, two = some[named], one[named], two[named]
            gone = some[(listed if sent is None else probed)(part, one, two, of[some])]
            if len(gone):
                text = without(text, raw, start, end, first, of, gone)
            columns = [text if k == text_at else part.column(k) for k in range(len(names))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(np.diff(first)), pa.array(np.bincount(of[gone], minlength=part.num_rows))], names=[*(f"c{k}" for k in range(len(names))), "n_lines", "n_dropped"])

    kinds = ", ".join(f"c{k} {docs.schema[c].dataType.simpleString()}" for k, c in enumerate(names))
    return given.mapInArrow(run, f"{kinds}, n_lines long, n_dropped long").toDF(*names, "n_lines", "n_dropped")
