"""Operator 10: passages of a benchmark in documents, by a prefix-filtered set join.

A window is ``size`` consecutive words of an item (an item of fewer words is one window).  A document holds the window
exactly if it holds all its shingles in place, so the necessary prefix of a window's shingles, ordered by rarity, is
its rarest one.  Rarity is the number of occurrences in all documents, counted in a first pass.  In the second pass the
documents' shingles meet the windows' prefixes; the offset of the prefix in its window bounds where the window may
begin (positional bound), the document's ends bound it further (length bound), and what is left is verified: the hashes
of all words in place, then their bytes.

A benchmark of ``BLOCK_BYTES`` of text at most is sent to the executors as it is, and the documents stay where they are.
A larger one is joined: a bitmap of fixed size tells which of the documents' shingles may be in the benchmark, these are
exchanged and counted, and meet the prefixes; only texts with candidates are exchanged, by their digest, and each is
verified with its candidates.  Nothing of the benchmark passes the driver then.

Cases: a null or empty text has no words and no hits; items without words or with a null id are left out; repeated rows
give a row each, repeated items count once by their id; other columns are not read, or kept by ``without_leaks``; an
empty table of documents gives an empty result, and with an empty benchmark nothing is hit.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grafloom.llm.shared import flat, materialize, parted, release_model, steps

#: Text of a benchmark that is sent whole.
BLOCK_BYTES = 8 << 20
#: Words in a shingle; shorter windows are one shingle.
SHINGLE = 3
#: Bits of the sketch of a larger benchmark's shingles.
BITS = 1 << 26


def words_of(raw, offsets):
    from grafloom.llm.hashing import LETTERS, Words

    return Words(raw, offsets, LETTERS, True)


def equal_words(words, a, block, b, size):
    """Which of the runs of ``size`` words from a in ``words`` and from b in ``block`` are byte for byte the same."""
    import numpy as np

    from grafloom.llm.hashing import ragged

    one, two = ragged(a, size), ragged(b, size)
    of = np.repeat(np.arange(len(a)), size)
    n = words.end[one] - words.start[one]
    same = n == block.end[two] - block.start[two]
    ok = np.bincount(of[~same], minlength=len(a)) == 0
    pick = ok[of]
    one, two, of, n = one[pick], two[pick], of[pick], n[pick]
    wrong = words.data[ragged(words.start[one], n)] != block.data[ragged(block.start[two], n)]
    return ok & (np.bincount(np.repeat(of, n)[wrong], minlength=len(a)) == 0)


class Windows:
    """The windows of a benchmark as arrays: its words, and of each window the first word, length and item."""

    def __init__(self, items: list[tuple[str, str]], size: int):
        import numpy as np

        from grafloom.llm.hashing import ragged

        self.ids = [i for i, _ in items]
        raws = [t.encode("utf-8") for _, t in items]
        self.words = words_of(np.frombuffer(b"".join(raws), np.uint8), np.cumsum([0, *map(len, raws)]))
        self.values, n = self.words.hashes(), np.diff(self.words.first)
        many = np.where(n > 0, np.maximum(n - size + 1, 1), 0)
        self.at = ragged(self.words.first[:-1], many)
        self.item = np.repeat(np.arange(len(items)), many)
        self.size = np.minimum(n, size)[self.item]
        self.gram = np.minimum(self.size, SHINGLE)
        # The shingle at each word, if it does not run over its item's end; its length is that of its item's shingles.
        per_word = np.minimum(n, SHINGLE)[self.words.doc]
        self.key = np.zeros(len(self.values), np.uint64)
        self.has = np.zeros(len(self.values), bool)
        self.gram_of = per_word
        for g in np.unique(per_word).tolist():
            at, h = self.words.windows(self.values, g)
            on = per_word[at] == g
            self.key[at[on]], self.has[at[on]] = h[on], True

    def wanted(self) -> list:
        """(length, sorted distinct hashes) of all shingles."""
        import numpy as np

        return [(g, np.unique(self.key[self.has & (self.gram_of == g)])) for g in np.unique(self.gram_of[self.has]).tolist()]

    def choose(self, counts: dict) -> None:
        """Keeps the rarest shingle of each window as its prefix; ``counts`` has, by length, hashes and numbers."""
        import numpy as np

        n = np.zeros(len(self.key), np.int64)
        for g, (keys, numbers) in counts.items():
            on = np.flatnonzero(self.has & (self.gram_of == g))
            place = np.minimum(np.searchsorted(keys, self.key[on]), max(len(keys) - 1, 0))
            if len(keys):
                n[on] = np.where(keys[place] == self.key[on], numbers[place], 0)
        best, where = np.full(len(self.at), np.iinfo(np.int64).max), self.at.copy()
        for k in range(int((self.size - self.gram).max(initial=-1)) + 1):
            on = np.flatnonzero(k <= self.size - self.gram)
            less = n[self.at[on] + k] < best[on]
            on = on[less]
            best[on], where[on] = n[self.at[on] + k], self.at[on] + k
        self.prefix = {}
        for g in np.unique(self.gram).tolist():
            # A window of which a shingle occurs nowhere cannot occur.
            on = np.flatnonzero((best > 0) & (self.gram == g))
            on = on[np.argsort(self.key[where[on]], kind="stable")]
            self.prefix[g] = (self.key[where[on]], on, where[on] - self.at[on])


def items_of(benchmark: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return benchmark.select(benchmark[id_col].cast("string").alias("i"), benchmark[text_col].alias("t")).filter("i is not null and t is not null")


def counted(docs: DataFrame, wanted: list) -> dict:
    """How often each wanted shingle occurs in all documents: by length, sorted hashes and numbers."""
    import numpy as np

    sent = docs.sparkSession.sparkContext.broadcast(wanted)  # of a benchmark whose size was checked

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_model()
        keys = sent.value
        sums = {g: np.zeros(len(k), np.int64) for g, k in keys}
        for part in steps(batches, "t"):
            words = words_of(*flat(part.column("t")))
            values = words.hashes()
            for g, known in keys:
                _, h = words.windows(values, g)
                at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                sums[g] += np.bincount(at[known[at] == h], minlength=len(known))
        for g, known in keys:
            on = np.flatnonzero(sums[g])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(on), g, np.int32)), pa.array(known[on].view(np.int64)), pa.array(sums[g][on])], names=["g", "h", "n"])

    found = docs.select("t").mapInArrow(run, "g int, h long, n long").groupBy("g", "h").agg(F.sum("n").alias("n")).toArrow()
    sent.unpersist()
    g, h, n = (found.column(c).to_numpy() for c in ("g", "h", "n"))
    out = {}
    for k in np.unique(g).tolist():
        keys, numbers = h[g == k].astype(np.int64).view(np.uint64), n[g == k]
        order = np.argsort(keys)
        out[k] = (keys[order], numbers[order])
    return out


def find(words, values, block: Windows):
    """(first word, window) of all occurrences of the block's windows in a batch."""
    import numpy as np

    from grafloom.llm.hashing import ragged

    starts, windows = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for g, (keys, window, offset) in block.prefix.items():
        if not len(keys):
            continue
        at, h = words.windows(values, g)
        lo = np.searchsorted(keys, h)
        near = np.flatnonzero((lo < len(keys)) & (keys[np.minimum(lo, len(keys) - 1)] == h))
        lo = lo[near]
        many = np.searchsorted(keys, h[near], "right") - lo
        pick = ragged(lo, many)
        place = np.repeat(at[near], many)
        start, w = place - offset[pick], window[pick]
        d = words.doc[place]
        ok = (start >= words.first[d]) & (start + block.size[w] <= words.first[d + 1])
        start, w = start[ok], w[ok]
        for k in range(int(block.size[w].max(initial=0))):
            on = k < block.size[w]
            ok = np.ones(len(start), bool)
            ok[on] = values[start[on] + k] == block.values[block.at[w[on]] + k]
            start, w = start[ok], w[ok]
        ok = equal_words(words, start, block.words, block.at[w], block.size[w])
        starts.append(start[ok])
        windows.append(w[ok])
    return np.concatenate(starts), np.concatenate(windows)


def hits(raw, offsets, block: Windows):
    """(words, hit words, ids of the items) of each text."""
    import numpy as np

    words = words_of(raw, offsets)
    n = len(offsets) - 1
    start, w = find(words, words.hashes(), block)
    items: list[set[str]] = [set() for _ in range(n)]
    for d, i in set(zip(words.doc[start].tolist(), block.item[w].tolist())):
        items[d].add(block.ids[i])
    return np.diff(words.first), covered(words, start, block.size[w], n), [sorted(x) for x in items]


def covered(words, start, size, texts: int):
    """How many words of each text lie in the runs."""
    import numpy as np

    change = np.zeros(len(words.doc) + 1, np.int64)
    np.add.at(change, start, 1)
    np.add.at(change, start + size, -1)
    return np.bincount(words.doc[np.cumsum(change[:-1]) > 0], minlength=texts)


def digests(words):
    """Two hashes of each text's words; texts of equal words have equal hits."""
    from grafloom.llm.hashing import Sums

    a, b = words.first[:-1], words.first[1:]
    return Sums(words.hashes(0), 0).of(a, b), Sums(words.hashes(1), 1).of(a, b)


# A benchmark that is joined.


def benchmark_windows(items: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """(shingles, windows): (k, p, g, h) of each shingle of each item, and (k, i, w, size, g, words), the words of a window
    as one blob with a zero byte between them; k tells texts of one item id apart."""
    items = items.select("i", "t", F.concat_ws(":", F.md5("t"), "i").alias("k")).dropDuplicates(["k"])

    def of_shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        release_model()
        for part in steps(batches, "t"):
            block = Windows(list(zip(part.column("i").to_pylist(), part.column("t").to_pylist())), size)
            at = np.flatnonzero(block.has)
            d = block.words.doc[at]
            yield pa.RecordBatch.from_arrays([part.column("k").take(pa.array(d)), pa.array(at - block.words.first[d]), pa.array(block.gram_of[at].astype(np.int32)), pa.array(block.key[at].view(np.int64))], names=["k", "p", "g", "h"])

    def of_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        release_model()
        for part in steps(batches, "t"):
            block = Windows(list(zip(part.column("i").to_pylist(), part.column("t").to_pylist())), size)
            raw, w = block.words.data.tobytes(), block.words
            words = [b"\0".join(raw[a:b] for a, b in zip(w.start[x : x + n].tolist(), w.end[x : x + n].tolist())) for x, n in zip(block.at.tolist(), block.size.tolist())]
            yield pa.RecordBatch.from_arrays([part.column("k").take(pa.array(block.item)), part.column("i").take(pa.array(block.item)), pa.array(block.at - w.first[block.item]), pa.array(block.size), pa.array(block.gram.astype(np.int32)), pa.array(words, pa.binary())], names=["k", "i", "w", "size", "g", "words"])

    items = materialize(items, "items")
    return materialize(items.mapInArrow(of_shingles, "k string, p long, g int, h long"), "shingles"), materialize(items.mapInArrow(of_windows, "k string, i string, w long, size long, g int, words binary"), "windows")


def may_be_in(docs: DataFrame, shingles: DataFrame) -> DataFrame:
    """(d1, d2, p, g, h): the documents' shingles that the benchmark may have, by a bitmap of their hashes."""
    import numpy as np

    # Hashes are scrambled, so their upper bits are as good as another hash of them.
    marked = shingles.select(F.shiftright("h", 38).bitwiseAND(BITS - 1).alias("p"))
    rows = marked.groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("b")).toArrow()
    bits = np.zeros(BITS // 64, np.int64)
    bits[rows.column("w").to_numpy()] = rows.column("b").to_numpy()
    lengths = [r.g for r in shingles.select("g").distinct().collect()]  # SHINGLE values at most
    sent = docs.sparkSession.sparkContext.broadcast(bits)  # BITS bits, whatever the benchmark

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_model()
        marks = sent.value
        for part in steps(batches, "t"):
            words = words_of(*flat(part.column("t")))
            one, two = digests(words)
            values = words.hashes()
            for g in lengths:
                at, h = words.windows(values, g)
                p = (h.view(np.int64) >> 38) & (BITS - 1)
                on = np.flatnonzero((marks[p >> 6] >> (p & 63)) & 1)
                at, h = at[on], h[on]
                d = words.doc[at]
                yield pa.RecordBatch.from_arrays([pa.array(one[d].view(np.int64)), pa.array(two[d].view(np.int64)), pa.array(at - words.first[d]), pa.array(np.full(len(at), g, np.int32)), pa.array(h.view(np.int64))], names=["d1", "d2", "p", "g", "h"])

    return docs.select("t").mapInArrow(run, "d1 long, d2 long, p long, g int, h long")


def candidates(docs: DataFrame, items: DataFrame, size: int) -> DataFrame:
    """(d1, d2, found): of each text with candidates, by its digest, where which windows of which items may begin."""
    shingles, windows = benchmark_windows(items, size)
    near = materialize(may_be_in(docs, shingles).join(shingles.select("g", "h").distinct(), ["g", "h"], "left_semi"), "near")
    # Occurrences in all documents; what is in many of them is counted with partial sums.
    counts = near.groupBy("g", "h").agg(F.count(F.lit(1)).alias("n"))
    held = shingles.join(counts, ["g", "h"], "left").select("k", "p", "g", "h", F.coalesce("n", F.lit(0)).alias("n"))
    # A shingle is in the windows that begin up to size - g words before it.
    inside = held.select("k", F.explode(F.sequence(F.greatest(F.col("p") - F.lit(size) + F.col("g"), F.lit(0).cast("long")), F.col("p"))).alias("w"), "p", "g", "h", "n")
    rarest = windows.join(inside.select("k", "w", F.struct("n", "p", "h").alias("x")), ["k", "w"]).groupBy("k", "i", "w", "size", "g", "words").agg(F.min("x").alias("x")).filter("x.n > 0")
    prefixes = rarest.select("i", "size", "g", "words", F.col("x.h").alias("h"), (F.col("x.p") - F.col("w")).alias("offset"))
    met = near.join(prefixes, ["g", "h"]).select("d1", "d2", (F.col("p") - F.col("offset")).alias("start"), "i", "size", "words").filter("start >= 0").distinct()
    return materialize(met.groupBy("d1", "d2").agg(F.collect_list(F.struct("start", "size", "i", "words")).alias("found")), "candidates")


def with_digest(docs: DataFrame, text: str) -> DataFrame:
    """``docs`` with the columns d1 and d2."""
    names = docs.columns
    at = names.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        release_model()
        for part in steps(batches, text):
            one, two = digests(words_of(*flat(part.column(at))))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(one.view(np.int64)), pa.array(two.view(np.int64))], names=[*names, "d1", "d2"])

    kinds = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in docs.columns)
    return docs.mapInArrow(run, f"{kinds}, d1 long, d2 long")


def verified(words, found: pa.Array):
    """(first word, size, item) of the candidates that are there, for the texts of a batch and the list of each."""
    starts, sizes, items = [], [], []
    raw = words.data.tobytes()
    for d, own in enumerate(found.to_pylist()):
        first, n = int(words.first[d]), int(words.first[d + 1] - words.first[d])
        for c in own or ():
            a = first + c["start"]
            if c["start"] + c["size"] <= n and b"\0".join(raw[x:y] for x, y in zip(words.start[a : a + c["size"]].tolist(), words.end[a : a + c["size"]].tolist())) == c["words"]:
                starts.append(a)
                sizes.append(c["size"])
                items.append((d, c["i"]))
    return starts, sizes, items


def joined(docs: DataFrame, items: DataFrame, size: int, text: str) -> DataFrame:
    """``docs`` (columns c0, c1, ...) with their candidates in ``found``, null for most."""
    near = candidates(docs.select(F.col(text).alias("t")), items, size)
    some, others = parted(with_digest(docs, text), "d1", near.select("d1"))
    both = some.join(near, ["d1", "d2"], "left").select(*docs.columns, "found")
    return both.unionByName(others.select(*docs.columns, F.lit(None).cast(near.schema["found"].dataType).alias("found")))


def small_block(benchmark: DataFrame, docs: DataFrame, size: int, id_col: str, text_col: str):
    """The benchmark with its prefixes chosen as a broadcast, or none if it is too large for that."""
    items = items_of(benchmark, id_col, text_col)
    if (items.agg(F.sum(F.octet_length("t"))).first()[0] or 0) > BLOCK_BYTES:
        return None
    block = Windows([(r.i, r.t) for r in items.toLocalIterator()], size)
    block.choose(counted(docs, block.wanted()) if len(block.at) else {})
    return docs.sparkSession.sparkContext.broadcast(block)


def results(part: pa.RecordBatch, text: int, sent, found: str):
    """(words, hit words, ids of the items) of the rows of a batch."""
    import numpy as np

    if sent is not None:
        return hits(*flat(part.column(text)), sent.value)
    words = words_of(*flat(part.column(text)))
    starts, sizes, named = verified(words, part.column(found))
    items: list[set[str]] = [set() for _ in range(part.num_rows)]
    for d, i in named:
        items[d].add(i)
    return np.diff(words.first), covered(words, np.array(starts, np.int64), np.array(sizes, np.int64), part.num_rows), [sorted(x) for x in items]


def leaks(docs: DataFrame, benchmark: DataFrame, size: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(id, n_words, n_hit, items array<string>) of each row."""
    source = docs.select(docs[id_col].alias("c0"), docs[text_col].alias("c1"))
    sent = small_block(benchmark, source.select(F.col("c1").alias("t")), size, item_col, item_text)
    rows = source if sent is not None else joined(source, items_of(benchmark, item_col, item_text), size, "c1")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_model()
        for part in steps(batches, "c1"):
            n, hit, items = results(part, 1, sent, "found")
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n), pa.array(hit), pa.array(items, pa.list_(pa.string()))], names=[id_col, "n_words", "n_hit", "items"])

    kind = docs.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(run, f"`{id_col}` {kind}, n_words long, n_hit long, items array<string>")


def without_leaks(docs: DataFrame, benchmark: DataFrame, size: int = 10, text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of ``docs`` in which no window of the benchmark occurs."""
    at = docs.columns.index(text_col)
    many = len(docs.columns)
    named = docs.toDF(*[f"c{k}" for k in range(many)])
    sent = small_block(benchmark, named.select(F.col(f"c{at}").alias("t")), size, item_col, item_text)
    rows = named if sent is not None else joined(named, items_of(benchmark, item_col, item_text), size, f"c{at}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_model()
        for part in steps(batches, f"c{at}"):
            _, hit, _ = results(part, at, sent, "found")
            yield part.select(list(range(many))).filter(pa.array(hit == 0))

    return rows.mapInArrow(run, named.schema).toDF(*docs.columns)
