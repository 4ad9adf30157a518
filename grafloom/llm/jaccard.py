"""Operator 3: n-gram Jaccard join by chosen paths.

Sets are the distinct shingles of five consecutive words (words as in operator 10, A-Z lower-cased; a shorter text is
one shingle).

1. Texts of equal words form a class; its least id stands for it.  Each class is embedded as ``SKETCH`` min-hash
   tokens, of which two sets share a part close to their Jaccard similarity.
2. A run splits all sets on sampled tokens: each split draws 1 / threshold token positions on average (that number
   rounded down or up, so that no split draws none), and a set goes to the bucket (position, its token) of each.  In a
   bucket of more than ``SMALL`` sets all are compared with a few hubs, and those near the best hub are linked to it, so
   they need not meet each other.  With up to ``SMALL`` others the bucket is done once these have met all its sets;
   other buckets are split again, by positions sampled anew for each, up to ``LEVELS`` times, and what is still large
   then has its others meet all its sets in blocks.  As many runs are made as the
   target recall needs where all buckets of a pair lie ``LEVELS`` splits deep, whatever tokens its sketches agree in.
3. Buckets are brute-forced on the sketches, with a margin below the threshold that the recall accounts for; of the
   pairs found, a bucket gives out a spanning forest only.  Components of these are groups of candidates.
4. Within each group, all pairs are verified on the exact sets, in pairs of blocks where the group is large: each set
   gets its number of links, and links form the final classes.  Pairs are counted, never written out.  A set is copied to
   ``SPREAD`` cells at most, while blocks hold up to ``MOST`` sets; a cell is worked through by tiles of ``BLOCK`` sets.

Nothing is capped: large buckets and groups are cut into pairs of blocks, which different tasks take.

Cases: null and empty texts and rows with a null id are linked to nothing and are a class of their own; repeated rows
count as copies; rows that share an id are taken as one document with several texts; other columns are not read; an
empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grafloom.llm.components import components
from grafloom.llm.shared import flat, ints, materialize, release_model, steps, task_count

SHINGLE = 5
SKETCH = 64
#: Sets in a bucket that is brute-forced as it is; times that larger ones are split.
SMALL = 512
LEVELS = 4
#: Sets of a larger bucket with which all its sets are compared.
HUBS = 4
#: Sets of a group that are compared at once; blocks that a group is cut into, while these do not get too large.
BLOCK = 256
SPREAD = 64
MOST = 1 << 14


def agreement(threshold: float) -> list[float]:
    """The chance that sketches of a pair at the threshold agree in 0, 1, ... ``SKETCH`` tokens."""
    return [math.comb(SKETCH, x) * threshold**x * (1 - threshold) ** (SKETCH - x) for x in range(SKETCH + 1)]


def least_agreement(threshold: float, recall: float) -> int:
    """Equal tokens that make candidates; a quarter of what ``recall`` may miss has fewer at the threshold."""
    missed, least = 0.0, 0
    for x, chance in enumerate(agreement(threshold)):
        missed += chance
        if missed > (1 - recall) / 4:
            break
        least = x + 1
    return least


def sampled(threshold: float) -> tuple[int, float]:
    """Token positions that each split samples at least, and the chance of one more: 1 / threshold on average."""
    least = min(int(1 / threshold), SKETCH - 1)
    return least, min(1 / threshold - least, 1.0)


def chosen_at(above, threshold: float):
    """(path, position): whether a split of each path in ``above`` samples each token position; and the positions'
    hashes."""
    import numpy as np

    from grafloom.llm.hashing import mix

    places = mix(np.arange(1, SKETCH + 1, dtype=np.uint64) + np.uint64(0xA5A5A5A5 << 16))
    least, more = sampled(threshold)
    drawn = mix(above[:, None] ^ places[None, :])
    lowest = np.partition(drawn, (least - 1, least), axis=1)
    one_more = (mix(above ^ np.uint64(0x5A5A5A5A << 16)) >> np.uint64(11)) * 2.0**-53 < more
    return drawn <= np.where(one_more, lowest[:, least], lowest[:, least - 1])[:, None], places


def survival(x: int, p: float, threshold: float) -> float:
    """The chance that a pair whose sketches agree in ``x`` tokens survives a split, if it does each bucket below with
    chance ``p``."""
    least, more = sampled(threshold)
    out = 0.0
    for n, share in ((least, 1 - more), (least + 1, more)):
        lost = sum(math.comb(x, j) * math.comb(SKETCH - x, n - j) * (1 - p) ** j for j in range(n + 1))
        out += share * (1 - lost / math.comb(SKETCH, n))
    return out


def roots(runs: int):
    """The path that each run starts from."""
    import numpy as np

    from grafloom.llm.hashing import mix

    return mix(np.arange(1, runs + 1, dtype=np.uint64))


def missed_share(threshold: float, recall: float, runs: int, depth: int) -> float:
    """The chance that a pair at the threshold is no candidate after ``runs`` runs, if all its buckets lie ``depth``
    splits deep: over all numbers of tokens that its sketches may agree in, and for the positions that the runs do
    sample at their roots (which are the same for all pairs)."""
    import numpy as np

    times = chosen_at(roots(runs), threshold)[0].sum(axis=0)
    least = least_agreement(threshold, recall)
    missed = 0.0
    for x, chance in enumerate(agreement(threshold)):
        if x < least:
            missed += chance
            continue
        p = 1.0
        for _ in range(depth - 1):
            p = survival(x, p, threshold)
        # The mean of the products over all x of the positions, by the elementary symmetric sums.
        sums = np.zeros(SKETCH + 1)
        sums[0] = 1
        for fails in (1 - p) ** times:
            sums[1:] += sums[:-1] * fails
        missed += chance * sums[x] / math.comb(SKETCH, x)
    return missed


def runs_for(threshold: float, recall: float, depth: int | None = None) -> int:
    """Runs after which a pair at the threshold is a candidate with probability ``recall``, if its buckets lie
    ``depth`` splits deep; as deep as they get, if not given.  Pairs in shallower buckets are missed less."""
    if not recall < 1 or agreement(threshold)[0] > (1 - recall) / 4:
        raise ValueError(f"sketches of {SKETCH} tokens do not reach recall {recall} at threshold {threshold}")
    runs = 1
    while missed_share(threshold, recall, runs, depth or LEVELS) > 1 - recall:
        runs += 1
    return runs


def shingles(part, text="t"):
    """(hash of each shingle, number of its text, two hashes of each text's words, number of words)."""
    import numpy as np

    from grafloom.llm.hashing import LETTERS, Sums, Words

    words = Words(*flat(part.column(text)), LETTERS, True)
    one, n = words.hashes(0), np.diff(words.first)
    at, h = words.windows(one, SHINGLE)
    owner = words.doc[at]
    sums = Sums(one, 0)
    whole = sums.of(words.first[:-1], words.first[1:])
    other = Sums(words.hashes(1), 1).of(words.first[:-1], words.first[1:])
    short = np.flatnonzero((n > 0) & (n < SHINGLE))
    if len(short):
        owner, h = np.concatenate([owner, short]), np.concatenate([h, whole[short]])
        order = np.argsort(owner, kind="stable")
        owner, h = owner[order], h[order]
    return h, owner, whole, other, n


def seeds():
    import numpy as np

    from grafloom.llm.hashing import mix

    base = mix(np.arange(1, 2 * SKETCH + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return base[:SKETCH], base[SKETCH:] | np.uint64(1)


def sketches(docs: DataFrame) -> DataFrame:
    """(doc, s1, s2, sketch) of each row of (i, t); the last three are null if the text has no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        release_model()
        flips, factors = seeds()
        for part in steps(batches, "t"):
            h, owner, one, two, n = shingles(part)
            some = np.flatnonzero(n > 0)
            table = np.empty((len(some), SKETCH), np.uint32)
            if len(some):
                heads = np.searchsorted(owner, some)
                for k in range(SKETCH):
                    table[:, k] = np.minimum.reduceat(((h ^ flips[k]) * factors[k]) >> np.uint64(32), heads)
            blobs: list[bytes | None] = [None] * part.num_rows
            for k, row in zip(some.tolist(), table):
                blobs[k] = row.tobytes()
            none = n == 0
            yield pa.RecordBatch.from_arrays([part.column("i"), pa.array(one.view(np.int64), mask=none), pa.array(two.view(np.int64), mask=none), pa.array(blobs, pa.binary())], names=["doc", "s1", "s2", "sketch"])

    return docs.mapInArrow(run, "doc long, s1 long, s2 long, sketch binary")


def split(sets: DataFrame, threshold: float, runs: int) -> DataFrame:
    """(path, rep): the buckets one split below; ``sets`` has (path, rep, sketch), or (rep, sketch) for the root of
    all runs."""
    root = "path" not in sets.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        from grafloom.llm.hashing import mix

        release_model()
        for batch in batches:
            rep = ints(batch.column("rep"))
            table = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint32).reshape(-1, SKETCH)
            for r in range(runs if root else 1):
                above = roots(runs)[r : r + 1] if root else ints(batch.column("path")).view(np.uint64)
                chosen, places = chosen_at(above, threshold)
                if root:
                    chosen = np.broadcast_to(chosen, table.shape)
                    above = np.broadcast_to(above, len(rep))
                row, place = np.nonzero(chosen)
                path = mix(mix(above[row] + places[place]) ^ table[row, place].astype(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(path.view(np.int64)), pa.array(rep[row])], names=["path", "rep"])

    return sets.mapInArrow(run, "path long, rep long")


def groups(batches: Iterator[pa.RecordBatch], *keys: str) -> Iterator[pa.Table]:
    """Tables of whole groups of equal keys from sorted batches; what may go on is held back."""
    import numpy as np

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        new = np.zeros(batch.num_rows, bool)
        for k in keys:
            x = ints(batch.column(k))
            new[1:] |= x[1:] != x[:-1]
            if held:
                new[0] |= x[0] != held[-1].column(k)[-1].as_py()
        cuts = np.flatnonzero(new)
        if held and len(cuts):
            yield pa.Table.from_batches([*held, batch.slice(0, cuts[0])] if cuts[0] else held)
            held, batch, cuts = [], batch.slice(cuts[0]), cuts - cuts[0]
        if len(cuts) and cuts[-1]:
            yield pa.Table.from_batches([batch.slice(0, cuts[-1])])
            batch = batch.slice(cuts[-1])
        held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def bounds_of(table: pa.Table, *keys: str):
    import numpy as np

    new = np.ones(table.num_rows, bool)
    new[1:] = False
    for k in keys:
        x = ints(table.column(k).combine_chunks())
        new[1:] |= x[1:] != x[:-1]
    return np.append(np.flatnonzero(new), table.num_rows)


def rooted(near):
    """The least row that each row of a symmetric boolean matrix is connected with."""
    import numpy as np

    n = len(near)
    label = np.full(n, -1)
    for k in range(n):
        if label[k] >= 0:
            continue
        label[k] = k
        front = np.array([k])
        while len(front):
            front = np.flatnonzero(near[front].any(axis=0) & (label < 0))
            label[front] = k
    return label


def forests(members: DataFrame, least_equal: int) -> DataFrame:
    """(a, b): a spanning forest of the near pairs of each bucket; ``members`` has (path, x, y, rep, bits), a bucket or
    pair of blocks being one (path, x, y)."""
    spark = members.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        from grafloom.llm.hashing import ragged

        release_model()
        for table in groups(batches, "path", "x", "y"):
            table = table.combine_chunks()
            cut = bounds_of(table, "path", "x", "y")
            size = np.diff(cut)
            rep = ints(table.column("rep").combine_chunks())
            bits = np.frombuffer(b"".join(table.column("bits").to_pylist()), np.uint8).reshape(-1, SKETCH)
            left, right = [], []
            few = np.flatnonzero((size > 1) & (size <= 24))
            rows = ragged(cut[few], size[few])
            follow = np.repeat(cut[few] + size[few], size[few]) - rows - 1
            for at in range(0, len(rows), 4096):
                r, f = rows[at : at + 4096], follow[at : at + 4096]
                a, b = np.repeat(r, f), ragged(r + 1, f)
                ok = (bits[a] == bits[b]).sum(axis=1) >= least_equal
                left.append(a[ok])
                right.append(b[ok])
            for g in np.flatnonzero(size > 24).tolist():
                own = bits[cut[g] : cut[g + 1]]
                equal = np.zeros((len(own), len(own)), np.uint8)
                for k in range(SKETCH):
                    equal += own[:, None, k] == own[None, :, k]
                label = rooted(equal >= least_equal)
                on = np.flatnonzero(label != np.arange(len(own)))
                left.append(cut[g] + on)
                right.append(cut[g] + label[on])
            a, b = (rep[np.concatenate(x)] if x else np.zeros(0, np.int64) for x in (left, right))
            yield pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], names=["a", "b"])

    dealt = members.repartition(task_count(spark), "path", "x", "y").sortWithinPartitions("path", "x", "y", "rep")
    return dealt.mapInArrow(run, "a long, b long").distinct()


def in_blocks(rows: DataFrame, size_col: str, block: Column, row_col: str) -> DataFrame:
    """``rows`` with (x, y): every pair of blocks that a row's block is in; groups of up to two blocks are one."""
    many = F.when(F.col(size_col) <= 2 * block, 1).otherwise(F.ceil(F.col(size_col) / block)).cast("int")
    own = F.pmod(F.xxhash64(row_col), "many").cast("int")
    out = rows.withColumn("many", many).withColumn("own", own)
    out = out.withColumn("z", F.explode(F.when(F.col("many") == 1, F.array(F.lit(0))).otherwise(F.filter(F.sequence(F.lit(0), F.col("many") - 1), lambda k: k != F.col("own")))))
    return out.withColumn("x", F.least("own", "z")).withColumn("y", F.greatest("own", "z")).drop("z")


def hubs_of(members: DataFrame, least_equal: int, name: str = "") -> DataFrame:
    """``members`` (path, n, rep, sketch, bits), ``n`` sets a path, with the path's hub, whether the set is ``near`` it and
    how many sets of the path are not (``apart``).  The hub is that of ``HUBS`` drawn sets which most sets are near."""
    drawn = [F.min_by(F.struct("rep", "bits"), F.xxhash64("rep", "path", F.lit(k))).alias(f"h{k}") for k in range(HUBS)]
    drawn = materialize(members.groupBy("path").agg(*drawn), f"drawn{name}")
    given = members.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        release_model()
        for batch in batches:
            of = {c: np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, SKETCH) for c in ("bits", *(f"bits{k}" for k in range(HUBS)))}
            mask = np.zeros(batch.num_rows, np.int32)
            for k in range(HUBS):
                mask |= ((of["bits"] == of[f"bits{k}"]).sum(axis=1) >= least_equal).astype(np.int32) << k
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in given), pa.array(mask)], names=[*given, "mask"])

    met = members.join(drawn, "path").select(*given, *[F.col(f"h{k}.bits").alias(f"bits{k}") for k in range(HUBS)])
    met = materialize(met.mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in members.schema) + ", mask int"), f"met{name}")
    near = lambda k: F.shiftright("mask", k).bitwiseAND(1)
    many = met.groupBy("path").agg(F.count(F.lit(1)).alias("n"), *[F.sum(near(k)).alias(f"n{k}") for k in range(HUBS)])
    best = F.greatest(*[F.struct(F.col(f"n{k}").alias("n"), F.lit(1 << k).alias("bit"), F.col(f"h{k}.rep").alias("hub")) for k in range(HUBS)])
    best = many.join(drawn, "path").select("path", "n", best.alias("best"))
    best = materialize(best.select("path", "best.hub", "best.bit", (F.col("n") - F.col("best.n")).alias("apart")), f"hubs{name}")
    return met.join(best, "path").select(*given, "hub", F.expr("mask & bit <> 0").alias("near"), "apart")


def around_hubs(rows: DataFrame) -> DataFrame:
    """(path, x, y, rep, bits) of rows with hubs: cells in which the sets apart from the hub meet each other (x >= 0), and
    all those near it (x < 0)."""
    apart = in_blocks(rows.filter("not near and apart > 1"), "apart", F.lit(SMALL), "rep").select("path", "x", "y", "rep", "bits")
    cut = lambda c: F.ceil(c / SMALL).cast("int")
    place = lambda c: F.pmod(F.xxhash64("rep"), c).cast("int")
    both = rows.filter("apart between 1 and n - 1").withColumn("xs", cut(F.col("n") - F.col("apart"))).withColumn("ys", cut(F.col("apart")))
    own = F.when(F.col("near"), place(F.col("xs"))).otherwise(place(F.col("ys")))
    both = both.withColumn("own", own).withColumn("z", F.explode(F.sequence(F.lit(0), F.when(F.col("near"), F.col("ys")).otherwise(F.col("xs")) - 1)))
    x, y = F.when(F.col("near"), F.col("own")).otherwise(F.col("z")), F.when(F.col("near"), F.col("z")).otherwise(F.col("own"))
    return apart.unionByName(both.select("path", (-1 - x).alias("x"), y.alias("y"), "rep", "bits"))


def candidate_edges(reps: DataFrame, threshold: float, recall: float) -> DataFrame:
    """(a, b): forests of the near pairs of all buckets of all runs, and pairs of sets with their hubs."""
    bits = reps.select("rep", low_bytes("sketch").alias("bits"))
    runs, least_equal = runs_for(threshold, recall), least_agreement(threshold, recall)
    sets, edges = reps.select("rep", "sketch"), None
    for level in range(1, LEVELS + 1):
        paths = materialize(split(sets, threshold, runs), f"paths{level}")
        # Written, so that the join deals both sides by itself and Spark can split a path that very many sets share.
        counts = materialize(paths.groupBy("path").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), f"counts{level}")
        shared = materialize(paths.join(counts, "path"), f"shared{level}")
        ready = in_blocks(shared.filter(F.col("n") <= SMALL), "n", F.lit(SMALL), "rep").join(bits, "rep").select("path", "x", "y", "rep", "bits")
        large = shared.filter(F.col("n") > SMALL)
        more = not large.isEmpty()
        if more:
            members = large.join(reps.select("rep", "sketch", low_bytes("sketch").alias("bits")), "rep").select("path", "n", "rep", "sketch", "bits")
            large = hubs_of(materialize(members, f"large{level}"), least_equal, str(level))
            done = large if level == LEVELS else large.filter(F.col("apart") <= SMALL)
            ready = ready.unionByName(around_hubs(done))
        made = forests(ready, least_equal)
        edges = made if edges is None else edges.unionByName(made)
        if not more:
            break
        edges = edges.unionByName(done.filter("near and rep <> hub").select(F.greatest("rep", "hub").alias("a"), F.least("rep", "hub").alias("b")).distinct())
        sets = large.filter(F.col("apart") > SMALL).select("path", "rep", "sketch")
        if level == LEVELS or sets.isEmpty():
            break
    return edges


def low_bytes(column: str):
    """The lowest byte of each token of a sketch, as a binary, by cutting its hexadecimal form."""
    return F.unhex(F.regexp_replace(F.hex(column), "(..)......", "$1"))


def near_pairs(one: list, two: list, threshold: float):
    """(set of ``one``, set of ``two``): whether two sets of distinct hashes have at least the similarity."""
    import numpy as np
    import pandas as pd

    sizes = np.array([len(x) for x in one]), np.array([len(x) for x in two])
    both = np.zeros((len(one), len(two)))
    if len(one) * len(two) <= 24:
        for i, p in enumerate(one):
            for j, q in enumerate(two):
                both[i, j] = len(np.intersect1d(p, q, assume_unique=True))
    else:
        codes, uniques = pd.factorize(np.concatenate([*one, *two]))
        cut = int(sizes[0].sum())
        number = np.full(len(uniques), -1)
        common = np.intersect1d(codes[:cut], codes[cut:])  # hashes of one side only add nothing
        number[common] = np.arange(len(common))
        sides = []
        for part, size in ((codes[:cut], sizes[0]), (codes[cut:], sizes[1])):
            row, code = np.repeat(np.arange(len(size)), size), number[part]
            row, code = row[code >= 0], code[code >= 0]
            order = np.argsort(code, kind="stable")
            sides.append((row[order], code[order], len(size)))
        for c in range(0, len(common), 4096):
            dense = []
            for row, code, n in sides:
                lo, hi = np.searchsorted(code, [c, c + 4096])
                d = np.zeros((n, 4096), np.float32)
                d[row[lo:hi], code[lo:hi] - c] = 1
                dense.append(d)
            both += dense[0] @ dense[1].T
    return both >= threshold * (sizes[0][:, None] + sizes[1][None, :] - both) - 1e-9


def linked(own: list, copies, block, x: int, y: int, many: int, threshold: float):
    """(links of each set, a label that connected sets share) in the cell of blocks x and y of a group that was cut into
    ``many``.  Of the cells that hold one block, the one with its successor counts the pairs within it."""
    import numpy as np

    n = len(own)
    links, parent = np.zeros(n, np.int64), list(range(n))

    def top(k: int) -> int:
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    # Tiles lie within one block each.
    ends = np.append(np.flatnonzero(block[1:] != block[:-1]) + 1, n)
    tiles = [(a, min(a + BLOCK, stop)) for start, stop in zip(np.append(0, ends[:-1]).tolist(), ends.tolist()) for a in range(start, stop, BLOCK)]
    for i, (a, b) in enumerate(tiles):
        for c, d in tiles[i:]:
            k = int(block[a])
            if many > 1 and block[c] == k and (k + 1) % many != (y if k == x else x):
                continue
            near = near_pairs(own[a:b], own[c:d], threshold)
            if a == c:
                np.fill_diagonal(near, False)
            links[a:b] += near @ copies[c:d]
            if a != c:
                links[c:d] += copies[a:b] @ near
            row, other = np.nonzero(near)
            few = len(row) <= 4 * (b - a + d - c)
            for p, q in zip((row + a).tolist(), (other + c).tolist()) if few else spanning(near, a, c):
                p, q = top(p), top(q)
                if p != q:
                    parent[max(p, q)] = min(p, q)
    return links, np.array([top(k) for k in range(n)])


def spanning(near, a: int, c: int):
    """Pairs that connect what the pairs of a matrix (sets from a on, sets from c on) connect, a few a set."""
    import numpy as np

    n, m = near.shape
    square = np.zeros((n + m, n + m), bool)
    square[:n, n:], square[n:, :n] = near, near.T
    label = rooted(square)
    place = np.append(np.arange(n) + a, np.arange(m) + c)
    on = np.flatnonzero(label != np.arange(n + m))
    return zip(place[on].tolist(), place[label[on]].tolist())


def verified(docs: DataFrame, groups_of: DataFrame, threshold: float) -> DataFrame:
    """(grp, rep, links, root, many): within each group (rep, grp, size, copies), the links of each set and the least
    set it is connected with, by exact similarities; groups of several blocks give a row per pair of blocks."""
    spark = docs.sparkSession

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        release_model()
        for part in steps(batches, "t"):
            h, owner, *_ = shingles(part)
            cut = np.searchsorted(owner, np.arange(part.num_rows + 1))
            blobs = [np.unique(h[a:b]).tobytes() for a, b in zip(cut[:-1], cut[1:])]
            yield pa.RecordBatch.from_arrays([part.column("rep"), part.column("grp"), part.column("size"), part.column("copies"), pa.array(blobs, pa.binary())], names=["rep", "grp", "size", "copies", "hashes"])

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        release_model()
        for table in groups(batches, "grp", "x", "y"):
            table = table.combine_chunks()
            cut = bounds_of(table, "grp", "x", "y")
            col = {c: ints(table.column(c).combine_chunks()) for c in ("rep", "grp", "copies", "x", "y", "own", "many")}
            blobs = table.column("hashes").to_pylist()
            links, root = np.zeros(table.num_rows, np.int64), col["rep"].copy()
            for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()):
                x, y, many = (int(col[c][a]) for c in ("x", "y", "many"))
                own = [np.frombuffer(z, np.uint64) for z in blobs[a:b]]
                links[a:b], label = linked(own, col["copies"][a:b], col["own"][a:b], x, y, many, threshold)
                least = np.full(b - a, np.iinfo(np.int64).max)
                np.minimum.at(least, label, col["rep"][a:b])
                root[a:b] = least[label]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (col["grp"], col["rep"], links, root, col["many"])], names=["grp", "rep", "links", "root", "many"])

    texts = docs.join(groups_of, docs["i"] == groups_of["rep"]).select("rep", "grp", "size", "copies", "t").mapInArrow(sets, "rep long, grp long, size long, copies long, hashes binary")
    block = F.greatest(F.lit(BLOCK), F.least(F.lit(MOST), F.ceil(F.col("size") / SPREAD)))
    dealt = in_blocks(texts, "size", block, "rep").repartition(task_count(spark), "grp", "x", "y").sortWithinPartitions("grp", "x", "y", "own", "rep")
    return dealt.mapInArrow(check, "grp long, rep long, links long, root long, many long")


def similar(docs: DataFrame, threshold: float = 0.8, recall: float = 0.9999, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, class_id, rep_id, n_links) of each row: the least id that it is linked to directly or by others, the least
    id with the same words, and how many other rows have at least the similarity ``threshold``."""
    source = docs.select(docs[id_col].cast("long").alias("i"), docs[text_col].alias("t"))
    rows = materialize(sketches(source), "sketches")
    usable = rows.filter("doc is not null and s1 is not null")
    reps = materialize(usable.groupBy("s1", "s2").agg(F.min("doc").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("sketch").alias("sketch")), "classes")
    edges = candidate_edges(reps, threshold, recall)
    found = materialize(components(edges), "groups")
    sizes = found.groupBy("root").agg(F.count(F.lit(1)).alias("size"))
    members = found.join(sizes, "root").join(reps.select("rep", "copies", "s1", "s2"), F.col("node") == F.col("rep")).select("rep", F.col("root").alias("grp"), "size", "copies")
    exact = materialize(verified(source, members.dropDuplicates(["rep"]), threshold), "verified")
    per_set = exact.groupBy("rep").agg(F.sum("links").alias("links"), F.min("root").alias("root"))
    spread = exact.filter("many > 1 and rep <> root").select(F.col("rep").alias("a"), F.col("root").alias("b"))
    if not spread.isEmpty():
        wide = components(spread)
        per_set = per_set.join(wide, F.col("rep") == F.col("node"), "left").select("rep", "links", F.coalesce(wide["root"], per_set["root"]).alias("root"))
    classes = reps.select("s1", "s2", "rep", "copies").join(per_set, "rep", "left").select("s1", "s2", "rep", "copies", "links", "root")
    return rows.select("doc", "s1", "s2").join(classes, ["s1", "s2"], "left").select(
        F.col("doc").alias(id_col),
        F.when(F.col("doc").isNull(), None).otherwise(F.coalesce("root", "rep", "doc")).alias("class_id"),
        F.when(F.col("doc").isNull(), None).otherwise(F.coalesce("rep", "doc")).alias("rep_id"),
        F.when(F.col("doc").isNull() | F.col("rep").isNull(), F.lit(0).cast("long")).otherwise(F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
    )


def one_of_each(docs: DataFrame, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are the least of their class, by id and then by the text's digest; rows of equal id and
    equal text are one, other rows that share an id are decided each by its text.  Rows with a null id stay."""
    given = docs.filter(docs[id_col].isNotNull())
    key, numbered = id_col, given
    if not given.groupBy(id_col).agg(F.count(F.lit(1)).alias("many")).filter("many > 1").isEmpty():
        # Numbers of the distinct rows take the ids' place; as they are given out in order, the least is still the least.
        key = "_row"
        digest = F.sha2(given[text_col], 256)
        texts = given.select(given[id_col].cast("long").alias("i"), digest.alias("h")).distinct().orderBy("i", "h")
        texts = materialize(texts.select("i", "h", F.monotonically_increasing_id().alias(key)), "rows")
        same = (given[id_col].cast("long") == texts["i"]) & digest.eqNullSafe(texts["h"])
        numbered = materialize(given.join(texts, same).select(*[given[c] for c in docs.columns], texts[key]).dropDuplicates([key]), "numbered")
    stay = similar(numbered, threshold, id_col=key, text_col=text_col).filter(F.col("class_id") == F.col(key)).select(F.col(key).alias("stays"))
    kept = numbered.join(stay, numbered[key] == stay["stays"], "left_semi").select(*docs.columns)
    return kept.unionByName(docs.filter(docs[id_col].isNull()))
