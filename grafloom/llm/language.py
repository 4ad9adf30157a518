"""Operator 4: language of texts by error-correcting output codes over byte n-grams.

Each language has a codeword; for each of its bits, one linear classifier over hashed byte n-grams (2 to 4 bytes of the
text, A-Z lower-cased, everything that is neither a letter nor above ASCII as one blank) tells the languages that have
the bit from those that have not.  Weights are smoothed log-odds of the n-grams on both sides; a text's margin is their
mean over all n-grams of the whole text.  Decoding adds up a logistic loss for each codeword, each bit weighted by how
well it separated the training rows, and takes the nearest codeword; its softmin is the score.  A text whose two
nearest codewords are close is flagged as ambiguous.

All 2**(k-1) - 1 splits of k languages are bits while k <= 5, else ``BITS`` fixed random splits.  The classifiers are
fitted on at most ``SAMPLE`` labelled rows of each language, which is a documented bound; of these, every
``CALIBRATE``-th row of a language that has as many is left out of the weights, and tells the cut, scale and trust of
each bit by its margins over all its n-grams (if no language has as many, all rows do both).  All else covers every row
and whole texts.  At most ``LANGUAGES`` distinct labels are learned; more are an error.

A text is rejected (``far``) if its bits speak for no codeword: the weighted loss per bit of the nearest one is more
than ``FAR`` of what bits without any evidence lose, so that its prediction is no more than the least bad guess.

Cases: a null text or one without a letter is ``und`` with score 0 and rejected; a null label is not learned from; ties
go to the language that sorts first; repeated rows give a row each; other columns are not read, or kept by
``known_language``; with an empty table, or without any label, all is ``und``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grafloom.llm.shared import flat, materialize, release_model, steps, task_count

#: Labelled rows of each language that classifiers are fitted on.
SAMPLE = 2000
#: Hash buckets of n-grams, and their lengths.
BUCKETS = 1 << 16
ORDERS = (2, 3, 4)
#: Every so many-th sampled row of a language calibrates the bits.
CALIBRATE = 4
#: Distinct labels that are learned at most.
LANGUAGES = 1000
#: Codeword bits where there are more than five languages.
BITS = 31
#: A text is ambiguous if the nearest codeword's share of both nearest is below this.
CLEAR = 0.6
#: A text is rejected if its nearest codeword loses more than this share of a loss without evidence.
FAR = 0.55


def fold_table():
    """Bytes as n-grams see them."""
    import numpy as np

    t = np.full(256, 0x20, np.uint8)
    t[0x61:0x7B] = np.arange(0x61, 0x7B)
    t[0x41:0x5B] = np.arange(0x61, 0x7B)
    t[0x80:] = np.arange(0x80, 0x100)
    return t


def grams(raw, offsets):
    """(bucket of each n-gram, number of its text) for texts raw[offsets[k]:offsets[k + 1]]."""
    import numpy as np

    from grafloom.llm.hashing import mix

    # Each text is set between two blanks; runs of blanks count once.
    n = len(offsets) - 1
    size = np.diff(offsets)
    out = np.full(int(size.sum()) + 2 * n, 0x20, np.uint8)
    doc = np.repeat(np.arange(n), size + 2)
    place = np.arange(len(raw)) + np.repeat(2 * np.arange(n) + 1, size)
    out[place] = fold_table()[raw]
    keep = np.ones(len(out), bool)
    keep[1:] = (out[1:] != 0x20) | (out[:-1] != 0x20) | (doc[1:] != doc[:-1])
    out, doc = out[keep].astype(np.uint64), doc[keep]
    buckets, owners = [], []
    code = out
    for k in range(2, max(ORDERS) + 1):
        code = (code[:-1] << np.uint64(8)) | out[k - 1 :]
        if k in ORDERS:
            ok = doc[: len(code)] == doc[k - 1 :]
            buckets.append((mix(code[ok] + np.uint64(k << 56)) & np.uint64(BUCKETS - 1)).astype(np.int64))
            owners.append(doc[: len(code)][ok])
    return np.concatenate(buckets), np.concatenate(owners)


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def codewords(k: int):
    """A (k, bits) matrix of +1 and -1."""
    import numpy as np

    if k == 1:
        return np.ones((1, 1))
    if k <= 5:
        bits = [[1 if (b >> j) & 1 or j == 0 else -1 for j in range(k)] for b in range(0, 1 << k, 2)]
        return np.array([b for b in bits if -1 in b], float).T
    rng, cols = np.random.default_rng(7), []
    while len(cols) < BITS:
        c = rng.permutation(np.where(np.arange(k) < k // 2, 1.0, -1.0))
        cols.append(c * c[0])
    out = np.array(cols).T
    while len({tuple(r) for r in out.tolist()}) < k:
        out = np.column_stack([out, rng.permutation(np.where(np.arange(k) < k // 2, 1.0, -1.0))])
    return out


class Model:
    def __init__(self, languages: list[str], counts):
        """counts: (language, bucket) sums of n-grams over the rows that are fitted on."""
        import numpy as np

        self.languages, self.codes = languages, codewords(len(languages))
        share = (counts + 0.05) / (counts + 0.05).sum(axis=1, keepdims=True)
        weights = []
        for bit in self.codes.T:
            yes = share[bit > 0].mean(axis=0)
            no = share[bit < 0].mean(axis=0) if (bit < 0).any() else yes
            weights.append(np.log(yes) - np.log(no))
        self.weights = np.array(weights, np.float32).T.copy()  # (bucket, bit)
        bits = self.codes.shape[1]
        self.cut, self.scale, self.trust = np.zeros(bits), np.full(bits, 4.0), np.ones(bits)

    def calibrate(self, truth, margin) -> None:
        """Sets the cut and scale of each bit, and how well it tells rows apart, by the numbers of the languages of rows
        and their margins (row, bit); every language has at least one."""
        import numpy as np

        # The typical margin of each language, then of both sides of each bit.
        typical = np.array([np.median(margin[truth == k], axis=0) for k in range(len(self.languages))])
        top = np.array([typical[c > 0, b].mean() for b, c in enumerate(self.codes.T)])
        low = np.array([typical[c < 0, b].mean() if (c < 0).any() else top[b] - 2.0 for b, c in enumerate(self.codes.T)])
        self.cut = (top + low) / 2
        self.scale = 4.0 / np.maximum((top - low) / 2, 1e-6)
        right = ((margin - self.cut) * self.codes[truth]) > 0
        # Languages count alike, however many rows they have.
        right = np.array([right[truth == k].mean(axis=0) for k in range(len(self.languages))]).mean(axis=0)
        self.trust = np.clip(2 * right - 1, 0.05, 1.0)

    def decode(self, margin):
        """(number of the nearest language, score, whether it is clear, its loss as a share of a loss without evidence)
        from the mean weights of each text."""
        import numpy as np

        loss = np.logaddexp(0, -((margin - self.cut) * self.scale)[:, None, :] * self.codes[None, :, :]) @ self.trust
        like = np.exp(loss.min(axis=1, keepdims=True) - loss)
        order = np.argsort(loss, axis=1, kind="stable")
        best = order[:, 0]
        score = 1 / like.sum(axis=1)
        clear = np.ones(len(best), bool)
        if len(self.languages) > 1:
            clear = 1 / (1 + like[np.arange(len(best)), order[:, 1]]) >= CLEAR
        return best, score, clear, loss.min(axis=1) / (np.log(2) * self.trust.sum())

    def margins(self, raw, offsets):
        """The mean weights of all n-grams of each text: (text, bit)."""
        import numpy as np

        n = len(offsets) - 1
        bucket, owner = grams(raw, offsets)
        order = np.argsort(owner, kind="stable")
        bucket, owner = bucket[order], owner[order]
        many = np.bincount(owner, minlength=n)
        sums = np.zeros((n, self.weights.shape[1]))
        on = np.flatnonzero(many)
        if len(on):
            at = np.cumsum(many[on]) - many[on]
            for b in range(self.weights.shape[1]):
                sums[on, b] = np.add.reduceat(self.weights[bucket, b].astype(np.float64), at)
        return sums / np.maximum(many, 1)[:, None]

    def predict(self, part, text):
        """(languages, scores, ambiguous, far) of the rows of a batch."""
        import numpy as np

        array = part.column(text)
        best, score, clear, loss = self.decode(self.margins(*flat(array)))
        letters = np.fromiter((has_letter(t) for t in array.to_pylist()), bool, part.num_rows)
        names = [self.languages[k] if ok else "und" for k, ok in zip(best.tolist(), letters.tolist())]
        return names, np.where(letters, score, 0.0), letters & ~clear, ~letters | (loss > FAR)


class Nothing:
    """What is learned from no rows."""

    def predict(self, part, text):
        import numpy as np

        n = part.num_rows
        return ["und"] * n, np.zeros(n), np.zeros(n, bool), np.ones(n, bool)


def is_held_out(id_column: Column) -> Column:
    return F.crc32(id_column.cast("string").cast("binary")) % 4 == 2


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", key_col: str = "doc_id", sample: int = SAMPLE) -> Model | Nothing:
    """A model of the rows of ``labelled``: ``sample`` of each language, chosen by the hash of the key."""
    import numpy as np
    from pyspark.sql import Window

    rows = labelled.select(labelled[key_col].alias("k"), labelled[text_col].alias("t"), labelled[lang_col].alias("l")).filter("t is not null and l is not null")
    sizes = {r.l: r.n for r in rows.groupBy("l").agg(F.count(F.lit(1)).alias("n")).limit(LANGUAGES + 1).collect()}
    languages = sorted(sizes)
    if not languages:
        return Nothing()
    if len(languages) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} distinct labels in {lang_col}")
    # A row passes with the rate that leaves a little more than the sample of its language; the window cuts it exactly.
    rate = F.create_map(*[F.lit(x) for name in languages for x in (name, min(1.0, 1.3 * sample / sizes[name] + 0.001))])
    rows = rows.withColumn("r", F.pmod(F.xxhash64(F.col("k").cast("string")), F.lit(1 << 30)))
    rows = rows.filter(F.col("r") < rate[F.col("l")] * (1 << 30))
    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy("l").orderBy("r", "k"))).filter(F.col("n") <= sample)
    rows = rows.select("t", "l", (F.col("n") % CALIBRATE == 0).alias("c")).repartition(task_count(labelled.sparkSession))
    rows = materialize(rows, "sample")
    both = any(n < CALIBRATE for n in sizes.values())
    at = {x: k for k, x in enumerate(languages)}

    def numbers(part):
        return np.array([at[x] for x in part.column("l").to_pylist()], np.int64)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_model()
        sums: dict[int, np.ndarray] = {}
        for part in steps(batches, "t"):
            bucket, owner = grams(*flat(part.column("t")))
            of = numbers(part)[owner]
            for k in np.unique(of).tolist():
                sums[k] = sums.get(k, 0) + np.bincount(bucket[of == k], minlength=BUCKETS)
        for k, own in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([own.astype(np.float32).tobytes()], pa.binary())], names=["k", "b"])

    counts = np.zeros((len(languages), BUCKETS))
    for r in rows.filter(F.lit(both) | ~F.col("c")).mapInArrow(count, "k int, b binary").toLocalIterator():
        counts[r.k] += np.frombuffer(r.b, np.float32)
    model = Model(languages, counts)
    sent = labelled.sparkSession.sparkContext.broadcast(model)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_model()
        for part in steps(batches, "t"):
            margin = sent.value.margins(*flat(part.column("t"))).astype(np.float32)
            yield pa.RecordBatch.from_arrays([pa.array([numbers(part).astype(np.int32).tobytes()], pa.binary()), pa.array([margin.tobytes()], pa.binary())], names=["k", "b"])

    # Numbers of the sample only: at most ``sample`` rows a language, a few bits each.
    found = rows.filter(F.lit(both) | F.col("c")).mapInArrow(measure, "k binary, b binary").collect()
    sent.unpersist()
    model.calibrate(np.frombuffer(b"".join(r.k for r in found), np.int32), np.frombuffer(b"".join(r.b for r in found), np.float32).reshape(-1, model.codes.shape[1]).astype(np.float64))
    return model


def languages(docs: DataFrame, model: Model | Nothing, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score, ambiguous, far) of each row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS x bits floats

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_model()
        for part in steps(batches, "t"):
            names, score, unclear, far = sent.value.predict(part, "t")
            yield pa.RecordBatch.from_arrays([part.column("i"), pa.array(names, pa.string()), pa.array(score), pa.array(unclear), pa.array(far)], names=[id_col, "lang_pred", "score", "ambiguous", "far"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(docs[id_col].alias("i"), docs[text_col].alias("t")).mapInArrow(run, f"`{id_col}` {kind}, lang_pred string, score double, ambiguous boolean, far boolean")


def known_language(docs: DataFrame, model: Model | Nothing, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not rejected: texts with a letter whose bits speak for a learned language."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_model()
        for part in steps(batches, f"c{at}"):
            yield part.filter(pa.array(~sent.value.predict(part, at)[3]))

    named = docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])
    return named.mapInArrow(run, named.schema).toDF(*docs.columns)
