"""Operator 1: token counts of a word-end BPE vocabulary by rank-synchronous array merging.

Pre-tokens of a batch are held as one ragged NumPy array of symbol ids.  In each round every sequence merges all
occurrences of its own lowest-rank pair at once; sequences without a known pair leave the array, and what is left of
each is its number of tokens.  As the merged symbol of rank r only takes part in merges of higher rank, this equals
one-merge-at-a-time BPE.

Cases: a null or empty text has 0 bytes and 0 tokens; a null id is kept; repeated rows and ids give a row each; other
columns are not read, so their names may clash; an empty table gives an empty result.  Special strings in a text count
as one token each, as the library does by default.  Nothing is shuffled and memory is bounded by one Arrow batch and
the piece cache (``CACHE`` entries).
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from grafloom.llm.shared import lengths, steps, worker_model

#: Pre-tokens whose counts a worker remembers; the cache is emptied when it is full.
CACHE = 300_000


def byte_names() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


class WordBpe:
    def __init__(self, path: str):
        import numpy as np

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, tail = model["vocab"], model["end_of_word_suffix"]
        names = byte_names()
        self.inner = np.array([vocab[c] for c in names], np.int64)
        self.final = np.array([vocab[c + tail] for c in names], np.int64)
        pairs = [(vocab[a], vocab[b], vocab[a + b]) for a, b in (m if isinstance(m, list) else m.split(" ") for m in model["merges"])]
        keys = np.array([a << 20 | b for a, b, _ in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order
        self.merged = np.array([c for _, _, c in pairs], np.int64)
        self.none = len(pairs)
        special = [t["content"] for t in spec["added_tokens"]]
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.names = special
        self.cache: dict[bytes, int] = {}

    def merge(self, raw, start, end):
        """Number of tokens of each byte slice."""
        import numpy as np

        from grafloom.llm.hashing import ragged

        size = end - start
        symbols = self.inner[raw[ragged(start, size)]]
        stops = np.cumsum(size)
        symbols[stops - 1] = self.final[raw[end - 1]]
        counts = size.copy()
        rows = np.flatnonzero(size > 1)  # sequences still in the array
        if len(rows) < len(size):
            symbols = symbols[ragged(stops[rows] - size[rows], size[rows])]
        size = size[rows]
        while len(rows):
            row = np.repeat(np.arange(len(rows)), size)
            heads = np.cumsum(size) - size
            key = symbols << 20
            key[:-1] |= symbols[1:]
            at = np.searchsorted(self.keys, key)
            at[at == len(self.keys)] = 0
            rank = np.where(self.keys[at] == key, self.ranks[at], self.none)
            rank[heads + size - 1] = self.none
            least = np.minimum.reduceat(rank, heads)
            hit = (rank == least[row]) & (rank < self.none)
            after = np.flatnonzero(hit[1:] & hit[:-1]) + 1
            if len(after):  # a run of the same symbol merges from the left, two by two
                place = np.flatnonzero(hit)
                fresh = np.append(True, (place[1:] != place[:-1] + 1) | (row[place[1:]] != row[place[:-1]]))
                since = np.arange(len(place)) - np.maximum.accumulate(np.where(fresh, np.arange(len(place)), 0))
                hit[place[since % 2 == 1]] = False
            place = np.flatnonzero(hit)
            symbols[place] = self.merged[rank[place]]
            keep = np.ones(len(symbols), bool)
            keep[place + 1] = False
            done = least == self.none
            size = size - np.bincount(row[place], minlength=len(rows))
            counts[rows] = size
            done |= size < 2
            keep &= ~done[row]
            symbols, rows, size = symbols[keep], rows[~done], size[~done]
        return counts

    def count(self, texts: list[str | None]) -> list[int]:
        import numpy as np

        from grafloom.llm.pieces import code_points, cut, distinct_slices

        parts: list[str] = []
        owner: list[int] = []
        totals = np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            if not text:
                continue
            if any(name in text for name in self.names):
                segments = self.special.split(text)
                totals[i] += len(segments) - 1
            else:
                segments = [text]
            for s in segments:
                if not s.isascii():
                    s = unicodedata.normalize("NFC", s).replace("Σ", "σ")
                parts.append(s.lower())
                owner.append(i)
        if not parts:
            return totals.tolist()
        raw = np.frombuffer("".join(parts).encode("utf-8"), np.uint8)
        points, offsets = code_points(raw)
        heads = np.cumsum([0, *map(len, parts)])
        start, end = cut(points, heads[:-1], spaced=False)
        if not len(start):
            return totals.tolist()
        of = np.asarray(owner)[np.searchsorted(heads, start, "right") - 1]
        a, b = offsets[start], offsets[end]
        first, codes = distinct_slices(raw, a, b)
        data = raw.tobytes()
        fa, fb = a[first], b[first]
        names = [data[x:y] for x, y in zip(fa.tolist(), fb.tolist())]
        found = np.fromiter((self.cache.get(x, -1) for x in names), np.int64, len(names))
        missing = np.flatnonzero(found < 0)
        if len(missing):
            found[missing] = self.merge(raw, fa[missing], fb[missing])
            if len(self.cache) + len(missing) > CACHE:
                self.cache.clear()
            self.cache.update((names[k], c) for k, c in zip(missing.tolist(), found[missing].tolist()))
        totals += np.bincount(of, weights=found[codes], minlength=len(texts)).astype(np.int64)
        return totals.tolist()


def load(path: str) -> WordBpe:
    return worker_model(("word_bpe", path), lambda: WordBpe(path))


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of each row; ``tokenizer`` is the vocabulary's path on every machine."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        model = load(tokenizer)
        for part in steps(batches, "t"):
            n = np.asarray(model.count(part.column("t").to_pylist()))
            yield pa.RecordBatch.from_arrays([part.column("i"), pa.array(lengths(part.column("t"))), pa.array(n), pa.array(n > limit)], names=[id_col, "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(docs[id_col].alias("i"), docs[text_col].alias("t")).mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean")
