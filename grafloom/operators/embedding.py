"""Embedders as an extension point: what turns texts into vectors of one length, and how an index names it."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from grafloom.functions.vectors import hash_embedding


@dataclass(frozen=True)
class Embedder:
    """``column`` gives the vectors of a text column; model, revision and length are kept with an index and must be the
    same where it is opened."""

    model: str
    revision: str
    dim: int
    column: Callable[[Column], Column]

    def meta(self) -> dict[str, str]:
        return {"model": self.model, "revision": self.revision, "dim": str(self.dim)}


def hashed(dim: int = 384) -> Embedder:
    """Hash features of words; needs no model."""
    return Embedder("hash", "1", dim, lambda c: hash_embedding(c, dim))


_LOADED: dict = {}


def loaded(model: str, revision: str, dim: int, load: Callable[[], Callable[[list[str]], Sequence[Sequence[float]]]], batch: int = 64) -> Embedder:
    """An embedder of a model that ``load`` brings: once a Python worker, then texts in batches of at most ``batch``.

    A null text has a null vector.  Where the model fails on a batch its texts are tried one by one, and those that fail
    alone, or whose vectors are not of length ``dim`` or not finite, have null vectors; so one text does not stop a job.
    """
    key = uuid.uuid4().hex

    @F.pandas_udf("array<double>")
    def embed(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import numpy as np

        if key not in _LOADED:
            _LOADED.clear()  # one model is held at a time
            _LOADED[key] = load()
        run = _LOADED[key]

        def vectors(texts: list[str]) -> list:
            try:
                rows = [np.asarray(v, dtype=np.float64) for v in run(texts)]
                if len(rows) != len(texts):
                    raise ValueError("one vector for each text")
            except Exception:  # noqa: BLE001 - a model may fail in any way
                return [None] if len(texts) == 1 else [v for t in texts for v in vectors([t])]
            return [v.tolist() if v.shape == (dim,) and np.isfinite(v).all() else None for v in rows]

        for s in series:
            texts = [None if t is None or t != t else t for t in s.tolist()]
            some = [t for t in texts if t is not None]
            found = iter([v for a in range(0, len(some), batch) for v in vectors(some[a : a + batch])])
            yield pd.Series([None if t is None else next(found) for t in texts], dtype=object)

    return Embedder(model, revision, dim, embed)
