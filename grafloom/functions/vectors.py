"""Vectors as array columns: products in double precision, and a hashing embedder."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Null if either vector is zero."""
    size = norm(a) * norm(b)
    return F.when(size > 0, dot(a, b) / size)


def normalized(a: Column) -> Column:
    size = norm(a)
    return F.transform(a, lambda x: x.cast("double") / size)


def hash_embedding(c: Column, dim: int = 384) -> Column:
    """Signed hash features of words (weight 1.3) and their character 4-grams (0.45), of length one (Arrow UDF)."""

    @F.pandas_udf("array<double>")
    def embed(s: pd.Series) -> pd.Series:
        import hashlib
        import re

        import numpy as np

        from grafloom.functions.text import TOKEN

        memo: dict[str, tuple[int, float]] = {}

        def place(feature: str) -> tuple[int, float]:
            if feature not in memo:
                if len(memo) > 200_000:
                    memo.clear()
                n = int.from_bytes(hashlib.blake2b(feature.encode(), digest_size=8).digest(), "little")
                memo[feature] = (n % dim, 1.0 if (n >> 63) & 1 else -1.0)
            return memo[feature]

        def one(text: str | None):
            v = np.zeros(dim)
            for word in re.findall(TOKEN, (text or "").lower()):
                k, sign = place("w:" + word)
                v[k] += 1.3 * sign
                for i in range(len(word) - 3):
                    k, sign = place("g:" + word[i : i + 4])
                    v[k] += 0.45 * sign
            size = np.linalg.norm(v)
            return (v / size if size else v).tolist()

        return s.map(one)

    return embed(c)
