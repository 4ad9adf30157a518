"""Operator 13: fill-in-middle transformation by an Arrow-batched pandas UDF.

A text is cut into units by a pattern of the regex library (lines with their ends, unless another is given).  One pass of
``finditer`` gathers the units' end offsets in a compact array; two numbers from the document's seed choose two of these,
and slices of the text between them are the prefix, the middle and the suffix.  The seed is the SHA-256 of
``<seed>:<id>``, so the outcome depends on the id alone, on no order and no partition.

Forms: ``psm`` puts ``<P>``prefix``<S>``suffix``<M>``middle, ``spm`` ``<S>``suffix``<P>``prefix``<M>``middle, ``plain``
the text as it is: where it is empty, where it holds one of the marks, or where the seed leaves it out at ``rate`` percent.
``restore`` gives the text back from output and form; a text without marks cannot form one across a seam, as a mark begins
with its only ``<``.

Cases: a null text counts as empty; a null id as an empty one in the seed; texts that the pattern does not cover to the
end (no such for lines) are an error; repeated rows and ids give equal outcomes each; very long texts take 8 bytes a unit
beside themselves; other columns are passed on only if asked for; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from array import array

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LINES = r"[^\n]*\n|[^\n]+"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SCHEMA = "n long, form string, prefix_chars long, middle_chars long, output string, output_sha256 string, restored_sha256 string"


def unit_ends(pattern: regex.Pattern, text: str) -> array:
    """0 and the end of every unit."""
    out = array("q", [0])
    out.extend(m.end() for m in pattern.finditer(text))
    if out[-1] != len(text):
        raise ValueError("the pattern does not cover the text")
    return out


def numbers(seed: int, key: str) -> list[int]:
    """The first four groups of eight hexadecimal digits of the digest."""
    digest = hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()
    return [int(digest[k : k + 8], 16) for k in range(0, 32, 8)]


def transform(pattern: regex.Pattern, key: str, text: str, seed: int, rate: int, spm: int) -> tuple:
    """(units, form, characters of the prefix and of the middle, output)."""
    ends, (h1, h2, h3, h4) = unit_ends(pattern, text), numbers(seed, key)
    n = len(ends) - 1
    if not text or h3 % 100 >= rate or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = text[: ends[a]], text[ends[a] : ends[b]], text[ends[b] :]
    if h4 % 100 < spm:
        return n, "spm", len(prefix), len(middle), f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", len(prefix), len(middle), f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def restore(output: str, form: str) -> str:
    """The text from which ``transform`` made the output."""
    if form == "plain":
        return output
    first, second = (PREFIX, SUFFIX) if form == "psm" else (SUFFIX, PREFIX)
    one, rest = output.removeprefix(first).split(second, 1)
    two, middle = rest.split(MIDDLE, 1)
    return one + middle + two if form == "psm" else two + middle + one


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 7, rate: int = 100, spm: int = 50, units: str = LINES, keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, kept columns, n, form, prefix_chars, middle_chars, output, digests of output and of the restored text)."""

    @F.pandas_udf(SCHEMA)
    def outcome(keys: pd.Series, texts: pd.Series) -> pd.DataFrame:
        pattern, rows = regex.compile(units), []
        for key, text in zip(keys, texts):
            n, form, before, middle, output = transform(pattern, key, text, seed, rate, spm)
            rows.append((n, form, before, middle, output, digest(output), digest(restore(output, form))))
        out = pd.DataFrame(rows, columns=["n", "form", "prefix_chars", "middle_chars", "output", "output_sha256", "restored_sha256"])
        return out.astype({"n": "int64", "prefix_chars": "Int64", "middle_chars": "Int64"})

    key, text = (F.coalesce(docs[c].cast("string"), F.lit("")) for c in (id_col, text_col))
    return docs.select(docs[id_col], *(docs[c] for c in keep), outcome(key, text).alias("_fim")).select(id_col, *keep, "_fim.*")
