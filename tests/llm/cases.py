"""Small tables with what operators must stand, and brute-force versions of their results."""

from __future__ import annotations

import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, i long, t string, doc long, at string, n_tokens string, shard string, path string, rep string"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(s: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), s)


def passage(seed: int, n: int) -> str:
    import random

    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghinorst") for _ in range(r.randint(2, 8))) for _ in range(n))


def texts() -> list[tuple[int | None, str | None]]:
    shared, line = passage(1, 70), "This line is in very many documents."
    base = passage(2, 120)
    near = base.split()
    near[60] = "other"
    rows: list[tuple[int | None, str | None]] = [
        (1, base),
        (2, base),
        (3, " ".join(near)),
        (4, f"{passage(3, 40)} {shared}\n{line}\n{passage(4, 20)}"),
        (5, f"{passage(5, 60)}\n  {line.upper()}\t\n{shared} end"),
        (6, f"{line}\n\n{passage(6, 30)}"),
        (7, None),
        (8, ""),
        (9, " \n\t\r\n "),
        (10, "12345 67 --- !!!"),
        (11, "It's we'll 'S don''t <|endoftext|> Ünïcödé Straße ΑΣΣ ſ 日本語テキスト 🎉👍   \x1c ١٢ 're"),
        (12, "a" * 3000),
        (13, passage(7, 30_000)),
        (14, "one two three"),
        (15, "one two three"),
        (15, "one two three"),
        (None, base),
        (None, None),
        (2**40, f"{line}\n{line}\nlast"),
        (-3, passage(1, 49)),
        (16, passage(8, 10)),
        (17, "x " + passage(8, 10).upper() + " y"),
        (18, passage(9, 5)),
        (19, passage(9, 5) + " more words here"),
    ]
    return rows


def table(spark, rows=None):
    """The rows, with further columns whose names operators use inside."""
    rows = texts() if rows is None else rows
    langs = ["en", "fr", None]
    data = [(i, t, langs[k % 3], "s", None if t is None else len(t), 1, "x", 2, "y", "z", "0", "p", "r") for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(data, SCHEMA)


def ordered(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.select(*names).collect()), key=lambda r: tuple((x is None, str(x)) for x in r))
