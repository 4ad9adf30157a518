"""Operators 11 and 13 against brute force."""

import hashlib
import math
import os
import re
from collections import Counter

import pytest
import regex

from grafloom.llm import fill_in_middle, lexical_search

from . import cases
from .test_operators import near_copies

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def brute_ranks(rows, items, k=10):
    docs = [(i, Counter(TERM.findall(cases.low(t or "")))) for i, t in rows if i is not None]
    docs = [(i, c, sum(c.values())) for i, c in docs if c]
    n, total, df = len(docs), sum(x[2] for x in docs), Counter(t for _, c, _ in docs for t in c)
    out = []
    for item, text in items:
        found = []
        for i, c, size in docs if item is not None else ():
            m = 10 + 90 * size * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in set(TERM.findall(cases.low(text or ""))) if t in c)
            found += [(-score, i)] if score > 0 else []
        out += [(item, r + 1, i, -s) for r, (s, i) in enumerate(sorted(found)[:k])]
    return sorted(out)


def found(df):
    return sorted(tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect())


def searched():
    rows = cases.texts() + near_copies(40, 3) + [(500 + k, f"tie {'x ' * (k % 3)}tie {k % 5}") for k in range(60)]
    items = [(1, cases.passage(1, 30)), (2, "TIE 3"), (2, "tie"), (3, None), (4, ""), (5, "nowhere_seen qqqqqq"), (None, "tie"), (6, cases.passage(3, 150)), (7, "Straße ÜNÏ日本語テキスト x"), (8, "one two three one")]
    return rows, items


@pytest.mark.parametrize("limits", [{}, {"BLOCK": 2, "SHARD": 7}, {"BLOCK": 3, "CELL": 40, "TOGETHER": 1}, {"TERMS": 0, "BLOCK": 16}, {"POSTINGS": 50}])
def test_ranked_equals_brute_force(spark, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(lexical_search, name, value)
    rows, items = searched()
    asked = spark.createDataFrame(items, "item_id long, text string")
    assert found(lexical_search.ranked(cases.table(spark, rows), asked)) == brute_ranks(rows, items)
    assert found(lexical_search.ranked(cases.table(spark, rows), asked, k=3)) == brute_ranks(rows, items, 3)


def test_ranked_equals_brute_force_on_documents(spark):
    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("needs the test tables")
    docs, items = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "benchmark"))
    rows, asked = ([tuple(r) for r in x.collect()] for x in (docs.select("doc_id", "text"), items.select("item_id", "text")))
    assert found(lexical_search.ranked(docs, items)) == brute_ranks(rows, asked)


def test_ranked_without_documents_or_questions(spark):
    docs, items = (spark.createDataFrame([], f"{c} long, text string") for c in ("doc_id", "item_id"))
    one, ask = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([(1, "a b")], "item_id long, text string")
    for left, right in ((docs, items), (one, items), (docs, ask)):
        got = lexical_search.ranked(left, right)
        assert got.columns == ["item_id", "rank", "doc_id", "score"] and not got.count()


def shard_of(texts):
    import numpy as np

    words = [TERM.findall(t) for t in texts]
    post = [(d, int.from_bytes(hashlib.sha256(t.encode()).digest()[:7], "little"), c) for d, w in enumerate(words) for t, c in sorted(Counter(w).items())]
    doc, h, tf = (np.array(x) for x in zip(*post))
    arrays = lexical_search.blocks_of(np.arange(len(texts)), np.array([len(w) for w in words]), doc, h.astype(np.uint64), h.astype(np.uint64), tf)
    return {c: arrays[c].astype(kind).tobytes() for c, kind in lexical_search.ARRAYS.items()}, post, sum(map(len, words))


def test_blocks_hold_their_postings_and_bounds(monkeypatch):
    import numpy as np

    texts = [" ".join([f"w{k % 7}"] * (1 + k % 11) + [f"v{k}"] * 300 * (k % 50 == 0) + ["x"] * (70_000 if k == 99 else 1)) for k in range(700)]
    row, post, total = shard_of(texts)
    lists = lexical_search.Lists(row, len(texts), total)
    lists.unpack(np.arange(len(lists.first)))
    got = {(int(lists.h1[k // lexical_search.FAR]), k % lexical_search.FAR): s for k, s in zip(lists.key.tolist(), lists.score.tolist())}
    assert got == {(h, d): lexical_search.impact(c, int(lists.m[d])) for d, h, c in post}
    worst = np.maximum.reduceat(lists.score, lists.begin[:-1])
    assert (worst <= lists.bound).all() and lists.open.all()


def test_blocks_below_the_threshold_stay_packed():
    import numpy as np

    texts = ["rare " * 20 + "common" if k in range(9, 13) else f"common word{k % 3} " + "filler " * (30 + k % 9) for k in range(5000)]
    row, _, total = shard_of(texts)
    lists = lexical_search.Lists(row, len(texts), total)
    h = np.array([int.from_bytes(hashlib.sha256(t.encode()).digest()[:7], "little") for t in ("rare", "common")], np.uint64)
    counted = {}
    q, place, score = lexical_search.search(lists, np.array([0, 2]), h, h, np.array([7000, 3]), 4, counted)
    assert place.tolist() == [9, 10, 11, 12] and (score == score[0]).all()
    common = lists.find(h[1:], h[1:])[0]
    opened = lists.open[lists.head[common] : lists.head[common + 1]]
    assert opened.sum() <= 2 < len(opened) and counted["scored"] < 100


def brute_middle(i, t):
    t = t or ""
    u = regex.findall(r"[^\n]*\n|[^\n]+", t)
    d = hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()
    h = [int(d[8 * k : 8 * k + 8], 16) for k in range(4)]
    if not t or "<P>" in t or "<S>" in t or "<M>" in t:
        return (i, len(u), "plain", None, None, hashlib.sha256(t.encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
    a, b = sorted(x % (len(u) + 1) for x in h[:2])
    pre, mid, suf = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    form, out = ("spm", f"<S>{suf}<P>{pre}<M>{mid}") if h[3] % 100 < 50 else ("psm", f"<P>{pre}<S>{suf}<M>{mid}")
    return (i, len(u), form, len(pre), len(mid), hashlib.sha256(out.encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())


NAMES = ("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")


def test_fill_in_middle_equals_brute_force(spark):
    rows = cases.texts() + [(600 + k, t) for k, t in enumerate(["\n", "\n\n", "a\nb", "a\r\nb\n\x85c d", "x<P>y", "<S", "<<S>", "<M>", "é🎉\n日本\nend", "<\nS>\nP>", "M><\n" * 40, "line\n" * 5000])]
    got = cases.ordered(fill_in_middle.fill_in_middle(cases.table(spark, rows)), *NAMES)
    assert got == sorted((brute_middle(i, t) for i, t in rows), key=lambda r: tuple((x is None, str(x)) for x in r))


def test_fill_in_middle_general_interface(spark):
    rows = [(k, f"def f{k}():\n    return {k}\n\n" * (k % 4 + 1)) for k in range(200)]
    docs = spark.createDataFrame([(k, t, "extra", 1) for k, t in rows], "doc_id long, text string, form string, n long")
    out = fill_in_middle.fill_in_middle(docs.withColumnRenamed("form", "source").withColumnRenamed("n", "m"), rate=60, spm=0, units=r"\w+|\W", keep=("source",)).collect()
    assert {r.form for r in out} == {"plain", "psm"} and 60 < sum(r.form == "psm" for r in out) < 170
    assert all(fill_in_middle.restore(r.output, r.form) == dict(rows)[r.doc_id] and r.source == "extra" for r in out)
    with pytest.raises(ValueError):
        fill_in_middle.unit_ends(regex.compile("a"), "ab")
    empty = fill_in_middle.fill_in_middle(docs.limit(0))
    assert not empty.count() and "output" in empty.columns
