"""Operator 12: reading of pages, trees, decoding, and held-out accuracy."""

import html
import itertools
import os
import random
import re
from collections import Counter

import numpy as np
import pytest

from grafloom.llm import boosting, dom, main_text

DATA = "/root/testdata/sf0.01"


def blocks(page):
    f = dom.Forest()
    f.add(page)
    return list(f.text.values())


@pytest.mark.parametrize(
    "page,want",
    [
        ("", []),
        ("plain  text\n here", ["plain text here"]),
        ("a < b &amp; c &lt;d&gt; &copy &notit; &#65;&#x42;&nbsp;x", ["a < b & c <d> © ¬it; AB x"]),
        ("<p>one<p>two<b>bold</b> three<br>four</p>five", ["one", "twobold three four", "five"]),
        ("<p><b>head.<br><p>next</p>", ["head.", "next"]),
        ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>e", ["a", "b", "c", "d", "e"]),
        ("<table><tr><td>a<td>b<tr><th>c</table>d", ["a", "b", "c", "d"]),
        ("<script>if (a<b) '</p>'</script>x<style>p{}</style><!-- <p>no --> y<!-->z", ["x yz"]),
        ('<div title="a>b" class=\'x\'>t</div><a href=it\'s>link</a> end', ["t", "link end"]),
        ("<title>no</title><body>yes<textarea>no</textarea>", ["yes"]),
        ("x<p", ["x"]),
        ('x<p title="never closed>y</p>', ["x"]),
        ("x<script>y", ["x"]),
        ("a</p>b</div>c", ["a", "bc"]),
        ("<div><p>a</div>b<hr>c", ["a", "b", "c"]),
        ("<?xml version=1?><!DOCTYPE html><![CDATA[x]]>y</ z>w<1>", ["yw<1>"]),
        ("<DIV>A<SCRIPT>x</SCRIPT >B</DIV>", ["AB"]),
    ],
)
def test_blocks_of_pages(page, want):
    assert blocks(page) == want


def test_trees_of_pages():
    f = dom.Forest()
    f.add('<html><body class="post-body mainText"><div id=x><a href=#>link here</a> text</div><p>b')
    f.add("c")
    assert [dom.KINDS[k] for k in f.kind] == ["other", "html", "body", "div", "text", "p", "text", "other", "text"]
    assert f.parent == [-1, 0, 1, 2, 3, 2, 5, -1, 7] and f.end == [7, 7, 7, 5, 5, 7, 7, 9, 9] and f.page == [0] * 7 + [1] * 2
    assert f.names == [(2, "post"), (2, "body"), (2, "main"), (2, "text"), (3, "x")] and f.link == {4: 9, 6: 0, 8: 0}
    x = dom.numbers(f)
    assert x.shape[0] == 9 and np.isfinite(x).all()
    named = dom.named(f, {"main": 2.0, "x": -1.0})
    assert named[2].tolist() == [0, 2, 0, 2] and named[4].tolist() == [-1, 0, -1, 2] and named[8].tolist() == [0, 0, 0, 0]


def test_deep_and_broken_pages_are_read():
    assert blocks("<div>" * 20_000 + "x") == ["x"]
    assert blocks("<li>" * 5000 + "y") == ["y"]
    r = random.Random(5)
    parts = ["<div>", "</div>", "<p>", "</p>", "<li>", "<table>", "<td>", "</table>", "<a href=x>", "</a>", "t ", "&amp;", "<!--", "-->", "<", ">", "<b class='", "'>", "</", "<body>", "<h1>", "<br>"]
    for _ in range(300):
        f = dom.Forest()
        f.add("".join(r.choice(parts) for _ in range(60)))
        n = len(f.parent)
        assert all(p < k for k, p in enumerate(f.parent)) and all(k < e <= n for k, e in enumerate(f.end))
        assert all(f.end[k] <= f.end[p] for k, p in enumerate(f.parent) if p >= 0)
        assert dom.numbers(f).shape[0] == n


def test_decoding_equals_all_choices():
    r = random.Random(2)
    for _ in range(200):
        n = r.randint(1, 9)
        parent = [-1] + [r.randrange(k) for k in range(1, n)]
        odds = [r.uniform(-2, 2) for _ in range(n)]
        kept = main_text.decode(odds, parent)
        assert all(not k or p < 0 or kept[p] for k, p in zip(kept, parent))
        legal = (c for c in itertools.product((False, True), repeat=n) if all(not k or p < 0 or c[p] for k, p in zip(c, parent)))
        assert abs(sum(o for o, k in zip(odds, kept) if k) - max(sum(o for o, k in zip(odds, c) if k) for c in legal)) < 1e-9


def test_trees_learn_what_one_split_cannot():
    r = np.random.default_rng(3)
    x = r.normal(size=(3000, 5))
    y = ((x[:, 1] > 0) ^ (x[:, 3] > 0.5)).astype(float)
    trees = boosting.Trees(trees=40).fit(x[:2000], y[:2000], np.ones(2000))
    assert ((trees.log_odds(x[2000:]) > 0) == y[2000:]).mean() > 0.93
    assert (boosting.Trees().fit(x, np.ones(3000), np.ones(3000)).log_odds(x) > 0).all()
    assert (boosting.Trees().fit(x[:0], y[:0], y[:0]).log_odds(x) < 0).all()


def in_article(page):
    """The blocks of the article of the given tables' pages."""
    inner = page[page.index("<article>") + 9 : page.index("</article>")]
    cut = (" ".join(html.unescape(re.sub("<[^>]*>", lambda m: " " if m[0] == "<br>" else "", x)).split()) for x in re.split("</?p>|</?h1>", inner))
    return "\n".join(x for x in cut if x)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
def test_main_texts_of_the_given_pages(spark):
    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    want = {r.page_id: (r.url, in_article(r.html)) for r in pages.collect()}
    got = main_text.main_texts(pages).collect()
    assert {r.page_id: (r.url, r.text) for r in got} == want and all(r.n_chars == len(r.text) for r in got)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
def test_held_out_layouts(spark):
    """Pages composed from other texts by other random choices: most come out exactly, nearly all blocks are right."""
    rows = [r.html for r in spark.read.parquet(f"{DATA}/pages.parquet").collect()]
    model = main_text.learn(rows[:120])
    composer = main_text.Composer(random.Random(77), [t for h in rows[120:] for t in in_article(h).split("\n")])
    exact = right = extra = missing = 0
    for _ in range(300):
        page = composer.page()
        want = [t.replace("\x02", "").replace("\x03", "") for t in blocks(page) if "\x02" in t]
        got = model.texts([page.replace("\x02", "").replace("\x03", "")])[0].split("\n")
        same = sum((Counter(want) & Counter(got)).values())
        exact, right, extra, missing = exact + (want == got), right + same, extra + len(got) - same, missing + len(want) - same
    assert exact / 300 > 0.85 and right / (right + extra) > 0.96 and right / (right + missing) > 0.96


def test_written_page_by_part(spark):
    """A page in a style of its own, with every part that is no main text."""
    page = """<html><head><title>T</title></head><body><header id="site-header"><h1>The Site</h1><nav class="menu"><a href=/>Home</a> <a href=/a>About us</a></nav></header>
    <div class="cookie-banner"><p>We use cookies to make this site work for you.</p><button>Accept</button></div>
    <div class="layout"><div class="post-content"><h1>A day at the sea</h1><p>We went to the sea &amp; swam   for hours.</p><div class="advert">Buy our boats now, they are cheap.</div>
    <p>Then the rain came, and everyone ran home.</p><ul><li>Bring towels</li><li>Bring water</li></ul><form class="newsletter"><label>Your address</label><input><button>Subscribe</button></form></div>
    <aside class="sidebar"><h3>Related</h3><ul><li><a href=/1>Another story</a></li><li><a href=/2>One more story</a></li></ul></aside>
    <section id="comments"><h3>2 comments</h3><div class="comment"><b>Ann</b><p>I liked this story about the sea very much.</p></div><div class="comment"><b>Bo</b><p>The rain was awful that day.</p></div></section></div>
    <footer>&copy; 2024 The Site. All rights reserved.</footer><script>track()</script></body></html>"""
    rows = [(1, "u", page), (1, "u", page), (None, None, None), (2, "v", ""), (3, "w", "<p>" + "only text. " * 20_000)]
    docs = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", __import__("pyspark").sql.functions.lit("x"))
    got = {(r.page_id, r.url, r.text, r.n_chars) for r in main_text.main_texts(docs).collect()}
    want = "A day at the sea\nWe went to the sea & swam for hours.\nThen the rain came, and everyone ran home.\nBring towels\nBring water"
    long = ("only text. " * 20_000).strip()
    assert got == {(1, "u", want, len(want)), (None, None, "", 0), (2, "v", "", 0), (3, "w", long, len(long))}
    assert main_text.main_texts(docs).count() == 5
    empty = main_text.main_texts(docs.limit(0))
    assert empty.columns == ["page_id", "url", "text", "n_chars"] and not empty.count()
