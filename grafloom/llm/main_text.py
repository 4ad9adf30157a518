"""Operator 12: main text of HTML pages by gradient-boosted trees over the nodes of their trees.

``dom`` reads pages into block elements and text blocks and gives each node its features: kind, depth, density of text
and links in its subtree, what stands beside it, and how words of its attributes and of those around it speak for or
against main text.  Boosted trees
(``boosting``) give the log-odds that a node is of the main text or holds some of it.  Decoding is hierarchical: of all
choices in which a chosen node's ancestors are chosen too, it takes the one with the greatest sum of log-odds, in one pass
up and one down the tree, so no kept text lies in a dropped part.  Kept text blocks come out in page order.

There are no labelled pages, so the trees learn from a bounded sample of the table, ``PAGES`` pages of
at most ``LONGEST`` characters, in two ways: pages with a landmark (``article`` or ``main``) as they are (main is what
lies in it, outside of menus, forms and the like), and ``COMPOSED`` pages, composed from the sample's own texts
in many ways of writing: with and without landmark elements, with telling, foreign or no names, with menus, adverts,
notices, sidebars, forms and reader comments before, in and after the article.  A node is labelled by the part that it was
composed for.  What the trees have learned is one small object; the sample is fitted in one task.

Cases: a null or empty page has an empty text; a page without any tag is one block; repeated rows give a row each, null
ids and urls are passed on; other columns are not read; an empty table gives an empty result.  Pages are read whole,
whatever their length.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grafloom.llm.shared import release_model, steps

#: Pages of the sample, their length at most, pages composed of their texts.
PAGES = 150
LONGEST = 100_000
COMPOSED = 750
#: Words of attributes whose odds are learned: the most frequent ones in the sample and its compositions.
WORDS = 1000

#: Names that pages give their parts.
NAMES = {
    "main": "post article entry content story main body text single hentry post-body article-content entry-content story-text page-content articleBody",
    "nav": "nav menu navbar navigation breadcrumb breadcrumbs pagination main-menu site-nav topnav toc tabs",
    "header": "header masthead topbar branding site-header page-header banner logo",
    "footer": "footer site-footer colophon copyright bottom legal page-footer",
    "aside": "sidebar aside widget related recommended trending rail secondary tags read-more more-stories side popular",
    "notice": "cookie consent notice alert gdpr privacy newsletter subscribe paywall popup modal overlay cookie-banner warning message",
    "ad": "ad ads advert advertisement sponsor sponsored promo ad-slot adsense promotion",
    "form": "form search login signup contact search-form subscribe-form register",
    "comments": "comments comment replies discussion responses comment-list disqus reader-comments thread reactions respond feedback",
    "share": "share social sharing share-buttons follow author-box byline-links",
}
LANDMARK = {"main": "article", "nav": "nav", "header": "header", "footer": "footer", "aside": "aside", "notice": "aside", "ad": "aside", "form": "form", "comments": "section", "share": "div"}
#: Parts of a landmark that are no main text.
OUTSIDE = ("nav", "aside", "footer", "form", "control")


class Composer:
    """Pages made of given texts; the texts of main parts are noted in ``main``."""

    def __init__(self, random, texts: list[str]):
        self.r, self.long = random, [t for t in texts if len(t) > 40] or ["A text of some length that says a little about nothing."]
        self.short = [t for t in texts if len(t) <= 60] or ["Short text"]

    def words(self, n: int) -> str:
        text = self.r.choice(self.long).split()
        a = self.r.randrange(max(1, len(text) - n))
        return " ".join(text[a : a + n])

    def wrap(self, part: str, inner: str, telling: float = 0.8) -> str:
        r = self.r
        tag = LANDMARK[part] if r.random() < 0.5 else "section" if r.random() < 0.15 else "div"
        names = NAMES[part].split()
        if r.random() < (telling if tag in ("div", "section") else 0.3):
            name = r.choice(names) + (f"-{r.choice(('box', 'wrap', 'list', 'area', 'block', 'inner'))}" if r.random() < 0.3 else "")
            attribute = f' {r.choice(("class", "class", "id"))}="{name if r.random() < 0.7 else f"x{r.randrange(99)} {name}"}"'
        elif r.random() < 0.4:
            attribute = f' class="{"".join(r.choice("bcdfghkmqrtvwxz") for _ in range(4))}{r.randrange(99)}"'
        else:
            attribute = ""
        return f"<{tag}{attribute}>{inner}</{tag}>"

    def links(self, n: int) -> str:
        r = self.r
        items = [f'<a href="/{k}">{self.words(r.randint(1, 5))}</a>' for k in range(n)]
        kind = r.random()
        return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>" if kind < 0.6 else " | ".join(items) if kind < 0.8 else "".join(f"<div>{x}</div>" for x in items)

    def sentence(self) -> str:
        return self.r.choice(self.short) if self.r.random() < 0.25 else self.words(self.r.randint(3, 60))

    def paragraph(self) -> str:
        r = self.r
        text = r.choice(self.short) if r.random() < 0.2 else r.choice(self.long)
        if r.random() < 0.15:
            words = text.split()
            k = r.randrange(len(words))
            words[k] = f'<a href="/w">{words[k]}</a>'
            text = " ".join(words)
        return text

    def block(self, part: str) -> str:
        """One part that is no main text."""
        r = self.r
        if part == "nav":
            inner = self.links(r.randint(2, 9))
        elif part == "header":
            inner = f"<{(t := r.choice(('h1', 'h2', 'div', 'p')))}>{self.words(r.randint(1, 4))}</{t}>" + (self.links(3) if r.random() < 0.4 else "") + (f"<p>{self.sentence()}</p>" if r.random() < 0.3 else "")
        elif part == "footer":
            inner = r.choice((f"&copy; {self.words(3)} &middot; {self.sentence()}", f"<p>&copy; 2024 {self.sentence()}</p>", f"<p>{self.sentence()}</p>{self.links(3)}", self.links(5)))
        elif part == "aside":
            inner = (f"<h3>{self.words(2)}</h3>" if r.random() < 0.6 else "") + (self.links(r.randint(2, 6)) if r.random() < 0.6 else "".join(f"<p>{self.sentence()}</p>" for _ in range(r.randint(1, 3))))
        elif part == "notice":
            inner = f"<p>{self.sentence()}</p>" if r.random() < 0.6 else self.sentence()
            inner += f"<button>{self.words(1)}</button>" if r.random() < 0.5 else ""
        elif part == "ad":
            inner = r.choice((self.sentence(), f"<p>{self.sentence()}</p>", f'<a href="/ad">{self.sentence()}</a>', f"<span>{self.words(1)}</span> {self.sentence()}"))
        elif part == "form":
            inner = f"<label>{self.words(2)}</label><input name=q><button>{self.words(1)}</button>" + (f"<p>{self.sentence()}</p>" if r.random() < 0.4 else "")
            inner = inner if r.random() < 0.4 else f"<form>{inner}</form>"
        elif part == "share":
            inner = self.links(r.randint(2, 4))
        else:
            one = lambda: self.wrap("comments", (f"<b>{self.words(2)}</b>" if r.random() < 0.5 else f"<div>{self.words(2)}</div>") + (f"<p>{self.paragraph()}</p>" if r.random() < 0.7 else self.sentence()), 0.6)
            many = "".join(one() for _ in range(r.randint(1, 5)))
            inner = (f"<h3>{self.words(2)}</h3>" if r.random() < 0.7 else "") + (many if r.random() < 0.7 else "<ol>" + "".join(f"<li>{self.sentence()}</li>" for _ in range(3)) + "</ol>")
        return self.wrap(part, inner, 0.95)

    def article(self) -> str:
        """A main part; its texts are enclosed in marks."""
        r = self.r
        out, mark = [], lambda x: f"\x02{x}\x03"
        if r.random() < 0.8:
            h = r.choice(("h1", "h1", "h1", "h2"))
            head = f"<{h}>{mark(r.choice(self.short) if r.random() < 0.5 else self.words(r.randint(2, 10)))}</{h}>"
            out.append(f"<header>{head}</header>" if r.random() < 0.1 else head)
        loose = r.random() < 0.12
        for _ in range(r.choice((1, 2, 3, 4, 6, 8, 12))):
            kind = r.random()
            if loose:
                out.append(f"<div>{mark(self.paragraph())}</div>" if kind < 0.5 else mark(self.paragraph()) + "<hr>")
            elif kind < 0.72:
                text = self.paragraph()
                out.append(f"<p><b>{mark(text)}<br><p>" if r.random() < 0.1 else f"<p>{mark(text)}</p>")
            elif kind < 0.79:
                out.append("<ul>" + "".join(f"<li>{mark(self.sentence())}</li>" for _ in range(r.randint(1, 5))) + "</ul>")
            elif kind < 0.86:
                out.append(f"<h2>{mark(self.words(r.randint(1, 6)))}</h2>")
            elif kind < 0.9:
                out.append(f"<blockquote>{mark(self.sentence())}</blockquote>")
            elif kind < 0.93:
                out.append("<table>" + "".join(f"<tr><td>{mark(self.words(1))}</td><td>{mark(self.words(3))}</td></tr>" for _ in range(r.randint(1, 4))) + "</table>")
            elif kind < 0.95:
                out.append(f"<figure><img src=x><figcaption>{mark(self.sentence())}</figcaption></figure>")
            else:
                out.append(f"<pre>{mark(self.sentence())}</pre>")
            if r.random() < 0.1:
                out.append(self.block(r.choice(("ad", "aside", "form", "share", "notice", "nav"))))
        if r.random() < 0.15:
            out.append(self.block(r.choice(("comments", "share", "aside", "footer"))))
        inner = "".join(out)
        if r.random() < 0.25:
            inner = f'<div class="{r.choice(NAMES["main"].split())}">{inner}</div>'
        return inner if r.random() < 0.06 else self.wrap("main", inner, 0.75)

    def page(self) -> str:
        r = self.r
        if r.random() < 0.04:
            return "".join(f"<p>\x02{self.paragraph()}\x03</p>" for _ in range(r.randint(1, 6)))
        top = [self.block(p) for p in ("header", "nav", "ad", "notice", "form", "nav", "ad") if r.random() < 0.4]
        r.shuffle(top)
        left = [self.block(p) for p in ("aside", "ad", "nav") if r.random() < 0.15]
        right = [self.block(p) for p in ("share", "comments", "aside", "form", "comments", "ad", "notice") if r.random() < 0.3]
        middle = "".join([*left, self.article(), *right])
        if r.random() < 0.5:
            middle = f'<{r.choice(("div", "div", "main"))}{r.choice(("", "", " class=container", " id=wrapper", " class=layout", " class=content"))}>{middle}</div>'
        low = [self.block(p) for p in ("notice", "nav", "footer", "footer", "ad") if r.random() < 0.4]
        return f'<!DOCTYPE html><html><head><title>{self.words(5)}</title><script>var a="<p>";</script></head><body>{"".join([*top, middle, *low])}' + ("</body></html>" if r.random() < 0.8 else "")


def weak_labels(forest):
    """For the nodes of real pages: (whether the page has a landmark, whether the node has main text in it)."""
    import numpy as np

    from grafloom.llm.dom import KINDS, TEXT

    kind, end, parent = (np.array(x, np.int64) for x in (forest.kind, forest.end, forest.parent))
    names: dict[int, set[str]] = {}
    from grafloom.llm.dom import words_of

    main = {w for n in NAMES["main"].split() for w in words_of(n)}
    outside = {w for k, v in NAMES.items() if k != "main" for n in v.split() for w in words_of(n)} - main
    for at, w in forest.names:
        names.setdefault(at, set()).add(w)
    state = np.zeros(len(kind), np.int64)  # 0 before a landmark, 1 in it, 2 in a part of it that is no main text
    for k in range(len(kind)):
        above = state[parent[k]] if parent[k] >= 0 else 0
        if above == 1 and (KINDS[kind[k]] in OUTSIDE or names.get(k, set()) & outside):
            above = 2
        elif above == 0 and KINDS[kind[k]] in ("article", "main"):
            above = 1
        state[k] = above
    good = np.append(0, np.cumsum((kind == TEXT) & (state == 1)))
    holds = good[end] > good[:-1]
    return holds[np.array(forest.roots)][np.array(forest.page)], holds


class Model:
    def __init__(self, trees, odds: dict[str, float]):
        self.trees, self.odds = trees, odds

    def features(self, forest):
        import numpy as np

        from grafloom.llm.dom import named, numbers

        return np.concatenate([numbers(forest), named(forest, self.odds)], axis=1)

    def texts(self, pages: list[str]) -> list[str]:
        """The main text of each page."""
        from grafloom.llm.dom import Forest

        forest = Forest()
        for page in pages:
            forest.add(page)
        if not pages:
            return []
        kept = decode(self.trees.log_odds(self.features(forest)).tolist(), forest.parent)
        out: list[list[str]] = [[] for _ in pages]
        for k, text in forest.text.items():
            if kept[k]:
                out[forest.page[k]].append(text)
        return ["\n".join(x) for x in out]


def decode(odds: list[float], parent: list[int]) -> list[bool]:
    """The choice of nodes of greatest sum in which every chosen node's parent is chosen."""
    best = list(odds)
    for k in range(len(best) - 1, 0, -1):
        if best[k] > 0 and parent[k] >= 0:
            best[parent[k]] += best[k]
    kept = [False] * len(best)
    for k, p in enumerate(parent):
        kept[k] = best[k] > 0 and (p < 0 or kept[p])
    return kept


def learn(pages: list[str], seed: int = 12, composed: int = COMPOSED) -> Model:
    """A model from sampled pages, the same for the same pages."""
    import math
    import random

    import numpy as np

    from grafloom.llm.boosting import Trees
    from grafloom.llm.dom import TEXT, Forest

    real = Forest()
    for page in pages:
        real.add(page)
    r = random.Random(seed)
    composer = Composer(r, list(dict.fromkeys(real.text.values())))
    made = Forest()
    for _ in range(composed):
        made.add(composer.page())
    kind, end = np.array(made.kind), np.array(made.end)
    main = np.zeros(len(kind), bool)
    for k, text in made.text.items():
        main[k] = "\x02" in text
        made.text[k] = text.replace("\x02", "").replace("\x03", "") or "-"
    good = np.append(0, np.cumsum((kind == TEXT) & main))
    told, holds = weak_labels(real) if pages else (np.zeros(0, bool), np.zeros(0, bool))
    holds_made = good[end] > good[:-1]
    sides: dict[str, list[int]] = {}
    for forest, known, label in ((real, told, holds), (made, np.ones(len(kind), bool), holds_made)):
        for k, w in set(forest.names):
            if known[k]:
                sides.setdefault(w, [0, 0])[int(label[k])] += 1
    often = sorted(sides.items(), key=lambda x: (-sum(x[1]), x[0]))[:WORDS]
    model = Model(None, {w: math.log((yes + 0.5) / (no + 0.5)) for w, (no, yes) in often if yes + no > 1})
    x = np.concatenate([model.features(real)[told], model.features(made)]) if pages else model.features(made)
    y = np.concatenate([holds[told], holds_made])
    # Pages count alike, whatever their length.
    page = np.concatenate([np.array(real.page, np.int64)[told], len(pages) + np.array(made.page, np.int64)])
    weight = 1 / np.sqrt(np.bincount(page))[page]
    model.trees = Trees(trees=80).fit(x, y.astype(float), weight / weight.mean())
    return model


def fit(pages: DataFrame, html_col: str = "html", sample: int = PAGES, longest: int = LONGEST) -> Model:
    """A model of ``sample`` pages, those with the least hashes."""
    rows = pages.select(pages[html_col].alias("h")).filter(F.length("h").between(1, longest)).withColumn("r", F.xxhash64("h"))
    chosen = rows.orderBy("r", "h").limit(sample).coalesce(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_model()
        found = [x for b in batches for x in zip(b.column("r").to_pylist(), b.column("h").to_pylist())]
        model = learn([h for _, h in sorted(found)])
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["m"])

    fitted = chosen.mapInArrow(run, "m binary").first()
    return pickle.loads(fitted.m) if fitted else learn([])


def main_texts(pages: DataFrame, model: Model | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars) of each page."""
    model = model or fit(pages, html_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_model()
        for part in steps(batches, "h"):
            texts = model.texts([h or "" for h in part.column("h").to_pylist()])
            yield pa.RecordBatch.from_arrays([part.column("i"), part.column("u"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["i", "u", "text", "n_chars"])

    kinds = [pages.schema[c].dataType.simpleString() for c in (id_col, url_col)]
    rows = pages.select(pages[id_col].alias("i"), pages[url_col].alias("u"), pages[html_col].alias("h"))
    return rows.mapInArrow(run, f"i {kinds[0]}, u {kinds[1]}, text string, n_chars long").withColumnsRenamed({"i": id_col, "u": url_col})
