"""The positional term index, the vector index, published snapshots and embedders."""

import itertools
import math
import os
import random
import re
import unicodedata
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from grafloom.engine import Engine
from grafloom.functions.text import TOKEN
from grafloom.operators import ann, dense, embedding, lexical, term_index
from grafloom.operators.term_index import TermIndex
from grafloom.plans import retrieval
from grafloom.sources import sinks

DATA = "/root/testdata/sf0.01"


def texts(n=120, seed=1):
    r = random.Random(seed)
    words = [f"w{k}" for k in range(25)]
    return [(k, " ".join(["the"] * (k % 3) + r.choices(words, k=r.randint(0, 30)) + ["the", "THE-end"])) for k in range(n)]


@pytest.fixture(scope="module")
def small(spark):
    rows = [*texts(), (900, None), (901, ""), (902, "  ... ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return rows, docs, TermIndex.build(docs, "doc_id", F.col("text"))


def places(text):
    out = {}
    for k, w in enumerate(re.findall(TOKEN, (text or "").lower()), 1):
        out.setdefault(w, []).append(k)
    return out


def test_blocks_hold_all_places(small):
    rows, _, index = small
    got, heads = {}, Counter()
    for b in index.blocks.collect():
        assert b.n == len(b.docs) == len(b.tfs) == len(b.dls) == len(b.gaps) <= term_index.BLOCK and b.docs == sorted(b.docs)
        assert b.most_tf == max(b.tfs) and b.least_dl == min(b.dls)
        heads[b.term] += b.n
        for i, tf, dl, gaps in zip(b.docs, b.tfs, b.dls, b.gaps):
            got[i, b.term] = (list(itertools.accumulate(gaps)), tf, dl)
    want = {(i, t): (p, len(p), sum(map(len, places(text).values()))) for i, text in rows for t, p in places(text).items()}
    assert got == want and heads == Counter(t for _, t in want)
    assert index.corpus.first().n == len(rows)


def test_bm25_of_the_index_equals_that_of_texts(spark, small):
    _, docs, index = small
    terms = spark.createDataFrame([(1, "the"), (1, "w3"), (2, "w7"), (3, "nowhere"), (4, "end"), (4, "w1")], "item_id long, term string")
    key = lambda df: {(r.item_id, r.doc_id): round(r.score, 9) for r in df.collect()}
    assert key(index.bm25(terms, "item_id")) == key(lexical.bm25(docs, terms))


def brute_covers(lists):
    """All shortest stretches, by trying every pair of ends."""
    every = sorted(p for x in lists for p in x)
    holds = lambda a, b: all(any(a <= p <= b for p in x) for x in lists)
    found = [(a, b) for a in every for b in every if a <= b and holds(a, b)]
    return sorted((a, b, sum(a <= p <= b for p in every)) for a, b in found if not any((c, d) != (a, b) and a <= c and d <= b for c, d in found))


def test_covers_equal_all_stretches():
    r = random.Random(4)
    for _ in range(200):
        spots = r.sample(range(1, 40), r.randint(3, 14))
        lists = [[] for _ in range(r.randint(1, 3))]
        for k, p in enumerate(spots):
            lists[k % len(lists)].append(p)
        gaps = [np.diff(sorted(x), prepend=0).tolist() for x in lists]
        assert sorted(term_index.covers(gaps)) == brute_covers(lists)


def test_cover_density(spark, small):
    rows, _, index = small
    asked = {1: ["w1", "w2"], 2: ["the", "end"], 3: ["w3"], 4: ["w4", "nowhere"], 5: ["w1", "w2", "w3"]}
    terms = spark.createDataFrame([(q, t) for q, ts in asked.items() for t in ts], "item_id long, term string")
    every, some = {}, {}
    for q, ts in asked.items():
        for i, text in rows:
            p = places(text)
            if all(t in p for t in ts):
                c = brute_covers([p[t] for t in ts])
                w = sum(0.1 / (1 + (b - a) - (m - 1)) for a, b, m in c)
                every[q, i] = (len(c), round(w / (w + 1), 9))
            if n := sum(len(p.get(t, ())) for t in ts):
                some[q, i] = round(n * 0.1 / (n * 0.1 + 1), 9)
    assert {(r.item_id, r.doc_id): (r.covers, round(r.rank_cd, 9)) for r in index.every_cover(terms, "item_id").collect()} == every
    assert {(r.item_id, r.doc_id): round(r.rank_cd, 9) for r in index.any_cover(terms, "item_id").collect()} == some
    first = index.preselected(terms, "item_id", 5).collect()
    for q in asked:
        best = sorted((-s, i) for (item, i), s in some.items() if item == q)[:5]
        assert {r.doc_id for r in first if r.item_id == q} == {i for _, i in best}
        assert [r.score for r in sorted(first, key=lambda r: r.rank) if r.item_id == q] == sorted((r.score for r in first if r.item_id == q), reverse=True)


def test_questions_open_only_the_folders_of_their_terms(spark, small):
    _, _, index = small
    terms = spark.createDataFrame([(1, "w3")], "item_id long, term string")
    folder = terms.select(term_index.bucket(F.col("term")).alias("b")).first().b
    plan = index.bm25(terms, "item_id")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [bucket" in plan
    assert "text#" not in plan.split("== Physical Plan ==")[1]
    read = index.opened(terms)
    assert {f.rsplit("bucket=", 1)[1].split("/")[0] for f in read.inputFiles()} >= {str(folder)}
    opened = spark.read.parquet(*[f for f in index.blocks.inputFiles() if f"bucket={folder}/" in f])
    assert 0 < opened.count() < index.blocks.count()


def test_a_common_term_is_dealt_to_several_tasks(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("every "), F.col("id")).alias("text"))
    index = TermIndex.build(docs, "doc_id", F.col("text"))
    files = {r.f: r.n for r in index.blocks.filter("term = 'every'").groupBy(F.input_file_name().alias("f")).agg(F.sum("n").alias("n")).collect()}
    assert sum(files.values()) == 3000 and len(files) > 1 and max(files.values()) < 2500


def test_tokens_are_those_of_the_pattern():
    import pyarrow as pa

    r = random.Random(2)
    pool = "aZ09 _-.\u00bf\u00c0\u00d7\u07ff\u0800\u1000\u1eb7\u1ef9\u1efa\u1fff\u2000\ud7ff\U0001f600"
    texts = ["", "ab", "ab", "", *("".join(r.choices(pool, k=r.randint(0, 12))) for _ in range(3000)), "x"]
    for held in (pa.array(texts), pa.array(["", ""]), pa.array([], pa.string()), pa.array(["skip", *texts]).slice(1)):
        found, many = term_index.tokens_of(held)
        want = [re.findall(TOKEN, x) for x in held.to_pylist()]
        assert found.to_pylist() == [t for ts in want for t in ts] and many.tolist() == [len(ts) for ts in want]


def test_pieces_are_bounded_and_whole(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(term_index, "TEXT", 10)
    texts = ["abc", "x" * 30, "", "abcdef", "abcd", "e", *["ab"] * 12]
    found = list(term_index.pieces(iter([pa.RecordBatch.from_pydict({"w": pa.array(texts, pa.string())}), pa.RecordBatch.from_pydict({"w": pa.array([], pa.string())})])))
    assert [x for b in found for x in b.column("w").to_pylist()] == texts
    assert all(b.num_rows == 1 or sum(map(len, b.column("w").to_pylist())) <= 10 for b in found)


def test_postings_are_packed_before_they_are_exchanged(spark):
    """Blocks come from batches of documents, so their exchange carries a row for a term, not for a posting."""
    docs = spark.range(2000).select(F.col("id").alias("doc_id"), F.lit("a b c d e").alias("text"))
    rows = term_index.blocks(docs, "doc_id", F.col("text"))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.index("MapInArrow") > plan.index("hashpartitioning(bucket") and "rangepartitioning" not in plan
    found = rows.agg(F.sum("n"), F.count(F.lit(1))).first()
    assert found[0] == 10000 and found[1] < 500


@pytest.mark.parametrize("form", [lexical.PLAIN, lexical.FULLTEXT, lexical.GRAPH])
def test_the_best_of_the_index_are_those_of_all(spark, small, form, monkeypatch):
    """Also by small pieces and with many ties; a question's places are those of all scores."""
    monkeypatch.setattr(term_index, "PAIRS", 7)
    rows, docs, _ = small
    docs = docs.union(spark.createDataFrame([(1000 + k, "w3 \u1ebd e w5") for k in range(40)] + [(None, "w3 w3 \u1ebd")], "doc_id long, text string")).repartition(5)
    index = TermIndex.build(docs, "doc_id", F.col("text"), positions=False)
    asked = spark.createDataFrame([(1, "the", 1), (1, "w3", 2), (2, "w7", 1), (3, "nowhere", 1), (4, "end", 1), (4, "w1", 3), (5, "e", 1), (5, "w5", 1)], "item_id long, term string, times long")
    key = lambda df: sorted((r.item_id, r["rank"], r.doc_id or -1, round(r.score, 9)) for r in df.collect())
    for k in (1, 5, 300):
        assert key(index.best(asked, "item_id", k, form)) == key(lexical.top(index.bm25(asked, "item_id", form), k, "item_id", "doc_id"))
    if form.accents:
        plain = asked.drop("times")
        few = index.preselected(plain, "item_id", 6)
        chosen = lexical.top(index.any_cover(plain, "item_id"), 6, "item_id", "doc_id", "rank_cd").drop("rank").fillna(-1, "doc_id")
        want = lexical.top(chosen.join(index.bm25(plain, "item_id", form).fillna(-1, "doc_id"), ["item_id", "doc_id"]), 6, "item_id", "doc_id")
        assert form != lexical.PLAIN or key(few) == key(want)


def test_an_index_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    terms = spark.createDataFrame([(1, "a")], "item_id long, term string")
    index = TermIndex.build(empty, "doc_id", F.col("text"))
    assert not index.bm25(terms, "item_id").count() and not index.every_cover(terms, "item_id").count()


# vectors


def clouds(n, dim=16, seed=5):
    r = np.random.default_rng(seed)
    middle = r.normal(size=(12, dim)) * 3
    return [(int(k), (middle[k % 12] + r.normal(size=dim)).tolist()) for k in range(n)]


SHAPE = "vec_id long, embedding array<double>"


def exact(rows, asked, k):
    unit = lambda v: np.array(v) / np.linalg.norm(v)
    ids, m = np.array([i for i, _ in rows]), np.array([unit(v) for _, v in rows])
    out = {}
    for q, v in asked:
        s = m @ unit(v)
        out[q] = [int(ids[x]) for x in np.lexsort((ids, -np.round(s, 9)))[:k]]
    return out


def answers(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.item_id, r.rank)):
        out.setdefault(r.item_id, []).append(r.vec_id)
    return out


@pytest.mark.parametrize("sent", [8192, 3])
def test_vectors_are_found_by_few_and_many_questions(spark, monkeypatch, sent):
    monkeypatch.setattr(ann, "SENT", sent)
    monkeypatch.setattr(ann, "BLOCK", 64)
    rows = clouds(1500)
    odd = [(5000, None), (5001, [None] * 16), (5002, [0.0] * 16), (5003, [1.0, 2.0]), (7, rows[7][1])]
    index = ann.VectorIndex.build(spark.createDataFrame(rows + odd, SHAPE))
    assert index.blocks.agg(F.sum("n")).first()[0] == 1501  # all but the four that take no part
    asked = spark.createDataFrame([(i, v) for i, v in clouds(60, seed=5)] + odd[:4], "item_id long, embedding array<double>")
    want = exact(rows + odd[4:], clouds(60, seed=5), 10)
    got = answers(index.search(asked, 10))
    assert set(got) == set(want)
    hit = sum(len(set(got[q]) & set(want[q])) for q in want) / sum(len(set(x)) for x in want.values())
    share = index.share_read(asked)
    assert hit >= 0.95 and share < 0.5
    assert answers(index.search(asked, 10, probes=10_000)).keys() == want.keys()


def test_all_lists_without_codes_are_exact(spark):
    rows = clouds(300, seed=9)
    index = ann.VectorIndex.build(spark.createDataFrame(rows, SHAPE), lists=7, coded=False)
    asked = spark.createDataFrame(rows[:20], "item_id long, embedding array<double>")
    assert answers(index.search(asked, 5, probes=7)) == exact(rows, rows[:20], 5)


def test_a_vector_index_is_opened_again(spark, tmp_path):
    rows = clouds(200, seed=3)
    docs = spark.createDataFrame(rows, SHAPE)
    ann.VectorIndex.build(docs, path=str(tmp_path / "v"))
    again = ann.VectorIndex.open(spark, str(tmp_path / "v"))
    asked = docs.limit(5).withColumnRenamed("vec_id", "item_id")
    assert all(q in found for q, found in answers(again.search(asked, 3)).items())
    empty = ann.VectorIndex.build(docs.limit(0))
    assert empty.model is None and not empty.search(asked, 3).count()


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
def test_recall_on_the_given_vectors(spark):
    exact_ = {(r.item_id, r.doc_id) for r in retrieval.dense_topk_multi(spark, DATA).collect()}
    got = {(r.item_id, r.doc_id) for r in retrieval.ann_topk(spark, DATA).collect()}
    assert len(got & exact_) >= 0.95 * len(exact_)


# snapshots and embedders


LINES = ["Luật thử", "Chương I. Chung", "Điều 1. Phạm vi điều chỉnh của bộ luật", "1. Tiêu chuẩn lao động và quyền"]


def lines(spark, *more):
    return spark.createDataFrame([("law", k, t) for k, t in enumerate([*LINES, *more])], "doc_id string, n int, line string")


def test_a_broken_write_leaves_the_old_index(spark, tmp_path, monkeypatch):
    path, engine = str(tmp_path / "i"), Engine(spark, dim=16)
    first, second = engine.build(lines(spark)), engine.build(lines(spark, "Điều 2. Thử việc và hợp đồng"))
    name = first.write(path)
    pinned = engine.open(path)
    before = {r.chunk_id for r in pinned.chunks.collect()}
    for broken in ("docs", "edges", "corpus"):
        tables = {"docs": second.docs, "nodes": second.nodes, "edges": second.edges, "chunks": second.chunks, "postings": second.terms.blocks, "corpus": second.terms.corpus}
        tables[broken] = tables[broken].withColumn("boom", F.raise_error(F.lit("sink")).cast("string"))
        with pytest.raises(Exception, match="sink"):
            sinks.write_index(tables, path, second.embedder.meta())
        assert {r.chunk_id for r in engine.open(path).chunks.collect()} == before
    second.write(path)
    after = {r.chunk_id for r in engine.open(path).chunks.collect()}
    assert len(after) > len(before) and {r.chunk_id for r in pinned.chunks.collect()} == before
    assert {r.chunk_id for r in engine.open(path, name).chunks.collect()} == before
    assert [n for n, _, _ in sinks.manifest(spark, path)] == [2, 1]
    with pytest.raises(ValueError):
        engine.open(path, "none")
    with pytest.raises(ValueError):
        engine.open(str(tmp_path / "nothing"))


def test_another_embedder(spark, tmp_path):
    load = lambda: lambda batch: [[float(len(t)), 1.0, float(t.count("a"))] for t in batch]
    own = embedding.loaded("lengths", "7", 3, load)
    index = Engine(spark, embedder=own).build(lines(spark))
    assert {len(r.vector) for r in index.chunks.select("vector").collect()} == {3}
    asked = spark.createDataFrame([(1, "a question about phạm vi")], "query_id long, text string")
    assert index.retrieve(asked, "dense", 2).count() == 2
    index.write(str(tmp_path / "i"))
    assert Engine(spark, embedder=own).open(str(tmp_path / "i")).chunks.count() == index.chunks.count()
    for other in (embedding.loaded("lengths", "8", 3, load), embedding.hashed(3)):
        with pytest.raises(ValueError):
            Engine(spark, embedder=other).open(str(tmp_path / "i"))


def test_texts_that_a_model_cannot_take(spark):
    def load():
        def run(batch):
            if any("bad" in t for t in batch):
                raise RuntimeError("no")
            return [[1.0, math.nan] if t == "nan" else [1.0] if t == "short" else [1.0, float(len(t))] for t in batch]

        return run

    own = embedding.loaded("m", "1", 2, load, batch=4)
    rows = [("one",), ("bad",), (None,), ("nan",), ("short",), ("three",), ("bad too",), ("x",)]
    got = [r.v for r in spark.createDataFrame(rows, "t string").coalesce(1).select(own.column(F.col("t")).alias("v")).collect()]
    assert got == [[1.0, 3.0], None, None, None, None, [1.0, 5.0], None, [1.0, 1.0]]


def test_dense_search_agrees(spark, monkeypatch):
    rows = clouds(150, seed=8)
    vectors, asked = spark.createDataFrame(rows, SHAPE), spark.createDataFrame(rows[:60], "item_id long, embedding array<double>")
    assert answers(dense.similarities(vectors, asked, 5)) == exact(rows, rows[:60], 5)
    # Many questions and one run of vectors: the blocks of questions are dealt to several tasks.
    for name, value in (("SENT", 3), ("BLOCK", 4)):
        monkeypatch.setattr(dense, name, value)
    found = dense.similarities(vectors, asked, 5)
    assert answers(found) == exact(rows, rows[:60], 5)
    assert "hashpartitioning(part" in found._jdf.queryExecution().toString() and "salt" in found._jdf.queryExecution().toString()
    monkeypatch.setattr(dense, "RUN", 40)
    assert answers(dense.similarities(vectors, asked, 5)) == exact(rows, rows[:60], 5)


def test_full_text_takes_all_spellings_as_one_word(spark):
    texts = {0: "thuế thu nhập", 1: "thue thuế THUẾ đất", 2: "đất đai", 3: None, 4: "", 5: "thu nhap khac nua", 6: "xa la"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    asked = {1: ["thuế", "thu", "thuế"], 2: ["la", "đat"], 3: ["khong"]}
    questions = spark.createDataFrame(list(asked.items()), "item_id long, k array<string>")
    for form in (lexical.FULLTEXT, lexical.GRAPH):
        fold = (lambda t: unicodedata.normalize("NFD", t.lower()).translate({0x111: "d"}).encode("ascii", "ignore").decode()) if not form.accents else str.lower
        words = {i: [fold(w) for w in (t or "").split()] for i, t in texts.items()}
        size = {i: max(len(w), 1) for i, w in words.items()}
        mean, n, want = sum(size.values()) / len(size), len(size), {}
        for q, terms in asked.items():
            for t in map(fold, terms):
                df = sum(t in w for w in words.values())
                odds = (n - df + 0.5) / (df + 0.5)
                rare = math.log(1 + odds) if form.added else max(math.log(odds), 1e-6)
                for i, w in words.items():
                    if t in w:
                        part = w.count(t) * (2.2 if form.scaled else 1) / (w.count(t) + 1.2 * (0.25 + 0.75 * size[i] / mean))
                        want[q, i] = want.get((q, i), 0) + rare * part
        terms = lexical.asked(questions, "item_id", F.col("k"), form)
        index = TermIndex.build(docs, "doc_id", F.col("text"))
        for found in (index.bm25(terms, "item_id", form), lexical.bm25(docs, terms, form=form)):
            assert {(r.item_id, r.doc_id): round(r.score, 9) for r in found.collect()} == {k: round(v, 9) for k, v in want.items()}
