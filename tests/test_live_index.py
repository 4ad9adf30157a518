"""Tables in parts and the index that follows its documents: only what is touched is written, any split gives one index."""

import os
import random
from urllib.parse import urlparse

import pytest
from pyspark.sql import functions as F

from grafloom.operators.chunking import sliding
from grafloom.operators.lexical import document_frequency, postings
from grafloom.operators.live_index import LiveIndex
from grafloom.operators.term_index import TermIndex
from grafloom.sources.store import Store, Table, hashed
from grafloom.streaming.incremental import index_writer

VERSIONS = "doc_id long, seq long, text string, removed boolean"
ROWS = {"rows": Table("k long, v string", hashed("k", 8)), "days": Table("d date, v string", "d")}


def files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(urlparse(path).path) for f in names if f.endswith(".parquet") and "/runs/" in d}


def test_upsert_writes_touched_parts_only(spark, tmp_path):
    path = str(tmp_path / "s")
    store = Store(spark, path, ROWS)
    store.upsert("rows", spark.range(200).select(F.col("id").alias("k"), F.lit("old").alias("v")), "k")
    before, runs = files(path), {p: store.runs("rows", p) for p in store.parts("rows")}
    new = spark.createDataFrame([(5, "new"), (700, "new")], ROWS["rows"].schema)
    written = store.upsert("rows", new, "k")
    assert written == store.touched("rows", new) and 1 <= len(written) <= 2
    assert {p for p in runs if store.runs("rows", p) != runs[p]} == set(written)
    after = files(path)
    assert all(after[f] == t for f, t in before.items())
    assert {f.split("part=")[1].split("/")[0] for f in set(after) - set(before)} == set(written)
    got = {r.k: r.v for r in Store(spark, path, ROWS).read("rows").collect()}
    assert got == {k: "old" for k in range(200)} | {5: "new", 700: "new"}


def test_null_keys_repeats_and_empty_changes(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), ROWS)
    assert store.read("rows").count() == 0 and store.upsert("rows", spark.createDataFrame([], ROWS["rows"].schema), "k") == []
    store.upsert("rows", spark.createDataFrame([(None, "a"), (1, None)], ROWS["rows"].schema), "k", ("s", 0))
    store.upsert("rows", spark.createDataFrame([(None, "b")], ROWS["rows"].schema), "k", ("s", 1))
    store.upsert("rows", spark.createDataFrame([(None, "late")], ROWS["rows"].schema), "k", ("s", 1))
    assert sorted(map(tuple, store.read("rows").collect()), key=str) == [(1, None), (None, "b")]


def test_retention_drops_whole_days_unread(spark, tmp_path):
    path = str(tmp_path / "s")
    store = Store(spark, path, ROWS)
    days = spark.sql("SELECT date_add(date'2024-01-01', CAST(id % 10 AS INT)) AS d, CAST(id AS STRING) AS v FROM range(100)")
    change = store.change()
    change.append("days", days.unionByName(spark.sql("SELECT CAST(NULL AS DATE) AS d, 'x' AS v")))
    change.commit()
    before = files(path)
    gone = store.retain("days", "2024-01-06", F.col("v").cast("int") >= 50)
    assert gone == [f"2024-01-0{k}" for k in range(1, 6)]
    assert {f.split("part=")[1].split("/")[0] for f in set(files(path)) - set(before)} == {"2024-01-06"}
    assert sorted(r.v for r in store.read("days").collect()) == sorted([str(k) for k in range(100) if k % 10 > 5 or k % 10 == 5 and k >= 50] + ["x"])


def test_a_change_that_breaks_is_not_seen_and_a_second_writer_is_refused(spark, tmp_path):
    path = str(tmp_path / "s")
    store = Store(spark, path, ROWS)
    store.upsert("rows", spark.createDataFrame([(1, "a")], ROWS["rows"].schema), "k")
    pinned, other = Store(spark, path, ROWS), Store(spark, path, ROWS)
    change = store.change()
    change.append("rows", spark.createDataFrame([(2, "b")], ROWS["rows"].schema))
    with pytest.raises(ValueError):
        change.replace("rows", spark.createDataFrame([(3, "c")], ROWS["rows"].schema), [])
    assert [tuple(r) for r in Store(spark, path, ROWS).read("rows").collect()] == [(1, "a")]
    store.upsert("rows", spark.createDataFrame([(1, "z")], ROWS["rows"].schema), "k")
    assert [tuple(r) for r in pinned.read("rows").collect()] == [(1, "a")]
    with pytest.raises(RuntimeError):
        other.upsert("rows", spark.createDataFrame([(4, "d")], ROWS["rows"].schema), "k")
    assert [tuple(r) for r in Store(spark, path, ROWS, 1).read("rows").collect()] == [(1, "a")]


def test_another_layout_is_refused(spark, tmp_path):
    path = str(tmp_path / "s")
    Store(spark, path, ROWS).upsert("rows", spark.createDataFrame([(1, "a")], ROWS["rows"].schema), "k")
    with pytest.raises(ValueError):
        Store(spark, path, ROWS | {"rows": Table(ROWS["rows"].schema, hashed("k", 4))})


def versions(n=60, seed=5):
    r = random.Random(seed)
    words = [f"w{k}" for k in range(40)]
    rows = []
    for doc in range(n):
        for seq in range(r.randrange(1, 4)):
            text = r.choice([None, "", " ".join(r.choice(words) for _ in range(r.randrange(1, 30)))]) if r.random() < 0.2 else " ".join(r.choice(words) for _ in range(r.randrange(1, 30)))
            rows.append((doc, seq, text, r.random() < 0.1))
    rows.append((n, 0, " ".join(f"w{k % 7}" for k in range(900)), None))
    rows += rows[:5]
    r.shuffle(rows)
    return rows


def held(rows):
    best = {}
    for doc, seq, text, removed in rows:
        best[doc] = max(best.get(doc, (-1,)), (seq, not removed, text is not None, text or ""))
    return [(doc, text if has else None) for doc, (_, live, has, text) in best.items() if live]


def state(index):
    chunks = sorted((r.doc_id, r.ordinal, tuple(r.words)) for r in index.chunks().collect())
    df = sorted((r.term, r.df) for r in index.frequencies().collect())
    return chunks, df, tuple(index.corpus().first())


def ranked(index, terms):
    return sorted((r.item_id, r.doc_id, round(r.score, 9)) for r in index.bm25(terms, "item_id").collect())


def test_any_split_gives_the_index_of_one_build(spark, tmp_path):
    rows = versions()
    docs = spark.createDataFrame(held(rows), "doc_id long, text string")
    terms = spark.createDataFrame([(q, f"w{(q * 7 + k) % 45}") for q in range(4) for k in range(3)], "item_id int, term string")
    whole = TermIndex.build(docs, "doc_id", F.col("text"))
    want = (
        sorted((r.doc_id, r.ordinal, tuple(r.words)) for r in sliding(docs.filter("text is not null")).collect()),
        sorted((r.term, r.df) for r in document_frequency(postings(docs, "doc_id", F.col("text"))).collect()),
        tuple(whole.corpus.first()),
    )
    for k, cuts in enumerate(([], [40], [1, 60, 61])):
        index = LiveIndex(spark, str(tmp_path / f"i{k}"), 4)
        bounds = [0, *cuts, len(rows)]
        for number, (a, b) in enumerate(zip(bounds, bounds[1:])):
            part = spark.createDataFrame(rows[a:b], VERSIONS)
            index.apply(part, ("s", number))
            index.apply(part, ("s", number))
        assert state(index) == want
        assert ranked(index.terms(), terms) == ranked(whole, terms)
    every = [sorted(map(tuple, x.every_cover(terms, "item_id").collect())) for x in (index.terms(), whole)]
    assert every[0] == every[1] and every[0]
    pinned = index.terms()
    assert index.compact(most=1) and index.compact(most=1) == {}
    assert state(LiveIndex(spark, str(tmp_path / "i2"), 4)) == want
    assert ranked(index.terms(), terms) == ranked(pinned, terms) == ranked(whole, terms)


def test_equal_numbers_are_settled_alike_in_one_batch_and_in_two(spark, tmp_path):
    a, b = [(1, 3, "x y z", False)], [(1, 3, "x y x", False), (None, 1, "lost", False)]
    one, two, turned = (LiveIndex(spark, str(tmp_path / f"n{k}"), 2) for k in range(3))
    one.apply(spark.createDataFrame(a + b, VERSIONS))
    for index, parts in ((two, (a, b)), (turned, (b, a))):
        for part in parts:
            index.apply(spark.createDataFrame(part, VERSIONS))
    assert state(one) == state(two) == state(turned) and state(one)[2][0] == 1


def test_questions_open_their_terms_buckets_only(spark, tmp_path):
    index = LiveIndex(spark, str(tmp_path / "b"), 8)
    index.apply(spark.createDataFrame(versions(), VERSIONS))
    terms = spark.createDataFrame([(1, "w3")], "item_id int, term string")
    bucket = index.store.touched("postings", terms)
    read = index.terms().opened(terms).inputFiles()
    assert len(bucket) == 1 and read and all(f"/postings/part={bucket[0]}/" in f for f in read)


def test_a_stream_that_is_started_again(spark, tmp_path):
    rows, folder = versions(20, 9), tmp_path
    for k, part in enumerate((rows[:15], rows[15:])):
        spark.createDataFrame(part, VERSIONS).coalesce(1).write.parquet(f"{folder}/in/{k}")
        stream = spark.readStream.schema(VERSIONS).option("recursiveFileLookup", "true").parquet(f"{folder}/in")
        write = index_writer(spark, f"{folder}/index", f"{folder}/state", 2)
        stream.writeStream.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
    once = LiveIndex(spark, str(tmp_path / "once"), 2)
    once.apply(spark.createDataFrame(rows, VERSIONS))
    assert state(LiveIndex(spark, f"{folder}/index", 2)) == state(once)
    assert LiveIndex(spark, f"{folder}/index", 2).store.state.number == 2
    assert LiveIndex(spark, f"{folder}/index", 2).documents().count() == len(held(rows))
