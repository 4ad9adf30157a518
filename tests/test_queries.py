"""Every query with SQL equals it on the smallest tables; plans are what they should be."""

import glob
import os

import pandas
import pytest

from grafloom.plans import registry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")


def canonical(frame):
    def text(x):
        if pandas.isna(x):
            return "-"
        if isinstance(x, bool) or type(x).__name__ == "bool":
            return str(bool(x))
        return repr(round(float(x), 6)) if isinstance(x, (int, float)) or hasattr(x, "dtype") and x.dtype.kind in "iuf" else str(x)

    names = sorted(frame.columns)
    for c in names:
        if "datetime" in str(frame[c].dtype):
            frame[c] = frame[c].astype("datetime64[us]").astype(str)
    return names, sorted(tuple(map(text, r)) for r in frame[names].itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_equals_sql(spark, duck, name):
    got = canonical(registry.queries()[name](spark, DATA).toPandas())
    assert got == canonical(duck.sql(registry.oracle_sql()[name]).df())


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_has_rows(spark, name):
    assert registry.queries()[name](spark, DATA).limit(1).count() == 1


def plan(df):
    return df._jdf.queryExecution().toString()


def test_plans(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    assert "PushedFilters: [IsNotNull(lang), EqualTo(lang,en)]" in plan(docs.filter("lang = 'en'").select("doc_id"))
    for name in ("bm25_topk", "hybrid_topk", "retrieve_graph", "rate_limit_verdict", "scd_version"):
        text = plan(registry.queries()[name](spark, DATA))
        assert "CartesianProduct" not in text
    counts = plan(registry.queries()["token_counts"](spark, DATA))
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in counts and "Exchange" not in counts


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["item_id", "rank", "doc_id", "score"]
    assert set(registry.queries()) <= set(__spark_entry__.queries()) and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    for name in ("like_fallback", "doc_aliases_match", "blocked_sources_antijoin", "registry_lookup", "resolve_sources", "version_chunks", "ancestor_closure", "chunk_upsert"):
        text = plan(registry.queries()[name](spark, DATA))
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text, name


def over(spark, folder, **tables):
    """The folder with each table (schema, rows) in it."""
    for name, (schema, rows) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def same_as_sql(spark, folder, name):
    import duckdb

    c = duckdb.connect()
    for f in glob.glob(f"{folder}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}/*.parquet'")
    got, want = canonical(registry.queries()[name](spark, folder).toPandas()), canonical(c.sql(registry.oracle_sql()[name]).df())
    assert got == want
    return want[1]


def test_pages_of_one_url_are_verified_each(spark, tmp_path):
    rows = [(1, "u", "x" * 3), (2, "u", "x" * 4), (3, "u", "x" * 5), (700, "u", "x" * 6), (7, "v", "x" * 9), (8, None, "x" * 9), (9, "w", None), (None, "n", "x")]
    rows += [(10, "w", "x" * 3), (10, "z", "x" * 4), (10, "z", "x" * 4)]
    folder = over(spark, tmp_path, pages=("page_id long, url string, html string", rows))
    assert len(same_as_sql(spark, folder, "reverify_oldest")) == 7 + 9


def test_titles_of_odd_texts_are_those_of_sql(spark, tmp_path):
    texts = [None, "", " \n\t", "---\n===\nx", "----\n" * 12 + "late", "Căn cứ Luật\nsau", "Tên\nChương I\nĐiều 1. Một", "ßA STRAßE!! ßB", "\u0130STANBUL ΟΔΟΣ", "\u00a0 a\u00a0\u2003b\u3000", "a\x0b\x0bb\x85", "--\u2028\nb", "---\x85\nb", "...\r\nb\r\nc", "a\n\nb\nc\nd", "\n" * 20 + "x", "__", "SHOUTING. LOUD\nMORE"]
    rows = [(k, x, "en", "src-1", 1) for k, x in enumerate(texts)] + [(99, None, "en", None, None)]
    folder = over(spark, tmp_path, documents=("doc_id long, text string, lang string, source string, n_chars long", rows))
    assert len(same_as_sql(spark, folder, "doc_titles")) == len(texts) + 1
