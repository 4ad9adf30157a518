"""Database scans: types, ranges, pushed predicates, and what Spark keeps."""

import json
import sqlite3

import pytest
from pyspark.sql import functions as F

from grafloom.sources import sqlite
from grafloom.sources.files import eval_samples

ROWS = [(k, f"t{k % 7}" if k % 5 else None, k / 4, bytes([k % 256]), k % 3) for k in range(1, 2001)]


@pytest.fixture(scope="module")
def path(tmp_path_factory):
    p = str(tmp_path_factory.mktemp("db") / "a b.db")
    c = sqlite3.connect(p)
    c.execute('CREATE TABLE "my ""t" (id INTEGER PRIMARY KEY, name VARCHAR(9) COLLATE NOCASE, x REAL, b BLOB, "group" INT)')
    c.executemany('INSERT INTO "my ""t" VALUES (?, ?, ?, ?, ?)', ROWS)
    c.execute("CREATE TABLE pairs (a TEXT, b INTEGER, PRIMARY KEY (a, b)) WITHOUT ROWID")
    c.executemany("INSERT INTO pairs VALUES (?, ?)", [("x", 1), ("y", 2)])
    c.execute("CREATE TABLE odd (n INTEGER, t TEXT)")
    c.executemany("INSERT INTO odd VALUES (?, ?)", [(1, "a"), ("word", "B"), (None, b"raw"), (2.5, "b"), (4, None)])
    c.execute("CREATE TABLE hollow (a TEXT)")
    c.commit()
    c.close()
    return p


def rows(df):
    return sorted((tuple(bytes(v) if isinstance(v, bytearray) else v for v in r) for r in df.collect()), key=str)


def test_a_scan_equals_the_rows(spark, path):
    df = sqlite.sqlite_table(spark, path, 'my "t', ranges=7, least=100)
    assert df.dtypes == [("id", "bigint"), ("name", "string"), ("x", "double"), ("b", "binary"), ("group", "bigint")]
    assert rows(df) == sorted(ROWS, key=str) and df.rdd.getNumPartitions() == 7
    assert rows(sqlite.sqlite_table(spark, path, "pairs")) == [("x", 1), ("y", 2)]
    assert sqlite.sqlite_table(spark, path, "hollow").count() == 0


@pytest.mark.parametrize("condition", ["id > 1500 AND id <= 1777", "name = 'T3'", "name = 't3'", "name IN ('t1', 't2', 'zz')", "name LIKE 't4%'", "name IS NULL", "name IS NOT NULL AND `group` = 2", "x >= 100.5", "id = 5 OR name = 't6'", "name >= 't5'", "NOT (id < 1990)", "id + 1 = 7", "id IN (3, 4, 9999999999)"])
def test_predicates_mean_what_they_mean_in_spark(spark, path, condition):
    df = sqlite.sqlite_table(spark, path, 'my "t')
    plain = spark.createDataFrame(ROWS, df.schema)
    assert rows(df.filter(condition)) == rows(plain.filter(condition))


def test_predicates_are_pushed_into_the_scan(spark, path):
    reader = sqlite.SqliteSource({"path": path, "dbtable": 'my "t'}).reader(sqlite.SqliteSource({"path": path, "dbtable": 'my "t'}).schema())
    left = list(reader.pushFilters([sqlite.GreaterThan(("id",), 1900), sqlite.EqualTo(("name",), "t3"), sqlite.EqualTo(("x",), 1.0), sqlite.EqualTo(("id",), "5")]))
    assert [type(f).__name__ for f in left] == ["EqualTo", "EqualTo"] and len(reader.where) == 2
    read = sum(b.num_rows for p in reader.partitions() for b in reader.read(p))
    assert read == sum(1 for r in ROWS if r[0] > 1900 and r[1] == "t3")
    plan = sqlite.sqlite_table(spark, path, 'my "t').filter("id > 1900")._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    assert "Filter (" not in plan.replace("PushedFilters", "")


def test_values_of_other_types(spark, path):
    df = sqlite.sqlite_table(spark, path, "odd")
    plain = spark.createDataFrame([(1, "a"), (None, "B"), (None, None), (None, "b"), (4, None)], "n long, t string")
    for condition in ("true", "n IS NULL", "n > 0", "n IS NOT NULL", "t = 'b'", "t IS NULL", "t < 'a'"):
        assert rows(df.filter(condition)) == rows(plain.filter(condition)), condition
    with pytest.raises(Exception, match="is no bigint"):
        sqlite.sqlite_table(spark, path, "odd", mode="failfast").collect()
    for bad in ((path, "missing"), (path + "x", "odd"), (path + "*.none", "odd")):
        with pytest.raises(Exception):
            sqlite.sqlite_table(spark, *bad).collect()


def test_written_files_are_read_as_one_table(spark, tmp_path):
    df = spark.range(500).repartition(3).select("id", F.concat(F.lit("n"), "id").alias("s"), (F.col("id") / 2).alias("x"), (F.col("id") % 2 == 0).alias("even"), F.lit("2024-01-02 03:04:05").cast("timestamp_ntz").alias("at"))
    for _ in range(2):  # a repeated write replaces the files
        files = sqlite.write_sqlite(df, str(tmp_path / "out"), "t")
    assert files == ["part-00000.db", "part-00001.db", "part-00002.db"] and sorted(p.name for p in (tmp_path / "out").iterdir()) == files
    again = sqlite.sqlite_table(spark, f"{tmp_path}/out/*.db", "t")
    assert rows(again) == rows(df.select("id", "s", "x", F.col("even").cast("long"), F.col("at").cast("string")))


def test_labelled_questions_in_three_forms(spark, tmp_path):
    samples = [{"id": f"q{k}", "question": f"why {k}", "relevant_contexts": [{"chunk_id": f"c{k}"}], "ragas_fields": {"user_input": "u", "retrieved_contexts": ["x"]}} for k in range(3)]
    (tmp_path / "a.json").write_text(json.dumps(samples))
    (tmp_path / "a.jsonl").write_text("\n".join(map(json.dumps, samples)))
    c = sqlite3.connect(str(tmp_path / "a.db"))
    c.execute("CREATE TABLE samples (id TEXT, question TEXT, relevant_contexts TEXT, ragas_fields TEXT)")
    c.executemany("INSERT INTO samples VALUES (?, ?, ?, ?)", [(s["id"], s["question"], json.dumps(s["relevant_contexts"]), json.dumps(s["ragas_fields"])) for s in samples])
    c.commit()
    c.close()
    one, two, three = (eval_samples(spark, str(tmp_path / f"a.{x}")).collect() for x in ("json", "jsonl", "db"))
    assert one == two == three and [r.id for r in one] == ["q0", "q1", "q2"] and one[1].relevant_contexts[0].chunk_id == "c1"
    assert [r.id for r in eval_samples(spark, str(tmp_path / "a.db"), 1, 1).collect()] == ["q1"]
