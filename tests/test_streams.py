"""Keyed state in streams: equal to the batch forms, also in parts, after a restart, and with state that goes."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from grafloom.streaming import answers, limits

T0 = dt.datetime(2024, 1, 1)


@pytest.fixture
def store(spark):
    for name, value in limits.STORE.items():
        spark.conf.set(name, value)
    yield
    for name in limits.STORE:
        spark.conf.unset(name)


def run(spark, make, schema, parts, folder):
    """The rows of a stream that is started anew for every part, from the checkpoint of the one before."""
    for k, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/in/{k}")
        stream = make(spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{folder}/in"))
        stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/out")


def requests(n=400):
    r = random.Random(3)
    at = sorted(r.randrange(6 * 3600) for _ in range(n))
    return [(k, r.choice((1, 2, None)), T0 + dt.timedelta(seconds=s)) for k, s in enumerate(at)]


def test_verdicts_of_a_stream_equal_those_of_the_batch(spark, store, tmp_path):
    rows, schema = requests(), "event_id long, user_id long, ts timestamp"
    got = run(spark, limits.verdict_stream, schema, [rows[:150], rows[150:151], rows[151:]], tmp_path)
    want = limits.verdicts(spark.createDataFrame(rows, schema))
    key = lambda df: sorted((r.event_id, r.in_minute, r.in_hour, r.allowed) for r in df.collect())
    assert key(got) == key(want) and not all(r.allowed for r in got.collect())


def test_a_stream_needs_its_state_store(spark):
    spark.conf.unset(next(iter(limits.STORE)))
    stream = spark.readStream.format("rate").load().select(F.col("value").alias("event_id"), F.lit(1).alias("user_id"), F.col("timestamp").alias("ts"))
    with pytest.raises(ValueError):
        limits.verdict_stream(stream)


def brute_answers(rows, ttl=dt.timedelta(hours=24), grace=dt.timedelta(days=7)):
    held, out = {}, []
    for key, id_, ts, kind, answer in sorted(rows, key=lambda r: (r[2], r[1])):
        e = held.get(key)
        if e and e["ends"] + grace < ts:
            e = held[key] = None
        if kind == "store":
            held[key] = {"answer": answer, "ends": ts + ttl, "hits": e["hits"] if e else 0}
        elif kind == "invalid" and e and e["ends"] > ts:
            e["ends"] = ts
        elif kind == "ask":
            hit = bool(e) and e["ends"] > ts
            if hit:
                e["hits"] += 1
            out.append((key, id_, hit, e["answer"] if hit else None, e["hits"] if hit else None))
    return sorted(out, key=lambda r: r[1])


def test_answers_of_a_stream_equal_those_of_a_table(spark, store, tmp_path):
    r = random.Random(8)
    at = sorted(r.randrange(60 * 24) for _ in range(500))
    rows = [(r.choice("abc"), k, T0 + dt.timedelta(hours=h), r.choices(("ask", "store", "invalid", "other"), (12, 2, 1, 1))[0], f"answer {k}") for k, h in enumerate(at)]
    rows += [("gap", 600, T0, "store", "x"), ("gap", 601, T0 + dt.timedelta(hours=1), "ask", None)]
    rows.sort(key=lambda x: (x[2], x[1]))
    late = [("gap", 602, T0 + dt.timedelta(days=70), "store", "y"), ("gap", 603, T0 + dt.timedelta(days=70, hours=1), "ask", None)]
    schema = "key string, id long, ts timestamp, kind string, answer string"
    got = run(spark, answers.answered, schema, [rows[:200], rows[200:], late], tmp_path)
    found = sorted(((x.key, x.id, x.hit, x.answer, x.hits) for x in got.collect()), key=lambda x: x[1])
    assert found == brute_answers(rows + late)
    assert found[-1][:5] == ("gap", 603, True, "y", 1)  # counts anew after the days of grace


def test_verdicts_hold_one_value_for_many_windows(spark, store, tmp_path, monkeypatch):
    """Subjects that share a value are counted apart, and the store is not asked once for every window."""
    monkeypatch.setattr(limits, "GROUPS", 1, raising=False)
    r = random.Random(5)
    at = sorted(r.randrange(20 * 86400) for _ in range(700))
    rows = [(k, r.choice((*range(9), None)), T0 + dt.timedelta(seconds=s)) for k, s in enumerate(at)]
    rows += [(1000 + k, k % 3, T0 + dt.timedelta(days=20, seconds=k // 6)) for k in range(120)]
    schema, seen = "event_id long, user_id long, ts timestamp", []
    for k, part in enumerate((rows[:300], rows[300:750], rows[750:])):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
        stream = limits.verdict_stream(spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in"))
        query = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
        query.awaitTermination()
        seen += [p.stateOperators[0].numRowsUpdated for p in query.recentProgress if p.stateOperators]
    assert 0 < max(seen) <= 10
    key = lambda df: sorted((x.event_id, x.in_minute, x.in_hour, x.allowed) for x in df.collect())
    assert key(spark.read.parquet(f"{tmp_path}/out")) == key(limits.verdicts(spark.createDataFrame(rows, schema)))
