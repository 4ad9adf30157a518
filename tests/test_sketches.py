"""Stored sketches merge to what one pass gives; re-verification goes oldest first and can be started again."""

import datetime as dt
import random

from pyspark.sql import functions as F

from grafloom.operators import sketches
from grafloom.streaming.reverify import SCHEMA, registry_store, reverify, waves

T0 = dt.datetime(2024, 1, 1)
ROWS = "ts timestamp, kind string, user long, value double"


def test_merged_sketches_are_near_what_all_rows_give(spark):
    r = random.Random(2)
    rows = [(T0 + dt.timedelta(hours=r.randrange(240)), r.choice("ab"), r.randrange(3000), r.gauss(0, 1)) for _ in range(20000)]
    rows += [(T0, "a", None, None), (T0, None, 1, float("nan"))]
    df = spark.createDataFrame(rows, ROWS)
    stored = sketches.by_day(df, "ts", "kind", "user", "value")
    assert stored.count() == 21
    for kind, n, keys, quantiles in sketches.merged(stored, "kind", [0.1, 0.5, 0.9]).collect():
        mine = [x for x in rows if x[1] == kind]
        users, values = {x[2] for x in mine} - {None}, sorted(x[3] for x in mine if x[3] is not None and x[3] == x[3])
        assert n == len(mine) and abs(keys - len(users)) <= 0.05 * len(users)
        assert quantiles is None if not values else all(abs(sum(v <= q for v in values) / len(values) - s) < 0.025 for q, s in zip(quantiles, (0.1, 0.5, 0.9)))
    once = sketches.merged(sketches.by_day(df.withColumn("ts", F.lit(T0)), "ts", "kind", "user", "value"), "kind", [0.5]).collect()
    assert {x.kind for x in once} == {"a", "b", None}
    assert sketches.merged(sketches.by_day(df.limit(0), "ts", "kind", "user", "value"), "kind", [0.5]).count() == 0


def laws(n=23):
    return [(f"L{k:02}", "IN_FORCE", None, None if k % 5 == 0 else T0 + dt.timedelta(days=k * 7 % n)) for k in range(n)] + [(None, "UNKNOWN", None, None)]


def test_waves_go_oldest_first(spark):
    got = [[r.code for r in w.collect()] for w in waves(spark.createDataFrame(laws(), SCHEMA), F.lit(T0 + dt.timedelta(days=15)), 4)]
    due = sorted((x for x in laws() if x[0] and (x[3] is None or x[3] < T0 + dt.timedelta(days=15))), key=lambda x: (x[3] is not None, x[3] or T0, x[0]))
    codes = [x[0] for x in due]
    assert [sorted(w) for w in got] == [sorted(codes[k : k + 4]) for k in range(0, len(codes), 4)]


def test_a_broken_job_goes_on_with_what_is_due(spark, tmp_path):
    store, seen, bound = registry_store(spark, str(tmp_path / "laws"), 4), [], F.lit(T0 + dt.timedelta(days=40))
    store.upsert("laws", spark.createDataFrame(laws(), SCHEMA), "code")

    def verify(rows, stop=None):
        seen.append(sorted(r.code for r in rows.collect()))
        if len(seen) == stop:
            raise ConnectionError
        status = F.when(F.col("code") == "L03", F.lit(None).cast("string")).when(F.col("code") == "L04", "REPLACED").otherwise("IN_FORCE")
        return rows.select("code", status.alias("status"), F.when(F.col("code") == "L04", "L99").alias("replacement_code"), F.lit(T0 + dt.timedelta(days=50)).alias("checked_at"))

    try:
        reverify(store, lambda rows: verify(rows, 2), bound, 10)
        raise AssertionError
    except ConnectionError:
        pass
    report = reverify(registry_store(spark, str(tmp_path / "laws"), 4), verify, bound, 10)
    assert [len(x) for x in seen] == [10, 10, 10, 3] and sorted(seen[1]) == sorted(seen[2]) and not set(seen[0]) & set(seen[2] + seen[3])
    assert report.checked + 10 + report.failed == 23 and report.failed == 1
    now = {r.code: r for r in registry_store(spark, str(tmp_path / "laws"), 4).read("laws").collect()}
    assert now["L04"].status == "REPLACED" and now["L04"].replaced_by == "L99" and now["L03"].verified_at == T0 + dt.timedelta(days=21)
    assert now[None].verified_at is None and len(now) == 24
