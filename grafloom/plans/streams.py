"""Windowed and stateful queries: batch forms with SQL, and streams that must equal them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grafloom.plans.book import Book, table
from grafloom.sources.shared import shared_folder
from grafloom.streaming import answers, limits, memory

BOOK = Book()


@BOOK.add("SELECT user_id, date_trunc('minute', ts)::TIMESTAMP AS window_start, count(*) AS n FROM events GROUP BY ALL")
def rate_limit_minute(spark: SparkSession, d: str) -> DataFrame:
    return limits.counts(table(spark, d, "events"), "MINUTE").withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@BOOK.add("SELECT user_id, date_trunc('hour', ts)::TIMESTAMP AS window_start, count(*) AS n FROM events GROUP BY ALL")
def rate_limit_hour(spark: SparkSession, d: str) -> DataFrame:
    return limits.counts(table(spark, d, "events"), "HOUR").withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@BOOK.add("SELECT event_id, user_id, ts, in_minute, in_hour, in_minute <= 4 AND in_hour <= 30 AS allowed FROM (SELECT event_id, user_id, ts, row_number() OVER (PARTITION BY user_id, date_trunc('minute', ts) ORDER BY ts, event_id) AS in_minute, row_number() OVER (PARTITION BY user_id, date_trunc('hour', ts) ORDER BY ts, event_id) AS in_hour FROM events)")
def rate_limit_verdict(spark: SparkSession, d: str) -> DataFrame:
    return limits.verdicts(table(spark, d, "events"))


@BOOK.add("SELECT * FROM (SELECT user_id, date_trunc('hour', ts)::TIMESTAMP AS window_start, count(*) AS n FROM events GROUP BY ALL) WHERE window_start >= TIMESTAMP '2024-01-15 09:00:00'")
def rate_limit_retention(spark: SparkSession, d: str) -> DataFrame:
    cut = F.lit("2024-01-15 10:00:00").cast("timestamp_ntz") - F.expr("INTERVAL 1 HOUR")
    return rate_limit_hour(spark, d).filter(F.col("window_start") >= cut)


def source(spark: SparkSession, d: str, name: str) -> DataFrame:
    schema = table(spark, d, name).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").parquet(f"{d}/{name}.parquet*")


def finished(stream: DataFrame, mode: str) -> DataFrame:
    """The rows of a stream over what is there now, written by batches into the shared folder."""
    spark, folder = stream.sparkSession, shared_folder(stream.sparkSession, "streams")

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{folder}/out/{number}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    return spark.read.option("recursiveFileLookup", "true").schema(f"{stream.schema.simpleString()[7:-1]}, batch int".replace(":", " ")).parquet(f"{folder}/out")


@BOOK.add("SELECT user_id, date_trunc('hour', ts)::TIMESTAMP AS window_start, count(*) AS n FROM events GROUP BY ALL")
def rate_limit_stream(spark: SparkSession, d: str) -> DataFrame:
    """The hourly counts by a stream: of each window its last state."""
    rows = finished(limits.stream(source(spark, d, "events")), "update")
    last = rows.groupBy("user_id", "window_start").agg(F.max_by("n", "batch").alias("n"))
    return last.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


def keyed(make, events: DataFrame) -> DataFrame:
    """The rows of a stream with keyed state, which needs a state store of its own."""
    spark = events.sparkSession
    before = {name: spark.conf.get(name, None) for name in limits.STORE}
    for name, value in limits.STORE.items():
        spark.conf.set(name, value)
    try:
        return finished(make(events), "append")
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


VERDICT_SQL = BOOK.sql["rate_limit_verdict"]


@BOOK.add(VERDICT_SQL)
def rate_limit_verdict_stream(spark: SparkSession, d: str) -> DataFrame:
    """The verdict of every event by keyed state with timers."""
    rows = keyed(limits.verdict_stream, source(spark, d, "events"))
    return rows.drop("batch").withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@BOOK.add(
    """WITH e AS (SELECT event_id, user_id, ts, CASE event_type WHEN 'purchase' THEN 'store' WHEN 'error' THEN 'invalid' ELSE 'ask' END AS kind, event_id % 9 AS answer, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
g AS (SELECT *, sum(CASE WHEN kind = 'store' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY k) AS gen FROM e),
n AS (SELECT user_id, gen, min(CASE WHEN kind = 'store' THEN ts END) AS stored, min(CASE WHEN kind = 'store' THEN answer END) AS answer, min(CASE WHEN kind = 'invalid' THEN ts END) AS bad, min(CASE WHEN kind = 'invalid' THEN k END) AS bad_k FROM g WHERE gen > 0 GROUP BY ALL),
m AS (SELECT *, stored + INTERVAL 24 HOUR AS whole, CASE WHEN bad < stored + INTERVAL 24 HOUR THEN bad ELSE stored + INTERVAL 24 HOUR END AS ends FROM n),
p AS (SELECT *, CASE WHEN coalesce(lag(ends) OVER (PARTITION BY user_id ORDER BY gen) + INTERVAL 7 DAY >= stored, false) THEN 0 ELSE 1 END AS fresh FROM m),
q AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY gen) AS epoch FROM p),
a AS (SELECT event_id, g.user_id, g.ts, g.k, epoch, q.answer, coalesce(g.ts < whole AND (bad_k IS NULL OR k < bad_k OR bad >= whole), false) AS hit FROM g LEFT JOIN q ON q.user_id = g.user_id AND q.gen = g.gen WHERE kind = 'ask')
SELECT event_id, user_id, hit, CASE WHEN hit THEN CAST(answer AS VARCHAR) END AS answer, CASE WHEN hit THEN CAST(sum(CASE WHEN hit THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, epoch ORDER BY k) AS BIGINT) END AS hits FROM a"""
)
def answer_cache_stream(spark: SparkSession, d: str) -> DataFrame:
    """Every question to a cache of one entry a user: purchases store, errors end, other events ask."""
    events = source(spark, d, "events")
    kind = F.when(F.col("event_type") == "purchase", "store").when(F.col("event_type") == "error", "invalid").otherwise("ask")
    log = events.select(F.col("user_id").alias("key"), F.col("event_id").alias("id"), "ts", kind.alias("kind"), (F.col("event_id") % 9).cast("string").alias("answer"))
    rows = keyed(answers.answered, log)
    return rows.select(F.col("id").alias("event_id"), F.col("key").alias("user_id"), "hit", "answer", "hits")


@BOOK.add("SELECT conv_id, CAST(count(*) // 3 * 3 AS BIGINT) AS seen FROM conversations GROUP BY conv_id")
def memory_stream(spark: SparkSession, d: str) -> DataFrame:
    """Messages folded by threes in a stream; how many each conversation's memory covers."""
    rows = finished(memory.fold_stream(source(spark, d, "conversations"), batch=3), "update")
    return rows.groupBy("conv_id").agg(F.max("seen").alias("seen"))
