"""Exact retrieval metrics: per question, per retriever, latencies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grafloom.operators.metrics import retrieval_metrics, summary
from grafloom.operators.quantiles import quantiles
from grafloom.plans.book import Book, table
from grafloom.plans.retrieval import DENSE, dense_ranks

BOOK = Book()

PER = f"""WITH {DENSE}, top AS (SELECT item_id, doc_id AS id, rank FROM den WHERE rank <= 10), lab AS (SELECT b.item_id, e.label FROM benchmark b JOIN embeddings e ON e.vec_id = b.item_id),
ex AS (SELECT l.item_id, e.vec_id AS id FROM lab l JOIN embeddings e ON e.label = l.label),
per AS (SELECT t.item_id, count(*) FILTER (WHERE ex.id IS NOT NULL) AS hits, count(*) FILTER (WHERE ex.id IS NOT NULL) > 0 AS hit, count(*) FILTER (WHERE ex.id IS NOT NULL) / count(*)::DOUBLE AS prec, coalesce(1.0::DOUBLE / min(rank) FILTER (WHERE ex.id IS NOT NULL), 0) AS mrr FROM top t LEFT JOIN ex ON ex.item_id = t.item_id AND ex.id = t.id GROUP BY t.item_id),
n AS (SELECT item_id, count(*) AS n FROM ex GROUP BY item_id)"""


def metrics(spark: SparkSession, d: str) -> DataFrame:
    """What a question should find are the vectors with its own label."""
    vectors = table(spark, d, "embeddings").select("vec_id", "label")
    label = table(spark, d, "benchmark").select("item_id").join(vectors.withColumnRenamed("vec_id", "item_id"), "item_id")
    expected = label.join(vectors, "label").select("item_id", F.col("vec_id").alias("id"))
    found = dense_ranks(spark, d, 10).select("item_id", F.col("doc_id").alias("id"), "rank")
    return retrieval_metrics(found, expected, "item_id", "id")


@BOOK.add(f"{PER} SELECT per.item_id, hits, hit, round(prec, 6) AS precision, round(hits / n::DOUBLE, 6) AS recall, round(mrr, 6) AS mrr FROM per JOIN n USING (item_id)")
def ir_metrics_per_query(spark: SparkSession, d: str) -> DataFrame:
    return metrics(spark, d).withColumns({c: F.round(c, 6) for c in ("precision", "recall", "mrr")})


@BOOK.add(f"{PER} SELECT 'dense' AS backend, count(*) AS samples, round(avg(hit::INT), 6) AS hit_rate, round(avg(prec), 6) AS precision, round(avg(hits / n::DOUBLE), 6) AS recall, round(avg(mrr), 6) AS mrr FROM per JOIN n USING (item_id)")
def ir_metrics_summary(spark: SparkSession, d: str) -> DataFrame:
    out = summary(metrics(spark, d).withColumn("backend", F.lit("dense")))
    return out.withColumns({c: F.round(c, 6) for c in ("hit_rate", "precision", "recall", "mrr")})


@BOOK.add("SELECT event_type AS step, count(*) AS n, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.95), 6) AS p95, round(min(value), 6) AS least, round(max(value), 6) AS most FROM events GROUP BY event_type")
def latency_percentiles(spark: SparkSession, d: str) -> DataFrame:
    out = quantiles(table(spark, d, "events"), "event_type", "value", [0.5, 0.95])
    return out.select(F.col("event_type").alias("step"), "n", F.round(F.col("quantiles")[0], 6).alias("median"), F.round(F.col("quantiles")[1], 6).alias("p95"), F.round("least", 6).alias("least"), F.round("most", 6).alias("most"))


@BOOK.add("SELECT event_type AS backend, round(avg(value) FILTER (WHERE NOT isnan(value)), 6) AS mean FROM events GROUP BY event_type")
def mean_or_none(spark: SparkSession, d: str) -> DataFrame:
    from grafloom.operators.metrics import mean_or_null

    return table(spark, d, "events").groupBy(F.col("event_type").alias("backend")).agg(F.round(mean_or_null(F.col("value")), 6).alias("mean"))
