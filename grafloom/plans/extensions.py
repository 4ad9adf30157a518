"""Relational breadth over the star-schema tables, beyond what corpora need."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from grafloom.plans.book import Book, table

BOOK = Book()


@BOOK.add("SELECT n_name, count(*) AS orders, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE l_shipdate >= TIMESTAMP '1995-01-01' GROUP BY n_name")
def ext_join_agg(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "lineitem").filter("l_shipdate >= timestamp_ntz'1995-01-01'")
    joined = items.join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.groupBy("n_name").agg(F.count(F.lit(1)).alias("orders"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@BOOK.add("SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000) AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def ext_semi_anti(spark: SparkSession, d: str) -> DataFrame:
    orders, key = table(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey")
    out = table(spark, d, "customer").join(orders.filter("o_totalprice > 200000"), key, "left_semi")
    return out.join(orders.filter("o_orderpriority = '1-URGENT'"), key, "left_anti").select("c_custkey", "c_name")


@BOOK.add("SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity, CAST(grouping(l_returnflag, l_linestatus) AS BIGINT) AS level FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def ext_rollup(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"), F.grouping_id().alias("level"))


@BOOK.add("SELECT o_orderkey, o_custkey, row_number() OVER w AS place, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING), 2) AS running, lag(o_orderkey) OVER w AS before FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
def ext_window(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, d, "orders").select("o_orderkey", "o_custkey", F.row_number().over(w).alias("place"), F.round(F.sum("o_totalprice").over(w.rowsBetween(Window.unboundedPreceding, 0)), 2).alias("running"), F.lag("o_orderkey").over(w).alias("before"))


@BOOK.add("(SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier) EXCEPT SELECT n_nationkey FROM nation WHERE n_regionkey = 0")
def ext_setops(spark: SparkSession, d: str) -> DataFrame:
    both = table(spark, d, "customer").select(F.col("c_nationkey").alias("k")).intersect(table(spark, d, "supplier").select("s_nationkey"))
    return both.subtract(table(spark, d, "nation").filter("n_regionkey = 0").select("n_nationkey"))


@BOOK.add("SELECT user_id, min(ts) AS started, count(*) AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, s")
def ext_session_window(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events").withColumn("at", F.col("ts").cast("timestamp"))
    out = events.groupBy("user_id", F.session_window("at", "30 minutes").alias("w")).agg(F.min("ts").alias("started"), F.count(F.lit(1)).alias("n"))
    return out.select("user_id", "started", "n")
