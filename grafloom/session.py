"""A session with the settings that the engine expects; partition counts are left to the cluster and to AQE."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "grafloom", **conf: str) -> SparkSession:
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    return SparkSession.builder.appName(app).config(map=settings | conf).getOrCreate()
