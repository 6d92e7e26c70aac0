"""One place for the Spark settings that every entry point shares."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def session(name: str = "lodestar", master: str | None = None, partitions: int | None = None, memory: str = "8g") -> SparkSession:
    """A session for local runs; on a cluster, spark-submit's own settings win where they are given."""
    builder = SparkSession.builder.appName(name).config(map=SETTINGS)
    if master:
        builder = builder.master(master).config("spark.driver.memory", memory)
    if partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
