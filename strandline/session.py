"""Session factory and table access shared by every query."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "strandline", cpus: int | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session. Under spark-submit its own settings hold: nothing but the time zone, which results depend on, is set.
    Else it is local, or at SPARK_MASTER, with as many cores and shuffle partitions as asked for."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC")
    if "PYSPARK_GATEWAY_PORT" not in os.environ:  # what spark-submit starts Python with
        n = cpus or int(os.environ.get("BENCH_CPUS", "8"))
        builder = (
            builder.master(os.environ.get("SPARK_MASTER", f"local[{n}]"))
            .config("spark.sql.shuffle.partitions", str(shuffle_partitions or n))
            .config("spark.ui.enabled", "false")
            .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "8g"))
        )
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables, read through Spark so that any store that Spark knows will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
