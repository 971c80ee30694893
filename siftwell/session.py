"""The Spark session the library is written for."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def get_session(app: str = "siftwell", master: str | None = None, **conf: str) -> SparkSession:
    """Return a session with ANSI mode, UTC and adaptive execution on.

    An existing session is reused.  ``master`` defaults to what spark-submit gives, or
    ``local[$BENCH_CPUS]`` (8) outside of it.
    """
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.shuffle.partitions": os.environ.get("SIFTWELL_SHUFFLE_PARTITIONS", "8"),
        "spark.ui.enabled": "false",
        "spark.driver.memory": os.environ.get("SIFTWELL_DRIVER_MEMORY", "8g"),
    }
    builder = SparkSession.builder.appName(app).config(map=base | conf)
    if master or "SPARK_MASTER" not in os.environ:
        builder = builder.master(master or f"local[{os.environ.get('BENCH_CPUS', '8')}]")
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
