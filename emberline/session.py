"""A session with the settings that the library is tuned for."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def local_session(cpus: int | str | None = None, **conf: str) -> SparkSession:
    """A local session for tests, benchmarks and exploration.

    On a cluster, use the cluster's own session: no operator needs a setting
    from here, and each reads ``spark.checkpoint.dir`` from its session.
    """
    cpus = cpus or os.environ.get("BENCH_CPUS") or 8
    settings = {
        "spark.sql.shuffle.partitions": str(cpus),
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
        "spark.driver.host": "127.0.0.1",
    } | conf
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("emberline")
    spark = builder.config(map=settings).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
