"""The Spark session that tests, the bench and scripts share."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def session(cores: int | str | None = None, app: str = "tidemark", **conf: str) -> SparkSession:
    """A local session with UTC time and adaptive execution; conf overrides any setting."""
    cores = cores or os.environ.get("BENCH_CPUS", "8")
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.shuffle.partitions": "8",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "12g",
        "spark.driver.host": "127.0.0.1",
    }
    built = SparkSession.builder.master(f"local[{cores}]").appName(app).config(map=settings | conf).getOrCreate()
    built.sparkContext.setLogLevel("ERROR")
    return built
