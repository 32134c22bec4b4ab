"""Session builder with the settings the jobs are written for."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def get_spark(app: str = "tapewire", master: str | None = None, **extra: str) -> SparkSession:
    """Build or fetch a session.

    On a cluster pass no master; spark-submit supplies it together with
    ``spark.checkpoint.dir`` and the shuffle settings.  AQE (coalescing, skew
    join splitting, runtime broadcast) is what the operators rely on, so it is
    set explicitly.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    }
    if master and master.startswith("local"):
        cores = master[6:-1] if master.startswith("local[") else ""
        settings["spark.sql.shuffle.partitions"] = cores if cores.isdigit() else "8"
        settings["spark.ui.enabled"] = "false"
        settings["spark.driver.memory"] = os.environ.get("TAPEWIRE_DRIVER_MEMORY", "8g")
    settings.update(extra)
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
