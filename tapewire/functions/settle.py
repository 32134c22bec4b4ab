"""Materialise a bounded intermediate table once.

Daily tables (prices, signals, trades) are bounded by days x tickers, and
several later steps read different columns of them.  Column pruning makes each
reader a different plan, so Spark would scan the raw news or bars once per
reader.  A reliable checkpoint in the shared folder stops that and survives the
loss of executors.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; a temporary folder only in local mode where none is set."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not sc.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            folder = tempfile.mkdtemp(prefix="tapewire-ckpt-")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def settle(df: DataFrame) -> DataFrame:
    """Checkpoint ``df``; a frame that already is one is returned as it is."""
    if getattr(df, "_settled", False):
        return df
    ensure_checkpoint_dir(df.sparkSession)
    out = df.checkpoint()
    out._settled = True
    return out
