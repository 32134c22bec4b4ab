"""Arrow batches of bounded size for steps that run Python over whole texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

BATCH_ROWS, BATCH_BYTES = 2000, 8 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Lowers the session's Arrow batch size to ``BATCH_ROWS`` rows or ``BATCH_BYTES`` bytes; smaller settings stay.

    A setting of the session: it also holds for later jobs, whose results do not depend on it.
    """
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(key, None)
        if now is None or not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


def spread(table: DataFrame) -> DataFrame:
    """A table that is read in fewer tasks than there are cores, dealt over all of them.

    For scans with costly work per row: a file of one row group is one task however many texts it holds.
    A table of many files stays as it is, and nothing is shuffled.
    """
    cores = table.sparkSession.sparkContext.defaultParallelism
    return table if table.rdd.getNumPartitions() >= cores else table.repartition(cores)
