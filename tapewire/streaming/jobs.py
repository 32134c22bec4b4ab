"""Structured Streaming forms of ingest, scoring, signals and alerts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tapewire import config
from tapewire.functions.labels import signal_of
from tapewire.functions.settle import settle
from tapewire.schemas import NEWS
from tapewire.sources.keyed import KeyedTable
from tapewire.sources.store import score_with_cache


def read_news_stream(spark: SparkSession, path: str, schema=NEWS, max_files: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def deduplicated(news: DataFrame, delay: str = "7 days") -> DataFrame:
    """Drop repeats of (ticker, headline) that arrive within the watermark."""
    return news.withWatermark("date", delay).dropDuplicatesWithinWatermark(["ticker", "headline"])


def daily_signal_stream(scored: DataFrame, threshold: float = config.CONFIDENCE_THRESHOLD, delay: str = "2 days") -> DataFrame:
    """Mean signal and count per (day, ticker), for update mode: a day is given again when more of it comes.

    State of a day is kept until the watermark has passed it; rows that come later are left out.
    """
    rows = scored.where(F.col("confidence") >= threshold).withColumn("signal", signal_of("label_name"))
    agg = rows.withWatermark("date", delay).groupBy(F.window("date", "1 day"), "ticker").agg(
        F.avg("signal").alias("signal"), F.count("*").alias("headline_count")
    )
    return agg.select(F.to_date("window.start").alias("date"), "ticker", "signal", "headline_count")


def daily_volume_stream(news: DataFrame, delay: str = "2 days") -> DataFrame:
    """Headlines per (day, ticker), for update mode."""
    agg = news.withWatermark("date", delay).groupBy(F.window("date", "1 day"), "ticker").agg(F.count("*").alias("n"))
    return agg.select(F.to_date("window.start").alias("date"), "ticker", "n")


Body = Callable[[DataFrame, int], None]


def upsert(table: KeyedTable) -> Body:
    """foreachBatch body: the batch's rows replace those of the same key.  A replayed batch changes nothing."""
    return lambda batch, batch_id: table.merge(batch, version=batch_id + 1)


def volume_windows(daily: KeyedTable, windows: KeyedTable, days: int = 30) -> Body:
    """foreachBatch body for daily counts: keeps the counts by day and the trailing sums of all windows.

    A window is named by the day after its last one.  Only changed days reach it, as differences to what the
    table of days held before the batch: a day's change goes to ``days`` windows, whatever it counts.
    """

    def body(batch: DataFrame, batch_id: int) -> None:
        version = batch_id + 1
        now = settle(batch.select("date", "ticker", "n"))
        old = daily.lookup(now, before=version).withColumnRenamed("n", "old")
        change = now.join(old, ["date", "ticker"], "left").withColumn("n", F.col("n") - F.coalesce("old", F.lit(0)))
        ends = F.transform(F.sequence(F.lit(1), F.lit(days)), lambda k: F.date_add("date", k))
        moved = settle(change.where("n <> 0").withColumn("end_date", F.explode(ends)).groupBy("end_date", "ticker").agg(F.sum("n").alias("n")))
        before = windows.lookup(moved, before=version)
        windows.merge(before.unionByName(moved).groupBy("end_date", "ticker").agg(F.sum("n").alias("n")).join(moved.select("end_date", "ticker"), ["end_date", "ticker"], "left_semi"), version)
        daily.merge(now, version)

    return body


def recommendation_alerts(history: KeyedTable, alerts: KeyedTable) -> Body:
    """foreachBatch body: the changes of each ticker's recommendation in order of event time.

    Updates: ticker, recommendation, ts.  ``history`` keeps them by (ticker, ts), ``alerts`` the update
    before each, both in buckets by ticker.  From a batch's earliest update of a ticker on, each update is
    compared with the one before it, the last of the history if need be; so updates that come late
    or in other batches give the same alerts in the end.  Of updates at one time the largest counts.
    """

    def body(batch: DataFrame, batch_id: int) -> None:
        version = batch_id + 1
        new = settle(batch.select("ticker", "ts", "recommendation"))
        history.merge(new, version)
        since = new.groupBy("ticker").agg(F.min("ts").alias("since"))
        known = history.lookup(new, before=version + 1).join(since, "ticker")
        early = F.col("ts") < F.col("since")
        last = known.where(early).groupBy("ticker").agg(F.max(F.struct("ts", "recommendation", "since")).alias("x")).select("ticker", "x.*")
        rows = known.where(~early).unionByName(last)
        previous = F.lag("recommendation").over(W.partitionBy("ticker").orderBy("ts"))
        told = rows.withColumn("previous", previous).where(~early)
        alerts.merge(told.select("ticker", "ts", "previous", "recommendation"), version)

    return body


HISTORY = "ticker string, ts timestamp, recommendation string"
ALERTS = "ticker string, ts timestamp, previous string, recommendation string"


def current_alerts(alerts: KeyedTable) -> DataFrame:
    """(ticker, ts, previous, recommendation) where the recommendation differs from the one before."""
    return alerts.read().where("previous <> recommendation")


def incremental_scorer(cache: KeyedTable, scorer: Callable[[DataFrame], DataFrame], model: str, out_path: str) -> Body:
    """foreachBatch body: score unseen headlines once, merge them into the cache, write the scored batch.

    The batch id numbers the merge and the output folder.  A repeated batch sees the cache as it was before
    its first attempt and overwrites what that left, whole or not.
    """

    def body(batch: DataFrame, batch_id: int) -> None:
        scored = score_with_cache(batch, cache, scorer, model, version=batch_id + 1)
        scored = scored.withColumn("label_name", F.coalesce("label_name", F.raise_error(F.lit("a text of the batch has no score"))))
        scored.write.mode("overwrite").parquet(f"{out_path}/batch={batch_id}")

    return body


def run_to_end(stream: DataFrame, body: Body, state: str) -> None:
    """Reads what has landed, gives it to ``body`` in update mode, and stops; ``state`` is the query's folder."""
    stream.writeStream.foreachBatch(body).outputMode("update").option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
