"""Headline-level filters and the daily signal table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tapewire import config
from tapewire.functions.labels import signal_of


def confident_or_all(scored: DataFrame, threshold: float = config.CONFIDENCE_THRESHOLD) -> DataFrame:
    """Confident rows; every row when none is confident.

    The fallback flag is a scalar subquery, so no row leaves its partition.
    """
    best = scored.agg(F.max("confidence")).scalar()
    sure = F.col("confidence") >= threshold
    return scored.where(sure | (F.coalesce(best, F.lit(-1.0)) < threshold))


def directional(scored: DataFrame, threshold: float = config.VALIDATION_CONFIDENCE) -> DataFrame:
    return scored.where((F.col("confidence") >= threshold) & ~F.col("label_name").isin("uncertain", "neutral"))


def daily_signals(scored: DataFrame, threshold: float = config.CONFIDENCE_THRESHOLD, keys: tuple[str, ...] = ()) -> DataFrame:
    """Mean signal, mean confidence and headline count per (date, ticker), rounded to 4 places."""
    rows = confident_or_all(scored, threshold)
    return rows.groupBy(*keys, F.to_date("date").alias("date"), "ticker").agg(
        F.round(F.avg(signal_of("label_name")), 4).alias("signal"),
        F.round(F.avg("confidence"), 4).alias("avg_confidence"),
        F.count("*").alias("headline_count"),
    )


def top_per_day(rows: DataFrame, cap: int | Column, keys: list[str], order: list[Column]) -> DataFrame:
    """First ``cap`` rows per group.  With an integer cap Spark prunes each group before the shuffle."""
    w = W.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= cap).drop("_rn")


def aggregate_signals(
    scored: DataFrame,
    signal_col: str = "signal",
    threshold: float = config.CONFIDENCE_THRESHOLD,
    confidence_weighted: bool = True,
    cap: int = config.MAX_HEADLINES_PER_DAY,
    keys: tuple[str, ...] = (),
) -> DataFrame:
    """Daily signal from confident headlines: optional top-``cap`` by confidence, optional weighting."""
    rows = scored.where(F.col("confidence") >= threshold)
    group = [*keys, "date", "ticker"]
    if cap > 0:
        rows = top_per_day(rows, cap, group, [F.desc("confidence"), F.col("headline_id")])
    value = F.col(signal_col) * F.col("confidence") if confidence_weighted else F.col(signal_col).cast("double")
    return rows.groupBy(*group).agg(F.avg(value).alias("signal"), F.count(signal_col).alias("headline_count"))


def news_features(signals: DataFrame, lookback: int = 30) -> DataFrame:
    """Volume shock, sentiment velocity and trend against trailing rows that exclude the current one."""
    w = W.partitionBy("ticker").orderBy("date")

    def trailing(col: str, rows: int, at_least: int) -> Column:
        frame = w.rowsBetween(-rows, -1)
        return F.when(F.count(col).over(frame) >= at_least, F.avg(col).over(frame))

    base = trailing("headline_count", lookback, 5)
    shock = F.least(F.lit(10.0), F.coalesce(F.col("headline_count") / F.when(base.isNotNull(), F.greatest(base, F.lit(1.0))), F.lit(1.0)))
    return signals.select(
        "*",
        shock.alias("news_volume_shock"),
        F.coalesce(F.col("signal") - trailing("signal", 3, 1), F.lit(0.0)).alias("sentiment_velocity"),
        F.coalesce(F.col("signal") - trailing("signal", 7, 1), F.lit(0.0)).alias("sentiment_trend"),
    )


def market_sentiment(signals: DataFrame) -> DataFrame:
    return signals.groupBy("date").agg(
        F.avg("signal").alias("market_sentiment"),
        F.stddev_samp("signal").alias("market_sentiment_std"),
        F.count("signal").alias("ticker_count"),
    )


def usable_dates(signals: DataFrame, min_tickers: int, keys: list[str] | None = None) -> DataFrame:
    """Dates with enough distinct tickers."""
    keys = keys or []
    counts = signals.groupBy(*keys, "date").agg(F.count_distinct("ticker").alias("k"))
    return counts.where(F.col("k") >= min_tickers).select(*keys, "date")


def min_tickers_for(cutoff: float) -> int:
    import math

    return max(4, math.ceil(2 / max(cutoff, 0.01)))


def on_usable_dates(signals: DataFrame, min_tickers: int, keys: list[str] | None = None) -> DataFrame:
    keys = keys or []
    return signals.join(usable_dates(signals, min_tickers, keys), [*keys, "date"], "left_semi")


def liquidity_filter(signals: DataFrame, dollar_vol: DataFrame, share: float = 0.2, keys: list[str] | None = None) -> DataFrame:
    """Keep rows whose dollar volume is missing or at least that date's ``share`` quantile.

    A date's cross-section is bounded by the number of tickers.
    """
    joined = signals.join(dollar_vol, ["date", "ticker"], "left")
    cut = F.percentile("dollar_vol", F.lit(share)).over(W.partitionBy(*(keys or []), "date"))
    return joined.withColumn("_cut", cut).where("dollar_vol is null or dollar_vol >= _cut").drop("_cut", "dollar_vol")


def zscore(col: str, keys: list[str], bound: float = 3.0) -> Column:
    """Cross-sectional z-score clipped to +-bound; 0 for a single or flat group."""
    w = W.partitionBy(*keys)
    std, size = F.stddev_samp(col).over(w), F.count(col).over(w)
    z = (F.col(col) - F.avg(col).over(w)) / F.nullif(std, F.lit(0.0))
    flat = (size < 2) | (std < 1e-8)
    return F.when(F.col(col).isNull(), None).when(flat, 0.0).otherwise(F.greatest(F.lit(-bound), F.least(F.lit(bound), z)))


def sector_neutral(signals: DataFrame, sectors: DataFrame, col: str = "signal", keys: tuple[str, ...] = ()) -> DataFrame:
    """Replace ``col`` by its z-score inside (date, sector); unlisted tickers form one sector."""
    rows = with_sector(signals, sectors)
    w = W.partitionBy(*keys, "date", "sector")
    std, size = F.stddev_samp(col).over(w), F.count(F.lit(1)).over(w)
    z = (F.col(col) - F.avg(col).over(w)) / F.nullif(std, F.lit(0.0))
    return rows.withColumn(col, F.when((size < 2) | (std < 1e-9), 0.0).otherwise(z))


def with_sector(df: DataFrame, sectors: DataFrame) -> DataFrame:
    return df.join(sectors, "ticker", "left").withColumn("sector", F.coalesce("sector", F.lit(config.DEFAULT_SECTOR)))


def sparse_tickers(news: DataFrame, minimum: int = 5) -> DataFrame:
    return news.groupBy("ticker").agg(F.count("*").alias("headlines")).where(F.col("headlines") < minimum)


def universe_summary(news: DataFrame) -> DataFrame:
    """Row count, tickers, date range and the spread of headlines per ticker, in two levels."""
    per = news.groupBy("ticker").agg(F.count("*").alias("k"), F.min("date").alias("lo"), F.max("date").alias("hi"))
    return per.agg(
        F.sum("k").alias("headlines"),
        F.count("*").alias("tickers"),
        F.min("lo").alias("first_date"),
        F.max("hi").alias("last_date"),
        F.median("k").alias("median_per_ticker"),
        F.min("k").alias("min_per_ticker"),
        F.max("k").alias("max_per_ticker"),
    )
