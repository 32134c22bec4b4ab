"""Features of dated series: each row sees its own history, so every date is a snapshot."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tapewire import config
from tapewire.functions.stats import ratio


def series_features(series: DataFrame, window: int = 12, trend_window: int = 3, default_trends: dict[str, int] | None = None) -> DataFrame:
    """Latest value, year-over-year and month changes, standardised surprise and trend per (series, date).

    ``default_trends`` overrides the trend window for named series.  Thin
    histories give 0.
    """
    w = W.partitionBy("series").orderBy("date")
    recent = w.rowsBetween(-(window - 1), 0)
    past = w.rowsBetween(W.unboundedPreceding, 0)
    n = F.row_number().over(w)
    value = F.col("value")
    year_ago = F.lag("value", 12).over(w)
    sigma = F.stddev_samp("value").over(recent)
    threshold = F.when(F.avg("value").over(past) != 0, 0.05 * F.abs(F.avg("value").over(past))).otherwise(1e-6)

    def trend(back: int):
        change = value - F.lag("value", back).over(w)
        return F.when(n < back + 1, 0).when(change > threshold, 1).when(change < -threshold, -1).otherwise(0)

    chosen = trend(trend_window)
    for name, back in (default_trends or {}).items():
        chosen = F.when(F.col("series") == name, trend(back)).otherwise(chosen)
    return series.select(
        "series",
        "date",
        n.alias("n"),
        value.alias("latest"),
        F.when((n >= 13) & (year_ago != 0), (value - year_ago) / F.abs(F.nullif(year_ago, F.lit(0.0)))).otherwise(0.0).alias("yoy"),
        F.when(n >= 2, value - F.lag("value").over(w)).otherwise(0.0).alias("mom"),
        F.when((n >= window) & (sigma != 0), (value - F.avg("value").over(recent)) / F.nullif(sigma, F.lit(0.0))).otherwise(0.0).alias("surprise"),
        chosen.alias("trend"),
    )


def change_and_volatility(prices: DataFrame, change_window: int = 5, vol_window: int = 20) -> DataFrame:
    """Change against |base| and annualised volatility per (series, date); thin histories give 0."""
    w = W.partitionBy("series").orderBy("date")
    n = F.row_number().over(w)
    base = F.lag("price", change_window).over(w)
    rows = prices.withColumn("_r", ratio("price", F.lag("price").over(w)) - 1).withColumn("_n", n).withColumn("_b", base)
    frame = w.rowsBetween(-(vol_window - 1), 0)
    ok = (F.col("_n") >= vol_window + 1) & (F.count("_r").over(frame) >= 5)
    return rows.select(
        "series",
        "date",
        "price",
        F.when((F.col("_n") >= change_window + 1) & (F.col("_b") != 0), (F.col("price") - F.col("_b")) / F.abs(F.nullif("_b", F.lit(0.0))))
        .otherwise(0.0)
        .alias("change_5d"),
        F.when(ok, F.stddev_samp("_r").over(frame) * math.sqrt(config.TRADING_DAYS)).otherwise(0.0).alias("volatility"),
    )
