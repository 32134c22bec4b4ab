"""Price panel in long form: returns, volatilities, forward returns.

A panel row is (date, pos, ticker, close, volume).  Positions come from the
calendar, and windows use RANGE frames over ``pos``: a missing print is a hole
at its position, never shifted onto a neighbour.  One ticker's history is
bounded by the calendar, so a window per ticker stays small.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import WindowSpec
from pyspark.sql import functions as F

from tapewire import config
from tapewire.functions.stats import ratio
from tapewire.operators.calendar import trading_calendar, with_pos


def by_ticker() -> WindowSpec:
    return W.partitionBy("ticker").orderBy("pos")


def at_offset(col: str, offset: int) -> Column:
    """Value ``offset`` trading days away, NULL when that day has no print."""
    return F.max(col).over(by_ticker().rangeBetween(offset, offset))


def price_panel(prices: DataFrame, cal: DataFrame | None = None) -> DataFrame:
    """Attach positions and drop tickers without a single close."""
    cal = trading_calendar(prices) if cal is None else cal
    panel = with_pos(prices, cal)
    quoted = prices.groupBy("ticker").agg(F.count("close").alias("k")).where("k > 0").select("ticker")
    return panel.join(quoted, "ticker", "left_semi")


def simple_returns(panel: DataFrame, pad: bool = False) -> DataFrame:
    """One-day return.  ``pad=True`` fills missing closes forward over the ticker's history first."""
    if pad:
        filled = F.last("close", ignorenulls=True).over(by_ticker().rowsBetween(W.unboundedPreceding, W.currentRow))
        prev = F.lag("_px").over(by_ticker())
        return panel.withColumn("_px", filled).withColumn("ret", ratio("_px", prev) - 1).drop("_px")
    return panel.withColumn("ret", ratio("close", at_offset("close", -1)) - 1)


def next_day_returns(panel: DataFrame) -> DataFrame:
    return panel.withColumn("next_ret", ratio(at_offset("close", 1), "close") - 1)


def forward_returns(panel: DataFrame, lags: list[int]) -> DataFrame:
    """Add ``return_lag_k`` columns measured from the close at ``pos``; rows without a base price drop out."""
    base = panel.where(F.col("close").isNotNull() & (F.col("close") != 0))
    cols = [((at_offset("close", k) - F.col("close")) / F.nullif("close", F.lit(0.0))).alias(f"return_lag_{k}") for k in lags]
    return base.select("ticker", "pos", "close", *cols)


def returns_from_closes(panel: DataFrame) -> DataFrame:
    return simple_returns(panel).select("ticker", "pos", "close", "volume", "ret")


def attach_points(panel_cols: DataFrame, points: DataFrame) -> DataFrame:
    """Union wanted (ticker, pos) points into the panel so windows can be read at days without a print."""
    wanted = points.select("ticker", "pos").distinct().withColumn("_point", F.lit(True))
    return panel_cols.withColumn("_point", F.lit(False)).unionByName(wanted, allowMissingColumns=True)


def realised_vol(panel: DataFrame, points: DataFrame, window: int = 20) -> DataFrame:
    """Annualised volatility of the returns inside the ``window`` prices strictly before each point.

    Fewer than three slots or a flat window gives 1.0.
    """
    both = attach_points(returns_from_closes(panel), points)
    frame = by_ticker().rangeBetween(-(window - 1), -1)
    std = F.stddev_samp("ret").over(frame)
    vol = F.when((F.col("pos") >= 3) & (std > 1e-8), std * math.sqrt(config.TRADING_DAYS)).otherwise(F.lit(1.0))
    return both.withColumn("vol", vol).where("_point").select("ticker", "pos", "vol")


def rolling_log_vol(panel: DataFrame, window: int = 20) -> DataFrame:
    """Rolling annualised std of log returns, NULL unless the window is full."""
    logs = panel.withColumn("log_ret", F.ln(ratio("close", at_offset("close", -1))))
    frame = by_ticker().rangeBetween(-(window - 1), 0)
    full = F.count("log_ret").over(frame) == window
    return logs.withColumn("rolling_vol", F.when(full, F.stddev_samp("log_ret").over(frame) * math.sqrt(config.TRADING_DAYS)))


def dollar_volume(panel: DataFrame) -> DataFrame:
    return panel.select("date", "ticker", (F.col("close") * F.col("volume")).alias("dollar_vol"))


def benchmark_returns(panel: DataFrame) -> DataFrame:
    """(pos, bench_ret): daily change of the average close over all tickers."""
    level = panel.groupBy("pos").agg(F.avg("close").alias("level"))
    prev = F.max("level").over(W.orderBy("pos").rangeBetween(-1, -1))
    return level.select("pos", (ratio("level", prev) - 1).alias("bench_ret")).where("bench_ret is not null")


def coverage_ratio(prices: DataFrame) -> DataFrame:
    """Share of (date, ticker) slots with a close."""
    return prices.agg(
        (F.count("close") / (F.count_distinct("date") * F.count_distinct("ticker"))).alias("coverage")
    )


def unpivot_panel(wide: DataFrame, value: str, date: str = "date") -> DataFrame:
    """Wide (date, ticker columns) to long; empty cells drop out."""
    tickers = [c for c in wide.columns if c != date]
    return wide.unpivot(date, tickers, "ticker", value).where(F.col(value).isNotNull())


def pivot_panel(prices: DataFrame, tickers: list[str], value: str = "close") -> DataFrame:
    return prices.groupBy("date").pivot("ticker", tickers).agg(F.max(value))
