"""Chart and report tables."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapewire.functions.labels import side_name
from tapewire.functions.stats import ratio


def signal_distribution(signals: DataFrame, position: Column) -> DataFrame:
    return signals.groupBy(side_name(position).alias("side")).agg(F.count("*").alias("n"))


def drawdown_trough(curve: DataFrame, keys: list[str]) -> DataFrame:
    """Deepest drawdown and its first date per key; equal depths compare at 12 places."""
    curve = curve.withColumn("drawdown", F.round("drawdown", 12))
    return curve.groupBy(*keys).agg(F.min("drawdown").alias("depth"), F.min(F.struct("drawdown", "date"))["date"].alias("trough"))


def return_histogram(rows: DataFrame, value: str, bins: int = 50) -> DataFrame:
    """Equal-width histogram with density; bounds come from one scalar subquery."""
    valid = rows.where(F.col(value).isNotNull())
    s = valid.agg(F.struct(F.min(value).alias("lo"), F.max(value).alias("hi"), F.count("*").alias("n")).alias("s")).scalar()
    lo, hi, n = s["lo"], s["hi"], s["n"]
    width = (hi - lo) / bins
    index = F.least(F.lit(bins - 1), F.floor((F.col(value) - lo) / F.nullif(width, F.lit(0.0))).cast("int"))
    counts = valid.groupBy(index.alias("bin")).agg(F.count("*").alias("count"))
    return counts.select("bin", (lo + F.col("bin") * width).alias("left_edge"), "count", (F.col("count") / n / F.nullif(width, F.lit(0.0))).alias("density"))


def moments(rows: DataFrame, value: str) -> DataFrame:
    return rows.agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.count(value).alias("n"))


def kernel_density(rows: DataFrame, side: str, value: str, n: str | None = None, points: int = 41, low: float = -0.1, high: float = 0.1) -> DataFrame:
    """Gaussian kernel density per side on a fixed grid, Scott bandwidth.

    Equal values are counted first; each distinct value meets the grid by a
    generator, and sums are combined map-side.
    """
    w = F.col(n) if n else F.lit(1)
    counts = rows.where(F.col(value).isNotNull()).groupBy(side, F.col(value).alias("v")).agg(F.sum(w).cast("double").alias("w"))
    total = counts.groupBy(side).agg(F.sum("w").alias("n"), (F.sum(F.col("v") * F.col("w")) / F.sum("w")).alias("mu"))
    spread = counts.join(total, side).groupBy(side).agg(
        F.first("n").alias("n"), F.sqrt(F.sum(F.col("w") * F.pow(F.col("v") - F.col("mu"), 2)) / F.nullif(F.first("n") - 1, F.lit(0.0))).alias("sd")
    )
    band = spread.where("sd > 0").select(side, "n", (F.col("sd") * F.pow("n", F.lit(-0.2))).alias("h"))
    step = (high - low) / (points - 1)
    grid = F.sequence(F.lit(0), F.lit(points - 1))
    placed = counts.join(band, side).withColumn("i", F.explode(grid)).withColumn("x", F.lit(low) + F.col("i") * step)
    z = (F.col("x") - F.col("v")) / F.col("h")
    return placed.groupBy(side, "i").agg(
        F.first("x").alias("x"), (F.sum(F.col("w") * F.exp(-z * z / 2) / (F.col("h") * math.sqrt(2 * math.pi))) / F.first("n")).alias("density")
    )


def with_group_value(rows: DataFrame, groups: DataFrame, key: str) -> DataFrame:
    return rows.join(groups, key, "left")


def shares(rows: DataFrame, col: str) -> DataFrame:
    total = rows.agg(F.count("*")).scalar()
    return rows.groupBy(col).agg(F.count("*").alias("n")).withColumn("share", ratio("n", total))
