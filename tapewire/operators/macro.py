"""Macro and commodity snapshots for every date, with regime and shock rules.

Series are dated and few (one row per series and period), so the per-series
windows are bounded by the calendar.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tapewire import config
from tapewire.operators.series import change_and_volatility, series_features
from tapewire.rule_data import REGIMES, SHOCKS

MACRO_SERIES = ["cpi", "unemployment", "payrolls", "gdp", "fed_funds", "yield_10yr", "yield_2yr"]
COMMODITY_SERIES = ["oil", "gas", "copper", "gold"]


def carry_forward(features: DataFrame, dates: DataFrame, series: list[str]) -> DataFrame:
    """Last feature row of each series on or before each date: (date, series, f)."""
    names = F.array(*[F.lit(s) for s in series])
    grid = dates.select("date").distinct().withColumn("series", F.explode(names)).withColumn("_ask", F.lit(1))
    packed = features.select("series", "date", F.struct(*[c for c in features.columns if c not in ("series", "date")]).alias("f"))
    both = packed.withColumn("_ask", F.lit(0)).unionByName(grid, allowMissingColumns=True)
    behind = W.partitionBy("series").orderBy("date").rangeBetween(W.unboundedPreceding, W.currentRow)
    return both.withColumn("f", F.last("f", ignorenulls=True).over(behind)).where("_ask = 1").drop("_ask")


def _pick(series: str, field: str) -> Column:
    return F.max(F.when(F.col("series") == series, F.col(f"f.{field}")))


def classify_regime(cpi_yoy: Column, cpi_surprise: Column, fed_funds: Column, fed_trend: Column, spread: Column, vix: Column, gdp_trend: Column, unemployment_trend: Column) -> Column:
    """First matching rule wins."""
    return (
        F.when((cpi_yoy > 0.04) & (cpi_surprise > 1.5), "inflation_shock")
        .when((gdp_trend < 0) & (unemployment_trend > 0), "growth_slowdown")
        .when((vix > 28) | (spread < -0.003), "risk_off")
        .when((fed_trend > 0) | ((fed_funds > 0.04) & (cpi_yoy > 0.025)), "tightening")
        .when((fed_trend < 0) | (fed_funds < 0.01), "easing")
        .when((vix < 16) & (gdp_trend >= 0) & (spread > 0.005), "risk_on")
        .otherwise("neutral")
    )


def macro_snapshots(macro: DataFrame, vix: DataFrame, dates: DataFrame) -> DataFrame:
    """One macro row per date: levels, changes, surprise, trend and regime; empty series use defaults."""
    features = series_features(macro).join(
        series_features(macro, trend_window=2).select("series", "date", F.col("trend").alias("trend2")), ["series", "date"]
    )
    filled = carry_forward(features, dates, MACRO_SERIES)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    surprise_of = F.col("series").isin("cpi", "unemployment", "payrolls", "gdp", "fed_funds") & (F.col("f.n") > 3)
    trend_of = F.col("series").isin("gdp", "payrolls") & (F.col("f.n") > 3)
    y10 = _pick("yield_10yr", "latest")
    wide = filled.groupBy("date").agg(
        zero(_pick("cpi", "yoy")).alias("cpi_yoy"),
        zero(_pick("cpi", "surprise")).alias("cpi_surprise"),
        F.coalesce(_pick("unemployment", "latest") / 100, F.lit(0.04)).alias("unemployment"),
        F.coalesce(_pick("unemployment", "trend"), F.lit(0)).alias("unemployment_trend"),
        zero(_pick("payrolls", "mom")).alias("payrolls_chg"),
        zero(_pick("gdp", "yoy")).alias("gdp_growth"),
        F.coalesce(_pick("gdp", "trend2"), F.lit(0)).alias("gdp_trend"),
        F.coalesce(_pick("fed_funds", "latest") / 100, F.lit(0.05)).alias("fed_funds"),
        F.coalesce(_pick("fed_funds", "trend"), F.lit(0)).alias("fed_trend"),
        F.coalesce(F.when(y10 > 1, y10 / 100).otherwise(y10), F.lit(0.044)).alias("yield_10yr"),
        F.coalesce(_pick("yield_2yr", "latest") / 100, F.lit(0.049)).alias("yield_2yr"),
        zero(F.avg(F.when(surprise_of, F.col("f.surprise")))).alias("macro_surprise"),
        F.coalesce(F.signum(F.sum(F.when(trend_of, F.col("f.trend")))), F.lit(0.0)).cast("int").alias("macro_trend"),
    )
    packed = vix.select(F.lit("vix").alias("series"), "date", "level")
    levels = carry_forward(packed, dates, ["vix"]).select("date", F.coalesce("f.level", F.lit(config.VIX_DEFAULT)).alias("vix"))
    wide = wide.join(levels, "date").withColumn("yield_spread", F.col("yield_10yr") - F.col("yield_2yr"))
    c = F.col
    regime = classify_regime(c("cpi_yoy"), c("cpi_surprise"), c("fed_funds"), c("fed_trend"), c("yield_spread"), c("vix"), c("gdp_trend"), c("unemployment_trend"))
    places = {"cpi_yoy": 5, "unemployment": 5, "payrolls_chg": 1, "gdp_growth": 5, "fed_funds": 5, "yield_10yr": 5, "yield_2yr": 5, "yield_spread": 5, "vix": 2, "macro_surprise": 4}
    return wide.select("date", *[F.round(k, v).alias(k) for k, v in places.items()], "macro_trend", regime.alias("regime"))


def one_hot(col: str, values: list[str], prefix: str) -> list[Column]:
    return [F.coalesce((F.col(col) == v).cast("double"), F.lit(0.0)).alias(f"{prefix}_{v}") for v in values]


def macro_features(snapshots: DataFrame) -> DataFrame:
    """Numeric feature row: 11 values and 7 regime flags."""
    numeric = [c for c in snapshots.columns if c not in ("date", "regime")]
    return snapshots.select("date", *[F.col(c).cast("double").alias(f"macro_{c.removeprefix('macro_')}") for c in numeric], *one_hot("regime", REGIMES, "macro_regime"))


def classify_shock(change: Column, vol: Column, name: Column) -> Column:
    return (
        F.when(change < -0.05, "price_crash")
        .when((change > 0.05) & (vol > 0.40), F.when(name.isin("oil", "gas"), "supply_shock").otherwise("demand_shock"))
        .when((F.abs(change) > 0.03) & (vol > 0.30), "demand_shock")
        .otherwise("neutral")
    )


def commodity_states(prices: DataFrame) -> DataFrame:
    """Price, change, volatility and shock per (series, date)."""
    rows = change_and_volatility(prices)
    shock = classify_shock(F.col("change_5d"), F.col("volatility"), F.col("series"))
    return rows.select(
        "series", "date", F.round("price", 4).alias("price"), F.round("change_5d", 5).alias("change_5d"), F.round("volatility", 5).alias("volatility"), shock.alias("shock")
    )


def commodity_snapshots(prices: DataFrame, dates: DataFrame) -> DataFrame:
    """One row per date with four (price, change, vol, shock) groups and the stress score."""
    filled = carry_forward(commodity_states(prices), dates, COMMODITY_SERIES)
    cols = []
    for name in COMMODITY_SERIES:
        cols += [
            F.coalesce(_pick(name, "price"), F.lit(0.0)).alias(f"{name}_price"),
            F.coalesce(_pick(name, "change_5d"), F.lit(0.0)).alias(f"{name}_change_5d"),
            F.coalesce(_pick(name, "volatility"), F.lit(0.0)).alias(f"{name}_volatility"),
            F.coalesce(_pick(name, "shock"), F.lit("neutral")).alias(f"{name}_shock"),
        ]
    wide = filled.groupBy("date").agg(*cols)
    return wide.withColumn("commodity_stress", stress_score([F.col(f"{n}_shock") for n in COMMODITY_SERIES], F.col("oil_volatility"), F.col("gas_volatility")))


def stress_score(shocks: list[Column], oil_vol: Column, gas_vol: Column) -> Column:
    share = sum(((s != "neutral").cast("int") for s in shocks), F.lit(0)) / 4.0
    return F.round(0.6 * share + 0.4 * F.least(F.lit(1.0), (oil_vol + gas_vol) / 2.0), 4)


def commodity_features(snapshots: DataFrame) -> DataFrame:
    cols: list[Column] = []
    for n in COMMODITY_SERIES:
        cols += [
            F.col(f"{n}_price").alias(f"commodity_{n}_price"),
            F.col(f"{n}_change_5d").alias(f"commodity_{n}_change_5d"),
            F.col(f"{n}_volatility").alias(f"commodity_{n}_vol"),
            *one_hot(f"{n}_shock", SHOCKS, f"commodity_{n}_shock"),
        ]
    return snapshots.select("date", *cols, "commodity_stress")
