"""Signal validation statistics.

Rows may carry a count column ``n`` for identical headlines, so headline-level
statistics run on (ticker, day, signal) counts and never shuffle raw news for a
second time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapewire import config
from tapewire.functions.dates import period_label
from tapewire.functions.labels import signal_of
from tapewire.functions.settle import settle
from tapewire.functions.stats import correlation_p, ratio, t_two_sided_p
from tapewire.operators.calendar import as_of_forward
from tapewire.operators.panel import forward_returns
from tapewire.operators.ranks import equal_frequency_bins, spearman
from tapewire.operators.signals import directional


def signal_return_table(scored: DataFrame, panel: DataFrame, cal: DataFrame, lags: list[int], threshold: float = config.VALIDATION_CONFIDENCE) -> DataFrame:
    """One row per directional headline with its forward returns; lag 1 must exist."""
    rows = directional(scored, threshold).withColumn("signal", signal_of("label_name")).withColumn("date", F.to_date("date"))
    entered = as_of_forward(rows, cal).withColumnRenamed("entry_pos", "pos")
    ahead = forward_returns(panel, sorted({1, *lags})).where("return_lag_1 is not null").drop("close")
    return entered.join(ahead, ["ticker", "pos"])


def signal_return_counts(scored: DataFrame, panel: DataFrame, cal: DataFrame, lags: list[int], threshold: float = config.VALIDATION_CONFIDENCE) -> DataFrame:
    """Same content with identical (date, ticker, signal) headlines counted before any join."""
    rows = directional(scored, threshold).select(F.to_date("date").alias("date"), "ticker", signal_of("label_name").alias("signal"))
    counts = rows.groupBy("date", "ticker", "signal").agg(F.count("*").alias("n"))
    entered = as_of_forward(counts, cal).withColumnRenamed("entry_pos", "pos")
    ahead = forward_returns(panel, sorted({1, *lags})).where("return_lag_1 is not null").drop("close")
    return entered.join(ahead, ["ticker", "pos"])


def attach_forward(signals: DataFrame, panel: DataFrame, cal: DataFrame, lags: list[int]) -> DataFrame:
    """Forward returns for an already daily signal table (as-of entry)."""
    entered = as_of_forward(signals, cal).withColumnRenamed("entry_pos", "pos")
    return entered.join(forward_returns(panel, lags).drop("close"), ["ticker", "pos"])


def by_lag(rows: DataFrame, lags: list[int], keep: list[str]) -> DataFrame:
    """Unpivot ``return_lag_k`` columns into (lag, ret)."""
    long = rows.unpivot(keep, [f"return_lag_{k}" for k in lags], "name", "ret").where("ret is not null")
    return long.withColumn("lag", F.regexp_extract("name", r"(\d+)$", 1).cast("int")).drop("name")


def hit_rate(rows: DataFrame, keys: list[str], ret: str, buy: Column | float = config.BUY_THRESHOLD, sell: Column | float = config.SELL_THRESHOLD, n: str | None = None) -> DataFrame:
    """Directional hit rate overall, for buys and for sells."""
    w = F.col(n) if n else F.lit(1)
    is_buy, is_sell = F.col("signal") > buy, F.col("signal") < sell
    total = lambda cond: F.coalesce(F.sum(F.when(cond, w)), F.lit(0))
    valid = rows.where(F.col(ret).isNotNull())
    agg = valid.groupBy(*keys).agg(
        total(is_buy).alias("n_buy"),
        total(is_sell).alias("n_sell"),
        total(is_buy & (F.col(ret) > 0)).alias("hb"),
        total(is_sell & (F.col(ret) < 0)).alias("hs"),
    )
    rate = lambda h, k: F.round(F.coalesce(ratio(h, k), F.lit(0.0)), 4)
    both = F.col("n_buy") + F.col("n_sell")
    return agg.select(
        *keys,
        rate(F.col("hb") + F.col("hs"), both).alias("overall"),
        rate(F.col("hb"), F.col("n_buy")).alias("buy"),
        rate(F.col("hs"), F.col("n_sell")).alias("sell"),
        "n_buy",
        "n_sell",
        both.alias("n_total"),
    )


def information_coefficient(
    rows: DataFrame, keys: list[str], ret: str, signal: str = "signal", n: str | None = None, min_n: int = 5, bounded: bool = False, thin: float | None = 0.0
) -> DataFrame:
    """IC with its p-value and 5% flag.  Groups below ``min_n`` get (``thin``, 1.0)."""
    s = spearman(rows, keys, signal, ret, n, bounded)
    enough = F.col("n") >= min_n
    p = F.when(enough, correlation_p("ic", "n")).otherwise(F.lit(1.0))
    out = s.withColumn("ic", F.when(enough, F.col("ic")).otherwise(F.lit(thin).cast("double"))).withColumn("p_value", p)
    return out.select(
        *keys,
        F.round("ic", 4).alias("ic"),
        F.round("p_value", 4).alias("p_value"),
        F.coalesce(F.col("p_value") < 0.05, F.lit(False)).alias("significant"),
        "n",
        F.round("t_stat", 4).alias("t_stat"),
    )


def ic_decay(rows: DataFrame, lags: list[int], n: str | None = None) -> DataFrame:
    keep = ["signal"] + ([n] if n else [])
    return information_coefficient(by_lag(rows, lags, keep), ["lag"], "ret", n=n)


def ic_by_ticker(rows: DataFrame, ret: str, n: str | None = None, min_n: int = 5) -> DataFrame:
    return information_coefficient(rows, ["ticker"], ret, n=n, min_n=min_n).where(F.col("n") >= min_n)


def factor_ics(factors: DataFrame, panel: DataFrame, cal: DataFrame, columns: list[str], lag: int = 2, min_n: int = 10) -> DataFrame:
    rows = settle(attach_forward(factors.select("date", "ticker", *columns), panel, cal, [lag]))
    long = rows.unpivot([f"return_lag_{lag}"], columns, "factor", "value")
    return information_coefficient(long, ["factor"], f"return_lag_{lag}", "value", min_n=min_n, thin=None)


def ic_by_period(rows: DataFrame, ret: str, freq: str, signal: str = "signal", min_n: int = 5) -> DataFrame:
    labelled = rows.withColumn("period", period_label("date", freq))
    return information_coefficient(labelled, ["period"], ret, signal, min_n=min_n, thin=None)


def daily_ic(rows: DataFrame, ret: str, signal: str = "signal", min_names: int = 5, keys: list[str] | None = None) -> DataFrame:
    """Cross-sectional IC per date; a date holds at most one row per ticker."""
    keys = keys or []
    s = spearman(rows, [*keys, "date"], signal, ret, bounded=True)
    return s.where((F.col("n") >= min_names) & F.col("ic").isNotNull()).select(*keys, "date", "n", "ic")


def ic_summary(ics: DataFrame, keys: list[str] | None = None, min_n: int = 3) -> DataFrame:
    """Mean IC, t statistic and information ratio (mean/std) of a series of ICs."""
    keys = keys or []
    agg = ics.groupBy(*keys).agg(F.avg("ic").alias("mean_ic"), F.stddev_samp("ic").alias("std_ic"), F.count("ic").alias("n_ic"))
    usable = (F.col("n_ic") >= min_n) & (F.col("std_ic") > 1e-9)
    std = F.nullif("std_ic", F.lit(0.0))
    return agg.select(
        "*",
        F.when(usable, F.col("mean_ic") / std).alias("icir"),
        F.when((F.col("n_ic") > 1) & (F.col("std_ic") > 0), F.col("mean_ic") / (std / F.sqrt("n_ic"))).alias("t_stat"),
    )


def quantile_returns(rows: DataFrame, ret: str, signal: str = "signal", bins: int = 5, n: str | None = None) -> DataFrame:
    """Mean signal, mean return and count per signal bin (repeated edges give fewer bins)."""
    w0 = F.col(n) if n else F.lit(1)
    # Equal (signal, return) rows are counted before anything reads them twice.
    valid = rows.where(F.col(ret).isNotNull() & F.col(signal).isNotNull()).groupBy(signal, ret).agg(F.sum(w0).alias("_n"))
    valid, n = settle(valid), "_n"
    binned = equal_frequency_bins(valid, [], signal, bins, "quantile", n)
    w = F.col(n)
    agg = binned.groupBy("quantile").agg(
        F.sum(F.col(signal) * w).alias("s"), F.sum(F.col(ret) * w).alias("r"), F.sum(w).alias("count")
    )
    total = valid.agg(F.sum(w)).scalar()
    return agg.where(total >= bins * 2).select(
        "quantile", (F.col("s") / F.col("count")).alias("mean_signal"), (F.col("r") / F.col("count")).alias("mean_return"), "count"
    )


def quantile_spread(quantiles: DataFrame) -> DataFrame:
    """Top minus bottom mean return; NULL with a single bin."""
    return quantiles.agg(
        F.count("*").alias("bins"),
        F.when(F.count("*") >= 2, F.max_by("mean_return", "quantile") - F.min_by("mean_return", "quantile")).alias("spread"),
    )


def calibration(rows: DataFrame, ret: str, bins: int = 5) -> DataFrame:
    """Hit rate per confidence bin over rows with a direction."""
    valid = rows.where(F.col(ret).isNotNull() & (F.abs("signal") > 0))
    correct = ((F.col("signal") > config.BUY_THRESHOLD) & (F.col(ret) > 0)) | ((F.col("signal") < config.SELL_THRESHOLD) & (F.col(ret) < 0))
    counts = settle(valid.groupBy("confidence", correct.alias("correct")).agg(F.count("*").alias("n")))
    binned = equal_frequency_bins(counts, [], "confidence", bins, "conf_bin", "n")
    total = counts.agg(F.sum("n")).scalar()
    agg = binned.groupBy("conf_bin").agg(
        F.sum(F.col("confidence") * F.col("n")).alias("s"),
        F.sum(F.when(F.col("correct"), F.col("n")).otherwise(0)).alias("h"),
        F.sum("n").alias("count"),
    )
    return agg.where(total >= bins * 2).select(
        "conf_bin", (F.col("s") / F.col("count")).alias("mean_confidence"), (F.col("h") / F.col("count")).alias("hit_rate"), "count"
    )


def conditional_ttest(rows: DataFrame, ret: str, n: str | None = None, keys: list[str] | None = None) -> DataFrame:
    """One-sample t-test of buy and sell returns against 0; significant only in the traded direction."""
    keys = keys or []
    side = F.when(F.col("signal") > config.BUY_THRESHOLD, "buy").when(F.col("signal") < config.SELL_THRESHOLD, "sell")
    w = (F.col(n) if n else F.lit(1)).cast("double")
    valid = rows.where(F.col(ret).isNotNull()).withColumn("side", side).where("side is not null")
    agg = valid.groupBy(*keys, "side").agg(F.sum(w).alias("k"), F.sum(F.col(ret) * w).alias("s"), F.sum(F.col(ret) * F.col(ret) * w).alias("ss"))
    mean = F.col("s") / F.col("k")
    var = (F.col("ss") - F.col("k") * mean * mean) / F.nullif(F.col("k") - 1, F.lit(0.0))
    t = F.when(var > 0, mean / F.sqrt(var / F.col("k")))
    enough = F.col("k") >= 3
    agg = agg.withColumn("mean", mean).withColumn("t", t).withColumn("p", F.when(enough, t_two_sided_p("t", F.col("k") - 1)).otherwise(1.0))
    towards = F.when(F.col("side") == "buy", F.col("mean") > 0).otherwise(F.col("mean") < 0)
    return agg.select(
        *keys,
        "side",
        F.when(enough, F.round("mean", 6)).otherwise(0.0).alias("mean_return"),
        F.when(enough, F.round("t", 4)).otherwise(0.0).alias("t_stat"),
        F.round("p", 4).alias("p_value"),
        F.coalesce(enough & (F.col("p") < 0.05) & towards, F.lit(False)).alias("significant"),
        F.col("k").cast("long").alias("n"),
    )


def welch_test(df: DataFrame, value: str, is_first: Column, n: Column | None = None) -> DataFrame:
    """Two-sample t-test with unequal variances between rows where ``is_first`` holds and the rest."""
    w = (F.lit(1) if n is None else n).cast("double")

    def moments(cond: Column, tag: str) -> list[Column]:
        x = F.when(cond, F.col(value))
        return [
            F.coalesce(F.sum(F.when(cond, w)), F.lit(0.0)).alias(f"n{tag}"),
            F.sum(x * w).alias(f"s{tag}"),
            F.sum(x * x * w).alias(f"q{tag}"),
        ]

    m = df.agg(*moments(is_first, "1"), *moments(~is_first, "2"))

    def variance(tag: str) -> Column:
        k = F.col(f"n{tag}")
        mean = F.col(f"s{tag}") / F.nullif(k, F.lit(0.0))
        return (F.col(f"q{tag}") - k * mean * mean) / F.nullif(k - 1, F.lit(0.0)) / F.nullif(k, F.lit(0.0))

    v1, v2 = variance("1"), variance("2")
    m1, m2 = F.col("s1") / F.nullif("n1", F.lit(0.0)), F.col("s2") / F.nullif("n2", F.lit(0.0))
    enough = (F.col("n1") >= 2) & (F.col("n2") >= 2)
    t = (m1 - m2) / F.nullif(F.sqrt(v1 + v2), F.lit(0.0))
    dof = (v1 + v2) * (v1 + v2) / F.nullif(v1 * v1 / F.nullif(F.col("n1") - 1, F.lit(0.0)) + v2 * v2 / F.nullif(F.col("n2") - 1, F.lit(0.0)), F.lit(0.0))
    out = m.withColumn("t", t).withColumn("dof", dof)
    p = t_two_sided_p("t", "dof")
    return out.select(
        F.col("n1").cast("long").alias("n_first"),
        F.col("n2").cast("long").alias("n_rest"),
        F.when(enough, F.round("t", 4)).otherwise(0.0).alias("t_stat"),
        F.when(enough, F.col("dof")).alias("dof"),
        F.when(enough, F.round(p, 4)).otherwise(1.0).alias("p_value"),
        F.coalesce(enough & (p < 0.05), F.lit(False)).alias("significant"),
    )


def linear_fit(rows: DataFrame, x: str, y: str, n: str | None = None) -> DataFrame:
    """Least-squares line of y on x with R-squared and the slope's t statistic."""
    w = (F.col(n) if n else F.lit(1)).cast("double")
    valid = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    # Two passes: centring on the means keeps the sums free of cancellation.
    mean_x, mean_y = F.sum(F.col(x) * w) / F.sum(w), F.sum(F.col(y) * w) / F.sum(w)
    means = valid.agg(F.struct(mean_x.alias("mx"), mean_y.alias("my")).alias("m")).scalar()
    dx = F.col(x) - means["mx"]
    dy = F.col(y) - means["my"]
    m = valid.agg(
        F.sum(w).alias("k"),
        F.sum(dx * dx * w).alias("sxx"),
        F.sum(dy * dy * w).alias("syy"),
        F.sum(dx * dy * w).alias("sxy"),
        (F.sum(F.col(x) * w) / F.sum(w)).alias("mx"),
        (F.sum(F.col(y) * w) / F.sum(w)).alias("my"),
    )
    slope = ratio("sxy", "sxx")
    r = F.col("sxy") / F.nullif(F.sqrt(F.col("sxx") * F.col("syy")), F.lit(0.0))
    m = m.withColumn("slope", slope).withColumn("r", r)
    return m.select(
        "slope",
        (F.col("my") - F.col("slope") * F.col("mx")).alias("intercept"),
        (F.col("r") * F.col("r")).alias("r_squared"),
        correlation_p("r", "k").alias("p_value"),
        F.col("k").cast("long").alias("n"),
    )


def validation_verdict(hit: DataFrame, decay: DataFrame, ttest: DataFrame) -> DataFrame:
    """Count of green checks (hit rate, lag-1 IC, significant buys) and the verdict."""
    h = hit.agg(F.max("overall")).scalar()
    ic = decay.where("lag = 1").agg(F.max("ic")).scalar()
    buy = ttest.where("side = 'buy'").agg(F.bool_or("significant")).scalar()
    one = hit.agg(F.count("*").alias("_c"))
    green = F.coalesce((h >= 0.55).cast("int"), F.lit(0)) + F.coalesce((ic > 0.02).cast("int"), F.lit(0)) + F.coalesce(buy.cast("int"), F.lit(0))
    verdict = F.when(F.col("n_green") >= 2, "predictive").when(F.col("n_green") == 1, "weak").otherwise("none")
    return one.select(green.alias("n_green")).withColumn("verdict", verdict)


def walk_forward_summary(periods: DataFrame) -> DataFrame:
    """Roll-up of per-period Sharpe and IC with the pass rule."""
    v = periods.where("sharpe is not null")
    s = v.agg(
        F.count("*").alias("n_periods"),
        F.avg("sharpe").alias("mean_sharpe"),
        F.avg((F.col("sharpe") > 0).cast("double")).alias("pct_positive_sharpe"),
        F.avg("ic_mean").alias("mean_ic"),
        F.avg(F.coalesce((F.col("ic_mean") > 0).cast("double"), F.lit(0.0))).alias("pct_positive_ic"),
        F.stddev_samp("ic_mean").alias("std_ic"),
    )
    icir = F.when(F.col("std_ic") > 1e-9, F.col("mean_ic") / F.nullif("std_ic", F.lit(0.0)) * F.sqrt("n_periods"))
    verdict = (
        F.when((F.col("pct_positive_sharpe") >= 0.60) & (F.col("mean_sharpe") > 0), "PASS")
        .when(F.col("pct_positive_sharpe") >= 0.50, "BORDERLINE")
        .otherwise("FAIL")
    )
    return s.select("*", icir.alias("icir"), verdict.alias("verdict")).drop("std_ic")
