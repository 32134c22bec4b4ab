"""Price factors for signal rows and their combination."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tapewire import config
from tapewire.functions.settle import settle
from tapewire.functions.stats import clip, ratio
from tapewire.operators.calendar import as_of_forward, with_pos
from tapewire.operators.panel import at_offset, attach_points, by_ticker, returns_from_closes, rolling_log_vol
from tapewire.operators.signals import zscore

FACTORS = ["momentum", "vol_factor", "liquidity"]
COLUMN_OF = {"sentiment": "signal", "momentum": "momentum", "volatility": "vol_factor", "liquidity": "liquidity"}


def raw_factors(panel: DataFrame, points: DataFrame, mom_window: int = 21, skip: int = 2, vol_window: int = 20, liq_window: int = 20) -> DataFrame:
    """Unstandardised factors at (ticker, pos) points, which need not have a print themselves.

    One window pass over the panel plus the points; positions before the first
    day clamp to day 0.
    """
    quoted = panel.select("ticker").distinct()
    both = attach_points(returns_from_closes(panel), points.join(quoted, "ticker", "left_semi"))
    pos = F.col("pos")
    first = F.max(F.when((pos == 0), F.col("close"))).over(W.partitionBy("ticker"))
    start = F.when(pos >= mom_window + skip, at_offset("close", -(mom_window + skip))).otherwise(first)
    end = F.when(pos >= skip, at_offset("close", -skip)).otherwise(first)
    momentum = F.when(pos > skip, (end - start) / F.nullif(start, F.lit(0.0)))

    vol_frame = by_ticker().rangeBetween(-(vol_window - 1), -1)
    vol = F.stddev_samp("ret").over(vol_frame) * math.sqrt(config.TRADING_DAYS)
    enough = (pos >= 4) & (F.count("ret").over(vol_frame) >= 3)
    vol_factor = F.when(enough & (vol > 1e-8), -vol)

    liq_frame = by_ticker().rangeBetween(-liq_window, -1)
    mean_dv = F.avg(F.col("close") * F.col("volume")).over(liq_frame)
    liquidity = F.when((pos >= 4) & (mean_dv > 0), F.ln(F.when(mean_dv > 0, mean_dv)))
    return (
        both.select("ticker", "pos", "_point", momentum.alias("momentum"), vol_factor.alias("vol_factor"), liquidity.alias("liquidity"))
        .where("_point")
        .drop("_point")
    )


def factor_matrix(signals: DataFrame, panel: DataFrame, cal: DataFrame, keys: tuple[str, ...] = (), use_volume: bool = True) -> DataFrame:
    """Attach the three z-scored factors to each (keys, date, ticker) signal row.

    Standardisation covers the tickers that have a signal on that date.  Factors
    are rounded to 9 places, so equal scores rank as equal whatever order the
    sums ran in.
    """
    signals = settle(signals)
    entered = as_of_forward(signals, cal).withColumnRenamed("entry_pos", "pos")
    raw = raw_factors(panel, entered)
    rows = entered.join(raw, ["ticker", "pos"], "left")
    group = [*keys, "date"]
    cols: list[Column] = [F.round(zscore(c, group), 9).alias(c) for c in ("momentum", "vol_factor")]
    cols.append(F.round(zscore("liquidity", group), 9).alias("liquidity") if use_volume else F.lit(None).cast("double").alias("liquidity"))
    return rows.select(*signals.columns, *cols)


def merged_weights(weights: dict[str, float] | None) -> dict[str, float]:
    w = {**config.DEFAULT_FACTOR_WEIGHTS, **(weights or {})}
    total = sum(abs(v) for v in w.values()) or 1.0
    return {k: v / total for k, v in w.items()}


def combine_factors(factors: DataFrame, weights: dict[str, float] | None = None, out: str = "combined_score") -> DataFrame:
    """Weighted sum of the factors; a missing factor counts as 0."""
    score = F.lit(0.0)
    for name, weight in merged_weights(weights).items():
        if abs(weight) >= 1e-9 and COLUMN_OF[name] in factors.columns:
            score = score + F.lit(weight) * F.coalesce(F.col(COLUMN_OF[name]), F.lit(0.0))
    return factors.withColumn(out, F.round(score, 6))


def combine_by_columns(factors: DataFrame, out: str = "combined_score") -> DataFrame:
    """Same with the weights w_s, w_m, w_v, w_l as columns of a parameter row."""
    parts = [("w_s", "signal"), ("w_m", "momentum"), ("w_v", "vol_factor"), ("w_l", "liquidity")]
    total = sum((F.abs(w) for w, _ in parts), F.lit(0.0))
    score = sum((F.col(w) / total * F.coalesce(F.col(c), F.lit(0.0)) for w, c in parts), F.lit(0.0))
    return factors.withColumn(out, F.round(score, 6))


def weights_label(row: tuple[float, float, float, float]) -> str:
    return "+".join(f"{tag}{int(w * 100)}" for tag, w in zip("SMVL", row) if w)


def vol_target(rows: DataFrame, panel: DataFrame, cal: DataFrame, col: str = "combined_score", target: float = 0.15) -> DataFrame:
    """Scale ``col`` by target / volatility of the trading day strictly before the date, clipped to +-3.

    Missing or tiny volatility counts as 1.0.
    """
    vols = rolling_log_vol(panel).select("ticker", (F.col("pos") + 1).alias("pos"), "rolling_vol")
    entered = as_of_forward(rows, cal).withColumnRenamed("entry_pos", "pos").join(vols, ["ticker", "pos"], "left")
    vol = F.when(F.col("rolling_vol") > 0.01, F.col("rolling_vol")).otherwise(F.lit(1.0))
    return entered.withColumn(col, clip(F.col(col) * (target / vol), -3.0, 3.0)).drop("pos", "rolling_vol")


def vix_damp(rows: DataFrame, vix: DataFrame, col: str = "combined_score", level: float = 30.0, reduction: float = 0.5) -> DataFrame:
    """Scale positive scores down on dates whose VIX is above ``level`` (exact date)."""
    high = vix.where(F.col("level") > level).select("date", F.lit(True).alias("_high"))
    joined = rows.join(F.broadcast(high), "date", "left")
    damp = F.coalesce("_high", F.lit(False)) & (F.col(col) > 0)
    return joined.withColumn(col, F.when(damp, F.col(col) * reduction).otherwise(F.col(col))).drop("_high")


def market_features(panel: DataFrame, bench: DataFrame) -> DataFrame:
    """Market features per (ticker, pos) over the ticker's own prints.

    ``bench``: (pos, close) of the benchmark.  Beta keeps the mixed degrees of
    freedom of the reference (sample covariance over population variance).
    """
    w = W.partitionBy("ticker").orderBy("pos")
    bw = W.orderBy("pos")
    base = lambda col, k, win: F.lag(col, k).over(win)
    change = lambda col, k, win: F.coalesce((F.col(col) - base(col, k, win)) / F.abs(F.nullif(base(col, k, win), F.lit(0.0))), F.lit(0.0))

    def vol(col: str, win) -> Column:
        frame = win.rowsBetween(-19, 0)
        return F.coalesce(F.when(F.count(col).over(frame) == 20, F.stddev_samp(col).over(frame) * math.sqrt(config.TRADING_DAYS)), F.lit(0.0))

    b = bench.withColumn("_br", ratio("close", F.lag("close").over(bw)) - 1)
    b = b.select(
        "pos",
        "_br",
        change("close", 5, bw).alias("market_bench_5d_ret"),
        change("close", 20, bw).alias("market_bench_20d_ret"),
        vol("_br", bw).alias("market_bench_vol_20d"),
    )
    t = panel.where("close is not null").select("ticker", "date", "pos", "close")
    t = t.withColumn("_ret", ratio("close", F.lag("close").over(w)) - 1).withColumn("_d", F.col("close") - F.lag("close").over(w))
    t = t.join(F.broadcast(b), "pos", "left")
    f60, f14 = w.rowsBetween(-59, 0), w.rowsBetween(-13, 0)
    pair = F.col("_ret").isNotNull() & F.col("_br").isNotNull()
    x, y = F.when(pair, F.col("_ret")), F.when(pair, F.col("_br"))
    full = F.count(x).over(f60) == 60
    var = F.var_pop(y).over(f60)
    beta = F.when(full, F.when(var > 0, F.covar_samp(x, y).over(f60) / F.nullif(var, F.lit(0.0))).otherwise(1.0)).otherwise(0.0)
    gain, loss = F.avg(F.greatest("_d", F.lit(0.0))).over(f14), F.avg(F.greatest(-F.col("_d"), F.lit(0.0))).over(f14)
    rsi = F.when(F.count("_d").over(f14) < 14, 0.0).when(loss == 0, 100.0).otherwise(100 - 100 / (1 + gain / F.nullif(loss, F.lit(0.0))))
    return t.select(
        "date",
        "ticker",
        "pos",
        "market_bench_5d_ret",
        "market_bench_20d_ret",
        "market_bench_vol_20d",
        change("close", 5, w).alias("market_ticker_5d_ret"),
        change("close", 20, w).alias("market_ticker_20d_ret"),
        vol("_ret", w).alias("market_ticker_vol_20d"),
        beta.alias("market_ticker_beta"),
        rsi.alias("market_rsi_14"),
    )


def training_labels(rows: DataFrame, panel: DataFrame, cal: DataFrame, forward: int = config.FORWARD_DAYS) -> DataFrame:
    """Base price at or after the date, label from the (forward+1)-th own print after the date.

    Works on the ticker's own prints; distinct (ticker, date) pairs are resolved
    once and joined back.
    """
    w = W.partitionBy("ticker").orderBy("pos")
    prints = panel.where("close is not null").select("ticker", "pos", "close", F.row_number().over(w).alias("k"))
    wanted = rows.select("ticker", "date").distinct()
    entered = as_of_forward(wanted, cal).withColumnRenamed("entry_pos", "pos")
    exact = with_pos(wanted, cal, pos="same").select("ticker", "date", "same")
    entered = entered.join(exact, ["ticker", "date"], "left")
    both = prints.select("ticker", "pos", "close", "k").unionByName(entered.select("ticker", "pos", "date", "same"), allowMissingColumns=True)
    ahead = w.rangeBetween(W.currentRow, W.unboundedFollowing)
    both = both.withColumn("base_k", F.min("k").over(ahead))
    # First print strictly after the signal day: a print on the day itself is skipped.
    strictly = w.rangeBetween(1, W.unboundedFollowing)
    both = both.withColumn("after_k", F.when(F.col("same").isNotNull(), F.min("k").over(strictly)).otherwise(F.col("base_k")))
    asked = both.where("date is not null and base_k is not null and after_k is not null")
    by_k = prints.select("ticker", "k", "close")
    out = asked.select("ticker", "date", "base_k", (F.col("after_k") + forward).alias("future_k"))
    out = out.join(by_k.select("ticker", F.col("k").alias("base_k"), F.col("close").alias("base_close")), ["ticker", "base_k"])
    out = out.join(by_k.select("ticker", F.col("k").alias("future_k"), F.col("close").alias("future_close")), ["ticker", "future_k"])
    ret = (F.col("future_close") - F.col("base_close")) / F.nullif("base_close", F.lit(0.0))
    label = F.when(ret > 0.005, 1).when(ret < -0.005, -1).otherwise(0)
    return out.where("base_close <> 0").select("ticker", "date", ret.alias("fwd_ret"), label.alias("label"))
