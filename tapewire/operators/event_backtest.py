"""Event back-test: next-day returns of daily signals and the portfolio metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tapewire import config
from tapewire.functions.labels import position_of
from tapewire.functions.settle import settle
from tapewire.functions.stats import ratio, sharpe
from tapewire.operators.panel import next_day_returns

YEAR = float(config.TRADING_DAYS)


def strategy_returns(
    signals: DataFrame,
    panel: DataFrame,
    buy: Column | float = config.BUY_THRESHOLD,
    sell: Column | float = config.SELL_THRESHOLD,
    cost_bps: float = config.TRANSACTION_COST_BPS + config.SLIPPAGE_BPS,
) -> DataFrame:
    """Join signals to the next-day return on the exact trading date and charge the round trip."""
    ahead = next_day_returns(panel).where("next_ret is not null").select("date", "ticker", "next_ret")
    rows = signals.join(ahead, ["date", "ticker"]).withColumn("position", position_of("signal", buy, sell))
    cost = F.abs("position") * F.lit(cost_bps / 10_000.0)
    gross = F.col("position") * F.col("next_ret")
    return rows.select(
        *[c for c in signals.columns if c not in ("avg_confidence", "headline_count")],
        "position",
        (gross - cost).alias("strategy_return"),
        gross.alias("gross_strategy_return"),
        F.col("next_ret").alias("benchmark_return"),
        cost.alias("cost_drag"),
    )


def daily_portfolio(returns: DataFrame, keys: list[str]) -> DataFrame:
    """Equal-weight mean strategy and benchmark return per date."""
    return returns.groupBy(*keys, "date").agg(
        F.avg("strategy_return").alias("strat"), F.avg("benchmark_return").alias("bench")
    )


def equity_curve(daily: DataFrame, keys: list[str], ret: str = "strat", order: str = "date") -> DataFrame:
    """Cumulative growth, running peak and drawdown.

    Runs on per-date rows partitioned by strategy, so a partition holds at most
    one row per trading day.
    """
    w = W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
    curve = daily.withColumn("equity", F.product(1 + F.col(ret)).over(w))
    curve = curve.withColumn("peak", F.max("equity").over(w))
    return curve.withColumn("drawdown", ratio(F.col("equity") - F.col("peak"), "peak"))


def turnover_by_date(returns: DataFrame, keys: list[str]) -> DataFrame:
    w = W.partitionBy(*keys, "ticker").orderBy("date")
    change = F.coalesce(F.abs(F.col("position") - F.lag("position").over(w)), F.lit(0))
    return returns.withColumn("pos_change", change).groupBy(*keys, "date").agg(F.sum("pos_change").alias("turnover"))


def portfolio_metrics(returns: DataFrame, keys: list[str]) -> DataFrame:
    """All metrics per key (model, ticker, parameter set ...), one row each.

    Alpha keeps the reference formula, which mixes the annualised strategy
    return with the benchmark's total return.
    """
    returns = settle(returns)
    rf_day = config.RISK_FREE_RATE / YEAR
    daily = equity_curve(daily_portfolio(returns, keys), keys)
    loss = F.when(F.col("strat") < 0, F.col("strat"))
    base = daily.groupBy(*keys).agg(
        F.count("*").alias("n_days"),
        (F.product(1 + F.col("strat")) - 1).alias("tot"),
        (F.product(1 + F.col("bench")) - 1).alias("bench_tot"),
        F.avg(F.col("strat") - rf_day).alias("ex_mean"),
        F.stddev_samp(F.col("strat") - rf_day).alias("ex_std"),
        F.stddev_samp("strat").alias("std"),
        F.count(loss).alias("n_loss"),
        F.stddev_samp(loss).alias("loss_std"),
        F.min("drawdown").alias("max_dd"),
        F.covar_samp("strat", "bench").alias("cov"),
        F.var_samp("bench").alias("bench_var"),
    )
    active = F.col("position") != 0
    trades = returns.groupBy(*keys).agg(
        F.count_if(active).alias("total_trades"),
        F.count_if(active & (F.col("strategy_return") > 0)).alias("wins"),
        F.count_distinct(F.when(active, F.col("date"))).alias("active_days"),
        F.sum("cost_drag").alias("cost"),
    )
    turn = turnover_by_date(returns, keys).groupBy(*keys).agg(F.avg("turnover").alias("turn"))
    m = base.join(trades, keys).join(turn, keys)
    m = m.withColumn("ann", F.pow(1 + F.col("tot"), YEAR / F.col("n_days")) - 1)
    down = F.when(F.col("n_loss") > 1, F.col("loss_std") * YEAR**0.5).otherwise(F.lit(1e-9))
    m = m.withColumn("beta", F.when(F.col("bench_var") > 0, ratio("cov", "bench_var")).otherwise(0.0))
    alpha = F.when(
        F.col("bench_var") > 0,
        F.col("ann") - (config.RISK_FREE_RATE + F.col("beta") * (F.col("bench_tot") - config.RISK_FREE_RATE)),
    ).otherwise(0.0)
    r4 = lambda c: F.round(c, 4)
    return m.select(
        *keys,
        r4("tot").alias("total_return"),
        r4("bench_tot").alias("benchmark_total_return"),
        r4("ann").alias("annualised_return"),
        r4(F.col("std") * YEAR**0.5).alias("annualised_volatility"),
        r4(sharpe(F.col("ex_mean"), F.col("ex_std"), F.lit(YEAR))).alias("sharpe_ratio"),
        r4(F.when(down > 0, (F.col("ann") - config.RISK_FREE_RATE) / F.nullif(down, F.lit(0.0))).otherwise(0.0)).alias("sortino_ratio"),
        r4(F.when(F.abs("max_dd") > 1e-9, F.col("ann") / F.abs(F.nullif("max_dd", F.lit(0.0)))).otherwise(0.0)).alias("calmar_ratio"),
        r4("max_dd").alias("max_drawdown"),
        r4(F.coalesce(ratio("wins", "total_trades"), F.lit(0.0))).alias("win_rate"),
        r4(alpha).alias("alpha"),
        r4("beta").alias("beta"),
        "total_trades",
        "n_days",
        F.round(F.col("turn") * YEAR, 2).alias("ann_turnover"),
        F.round(F.when(F.col("total_trades") > 0, F.col("active_days") / F.greatest(F.lit(1), "total_trades")).otherwise(0.0), 1).alias(
            "avg_holding_period_days"
        ),
        F.round("cost", 6).alias("total_cost_drag"),
    )


def drawdown_blocks(curve: DataFrame, keys: list[str], order: str = "date") -> DataFrame:
    """Contiguous runs with a negative drawdown as (first_day, last_day, days).

    A drawdown within rounding (1e-12) of the peak is none.
    """
    w = W.partitionBy(*keys).orderBy(order)
    flagged = curve.withColumn("under", (F.col("drawdown") < -1e-12).cast("int"))
    starts = F.when(F.col("under") != F.coalesce(F.lag("under").over(w), F.lit(-1)), 1).otherwise(0)
    island = flagged.withColumn("_start", starts)
    island = island.withColumn("_island", F.sum("_start").over(w.rowsBetween(W.unboundedPreceding, W.currentRow)))
    return (
        island.where("under = 1")
        .groupBy(*keys, "_island")
        .agg(F.min(order).alias("first_day"), F.max(order).alias("last_day"), F.count("*").alias("days"), F.min("drawdown").alias("depth"))
        .drop("_island")
    )


def rolling_sharpe(daily: DataFrame, keys: list[str], ret: str = "strat", window: int = 60) -> DataFrame:
    """Sharpe over the last ``window`` rows, NULL until full or when flat."""
    excess = daily.withColumn("_ex", F.col(ret) - config.RISK_FREE_RATE / YEAR)
    w = W.partitionBy(*keys).orderBy("date").rowsBetween(-(window - 1), 0)
    std = F.stddev_samp("_ex").over(w)
    full = (F.count("_ex").over(w) == window) & (std > 0)
    value = F.when(full, F.avg("_ex").over(w) / F.nullif(std, F.lit(0.0)) * YEAR**0.5)
    return excess.withColumn("rolling_sharpe", value).drop("_ex")
