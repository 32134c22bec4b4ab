"""Cross-sectional long-short back-test for any number of strategies at once.

A strategy is a ``run`` id with its parameter columns on the signal rows:
``hold_days``, ``cutoff``, ``cost_bps``, ``weighting`` (equal | vol_scaled),
``vix_filter``.  Every step groups by ``run``, so a grid of settings is one job.
Per run the data is a daily cross-section, bounded by days x tickers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tapewire import config
from tapewire.functions.dates import weekday_gap
from tapewire.functions.settle import settle
from tapewire.functions.stats import correlation_p, sharpe
from tapewire.operators.calendar import as_of_backward, explode_params, forward_positions, rebalance_dates
from tapewire.operators.event_backtest import equity_curve
from tapewire.operators.panel import realised_vol
from tapewire.operators.ranks import spearman

PARAMS = ["hold_days", "cutoff", "cost_bps", "weighting", "vix_filter"]


def strategy(
    run: str,
    hold_days: int = config.HOLD_DAYS,
    cutoff: float = config.QUANTILE_CUTOFF,
    cost_bps: float = config.TRANSACTION_COST_BPS + config.SLIPPAGE_BPS,
    weighting: str = "equal",
    vix_filter: bool = False,
    **extra: object,
) -> dict:
    """One parameter set."""
    return {
        "run": run,
        "hold_days": int(hold_days),
        "cutoff": float(cutoff),
        "cost_bps": float(cost_bps),
        "weighting": weighting,
        "vix_filter": bool(vix_filter),
        **extra,
    }


def with_strategies(signals: DataFrame, rows: list[dict]) -> DataFrame:
    """Pair the daily signals, read once, with every parameter set."""
    return explode_params(settle(signals), rows)


def rank_positions(day: DataFrame, keys: list[str], signal: str = "signal") -> DataFrame:
    """Position +1 / -1 / 0 per cross-section: top and bottom floor(n*cutoff), at least one each.

    Fewer than four names gives 0; on overlap the short side wins; ties break on ticker.
    """
    w = W.partitionBy(*keys)
    ranked = day.withColumn("_n", F.count(F.lit(1)).over(w)).withColumn(
        "_rn", F.row_number().over(w.orderBy(F.desc(signal), "ticker"))
    )
    each = F.greatest(F.lit(1), F.floor(F.col("_n") * F.col("cutoff")))
    pos = (
        F.when(F.col("_n") < 4, 0)
        .when(F.col("_rn") > F.col("_n") - each, -1)
        .when(F.col("_rn") <= each, 1)
        .otherwise(0)
    )
    return ranked.withColumn("position", pos).drop("_n", "_rn")


def rebalance_book(signals: DataFrame, panel: DataFrame, cal: DataFrame, vix: DataFrame | None = None) -> DataFrame:
    """Active positions with weights per (run, rebalance date).

    ``signals``: run + parameters + date, ticker, signal.
    """
    schedule = rebalance_dates(signals.select("run", "date", "hold_days").distinct(), ["run"])
    quoted = panel.select("ticker").distinct()
    day = signals.join(schedule, ["run", "date"]).join(quoted, "ticker", "left_semi")
    active = rank_positions(day, ["run", "date"]).where("position <> 0")
    entry = forward_positions(cal.select("date").unionByName(signals.select("date").distinct()).distinct(), cal)
    last = cal.agg(F.max("pos")).scalar()
    active = active.join(F.broadcast(entry), "date").withColumn("exit_pos", F.col("entry_pos") + F.col("hold_days"))
    active = active.where(F.col("exit_pos") <= last)
    if vix is None:
        active = active.withColumn("vix_level", F.lit(config.VIX_DEFAULT))
    else:
        active = as_of_backward(active, vix, "level", config.VIX_DEFAULT, out="vix_level")
    vols = realised_vol(panel, active.where("weighting = 'vol_scaled'").select("ticker", F.col("entry_pos").alias("pos")))
    active = active.join(vols.withColumnRenamed("pos", "entry_pos"), ["ticker", "entry_pos"], "left")
    book = W.partitionBy("run", "date")
    side = W.partitionBy("run", "date", "position")
    n_side = F.count(F.lit(1)).over(side)
    both = F.count(F.lit(1)).over(book) > n_side
    equal = F.when(both, 1.0 / n_side).otherwise(F.lit(0.5))
    inverse = 1.0 / F.greatest(F.col("vol"), F.lit(1e-6))
    active = active.withColumn("_inv", inverse)
    raw = F.when(F.col("weighting") == "vol_scaled", F.col("_inv") / F.sum("_inv").over(side)).otherwise(equal)
    scale = F.when(F.col("vix_filter") & (F.col("vix_level") > config.VIX_RISK_OFF), config.VIX_EXPOSURE_SCALE).otherwise(1.0)
    return active.withColumn("weight", raw * scale).drop("_inv", "vol")


def fill_trades(book: DataFrame, panel: DataFrame, cal: DataFrame) -> DataFrame:
    """Entry and exit prices by position; trades without both prices drop out."""
    px = panel.where("close is not null").select("ticker", "pos", "close")
    entry = px.select("ticker", F.col("pos").alias("entry_pos"), F.col("close").alias("p_entry"))
    exit_ = px.select("ticker", F.col("pos").alias("exit_pos"), F.col("close").alias("p_exit"))
    rows = book.join(entry, ["ticker", "entry_pos"]).join(exit_, ["ticker", "exit_pos"]).where("p_entry <> 0 and weight <> 0")
    days = cal.select("date", "pos")
    rows = rows.join(F.broadcast(days.select(F.col("pos").alias("entry_pos"), F.col("date").alias("entry_date"))), "entry_pos")
    rows = rows.join(F.broadcast(days.select(F.col("pos").alias("exit_pos"), F.col("date").alias("exit_date"))), "exit_pos")
    period = (F.col("p_exit") - F.col("p_entry")) / F.nullif("p_entry", F.lit(0.0))
    cost = F.col("cost_bps") / 10_000.0 * F.col("weight")
    rows = rows.withColumn("_pr", period)
    return rows.select(
        "run",
        *PARAMS,
        F.col("date").alias("rebalance_date"),
        "entry_date",
        "exit_date",
        "ticker",
        "signal",
        "position",
        F.round("weight", 6).alias("weight"),
        F.round("_pr", 6).alias("period_return"),
        F.round(F.col("position") * F.col("weight") * F.col("_pr") - cost, 6).alias("ls_return"),
        F.round(cost, 6).alias("cost_drag"),
        F.round("vix_level", 2).alias("vix_level"),
    )


def long_short(signals: DataFrame, panel: DataFrame, cal: DataFrame, vix: DataFrame | None = None) -> DataFrame:
    """Trade table of every run."""
    return fill_trades(rebalance_book(signals, panel, cal, vix), panel, cal)


def holdings_turnover(book: DataFrame) -> DataFrame:
    """|current xor previous| / max(|current|, |previous|) between consecutive rebalances of a run.

    The overlap is counted with a lag per (run, ticker), so no holdings set is collected.
    """
    sizes = book.groupBy("run", "date").agg(F.count("*").alias("held"), F.sum(F.abs("weight")).alias("gross"))
    w = W.partitionBy("run").orderBy("date")
    sizes = sizes.withColumn("k", F.row_number().over(w)).withColumn("prev_held", F.lag("held").over(w))
    numbered = book.select("run", "date", "ticker").join(sizes.select("run", "date", "k"), ["run", "date"])
    stays = (F.lag("k").over(W.partitionBy("run", "ticker").orderBy("k")) == F.col("k") - 1).cast("int")
    kept = numbered.withColumn("_stay", F.coalesce(stays, F.lit(0))).groupBy("run", "date").agg(F.sum("_stay").alias("kept"))
    out = sizes.join(kept, ["run", "date"])
    moved = F.col("held") + F.col("prev_held") - 2 * F.col("kept")
    return out.select("run", "date", "held", "gross", (moved / F.greatest("held", "prev_held")).alias("turnover"))


def book_summary(book: DataFrame) -> DataFrame:
    """Average turnover and gross exposure per run."""
    return holdings_turnover(book).groupBy("run").agg(
        F.round(F.avg("gross"), 4).alias("avg_gross_exposure"), F.round(F.avg("turnover"), 4).alias("avg_turnover")
    )


def _exact(col: Column) -> Column:
    """The decimal that a double is written as; NULL for what does not fit (NaN, infinity)."""
    return col.try_cast("decimal(32,20)")


def exact_total(col: str) -> Column:
    """Sum of returns as decimals, the same in any order of the rows: a period of 0.1, 0.2 and -0.3 gives 0."""
    x = F.col(col)
    return F.when(F.count(_exact(x)) == F.count(x), F.sum(_exact(x)).cast("double")).otherwise(F.sum(x))


def period_pnl(trades: DataFrame, keys: list[str]) -> DataFrame:
    return trades.groupBy(*keys, "rebalance_date").agg(exact_total("ls_return").alias("net_return"))


def positions_per_side(trades: DataFrame, keys: list[str]) -> DataFrame:
    per = trades.groupBy(*keys, "rebalance_date").agg(F.count_if(F.col("position") == 1).alias("k"))
    return per.groupBy(*keys).agg(F.round(F.avg("k"), 1).alias("avg_positions_per_side"))


def _period_stats(pnl: DataFrame, keys: list[str], per_year: Column) -> DataFrame:
    """Moments, growth and worst drawdown of the period returns; ``per_year`` is a column of ``pnl``."""
    curve = equity_curve(pnl.withColumn("_py", per_year), keys, "net_return", "rebalance_date")
    excess = F.col("net_return") - config.RISK_FREE_RATE / F.col("_py")
    loss = F.when(F.col("net_return") < 0, F.col("net_return"))
    return curve.groupBy(*keys).agg(
        F.count("*").alias("n_periods"),
        F.max("_py").alias("py"),
        (F.product(1 + F.col("net_return")) - 1).alias("tot"),
        F.avg(excess).alias("ex_mean"),
        F.stddev_samp(excess).alias("ex_std"),
        F.stddev_samp("net_return").alias("std"),
        F.count(loss).alias("n_loss"),
        F.stddev_samp(loss).alias("loss_std"),
        F.min("drawdown").alias("max_dd"),
        F.avg((F.col("net_return") > 0).cast("double")).alias("win"),
    )


def run_metrics(trades: DataFrame, keys: list[str] | None = None, min_ic: int = 10, p_value: bool = True) -> DataFrame:
    """Metrics at 252/hold_days periods per year, plus signal IC and hit rate over positions."""
    keys = keys or ["run"]
    trades = settle(trades)
    pnl = trades.groupBy(*keys, "rebalance_date").agg(exact_total("ls_return").alias("net_return"), F.max("hold_days").alias("hold_days"))
    s = _period_stats(pnl, keys, config.TRADING_DAYS / F.col("hold_days"))
    s = s.withColumn("ann", F.pow(1 + F.col("tot"), F.col("py") / F.greatest(F.col("n_periods"), F.lit(1))) - 1)
    # A run's trades are bounded by days x tickers per side.
    ic = spearman(trades, keys, "signal", "period_return", bounded=True).where(F.col("n") >= min_ic)
    hits = F.avg((F.signum("position") * F.col("period_return") > 0).cast("double"))
    side = trades.groupBy(*keys).agg(hits.alias("hit"), F.count("*").alias("n_trades"))
    m = s.join(side, keys).join(ic.select(*keys, "n", "ic"), keys, "left").join(positions_per_side(trades, keys), keys)
    down = F.when(F.col("n_loss") > 1, F.col("loss_std") * F.sqrt("py")).otherwise(F.lit(1e-9))
    r4 = lambda c: F.round(c, 4)
    out = [
        r4("tot").alias("total_return"),
        r4("ann").alias("annualised_return"),
        r4(F.col("std") * F.sqrt("py")).alias("annualised_volatility"),
        r4(sharpe(F.col("ex_mean"), F.col("ex_std"), F.col("py"))).alias("sharpe_ratio"),
        r4(F.when(down > 0, (F.col("ann") - config.RISK_FREE_RATE) / F.nullif(down, F.lit(0.0))).otherwise(0.0)).alias("sortino_ratio"),
        r4(F.when(F.abs("max_dd") > 1e-9, F.col("ann") / F.abs(F.nullif("max_dd", F.lit(0.0)))).otherwise(0.0)).alias("calmar_ratio"),
        r4("max_dd").alias("max_drawdown"),
        r4("win").alias("win_rate"),
        r4("ic").alias("ic"),
        r4("hit").alias("hit_rate"),
        "n_periods",
        "n_trades",
        "avg_positions_per_side",
    ]
    if p_value:
        out.insert(9, r4(correlation_p("ic", "n")).alias("ic_p_value"))
    return m.select(*keys, *out)


def tradeability(trades: DataFrame, dollar_vol: DataFrame, capital: float = config.CAPITAL_USD, limit: float = config.MAX_PARTICIPATION) -> DataFrame:
    """Scale returns down where |weight|*capital exceeds ``limit`` of the day's dollar volume."""
    dv = dollar_vol.select(F.col("date").alias("entry_date"), "ticker", "dollar_vol")
    rows = trades.join(dv, ["entry_date", "ticker"], "left")
    part = F.abs("weight") * capital / F.nullif("dollar_vol", F.lit(0.0))
    rows = rows.withColumn("participation_proxy", part)
    scale = F.coalesce(F.least(F.lit(1.0), limit / F.nullif("participation_proxy", F.lit(0.0))), F.lit(1.0))
    return rows.withColumn("ls_return", F.col("ls_return") * scale).drop("dollar_vol")


def gap_frequency(trades: DataFrame, keys: list[str]) -> DataFrame:
    """Periods per year from the median weekday gap between consecutive rebalances (252 for one period)."""
    days = trades.select(*keys, "rebalance_date").distinct()
    prev = F.lag("rebalance_date").over(W.partitionBy(*keys).orderBy("rebalance_date"))
    gaps = days.withColumn("gap", F.greatest(F.lit(1), weekday_gap(prev, "rebalance_date")))
    gaps = gaps.withColumn("gap", F.when(prev.isNotNull(), F.col("gap")))
    return gaps.groupBy(*keys).agg((config.TRADING_DAYS / F.greatest(F.lit(1.0), F.coalesce(F.median("gap"), F.lit(1.0)))).alias("per_year"))


def trade_metrics(trades: DataFrame, keys: list[str]) -> DataFrame:
    """Metrics of a trade table whose frequency is read off its own rebalance gaps."""
    trades = settle(trades)
    pnl = period_pnl(trades, keys).join(gap_frequency(trades, keys), keys)
    s = _period_stats(pnl, keys, F.col("per_year"))
    s = s.withColumn("ann", F.pow(1 + F.col("tot"), F.col("py") / F.greatest(F.lit(1), F.col("n_periods"))) - 1)
    ic = spearman(trades, keys, "signal", "period_return", bounded=True).where(F.col("n") > 10).select(*keys, "ic")
    part = F.avg("participation_proxy") if "participation_proxy" in trades.columns else F.lit(None).cast("double")
    side = trades.groupBy(*keys).agg(F.count("*").alias("trade_count"), part.alias("part"))
    m = s.join(side, keys).join(ic, keys, "left")
    return m.select(
        *keys,
        F.round("ann", 4).alias("annualised_return"),
        F.round(sharpe(F.col("ex_mean"), F.col("ex_std"), F.col("py")), 4).alias("sharpe_ratio"),
        F.round("max_dd", 4).alias("max_drawdown"),
        F.round("win", 4).alias("win_rate"),
        F.round("ic", 4).alias("ic"),
        "trade_count",
        F.round("part", 6).alias("participation_proxy_mean"),
        "n_periods",
    )


def side_curve(trades: DataFrame, keys: list[str]) -> DataFrame:
    """Chart series: mean long and mean short period return, halved sum, and its growth."""
    ret, pos = F.col("ls_return"), F.col("position")
    sides = {"long_ret": F.when(pos > 0, ret), "short_ret": F.when(pos < 0, ret)}
    per = trades.groupBy(*keys, "rebalance_date").agg(
        *[F.avg(x).alias(name) for name, x in sides.items()],
        *[F.avg(_exact(x)).alias(f"_{name}") for name, x in sides.items()],
        (F.count(_exact(ret)) == F.count(ret)).alias("_fit"),
    )
    total = lambda tag: F.coalesce(f"{tag}long_ret", F.lit(0)) + F.coalesce(f"{tag}short_ret", F.lit(0))
    # means are added as decimals, so the order of the trades and the halves of a last place do not show
    both = F.when(F.col("_fit"), total("_").cast("double")).otherwise(total("")) / 2
    per = per.withColumn("net_return", both).select(*keys, "rebalance_date", *sides, "net_return")
    return equity_curve(per, keys, "net_return", "rebalance_date")


def max_sharpe_row(metrics: DataFrame, group: list[str], label: str) -> DataFrame:
    """Best row per group by Sharpe; missing Sharpe ranks last, ties go to the smallest label."""
    key = F.struct(F.coalesce("sharpe_ratio", F.lit(-999.0)), F.lit(0))
    w = W.partitionBy(*group).orderBy(key.desc(), F.col(label))
    return metrics.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


