"""Parameter studies: every setting is a key column of one job.

The best setting of a stage or fold is joined back to the next stage, so no row reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tapewire import config
from tapewire.functions.dates import period_end, period_label, period_start
from tapewire.functions.settle import settle
from tapewire.operators import event_backtest as eb
from tapewire.operators import factors as fx
from tapewire.operators import keywords as kw
from tapewire.operators import longshort as ls
from tapewire.operators import signals as sg
from tapewire.operators import validation as va
from tapewire.operators.calendar import explode_params
from tapewire.operators.panel import dollar_volume

LAGS = [1, 2, 3, 5, 10]


def signals_by_threshold(scored: DataFrame, thresholds: list[float], value: Column | str = "signal") -> DataFrame:
    """(conf, date, ticker, signal, headline_count) for several thresholds in one pass over the headlines."""
    col = F.col(value) if isinstance(value, str) else value
    aggs = []
    for i, t in enumerate(thresholds):
        keep = F.col("confidence") >= t
        aggs += [F.avg(F.when(keep, col)).alias(f"s{i}"), F.count_if(keep).alias(f"c{i}")]
    wide = scored.groupBy("date", "ticker").agg(*aggs)
    packed = F.array(*[F.struct(F.lit(t).alias("conf"), F.col(f"s{i}").alias("signal"), F.col(f"c{i}").alias("headline_count")) for i, t in enumerate(thresholds)])
    return wide.select("date", "ticker", F.explode(packed).alias("p")).select("p.conf", "date", "ticker", "p.signal", "p.headline_count").where("headline_count > 0")


def _hit_rate(long: DataFrame, keys: list[str]) -> DataFrame:
    """Share of the positions in the right direction; NULL where no signal takes a position."""
    hit = va.hit_rate(long, keys, "ret", F.col("buy"), F.col("sell"))
    return hit.select(*keys, F.when(F.col("n_total") > 0, F.col("overall")).alias("hit_rate"))


def _study(signals: DataFrame, panel: DataFrame, cal: DataFrame, keys: list[str], lags: list[int]) -> tuple[DataFrame, DataFrame]:
    """IC and hit rate per (keys, lag), and back-test metrics per keys.  ``signals`` carries buy and sell columns."""
    ahead = settle(va.attach_forward(signals, panel, cal, lags))
    long = va.by_lag(ahead, lags, [*keys, "signal", "buy", "sell"])
    ic = va.information_coefficient(long, [*keys, "lag"], "ret", min_n=5, thin=None)
    hit = _hit_rate(long, [*keys, "lag"])
    returns = eb.strategy_returns(signals, panel, F.col("buy"), F.col("sell"))
    metrics = eb.portfolio_metrics(returns, keys).where("total_trades > 0")
    return ic.join(hit, [*keys, "lag"], "left"), metrics


def threshold_ablation(scored: DataFrame, panel: DataFrame, cal: DataFrame, grid: list[tuple] = config.THRESHOLD_GRID) -> DataFrame:
    by_conf = signals_by_threshold(scored, sorted({g[1] for g in grid}))
    rows = explode_params(by_conf, [{"config": c, "want": t, "buy": b, "sell": s} for c, t, b, s in grid]).where("conf = want")
    rows = settle(rows)
    stats, metrics = _study(rows, panel, cal, ["config"], [1])
    counts = rows.groupBy("config").agg(F.count("*").alias("n_signals"))
    out = counts.join(stats.select("config", "ic", "p_value", "hit_rate"), "config", "left").join(metrics.select("config", "total_trades", "sharpe_ratio"), "config", "left")
    return out.select("config", "n_signals", F.coalesce("total_trades", F.lit(0)).alias("n_active"), F.col("ic").alias("ic_1d"), F.col("p_value").alias("ic_p"), F.col("hit_rate").alias("hit_rate_1d"), F.col("sharpe_ratio").alias("sharpe"))


def horizon_ablation(scored: DataFrame, panel: DataFrame, cal: DataFrame, buy: float = 0.45, sell: float = -0.45) -> DataFrame:
    rows = sg.aggregate_signals(scored, confidence_weighted=False, cap=0).withColumn("buy", F.lit(buy)).withColumn("sell", F.lit(sell))
    return _lags(rows, panel, cal, [])


def _lags(rows: DataFrame, panel: DataFrame, cal: DataFrame, keys: list[str]) -> DataFrame:
    ahead = settle(va.attach_forward(rows, panel, cal, LAGS))
    long = va.by_lag(ahead, LAGS, [*keys, "signal", "buy", "sell"])
    ic = va.information_coefficient(long, [*keys, "lag"], "ret", min_n=5, thin=None)
    hit = _hit_rate(long, [*keys, "lag"])
    return ic.join(hit, [*keys, "lag"], "left")


def keyword_ablation(scored: DataFrame, panel: DataFrame, cal: DataFrame, weights: dict[str, float], floors: tuple[float, ...] = (0.003, 0.005), threshold: float = 0.70) -> DataFrame:
    """No keywords against CAR-adjusted signals at several |CAR| floors; one pass over the headlines."""
    variants = [("none", {})] + [(f"car>={f}", {k: v for k, v in weights.items() if abs(v) >= f}) for f in floors]
    rows = scored.where(F.col("confidence") >= threshold)
    wide = rows.groupBy("date", "ticker").agg(
        *[F.avg(kw.adjusted_signal(F.col("headline"), F.col("signal"), w)).alias(f"v{i}") for i, (_, w) in enumerate(variants)]
    )
    packed = F.array(*[F.struct(F.lit(n).alias("variant"), F.col(f"v{i}").alias("signal")) for i, (n, _) in enumerate(variants)])
    long = wide.select("date", "ticker", F.explode(packed).alias("p")).select("date", "ticker", "p.*")
    long = settle(long.withColumn("buy", F.lit(0.45)).withColumn("sell", F.lit(-0.45)))
    stats, metrics = _study(long, panel, cal, ["variant"], [1])
    counts = long.groupBy("variant").agg(F.count("*").alias("n_signals"))
    out = counts.join(stats.select("variant", "ic", "hit_rate"), "variant", "left").join(metrics.select("variant", "total_trades", "sharpe_ratio"), "variant", "left")
    return out.withColumn("total_trades", F.coalesce("total_trades", F.lit(0)))


def inversion_study(scored: DataFrame, panel: DataFrame, cal: DataFrame) -> DataFrame:
    """Normal and inverted signal, metrics per variant."""
    base = sg.aggregate_signals(scored, confidence_weighted=False, cap=0)
    rows = explode_params(base, [{"variant": "normal", "sign": 1}, {"variant": "inverted", "sign": -1}])
    rows = settle(rows.withColumn("signal", F.col("signal") * F.col("sign")).withColumn("buy", F.lit(0.45)).withColumn("sell", F.lit(-0.45)))
    stats, metrics = _study(rows, panel, cal, ["variant"], [1])
    out = stats.select("variant", "ic", "n", "hit_rate").join(metrics, "variant", "left")
    return out.withColumn("total_trades", F.coalesce("total_trades", F.lit(0)))


# ---- long-short grids -------------------------------------------------------


def run_grid(signals: DataFrame, panel: DataFrame, cal: DataFrame, vix: DataFrame | None, runs: list[dict]) -> DataFrame:
    """Metrics of every run on one signal table."""
    return ls.run_metrics(ls.long_short(ls.with_strategies(signals, runs), panel, cal, vix), p_value=False)


def improvement_runs() -> list[dict]:
    """Every run a sweep of the suite can ask for: the base settings, and each with the later sweeps' changes."""
    out = []
    for c in (0.20, 0.15, 0.10):
        for w in ("equal", "vol_scaled"):
            base = {"cutoff": c, "weighting": w}

            def add(section: str, label: str, base: dict = base, **change: object) -> None:
                out.append({**ls.strategy(f"{section}|{base['cutoff']:g}|{base['weighting']}|{label}", **{**base, **change}), "section": section, "q": base["cutoff"], "w": base["weighting"], "label": label})

            add("base", f"q{int(c * 100)}")
            for t, x in ((0, 0), (5, 2.5), (10, 5), (20, 10)):
                add("cost", f"cost{t + x:g}", cost_bps=t + x)
            for on in (False, True):
                add("vix", f"vix_{on}".lower(), vix_filter=on)
            for h in (1, 2, 3, 5):
                add("hold", f"hold{h}", hold_days=h)
    return out


def improvement_suite(scored: DataFrame, panel: DataFrame, cal: DataFrame, vix: DataFrame, min_tickers: int | None = None) -> DataFrame:
    """Five sweeps; each later sweep uses the best earlier setting.  Returns the leaderboard.

    All settings that can be chosen are runs of one job (66 of them); the choices are joins on its metrics.
    """
    need = sg.min_tickers_for(config.QUANTILE_CUTOFF) if min_tickers is None else min_tickers
    runs = improvement_runs()
    signals = sg.on_usable_dates(sg.aggregate_signals(scored), need)
    names = scored.sparkSession.createDataFrame([(r["run"], r["section"], r["q"], r["w"], r["label"]) for r in runs], "run string, section string, q double, w string, label string")
    core = [{k: r[k] for k in ("run", *ls.PARAMS)} for r in runs]
    m = settle(run_grid(signals, panel, cal, vix, core).join(F.broadcast(names), "run").drop("run").withColumnRenamed("label", "run"))
    base = m.where("section = 'base'")

    def best(rows: DataFrame) -> Column:
        """The setting of the best run, as a scalar struct."""
        return rows.orderBy(F.desc_nulls_last("sharpe_ratio"), "run").limit(1).select(F.struct("q", "w")).scalar()

    cutoffs = base.where("w = 'equal'").withColumn("section", F.lit("cutoff"))
    first = best(cutoffs)
    weighting = base.where((F.col("q") == first["q"]) | (F.col("q") == 0.10)).withColumns({"section": F.lit("weighting"), "run": F.concat_ws("_", "run", F.substring("w", 1, 3))})
    then = best(weighting)
    later = m.where(F.col("section") != "base").where((F.col("q") == then["q"]) & (F.col("w") == then["w"]))
    return leaderboard(cutoffs.unionByName(weighting).unionByName(later).drop("q", "w"), "run")


def leaderboard(metrics: DataFrame, label: str) -> DataFrame:
    """One row per label, best Sharpe first, missing last."""
    return metrics.dropDuplicates([label]).orderBy(F.desc_nulls_last("sharpe_ratio"), label)


def weight_rows(grid: list[tuple] = config.WEIGHT_GRID, **extra: object) -> list[dict]:
    return [ls.strategy(fx.weights_label(w), w_s=w[0], w_m=w[1], w_v=w[2], w_l=w[3], **extra) for w in grid]


def scored_grid(factors: DataFrame, rows: list[dict], prefix: str | None = None) -> DataFrame:
    """Combined score of every weight row: run + parameters + date, ticker, signal."""
    keep = [prefix] if prefix else []
    out = fx.combine_by_columns(explode_params(factors, rows))
    run = F.concat_ws("|", F.col(prefix), F.col("run")) if prefix else F.col("run")
    return out.select(*keep, run.alias("run"), *ls.PARAMS, "date", "ticker", F.col("combined_score").alias("signal"))


def multifactor_suite(factors: DataFrame, panel: DataFrame, cal: DataFrame) -> DataFrame:
    """Each factor alone and the 12-point weight grid."""
    factors = settle(factors)
    single = []
    for col in ("signal", *fx.FACTORS):
        rows = factors.where(F.col(col).isNotNull()).select("date", "ticker", F.col(col).alias("signal"))
        single.append(explode_params(rows, [ls.strategy(f"only_{col}")]))
    all_rows = scored_grid(factors, weight_rows())
    for s in single:
        all_rows = all_rows.unionByName(s)
    return ls.run_metrics(ls.long_short(all_rows, panel, cal), p_value=False)


def cost_sweep(factors: DataFrame, panel: DataFrame, cal: DataFrame, tcs: tuple[float, ...] = (0, 5, 10, 15, 20)) -> DataFrame:
    """Champion weights at several costs (slippage is half the transaction cost)."""
    combined = fx.combine_factors(factors, config.CHAMPION_WEIGHTS).select("date", "ticker", F.col("combined_score").alias("signal"))
    m = run_grid(combined, panel, cal, None, [ls.strategy(f"tc{t:g}", cost_bps=t * 1.5) for t in tcs])
    return m.withColumn("tc_bps", F.regexp_replace("run", "^tc", "").cast("double"))


def break_even(costs: DataFrame, cost: str = "tc_bps", keys: list[str] | None = None) -> DataFrame:
    """Largest cost with Sharpe >= 0 (0 if none) and first tested cost with Sharpe <= 0."""
    return costs.groupBy(*(keys or [])).agg(
        F.coalesce(F.max(F.when(F.col("sharpe_ratio") >= 0, F.col(cost))), F.lit(0.0)).alias("break_even_cost_bps"),
        F.min(F.when(F.col("sharpe_ratio") <= 0, F.col(cost))).alias("first_negative_cost_bps"),
    )


def signal_variants(scored: DataFrame, panel: DataFrame, cal: DataFrame, sectors: DataFrame) -> DataFrame:
    """Factor rows of the variants A to G, keyed by ``variant``.  F and G get their adjustment after combining."""
    base = sg.aggregate_signals(scored, confidence_weighted=False, cap=0)
    conf = sg.aggregate_signals(scored, cap=0)
    capped = sg.aggregate_signals(scored, confidence_weighted=False)
    both = sg.aggregate_signals(scored)
    cols = ["date", "ticker", "signal", "headline_count"]
    parts = [
        ("A_baseline", base),
        ("B_conf_weighted", conf),
        ("C_shock_filter", capped),
        ("D_sector_neutral", sg.sector_neutral(conf, sectors)),
        ("E_all_improvements", sg.sector_neutral(both, sectors)),
        ("F_vol_target", base),
        ("G_vix_filter", base),
    ]
    out = None
    for name, df in parts:
        piece = df.select(*cols).withColumn("variant", F.lit(name))
        out = piece if out is None else out.unionByName(piece)
    return fx.factor_matrix(settle(out), panel, cal, keys=("variant",))


def strategy_grid(variants: DataFrame, panel: DataFrame, cal: DataFrame, vix: DataFrame, grid: list[tuple] = config.WEIGHT_GRID) -> DataFrame:
    """Trades of every variant x weight row."""
    rows = settle(scored_grid(settle(variants), weight_rows(grid), "variant"))
    plain = rows.where(~F.col("variant").isin("F_vol_target", "G_vix_filter"))
    targeted = fx.vol_target(rows.where("variant = 'F_vol_target'"), panel, cal, "signal").select(*rows.columns)
    damped = fx.vix_damp(rows.where("variant = 'G_vix_filter'"), vix, "signal").select(*rows.columns)
    return ls.long_short(plain.unionByName(targeted).unionByName(damped).drop("variant"), panel, cal)


def best_per_variant(metrics: DataFrame) -> DataFrame:
    """Best run of each variant and its improvement over the baseline variant."""
    rows = metrics.withColumn("variant", F.split("run", r"\|")[0])
    best = ls.max_sharpe_row(rows, ["variant"], "run")
    # One row per variant (seven), so the window without a key is tiny.
    base = F.max(F.when(F.col("variant") == "A_baseline", F.col("sharpe_ratio"))).over(W.partitionBy(F.lit(1)))
    delta = F.col("sharpe_ratio") - base
    verdict = F.when(delta.isNull(), "n/a").when(delta > 0.10, "IMPROVEMENT").when(delta > -0.05, "neutral").otherwise("HURTS")
    return best.select("variant", "run", "sharpe_ratio", delta.alias("delta"), verdict.alias("verdict"))


def aligned_returns(trades: DataFrame) -> DataFrame:
    """(run, period index, r) on the union of all rebalance dates; gaps count as 0."""
    pnl = settle(ls.period_pnl(trades, ["run"]))
    periods = pnl.select("rebalance_date").distinct().withColumn("idx", F.row_number().over(W.orderBy("rebalance_date")) - 1)
    runs = pnl.select("run").distinct()
    # Runs are the settings of a written grid; each period is paired with that list.
    names = runs.agg(F.sort_array(F.collect_set("run")).alias("runs"))
    frame = periods.withColumn("run", F.explode(names.scalar()))
    return frame.join(pnl, ["run", "rebalance_date"], "left").select("run", "idx", "rebalance_date", F.coalesce("net_return", F.lit(0.0)).alias("r"))


def reality_check(returns: DataFrame, draws: int = 2000, hold_days: int = config.HOLD_DAYS, seed: int = config.RANDOM_SEED, centered: bool = False) -> DataFrame:
    """Bootstrap p-value of the best Sharpe among all runs; of equally good runs the smallest name is the best.

    A replicate is one row: its draws with replacement are the MD5 of (replicate, slot, seed) modulo the
    number of periods, and each run's array of returns is folded over them inside the row.  The arrays
    are bounded by the written grid times its periods.  ``centered`` subtracts each run's own mean excess first.
    """
    spark = returns.sparkSession
    py = config.TRADING_DAYS / hold_days
    rf = config.RISK_FREE_RATE / py

    def sharpe_of(n: Column, s: Column, ss: Column) -> Column:
        mean = s / n
        std = F.sqrt(F.greatest(F.lit(0.0), (ss - n * mean * mean) / F.nullif(n - 1, F.lit(0.0))))
        return F.when((n >= 3) & (std >= 1e-10), (mean - rf) / F.nullif(std, F.lit(0.0)) * (py**0.5))

    mean = F.avg("r").over(W.partitionBy("run"))
    rows = returns.select("run", "idx", "r", (F.col("r") - (mean - rf) if centered else F.col("r")).alias("drawn"))
    runs = rows.groupBy("run").agg(F.count("*").cast("double").alias("n"), F.sort_array(F.collect_list(F.struct("idx", "r", "drawn"))).alias("_x"))
    # summed in the order of the periods, so that runs of equal returns have equal Sharpe ratios
    total = lambda value: F.aggregate("_x", F.lit(0.0), lambda a, x: a + value(x))
    runs = runs.select("run", "n", total(lambda x: x["r"]).alias("s"), total(lambda x: x["r"] * x["r"]).alias("ss"), F.transform("_x", lambda x: x["drawn"]).alias("drawn"))
    observed = settle(runs.withColumn("sharpe", sharpe_of(F.col("n"), F.col("s"), F.col("ss"))))
    pool = observed.agg(F.collect_list("drawn").alias("pool")).scalar()
    size = observed.agg(F.coalesce(F.max("n"), F.lit(0.0))).scalar()
    # the scalars are columns first: Spark takes no subquery inside a lambda
    replicates = spark.range(draws).withColumnRenamed("id", "rep").withColumns({"pool": pool, "size": size, "periods": F.greatest(size, F.lit(1.0)).cast("long")})
    pick = lambda slot: (F.conv(F.substring(F.md5(F.concat_ws("|", "rep", slot, F.lit(str(seed))).cast("binary")), 1, 8), 16, 10).cast("long") % F.col("periods")).cast("int")
    replicates = replicates.withColumn("picks", F.transform(F.sequence(F.lit(1), F.col("periods").cast("int")), pick))

    def folded(r: Column) -> Column:
        zero = F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("ss"))
        sums = lambda a, k: F.struct((a["s"] + F.get(r, k)).alias("s"), (a["ss"] + F.get(r, k) * F.get(r, k)).alias("ss"))
        return F.aggregate("picks", zero, sums, lambda a: sharpe_of(F.col("size"), a["s"], a["ss"]))

    best = replicates.select("rep", F.array_max(F.transform("pool", folded)).alias("top")).where("top is not null")
    top = observed.where("sharpe is not null").agg(F.min_by("run", F.struct(-F.col("sharpe"), "run")).alias("best_strategy"), F.max("sharpe").alias("best_sharpe"), F.count("*").alias("n_strategies"))
    bar = top.select("best_sharpe").scalar()
    stats = best.agg(
        F.avg((F.col("top") >= bar).cast("double")).alias("p_value"),
        F.avg("top").alias("boot_mean"),
        F.stddev_pop("top").alias("boot_std"),
        F.percentile("top", F.lit(0.95)).alias("boot_95pct"),
        F.count("*").alias("n_boot"),
    )
    return stats.select(
        top.select("best_strategy").scalar().alias("best_strategy"),
        F.round(bar, 4).alias("best_sharpe"),
        F.round("p_value", 4).alias("p_value"),
        F.round("boot_mean", 4).alias("boot_mean"),
        F.round("boot_std", 4).alias("boot_std"),
        F.round("boot_95pct", 4).alias("boot_95pct"),
        top.select("n_strategies").scalar().alias("n_strategies"),
        size.cast("int").alias("n_periods"),
        "n_boot",
    )


def period_walk_forward(scored: DataFrame, panel: DataFrame, cal: DataFrame, freq: str = "quarter", min_tickers: int = 5) -> DataFrame:
    """Champion strategy per calendar period: Sharpe, return, IC per period, with the period as key."""
    base = sg.aggregate_signals(scored, confidence_weighted=False, cap=0).withColumn("period", period_label("date", freq))
    enough = base.groupBy("period").agg(F.count_distinct("ticker").alias("n_tickers")).where(F.col("n_tickers") >= min_tickers)
    factors = fx.factor_matrix(base, panel, cal)
    combined = settle(fx.combine_factors(factors, config.CHAMPION_WEIGHTS).join(enough, "period"))
    rows = combined.select(F.col("period").alias("run"), "date", "ticker", F.col("combined_score").alias("signal"))
    base_row = {k: v for k, v in ls.strategy("x").items() if k != "run"}
    trades = ls.long_short(explode_params(rows, [base_row]), panel, cal)
    metrics = ls.run_metrics(trades, p_value=False).withColumnRenamed("run", "period")
    ahead = va.attach_forward(rows, panel, cal, [config.HOLD_DAYS])
    ics = va.daily_ic(ahead, f"return_lag_{config.HOLD_DAYS}", keys=["run"])
    ic = va.ic_summary(ics, ["run"], min_n=2).select(F.col("run").alias("period"), F.round("mean_ic", 5).alias("ic_mean"), F.round("t_stat", 3).alias("ic_t_stat"))
    span = combined.groupBy("period").agg(F.min(period_start("date", freq)).alias("start"), F.min(period_end("date", freq)).alias("end_date"), F.max("n_tickers").alias("n_tickers"))
    out = span.join(metrics, "period", "left").join(ic, "period", "left")
    return out.select("period", "start", "end_date", "n_tickers", "n_periods", F.col("sharpe_ratio").alias("sharpe"), "annualised_return", "max_drawdown", "hit_rate", "ic_mean", "ic_t_stat")


# ---- expanding walk-forward -------------------------------------------------

CALIBRATION = [
    {"conf": c, "cutoff": q, "hold_days": h, "variant": v, "vix_filter": r}
    for c in (0.60, 0.75)
    for q in (0.15, 0.25)
    for h in (1, 2)
    for v in ("sentiment", "ensemble")
    for r in (False, True)
]


def variant_signals(scored: DataFrame, panel: DataFrame, cal: DataFrame, confs: list[float], min_tickers: int) -> DataFrame:
    """(variant, conf, date, ticker, signal) for the sentiment and ensemble variants.

    The top rows per day by confidence are nested across thresholds, so one
    ranked pass serves all of them.
    """
    kept = sg.top_per_day(scored.where(F.col("confidence") >= min(confs)), config.MAX_HEADLINES_PER_DAY, ["date", "ticker"], [F.desc("confidence"), F.col("headline_id")])
    daily = settle(signals_by_threshold(kept, confs, F.col("signal") * F.col("confidence")))
    sentiment = sg.on_usable_dates(daily, min_tickers, ["conf"])
    liquid = sg.liquidity_filter(daily, dollar_volume(panel), keys=["conf"])
    ensemble = fx.combine_factors(fx.factor_matrix(liquid, panel, cal, keys=("conf",)), config.ENSEMBLE_WEIGHTS)
    cols = ["conf", "date", "ticker"]
    return settle(
        sentiment.select(F.lit("sentiment").alias("variant"), *cols, "signal").unionByName(ensemble.select(F.lit("ensemble").alias("variant"), *cols, F.col("combined_score").alias("signal")))
    )


SETTING = ["variant", "conf", "cutoff", "hold_days", "vix_filter"]


def _run_settings(signals: DataFrame, settings: DataFrame, panel: DataFrame, cal: DataFrame, vix: DataFrame) -> DataFrame:
    """Trades of every setting on its own date range.

    ``settings``: run, fold, scenario, SETTING, cost_bps, from, until; folds times a written list.
    """
    rows = signals.join(F.broadcast(settings.withColumn("weighting", F.lit("equal"))), ["variant", "conf"]).where("date >= from and date <= until")
    trades = ls.long_short(settle(rows.select("run", *ls.PARAMS, "date", "ticker", "signal")), panel, cal, vix)
    return ls.tradeability(trades, dollar_volume(panel)).join(F.broadcast(settings.select("run", "fold", "scenario")), "run")


def test_quarters(scored: DataFrame, max_folds: int = 4, before: int = 4) -> DataFrame:
    """(fold, from, until): the last quarters that have at least ``before`` quarters before them."""
    quarters = scored.select(period_start("date", "quarter").alias("from")).distinct()
    # One row a quarter of the calendar.
    last = W.partitionBy(F.lit(1)).orderBy(F.desc("from"))
    ranked = quarters.withColumn("k", F.row_number().over(last)).withColumn("n", F.count(F.lit(1)).over(W.partitionBy(F.lit(1))))
    until = F.date_sub(F.add_months("from", 3), 1)
    return ranked.where((F.col("k") <= max_folds) & (F.col("k") <= F.col("n") - before)).select(F.col("from").cast("string").alias("fold"), "from", until.alias("until"))


def calibration_scores(metrics: DataFrame, limit: float = config.MAX_PARTICIPATION) -> DataFrame:
    part = F.coalesce("participation_proxy_mean", F.lit(0.0))
    return metrics.withColumn("score", F.col("sharpe_ratio") - 2.0 * F.greatest(F.lit(0.0), part - limit))


def walk_forward(scored: DataFrame, panel: DataFrame, cal: DataFrame, vix: DataFrame, min_tickers: int | None = None, max_folds: int = 4) -> dict[str, DataFrame]:
    """Expanding-window folds over the last quarters: calibrate on all earlier dates, then test.

    Folds, settings and the settings chosen are rows; a fold's best setting is joined back to the test
    scenarios, so nothing but finished tables leaves the jobs.  ``max_folds`` is the study's own
    parameter.  Without a fold all tables are empty.
    """
    need = sg.min_tickers_for(config.QUANTILE_CUTOFF) if min_tickers is None else min_tickers
    cost = config.TRANSACTION_COST_BPS + config.SLIPPAGE_BPS
    folds = settle(test_quarters(scored, max_folds))
    signals = variant_signals(scored, panel, cal, [0.60, 0.70, 0.75], need)
    grid = [{"k": k, **c, "cost_bps": cost} for k, c in enumerate(CALIBRATION)]
    train = explode_params(folds.select("fold", F.lit("0001-01-01").cast("date").alias("from"), F.date_sub("from", 1).alias("until")), grid)
    train = train.withColumn("run", F.format_string("%s|%02d", "fold", "k")).withColumn("scenario", F.lit("train"))
    scores = calibration_scores(ls.trade_metrics(_run_settings(signals, train, panel, cal, vix), ["fold", "run"])).where("score is not null")
    scores = scores.withColumn("k", F.substring("run", -2, 2).cast("int"))
    best = scores.groupBy("fold").agg(F.max_by(F.struct("k", "score", "sharpe_ratio"), F.struct("score", -F.col("k"))).alias("b")).select("fold", "b.*")
    chosen = settle(best.join(train.select("fold", "k", *SETTING), ["fold", "k"]).join(folds, "fold"))

    def scenario(name: str, **change: object) -> Column:
        value = lambda c: F.lit(change[c]) if c in change else F.col(c)
        return F.struct(F.lit(name).alias("scenario"), *[value(c).alias(c) for c in SETTING], F.lit(float(change.get("cost_bps", cost))).alias("cost_bps"))

    scenarios = [scenario("baseline", variant="sentiment", conf=0.70, cutoff=0.20, hold_days=2, vix_filter=False), scenario("improved")]
    for name, variant, on in (("ablation_sentiment", "sentiment", False), ("ablation_ensemble", "ensemble", False), ("ablation_ensemble_regime", "ensemble", True)):
        scenarios.append(scenario(name, variant=variant, vix_filter=on))
    scenarios += [scenario(f"cost_{bps:.1f}bps", cost_bps=bps) for bps in (0.0, 7.5, 15.0, 30.0)]
    tests = chosen.select("fold", "from", "until", F.explode(F.array(*scenarios)).alias("s")).select("fold", "from", "until", "s.*")
    tests = tests.withColumn("run", F.concat_ws("|", "fold", "scenario"))
    trades = settle(_run_settings(signals, tests, panel, cal, vix))
    per_fold = settle(ls.trade_metrics(trades, ["fold", "scenario"]))
    summary = settle(aggregate_oos(ls.trade_metrics(trades, ["scenario"]), per_fold))
    choices = chosen.select(
        F.col("fold").alias("test_period"),
        F.col("conf").alias("confidence_threshold"),
        F.col("cutoff").alias("quantile_cutoff"),
        "hold_days",
        "variant",
        F.col("vix_filter").alias("regime_filter"),
        "score",
        F.col("sharpe_ratio").alias("train_sharpe"),
    )
    costs = summary.where("scenario like 'cost_%'").withColumn("cost_bps", F.regexp_extract("scenario", r"cost_([0-9.]+)bps", 1).cast("double"))
    even = break_even(costs, "cost_bps").select("break_even_cost_bps").scalar()
    oos = relabel_uplift(summary.where("scenario in ('baseline', 'improved')"), per_fold).withColumn("break_even_cost_bps", even)
    return {
        "oos": oos,
        "periods": per_fold.where("scenario in ('baseline', 'improved')"),
        "ablation": per_fold.where("scenario like 'ablation%'"),
        "choices": choices,
        "costs": costs.withColumn("break_even_cost_bps", even),
    }


def aggregate_oos(overall: DataFrame, per_fold: DataFrame) -> DataFrame:
    """Scenario roll-up: trade metrics plus IC mean, spread, fold count and share of positive folds."""
    folds = per_fold.groupBy("scenario").agg(
        F.avg("ic").alias("ic_mean"),
        F.stddev_samp("ic").alias("ic_stability"),
        F.count_distinct("fold").alias("oos_fold_count"),
        F.avg((F.col("sharpe_ratio") > 0).cast("double")).alias("pct_positive_oos_folds"),
    )
    return overall.drop("ic").join(folds, "scenario").withColumnRenamed("ic_mean", "ic")


def relabel_uplift(summary: DataFrame, per_fold: DataFrame) -> DataFrame:
    """Rename ``improved`` when the regime filter adds nothing to the ensemble."""
    mean = lambda s: per_fold.where(F.col("scenario") == s).agg(F.avg("sharpe_ratio")).scalar()
    flat = F.coalesce(mean("ablation_ensemble_regime") <= mean("ablation_ensemble"), F.lit(False))
    return summary.withColumn("scenario", F.when(flat & (F.col("scenario") == "improved"), "improved_no_regime_uplift").otherwise(F.col("scenario")))


def diagnostics(scored: DataFrame, panel: DataFrame, cal: DataFrame, vix: DataFrame, model: str, min_tickers: int | None = None) -> dict[str, DataFrame]:
    """Event back-test, walk-forward and cost tables of one model, plus the ranked findings."""
    event = eb.portfolio_metrics(eb.strategy_returns(sg.daily_signals(scored), panel).withColumn("model", F.lit(model)), ["model"])
    wf = {k: v.withColumn("model", F.lit(model)) for k, v in walk_forward(scored, panel, cal, vix, min_tickers).items()}
    tables = {"backtest": event, **wf}
    if wf:
        cols = ["model", "scenario", "annualised_return", "sharpe_ratio", "max_drawdown", "win_rate", "trade_count", "ic", "ic_stability", "oos_fold_count", "pct_positive_oos_folds", "break_even_cost_bps"]
        both = wf["oos"].select(*cols).unionByName(wf["costs"].select(*cols))
        tables["ranked"] = both.orderBy("model", F.desc_nulls_last("sharpe_ratio"))
    return tables

