"""Factors and the long-short back-test."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapewire import config
from tapewire.operators import factors as fx
from tapewire.operators import longshort as ls
from tapewire.operators import panel as pn
from tapewire.operators import signals as sg
from tapewire.operators import validation as va
from tapewire.plans.fixtures import Market
from tapewire.plans.oracle_stats import RUN_METRICS, TRADE_METRICS, longshort_sql, run_metrics_sql, runs_values, spearman_sql, trade_metrics_sql
from tapewire.plans.registry import query

VIEWS = "wcapped panel cal ret vix"
P = "run, hold_days, cutoff, cost_bps, weighting, vix_filter"
BASE = [ls.strategy("base")]
MIXED = [
    ls.strategy("base"),
    ls.strategy("vol", weighting="vol_scaled", cutoff=0.4),
    ls.strategy("vix", vix_filter=True, hold_days=1, cost_bps=0.0),
    ls.strategy("five", hold_days=5, cutoff=0.35),
]
TRADES = (
    "run rebalance_date:t entry_date:t exit_date:t ticker signal:d position:i weight:d6 period_return:d6 ls_return:d6 cost_drag:d6 vix_level:d2"
)


#: Names a date needs, as the operators have it.
GATE = sg.min_tickers_for(config.QUANTILE_CUTOFF)


def gated(m: Market):
    return sg.on_usable_dates(sg.aggregate_signals(m.weekly), GATE)


#: The same of daily cross-sections: more dates, three headlines per ticker and day, no more names than a book needs.
DAILY_VIEWS = "capped panel cal ret vix"
DAILY_GATE = 4


def daily_gated(m: Market):
    return sg.on_usable_dates(sg.aggregate_signals(m.scored), DAILY_GATE)


def book(m: Market, runs=MIXED, signals=gated):
    return ls.rebalance_book(ls.with_strategies(signals(m), runs), m.panel, m.cal, m.vix)


def trades(m: Market, runs=MIXED, signals=gated):
    return ls.fill_trades(book(m, runs, signals), m.panel, m.cal)


def sql(runs=MIXED, source: str = "wcapped", signal: str = "signal", gate: int | None = GATE) -> str:
    ctes = longshort_sql(f"SELECT {P}, date, ticker, {signal} AS signal FROM {source} CROSS JOIN runs", gate)
    return "/*RECURSIVE_MARK*/" + runs_values(runs) + ",\n" + ctes.replace("/*RECURSIVE_MARK*/", "")


# ---- factors ----------------------------------------------------------------

FACTOR_CTES = """fpt AS MATERIALIZED (SELECT s.*, c.pos FROM capped s ASOF JOIN (SELECT date AS cd, pos FROM cal) c ON s.date <= c.cd),
fst AS MATERIALIZED (SELECT p.ticker, p.pos, CASE WHEN count(r.ret) FILTER (r.pos >= p.pos - 19) >= 3 AND p.pos >= 4 AND stddev_samp(r.ret) FILTER (r.pos >= p.pos - 19) * sqrt(252) > 1e-8
 THEN -stddev_samp(r.ret) FILTER (r.pos >= p.pos - 19) * sqrt(252) END AS volf,
 CASE WHEN p.pos >= 4 AND avg(r.close * r.volume) > 0 THEN ln(avg(r.close * r.volume)) END AS liq
 FROM (SELECT DISTINCT ticker, pos FROM fpt) p LEFT JOIN ret r ON r.ticker = p.ticker AND r.pos BETWEEN p.pos - 20 AND p.pos - 1 GROUP BY 1, 2),
fraw AS MATERIALIZED (SELECT f.*, s.volf, s.liq, CASE WHEN f.pos > 2 THEN (e.close - b.close) / b.close END AS mom FROM fpt f
 LEFT JOIN panel e ON e.ticker = f.ticker AND e.pos = greatest(0, f.pos - 2) LEFT JOIN panel b ON b.ticker = f.ticker AND b.pos = greatest(0, f.pos - 23)
 LEFT JOIN fst s ON s.ticker = f.ticker AND s.pos = f.pos),
fac AS MATERIALIZED (SELECT date, ticker, signal, headline_count, """ + ", ".join(
    f"""CASE WHEN {c} IS NULL THEN NULL WHEN count({c}) OVER w < 2 OR stddev_samp({c}) OVER w < 1e-8 THEN 0
 ELSE round(greatest(-3, least(3, ({c} - avg({c}) OVER w) / stddev_samp({c}) OVER w)), 9) END AS {n}"""
    for c, n in (("mom", "momentum"), ("volf", "vol_factor"), ("liq", "liquidity"))
) + " FROM fraw WINDOW w AS (PARTITION BY date))"
FVIEWS = "capped panel cal ret"


def matrix(m: Market):
    return fx.factor_matrix(sg.aggregate_signals(m.scored), m.panel, m.cal)


@query("FX01_momentum", "date:t ticker momentum:d", FVIEWS, "SELECT date, ticker, momentum FROM fac", FACTOR_CTES)
def _(m: Market):
    return matrix(m)


@query("FX02_low_volatility", "date:t ticker vol_factor:d", FVIEWS, "SELECT date, ticker, vol_factor FROM fac", FACTOR_CTES)
def _(m: Market):
    return matrix(m)


@query("FX03_liquidity", "date:t ticker liquidity:d", FVIEWS, "SELECT date, ticker, liquidity FROM fac", FACTOR_CTES)
def _(m: Market):
    return matrix(m)


@query("FX04_factor_matrix", "date:t ticker signal:d momentum:d vol_factor:d liquidity:d", FVIEWS, "SELECT * FROM fac", FACTOR_CTES)
def _(m: Market):
    return matrix(m)


COMBINED = "comb AS MATERIALIZED (SELECT *, round(0.5::DOUBLE * signal + 0.3::DOUBLE * coalesce(momentum, 0) + 0.2::DOUBLE * coalesce(vol_factor, 0), 6) AS combined_score FROM fac)"


@query("FX05_combined_score", "date:t ticker combined_score:d6", FVIEWS, "SELECT date, ticker, combined_score FROM comb", FACTOR_CTES + ",\n" + COMBINED)
def _(m: Market):
    return fx.combine_factors(matrix(m))


_LOGVOL = """lv AS MATERIALIZED (SELECT ticker, pos + 1 AS pos, CASE WHEN c = 20 THEN s * sqrt(252) END AS rv FROM (
 SELECT ticker, pos, count(lr) OVER w AS c, stddev_samp(lr) OVER w AS s FROM (SELECT r.ticker, r.pos, ln(r.close / p.close) AS lr FROM ret r LEFT JOIN ret p ON p.ticker = r.ticker AND p.pos = r.pos - 1)
 WINDOW w AS (PARTITION BY ticker ORDER BY pos RANGE BETWEEN 19 PRECEDING AND CURRENT ROW)))"""


@query(
    "FX06_vol_targeting",
    "date:t ticker combined_score:d6",
    FVIEWS,
    """SELECT f.date, f.ticker, greatest(-3, least(3, combined_score * (0.15::DOUBLE / CASE WHEN rv > 0.01 THEN rv ELSE 1 END))) AS combined_score
 FROM comb f JOIN fpt USING (date, ticker) LEFT JOIN lv ON lv.ticker = f.ticker AND lv.pos = fpt.pos""",
    FACTOR_CTES + ",\n" + COMBINED + ",\n" + _LOGVOL,
)
def _(m: Market):
    return fx.vol_target(fx.combine_factors(matrix(m)), m.panel, m.cal)


@query(
    "FX07_vix_damping",
    "date:t ticker combined_score:d6",
    FVIEWS + " vix",
    "SELECT date, ticker, CASE WHEN level > 30 AND combined_score > 0 THEN combined_score * 0.5 ELSE combined_score END AS combined_score FROM comb LEFT JOIN vix USING (date)",
    FACTOR_CTES + ",\n" + COMBINED,
)
def _(m: Market):
    return fx.vix_damp(fx.combine_factors(matrix(m)), m.vix)


MARKET_SPEC = "date:t ticker market_bench_5d_ret:d market_bench_20d_ret:d market_bench_vol_20d:d market_ticker_5d_ret:d market_ticker_20d_ret:d market_ticker_vol_20d:d market_ticker_beta:d market_rsi_14:d"
MARKET_SQL = """SELECT t.date, t.ticker, b.b5 AS market_bench_5d_ret, b.b20 AS market_bench_20d_ret, b.bv AS market_bench_vol_20d,
 coalesce((close - l5) / abs(l5), 0) AS market_ticker_5d_ret, coalesce((close - l20) / abs(l20), 0) AS market_ticker_20d_ret,
 CASE WHEN c20 = 20 THEN v20 * sqrt(252) ELSE 0 END AS market_ticker_vol_20d,
 CASE WHEN c60 = 60 THEN CASE WHEN vb > 0 THEN cv / vb ELSE 1 END ELSE 0 END AS market_ticker_beta,
 CASE WHEN cd < 14 THEN 0 WHEN al = 0 THEN 100 ELSE 100 - 100 / (1 + ag / al) END AS market_rsi_14
 FROM (SELECT *, lag(close, 5) OVER o AS l5, lag(close, 20) OVER o AS l20, count(r) OVER w20 AS c20, stddev_samp(r) OVER w20 AS v20, count(x) OVER w60 AS c60, var_pop(y) OVER w60 AS vb,
 covar_samp(x, y) OVER w60 AS cv, count(d) OVER w14 AS cd, avg(greatest(d, 0)) FILTER (d IS NOT NULL) OVER w14 AS ag, avg(greatest(-d, 0)) FILTER (d IS NOT NULL) OVER w14 AS al FROM t
 WINDOW o AS (PARTITION BY ticker ORDER BY pos), w20 AS (PARTITION BY ticker ORDER BY pos ROWS 19 PRECEDING), w60 AS (PARTITION BY ticker ORDER BY pos ROWS 59 PRECEDING), w14 AS (PARTITION BY ticker ORDER BY pos ROWS 13 PRECEDING)) t
 LEFT JOIN b USING (pos)"""
MARKET_CTES = """lev AS (SELECT pos, avg(close) AS close FROM panel GROUP BY 1),
br AS (SELECT *, close / lag(close) OVER (ORDER BY pos) - 1 AS br FROM lev),
b AS (SELECT pos, br, coalesce((close - lag(close, 5) OVER o) / abs(lag(close, 5) OVER o), 0) AS b5, coalesce((close - lag(close, 20) OVER o) / abs(lag(close, 20) OVER o), 0) AS b20,
 CASE WHEN count(br) OVER w = 20 THEN stddev_samp(br) OVER w * sqrt(252) ELSE 0 END AS bv FROM br WINDOW o AS (ORDER BY pos), w AS (ORDER BY pos ROWS 19 PRECEDING)),
t AS (SELECT *, CASE WHEN r IS NOT NULL AND br IS NOT NULL THEN r END AS x, CASE WHEN r IS NOT NULL AND br IS NOT NULL THEN br END AS y FROM (
 SELECT p.*, b.br, close / lag(close) OVER (PARTITION BY ticker ORDER BY pos) - 1 AS r, close - lag(close) OVER (PARTITION BY ticker ORDER BY pos) AS d FROM panel p LEFT JOIN b USING (pos)))"""


@query("FX08_market_features", MARKET_SPEC, "panel", MARKET_SQL, MARKET_CTES)
def _(m: Market):
    bench = m.panel.groupBy("pos").agg(F.avg("close").alias("close"))
    return fx.market_features(m.panel, bench)


@query(
    "FX10_training_labels",
    "ticker date:t fwd_ret:d label:i",
    "scored panel",
    """SELECT d.ticker, d.date, (f.close - b.close) / b.close AS fwd_ret, CASE WHEN (f.close - b.close) / b.close > 0.005 THEN 1 WHEN (f.close - b.close) / b.close < -0.005 THEN -1 ELSE 0 END AS label
 FROM (SELECT DISTINCT ticker, date FROM scored) d
 JOIN LATERAL (SELECT k, close FROM pr WHERE pr.ticker = d.ticker AND pr.date >= d.date ORDER BY k LIMIT 1) b ON true
 JOIN LATERAL (SELECT k FROM pr WHERE pr.ticker = d.ticker AND pr.date > d.date ORDER BY k LIMIT 1) a ON true
 JOIN pr f ON f.ticker = d.ticker AND f.k = a.k + 5""",
    "pr AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY pos) AS k FROM panel)",
)
def _(m: Market):
    return fx.training_labels(m.scored, m.panel, m.cal)


_FICS = [("signal", "signal"), ("momentum", "momentum"), ("vol_factor", "vol_factor"), ("liquidity", "liquidity")]


@query(
    "STA05_factor_ics",
    "factor ic:d4 n:i",
    FVIEWS + " fwd",
    "SELECT factor, CASE WHEN n >= 10 THEN round(ic, 4) END AS ic, n FROM s",
    FACTOR_CTES
    + ",\nfl AS ("
    + " UNION ALL ".join(f"SELECT '{c}' AS factor, fac.{c} AS value, return_lag_2 FROM fac JOIN fpt USING (date, ticker) JOIN fwd ON fwd.ticker = fac.ticker AND fwd.pos = fpt.pos" for c, _ in _FICS)
    + "),\ns AS ("
    + spearman_sql("fl", "factor", "value", "return_lag_2")
    + ")",
)
def _(m: Market):
    return va.factor_ics(matrix(m), m.panel, m.cal, [c for c, _ in _FICS], lag=2)


# ---- long-short -------------------------------------------------------------


@query("WN10_rank_positions", "run date:t ticker position:i", VIEWS, "SELECT run, date, ticker, position FROM lact", sql(BASE))
def _(m: Market):
    from tapewire.operators.calendar import rebalance_dates

    rows = ls.with_strategies(gated(m), BASE)
    schedule = rebalance_dates(rows.select("run", "date", "hold_days").distinct(), ["run"])
    day = rows.join(schedule, ["run", "date"]).join(m.panel.select("ticker").distinct(), "ticker", "left_semi")
    return ls.rank_positions(day, ["run", "date"]).where("position <> 0")


@query("BT04_long_short_trades", TRADES, VIEWS, "SELECT * FROM ltrades", sql())
def _(m: Market):
    return trades(m)


@query(
    "BT05_long_short_from_scores",
    TRADES.replace("signal:d", "signal:d6"),
    FVIEWS + " vix",
    "SELECT * FROM ltrades",
    FACTOR_CTES + ",\n" + COMBINED + ",\n" + sql(BASE, "comb", "combined_score", None),
)
def _(m: Market):
    scores = fx.combine_factors(matrix(m)).select("date", "ticker", F.col("combined_score").alias("signal"))
    return ls.long_short(ls.with_strategies(scores, BASE), m.panel, m.cal, m.vix)


_BOOK = "run date:t ticker position:i weight:d"


@query("BT06_equal_weights", _BOOK, VIEWS, "SELECT * FROM lbook", sql(BASE))
def _(m: Market):
    return book(m, BASE)


@query("BT07_inverse_vol_weights", _BOOK, VIEWS, "SELECT * FROM lbook", sql(MIXED[1:2]))
def _(m: Market):
    return book(m, MIXED[1:2])


@query("BT08_vix_exposure", _BOOK + " vix_level:d2", VIEWS, "SELECT * FROM lbook", sql(MIXED[2:3]))
def _(m: Market):
    return book(m, MIXED[2:3])


@query(
    "BT09_trade_returns",
    "run ticker n:i period_return:d6 ls_return:d6 cost_drag:d6",
    VIEWS,
    "SELECT run, ticker, count(*) AS n, sum(period_return) AS period_return, sum(ls_return) AS ls_return, sum(cost_drag) AS cost_drag FROM ltrades GROUP BY 1, 2",
    sql(),
)
def _(m: Market):
    return trades(m).groupBy("run", "ticker").agg(
        F.count("*").alias("n"), F.sum("period_return").alias("period_return"), F.sum("ls_return").alias("ls_return"), F.sum("cost_drag").alias("cost_drag")
    )


_TURN = """lsz AS (SELECT run, date, count(*) AS held, sum(abs(weight)) AS gross, list(ticker) AS names FROM lbook GROUP BY 1, 2),
lto AS (SELECT run, date, held, gross, CASE WHEN prev IS NOT NULL THEN (held + len(prev) - 2 * len(list_intersect(names, prev))) / greatest(held, len(prev)) END AS turnover FROM (
 SELECT *, lag(names) OVER (PARTITION BY run ORDER BY date) AS prev FROM lsz))"""


@query("WN20_holdings_turnover", "run date:t held:i gross:d turnover:d", VIEWS, "SELECT * FROM lto", sql() + ",\n" + _TURN)
def _(m: Market):
    return ls.holdings_turnover(book(m))


@query(
    "BT10_exposure_and_turnover",
    "run avg_gross_exposure:d4 avg_turnover:d4",
    VIEWS,
    "SELECT run, round(avg(gross), 4) AS avg_gross_exposure, round(avg(turnover), 4) AS avg_turnover FROM lto GROUP BY 1",
    sql() + ",\n" + _TURN,
)
def _(m: Market):
    return ls.book_summary(book(m))


@query("AG09_period_pnl", "run rebalance_date:t net_return:d", VIEWS, "SELECT run, rebalance_date, sum(ls_return) AS net_return FROM ltrades GROUP BY 1, 2", sql())
def _(m: Market):
    return ls.period_pnl(trades(m), ["run"])


@query(
    "AG10_positions_per_side",
    "run avg_positions_per_side:d1",
    VIEWS,
    "SELECT run, round(avg(k), 1) AS avg_positions_per_side FROM (SELECT run, rebalance_date, count(*) FILTER (position = 1) AS k FROM ltrades GROUP BY 1, 2) GROUP BY 1",
    sql(),
)
def _(m: Market):
    return ls.positions_per_side(trades(m), ["run"])


@query("BT11_run_metrics", "run " + RUN_METRICS, VIEWS, "SELECT * FROM rm", sql() + ",\n" + run_metrics_sql())
def _(m: Market):
    return ls.run_metrics(trades(m), p_value=False)


@query(
    "JN17_fill_join",
    "run ticker entry_date:t exit_date:t n:i",
    VIEWS,
    "SELECT run, ticker, entry_date, exit_date, count(*) AS n FROM ltrades GROUP BY ALL",
    sql(BASE),
)
def _(m: Market):
    return trades(m, BASE).groupBy("run", "ticker", "entry_date", "exit_date").agg(F.count("*").alias("n"))


TRADEABLE = """ttr AS MATERIALIZED (SELECT * EXCLUDE (ls_return, dv), ls_return * coalesce(least(1, 0.02::DOUBLE / nullif(participation_proxy, 0)), 1) AS ls_return FROM (
 SELECT t.*, p.close * p.volume AS dv, abs(weight) * 1000000::DOUBLE / nullif(p.close * p.volume, 0) AS participation_proxy FROM ltrades t LEFT JOIN panel p ON p.ticker = t.ticker AND p.date = t.entry_date))"""


@query(
    "BT12_tradeability_cap",
    "run rebalance_date:t ticker participation_proxy:d4 ls_return:d",
    VIEWS,
    "SELECT * FROM ttr",
    sql() + ",\n" + TRADEABLE,
)
def _(m: Market):
    return ls.tradeability(trades(m), pn.dollar_volume(m.panel))


@query("BT13_trade_metrics", "run " + TRADE_METRICS.replace("mean:d6", "mean:d4"), DAILY_VIEWS, "SELECT * FROM tm", sql(source="capped", gate=DAILY_GATE) + ",\n" + TRADEABLE + ",\n" + trade_metrics_sql("ttr", "run"))
def _(m: Market):
    return ls.trade_metrics(ls.tradeability(trades(m, signals=daily_gated), pn.dollar_volume(m.panel)), ["run"])


@query("AG18_gap_frequency", "run per_year:d", VIEWS, "SELECT run, py AS per_year FROM tpy", sql() + ",\n" + TRADEABLE + ",\n" + trade_metrics_sql("ttr", "run"))
def _(m: Market):
    return ls.gap_frequency(trades(m), ["run"])
