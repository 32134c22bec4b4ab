"""Event back-test slice: daily signals, returns, metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapewire.operators import event_backtest as eb
from tapewire.operators import panel as pn
from tapewire.operators import signals as sg
from tapewire.plans.fixtures import Market
from tapewire.plans.registry import query

SIG = "date:t ticker signal:d avg_confidence:d headline_count:i"
METRICS = (
    "total_return:d4 benchmark_total_return:d4 annualised_return:d4 annualised_volatility:d4 sharpe_ratio:d4 sortino_ratio:d4 "
    "calmar_ratio:d4 max_drawdown:d4 win_rate:d4 alpha:d4 beta:d4 total_trades:i n_days:i ann_turnover:d2 avg_holding_period_days:d1 total_cost_drag:d6"
)


def metrics_sql(source: str, keys: str) -> str:
    """Portfolio metrics of an event-return table per key columns."""
    k = keys + ", " if keys else ""
    part = f"PARTITION BY {keys} " if keys else ""
    using = lambda a: f"JOIN {a} USING ({keys})" if keys else f"CROSS JOIN {a}"
    return f"""
mt_daily AS (SELECT {k}date, avg(strategy_return) AS strat, avg(benchmark_return) AS bench FROM {source} GROUP BY {k}date),
mt_eq AS (SELECT *, product(1 + strat) OVER ({part}ORDER BY date ROWS UNBOUNDED PRECEDING) AS equity FROM mt_daily),
mt_dd AS (SELECT *, equity / 1 AS e2, max(equity) OVER ({part}ORDER BY date ROWS UNBOUNDED PRECEDING) AS peak FROM mt_eq),
mt_base AS (SELECT {k}count(*) AS n_days, product(1 + strat) - 1 AS tot, product(1 + bench) - 1 AS bench_tot,
  avg(strat - 0.045::DOUBLE / 252) AS ex_mean, stddev_samp(strat - 0.045::DOUBLE / 252) AS ex_std, stddev_samp(strat) AS std,
  count(*) FILTER (strat < 0) AS n_loss, stddev_samp(strat) FILTER (strat < 0) AS loss_std, min((equity - peak) / peak) AS max_dd,
  CASE WHEN count(*) > 1 THEN covar_samp(strat, bench) END AS cov, var_samp(bench) AS bench_var FROM mt_dd {"GROUP BY " + keys if keys else ""}),
mt_tr AS (SELECT {k}count(*) FILTER (position <> 0) AS total_trades, count(*) FILTER (position <> 0 AND strategy_return > 0) AS wins,
  count(DISTINCT date) FILTER (position <> 0) AS active_days, sum(cost_drag) AS cost FROM {source} {"GROUP BY " + keys if keys else ""}),
mt_ch AS (SELECT {k}date, coalesce(abs(position - lag(position) OVER (PARTITION BY {k}ticker ORDER BY date)), 0) AS ch FROM {source}),
mt_td AS (SELECT {k}date, sum(ch) AS turnover FROM mt_ch GROUP BY {k}date),
mt_tu AS (SELECT {k}avg(turnover) AS turn FROM mt_td {"GROUP BY " + keys if keys else ""}),
mt_all AS (SELECT *, pow(1 + tot, 252.0 / n_days) - 1 AS ann, CASE WHEN n_loss > 1 THEN loss_std * sqrt(252) ELSE 1e-9 END AS down,
  CASE WHEN bench_var > 0 THEN cov / bench_var ELSE 0 END AS beta FROM mt_base {using('mt_tr')} {using('mt_tu')}),
mt AS (SELECT {k}round(tot, 4) AS total_return, round(bench_tot, 4) AS benchmark_total_return, round(ann, 4) AS annualised_return,
  round(std * sqrt(252), 4) AS annualised_volatility, round(CASE WHEN ex_std > 0 THEN ex_mean / ex_std * sqrt(252) ELSE 0 END, 4) AS sharpe_ratio,
  round(CASE WHEN down > 0 THEN (ann - 0.045) / down ELSE 0 END, 4) AS sortino_ratio,
  round(CASE WHEN abs(max_dd) > 1e-9 THEN ann / abs(max_dd) ELSE 0 END, 4) AS calmar_ratio, round(max_dd, 4) AS max_drawdown,
  round(CASE WHEN total_trades > 0 THEN wins / total_trades ELSE 0 END, 4) AS win_rate,
  round(CASE WHEN bench_var > 0 THEN ann - (0.045 + beta * (bench_tot - 0.045)) ELSE 0 END, 4) AS alpha, round(beta, 4) AS beta,
  total_trades, n_days, round(turn * 252, 2) AS ann_turnover,
  round(CASE WHEN total_trades > 0 THEN active_days / greatest(1, total_trades) ELSE 0 END, 1) AS avg_holding_period_days,
  round(cost, 6) AS total_cost_drag FROM mt_all)"""


def returns(m: Market):
    return eb.strategy_returns(sg.daily_signals(m.scored), m.panel)


@query("AG01_daily_signals", SIG, "sig", "SELECT * FROM sig")
def _(m: Market):
    return sg.daily_signals(m.scored)


@query("WN01_simple_return", "date:t ticker ret:d", "ret", "SELECT date, ticker, ret FROM ret")
def _(m: Market):
    return pn.simple_returns(m.panel)


@query(
    "WN01_padded_return",
    "date:t ticker ret:d",
    "panel",
    "SELECT date, ticker, close / lag(close) OVER (PARTITION BY ticker ORDER BY pos) - 1 AS ret FROM panel",
)
def _(m: Market):
    return pn.simple_returns(m.panel, pad=True)


@query("WN02_next_day_return", "date:t ticker next_ret:d", "nextret", "SELECT * FROM nextret")
def _(m: Market):
    return pn.next_day_returns(m.panel).where("next_ret is not null")


@query(
    "JN03_exact_date_join",
    "date:t ticker signal:d next_ret:d",
    "sig nextret",
    "SELECT date, ticker, signal, next_ret FROM sig JOIN nextret USING (date, ticker)",
)
def _(m: Market):
    ahead = pn.next_day_returns(m.panel).where("next_ret is not null").select("date", "ticker", "next_ret")
    return sg.daily_signals(m.scored).join(ahead, ["date", "ticker"])


@query(
    "BT01_event_returns",
    "date:t ticker signal:d position:i strategy_return:d gross_strategy_return:d benchmark_return:d cost_drag:d",
    "events_bt",
    "SELECT * FROM events_bt",
)
def _(m: Market):
    return returns(m)


@query("BT02_portfolio_metrics", "model " + METRICS, "events_bt", "SELECT 'lexicon' AS model, * FROM mt", metrics_sql("events_bt", ""))
def _(m: Market):
    return eb.portfolio_metrics(returns(m).withColumn("model", F.lit("lexicon")), ["model"])


@query("BT03_metrics_by_ticker", "ticker " + METRICS, "events_bt", "SELECT * FROM mt", metrics_sql("events_bt", "ticker"))
def _(m: Market):
    return eb.portfolio_metrics(returns(m), ["ticker"])


@query(
    "AG03_equal_weight_daily",
    "date:t strat:d bench:d",
    "events_bt",
    "SELECT date, avg(strategy_return) AS strat, avg(benchmark_return) AS bench FROM events_bt GROUP BY 1",
)
def _(m: Market):
    return eb.daily_portfolio(returns(m), [])


@query(
    "AG04_compounded_return",
    "ticker total_return:d",
    "events_bt",
    "SELECT ticker, product(1 + strategy_return) - 1 AS total_return FROM events_bt GROUP BY 1",
)
def _(m: Market):
    return returns(m).groupBy("ticker").agg((F.product(1 + F.col("strategy_return")) - 1).alias("total_return"))


_CURVE = """
dl AS (SELECT ticker, date, avg(strategy_return) AS strat FROM events_bt GROUP BY 1, 2),
eq AS (SELECT *, product(1 + strat) OVER (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING) AS equity FROM dl),
pk AS (SELECT *, max(equity) OVER (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING) AS peak FROM eq),
curve AS (SELECT *, (equity - peak) / peak AS drawdown FROM pk)"""


@query("WN06_equity_drawdown", "ticker date:t equity:d peak:d drawdown:d", "events_bt", "SELECT * FROM curve", _CURVE)
def _(m: Market):
    return eb.equity_curve(eb.daily_portfolio(returns(m), ["ticker"]), ["ticker"])


@query(
    "WN07_turnover",
    "date:t turnover:d",
    "events_bt",
    "SELECT date, sum(ch) AS turnover FROM (SELECT date, coalesce(abs(position - lag(position) OVER (PARTITION BY ticker ORDER BY date)), 0) AS ch FROM events_bt) GROUP BY 1",
)
def _(m: Market):
    return eb.turnover_by_date(returns(m), [])


@query(
    "WN15_drawdown_blocks",
    "ticker first_day:t last_day:t days:i depth:d",
    "events_bt",
    'SELECT ticker, min(date) AS first_day, max(date) AS last_day, count(*) AS days, min(drawdown) AS depth FROM isl WHERE drawdown < -1e-12::DOUBLE GROUP BY ticker, grp',
    _CURVE
    + """,
flg AS (SELECT *, CASE WHEN (drawdown < -1e-12::DOUBLE) IS DISTINCT FROM lag(drawdown < -1e-12::DOUBLE) OVER (PARTITION BY ticker ORDER BY date) THEN 1 ELSE 0 END AS chg FROM curve),
isl AS (SELECT *, sum(chg) OVER (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING) AS grp FROM flg)""",
)
def _(m: Market):
    curve = eb.equity_curve(eb.daily_portfolio(returns(m), ["ticker"]), ["ticker"])
    return eb.drawdown_blocks(curve, ["ticker"])


@query(
    "WN14_rolling_sharpe",
    "ticker date:t rolling_sharpe:d",
    "events_bt",
    """SELECT ticker, date, CASE WHEN c = 60 AND s > 0 THEN a / s * sqrt(252) END AS rolling_sharpe FROM (
 SELECT ticker, date, count(*) OVER w AS c, avg(strat - 0.045::DOUBLE / 252) OVER w AS a, stddev_samp(strat - 0.045::DOUBLE / 252) OVER w AS s
 FROM dl WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS 59 PRECEDING))""",
    "dl AS (SELECT ticker, date, avg(strategy_return) AS strat FROM events_bt GROUP BY 1, 2)",
)
def _(m: Market):
    return eb.rolling_sharpe(eb.daily_portfolio(returns(m), ["ticker"]), ["ticker"])
