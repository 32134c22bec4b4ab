"""SQL building blocks for statistics and the long-short back-test (DuckDB dialect)."""

from __future__ import annotations

import re


def spearman_sql(source: str, keys: str, x: str, y: str, min_n: int = 0) -> str:
    """SELECT keys, n, ic of average-rank correlation."""
    part = f"PARTITION BY {keys} " if keys else ""
    kx = f"{keys}, " if keys else ""
    group = f" GROUP BY {keys}" if keys else ""
    return f"""SELECT {kx}count(*) AS n, CASE WHEN stddev_pop(rx) > 0 AND stddev_pop(ry) > 0 THEN corr(rx, ry) END AS ic FROM (
 SELECT {kx}rank() OVER ({part}ORDER BY {x}) + (count(*) OVER (PARTITION BY {kx}{x}) - 1) / 2.0::DOUBLE AS rx,
 rank() OVER ({part}ORDER BY {y}) + (count(*) OVER (PARTITION BY {kx}{y}) - 1) / 2.0::DOUBLE AS ry
 FROM {source} WHERE {x} IS NOT NULL AND {y} IS NOT NULL){group}{f' HAVING count(*) >= {min_n}' if min_n else ''}"""


def t_p_sql(t: str, df: str) -> str:
    """Two-sided Student-t probability by Simpson integration with the gamma-function constant."""
    steps = 4000
    theta = f"atan(abs({t}) / sqrt({df}))"
    node = f"CASE WHEN i = 0 OR i = {steps} THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * pow(cos(i * {theta} / {steps}), ({df}) - 1)"
    const = f"exp(lgamma((({df}) + 1) / 2.0::DOUBLE) - lgamma(({df}) / 2.0::DOUBLE)) / sqrt(pi())"
    return f"greatest(0, 1 - 2 * {const} * list_sum(list_transform(range(0, {steps + 1}), lambda i: {node})) * {theta} / {steps} / 3)"


def renamed(sql: str, suffix: str) -> str:
    """The same CTEs under other names, for a second use in one query; ``wk`` and shared views stay."""
    own = re.findall(r"(?:^|,\n|\*/)(\w+) AS (?:MATERIALIZED )?\(", sql)
    names = [n for n in own if n != "wk"]
    return re.sub(r"\b(" + "|".join(names) + r")\b(?! AS \w+[,)])", lambda m: m.group(1) + suffix, sql)


WEEKDAYS = """wk AS (SELECT CAST(d AS DATE) AS d, sum(CASE WHEN isodow(d) <= 5 THEN 1 ELSE 0 END) OVER (ORDER BY d) AS upto
 FROM (SELECT unnest(generate_series(TIMESTAMP '1994-01-01', TIMESTAMP '2004-12-31', INTERVAL 1 DAY)) AS d))"""


def runs_values(runs: list[dict]) -> str:
    rows = ", ".join(
        f"('{r['run']}', {r['hold_days']}, {r['cutoff']}::DOUBLE, {r['cost_bps']}::DOUBLE, '{r['weighting']}', {str(r['vix_filter']).lower()})" for r in runs
    )
    return f"runs AS (SELECT * FROM (VALUES {rows}) AS v(run, hold_days, cutoff, cost_bps, weighting, vix_filter))"


def longshort_sql(rows: str, min_tickers: int | None = None) -> str:
    """CTEs lbook and ltrades.  ``rows``: SELECT run, hold_days, cutoff, cost_bps, weighting, vix_filter, date, ticker, signal.

    Needs the shared views panel, cal, ret, vix.
    """
    gate = (
        f"WHERE (run, date) IN (SELECT (run, date) FROM lsig0 GROUP BY run, date HAVING count(DISTINCT ticker) >= {min_tickers})" if min_tickers else ""
    )
    return f"""/*RECURSIVE_MARK*/{WEEKDAYS},
lsig0 AS MATERIALIZED ({rows}),
lsig AS MATERIALIZED (SELECT * FROM lsig0 {gate}),
ldays AS MATERIALIZED (SELECT DISTINCT run, hold_days, date, w.upto, p.upto + 1 + hold_days AS target FROM lsig JOIN wk w ON w.d = lsig.date JOIN wk p ON p.d = lsig.date - 1),
lfirst AS MATERIALIZED (SELECT run, upto, min(date) AS date FROM ldays GROUP BY 1, 2),
lnext AS MATERIALIZED (SELECT a.run, a.date, b.date AS nd FROM ldays a ASOF JOIN lfirst b ON a.run = b.run AND a.target <= b.upto),
lreb AS (SELECT run, min(date) AS date FROM ldays GROUP BY 1 UNION ALL SELECT lreb.run, lnext.nd FROM lreb JOIN lnext ON lnext.run = lreb.run AND lnext.date = lreb.date),
lrank AS MATERIALIZED (SELECT l.*, row_number() OVER (PARTITION BY run, date ORDER BY signal DESC, ticker) AS rn, count(*) OVER (PARTITION BY run, date) AS cnt
 FROM lsig l JOIN lreb USING (run, date) WHERE ticker IN (SELECT ticker FROM panel)),
lact AS MATERIALIZED (SELECT *, CASE WHEN rn > cnt - k THEN -1 ELSE 1 END AS position FROM (SELECT *, greatest(1, CAST(floor(cnt * cutoff) AS BIGINT)) AS k FROM lrank WHERE cnt >= 4)
 WHERE rn > cnt - k OR rn <= k),
lent AS MATERIALIZED (SELECT a.*, c.pos AS entry_pos, c.pos + hold_days AS exit_pos FROM lact a ASOF JOIN (SELECT date AS cdate, pos FROM cal) c ON a.date <= c.cdate),
lval AS MATERIALIZED (SELECT e.*, coalesce(v.level, 20.0) AS vix_level FROM (SELECT * FROM lent WHERE exit_pos <= (SELECT max(pos) FROM cal)) e ASOF LEFT JOIN (SELECT date AS vdate, level FROM vix) v ON e.date >= v.vdate),
lvol AS MATERIALIZED (SELECT p.ticker, p.entry_pos, CASE WHEN p.entry_pos >= 3 AND stddev_samp(r.ret) > 1e-8 THEN stddev_samp(r.ret) * sqrt(252) ELSE 1 END AS vol
 FROM (SELECT DISTINCT ticker, entry_pos FROM lval WHERE weighting = 'vol_scaled') p LEFT JOIN ret r ON r.ticker = p.ticker AND r.pos BETWEEN p.entry_pos - 19 AND p.entry_pos - 1 GROUP BY 1, 2),
lbook AS MATERIALIZED (SELECT *, CASE WHEN vix_filter AND vix_level > 28 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END *
 CASE WHEN weighting = 'vol_scaled' THEN inv / sum(inv) OVER (PARTITION BY run, date, position)
 WHEN count(*) OVER (PARTITION BY run, date) > count(*) OVER (PARTITION BY run, date, position) THEN 1.0::DOUBLE / count(*) OVER (PARTITION BY run, date, position) ELSE 0.5 END AS weight
 FROM (SELECT l.*, 1.0::DOUBLE / greatest(vol, 1e-6) AS inv FROM lval l LEFT JOIN lvol USING (ticker, entry_pos))),
ltrades AS MATERIALIZED (SELECT run, hold_days, cutoff, cost_bps, weighting, vix_filter, date AS rebalance_date, entry_date, exit_date, ticker, signal, position,
 round(weight, 6) AS weight, round(pr, 6) AS period_return, round(position * weight * pr - cost_bps / 10000 * weight, 6) AS ls_return,
 round(cost_bps / 10000 * weight, 6) AS cost_drag, round(vix_level, 2) AS vix_level FROM (
 SELECT b.*, ce.date AS entry_date, cx.date AS exit_date, (x.close - e.close) / e.close AS pr FROM lbook b
 JOIN panel e ON e.ticker = b.ticker AND e.pos = b.entry_pos JOIN panel x ON x.ticker = b.ticker AND x.pos = b.exit_pos
 JOIN cal ce ON ce.pos = b.entry_pos JOIN cal cx ON cx.pos = b.exit_pos))"""


def run_metrics_sql(trades: str = "ltrades", keys: str = "run") -> str:
    """CTE rm: metrics per run at 252/hold periods per year."""
    return f"""rpnl AS (SELECT {keys}, rebalance_date, sum(ls_return) AS net, 252.0::DOUBLE / max(hold_days) AS py, count(*) FILTER (position = 1) AS n_long FROM {trades} GROUP BY {keys}, rebalance_date),
req AS (SELECT *, product(1 + net) OVER (PARTITION BY {keys} ORDER BY rebalance_date ROWS UNBOUNDED PRECEDING) AS equity FROM rpnl),
rpk AS (SELECT *, max(equity) OVER (PARTITION BY {keys} ORDER BY rebalance_date ROWS UNBOUNDED PRECEDING) AS peak FROM req),
rst AS (SELECT {keys}, count(*) AS n_periods, max(py) AS py, product(1 + net) - 1 AS tot, avg(net - 0.045::DOUBLE / py) AS ex_mean, stddev_samp(net - 0.045::DOUBLE / py) AS ex_std,
 stddev_samp(net) AS std, count(*) FILTER (net < 0) AS n_loss, stddev_samp(net) FILTER (net < 0) AS loss_std, min((equity - peak) / peak) AS max_dd,
 avg(CASE WHEN net > 0 THEN 1 ELSE 0 END) AS win, round(avg(n_long), 1) AS avg_positions_per_side FROM rpk GROUP BY {keys}),
rhit AS (SELECT {keys}, count(*) AS n_trades, avg(CASE WHEN sign(position) * period_return > 0 THEN 1 ELSE 0 END) AS hit FROM {trades} GROUP BY {keys}),
ric AS ({spearman_sql(trades, keys, "signal", "period_return", 10)}),
rall AS (SELECT *, pow(1 + tot, py / greatest(n_periods, 1)) - 1 AS ann, CASE WHEN n_loss > 1 THEN loss_std * sqrt(py) ELSE 1e-9 END AS down
 FROM rst JOIN rhit USING ({keys}) LEFT JOIN (SELECT {keys}, ic FROM ric) USING ({keys})),
rm AS (SELECT {keys}, round(tot, 4) AS total_return, round(ann, 4) AS annualised_return, round(std * sqrt(py), 4) AS annualised_volatility,
 round(CASE WHEN ex_std > 0 THEN ex_mean / ex_std * sqrt(py) ELSE 0 END, 4) AS sharpe_ratio, round(CASE WHEN down > 0 THEN (ann - 0.045) / down ELSE 0 END, 4) AS sortino_ratio,
 round(CASE WHEN abs(max_dd) > 1e-9 THEN ann / abs(max_dd) ELSE 0 END, 4) AS calmar_ratio, round(max_dd, 4) AS max_drawdown, round(win, 4) AS win_rate,
 round(ic, 4) AS ic, round(hit, 4) AS hit_rate, n_periods, n_trades, avg_positions_per_side FROM rall)"""


RUN_METRICS = (
    "total_return:d4 annualised_return:d4 annualised_volatility:d4 sharpe_ratio:d4 sortino_ratio:d4 calmar_ratio:d4 max_drawdown:d4 win_rate:d4 "
    "ic:d4 hit_rate:d4 n_periods:i n_trades:i avg_positions_per_side:d1"
)


def trade_metrics_sql(trades: str, keys: str) -> str:
    """CTE tm: metrics of a trade table at the frequency of its own rebalance gaps.  Needs wk."""
    return f"""tdays AS (SELECT DISTINCT {keys}, rebalance_date FROM {trades}),
tgap AS (SELECT {keys}, greatest(1, w2.upto - w1.upto - 1) AS gap FROM (SELECT *, lag(rebalance_date) OVER (PARTITION BY {keys} ORDER BY rebalance_date) AS prev FROM tdays) g
 JOIN wk w1 ON w1.d = g.prev - 1 JOIN wk w2 ON w2.d = g.rebalance_date),
tpy AS (SELECT {keys}, 252.0::DOUBLE / greatest(1.0, coalesce(median(gap), 1)) AS py FROM (SELECT DISTINCT {keys} FROM tdays) LEFT JOIN tgap USING ({keys}) GROUP BY {keys}),
tpnl AS (SELECT {keys}, rebalance_date, sum(ls_return) AS net FROM {trades} GROUP BY {keys}, rebalance_date),
teq AS (SELECT *, product(1 + net) OVER (PARTITION BY {keys} ORDER BY rebalance_date ROWS UNBOUNDED PRECEDING) AS equity FROM tpnl JOIN tpy USING ({keys})),
tpk AS (SELECT *, max(equity) OVER (PARTITION BY {keys} ORDER BY rebalance_date ROWS UNBOUNDED PRECEDING) AS peak FROM teq),
tst AS (SELECT {keys}, count(*) AS n_periods, max(py) AS py, product(1 + net) - 1 AS tot, avg(net - 0.045::DOUBLE / py) AS ex_mean, stddev_samp(net - 0.045::DOUBLE / py) AS ex_std,
 min((equity - peak) / peak) AS max_dd, avg(CASE WHEN net > 0 THEN 1 ELSE 0 END) AS win FROM tpk GROUP BY {keys}),
tside AS (SELECT {keys}, count(*) AS trade_count, avg(participation_proxy) AS part FROM {trades} GROUP BY {keys}),
tic AS ({spearman_sql(trades, keys, "signal", "period_return", 11)}),
tm AS (SELECT {keys}, round(pow(1 + tot, py / greatest(1, n_periods)) - 1, 4) AS annualised_return, round(CASE WHEN ex_std > 0 THEN ex_mean / ex_std * sqrt(py) ELSE 0 END, 4) AS sharpe_ratio,
 round(max_dd, 4) AS max_drawdown, round(win, 4) AS win_rate, round(ic, 4) AS ic, trade_count, round(part, 6) AS participation_proxy_mean, n_periods
 FROM tst JOIN tside USING ({keys}) LEFT JOIN (SELECT {keys}, ic FROM tic) USING ({keys}))"""


TRADE_METRICS = "annualised_return:d4 sharpe_ratio:d4 max_drawdown:d4 win_rate:d4 ic:d4 trade_count:i participation_proxy_mean:d6 n_periods:i"
