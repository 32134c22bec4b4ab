"""Parameter studies."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapewire import config
from tapewire.operators import longshort as ls
from tapewire.operators import validation as va
from tapewire.plans import experiments as ex
from tapewire.plans.fixtures import Market
from tapewire.plans.oracle_stats import RUN_METRICS, WEEKDAYS, longshort_sql, renamed, run_metrics_sql, spearman_sql, trade_metrics_sql
from tapewire.plans.queries.core import metrics_sql
from tapewire.plans.queries.longshort import _LOGVOL as LOGVOL
from tapewire.plans.queries.longshort import DAILY_GATE, DAILY_VIEWS, FACTOR_CTES, FVIEWS, GATE, TRADEABLE, VIEWS, daily_gated, gated, matrix
from tapewire.plans.queries.longshort import sql as ls_sql
from tapewire.plans.queries.text import CARS
from tapewire.plans.registry import query

_GRID = ", ".join(f"('{c}', {t}::DOUBLE, {b}::DOUBLE, {s}::DOUBLE)" for c, t, b, s in config.THRESHOLD_GRID)
_ABL = f"""grid AS (SELECT * FROM (VALUES {_GRID}) v(config, conf, buy, sell)),
asig AS MATERIALIZED (SELECT config, buy, sell, date, ticker, avg(signal::DOUBLE) AS signal FROM scored JOIN grid ON confidence >= conf GROUP BY ALL),
aev AS MATERIALIZED (SELECT config, date, ticker, position, position * next_ret - abs(position) * 0.0015::DOUBLE AS strategy_return, next_ret AS benchmark_return, abs(position) * 0.0015::DOUBLE AS cost_drag FROM (
 SELECT *, CASE WHEN signal > buy THEN 1 WHEN signal < sell THEN -1 ELSE 0 END AS position FROM asig JOIN nextret USING (date, ticker))),
afw AS MATERIALIZED (SELECT s.config, s.signal, s.buy, s.sell, f.return_lag_1 AS ret FROM (SELECT a.*, c.pos FROM asig a ASOF JOIN (SELECT date AS cd, pos FROM cal) c ON a.date <= c.cd) s JOIN fwd f USING (ticker, pos) WHERE return_lag_1 IS NOT NULL),
aic AS ({spearman_sql('afw', 'config', 'signal', 'ret', 5)}),
ahit AS (SELECT config, round(count(*) FILTER ((signal > buy AND ret > 0) OR (signal < sell AND ret < 0)) / nullif(count(*) FILTER (signal > buy OR signal < sell), 0), 4) AS hit FROM afw GROUP BY 1),
""" + metrics_sql("aev", "config")


@query(
    "EX01_threshold_ablation",
    "config n_signals:i n_active:i ic_1d:d4 hit_rate_1d:d4 sharpe:d4",
    "scored nextret cal fwd",
    """SELECT s.config, n_signals, coalesce(mt.total_trades, 0) AS n_active, round(ic, 4) AS ic_1d, hit AS hit_rate_1d, CASE WHEN mt.total_trades > 0 THEN mt.sharpe_ratio END AS sharpe
 FROM (SELECT config, count(*) AS n_signals FROM asig GROUP BY 1) s LEFT JOIN aic USING (config) LEFT JOIN ahit USING (config) LEFT JOIN mt USING (config)""",
    _ABL,
)
def _(m: Market):
    return ex.threshold_ablation(m.scored, m.panel, m.cal)


@query(
    "JN13_parameter_grid",
    "config date:t ticker signal:d",
    "scored",
    "SELECT config, date, ticker, avg(signal::DOUBLE) AS signal FROM scored JOIN grid ON confidence >= conf GROUP BY ALL",
    f"grid AS (SELECT * FROM (VALUES {_GRID}) v(config, conf, buy, sell))",
)
def _(m: Market):
    from tapewire.operators.calendar import explode_params

    by_conf = ex.signals_by_threshold(m.scored, sorted({g[1] for g in config.THRESHOLD_GRID}))
    return explode_params(by_conf, [{"config": c, "want": t} for c, t, _, _ in config.THRESHOLD_GRID]).where("conf = want")


@query(
    "EX02_horizon_ablation",
    "lag:i n:i ic:d4 hit_rate:d4",
    "binary_sig cal fwd",
    """SELECT lag, n, round(ic, 4) AS ic, hit AS hit_rate FROM s JOIN (SELECT lag, round(count(*) FILTER ((signal > 0.45 AND ret > 0) OR (signal < -0.45 AND ret < 0)) / count(*) FILTER (abs(signal) > 0.45), 4) AS hit
 FROM l GROUP BY 1) h USING (lag)""",
    """f AS MATERIALIZED (SELECT s.signal, w.* FROM (SELECT a.*, c.pos FROM binary_sig a ASOF JOIN (SELECT date AS cd, pos FROM cal) c ON a.date <= c.cd) s JOIN fwd w USING (ticker, pos)),
l AS MATERIALIZED ("""
    + " UNION ALL ".join(f"SELECT {k} AS lag, signal, return_lag_{k} AS ret FROM f WHERE return_lag_{k} IS NOT NULL" for k in ex.LAGS)
    + "),\ns AS ("
    + spearman_sql("l", "lag", "signal", "ret")
    + ")",
)
def _(m: Market):
    return ex.horizon_ablation(m.scored, m.panel, m.cal)


def _car_sql(floor: float) -> str:
    total = " + ".join(f"CASE WHEN contains(lower(headline), '{k}') THEN {v}::DOUBLE ELSE 0 END" for k, v in CARS.items() if abs(v) >= floor)
    return f"greatest(-1, least(1, signal + greatest(-0.25, least(0.25, {total}))))"


_KWA = f"""ksig AS MATERIALIZED (SELECT variant, date, ticker, avg(s) AS signal FROM (SELECT 'none' AS variant, date, ticker, signal::DOUBLE AS s FROM conf UNION ALL
 SELECT 'car>=0.003', date, ticker, {_car_sql(0.003)} FROM conf UNION ALL SELECT 'car>=0.005', date, ticker, {_car_sql(0.005)} FROM conf) GROUP BY ALL),
kev AS MATERIALIZED (SELECT variant, date, ticker, position, position * next_ret - abs(position) * 0.0015::DOUBLE AS strategy_return, next_ret AS benchmark_return, abs(position) * 0.0015::DOUBLE AS cost_drag FROM (
 SELECT *, CASE WHEN signal > 0.45 THEN 1 WHEN signal < -0.45 THEN -1 ELSE 0 END AS position FROM ksig JOIN nextret USING (date, ticker))),
kfw AS MATERIALIZED (SELECT s.variant, s.signal, f.return_lag_1 AS ret FROM (SELECT a.*, c.pos FROM ksig a ASOF JOIN (SELECT date AS cd, pos FROM cal) c ON a.date <= c.cd) s JOIN fwd f USING (ticker, pos) WHERE return_lag_1 IS NOT NULL),
khit AS (SELECT variant, round(count(*) FILTER ((signal > 0.45 AND ret > 0) OR (signal < -0.45 AND ret < 0)) / count(*) FILTER (abs(signal) > 0.45), 4) AS hit_rate FROM kfw GROUP BY 1),
""" + metrics_sql("kev", "variant")


@query(
    "EX03_keyword_ablation",
    "variant n_signals:i hit_rate:d4 total_trades:i sharpe_ratio:d4",
    "conf nextret cal fwd",
    "SELECT variant, n_signals, hit_rate, total_trades, sharpe_ratio FROM (SELECT variant, count(*) AS n_signals FROM ksig GROUP BY 1) JOIN khit USING (variant) JOIN mt USING (variant)",
    _KWA,
)
def _(m: Market):
    return ex.keyword_ablation(m.scored, m.panel, m.cal, CARS)


@query(
    "EX04_inversion_study",
    "variant ic:d4 n:i hit_rate:d4 total_trades:i win_rate:d4 sharpe_ratio:d4 max_drawdown:d4",
    "binary_sig nextret cal fwd",
    "SELECT variant, ic, n, hit_rate, total_trades, win_rate, sharpe_ratio, max_drawdown FROM iic JOIN ihit USING (variant) LEFT JOIN mt USING (variant)",
    """ifw AS MATERIALIZED (SELECT variant, signal * sgn AS signal, return_lag_1 AS ret FROM (SELECT a.*, c.pos FROM binary_sig a ASOF JOIN (SELECT date AS cd, pos FROM cal) c ON a.date <= c.cd) JOIN fwd USING (ticker, pos)
 CROSS JOIN (VALUES ('normal', 1), ('inverted', -1)) v(variant, sgn) WHERE return_lag_1 IS NOT NULL),
iic AS (""" + spearman_sql("ifw", "variant", "signal", "ret", 5) + """),
ihit AS (SELECT variant, round(count(*) FILTER ((signal > 0.45 AND ret > 0) OR (signal < -0.45 AND ret < 0)) / count(*) FILTER (abs(signal) > 0.45), 4) AS hit_rate FROM ifw GROUP BY 1),
iev AS MATERIALIZED (SELECT variant, date, ticker, position, position * next_ret - abs(position) * 0.0015::DOUBLE AS strategy_return, next_ret AS benchmark_return, abs(position) * 0.0015::DOUBLE AS cost_drag FROM (
 SELECT *, CASE WHEN signal * sgn > 0.45 THEN 1 WHEN signal * sgn < -0.45 THEN -1 ELSE 0 END AS position FROM binary_sig JOIN nextret USING (date, ticker) CROSS JOIN (VALUES ('normal', 1), ('inverted', -1)) v(variant, sgn))),
"""
    + metrics_sql("iev", "variant"),
)
def _(m: Market):
    return ex.inversion_study(m.scored, m.panel, m.cal)


_IMP = ex.improvement_runs()
_IMPNAMES = "inames AS (SELECT * FROM (VALUES " + ", ".join(f"('{r['run']}', '{r['section']}', {r['q']}::DOUBLE, '{r['w']}', '{r['label']}')" for r in _IMP) + ") v(run, section, q, w, label))"
_IMPSEL = """im AS MATERIALIZED (SELECT n.section, n.q, n.w, n.label AS run, rm.sharpe_ratio, rm.n_periods FROM rm JOIN inames n USING (run)),
ic1 AS (SELECT * REPLACE ('cutoff' AS section) FROM im WHERE section = 'base' AND w = 'equal'),
ib1 AS (SELECT q FROM ic1 ORDER BY sharpe_ratio DESC NULLS LAST, run LIMIT 1),
ic2 AS (SELECT * REPLACE ('weighting' AS section, run || '_' || left(w, 3) AS run) FROM im WHERE section = 'base' AND q IN (SELECT q FROM ib1 UNION ALL SELECT 0.10::DOUBLE)),
ib2 AS (SELECT q, w FROM ic2 ORDER BY sharpe_ratio DESC NULLS LAST, run LIMIT 1),
ic3 AS (SELECT im.* FROM im JOIN ib2 USING (q, w) WHERE section <> 'base')"""


@query(
    "EX05_improvement_suite",
    "run section sharpe_ratio:d4 n_periods:i",
    VIEWS,
    "SELECT * FROM ic1 UNION ALL SELECT * FROM ic2 UNION ALL SELECT * FROM ic3",
    ls_sql(_IMP) + ",\n" + run_metrics_sql() + ",\n" + _IMPNAMES + ",\n" + _IMPSEL,
)
def _(m: Market):
    return ex.improvement_suite(m.weekly, m.panel, m.cal, m.vix)


_HOLDS = [ls.strategy(f"hold{h}", hold_days=h) for h in (1, 2, 3)]


@query("BT15_hold_comparison", "run " + RUN_METRICS, VIEWS, "SELECT * FROM rm", ls_sql(_HOLDS) + ",\n" + run_metrics_sql())
def _(m: Market):
    return ex.run_grid(gated(m), m.panel, m.cal, m.vix, _HOLDS)


_SWEEP = [ls.strategy(f"tc{t}", cost_bps=t * 1.5) for t in (0, 5, 10, 15, 20)]
_CHAMP = "champ AS MATERIALIZED (SELECT *, round(0.4::DOUBLE * signal + 0.4::DOUBLE * coalesce(momentum, 0) + 0.2::DOUBLE * coalesce(vol_factor, 0), 6) AS cs FROM fac)"


@query(
    "EX07_cost_sweep",
    "run tc_bps:d sharpe_ratio:d4 annualised_return:d4 max_drawdown:d4",
    FVIEWS + " vix",
    "SELECT *, CAST(substr(run, 3) AS DOUBLE) AS tc_bps FROM rm",
    FACTOR_CTES + ",\n" + _CHAMP + ",\n" + ls_sql(_SWEEP, "champ", "cs", None) + ",\n" + run_metrics_sql(),
)
def _(m: Market):
    return ex.cost_sweep(matrix(m), m.panel, m.cal)


@query(
    "AG14_break_even_cost",
    "break_even_cost_bps:d first_negative_cost_bps:d",
    FVIEWS + " vix",
    "SELECT coalesce(max(CASE WHEN sharpe_ratio >= 0 THEN CAST(substr(run, 3) AS DOUBLE) END), 0) AS break_even_cost_bps, min(CASE WHEN sharpe_ratio <= 0 THEN CAST(substr(run, 3) AS DOUBLE) END) AS first_negative_cost_bps FROM rm",
    FACTOR_CTES + ",\n" + _CHAMP + ",\n" + ls_sql(_SWEEP, "champ", "cs", None) + ",\n" + run_metrics_sql(),
)
def _(m: Market):
    return ex.break_even(ex.cost_sweep(matrix(m), m.panel, m.cal))


_W12 = ex.weight_rows()
_WSQL = "wgrid AS (SELECT * FROM (VALUES " + ", ".join(f"('{r['run']}', {r['w_s']}::DOUBLE, {r['w_m']}::DOUBLE, {r['w_v']}::DOUBLE, {r['w_l']}::DOUBLE)" for r in _W12) + ") v(run, ws, wm, wv, wl))"


@query(
    "FX05_weight_grid",
    "run date:t ticker signal:d5",
    FVIEWS,
    """SELECT run, date, ticker, round(ws / t * signal + wm / t * coalesce(momentum, 0) + wv / t * coalesce(vol_factor, 0) + wl / t * coalesce(liquidity, 0), 6) AS signal
 FROM fac CROSS JOIN (SELECT *, abs(ws) + abs(wm) + abs(wv) + abs(wl) AS t FROM wgrid)""",
    FACTOR_CTES + ",\n" + _WSQL,
)
def _(m: Market):
    return ex.scored_grid(matrix(m), _W12)


_FIXED = "2 AS hold_days, 0.2::DOUBLE AS cutoff, 15.0::DOUBLE AS cost_bps, 'equal' AS weighting, false AS vix_filter, date, ticker"
_SCORE = "round(ws / t * signal + wm / t * coalesce(momentum, 0) + wv / t * coalesce(vol_factor, 0) + wl / t * coalesce(liquidity, 0), 6)"
_WT = "(SELECT *, abs(ws) + abs(wm) + abs(wv) + abs(wl) AS t FROM wgrid)"
_MF = f"SELECT run, {_FIXED}, {_SCORE} AS signal FROM fac CROSS JOIN {_WT}" + "".join(
    f" UNION ALL SELECT 'only_{c}', {_FIXED}, {c} FROM fac WHERE {c} IS NOT NULL" for c in ("signal", "momentum", "vol_factor", "liquidity")
)


def _recursive_first(*parts: str) -> str:
    return "/*RECURSIVE_MARK*/" + ",\n".join(p.replace("/*RECURSIVE_MARK*/", "") for p in parts)


@query(
    "EX06_multifactor_suite",
    "run " + RUN_METRICS,
    FVIEWS + " vix",
    "SELECT * FROM rm",
    _recursive_first(FACTOR_CTES, _WSQL, longshort_sql(_MF), run_metrics_sql()),
)
def _(m: Market):
    return ex.multifactor_suite(matrix(m), m.panel, m.cal)


# Variants A to G with the variant as key of the factor views.
_VSIG = """vplain AS MATERIALIZED (SELECT date, ticker, avg(signal * confidence) AS wsig, count(*) AS headline_count FROM conf GROUP BY 1, 2),
vcap AS MATERIALIZED (SELECT date, ticker, avg(signal::DOUBLE) AS signal, count(*) AS headline_count FROM (
 SELECT *, row_number() OVER (PARTITION BY date, ticker ORDER BY confidence DESC, headline_id) AS rn FROM conf) WHERE rn <= 3 GROUP BY 1, 2),
vsn AS MATERIALIZED (SELECT variant, date, ticker, headline_count, CASE WHEN n < 2 OR s < 1e-9 THEN 0 ELSE (signal - a) / s END AS signal FROM (
 SELECT *, count(*) OVER w AS n, stddev_samp(signal) OVER w AS s, avg(signal) OVER w AS a FROM (SELECT x.*, coalesce(sector, 'Other') AS sector FROM (
 SELECT 'D_sector_neutral' AS variant, date, ticker, wsig AS signal, headline_count FROM vplain UNION ALL SELECT 'E_all_improvements', date, ticker, signal, headline_count FROM capped) x LEFT JOIN sectors USING (ticker))
 WINDOW w AS (PARTITION BY variant, date, sector))),
vsig AS MATERIALIZED (SELECT v AS variant, date, ticker, signal, headline_count FROM binary_sig CROSS JOIN (VALUES ('A_baseline'), ('F_vol_target'), ('G_vix_filter')) t(v)
 UNION ALL SELECT 'B_conf_weighted', date, ticker, wsig, headline_count FROM vplain UNION ALL SELECT 'C_shock_filter', date, ticker, signal, headline_count FROM vcap
 UNION ALL SELECT variant, date, ticker, signal, headline_count FROM vsn)"""
_VFAC = FACTOR_CTES.replace("FROM capped s", "FROM vsig s").replace("SELECT date, ticker, signal, headline_count,", "SELECT variant, pos, date, ticker, signal, headline_count,").replace("PARTITION BY date", "PARTITION BY variant, date")
_VGRID = f"""vscore AS MATERIALIZED (SELECT variant, variant || '|' || run AS run, pos, date, ticker, {_SCORE} AS cs FROM fac CROSS JOIN {_WT}),
vfinal AS MATERIALIZED (SELECT s.run, s.date, s.ticker, CASE WHEN variant = 'F_vol_target' THEN greatest(-3, least(3, cs * (0.15::DOUBLE / CASE WHEN rv > 0.01 THEN rv ELSE 1 END)))
 WHEN variant = 'G_vix_filter' AND level > 30 AND cs > 0 THEN cs * 0.5 ELSE cs END AS cs FROM vscore s LEFT JOIN lv ON lv.ticker = s.ticker AND lv.pos = s.pos LEFT JOIN vix x ON x.date = s.date)"""
_VVIEWS = "conf capped binary_sig sectors panel cal ret vix"
_ALL84 = _recursive_first(
    _VSIG, _VFAC, _WSQL, LOGVOL, _VGRID, longshort_sql(f"SELECT run, {_FIXED}, cs AS signal FROM vfinal"), run_metrics_sql()
)


def grid_trades(m: Market):
    return ex.strategy_grid(ex.signal_variants(m.scored, m.panel, m.cal, m.sectors), m.panel, m.cal, m.vix)


@query(
    "FX11_signal_variants",
    "variant n:i signal_sum:d5 momentum_sum:d5",
    _VVIEWS,
    "SELECT variant, count(*) AS n, sum(signal) AS signal_sum, sum(momentum) AS momentum_sum FROM fac GROUP BY 1",
    _VSIG + ",\n" + _VFAC,
)
def _(m: Market):
    v = ex.signal_variants(m.scored, m.panel, m.cal, m.sectors)
    return v.groupBy("variant").agg(F.count("*").alias("n"), F.sum("signal").alias("signal_sum"), F.sum("momentum").alias("momentum_sum"))


@query("EX08_strategy_grid", "run " + RUN_METRICS, _VVIEWS, "SELECT * FROM rm", _ALL84)
def _(m: Market):
    return ls.run_metrics(grid_trades(m), p_value=False)


@query(
    "AG15_best_per_variant",
    "variant run sharpe_ratio:d4 delta:d4 verdict",
    _VVIEWS,
    """SELECT variant, run, sharpe_ratio, delta, CASE WHEN delta > 0.10 THEN 'IMPROVEMENT' WHEN delta > -0.05 THEN 'neutral' ELSE 'HURTS' END AS verdict FROM (
 SELECT *, sharpe_ratio - max(CASE WHEN variant = 'A_baseline' THEN sharpe_ratio END) OVER () AS delta FROM (SELECT *, row_number() OVER (PARTITION BY variant ORDER BY coalesce(sharpe_ratio, -999) DESC, run) AS rn FROM (
 SELECT split_part(run, '|', 1) AS variant, run, sharpe_ratio FROM rm)) WHERE rn = 1)""",
    _ALL84,
)
def _(m: Market):
    return ex.best_per_variant(ls.run_metrics(grid_trades(m), p_value=False))


_FOUR = [ls.strategy(f"q{int(q * 100)}", cutoff=q) for q in (0.2, 0.3, 0.4, 0.5)]


@query(
    "JN14_aligned_returns",
    "run rebalance_date:t r:d",
    VIEWS,
    "SELECT r.run, p.rebalance_date, coalesce(n.net, 0) AS r FROM (SELECT DISTINCT run FROM np) r CROSS JOIN (SELECT DISTINCT rebalance_date FROM np) p LEFT JOIN np n ON n.run = r.run AND n.rebalance_date = p.rebalance_date",
    ls_sql(_FOUR) + ",\nnp AS MATERIALIZED (SELECT run, rebalance_date, sum(ls_return) AS net FROM ltrades GROUP BY 1, 2)",
)
def _(m: Market):
    return ex.aligned_returns(ls.long_short(ls.with_strategies(gated(m), _FOUR), m.panel, m.cal, m.vix))


_BOOT = """bnet AS MATERIALIZED (SELECT run, rebalance_date, sum(ls_return) AS net FROM ltrades GROUP BY 1, 2),
bidx AS MATERIALIZED (SELECT rebalance_date, row_number() OVER (ORDER BY rebalance_date) - 1 AS idx FROM (SELECT DISTINCT rebalance_date FROM bnet)),
bret AS MATERIALIZED (SELECT r.run, p.idx, coalesce(n.net, 0) AS r FROM (SELECT DISTINCT run FROM bnet) r CROSS JOIN bidx p LEFT JOIN bnet n ON n.run = r.run AND n.rebalance_date = p.rebalance_date),
bobs AS MATERIALIZED (SELECT run, count(*)::DOUBLE AS n, sum(r) AS s, sum(r * r) AS ss FROM bret GROUP BY 1),
bpick AS MATERIALIZED (SELECT rep, ('0x' || left(md5(rep || '|' || slot || '|42'), 8))::BIGINT % (SELECT count(*) FROM bidx) AS idx FROM range(2000) a(rep), range(1, (SELECT count(*) FROM bidx) + 1) b(slot)),
bcnt AS MATERIALIZED (SELECT rep, idx, count(*) AS c FROM bpick GROUP BY 1, 2),
bsum AS MATERIALIZED (SELECT rep, run, sum(c)::DOUBLE AS n, sum(c * r) AS s, sum(c * r * r) AS ss FROM bcnt JOIN bret USING (idx) GROUP BY 1, 2),
btop AS MATERIALIZED (SELECT rep, max(sh) AS top FROM (SELECT rep, CASE WHEN n >= 3 AND sd >= 1e-10 THEN (s / n - 0.045::DOUBLE / 126) / sd * sqrt(126) END AS sh FROM (SELECT *, sqrt(greatest(0, (ss - n * (s / n) * (s / n)) / (n - 1))) AS sd FROM bsum)) GROUP BY 1 HAVING max(sh) IS NOT NULL),
bbest AS (SELECT arg_max(run, sh) AS best_strategy, max(sh) AS best, count(*) AS n_strategies FROM (SELECT run, CASE WHEN n >= 3 AND sd >= 1e-10 THEN (s / n - 0.045::DOUBLE / 126) / sd * sqrt(126) END AS sh FROM (SELECT *, sqrt(greatest(0, (ss - n * (s / n) * (s / n)) / (n - 1))) AS sd FROM bobs)) WHERE sh IS NOT NULL)"""


@query(
    "STA18_reality_check",
    "best_strategy best_sharpe:d4 p_value:d4 boot_mean:d4 boot_std:d4 boot_95pct:d4 n_strategies:i n_periods:i n_boot:i",
    _VVIEWS,
    """SELECT best_strategy, round(best, 4) AS best_sharpe, round(avg(CASE WHEN top >= best THEN 1.0::DOUBLE ELSE 0 END), 4) AS p_value, round(avg(top), 4) AS boot_mean, round(stddev_pop(top), 4) AS boot_std, round(quantile_cont(top, 0.95), 4) AS boot_95pct,
 n_strategies, (SELECT count(*) FROM bidx) AS n_periods, count(*) AS n_boot FROM btop, bbest GROUP BY best_strategy, best, n_strategies""",
    _ALL84 + ",\n" + _BOOT,
)
def _(m: Market):
    return ex.reality_check(ex.aligned_returns(grid_trades(m)), draws=2000, seed=42)


@query(
    "AG16_improvement_delta",
    "run delta:d4 verdict",
    VIEWS,
    "SELECT run, delta, CASE WHEN delta > 0.10 THEN 'IMPROVEMENT' WHEN delta > -0.05 THEN 'neutral' ELSE 'HURTS' END AS verdict FROM (SELECT run, sharpe_ratio - (SELECT sharpe_ratio FROM rm WHERE run = 'q20') AS delta FROM rm)",
    ls_sql(_FOUR) + ",\n" + run_metrics_sql(),
)
def _(m: Market):
    rows = ex.run_grid(gated(m), m.panel, m.cal, m.vix, _FOUR)
    named = rows.withColumn("run", F.concat(F.when(F.col("run") == "q20", "A_baseline").otherwise(F.col("run")), F.lit("|"), F.col("run")))
    return ex.best_per_variant(named).withColumn("run", F.element_at(F.split("run", r"\|"), -1))


_PER = "year(date) || '-Q' || quarter(date)"
_PCTES = _recursive_first(
    f"""pok AS MATERIALIZED (SELECT {_PER} AS period, count(DISTINCT ticker) AS n_tickers, CAST(date_trunc('quarter', min(date)) AS DATE) AS start,
 CAST(date_trunc('quarter', min(date)) + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE) AS end_date FROM binary_sig GROUP BY 1 HAVING count(DISTINCT ticker) >= 5)""",
    FACTOR_CTES.replace("FROM capped s", "FROM binary_sig s").replace("SELECT date, ticker, signal, headline_count,", "SELECT pos, date, ticker, signal, headline_count,"),
    f"pch AS MATERIALIZED (SELECT period, pos, date, ticker, round(0.4::DOUBLE * signal + 0.4::DOUBLE * coalesce(momentum, 0) + 0.2::DOUBLE * coalesce(vol_factor, 0), 6) AS cs FROM (SELECT {_PER} AS period, * FROM fac) JOIN pok USING (period))",
    longshort_sql(f"SELECT period AS run, {_FIXED}, cs AS signal FROM pch"),
    run_metrics_sql(),
    "pfw AS MATERIALIZED (SELECT period, date, cs, return_lag_2 FROM pch JOIN fwd USING (ticker, pos)),\npic AS MATERIALIZED (" + spearman_sql("pfw", "period, date", "cs", "return_lag_2", 5) + ")",
    "pim AS (SELECT period, round(avg(ic), 5) AS ic_mean, round(CASE WHEN count(*) > 1 AND stddev_samp(ic) > 0 THEN avg(ic) / (stddev_samp(ic) / sqrt(count(*))) END, 3) AS ic_t_stat FROM pic WHERE ic IS NOT NULL GROUP BY 1),\n"
    "pwf AS MATERIALIZED (SELECT p.*, rm.sharpe_ratio AS sharpe, ic_mean, ic_t_stat FROM pok p LEFT JOIN rm ON rm.run = p.period LEFT JOIN pim USING (period))",
)
_PVIEWS = "binary_sig panel cal ret vix fwd"


@query(
    "EX09_period_walk_forward",
    "period start:t end_date:t n_tickers:i sharpe:d4 ic_mean:d5 ic_t_stat:d3",
    _PVIEWS,
    "SELECT * FROM pwf",
    _PCTES,
)
def _(m: Market):
    return ex.period_walk_forward(m.scored, m.panel, m.cal)


@query(
    "STA20_walk_forward_summary",
    "n_periods:i mean_sharpe:d4 pct_positive_sharpe:d4 mean_ic:d5 verdict",
    _PVIEWS,
    """SELECT *, CASE WHEN pct_positive_sharpe >= 0.6 AND mean_sharpe > 0 THEN 'PASS' WHEN pct_positive_sharpe >= 0.5 THEN 'BORDERLINE' ELSE 'FAIL' END AS verdict FROM (
 SELECT count(*) AS n_periods, avg(sharpe) AS mean_sharpe, avg(CASE WHEN sharpe > 0 THEN 1 ELSE 0 END) AS pct_positive_sharpe, avg(ic_mean) AS mean_ic FROM pwf WHERE sharpe IS NOT NULL)""",
    _PCTES,
)
def _(m: Market):
    return va.walk_forward_summary(ex.period_walk_forward(m.scored, m.panel, m.cal))


# The walk-forward study: signals of both variants, folds and settings as rows, trades, choices, tests.
_ESIG = """wkept AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY date, ticker ORDER BY confidence DESC, headline_id) AS rn FROM wscored WHERE confidence >= 0.6::DOUBLE) WHERE rn <= 3),
wday AS MATERIALIZED (SELECT conf, date, ticker, avg(signal * confidence) AS signal, count(*) AS headline_count FROM wkept JOIN (VALUES (0.6::DOUBLE), (0.7::DOUBLE), (0.75::DOUBLE)) v(conf) ON confidence >= conf GROUP BY 1, 2, 3),
esig AS MATERIALIZED (SELECT conf, date, ticker, signal, headline_count FROM (SELECT *, quantile_cont(dv, 0.2) OVER (PARTITION BY conf, date) AS q FROM (SELECT wday.*, close * volume AS dv FROM wday LEFT JOIN px USING (date, ticker))) WHERE dv IS NULL OR dv >= q),
ssig AS MATERIALIZED (SELECT conf, date, ticker, signal FROM wday WHERE (conf, date) IN (SELECT (conf, date) FROM wday GROUP BY conf, date HAVING count(DISTINCT ticker) >= 10))"""
_EFAC = FACTOR_CTES.replace("FROM capped s", "FROM esig s").replace("SELECT date, ticker, signal, headline_count,", "SELECT conf, date, ticker, signal, headline_count,").replace("PARTITION BY date", "PARTITION BY conf, date")
_CAL = ", ".join(f"({k}, '{c['variant']}', {c['conf']}::DOUBLE, {c['cutoff']}::DOUBLE, {c['hold_days']}, {str(c['vix_filter']).lower()})" for k, c in enumerate(ex.CALIBRATION))
_WROW = "SELECT {c}.run, hold_days, cutoff, cost_bps, 'equal' AS weighting, vix_filter, date, ticker, signal FROM wsig JOIN {c} USING (variant, conf) WHERE date >= since AND date <= until"


def _walk(part: str, keys: str, settings: str) -> str:
    """Trades and metrics of a settings table under names of their own."""
    trades = longshort_sql(_WROW.format(c=settings)).replace("/*RECURSIVE_MARK*/", "")
    body = trades[trades.index("lsig0 AS") :] + ",\n" + TRADEABLE + f",\nttf AS MATERIALIZED (SELECT t.*, c.fold, c.scenario FROM ttr t JOIN {settings} c USING (run)),\n" + trade_metrics_sql("ttf", keys)
    return renamed(body, part)


_WF = "/*RECURSIVE_MARK*/" + ",\n".join(
    [
        WEEKDAYS,
        _ESIG,
        _EFAC,
        "wsig AS MATERIALIZED (SELECT 'sentiment' AS variant, conf, date, ticker, signal FROM ssig UNION ALL SELECT 'ensemble', conf, date, ticker, round(0.6::DOUBLE * signal + 0.3::DOUBLE * coalesce(momentum, 0) + 0.1::DOUBLE * coalesce(vol_factor, 0), 6) FROM fac)",
        """wfold AS MATERIALIZED (SELECT CAST(q AS VARCHAR) AS fold, q AS since, CAST(q + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE) AS until FROM (
 SELECT q, row_number() OVER (ORDER BY q DESC) AS k, count(*) OVER () AS n FROM (SELECT DISTINCT CAST(date_trunc('quarter', date) AS DATE) AS q FROM wscored)) WHERE k <= 4 AND k <= n - 4)""",
        f"wcal AS (SELECT * FROM (VALUES {_CAL}) v(k, variant, conf, cutoff, hold_days, vix_filter))",
        "wtrain AS MATERIALIZED (SELECT fold || '|' || lpad(CAST(k AS VARCHAR), 2, '0') AS run, fold, 'train' AS scenario, wcal.*, 15.0::DOUBLE AS cost_bps, DATE '0001-01-01' AS since, CAST(since - INTERVAL 1 DAY AS DATE) AS until FROM wfold, wcal)",
        _walk("_a", "fold, run", "wtrain"),
        "wscore AS MATERIALIZED (SELECT fold, CAST(right(run, 2) AS INT) AS k, sharpe_ratio, sharpe_ratio - 2 * greatest(0, coalesce(participation_proxy_mean, 0) - 0.02::DOUBLE) AS score FROM tm_a WHERE sharpe_ratio IS NOT NULL)",
        "wbest AS MATERIALIZED (SELECT b.fold, b.score, b.sharpe_ratio AS train_sharpe, c.*, f.since, f.until FROM (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY score DESC, k) AS rn FROM wscore) b JOIN wcal c USING (k) JOIN wfold f USING (fold) WHERE rn = 1)",
        """wtest AS MATERIALIZED (SELECT fold || '|' || scenario AS run, * FROM (
 SELECT fold, since, until, 'baseline' AS scenario, 'sentiment' AS variant, 0.7::DOUBLE AS conf, 0.2::DOUBLE AS cutoff, 2 AS hold_days, false AS vix_filter, 15.0::DOUBLE AS cost_bps FROM wbest UNION ALL
 SELECT fold, since, until, 'improved', variant, conf, cutoff, hold_days, vix_filter, 15 FROM wbest UNION ALL
 SELECT fold, since, until, s, v, conf, cutoff, hold_days, r, 15 FROM wbest, (VALUES ('ablation_sentiment', 'sentiment', false), ('ablation_ensemble', 'ensemble', false), ('ablation_ensemble_regime', 'ensemble', true)) x(s, v, r) UNION ALL
 SELECT fold, since, until, s, variant, conf, cutoff, hold_days, vix_filter, b FROM wbest, (VALUES ('cost_0.0bps', 0.0::DOUBLE), ('cost_7.5bps', 7.5::DOUBLE), ('cost_15.0bps', 15.0::DOUBLE), ('cost_30.0bps', 30.0::DOUBLE)) x(s, b)))""",
        _walk("_b", "fold, scenario", "wtest"),
        renamed(trade_metrics_sql("ttf_b", "scenario"), "_c"),
        """wsum AS MATERIALIZED (SELECT t.* EXCLUDE (ic), f.* EXCLUDE (scenario) FROM tm_c t JOIN (SELECT scenario, avg(ic) AS ic, stddev_samp(ic) AS ic_stability, count(DISTINCT fold) AS oos_fold_count,
 avg(CASE WHEN sharpe_ratio > 0 THEN 1.0::DOUBLE WHEN sharpe_ratio IS NOT NULL THEN 0 END) AS pct_positive_oos_folds FROM tm_b GROUP BY 1) f USING (scenario)),
wcost AS MATERIALIZED (SELECT *, CAST(regexp_extract(scenario, 'cost_([0-9.]+)bps', 1) AS DOUBLE) AS cost_bps FROM wsum WHERE scenario LIKE 'cost_%'),
weven AS (SELECT coalesce(max(CASE WHEN sharpe_ratio >= 0 THEN cost_bps END), 0) AS break_even_cost_bps FROM wcost),
wflat AS (SELECT coalesce(avg(sharpe_ratio) FILTER (scenario = 'ablation_ensemble_regime') <= avg(sharpe_ratio) FILTER (scenario = 'ablation_ensemble'), false) AS flat FROM tm_b),
woos AS MATERIALIZED (SELECT * REPLACE (CASE WHEN flat AND scenario = 'improved' THEN 'improved_no_regime_uplift' ELSE scenario END AS scenario) FROM wsum, wflat, weven WHERE scenario IN ('baseline', 'improved'))""",
    ]
)
_WVIEWS = "wscored px panel cal ret vix"


def folds(m: Market):
    return ex.walk_forward(m.weekly, m.panel, m.cal, m.vix)


@query(
    "EX10_calibration_choices",
    "test_period confidence_threshold:d quantile_cutoff:d hold_days:i variant regime_filter:b score:d4",
    _WVIEWS,
    "SELECT fold AS test_period, conf AS confidence_threshold, cutoff AS quantile_cutoff, hold_days, variant, vix_filter AS regime_filter, score FROM wbest",
    _WF,
)
def _(m: Market):
    return folds(m)["choices"]


@query("EX11_expanding_walk_forward", "fold scenario sharpe_ratio:d4 ic:d4 trade_count:i", _WVIEWS, "SELECT * FROM tm_b WHERE scenario IN ('baseline', 'improved')", _WF)
def _(m: Market):
    return folds(m)["periods"]


@query("EX12_cost_robustness", "scenario cost_bps:d sharpe_ratio:d4 break_even_cost_bps:d", _WVIEWS, "SELECT * FROM wcost, weven", _WF)
def _(m: Market):
    return folds(m)["costs"]


@query("AG13_out_of_sample_rollup", "scenario sharpe_ratio:d4 ic:d4 oos_fold_count:i pct_positive_oos_folds:d4 break_even_cost_bps:d", _WVIEWS, "SELECT * FROM woos", _WF)
def _(m: Market):
    return folds(m)["oos"]


@query(
    "EX13_diagnostics_ranked",
    "model scenario sharpe_ratio:d4 trade_count:i break_even_cost_bps:d",
    _WVIEWS,
    "SELECT 'lexicon' AS model, scenario, sharpe_ratio, trade_count, break_even_cost_bps FROM woos UNION ALL SELECT 'lexicon', scenario, sharpe_ratio, trade_count, break_even_cost_bps FROM wcost, weven",
    _WF,
)
def _(m: Market):
    return ex.diagnostics(m.weekly, m.panel, m.cal, m.vix, "lexicon")["ranked"]


@query(
    "BT14_strategy_variants",
    "variant conf:d n:i dates:i signal_sum:d4",
    _WVIEWS,
    "SELECT variant, conf, count(*) AS n, count(DISTINCT date) AS dates, sum(signal) AS signal_sum FROM wsig GROUP BY 1, 2",
    "/*RECURSIVE_MARK*/" + ",\n".join(_WF.replace("/*RECURSIVE_MARK*/", "").split(",\nwfold AS")[:1]),
)
def _(m: Market):
    v = ex.variant_signals(m.weekly, m.panel, m.cal, [0.60, 0.70, 0.75], GATE)
    return v.groupBy("variant", "conf").agg(F.count("*").alias("n"), F.count_distinct("date").alias("dates"), F.sum("signal").alias("signal_sum"))


@query(
    "SO03_leaderboard",
    "rank:i run sharpe_ratio:d4",
    DAILY_VIEWS,
    "SELECT row_number() OVER (ORDER BY sharpe_ratio DESC NULLS LAST, run) AS rank, run, sharpe_ratio FROM rm",
    ls_sql(_FOUR, "capped", gate=DAILY_GATE) + ",\n" + run_metrics_sql(),
)
def _(m: Market):
    from pyspark.sql import Window as W

    board = ex.leaderboard(ex.run_grid(daily_gated(m), m.panel, m.cal, m.vix, _FOUR), "run")
    return board.withColumn("rank", F.row_number().over(W.orderBy(F.desc_nulls_last("sharpe_ratio"), "run")))


