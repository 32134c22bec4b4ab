"""Signal validation statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapewire.functions.dates import period_label
from tapewire.functions.stats import t_two_sided_p
from tapewire.operators import ranks as rk
from tapewire.operators import signals as sg
from tapewire.operators import validation as va
from tapewire.plans.fixtures import Market
from tapewire.plans.oracle_stats import spearman_sql, t_p_sql
from tapewire.plans.registry import query

LAGS = [1, 2, 3, 5, 10]


def counts(m: Market):
    return va.signal_return_counts(m.scored, m.panel, m.cal, LAGS)


def rows(m: Market):
    return va.signal_return_table(m.scored, m.panel, m.cal, LAGS)


def daily(m: Market):
    return va.attach_forward(sg.aggregate_signals(m.scored), m.panel, m.cal, [1, 2])


_DAILY = """dsig AS MATERIALIZED (SELECT d.date, d.ticker, d.signal, f.return_lag_1, f.return_lag_2 FROM (SELECT s.*, c.pos FROM capped s ASOF JOIN (SELECT date AS cd, pos FROM cal) c ON s.date <= c.cd) d JOIN fwd f USING (ticker, pos))"""


@query(
    "STA01_hit_rate",
    "lag:i overall:d4 buy:d4 sell:d4 n_buy:i n_sell:i n_total:i",
    "srrow",
    """SELECT lag, round(CASE WHEN nb + ns > 0 THEN (hb + hs) / (nb + ns) ELSE 0 END, 4) AS overall, round(CASE WHEN nb > 0 THEN hb / nb ELSE 0 END, 4) AS buy,
 round(CASE WHEN ns > 0 THEN hs / ns ELSE 0 END, 4) AS sell, nb AS n_buy, ns AS n_sell, nb + ns AS n_total FROM (
 SELECT lag, count(*) FILTER (signal > 0.6) AS nb, count(*) FILTER (signal < -0.6) AS ns, count(*) FILTER (signal > 0.6 AND ret > 0) AS hb,
 count(*) FILTER (signal < -0.6 AND ret < 0) AS hs FROM lr GROUP BY lag)""",
    "lr AS (" + " UNION ALL ".join(f"SELECT {k} AS lag, signal, return_lag_{k} AS ret FROM srrow WHERE return_lag_{k} IS NOT NULL" for k in LAGS) + ")",
)
def _(m: Market):
    return va.hit_rate(va.by_lag(counts(m), LAGS, ["signal", "n"]), ["lag"], "ret", n="n")


@query(
    "STA02_information_coefficient",
    "ic:d4 p_value:d4 n:i t_stat:d4",
    "srrow",
    f"SELECT round(ic, 4) AS ic, round({t_p_sql('t', '(n - 2)')}, 4) AS p_value, n, round(t, 4) AS t_stat FROM (SELECT *, ic * sqrt((n - 2) / (1 - ic * ic)) AS t FROM s)",
    "s AS (" + spearman_sql("srrow", "", "signal", "return_lag_1") + ")",
)
def _(m: Market):
    return va.information_coefficient(counts(m), [], "return_lag_1", n="n")


@query(
    "STA03_ic_decay",
    "lag:i ic:d4 p_value:d4 n:i",
    "srrow",
    f"SELECT lag, round(ic, 4) AS ic, round({t_p_sql('t', '(n - 2)')}, 4) AS p_value, n FROM (SELECT *, ic * sqrt((n - 2) / (1 - ic * ic)) AS t FROM s)",
    "lr AS (" + " UNION ALL ".join(f"SELECT {k} AS lag, signal, return_lag_{k} AS ret FROM srrow" for k in LAGS) + "),\ns AS (" + spearman_sql("lr", "lag", "signal", "ret") + ")",
)
def _(m: Market):
    return va.ic_decay(counts(m), LAGS, n="n")


@query(
    "STA04_ic_by_ticker",
    "ticker ic:d4 n:i",
    "srrow",
    "SELECT ticker, round(ic, 4) AS ic, n FROM s",
    "s AS (" + spearman_sql("srrow", "ticker", "signal", "return_lag_1", 5) + ")",
)
def _(m: Market):
    return va.ic_by_ticker(counts(m), "return_lag_1", n="n")


@query(
    "STA06_ic_by_period",
    "period ic:d4 n:i",
    "capped cal fwd",
    "SELECT period, CASE WHEN n >= 5 THEN round(ic, 4) END AS ic, n FROM s",
    _DAILY + ",\npr AS (SELECT year(date) || '-Q' || quarter(date) AS period, signal, return_lag_2 FROM dsig),\ns AS (" + spearman_sql("pr", "period", "signal", "return_lag_2") + ")",
)
def _(m: Market):
    return va.ic_by_period(daily(m), "return_lag_2", "quarter")


@query(
    "STA07_daily_ic",
    "date:t n:i ic:d",
    "capped cal fwd",
    "SELECT date, n, ic FROM s WHERE n >= 5 AND ic IS NOT NULL",
    _DAILY + ",\ns AS (" + spearman_sql("dsig", "date", "signal", "return_lag_1") + ")",
)
def _(m: Market):
    return va.daily_ic(daily(m), "return_lag_1")


@query(
    "STA08_ic_information_ratio",
    "mean_ic:d std_ic:d n_ic:i icir:d t_stat:d",
    "capped cal fwd",
    """SELECT avg(ic) AS mean_ic, stddev_samp(ic) AS std_ic, count(*) AS n_ic, avg(ic) / stddev_samp(ic) AS icir, avg(ic) / (stddev_samp(ic) / sqrt(count(*))) AS t_stat
 FROM s WHERE n >= 5 AND ic IS NOT NULL""",
    _DAILY + ",\ns AS (" + spearman_sql("dsig", "date", "signal", "return_lag_1") + ")",
)
def _(m: Market):
    return va.ic_summary(va.daily_ic(daily(m), "return_lag_1"))


_QUANT = """v AS (SELECT * FROM dsig WHERE return_lag_1 IS NOT NULL),
e AS (SELECT quantile_cont(signal, [0, 0.2, 0.4, 0.6, 0.8, 1]) AS edges FROM v),
q AS (SELECT quantile, avg(signal) AS mean_signal, avg(return_lag_1) AS mean_return, count(*) AS count FROM (
 SELECT v.*, greatest(1, len(list_filter(list_distinct(edges), lambda x: x < v.signal))) AS quantile FROM v, e) GROUP BY 1)"""


@query("STA09_quantile_returns", "quantile:i mean_signal:d mean_return:d count:i", "capped cal fwd", "SELECT * FROM q", _DAILY + ",\n" + _QUANT)
def _(m: Market):
    return va.quantile_returns(daily(m), "return_lag_1")


@query(
    "STA09_quantile_spread",
    "bins:i spread:d",
    "capped cal fwd",
    "SELECT count(*) AS bins, arg_max(mean_return, quantile) - arg_min(mean_return, quantile) AS spread FROM q",
    _DAILY + ",\n" + _QUANT,
)
def _(m: Market):
    return va.quantile_spread(va.quantile_returns(daily(m), "return_lag_1"))


@query(
    "STA09_binary_signal_bins",
    "quantile:i mean_signal:d mean_return:d count:i",
    "srrow",
    """SELECT quantile, avg(signal) AS mean_signal, avg(return_lag_1) AS mean_return, count(*) AS count FROM (
 SELECT s.*, greatest(1, len(list_filter(list_distinct(edges), lambda x: x < s.signal))) AS quantile FROM srrow s, e) GROUP BY 1""",
    "e AS (SELECT quantile_cont(signal, [0, 0.2, 0.4, 0.6, 0.8, 1]) AS edges FROM srrow)",
)
def _(m: Market):
    return va.quantile_returns(counts(m), "return_lag_1", n="n")


@query(
    "STA10_conditional_ttest",
    "side mean_return:d6 t_stat:d4 p_value:d4 significant:b n:i",
    "srrow",
    f"""SELECT side, round(mean, 6) AS mean_return, round(t, 4) AS t_stat, round(p, 4) AS p_value,
 p < 0.05 AND CASE WHEN side = 'buy' THEN mean > 0 ELSE mean < 0 END AS significant, n FROM (SELECT *, {t_p_sql('t', '(n - 1)')} AS p FROM (
 SELECT CASE WHEN signal > 0 THEN 'buy' ELSE 'sell' END AS side, avg(return_lag_1) AS mean, avg(return_lag_1) / (stddev_samp(return_lag_1) / sqrt(count(*))) AS t, count(*) AS n FROM srrow GROUP BY 1))""",
)
def _(m: Market):
    return va.conditional_ttest(counts(m), "return_lag_1", n="n")


@query(
    "STA11_welch_test",
    "n_first:i n_rest:i t_stat:d4 dof:d4 p_value:d4",
    "srrow",
    f"""SELECT n1 AS n_first, n2 AS n_rest, round(t, 4) AS t_stat, dof, round({t_p_sql('t', 'dof')}, 4) AS p_value FROM (
 SELECT *, (m1 - m2) / sqrt(v1 + v2) AS t, (v1 + v2) * (v1 + v2) / (v1 * v1 / (n1 - 1) + v2 * v2 / (n2 - 1)) AS dof FROM (
 SELECT count(*) FILTER (source = 'sec_edgar') AS n1, count(*) FILTER (source <> 'sec_edgar') AS n2, avg(return_lag_1) FILTER (source = 'sec_edgar') AS m1,
 avg(return_lag_1) FILTER (source <> 'sec_edgar') AS m2, var_samp(return_lag_1) FILTER (source = 'sec_edgar') / count(*) FILTER (source = 'sec_edgar') AS v1,
 var_samp(return_lag_1) FILTER (source <> 'sec_edgar') / count(*) FILTER (source <> 'sec_edgar') AS v2 FROM srrow))""",
)
def _(m: Market):
    return va.welch_test(rows(m), "return_lag_1", F.col("source") == "sec_edgar")


@query(
    "STA12_student_t_tail",
    "l_quantity:d l_linenumber:i p:d6",
    "",
    f"SELECT l_quantity, l_linenumber, {t_p_sql('(l_quantity / 10)', '(l_linenumber * 3)')} AS p FROM (SELECT DISTINCT l_quantity, l_linenumber FROM lineitem)",
)
def _(m: Market):
    grid = m.table("lineitem").select("l_quantity", "l_linenumber").distinct()
    return grid.withColumn("p", t_two_sided_p(F.col("l_quantity") / 10, F.col("l_linenumber") * 3))


@query(
    "STA13_calibration",
    "conf_bin:i mean_confidence:d hit_rate:d count:i",
    "srrow",
    """SELECT conf_bin, avg(confidence) AS mean_confidence, avg(CASE WHEN (signal > 0.6 AND return_lag_1 > 0) OR (signal < -0.6 AND return_lag_1 < 0) THEN 1 ELSE 0 END) AS hit_rate, count(*) AS count FROM (
 SELECT s.*, greatest(1, len(list_filter(list_distinct(edges), lambda x: x < s.confidence))) AS conf_bin FROM srrow s, e) GROUP BY 1""",
    "e AS (SELECT quantile_cont(confidence, [0, 0.2, 0.4, 0.6, 0.8, 1]) AS edges FROM srrow)",
)
def _(m: Market):
    return va.calibration(rows(m), "return_lag_1")


@query(
    "STA14_linear_fit",
    "slope:d intercept:d r_squared:d p_value:d4 n:i",
    "srrow",
    f"""SELECT slope, intercept, r * r AS r_squared, {t_p_sql('t', '(n - 2)')} AS p_value, n FROM (SELECT *, r * sqrt((n - 2) / (1 - r * r)) AS t FROM (
 SELECT regr_slope(return_lag_1, signal) AS slope, regr_intercept(return_lag_1, signal) AS intercept, corr(return_lag_1, signal) AS r, count(*) AS n FROM srrow))""",
)
def _(m: Market):
    return va.linear_fit(counts(m), "signal", "return_lag_1", "n")


@query(
    "STA19_validation_verdict",
    "n_green:i verdict",
    "srrow",
    f"""SELECT n_green, CASE WHEN n_green >= 2 THEN 'predictive' WHEN n_green = 1 THEN 'weak' ELSE 'none' END AS verdict FROM (
 SELECT (SELECT CASE WHEN round(avg(CASE WHEN (signal > 0) = (return_lag_1 > 0) AND return_lag_1 <> 0 THEN 1 ELSE 0 END), 4) >= 0.55 THEN 1 ELSE 0 END FROM srrow)
 + (SELECT CASE WHEN round(ic, 4) > 0.02 THEN 1 ELSE 0 END FROM s)
 + (SELECT CASE WHEN mean > 0 AND {t_p_sql('t', '(n - 1)')} < 0.05 THEN 1 ELSE 0 END FROM b) AS n_green)""",
    "s AS (" + spearman_sql("srrow", "", "signal", "return_lag_1") + "),\n"
    "b AS (SELECT avg(return_lag_1) AS mean, avg(return_lag_1) / (stddev_samp(return_lag_1) / sqrt(count(*))) AS t, count(*) AS n FROM srrow WHERE signal > 0)",
)
def _(m: Market):
    c = counts(m)
    return va.validation_verdict(va.hit_rate(c, [], "return_lag_1", n="n"), va.ic_decay(c, [1], "n"), va.conditional_ttest(c, "return_lag_1", "n"))


@query(
    "WN13_spearman_unbounded_vs_window",
    "period ic_cells:d ic_window:d n:i",
    "srrow",
    "SELECT period, ic AS ic_cells, ic AS ic_window, n FROM s",
    "pr AS (SELECT CAST(year(date) AS VARCHAR) AS period, confidence, return_lag_2 FROM srrow),\ns AS (" + spearman_sql("pr", "period", "confidence", "return_lag_2") + ")",
)
def _(m: Market):
    r = rows(m).withColumn("period", period_label("date", "year"))
    a = rk.spearman(r, ["period"], "confidence", "return_lag_2").select("period", "n", F.col("ic").alias("ic_cells"))
    b = rk.spearman(r, ["period"], "confidence", "return_lag_2", bounded=True).select("period", F.col("ic").alias("ic_window"))
    return a.join(b, "period")
