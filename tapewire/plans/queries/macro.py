"""Macro, commodity, transmission and recommendation operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapewire.functions.dates import recency_weight
from tapewire.functions.settle import settle
from tapewire.operators import macro as mc
from tapewire.operators import recommend as rc
from tapewire.operators import transmission as tr
from tapewire.plans.fixtures import Market
from tapewire.plans.queries.text import CARS, LEX_CTES
from tapewire.plans.registry import query
from tapewire.rule_data import REGIMES, RULES, SHOCKS

# Proxy members by brand number: the i-th proxy lists every brand whose number is i modulo 8.
PROXIES = ["XLE", "XLB", "JETS", "XLY", "XLF", "XLK", "XLV", "TLT"]
MEMBERS = {p: [f"Brand#{b}" for b in range(1, 26) if b % len(PROXIES) == i] for i, p in enumerate(PROXIES)}


def dates(m: Market):
    return m.macro.select("date").distinct()


def snapshots(m: Market):
    return mc.macro_snapshots(m.macro, m.vix, dates(m))


def commodity(m: Market):
    return mc.commodity_snapshots(m.commodities, dates(m))


def context(m: Market):
    return tr.context_rows(snapshots(m), commodity(m))


def latest(m: Market):
    return settle(context(m).orderBy(F.desc("date")).limit(1))


def _feat(src: str, back: int) -> str:
    return f"""SELECT series, date, n, value AS latest, CASE WHEN n >= 13 AND y <> 0 THEN (value - y) / abs(y) ELSE 0 END AS yoy, CASE WHEN n >= 2 THEN value - p ELSE 0 END AS mom,
 CASE WHEN n >= 12 AND s <> 0 THEN (value - a) / s ELSE 0 END AS surprise, CASE WHEN n < {back + 1} THEN 0 WHEN value - t > th THEN 1 WHEN value - t < -th THEN -1 ELSE 0 END AS trend FROM (
 SELECT *, row_number() OVER w AS n, lag(value, 12) OVER w AS y, lag(value) OVER w AS p, lag(value, {back}) OVER w AS t, avg(value) OVER w12 AS a, stddev_samp(value) OVER w12 AS s,
 CASE WHEN avg(value) OVER wall <> 0 THEN 0.05 * abs(avg(value) OVER wall) ELSE 1e-6 END AS th
 FROM {src} WINDOW w AS (PARTITION BY series ORDER BY date), w12 AS (PARTITION BY series ORDER BY date ROWS 11 PRECEDING), wall AS (PARTITION BY series ORDER BY date ROWS UNBOUNDED PRECEDING))"""


_S = ["cpi", "unemployment", "payrolls", "gdp", "fed_funds", "yield_10yr", "yield_2yr"]
SNAP = f"""f3 AS MATERIALIZED ({_feat('macro', 3)}),
f2 AS MATERIALIZED ({_feat('macro', 2)}),
md AS MATERIALIZED (SELECT DISTINCT date FROM macro),
filled AS MATERIALIZED (SELECT d.date, d.series, f.* EXCLUDE (date, series), g.trend AS trend2 FROM (SELECT date, unnest({_S}) AS series FROM md) d
 ASOF LEFT JOIN f3 f ON d.series = f.series AND d.date >= f.date ASOF LEFT JOIN f2 g ON d.series = g.series AND d.date >= g.date),
wide AS MATERIALIZED (SELECT date, coalesce(max(yoy) FILTER (series = 'cpi'), 0) AS cpi_yoy, coalesce(max(surprise) FILTER (series = 'cpi'), 0) AS cpi_surprise,
 coalesce(max(latest) FILTER (series = 'unemployment') / 100, 0.04) AS unemployment, coalesce(max(trend) FILTER (series = 'unemployment'), 0) AS unemployment_trend,
 coalesce(max(mom) FILTER (series = 'payrolls'), 0) AS payrolls_chg, coalesce(max(yoy) FILTER (series = 'gdp'), 0) AS gdp_growth, coalesce(max(trend2) FILTER (series = 'gdp'), 0) AS gdp_trend,
 coalesce(max(latest) FILTER (series = 'fed_funds') / 100, 0.05) AS fed_funds, coalesce(max(trend) FILTER (series = 'fed_funds'), 0) AS fed_trend,
 coalesce(max(CASE WHEN latest > 1 THEN latest / 100 ELSE latest END) FILTER (series = 'yield_10yr'), 0.044) AS yield_10yr, coalesce(max(latest) FILTER (series = 'yield_2yr') / 100, 0.049) AS yield_2yr,
 coalesce(avg(surprise) FILTER (series IN ('cpi', 'unemployment', 'payrolls', 'gdp', 'fed_funds') AND n > 3), 0) AS macro_surprise,
 coalesce(sign(sum(trend) FILTER (series IN ('gdp', 'payrolls') AND n > 3)), 0) AS macro_trend FROM filled GROUP BY 1),
snap0 AS MATERIALIZED (SELECT w.*, yield_10yr - yield_2yr AS yield_spread, coalesce(v.level, 20) AS vix FROM wide w ASOF LEFT JOIN (SELECT date AS vd, level FROM vix) v ON w.date >= v.vd),
snap AS MATERIALIZED (SELECT date, round(cpi_yoy, 5) AS cpi_yoy, round(unemployment, 5) AS unemployment, round(payrolls_chg, 1) AS payrolls_chg, round(gdp_growth, 5) AS gdp_growth, round(fed_funds, 5) AS fed_funds,
 round(yield_10yr, 5) AS yield_10yr, round(yield_2yr, 5) AS yield_2yr, round(yield_spread, 5) AS yield_spread, round(vix, 2) AS vix, round(macro_surprise, 4) AS macro_surprise, macro_trend,
 CASE WHEN cpi_yoy > 0.04 AND cpi_surprise > 1.5 THEN 'inflation_shock' WHEN gdp_trend < 0 AND unemployment_trend > 0 THEN 'growth_slowdown' WHEN vix > 28 OR yield_spread < -0.003 THEN 'risk_off'
 WHEN fed_trend > 0 OR (fed_funds > 0.04 AND cpi_yoy > 0.025) THEN 'tightening' WHEN fed_trend < 0 OR fed_funds < 0.01 THEN 'easing'
 WHEN vix < 16 AND gdp_trend >= 0 AND yield_spread > 0.005 THEN 'risk_on' ELSE 'neutral' END AS regime FROM snap0)"""
SNAP_SPEC = "date:t cpi_yoy:d5 unemployment:d5 payrolls_chg:d1 gdp_growth:d5 fed_funds:d5 yield_10yr:d5 yield_2yr:d5 yield_spread:d5 vix:d2 macro_surprise:d4 macro_trend:i regime"


@query("MC01_macro_snapshots", SNAP_SPEC, "macro vix", "SELECT * FROM snap", SNAP)
def _(m: Market):
    return snapshots(m)


@query("MC02_regimes", "regime n:i", "macro vix", "SELECT regime, count(*) AS n FROM snap GROUP BY 1", SNAP)
def _(m: Market):
    return snapshots(m).groupBy("regime").agg(F.count("*").alias("n"))


STATE = """cst AS MATERIALIZED (SELECT series, date, round(price, 4) AS price, round(change_5d, 5) AS change_5d, round(volatility, 5) AS volatility,
 CASE WHEN change_5d < -0.05 THEN 'price_crash' WHEN change_5d > 0.05 AND volatility > 0.4 THEN CASE WHEN series IN ('oil', 'gas') THEN 'supply_shock' ELSE 'demand_shock' END
 WHEN abs(change_5d) > 0.03 AND volatility > 0.3 THEN 'demand_shock' ELSE 'neutral' END AS shock FROM (
 SELECT series, date, price, CASE WHEN n >= 6 AND b <> 0 THEN (price - b) / abs(b) ELSE 0 END AS change_5d, CASE WHEN n >= 21 AND c >= 5 THEN s * sqrt(252) ELSE 0 END AS volatility FROM (
 SELECT series, date, price, n, b, count(r) OVER w AS c, stddev_samp(r) OVER w AS s FROM (
 SELECT *, row_number() OVER o AS n, lag(price, 5) OVER o AS b, price / lag(price) OVER o - 1 AS r FROM commod WINDOW o AS (PARTITION BY series ORDER BY date))
 WINDOW w AS (PARTITION BY series ORDER BY date ROWS 19 PRECEDING))))"""
_C = ["oil", "gas", "copper", "gold"]
COMM = (
    STATE
    + f""",
cfill AS MATERIALIZED (SELECT d.date, d.series, c.price, c.change_5d, c.volatility, c.shock FROM (SELECT date, unnest({_C}) AS series FROM (SELECT DISTINCT date FROM macro)) d ASOF LEFT JOIN cst c ON d.series = c.series AND d.date >= c.date),
csnap0 AS MATERIALIZED (SELECT date, """
    + ", ".join(
        f"coalesce(max(price) FILTER (series = '{n}'), 0) AS {n}_price, coalesce(max(change_5d) FILTER (series = '{n}'), 0) AS {n}_change_5d, coalesce(max(volatility) FILTER (series = '{n}'), 0) AS {n}_volatility, coalesce(max(shock) FILTER (series = '{n}'), 'neutral') AS {n}_shock"
        for n in _C
    )
    + """ FROM cfill GROUP BY 1),
csnap AS MATERIALIZED (SELECT *, round(0.6 * ("""
    + " + ".join(f"CASE WHEN {n}_shock <> 'neutral' THEN 1 ELSE 0 END" for n in _C)
    + """) / 4.0 + 0.4 * least(1, (oil_volatility + gas_volatility) / 2), 4) AS commodity_stress FROM csnap0)"""
)
COMM_SPEC = "date:t " + " ".join(f"{n}_price:d4 {n}_change_5d:d5 {n}_volatility:d5 {n}_shock" for n in _C) + " commodity_stress:d4"


@query("MC03_commodity_snapshots", COMM_SPEC, "commod macro", "SELECT * FROM csnap", COMM)
def _(m: Market):
    return commodity(m)


@query("MC04_commodity_shocks", "series date:t price:d4 change_5d:d5 volatility:d5 shock", "commod", "SELECT * FROM cst", STATE)
def _(m: Market):
    return mc.commodity_states(m.commodities)


@query("MC05_commodity_stress", "date:t commodity_stress:d4", "commod macro", "SELECT date, commodity_stress FROM csnap", COMM)
def _(m: Market):
    return commodity(m)


_RULES = ", ".join(
    f"('{k}', '{d}', '{s}', {i}, {risk}, {pos}, {neg or '[]::VARCHAR[]'}, '{first.replace('_', ' ').title()} — {trig.split('(')[0].strip()}', '{second.replace('_', ' ').replace('-', ' ')}')"
    for i, (k, d, s, trig, first, second, pos, neg, risk) in enumerate(RULES)
)
_PROXY = ", ".join(f"('{t}', '{p}')" for p, names in MEMBERS.items() for t in names)
EVENTS = (
    SNAP
    + ",\n"
    + COMM
    + f""",
rules AS (SELECT * FROM (VALUES {_RULES}) v(rule, driver, state, ord, risk_level, positive, negative, flag, second_order)),
states AS MATERIALIZED (SELECT date, 'regime' AS driver, regime AS state FROM snap UNION ALL """
    + " UNION ALL ".join(f"SELECT date, '{n}', {n}_shock FROM csnap" for n in _C)
    + f"""),
ev AS MATERIALIZED (SELECT date, row_number() OVER (PARTITION BY date ORDER BY risk_level DESC, ord) AS rank, rule, risk_level, positive, negative, flag, second_order FROM states JOIN rules USING (driver, state)),
secs AS MATERIALIZED (SELECT ticker, list(p) || [upper(ticker)] AS sectors FROM (VALUES {_PROXY}) v(ticker, p) GROUP BY ticker),
expo AS MATERIALIZED (SELECT d.date, s.ticker, round(CASE WHEN pos + neg > 0 THEN (pos - neg) / (pos + neg) ELSE 0 END, 4) AS net_exposure, round(pos, 4) AS positive_exposure, round(neg, 4) AS negative_exposure, rules AS active_rules FROM (
 SELECT d.date, s.ticker, coalesce(sum((risk_level + 1) / 4.0::DOUBLE) FILTER (list_has_any(sectors, positive)), 0) AS pos, coalesce(sum((risk_level + 1) / 4.0::DOUBLE) FILTER (list_has_any(sectors, negative)), 0) AS neg,
 coalesce(list(rule ORDER BY rank) FILTER (list_has_any(sectors, positive) OR list_has_any(sectors, negative)), []) AS rules
 FROM (SELECT DISTINCT date FROM macro) d CROSS JOIN secs s LEFT JOIN ev ON ev.date = d.date GROUP BY 1, 2) s JOIN (SELECT DISTINCT date FROM macro) d USING (date)),
flags AS MATERIALIZED (SELECT date, ticker, list(txt ORDER BY part, rank)[1:5] AS risk_flags FROM (
 SELECT ev.date, s.ticker, 1 AS part, rank, flag AS txt FROM ev JOIN secs s ON list_has_any(sectors, negative) WHERE risk_level >= 1 UNION ALL
 SELECT ev.date, s.ticker, 2, rank, second_order FROM ev CROSS JOIN secs s WHERE risk_level >= 2) GROUP BY 1, 2)"""
)


@query("MC06_transmission_events", "date:t rank:i rule risk_level:i positive:a negative:a", "macro vix commod", "SELECT * FROM ev", EVENTS)
def _(m: Market):
    return tr.event_table(context(m))


def exposures(m: Market):
    tickers = F.array(*[F.lit(f"Brand#{b}") for b in range(1, 26)])
    rows = context(m).withColumn("ticker", F.explode(tickers))
    return rows.withColumn("sectors", tr.ticker_sectors(F.col("ticker"), MEMBERS))


@query(
    "MC07_sector_exposure",
    "date:t ticker net_exposure:d4 positive_exposure:d4 negative_exposure:d4 active_rules:a",
    "macro vix commod",
    "SELECT * FROM expo",
    EVENTS,
)
def _(m: Market):
    rows = exposures(m)
    return rows.select("date", "ticker", tr.exposure(F.col("sectors"), F.col("events")).alias("x")).select("date", "ticker", "x.*")


@query(
    "MC08_risk_flags",
    "date:t ticker risk_flags:a",
    "macro vix commod",
    "SELECT date, ticker, risk_flags FROM flags",
    EVENTS,
)
def _(m: Market):
    rows = exposures(m)
    return rows.select("date", "ticker", tr.risk_flags(F.col("sectors"), F.col("events")).alias("risk_flags")).where(F.size("risk_flags") > 0)


@query(
    "JN12_proxy_membership",
    "date:t ticker rule side",
    "macro vix commod",
    """SELECT DISTINCT date, ticker, rule, 'positive' AS side FROM ev JOIN secs ON list_has_any(sectors, positive) UNION ALL
 SELECT DISTINCT date, ticker, rule, 'negative' AS side FROM ev JOIN secs ON list_has_any(sectors, negative)""",
    EVENTS,
)
def _(m: Market):
    rows = exposures(m).select("date", "ticker", "sectors", F.explode("events").alias("e"))
    sides = F.array(*[F.when(F.arrays_overlap("sectors", F.col(f"e.{s}")), F.lit(s)) for s in ("positive", "negative")])
    return rows.select("date", "ticker", F.col("e.rule").alias("rule"), F.explode(F.array_compact(sides)).alias("side"))


def _adjust_sql(score: str) -> str:
    bias = "CASE regime WHEN 'risk_on' THEN 0.08 WHEN 'easing' THEN 0.06 WHEN 'risk_off' THEN -0.12 WHEN 'tightening' THEN -0.06 WHEN 'inflation_shock' THEN -0.08 WHEN 'growth_slowdown' THEN -0.10 ELSE 0 END::DOUBLE"
    first = f"({bias} + CASE WHEN abs(net_exposure) > 0.2 THEN net_exposure * 0.1 ELSE 0 END)"
    damp = f"CASE WHEN vix > 28 THEN ({score} + {first}) * 0.85::DOUBLE - {score} ELSE {first} END"
    total = f"greatest(-0.25, least(0.25, {damp} + CASE WHEN commodity_stress > 0.5 THEN -0.04 * commodity_stress ELSE 0 END))"
    return f"round(greatest(-1, least(1, {score} + {total})), 6)"


@query(
    "MC09_context_adjustment",
    "date:t ticker adjusted:d n_reasons:i",
    "macro vix commod",
    f"""SELECT date, ticker, {_adjust_sql('0.5::DOUBLE')} AS adjusted, CASE WHEN regime <> 'neutral' THEN 1 ELSE 0 END + CASE WHEN abs(net_exposure) > 0.2 THEN 1 ELSE 0 END + CASE WHEN vix > 28 THEN 1 ELSE 0 END
 + CASE WHEN commodity_stress > 0.5 THEN 1 ELSE 0 END AS n_reasons FROM expo JOIN snap USING (date) JOIN csnap USING (date)""",
    EVENTS,
)
def _(m: Market):
    rows = exposures(m).withColumn("net", tr.exposure(F.col("sectors"), F.col("events"))["net_exposure"])
    adjusted, reasons = tr.context_adjustment(F.lit(0.5), F.col("net"), F.col("regime"), F.col("vix"), F.col("commodity_stress"))
    return rows.select("date", "ticker", adjusted.alias("adjusted"), F.size(reasons).alias("n_reasons"))


@query(
    "SF10_one_hot_regime",
    "date:t " + " ".join(f"macro_regime_{r}:d" for r in REGIMES),
    "macro vix",
    "SELECT date, " + ", ".join(f"CASE WHEN regime = '{r}' THEN 1.0 ELSE 0.0 END AS macro_regime_{r}" for r in REGIMES) + " FROM snap",
    SNAP,
)
def _(m: Market):
    return mc.macro_features(snapshots(m))


@query(
    "SF10_one_hot_shocks",
    "date:t commodity_stress:d4 " + " ".join(f"commodity_{n}_shock_{s}:d" for n in _C for s in SHOCKS),
    "commod macro",
    "SELECT date, commodity_stress, " + ", ".join(f"CASE WHEN {n}_shock = '{s}' THEN 1.0 ELSE 0.0 END AS commodity_{n}_shock_{s}" for n in _C for s in SHOCKS) + " FROM csnap",
    COMM,
)
def _(m: Market):
    return mc.commodity_features(commodity(m))


@query(
    "SF10_chain_features",
    "date:t chain_active_count:d chain_max_risk_level:d chain_avg_risk_level:d " + " ".join(f"chain_{r[0]}:d" for r in RULES),
    "macro vix commod",
    "SELECT d.date, count(rule)::DOUBLE AS chain_active_count, coalesce(max(risk_level), 0)::DOUBLE AS chain_max_risk_level, coalesce(avg(risk_level), 0) AS chain_avg_risk_level, "
    + ", ".join(f"coalesce(max(CASE WHEN rule = '{r[0]}' THEN 1.0 ELSE 0.0 END), 0) AS chain_{r[0]}" for r in RULES)
    + " FROM (SELECT DISTINCT date FROM macro) d LEFT JOIN ev USING (date) GROUP BY 1",
    EVENTS,
)
def _(m: Market):
    return tr.chain_features(context(m))


@query(
    "SF11_recency_decay",
    "headline_id:i w:d",
    "news",
    "SELECT headline_id, exp(-0.3 * greatest(0, date_diff('day', date, DATE '2001-08-02'))) AS w FROM news",
)
def _(m: Market):
    return m.news.select("headline_id", recency_weight(m.now, "date", 0.3).alias("w"))


# ---- recommendations --------------------------------------------------------

_KWCASE = ", ".join(f"CASE WHEN contains(lower(s.headline), '{k}') THEN {abs(v)}::DOUBLE ELSE 0 END" for k, v in CARS.items())
SCORE = (
    LEX_CTES
    + f""",
wrow AS MATERIALIZED (SELECT s.*, l.normalised_score, CASE source WHEN 'sec_edgar' THEN 1.0 WHEN 'reuters' THEN 0.9 WHEN 'guardian' THEN 0.8 WHEN 'newsapi' THEN 0.6 WHEN 'reddit' THEN 0.3 ELSE 0.5 END::DOUBLE AS source_w,
 least(2, 1 + 10 * greatest({_KWCASE})) AS keyword_w, exp(-0.3::DOUBLE * greatest(0, date_diff('day', s.date, DATE '2001-08-02'))) AS recency_w,
 CASE WHEN normalised_score * signal > 0 THEN 1 + 0.5 * abs(normalised_score) WHEN normalised_score * signal < 0 THEN greatest(0.3, 1 - 0.7 * abs(normalised_score)) ELSE 1 END AS lexicon_w
 FROM scored s JOIN lexnews l USING (headline_id)),
tsc AS MATERIALIZED (SELECT ticker, count(*) AS headline_count, count(*) FILTER (confidence >= 0.7) AS confident_headline_count, avg(confidence) FILTER (confidence >= 0.7) AS confidence, avg(source_w) FILTER (confidence >= 0.7) AS source_quality,
 round(coalesce(sum(signal * source_w * keyword_w * recency_w * lexicon_w * confidence) FILTER (confidence >= 0.7 AND signal <> 0) / nullif(sum(source_w * keyword_w * recency_w * lexicon_w) FILTER (confidence >= 0.7 AND signal <> 0), 0), 0), 6) AS signal_score,
 round(avg(normalised_score), 4) AS lexicon_score FROM wrow GROUP BY 1)"""
)


@query(
    "RC01_composite_score",
    "ticker headline_count:i n_sure:i signal_score:d source_quality:d",
    "scored",
    "SELECT ticker, headline_count, confident_headline_count AS n_sure, signal_score, source_quality FROM tsc",
    SCORE,
)
def _(m: Market):
    return rc.ticker_scores(rc.score_cube(rc.weighted_rows(m.scored, CARS, m.now)))


def results(m: Market, strict: bool = False, quality: float = 0.0):
    universe = m.px.select("ticker").distinct()
    return rc.recommend(m.scored, universe, latest(m), CARS, m.now, MEMBERS, quality, strict)


REC_CTES = (
    SCORE.replace("/*RECURSIVE_MARK*/", "/*RECURSIVE_MARK*/")
    + ",\n"
    + EVENTS
    + f""",
adj AS MATERIALIZED (SELECT t.*, regime AS macro_regime, {_adjust_sql('signal_score')} AS adjusted_signal_score FROM tsc t JOIN (SELECT * FROM expo WHERE date = (SELECT max(date) FROM macro)) e USING (ticker)
 JOIN (SELECT * FROM snap WHERE date = (SELECT max(date) FROM macro)) s ON true JOIN (SELECT date AS cdate, commodity_stress FROM csnap WHERE date = (SELECT max(date) FROM macro)) c ON true),
vw AS MATERIALIZED (SELECT *, CASE WHEN signal_score > 0.6 THEN 'BUY' WHEN signal_score < -0.6 THEN 'SELL' ELSE 'HOLD' END AS tactical_signal,
 CASE WHEN macro_regime IN ('risk_on', 'easing') AND adjusted_signal_score > 0.1 THEN 'POSITIVE' WHEN macro_regime IN ('risk_off', 'growth_slowdown', 'tightening', 'inflation_shock') OR adjusted_signal_score < -0.1 THEN 'NEGATIVE' ELSE 'NEUTRAL' END AS investment_view,
 CASE WHEN CASE WHEN adjusted_signal_score <> 0 THEN adjusted_signal_score ELSE signal_score END > 0.6 THEN 'BUY' WHEN CASE WHEN adjusted_signal_score <> 0 THEN adjusted_signal_score ELSE signal_score END < -0.6 THEN 'SELL' ELSE 'HOLD' END AS recommendation FROM adj),
cv AS MATERIALIZED (SELECT *, CASE WHEN confident_headline_count >= 3 THEN 1 ELSE 0 END + CASE WHEN abs(signal_score) >= 0.55 THEN 1 ELSE 0 END + CASE WHEN source_quality >= 0.65 THEN 1 ELSE 0 END
 + CASE WHEN lexicon_score * signal_score > 0 AND abs(lexicon_score) > 0.15 THEN 1 ELSE 0 END
 + CASE WHEN (investment_view = 'POSITIVE' AND tactical_signal = 'BUY') OR (investment_view = 'NEGATIVE' AND tactical_signal = 'SELL') THEN 1 ELSE 0 END AS conviction_points FROM vw),
rec AS MATERIALIZED (SELECT *, CASE WHEN conviction_points >= 4 THEN 'HIGH' WHEN conviction_points >= 2 THEN 'MEDIUM' ELSE 'LOW' END AS conviction_level FROM cv)"""
)
REC_VIEWS = "scored macro vix commod px"
REC_SPEC = "ticker recommendation confidence:d4 signal_score:d4 headline_count:i confident_headline_count:i lexicon_score:d4 macro_regime adjusted_signal_score:d4 tactical_signal investment_view conviction_level conviction_points:i"
_REC_SELECT = "SELECT ticker, recommendation, round(confidence, 4) AS confidence, round(signal_score, 4) AS signal_score, headline_count, confident_headline_count, lexicon_score, macro_regime, round(adjusted_signal_score, 4) AS adjusted_signal_score, tactical_signal, investment_view, conviction_level, conviction_points FROM rec"


@query("RC02_recommendations", REC_SPEC, REC_VIEWS, _REC_SELECT, REC_CTES)
def _(m: Market):
    return results(m)


@query("RC03_conviction", "ticker conviction_points:i conviction_level", REC_VIEWS, "SELECT * FROM rec", REC_CTES)
def _(m: Market):
    return results(m)


@query(
    "RC04_strict_gates",
    "ticker recommendation n_flags:i",
    REC_VIEWS,
    """SELECT ticker, 'HOLD' AS recommendation, coalesce(len(risk_flags), 0) + CASE WHEN recommendation <> 'HOLD' THEN 1 ELSE 0 END AS n_flags
 FROM rec LEFT JOIN (SELECT ticker, risk_flags FROM flags WHERE date = (SELECT max(date) FROM macro)) f USING (ticker)""",
    REC_CTES,
)
def _(m: Market):
    return results(m, strict=True, quality=4.0).withColumn("n_flags", F.size("risk_flags"))


@query("RC05_reasoning", "ticker reasoning", "", None)
def _(m: Market):
    return results(m)


@query(
    "RC06_universe_scan",
    "rank:i ticker recommendation",
    REC_VIEWS,
    """SELECT row_number() OVER (ORDER BY CASE recommendation WHEN 'BUY' THEN 0 WHEN 'SELL' THEN 2 ELSE 1 END, CASE WHEN recommendation = 'SELL' THEN s ELSE -s END, ticker) AS rank, ticker, recommendation
 FROM (SELECT *, round(signal_score, 4) AS s FROM rec)""",
    REC_CTES,
)
def _(m: Market):
    from pyspark.sql import Window as W

    ordered = rc.scan_order(results(m))
    rank = F.when(F.col("recommendation") == "BUY", 0).when(F.col("recommendation") == "SELL", 2).otherwise(1)
    key = F.when(F.col("recommendation") == "SELL", F.col("signal_score")).otherwise(-F.col("signal_score"))
    return ordered.withColumn("rank", F.row_number().over(W.orderBy(rank, key, "ticker")))


BOOK = """book AS MATERIALIZED (SELECT ticker, a AS adjusted_signal_score, round(w / sum(w) OVER (), 4) AS position_weight FROM (SELECT *, least(0.2::DOUBLE, greatest(0, a) / sum(greatest(0, a)) OVER ()) AS w FROM (
 SELECT *, round(adjusted_signal_score, 4) AS a FROM rec WHERE signal_score > 0.3 AND conviction_level IN ('HIGH', 'MEDIUM') ORDER BY a DESC, ticker LIMIT 10)))"""


def book(m: Market):
    # A lower entry bar than BUY, so the book is not empty on this data.
    rows = results(m).withColumn("recommendation", F.when(F.col("signal_score") > 0.3, "BUY").otherwise("HOLD"))
    return rc.ranked_book(rows)


@query("RC07_ranked_book", "ticker adjusted_signal_score:d4 position_weight:d4", REC_VIEWS, "SELECT * FROM book", REC_CTES + ",\n" + BOOK)
def _(m: Market):
    return book(m)


@query("RC08_compare", REC_SPEC, REC_VIEWS, _REC_SELECT + " WHERE ticker IN ('Brand#3', 'Brand#7')", REC_CTES)
def _(m: Market):
    return rc.compare(results(m), ["brand#3", "BRAND#7"])


@query(
    "SO06_top_longs",
    "ticker adjusted_signal_score:d4",
    REC_VIEWS,
    "SELECT ticker, round(adjusted_signal_score, 4) AS adjusted_signal_score FROM rec ORDER BY 2 DESC, 1 LIMIT 5",
    REC_CTES,
)
def _(m: Market):
    return results(m).orderBy(F.desc("adjusted_signal_score"), "ticker").limit(5)


@query("RP12_summary_table", "ticker recommendation signal_score:d4 top_positive_keywords drivers risk_flags generated_at", "", None)
def _(m: Market):
    return rc.summary_table(results(m))


@query(
    "WN21_recommendation_changes",
    "ticker month:t previous recommendation",
    "scored",
    """SELECT ticker, month, previous, recommendation FROM (SELECT *, lag(recommendation) OVER (PARTITION BY ticker ORDER BY month) AS previous FROM (
 SELECT ticker, CAST(date_trunc('month', date) AS DATE) AS month, CASE WHEN avg(signal) > 0.1 THEN 'BUY' WHEN avg(signal) < -0.1 THEN 'SELL' ELSE 'HOLD' END AS recommendation FROM scored GROUP BY 1, 2))
 WHERE previous IS NOT NULL AND previous <> recommendation""",
)
def _(m: Market):
    month = F.to_date(F.date_trunc("month", "date"))
    s = m.scored.groupBy("ticker", month.alias("ts")).agg(F.avg("signal").alias("s"))
    s = s.withColumn("recommendation", F.when(F.col("s") > 0.1, "BUY").when(F.col("s") < -0.1, "SELL").otherwise("HOLD"))
    return rc.recommendation_changes(s).withColumn("month", F.col("ts"))
