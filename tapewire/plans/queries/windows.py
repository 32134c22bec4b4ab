"""Calendar, projections, aggregates and window operators."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tapewire import config
from tapewire.functions import dates as dt
from tapewire.functions import labels as lb
from tapewire.operators import calendar as cal
from tapewire.operators import panel as pn
from tapewire.operators import ranks as rk
from tapewire.operators import series as sr
from tapewire.operators import sets as st
from tapewire.operators import signals as sg
from tapewire.operators import validation as va
from tapewire.plans.fixtures import Market
from tapewire.plans.registry import query

# ---- projections and filters ------------------------------------------------


@query(
    "PRJ01_drop_blank_news",
    "headline_id:i date:t headline",
    "news",
    "SELECT headline_id, date, headline FROM n2 WHERE headline IS NOT NULL AND date IS NOT NULL AND trim(headline) <> ''",
    "n2 AS (SELECT headline_id, date, CASE source WHEN 'reddit' THEN NULL WHEN 'newsapi' THEN '   ' ELSE headline END AS headline FROM news)",
)
def _(m: Market):
    hole = F.when(F.col("source") == "reddit", None).when(F.col("source") == "newsapi", "   ").otherwise(F.col("headline"))
    return st.drop_blank(m.news.withColumn("headline", hole))


@query("PRJ02_confident_or_all", "headline_id:i confidence:d", "scored", "SELECT headline_id, confidence FROM scored WHERE confidence >= 0.7")
def _(m: Market):
    return sg.confident_or_all(m.scored)


@query("PRJ02_fallback_to_all", "headline_id:i confidence:d", "scored", "SELECT headline_id, confidence FROM scored")
def _(m: Market):
    return sg.confident_or_all(m.scored, threshold=1.5)


@query(
    "PRJ03_directional",
    "headline_id:i label_name confidence:d",
    "scored",
    "SELECT * FROM scored WHERE confidence >= 0.5 AND label_name NOT IN ('uncertain', 'neutral')",
)
def _(m: Market):
    return sg.directional(m.scored)


@query(
    "PRJ04_signal_map",
    "label_name signal:i inverted:i n:i",
    "scored",
    "SELECT label_name, signal, -signal AS inverted, count(*) AS n FROM scored GROUP BY ALL",
)
def _(m: Market):
    rows = m.scored.select("label_name", lb.signal_of("label_name").alias("signal"), lb.signal_of("label_name", inverted=True).alias("inverted"))
    return rows.groupBy("label_name", "signal", "inverted").agg(F.count("*").alias("n"))


@query(
    "PRJ05_positions",
    "date:t ticker position:i",
    "sig",
    "SELECT date, ticker, CASE WHEN signal > 0.6 THEN 1 WHEN signal < -0.6 THEN -1 ELSE 0 END AS position FROM sig",
)
def _(m: Market):
    return sg.daily_signals(m.scored).withColumn("position", lb.position_of("signal"))


@query("PRJ06_midnight_date", "event_id:i day:t", "", "SELECT event_id, CAST(ts AS DATE) AS day FROM events")
def _(m: Market):
    return m.table("events").select("event_id", F.to_date("ts").alias("day"))


@query(
    "PRJ07_period_labels",
    "year quarter month q_start:t q_end:t n:i",
    "news",
    """SELECT CAST(year(date) AS VARCHAR) AS year, year(date) || '-Q' || quarter(date) AS quarter, strftime(date, '%Y-%m') AS month,
 CAST(date_trunc('quarter', date) AS DATE) AS q_start, CAST(date_trunc('quarter', date) + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE) AS q_end, count(*) AS n
 FROM news GROUP BY ALL""",
)
def _(m: Market):
    cols = [
        dt.period_label("date", "year").alias("year"),
        dt.period_label("date", "quarter").alias("quarter"),
        dt.period_label("date", "month").alias("month"),
        dt.period_start("date", "quarter").alias("q_start"),
        dt.period_end("date", "quarter").alias("q_end"),
    ]
    return m.news.groupBy(*cols).agg(F.count("*").alias("n"))


@query(
    "PRJ08_sentiment_class",
    "event_id:i label:i label_name",
    "",
    """SELECT event_id, CASE WHEN s < -0.1 THEN 0 WHEN s > 0.1 THEN 2 ELSE 1 END AS label,
 CASE WHEN s < -0.1 THEN 'negative' WHEN s > 0.1 THEN 'positive' ELSE 'neutral' END AS label_name
 FROM (SELECT event_id, (user_id % 41 - 20) / 20.0::DOUBLE AS s FROM events)""",
)
def _(m: Market):
    score = (F.pmod("user_id", F.lit(41)) - 20) / 20.0
    return m.table("events").select("event_id", lb.sentiment_class(score).alias("label")).withColumn("label_name", lb.label_name("label"))


@query(
    "PRJ09_return_class",
    "date:t ticker label:i",
    "nextret",
    "SELECT date, ticker, CASE WHEN next_ret > 0.005 THEN 1 WHEN next_ret < -0.005 THEN -1 ELSE 0 END AS label FROM nextret",
)
def _(m: Market):
    return pn.next_day_returns(m.panel).where("next_ret is not null").withColumn("label", lb.return_class("next_ret"))


@query(
    "PRJ10_fixed_columns",
    "date:t ticker headline source extra",
    "news",
    "SELECT date, ticker, headline, source, CAST(NULL AS VARCHAR) AS extra FROM news",
)
def _(m: Market):
    return st.fixed_columns(m.news, ["date", "ticker", "headline", "source", "extra"])


@query(
    "PRJ13_usable_dates",
    "date:t ticker signal:d",
    "sig",
    "SELECT * FROM sig WHERE date IN (SELECT date FROM sig GROUP BY 1 HAVING count(DISTINCT ticker) >= 4)",
)
def _(m: Market):
    return sg.on_usable_dates(sg.daily_signals(m.scored), 4)


@query(
    "PRJ14_liquidity_filter",
    "date:t ticker signal:d",
    "sig px",
    """SELECT date, ticker, signal FROM (SELECT *, quantile_cont(dv, 0.2) OVER (PARTITION BY date) AS q FROM (
 SELECT sig.*, close * volume AS dv FROM sig LEFT JOIN px USING (date, ticker))) WHERE dv IS NULL OR dv >= q""",
)
def _(m: Market):
    return sg.liquidity_filter(sg.daily_signals(m.scored), pn.dollar_volume(m.panel))


@query(
    "PRJ15_coverage",
    "coverage:d",
    "px",
    "SELECT count(close) / (count(DISTINCT date) * count(DISTINCT ticker)) AS coverage FROM px",
)
def _(m: Market):
    return pn.coverage_ratio(m.px)


@query(
    "PRJ16_ticker_headlines",
    "date:t headline",
    "news",
    "SELECT max(date) AS date, headline FROM news WHERE upper(ticker) = upper('bRAND#7') AND headline IS NOT NULL GROUP BY headline",
)
def _(m: Market):
    return st.ticker_headlines(m.news, "bRAND#7")


@query(
    "PRJ17_sparse_tickers",
    "ticker headlines:i",
    "news",
    "SELECT ticker, count(*) AS headlines FROM news GROUP BY 1 HAVING count(*) < 600",
)
def _(m: Market):
    return sg.sparse_tickers(m.news, 600)


@query(
    "PRJ18_probability_label",
    "event_id:i label:i label_name confidence:d4",
    "",
    """SELECT event_id, CASE WHEN best < 0.5 THEN 1 ELSE arg END AS label,
 CASE WHEN best < 0.5 THEN 'uncertain' ELSE ['negative', 'neutral', 'positive'][arg + 1] END AS label_name, round(best, 4) AS confidence FROM (
 SELECT event_id, greatest(a, b, c) AS best, CASE WHEN a >= b AND a >= c THEN 0 WHEN b >= c THEN 1 ELSE 2 END AS arg FROM (
 SELECT event_id, x / (x + y + z) AS a, y / (x + y + z) AS b, z / (x + y + z) AS c FROM (
 SELECT event_id, (event_id % 7 + 1)::DOUBLE AS x, (user_id % 11 + 1)::DOUBLE AS y, ((event_id + user_id) % 5 + 1)::DOUBLE AS z FROM events)))""",
)
def _(m: Market):
    x, y, z = (F.pmod("event_id", F.lit(7)) + 1.0), (F.pmod("user_id", F.lit(11)) + 1.0), (F.pmod(F.col("event_id") + F.col("user_id"), F.lit(5)) + 1.0)
    probs = F.array(x / (x + y + z), y / (x + y + z), z / (x + y + z))
    return m.table("events").select("event_id", lb.label_from_probabilities(probs, 0.5).alias("p")).select("event_id", "p.*")


@query(
    "PRJ19_blended_label",
    "event_id:i label:i label_name confidence:d4",
    "",
    """SELECT event_id, CASE WHEN b > 0.05 THEN 2 WHEN b < -0.05 THEN 0 ELSE 1 END AS label,
 CASE WHEN b > 0.05 THEN 'positive' WHEN b < -0.05 THEN 'negative' ELSE 'neutral' END AS label_name, round(least(abs(b), 1), 4) AS confidence FROM (
 SELECT event_id, greatest(-1, least(1, coalesce(g, 0) * 0.4::DOUBLE + d * 0.6::DOUBLE)) AS b FROM (
 SELECT event_id, CASE WHEN user_id % 10 = 0 THEN NULL ELSE (user_id % 37 - 18) / 16.0::DOUBLE END AS g, (event_id % 29 - 14) / 13.0::DOUBLE AS d FROM events))""",
)
def _(m: Market):
    g = F.when(F.pmod("user_id", F.lit(10)) == 0, None).otherwise((F.pmod("user_id", F.lit(37)) - 18) / 16.0)
    d = (F.pmod("event_id", F.lit(29)) - 14) / 13.0
    return m.table("events").select("event_id", lb.blended_label(g, d).alias("p")).select("event_id", "p.*")


@query(
    "PRJ20_class_sample",
    "headline_id:i label_name",
    "scored",
    """SELECT headline_id, label_name FROM (SELECT *, row_number() OVER (PARTITION BY label_name ORDER BY md5(label_name || '|' || headline || '|' || headline_id || '|42')) AS rn FROM scored) WHERE rn <= 100""",
)
def _(m: Market):
    return st.sample_per_class(m.scored, "label_name", "headline", 300, id_col="headline_id", seed=42)


# ---- calendar joins ---------------------------------------------------------


@query(
    "JN01_forward_asof",
    "date:t entry_pos:i n:i",
    "news cal",
    "SELECT date, pos AS entry_pos, n FROM (SELECT date, count(*) AS n FROM news GROUP BY 1) d ASOF JOIN (SELECT date AS tdate, pos FROM cal) c ON d.date <= c.tdate",
)
def _(m: Market):
    return cal.as_of_forward(m.news, m.cal).groupBy("date", "entry_pos").agg(F.count("*").alias("n"))


@query(
    "JN02_signal_return_rows",
    "headline_id:i date:t ticker signal:i confidence:d label_name source " + " ".join(f"return_lag_{k}:d" for k in (1, 2, 3, 5, 10)),
    "srrow",
    "SELECT * FROM srrow",
)
def _(m: Market):
    return va.signal_return_table(m.scored, m.panel, m.cal, [1, 2, 3, 5, 10])


@query(
    "JN04_backward_asof",
    "date:t ticker level:d",
    "sig vix",
    "SELECT s.date, s.ticker, coalesce(v.level, 20.0) AS level FROM sig s ASOF LEFT JOIN (SELECT * FROM vix WHERE isodow(date) = 3) v ON s.date >= v.date",
)
def _(m: Market):
    weekly = m.vix.where(F.weekday("date") == 2)
    return cal.as_of_backward(sg.daily_signals(m.scored), weekly, "level", config.VIX_DEFAULT)


@query(
    "JN06_dollar_volume",
    "date:t ticker signal:d dollar_vol:d2",
    "sig px",
    "SELECT date, ticker, signal, close * volume AS dollar_vol FROM sig LEFT JOIN px USING (date, ticker)",
)
def _(m: Market):
    return sg.daily_signals(m.scored).join(pn.dollar_volume(m.panel), ["date", "ticker"], "left")


@query(
    "JN09_dimension_lookup",
    "ticker sector source_weight:d n:i",
    "news sectors",
    """SELECT ticker, coalesce(sector, 'Other') AS sector, CASE source WHEN 'sec_edgar' THEN 1.0 WHEN 'reuters' THEN 0.9 WHEN 'guardian' THEN 0.8
 WHEN 'newsapi' THEN 0.6 WHEN 'reddit' THEN 0.3 ELSE 0.5 END AS source_weight, count(*) AS n FROM news LEFT JOIN sectors USING (ticker) GROUP BY ALL""",
)
def _(m: Market):
    rows = sg.with_sector(m.news, m.sectors).withColumn("source_weight", st.source_weight("source"))
    return rows.groupBy("ticker", "sector", "source_weight").agg(F.count("*").alias("n"))


@query(
    "JN10_inner_alignment",
    "date:t ticker ret:d bench_ret:d",
    "ret",
    """SELECT date, ticker, ret, bench_ret FROM ret JOIN (SELECT pos, level / lag(level) OVER (ORDER BY pos) - 1 AS bench_ret FROM
 (SELECT pos, avg(close) AS level FROM ret GROUP BY 1)) b USING (pos) WHERE ret IS NOT NULL AND bench_ret IS NOT NULL""",
)
def _(m: Market):
    return pn.simple_returns(m.panel).where("ret is not null").join(pn.benchmark_returns(m.panel), "pos")


@query(
    "JN15_semi_joins",
    "ticker n:i",
    "news px",
    "SELECT ticker, count(*) AS n FROM news WHERE ticker IN (SELECT ticker FROM px) AND date IN (SELECT date FROM px) GROUP BY 1",
)
def _(m: Market):
    rows = m.news.join(m.px.select("ticker").distinct(), "ticker", "left_semi").join(m.cal.select("date"), "date", "left_semi")
    return rows.groupBy("ticker").agg(F.count("*").alias("n"))


_WEEKDAYS = """wk AS MATERIALIZED (SELECT CAST(d AS DATE) AS d, sum(CASE WHEN isodow(d) <= 5 THEN 1 ELSE 0 END) OVER (ORDER BY d) AS upto
 FROM (SELECT unnest(generate_series(TIMESTAMP '1994-01-01', TIMESTAMP '2004-12-31', INTERVAL 1 DAY)) AS d))"""


@query(
    "SF07_weekday_gap",
    "date:t gap:i",
    "news",
    "SELECT a.date, w2.upto - w1.upto - 1 AS gap FROM days a JOIN wk w1 ON w1.d = a.prev - 1 JOIN wk w2 ON w2.d = a.date",
    _WEEKDAYS + ",\ndays AS (SELECT * FROM (SELECT date, lag(date) OVER (ORDER BY date) AS prev FROM (SELECT DISTINCT date FROM news)) WHERE prev IS NOT NULL)",
)
def _(m: Market):
    days = m.news.select("date").distinct().withColumn("prev", F.lag("date").over(W.orderBy("date")))
    return days.where("prev is not null").withColumn("gap", dt.weekday_gap("prev", "date"))


REBALANCE_CTES = (
    "/*RECURSIVE_MARK*/"
    + _WEEKDAYS
    + """,
sdays AS MATERIALIZED (SELECT DISTINCT hold, date FROM capped CROSS JOIN (SELECT unnest([1, 2, 5]) AS hold)),
nxt AS MATERIALIZED (SELECT a.hold, a.date, min(b.date) AS nd FROM sdays a JOIN sdays b ON b.hold = a.hold AND b.date > a.date JOIN wk wa ON wa.d = a.date - 1 JOIN wk wb ON wb.d = b.date
 WHERE wb.upto - wa.upto - 1 >= a.hold GROUP BY 1, 2),
reb AS (SELECT hold, min(date) AS date, 1 AS rebalance_no FROM sdays GROUP BY 1 UNION ALL
 SELECT reb.hold, nxt.nd, rebalance_no + 1 FROM reb JOIN nxt ON nxt.hold = reb.hold AND nxt.date = reb.date)"""
)


@query("WN19_rebalance_calendar", "hold_days:i date:t rebalance_no:i", "capped", "SELECT hold AS hold_days, date, rebalance_no FROM reb", REBALANCE_CTES)
def _(m: Market):
    signals = sg.aggregate_signals(m.scored).select("date").distinct()
    grid = cal.explode_params(signals, [{"hold_days": h} for h in (1, 2, 5)])
    return cal.rebalance_dates(grid, ["hold_days"])


# ---- aggregates -------------------------------------------------------------


@query("AG02_capped_weighted_signals", "date:t ticker signal:d headline_count:i", "capped", "SELECT * FROM capped")
def _(m: Market):
    return sg.aggregate_signals(m.scored)


@query("AG02_plain_mean_signals", "date:t ticker signal:d headline_count:i", "binary_sig", "SELECT * FROM binary_sig")
def _(m: Market):
    return sg.aggregate_signals(m.scored, confidence_weighted=False, cap=0)


@query("AG05_source_counts", "source n:i", "news", "SELECT source, count(*) AS n FROM news GROUP BY 1")
def _(m: Market):
    return st.source_counts(m.news)


@query(
    "AG05_source_breakdown_map",
    "ticker breakdown:a",
    "news",
    "SELECT ticker, list(source || '=' || n ORDER BY source) AS breakdown FROM (SELECT ticker, source, count(*) AS n FROM news GROUP BY ALL) GROUP BY 1",
)
def _(m: Market):
    rows = st.source_breakdown(m.news)
    entries = F.transform(F.map_entries("source_breakdown"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return rows.select("ticker", F.array_sort(entries).alias("breakdown"))


@query(
    "AG06_universe_summary",
    "headlines:i tickers:i first_date:t last_date:t median_per_ticker:d min_per_ticker:i max_per_ticker:i",
    "news",
    """SELECT sum(k) AS headlines, count(*) AS tickers, min(lo) AS first_date, max(hi) AS last_date, median(k) AS median_per_ticker, min(k) AS min_per_ticker,
 max(k) AS max_per_ticker FROM (SELECT ticker, count(*) AS k, min(date) AS lo, max(date) AS hi FROM news GROUP BY 1)""",
)
def _(m: Market):
    return sg.universe_summary(m.news)


@query(
    "AG07_market_sentiment",
    "date:t market_sentiment:d market_sentiment_std:d ticker_count:i",
    "sig",
    "SELECT date, avg(signal) AS market_sentiment, stddev_samp(signal) AS market_sentiment_std, count(signal) AS ticker_count FROM sig GROUP BY 1",
)
def _(m: Market):
    return sg.market_sentiment(sg.daily_signals(m.scored))


@query("AG08_distinct_tickers", "date:t tickers:i", "sig", "SELECT date, count(DISTINCT ticker) AS tickers FROM sig GROUP BY 1")
def _(m: Market):
    return sg.daily_signals(m.scored).groupBy("date").agg(F.count_distinct("ticker").alias("tickers"))


@query(
    "AG17_date_bounds",
    "start:t end_date:t",
    "news",
    "SELECT min(date) AS start, CAST(max(date) + INTERVAL 15 DAY AS DATE) AS end_date FROM news",
)
def _(m: Market):
    return cal.date_bounds(m.news, 15).withColumnRenamed("end", "end_date")


# ---- windows ----------------------------------------------------------------


@query(
    "WN03_realised_vol",
    "date:t ticker vol:d",
    "sig cal ret",
    """SELECT p.date, p.ticker, CASE WHEN p.pos >= 3 AND stddev_samp(r.ret) > 1e-8 THEN stddev_samp(r.ret) * sqrt(252) ELSE 1 END AS vol
 FROM (SELECT s.date, s.ticker, c.pos FROM sig s ASOF JOIN cal c ON s.date <= c.date) p
 LEFT JOIN ret r ON r.ticker = p.ticker AND r.pos BETWEEN p.pos - 19 AND p.pos - 1 GROUP BY p.date, p.ticker, p.pos""",
)
def _(m: Market):
    entered = cal.as_of_forward(sg.daily_signals(m.scored), m.cal).withColumnRenamed("entry_pos", "pos")
    return entered.join(pn.realised_vol(m.panel, entered), ["ticker", "pos"])


@query(
    "WN04_news_features",
    "date:t ticker news_volume_shock:d sentiment_velocity:d sentiment_trend:d",
    "sig",
    """SELECT date, ticker, least(10, coalesce(headline_count / greatest(CASE WHEN c30 >= 5 THEN a30 END, CASE WHEN c30 >= 5 THEN 1 END), 1)) AS news_volume_shock,
 coalesce(signal - a3, 0) AS sentiment_velocity, coalesce(signal - a7, 0) AS sentiment_trend FROM (
 SELECT *, avg(headline_count) OVER w30 AS a30, count(*) OVER w30 AS c30, avg(signal) OVER w3 AS a3, avg(signal) OVER w7 AS a7 FROM sig
 WINDOW w30 AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING),
 w3 AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING),
 w7 AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING))""",
)
def _(m: Market):
    return sg.news_features(sg.daily_signals(m.scored))


# Groups of five brands trade every day, so that windows of 20 returns fill.
_GROUP = "'Group#' || (CAST(substr(ticker, 7) AS INT) % 5)"
_GVOL = f"""gpx AS MATERIALIZED (SELECT date, {_GROUP} AS ticker, avg(close) AS close, pos FROM panel GROUP BY ALL),
gvol AS MATERIALIZED (SELECT ticker, pos, date, CASE WHEN c = 20 THEN s * sqrt(252) END AS rolling_vol FROM (
 SELECT ticker, pos, date, count(lr) OVER w AS c, stddev_samp(lr) OVER w AS s FROM (SELECT r.*, ln(r.close / p.close) AS lr FROM gpx r LEFT JOIN gpx p ON p.ticker = r.ticker AND p.pos = r.pos - 1)
 WINDOW w AS (PARTITION BY ticker ORDER BY pos RANGE BETWEEN 19 PRECEDING AND CURRENT ROW)))"""


def _group():
    return F.concat(F.lit("Group#"), F.pmod(F.regexp_extract("ticker", r"(\d+)", 1).cast("int"), F.lit(5)).cast("string"))


def group_vols(m: Market):
    bars = m.panel.groupBy("date", "pos", _group().alias("ticker")).agg(F.avg("close").alias("close"))
    return pn.rolling_log_vol(bars, 20)


@query("WN05_rolling_log_vol", "date:t ticker rolling_vol:d", "panel", "SELECT date, ticker, rolling_vol FROM gvol", _GVOL)
def _(m: Market):
    return group_vols(m)


@query(
    "JN05_strict_backward_vol",
    "date:t ticker vol:d",
    "scored panel cal",
    f"""SELECT p.date, p.ticker, CASE WHEN v.rolling_vol > 0.01 THEN v.rolling_vol ELSE 1 END AS vol FROM (SELECT s.date, s.ticker, c.pos FROM
 (SELECT DISTINCT date, {_GROUP} AS ticker FROM scored WHERE confidence >= 0.7) s ASOF JOIN (SELECT date AS cd, pos FROM cal) c ON s.date <= c.cd) p LEFT JOIN gvol v ON v.ticker = p.ticker AND v.pos = p.pos - 1""",
    _GVOL,
)
def _(m: Market):
    vols = group_vols(m).select("ticker", (F.col("pos") + 1).alias("pos"), "rolling_vol")
    signals = sg.daily_signals(m.scored.withColumn("ticker", _group()))
    entered = cal.as_of_forward(signals, m.cal).withColumnRenamed("entry_pos", "pos")
    vol = F.when(F.col("rolling_vol") > 0.01, F.col("rolling_vol")).otherwise(1.0)
    return entered.join(vols, ["ticker", "pos"], "left").withColumn("vol", vol)


@query(
    "WN08_cross_section_zscore",
    "date:t ticker z:d",
    "capped",
    """SELECT date, ticker, CASE WHEN n < 2 OR s < 1e-8 THEN 0 ELSE greatest(-3, least(3, (signal - a) / s)) END AS z FROM (
 SELECT date, ticker, signal, count(*) OVER w AS n, stddev_samp(signal) OVER w AS s, avg(signal) OVER w AS a FROM capped WINDOW w AS (PARTITION BY date))""",
)
def _(m: Market):
    return sg.aggregate_signals(m.scored).withColumn("z", sg.zscore("signal", ["date"]))


@query(
    "WN09_sector_neutral",
    "date:t ticker signal:d",
    "capped sectors",
    """SELECT date, ticker, CASE WHEN n < 2 OR s < 1e-9 THEN 0 ELSE (signal - a) / s END AS signal FROM (
 SELECT date, ticker, signal, count(*) OVER w AS n, stddev_samp(signal) OVER w AS s, avg(signal) OVER w AS a
 FROM (SELECT c.*, coalesce(sector, 'Other') AS sector FROM capped c LEFT JOIN sectors USING (ticker)) WINDOW w AS (PARTITION BY date, sector))""",
)
def _(m: Market):
    return sg.sector_neutral(sg.aggregate_signals(m.scored), m.sectors)


@query(
    "WN11_top_n_per_group",
    "ticker headline_id:i confidence:d",
    "scored",
    "SELECT ticker, headline_id, confidence FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY confidence DESC, headline_id) AS rn FROM scored) WHERE rn <= 5",
)
def _(m: Market):
    return sg.top_per_day(m.scored, 5, ["ticker"], [F.desc("confidence"), F.col("headline_id")])


_EDGES = """e AS (SELECT quantile_cont(confidence, [0, 0.2, 0.4, 0.6, 0.8, 1]) AS edges FROM scored),
b AS (SELECT s.*, greatest(1, len(list_filter(list_distinct(edges), lambda x: x < s.confidence))) AS bin FROM scored s, e)"""


@query("WN12_equal_frequency_bins", "bin:i n:i lo:d hi:d", "scored", "SELECT bin, count(*) AS n, min(confidence) AS lo, max(confidence) AS hi FROM b GROUP BY 1", _EDGES)
def _(m: Market):
    binned = rk.equal_frequency_bins(m.scored, [], "confidence", 5)
    return binned.groupBy("bin").agg(F.count("*").alias("n"), F.min("confidence").alias("lo"), F.max("confidence").alias("hi"))


@query(
    "WN12_exact_quantiles",
    "q:a",
    "scored",
    "SELECT list_transform(quantile_cont(confidence, [0.05, 0.5, 0.95]), lambda x: printf('%.6f', x)) AS q FROM scored",
)
def _(m: Market):
    cut = rk.exact_quantiles(m.scored.withColumn("n", F.lit(1)), [], "confidence", [0.05, 0.5, 0.95])
    return cut.select(F.transform("edges", lambda x: F.format_string("%.6f", x)).alias("q"))


@query(
    "WN13_average_rank",
    "confidence:d avg_rank:d1 size:i",
    "scored",
    "SELECT DISTINCT confidence, rank() OVER (ORDER BY confidence) + (count(*) OVER (PARTITION BY confidence) - 1) / 2.0 AS avg_rank, count(*) OVER () AS size FROM scored",
)
def _(m: Market):
    return rk.average_rank(m.scored.withColumn("n", F.lit(1)), [], "confidence")


@query(
    "WN16_keep_first",
    "ticker headline date:t",
    "news",
    "SELECT ticker, headline, date FROM (SELECT *, row_number() OVER (PARTITION BY ticker, headline ORDER BY date, headline_id) AS rn FROM news) WHERE rn = 1",
)
def _(m: Market):
    return st.keep_first(m.news, ["ticker", "headline"], [F.col("date"), F.col("headline_id")])


@query(
    "WN17_series_tail",
    "series date:t latest:d yoy:d mom:d surprise:d trend:i",
    "macro",
    """SELECT series, date, value AS latest, CASE WHEN n >= 13 AND y <> 0 THEN (value - y) / abs(y) ELSE 0 END AS yoy, CASE WHEN n >= 2 THEN value - p ELSE 0 END AS mom,
 CASE WHEN n >= 12 AND s <> 0 THEN (value - a) / s ELSE 0 END AS surprise,
 CASE WHEN n < 4 THEN 0 WHEN value - t > th THEN 1 WHEN value - t < -th THEN -1 ELSE 0 END AS trend FROM (
 SELECT *, row_number() OVER w AS n, lag(value, 12) OVER w AS y, lag(value) OVER w AS p, lag(value, 3) OVER w AS t,
 avg(value) OVER w12 AS a, stddev_samp(value) OVER w12 AS s, CASE WHEN avg(value) OVER wall <> 0 THEN 0.05 * abs(avg(value) OVER wall) ELSE 1e-6 END AS th
 FROM macro WINDOW w AS (PARTITION BY series ORDER BY date), w12 AS (PARTITION BY series ORDER BY date ROWS 11 PRECEDING),
 wall AS (PARTITION BY series ORDER BY date ROWS UNBOUNDED PRECEDING))""",
)
def _(m: Market):
    return sr.series_features(m.macro)


@query(
    "WN18_change_and_vol",
    "series date:t change_5d:d volatility:d",
    "commod",
    """SELECT series, date, CASE WHEN n >= 6 AND b <> 0 THEN (price - b) / abs(b) ELSE 0 END AS change_5d, CASE WHEN n >= 21 AND c >= 5 THEN s * sqrt(252) ELSE 0 END AS volatility FROM (
 SELECT series, date, price, n, b, count(r) OVER w AS c, stddev_samp(r) OVER w AS s FROM (
 SELECT *, row_number() OVER o AS n, lag(price, 5) OVER o AS b, price / lag(price) OVER o - 1 AS r FROM commod WINDOW o AS (PARTITION BY series ORDER BY date))
 WINDOW w AS (PARTITION BY series ORDER BY date ROWS 19 PRECEDING))""",
)
def _(m: Market):
    return sr.change_and_volatility(m.commodities)


# ---- sets and sorts ---------------------------------------------------------


@query(
    "SET01_union_sources",
    "date:t ticker headline source n:i",
    "news",
    "SELECT date, ticker, headline, CASE WHEN source IN ('sec_edgar', 'reuters') THEN 'wire' ELSE 'press' END AS source, count(*) AS n FROM news GROUP BY ALL",
)
def _(m: Market):
    wire = F.col("source").isin("sec_edgar", "reuters")
    day = F.col("date").cast("timestamp").alias("date")
    a = m.news.where(wire).select(day, "ticker", "headline", F.lit("wire").alias("source"))
    b = m.news.where(~wire).select(day, "ticker", "headline", F.lit("press").alias("source"))
    return st.combine_sources([a, b]).groupBy("date", "ticker", "headline", "source").agg(F.count("*").alias("n"))


@query(
    "SET02_merge_sentences",
    "text label:i",
    "scored",
    "SELECT headline AS text, min(CASE label_name WHEN 'negative' THEN 0 WHEN 'neutral' THEN 1 ELSE 2 END) AS label FROM scored GROUP BY 1",
)
def _(m: Market):
    label = F.when(F.col("label_name") == "negative", 0).when(F.col("label_name") == "neutral", 1).otherwise(2)
    base = m.scored.select(F.col("headline").alias("text"), label.alias("label"), "label_name", "source")
    odd = F.pmod(F.length("text"), F.lit(2)) == 1
    return st.merge_sentences([base.where(odd), base.where(~odd)], order=[F.col("label"), F.col("source")])


@query(
    "SET03_incremental_expansion",
    "ticker headline date:t",
    "news",
    "SELECT ticker, headline, min(date) AS date FROM news GROUP BY 1, 2",
)
def _(m: Market):
    year = F.year("date")
    parts = [m.news.where(year <= 1996), m.news.where((year > 1996) & (year <= 1999)), m.news.where(year > 1999)]
    return st.expand_news(parts[0], parts[1:], tie=[F.col("headline_id")])


@query(
    "SET04_missing_tickers",
    "ticker",
    "news px",
    "SELECT ticker FROM (SELECT DISTINCT ticker FROM px) WHERE ticker NOT IN (SELECT ticker FROM news WHERE date = (SELECT max(date) FROM news))",
)
def _(m: Market):
    have = m.news.where(F.col("date") == m.news.agg(F.max("date")).scalar())
    return st.missing_tickers(m.px.select("ticker").distinct(), have)


@query(
    "SET05_symmetric_difference",
    "ticker in_both:i only_one:i",
    "news",
    """SELECT ticker, count(*) FILTER (a AND b) AS in_both, count(*) FILTER (a <> b) AS only_one FROM (
 SELECT ticker, headline, bool_or(year(date) <= 1998) AS a, bool_or(year(date) > 1998) AS b FROM news GROUP BY 1, 2) GROUP BY 1""",
)
def _(m: Market):
    return st.overlap_counts(m.news, ["ticker"], "headline", F.year("date") <= 1998)


@query(
    "SET06_union_optional",
    "ticker n:i share:d",
    "news",
    "SELECT ticker, count(*) AS n, NULL::DOUBLE AS share FROM news GROUP BY 1 UNION ALL SELECT 'all' AS ticker, NULL AS n, 1.0 AS share",
)
def _(m: Market):
    counts = m.news.groupBy("ticker").agg(F.count("*").alias("n"))
    total = m.news.agg(F.lit("all").alias("ticker"), F.lit(1.0).alias("share"))
    return st.union_optional([counts, None, total])


@query(
    "SO01_newest_first",
    "date:t headline_id:i headline",
    "news",
    "SELECT date, headline_id, headline FROM news ORDER BY date DESC, headline_id",
)
def _(m: Market):
    return m.news.orderBy(F.desc("date"), "headline_id")
