"""Classification, quality report, scalar functions and report tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapewire import config
from tapewire.functions.settle import settle
from tapewire.operators import event_backtest as eb
from tapewire.operators import factors as fx
from tapewire.operators import lexicon as lx
from tapewire.operators import macro as mc
from tapewire.operators import ml
from tapewire.operators import recommend as rc
from tapewire.operators import reports as rp
from tapewire.operators import transmission as tr
from tapewire.operators import validation as va
from tapewire.operators.sets import strata_key
from tapewire.plans.fixtures import Market
from tapewire.plans.queries.core import metrics_sql, returns
from tapewire.plans.queries.longshort import MARKET_CTES, MARKET_SPEC, MARKET_SQL, VIEWS, sql, trades
from tapewire.plans.oracle_stats import spearman_sql
from tapewire.plans.queries.macro import MEMBERS, REC_CTES, EVENTS, REC_VIEWS, commodity, results, snapshots
from tapewire.plans.queries.stats import counts
from tapewire.plans.queries.text import LEX_CTES, texts
from tapewire.plans.registry import query
from tapewire.rule_data import REGIMES, RULES, SHOCKS

_LAB = "CASE label_name WHEN 'negative' THEN 0 WHEN 'neutral' THEN 1 ELSE 2 END"
_PRED = "CASE WHEN confidence < 0.5 THEN 1 WHEN confidence < 0.75 THEN 0 ELSE 2 END"
CM = f"""lp AS MATERIALIZED (SELECT {_LAB} AS label, {_PRED} AS pred, source AS model FROM scored)"""
CLS = (
    CM
    + """,
cl AS MATERIALIZED (SELECT model, c AS class, count(*) FILTER (label = c) AS support, count(*) FILTER (pred = c) AS predicted, count(*) FILTER (label = c AND pred = c) AS tp FROM lp CROSS JOIN (SELECT unnest([0, 1, 2]) AS c) GROUP BY 1, 2),
cm AS MATERIALIZED (SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1 FROM (SELECT *, coalesce(tp / nullif(predicted, 0), 0) AS precision, coalesce(tp / nullif(support, 0), 0) AS recall FROM cl))"""
)


def predicted(m: Market):
    label = F.when(F.col("label_name") == "negative", 0).when(F.col("label_name") == "neutral", 1).otherwise(2)
    pred = F.when(F.col("confidence") < 0.5, 1).when(F.col("confidence") < 0.75, 0).otherwise(2)
    return m.scored.select(F.col("source").alias("model"), label.alias("label"), pred.alias("prediction"))


@query(
    "ML02_stratified_split",
    "headline_id:i label_name split",
    "scored",
    """SELECT headline_id, label_name, CASE WHEN rn < round(n * 0.7::DOUBLE) THEN 'train' WHEN rn < round(n * 0.85::DOUBLE) THEN 'val' ELSE 'test' END AS split FROM (
 SELECT *, row_number() OVER (PARTITION BY label_name ORDER BY md5(label_name || '|' || headline || '|' || headline_id || '|42')) - 1 AS rn, count(*) OVER (PARTITION BY label_name) AS n FROM scored)""",
)
def _(m: Market):
    return ml.stratified_split(m.scored, "label_name", "headline", "headline_id", seed=42)


@query(
    "ML03_class_metrics",
    "model class:i precision:d recall:d f1:d support:i",
    "scored",
    "SELECT * FROM cm",
    CLS,
)
def _(m: Market):
    return ml.class_metrics(predicted(m), ["model"])


@query(
    "ML03_overall_metrics",
    "model accuracy:d4 weighted_f1:d4 macro_f1:d4 n:i",
    "scored",
    "SELECT model, round(sum(tp) / sum(support), 4) AS accuracy, round(sum(f1 * support) / sum(support), 4) AS weighted_f1, round(avg(f1), 4) AS macro_f1, sum(support) AS n FROM cm GROUP BY 1",
    CLS,
)
def _(m: Market):
    return ml.overall_metrics(predicted(m), ["model"])


@query(
    "ML04_confusion_matrix",
    "label:i pred_0:i pred_1:i pred_2:i share_0:d share_1:d share_2:d",
    "scored",
    """SELECT label, p0 AS pred_0, p1 AS pred_1, p2 AS pred_2, round(p0 / n, 6) AS share_0, round(p1 / n, 6) AS share_1, round(p2 / n, 6) AS share_2 FROM (
 SELECT label, count(*) FILTER (pred = 0) AS p0, count(*) FILTER (pred = 1) AS p1, count(*) FILTER (pred = 2) AS p2, count(*) AS n FROM lp GROUP BY 1)""",
    CM,
)
def _(m: Market):
    return ml.confusion_matrix(predicted(m), [0, 1, 2])


@query(
    "ML09_model_comparison",
    "metric sec_edgar:d4 reddit:d4",
    "scored",
    """PIVOT_FREE""".replace(
        "PIVOT_FREE",
        "SELECT metric, max(v) FILTER (model = 'sec_edgar') AS sec_edgar, max(v) FILTER (model = 'reddit') AS reddit FROM ("
        + " UNION ALL ".join(
            f"SELECT model, '{k}' AS metric, {e} AS v FROM cm GROUP BY 1"
            for k, e in (("accuracy", "round(sum(tp) / sum(support), 4)"), ("weighted_f1", "round(sum(f1 * support) / sum(support), 4)"), ("macro_f1", "round(avg(f1), 4)"))
        )
        + ") GROUP BY 1",
    ),
    CLS,
)
def _(m: Market):
    return ml.model_comparison(predicted(m), ["sec_edgar", "reddit"])


@query("ML05_text_classifier", "label:i prediction:i n:i", "", None)
def _(m: Market):
    labels = m.table("labels").select("doc_id", F.col("quality").alias("label"))
    rows = texts(m).join(labels, "doc_id").withColumn("_key", strata_key("label", "text", "doc_id", config.RANDOM_SEED))
    rows = settle(ml.with_terms(rows))  # the texts are read and cut into terms once
    split = ml.split_by_key(rows, "label")
    model = ml.fit_text_classifier(split.where("split = 'train'"), split.where("split = 'val'"))
    out = ml.of_terms(model).transform(split.where("split <> 'train'"))
    return out.groupBy("label", F.col("prediction").cast("int").alias("prediction")).agg(F.count("*").alias("n"))


def feature_vectors(m: Market):
    """The whole feature vector of each (date, ticker) with news; the context is that of the month's first day."""
    scored = lx.score_texts(m.scored, dedupe=True)
    sent = scored.groupBy("date", "ticker").agg(
        F.avg("signal").alias("sent_signal_score"),
        F.avg("confidence").alias("sent_confidence"),
        F.avg("normalised_score").alias("sent_lexicon_score"),
        F.sum(F.size("matched_bullish")).alias("sent_bullish_count"),
        F.sum(F.size("matched_bearish")).alias("sent_bearish_count"),
        F.count("*").alias("sent_headline_count"),
        F.count_if(F.col("confidence") >= config.CONFIDENCE_THRESHOLD).alias("sent_confident_count"),
    )
    bench = m.panel.groupBy("pos").agg(F.avg("close").alias("close"))
    market = fx.market_features(m.panel, bench)
    # bounded by days, read several times below; each reader would scan orders and line items again
    macro, comm = settle(snapshots(m)), settle(commodity(m))
    ctx = settle(tr.context_rows(macro, comm))
    wide = mc.macro_features(macro).join(mc.commodity_features(comm), "date").join(tr.chain_features(ctx), "date").join(ctx.select("date", "events"), "date")
    rows = sent.join(market, ["date", "ticker"]).withColumn("month", F.to_date(F.date_trunc("month", "date"))).join(wide.withColumnRenamed("date", "month"), "month")
    x = tr.exposure(tr.ticker_sectors(F.col("ticker"), MEMBERS), F.col("events"))
    rows = rows.withColumn("_x", x)
    parts = {"chain_net_exposure": "net_exposure", "chain_pos_exposure": "positive_exposure", "chain_neg_exposure": "negative_exposure"}
    return rows.withColumns({n: F.col(f"_x.{c}") for n, c in parts.items()}).select("date", "ticker", *FEATURES)


_MACRO = ["cpi_yoy", "unemployment", "payrolls_chg", "gdp_growth", "fed_funds", "yield_10yr", "yield_2yr", "yield_spread", "vix", "macro_surprise", "macro_trend"]
_GOODS = ["oil", "gas", "copper", "gold"]
_SENT = {
    "sent_signal_score": "avg(s.signal)",
    "sent_confidence": "avg(confidence)",
    "sent_lexicon_score": "avg(normalised_score)",
    "sent_bullish_count": "sum(len(bull))",
    "sent_bearish_count": "sum(len(bear))",
    "sent_headline_count": "count(*)",
    "sent_confident_count": "count(*) FILTER (confidence >= 0.7)",
}
_MARKET = [c.split(":")[0] for c in MARKET_SPEC.split()[2:]]
_CONTEXT = {f"macro_{c.removeprefix('macro_')}": f"x.{c}" for c in _MACRO} | {f"macro_regime_{r}": f"CASE WHEN regime = '{r}' THEN 1 ELSE 0 END" for r in REGIMES}
for _n in _GOODS:
    _CONTEXT |= {f"commodity_{_n}_price": f"{_n}_price", f"commodity_{_n}_change_5d": f"{_n}_change_5d", f"commodity_{_n}_vol": f"{_n}_volatility"}
    _CONTEXT |= {f"commodity_{_n}_shock_{k}": f"CASE WHEN {_n}_shock = '{k}' THEN 1 ELSE 0 END" for k in SHOCKS}
_CONTEXT |= {"commodity_stress": "commodity_stress", "chain_active_count": "coalesce(k, 0)", "chain_max_risk_level": "coalesce(top, 0)", "chain_avg_risk_level": "coalesce(mean, 0)"}
_CONTEXT |= {f"chain_{r[0]}": f"CASE WHEN list_contains(rules, '{r[0]}') THEN 1 ELSE 0 END" for r in RULES}
_CONTEXT |= {"chain_net_exposure": "net_exposure", "chain_pos_exposure": "positive_exposure", "chain_neg_exposure": "negative_exposure"}
#: All numeric columns of the vector, by family.
FEATURES = [*_SENT, *_MARKET, *_CONTEXT]


@query(
    "FX09_feature_vector",
    "date:t ticker " + " ".join(f"{c}:d5" for c in FEATURES),
    "news scored panel macro vix commod",
    "SELECT s.date, s.ticker, " + ", ".join([*_SENT, *(f"mk.{c}" for c in _MARKET), *(f"{e} AS {n}" for n, e in _CONTEXT.items())])
    + """ FROM sv s JOIN mk ON mk.date = s.date AND mk.ticker = s.ticker JOIN snap x ON x.date = date_trunc('month', s.date) JOIN csnap c ON c.date = x.date
 LEFT JOIN (SELECT date AS ed, count(*) AS k, max(risk_level) AS top, avg(risk_level) AS mean, list(rule) AS rules FROM ev GROUP BY 1) e ON e.ed = x.date JOIN expo o ON o.date = x.date AND o.ticker = s.ticker""",
    LEX_CTES
    + ",\n"
    + EVENTS
    + ",\n"
    + MARKET_CTES
    + f",\nmk AS MATERIALIZED ({MARKET_SQL}),\nsv AS MATERIALIZED (SELECT s.date, s.ticker, "
    + ", ".join(f"{e} AS {n}" for n, e in _SENT.items())
    + " FROM scored s JOIN lexnews l USING (headline_id) GROUP BY 1, 2)",
)
def _(m: Market):
    return feature_vectors(m)


def training_rows(m: Market):
    """Labelled vectors with their split; settled, since splitting and fitting read them more than once."""
    labels = fx.training_labels(settle(m.scored.select("ticker", "date").distinct()), m.panel, m.cal)
    rows = settle(labels.join(feature_vectors(m), ["ticker", "date"]).withColumn("day", F.col("date").cast("string")))
    return settle(ml.stratified_split(rows, "label", "ticker", "day"))


@query("ML06_alpha_model", "label:i prediction:i n:i mean_up:d mean_down:d", "", None)
def _(m: Market):
    """Fitted on the training rows, scored on the test rows."""
    rows = training_rows(m)
    model = ml.fit_alpha(rows.where("split = 'train'"), FEATURES)
    out = ml.alpha_probabilities(model, rows.where("split = 'test'"))
    best = F.greatest("prob_down", "prob_flat", "prob_up")
    out = out.withColumn("prediction", F.when(F.col("prob_down") == best, -1).when(F.col("prob_flat") == best, 0).otherwise(1))
    return out.groupBy("label", "prediction").agg(F.count("*").alias("n"), F.avg("prob_up").alias("mean_up"), F.avg("prob_down").alias("mean_down"))


@query("ML07_feature_importances", "feature importance:d", "", None)
def _(m: Market):
    model = ml.fit_alpha(training_rows(m).where("split = 'train'"), FEATURES)
    return m.spark.createDataFrame(ml.feature_importances(model), "feature string, importance double")


@query(
    "ML08_quality_report",
    "model predictive_score:d2 risk_score:d2 robustness_score:d2 overall_score:d2 verdict",
    "events_bt scored",
    None,
)
def _(m: Market):
    perf = eb.portfolio_metrics(returns(m).withColumn("model", F.lit("lexicon")), ["model"])
    c = counts(m)
    ic = va.ic_decay(c, [1, 5], "n").agg(F.max(F.when(F.col("lag") == 1, F.col("ic"))).alias("ic"), F.max(F.when(F.col("lag") == 5, F.col("ic"))).alias("ic_5"))
    hit = va.hit_rate(c, [], "return_lag_1", n="n").agg(F.max("overall")).scalar()
    cls = ml.overall_metrics(predicted(m).withColumn("model", F.lit("lexicon")), ["model"]).drop("n")
    row = perf.join(cls, "model").withColumn("ic", ic.select("ic").scalar()).withColumn("ic_5", ic.select("ic_5").scalar()).withColumn("hit_rate", hit)
    return ml.quality_report(row)


_SCORES = "CASE WHEN s >= 2.0 THEN 10.0 WHEN s >= 1.5 THEN 8 + (s - 1.5) / 0.5 * 2 WHEN s >= 1 THEN 6 + (s - 1) / 0.5 * 2 WHEN s >= 0.5 THEN 3 + (s - 0.5) / 0.5 * 3 WHEN s >= 0 THEN s / 0.5 * 3 ELSE 0 END"


@query("SF12_sharpe_band", "event_id:i band:d", "", f"SELECT event_id, {_SCORES} AS band FROM (SELECT event_id, (user_id % 60 - 20) / 16.0::DOUBLE AS s FROM events)")
def _(m: Market):
    s = (F.pmod("user_id", F.lit(60)) - 20) / 16.0
    steps = [(2.0, 10.0, 0, 0), (1.5, 8.0, 0.5, 2.0), (1.0, 6.0, 0.5, 2.0), (0.5, 3.0, 0.5, 3.0), (0.0, 0.0, 0.5, 3.0)]
    return m.table("events").select("event_id", ml.band(s, steps, F.lit(0.0)).alias("band"))


@query("SF02_token_counts", "headline tokens:i first", "news", "SELECT DISTINCT headline, len(t) AS tokens, t[1] AS first FROM (SELECT headline, regexp_extract_all(lower(headline), '[a-z0-9]+(?:[-''][a-z0-9]+)*') AS t FROM news)")
def _(m: Market):
    t = lx.tokens(F.col("headline"))
    return m.news.select("headline").distinct().select("headline", F.size(t).alias("tokens"), F.get(t, F.lit(0)).alias("first"))


@query(
    "SF01_string_functions",
    "headline up title tail has_sec:b",
    "news",
    "SELECT DISTINCT headline, upper(headline) AS up, substr(headline, 1, 8) AS title, replace(lower(headline), 'brand#', '') AS tail, contains(headline, 'SEC') AS has_sec FROM news",
)
def _(m: Market):
    h = F.col("headline")
    return m.news.select("headline").distinct().select(
        "headline", F.upper(h).alias("up"), F.substring(h, 1, 8).alias("title"), F.replace(F.lower(h), F.lit("brand#"), F.lit("")).alias("tail"), F.contains(h, F.lit("SEC")).alias("has_sec")
    )


@query("SF09_json_fields", "k:i n:i total:d2", "", "SELECT CAST(json_extract(props, '$.k') AS BIGINT) AS k, count(*) AS n, sum(value) AS total FROM events GROUP BY 1")
def _(m: Market):
    k = F.from_json("props", "k long")["k"]
    return m.table("events").groupBy(k.alias("k")).agg(F.count("*").alias("n"), F.sum("value").alias("total"))


@query(
    "SF13_null_handling",
    "ticker part:d filled:d",
    "px",
    "SELECT ticker, sum(volume) / nullif(sum(volume) FILTER (isodow(date) = 1), 0) AS part, coalesce(sum(volume) / nullif(sum(volume) FILTER (isodow(date) = 6), 0), -1) AS filled FROM px GROUP BY 1",
)
def _(m: Market):
    day = F.weekday("date")
    return m.px.groupBy("ticker").agg(F.sum("volume").alias("v"), F.sum(F.when(day == 0, F.col("volume"))).alias("a"), F.sum(F.when(day == 5, F.col("volume"))).alias("b")).select(
        "ticker", (F.col("v") / F.nullif("a", F.lit(0.0))).alias("part"), F.coalesce(F.col("v") / F.nullif("b", F.lit(0.0)), F.lit(-1.0)).alias("filled")
    )


@query(
    "JN16_aggregate_back_to_detail",
    "run rebalance_date:t ticker ls_return:d best:d",
    VIEWS,
    "SELECT run, rebalance_date, ticker, ls_return, max(ls_return) OVER (PARTITION BY run) AS best FROM ltrades",
    sql(),
)
def _(m: Market):
    t = trades(m)
    return rp.with_group_value(t, t.groupBy("run").agg(F.max("ls_return").alias("best")), "run")


@query("SO04_watch_list_order", "ticker recommendation", REC_VIEWS, "SELECT ticker, recommendation FROM rec", REC_CTES)
def _(m: Market):
    return rc.scan_order(results(m))


@query("SO07_first_flags", "date:t ticker risk_flags:a", "macro vix commod", "SELECT date, ticker, risk_flags[1:5] AS risk_flags FROM flags", EVENTS)
def _(m: Market):
    rows = tr.context_rows(snapshots(m), commodity(m)).withColumn("ticker", F.explode(F.array(*[F.lit(f"Brand#{b}") for b in range(1, 26)])))
    flags = tr.risk_flags(tr.ticker_sectors(F.col("ticker"), MEMBERS), F.col("events"), 5)
    return rows.select("date", "ticker", flags.alias("risk_flags")).where(F.size("risk_flags") > 0)


# ---- report tables ----------------------------------------------------------

_CURVE = """dl AS (SELECT ticker, date, avg(strategy_return) AS strat, avg(benchmark_return) AS bench FROM events_bt GROUP BY 1, 2),
eq AS (SELECT *, product(1 + strat) OVER w AS equity, product(1 + bench) OVER w AS bench_equity FROM dl WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING)),
pk AS (SELECT *, max(equity) OVER (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING) AS peak FROM eq),
curve AS (SELECT *, (equity - peak) / peak AS drawdown FROM pk)"""


@query("RP01_equity_curves", "ticker date:t equity:d bench_equity:d", "events_bt", "SELECT ticker, date, equity, bench_equity FROM curve", _CURVE)
def _(m: Market):
    d = eb.daily_portfolio(returns(m), ["ticker"])
    bench = eb.equity_curve(d, ["ticker"], "bench").select("ticker", "date", F.col("equity").alias("bench_equity"))
    return eb.equity_curve(d, ["ticker"]).join(bench, ["ticker", "date"])


@query(
    "RP01_long_short_curve",
    "run rebalance_date:t net_return:d equity:d",
    VIEWS,
    """SELECT run, rebalance_date, net AS net_return, product(1 + net) OVER (PARTITION BY run ORDER BY rebalance_date ROWS UNBOUNDED PRECEDING) AS equity FROM (
 SELECT run, rebalance_date, (coalesce(avg(ls_return) FILTER (position > 0), 0) + coalesce(avg(ls_return) FILTER (position < 0), 0)) / 2 AS net FROM ltrades GROUP BY 1, 2)""",
    sql(),
)
def _(m: Market):
    from tapewire.operators.longshort import side_curve

    return side_curve(trades(m), ["run"])


@query("RP02_drawdown_trough", "ticker depth:d trough:t", "events_bt", "SELECT ticker, min(drawdown) AS depth, min(date) FILTER (d = md) AS trough FROM (SELECT *, round(drawdown, 12) AS d, min(round(drawdown, 12)) OVER (PARTITION BY ticker) AS md FROM curve) GROUP BY 1", _CURVE)
def _(m: Market):
    return rp.drawdown_trough(eb.equity_curve(eb.daily_portfolio(returns(m), ["ticker"]), ["ticker"]), ["ticker"])


@query(
    "RP03_signal_distribution",
    "side n:i",
    "events_bt",
    "SELECT CASE WHEN position > 0 THEN 'long' WHEN position < 0 THEN 'short' ELSE 'hold' END AS side, count(*) AS n FROM events_bt GROUP BY 1",
)
def _(m: Market):
    return rp.signal_distribution(returns(m), F.col("position"))


@query("RP04_sharpe_by_ticker", "ticker sharpe_ratio:d4", "events_bt", "SELECT ticker, sharpe_ratio FROM mt", metrics_sql("events_bt", "ticker"))
def _(m: Market):
    return eb.portfolio_metrics(returns(m), ["ticker"]).select("ticker", "sharpe_ratio").orderBy("sharpe_ratio", "ticker")


@query(
    "RP07_return_histogram",
    "bin:i left_edge:d count:i density:d4",
    "events_bt",
    """SELECT bin, lo + bin * width AS left_edge, count(*) AS count, count(*) / n / width AS density FROM (SELECT least(49, CAST(floor((benchmark_return - lo) / width) AS INT)) AS bin, lo, width, n FROM events_bt,
 (SELECT min(benchmark_return) AS lo, (max(benchmark_return) - min(benchmark_return)) / 50 AS width, count(*)::DOUBLE AS n FROM events_bt)) GROUP BY bin, lo, width, n""",
)
def _(m: Market):
    return rp.return_histogram(returns(m), "benchmark_return")


@query("RP07_fitted_moments", "mean:d std:d n:i", "events_bt", "SELECT avg(benchmark_return) AS mean, stddev_samp(benchmark_return) AS std, count(*) AS n FROM events_bt")
def _(m: Market):
    return rp.moments(returns(m), "benchmark_return")


@query(
    "RP08_return_densities",
    "side i:i density:d4",
    "srrow",
    """SELECT side, i, avg(exp(-((x - ret) / h) * ((x - ret) / h) / 2) / (h * sqrt(2 * pi()))) AS density FROM (SELECT side, ret, stddev_samp(ret) OVER (PARTITION BY side) * pow(count(*) OVER (PARTITION BY side), -0.2) AS h FROM (
 SELECT CASE WHEN signal > 0 THEN 'buy' ELSE 'sell' END AS side, return_lag_1 AS ret FROM srrow)) CROSS JOIN (SELECT i, -0.1::DOUBLE + i * (0.2::DOUBLE / 40) AS x FROM range(41) t(i)) GROUP BY 1, 2""",
)
def _(m: Market):
    rows = counts(m).withColumn("side", F.when(F.col("signal") > 0, "buy").otherwise("sell"))
    return rp.kernel_density(rows, "side", "return_lag_1", "n")


@query(
    "RP09_ic_decay_bars",
    "lag:i ic:d4 n:i",
    "srrow",
    "SELECT lag, round(ic, 4) AS ic, n FROM s",
    "lr AS (" + " UNION ALL ".join(f"SELECT {k} AS lag, signal, return_lag_{k} AS ret FROM srrow" for k in (1, 2, 3, 5, 10)) + "),\ns AS (" + spearman_sql("lr", "lag", "signal", "ret") + ")",
)
def _(m: Market):
    return va.ic_decay(counts(m), [1, 2, 3, 5, 10], "n")


@query("RP10_rolling_sharpe", "date:t rolling_sharpe:d", "events_bt", """SELECT date, CASE WHEN c = 60 AND s > 0 THEN a / s * sqrt(252) END AS rolling_sharpe FROM (
 SELECT date, count(*) OVER w AS c, avg(strat - 0.045::DOUBLE / 252) OVER w AS a, stddev_samp(strat - 0.045::DOUBLE / 252) OVER w AS s FROM (SELECT date, avg(strategy_return) AS strat FROM events_bt GROUP BY 1)
 WINDOW w AS (ORDER BY date ROWS 59 PRECEDING))""")
def _(m: Market):
    daily = eb.daily_portfolio(returns(m).withColumn("model", F.lit("m")), ["model"])
    return eb.rolling_sharpe(daily, ["model"])


@query("RP11_signal_scatter", "signal:i return_lag_1:d n:i", "srrow", "SELECT signal, return_lag_1, count(*) AS n FROM srrow GROUP BY ALL")
def _(m: Market):
    return counts(m).groupBy("signal", "return_lag_1").agg(F.sum("n").alias("n"))
