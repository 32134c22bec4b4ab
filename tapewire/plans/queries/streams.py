"""Streaming jobs driven to the end of the whole table, and the remaining sinks and pipelines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapewire.functions.labels import label_name, sentiment_class
from tapewire.operators import factors as fx
from tapewire.operators import ml
from tapewire.operators import sets as st
from tapewire.operators import signals as sg
from tapewire.operators import validation as va
from tapewire.plans.fixtures import Market
from tapewire.plans.oracle_stats import spearman_sql
from tapewire.plans.queries.longshort import FACTOR_CTES, FVIEWS, matrix
from tapewire.plans.queries.macro import BOOK, REC_CTES, REC_VIEWS, SNAP, book, results, snapshots
from tapewire.plans.queries.models import CLS, predicted
from tapewire.plans.queries.sources import folder
from tapewire.plans.queries.stats import counts
from tapewire.plans.registry import query
from tapewire.sources.keyed import KeyedTable
from tapewire.sources import store as so
from tapewire.streaming import jobs as sj


#: Files come in any order, so the watermark of a whole table read at once lies behind its first day.
WHOLE = "10000 days"


def landed(m: Market, df: DataFrame, files: int | None = None) -> tuple[str, str]:
    """Write the batch table as stream input; returns (input path, schema)."""
    path = folder(m)
    (df.repartition(files) if files else df).write.parquet(path)
    return path, df.schema.simpleString()[7:-1].replace(":", " ")


def drain(m: Market, stream: DataFrame) -> DataFrame:
    out, state = folder(m), folder(m)
    q = stream.writeStream.format("parquet").option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start(out)
    q.awaitTermination()
    return m.spark.read.schema(stream.schema).parquet(out)


def stamped(m: Market) -> DataFrame:
    return m.scored.withColumn("date", F.col("date").cast("timestamp")).select("date", "ticker", "headline", "source", "label_name", "confidence")


@query("ST01_stream_ingest", "ticker headline", "news", "SELECT DISTINCT ticker, headline FROM news")
def _(m: Market):
    path, schema = landed(m, stamped(m))
    news = sj.read_news_stream(m.spark, path, schema)
    # A watermark longer than the history: every repeat of a headline is a duplicate.
    return drain(m, sj.deduplicated(news, "10000 days").select("ticker", "headline"))


@query(
    "ST02_incremental_scoring",
    "label_name n:i",
    "news",
    "SELECT CASE WHEN length(headline) % 2 = 0 THEN 'positive' ELSE 'negative' END AS label_name, count(*) AS n FROM news GROUP BY 1",
)
def _(m: Market):
    path, schema = landed(m, stamped(m).drop("label_name", "confidence"))
    out = folder(m)

    def scorer(df: DataFrame) -> DataFrame:
        label = F.when(F.pmod(F.length("headline"), F.lit(2)) == 0, "positive").otherwise("negative")
        return df.withColumn("label_name", label).withColumn("confidence", F.lit(0.9))

    body = sj.incremental_scorer(so.open_cache(m.spark, folder(m), 8), scorer, "m", out)
    sj.run_to_end(sj.read_news_stream(m.spark, path, schema), body, folder(m))
    return m.spark.read.parquet(out).groupBy("label_name").agg(F.count("*").alias("n"))


@query(
    "ST03_recommendation_alerts",
    "ticker month:t previous recommendation",
    "scored",
    """SELECT ticker, month, previous, recommendation FROM (SELECT *, lag(recommendation) OVER (PARTITION BY ticker ORDER BY month) AS previous FROM (
 SELECT ticker, CAST(date_trunc('month', date) AS DATE) AS month, CASE WHEN avg(signal) > 0.1 THEN 'BUY' WHEN avg(signal) < -0.1 THEN 'SELL' ELSE 'HOLD' END AS recommendation FROM scored GROUP BY 1, 2))
 WHERE previous IS NOT NULL AND previous <> recommendation""",
)
def _(m: Market):
    s = m.scored.groupBy("ticker", F.date_trunc("month", "date").alias("ts")).agg(F.avg("signal").alias("s"))
    rec = F.when(F.col("s") > 0.1, "BUY").when(F.col("s") < -0.1, "SELL").otherwise("HOLD")
    path, schema = landed(m, s.select("ticker", rec.alias("recommendation"), F.col("ts").cast("timestamp").alias("ts")), 3)
    history, alerts = (KeyedTable(m.spark, folder(m), kind, ["ticker", "ts"], 4, ["ticker"]) for kind in (sj.HISTORY, sj.ALERTS))
    # one file a batch, and files in no order of time
    sj.run_to_end(sj.read_news_stream(m.spark, path, schema, 1), sj.recommendation_alerts(history, alerts), folder(m))
    return sj.current_alerts(alerts).withColumn("month", F.to_date("ts"))


@query(
    "ST04_daily_signal_stream",
    "date:t ticker signal:d headline_count:i",
    "conf",
    "SELECT date, ticker, avg(signal::DOUBLE) AS signal, count(*) AS headline_count FROM conf GROUP BY 1, 2",
)
def _(m: Market):
    path, schema = landed(m, stamped(m), 3)
    table = KeyedTable(m.spark, folder(m), "date date, ticker string, signal double, headline_count long", ["date", "ticker"], 8)
    sj.run_to_end(sj.daily_signal_stream(sj.read_news_stream(m.spark, path, schema, 1), delay=WHOLE), sj.upsert(table), folder(m))
    return table.read()


@query(
    "ST05_news_volume_stream",
    "end_date:t ticker n:i",
    "news",
    """SELECT CAST(d + 1 AS DATE) AS end_date, ticker, count(*) AS n FROM (SELECT ticker, unnest([date + CAST(i AS INTEGER) for i in range(30)]) AS d FROM news) GROUP BY 1, 2""",
)
def _(m: Market):
    path, schema = landed(m, stamped(m), 3)
    daily = KeyedTable(m.spark, folder(m), "date date, ticker string, n long", ["date", "ticker"], 8, ["ticker"])
    windows = KeyedTable(m.spark, folder(m), "end_date date, ticker string, n long", ["end_date", "ticker"], 8, ["ticker"])
    sj.run_to_end(sj.daily_volume_stream(sj.read_news_stream(m.spark, path, schema, 1), WHOLE), sj.volume_windows(daily, windows), folder(m))
    return windows.read()


# ---- remaining sinks --------------------------------------------------------


@query(
    "SRC15_metric_table_sink",
    "model class accuracy:d4 f1:d4",
    "scored",
    """SELECT model, 'overall' AS class, round(sum(tp) / sum(support), 4) AS accuracy, NULL::DOUBLE AS f1 FROM cm GROUP BY 1 UNION ALL
 SELECT model, ['negative', 'neutral', 'positive'][class + 1] AS class, NULL AS accuracy, round(f1, 4) AS f1 FROM cm""",
    CLS,
)
def _(m: Market):
    per = ml.class_metrics(predicted(m), ["model"]).withColumn("name", label_name("class"))
    maps = per.groupBy("model").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("name", F.struct("precision", "recall", F.round("f1", 4).alias("f1")).alias("v"))))).alias("per_class")
    )
    rows = so.flatten_class_metrics(ml.overall_metrics(predicted(m), ["model"]).join(maps, "model"))
    path = folder(m)
    so.save_metric_table(rows, path)
    return m.spark.read.schema(rows.schema).option("header", True).csv(path)


@query("SRC16_feature_snapshot_sink", "date:t macro_vix:d2 macro_trend:d", "macro vix", "SELECT date, vix AS macro_vix, macro_trend FROM snap", SNAP)
def _(m: Market):
    from tapewire.operators.macro import macro_features

    path = folder(m)
    macro_features(snapshots(m)).write.parquet(path)
    return m.spark.read.parquet(path)


@query("SRC17_json_report", "ticker n:i", "news", "SELECT ticker, count(*) AS n FROM news GROUP BY 1")
def _(m: Market):
    path = folder(m)
    so.save_json_report(m.news.groupBy("ticker").agg(F.count("*").alias("n")), path)
    return m.spark.read.schema("ticker string, n long").json(path)


@query(
    "SRC22_content_hash",
    "hash",
    "news",
    """SELECT sha256(sha256(sha256(sha256(string_agg(sha256(line), '' ORDER BY line)) ) || ' ' || sum(octet_length(encode(line)) + 1))) AS hash FROM (SELECT ticker || ',' || count(*) AS line FROM news GROUP BY ticker)""",
)
def _(m: Market):
    path = folder(m)
    lines = m.news.groupBy("ticker").agg(F.count("*").alias("n")).select(F.concat_ws(",", "ticker", "n").alias("line"))
    lines.coalesce(1).sortWithinPartitions("line").write.text(path)
    return so.content_hash(m.spark, path)


@query(
    "SRC23_portfolio_report",
    "copy run ticker recommendation",
    REC_VIEWS,
    """SELECT 'archive' AS copy, r AS run, ticker, recommendation FROM rec, (VALUES ('r1'), ('r2')) v(r) UNION ALL SELECT 'latest', NULL, ticker, recommendation FROM rec
 UNION ALL SELECT 'ranked', NULL, ticker, 'BUY' FROM book""",
    REC_CTES + ",\n" + BOOK,
)
def _(m: Market):
    from tapewire.operators import recommend as rc
    path = folder(m)
    rows = results(m)
    for run in ("r1", "r2"):
        so.save_portfolio(rc.summary_table(rows), rc.summary_table(book(m)), path, run)
    return so.load_portfolio(m.spark, path, ", ".join(f"`{c}` {t}" for c, t in rc.summary_table(rows).dtypes))


@query(
    "SRC24_labelled_sentences",
    "label:i label_name source n:i",
    "",
    """SELECT label, ['negative', 'neutral', 'positive'][label + 1] AS label_name, source, count(*) AS n FROM (
 SELECT CASE WHEN quality = 1 THEN 2 ELSE 0 END AS label, 'quality' AS source, text FROM documents JOIN labels USING (doc_id) UNION ALL
 SELECT CASE WHEN s < -0.1 THEN 0 WHEN s > 0.1 THEN 2 ELSE 1 END, 'score', text FROM (SELECT text, (conv_id % 5 - 2) / 4.0 AS s FROM conversations)) WHERE trim(text) <> '' GROUP BY ALL""",
)
def _(m: Market):
    a = m.documents.join(m.table("labels"), "doc_id").select("text", F.when(F.col("quality") == 1, 2).otherwise(0).alias("label"), F.lit("quality").alias("source"))
    score = (F.pmod("conv_id", F.lit(5)) - 2) / 4.0
    b = m.table("conversations").select("text", sentiment_class(score).alias("label"), F.lit("score").alias("source"))
    rows = a.unionByName(b).where("trim(text) <> ''").withColumn("label_name", label_name("label"))
    return rows.groupBy("label", "label_name", "source").agg(F.count("*").alias("n"))


@query(
    "UDF04_user_weights",
    "date:t ticker combined_score:d6",
    FVIEWS,
    "SELECT date, ticker, round(0.5::DOUBLE * signal + 0.5::DOUBLE * coalesce(momentum, 0), 6) AS combined_score FROM fac",
    FACTOR_CTES,
)
def _(m: Market):
    return fx.combine_factors(matrix(m), {"sentiment": 2.0, "momentum": 2.0, "volatility": 0.0})


@query(
    "UDF03_row_expression",
    "headline_id:i adjusted:d",
    "scored",
    "SELECT headline_id, greatest(-1, least(1, signal * confidence + CASE WHEN contains(headline, 'SEC') THEN -0.1::DOUBLE ELSE 0 END)) AS adjusted FROM scored",
)
def _(m: Market):
    from tapewire.functions.stats import clip

    bump = F.when(F.contains("headline", F.lit("SEC")), -0.1).otherwise(0.0)
    return m.scored.withColumn("adjusted", clip(F.col("signal") * F.col("confidence") + bump, -1.0, 1.0))


@query("UDF02_group_transform", "date:t ticker dev:d", "sig", "SELECT date, ticker, signal - avg(signal) OVER (PARTITION BY date) AS dev FROM sig")
def _(m: Market):
    from pyspark.sql import Window as W

    return sg.daily_signals(m.scored).withColumn("dev", F.col("signal") - F.avg("signal").over(W.partitionBy("date")))


@query(
    "SF06_array_functions",
    "ticker n:i has_sec:b total:i",
    "news",
    "SELECT ticker, len(s) AS n, list_contains(s, 'sec_edgar') AS has_sec, list_sum(list_transform(s, lambda x: length(x))) AS total FROM (SELECT ticker, list(DISTINCT source) AS s FROM news GROUP BY 1)",
)
def _(m: Market):
    s = st.source_breakdown(m.news).select("ticker", F.map_keys("source_breakdown").alias("s"))
    return s.select("ticker", F.size("s").alias("n"), F.array_contains("s", "sec_edgar").alias("has_sec"), F.aggregate("s", F.lit(0), lambda a, x: a + F.length(x)).alias("total"))


@query(
    "SF04_date_functions",
    "date:t next_week:t year:i quarter:i epoch:i",
    "",
    "SELECT DISTINCT CAST(o_orderdate AS DATE) AS date, CAST(o_orderdate + INTERVAL 7 DAY AS DATE) AS next_week, year(o_orderdate) AS year, quarter(o_orderdate) AS quarter, CAST(epoch(o_orderdate) AS BIGINT) AS epoch FROM orders",
)
def _(m: Market):
    d = F.to_date("o_orderdate")
    return m.table("orders").select(
        d.alias("date"), F.date_add(d, 7).alias("next_week"), F.year(d).alias("year"), F.quarter(d).alias("quarter"), F.unix_timestamp(d.cast("timestamp")).alias("epoch")
    ).distinct()


@query(
    "SF05_math_functions",
    "event_id:i a:d b:d c:i e:d",
    "",
    "SELECT event_id, tanh(value / 50) AS a, ln(1 + abs(value)) AS b, CAST(sign(value - 20) AS BIGINT) AS c, greatest(-1, least(1, (value - 20) / 10)) AS e FROM events",
)
def _(m: Market):
    from tapewire.functions.stats import clip

    v = F.col("value")
    return m.table("events").select("event_id", F.tanh(v / 50).alias("a"), F.ln(1 + F.abs(v)).alias("b"), F.signum(v - 20).alias("c"), clip((v - 20) / 10, -1.0, 1.0).alias("e"))


@query("SF08_map_lookup", "source weight:d n:i", "news", "SELECT source, CASE source WHEN 'sec_edgar' THEN 1.0 WHEN 'reuters' THEN 0.9 WHEN 'guardian' THEN 0.8 WHEN 'newsapi' THEN 0.6 WHEN 'reddit' THEN 0.3 ELSE 0.5 END AS weight, count(*) AS n FROM news GROUP BY ALL")
def _(m: Market):
    return m.news.groupBy("source", st.source_weight("source").alias("weight")).agg(F.count("*").alias("n"))


_CHECKS = (
    "lr AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT {k} AS lag, signal, return_lag_{k} AS ret FROM srrow" for k in (1, 2, 3, 5, 10)) + "),\n"
    "sl AS (" + spearman_sql("lr", "lag", "signal", "ret") + "),\nst AS (" + spearman_sql("srrow", "ticker", "signal", "return_lag_1", 5) + ")"
)


@query(
    "EX15_signal_validation",
    "check_name value:d4",
    "srrow",
    """SELECT 'hit_rate' AS check_name, round(avg(CASE WHEN signal * return_lag_1 > 0 THEN 1 ELSE 0 END), 4) AS value FROM srrow UNION ALL SELECT 'ic_lag_' || lag, round(ic, 4) FROM sl
 UNION ALL SELECT CASE WHEN signal > 0 THEN 't_buy' ELSE 't_sell' END, round(avg(return_lag_1) / (stddev_samp(return_lag_1) / sqrt(count(*))), 4) FROM srrow GROUP BY 1 UNION ALL SELECT 'ic_' || ticker, round(ic, 4) FROM st""",
    _CHECKS,
)
def _(m: Market):
    """All validation statistics from one counted table, as (check, value) rows."""
    from tapewire.functions.settle import settle

    c = settle(counts(m))
    hit = va.hit_rate(c, [], "return_lag_1", n="n").select(F.lit("hit_rate").alias("check"), F.col("overall").alias("value"))
    ic = va.ic_decay(c, [1, 2, 3, 5, 10], "n").select(F.concat(F.lit("ic_lag_"), F.col("lag").cast("string")).alias("check"), F.col("ic").alias("value"))
    t = va.conditional_ttest(c, "return_lag_1", "n").select(F.concat(F.lit("t_"), F.col("side")).alias("check"), F.col("t_stat").alias("value"))
    best = va.ic_by_ticker(c, "return_lag_1", "n").select(F.concat(F.lit("ic_"), F.col("ticker")).alias("check"), F.col("ic").alias("value"))
    return hit.unionByName(ic).unionByName(t).unionByName(best).withColumnRenamed("check", "check_name")
