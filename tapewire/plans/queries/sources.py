"""Sources and sinks.  Connectors read JSON built from the given tables; sinks write to the shared folder and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapewire import schemas as sc
from tapewire.functions.settle import ensure_checkpoint_dir
from tapewire.operators import keywords as kw
from tapewire.operators import ml
from tapewire.operators.lexicon import score_texts
from tapewire.plans.fixtures import Market
from tapewire.plans.queries.text import LEX_CTES
from tapewire.plans.registry import query
from tapewire.sources import news as sn
from tapewire.sources import store as so

NEWS = "date:t ticker headline source"


def folder(m: Market) -> str:
    return f"{ensure_checkpoint_dir(m.spark)}/tables/{uuid.uuid4().hex}"


def parse(df: DataFrame, schema) -> DataFrame:
    """Through JSON text and back, as a landed file would arrive."""
    return df.select(F.from_json(F.to_json(F.struct(*df.columns)), schema).alias("j")).select("j.*")


def iso(col: str = "date") -> Column:
    return F.date_format(col, "yyyy-MM-dd'T'00:00:00'Z'")


@query("SRC01_news_csv", NEWS + " n:i", "news", "SELECT date, ticker, headline, source, count(*) AS n FROM news GROUP BY ALL")
def _(m: Market):
    path = folder(m)
    m.news.select(F.col("date").cast("timestamp").alias("date"), "ticker", "headline", "source").write.option("header", True).csv(path)
    return sn.read_news_csv(m.spark, path).groupBy("date", "ticker", "headline", "source").agg(F.count("*").alias("n"))


@query("SRC02_external_columns", NEWS + " n:i", "news", "SELECT date, ticker, headline, 'fnspid' AS source, count(*) AS n FROM news GROUP BY ALL")
def _(m: Market):
    raw = m.news.select(F.col("date").cast("string").alias("Published_At"), F.col("ticker").alias("SYMBOL"), F.col("headline").alias("Title"))
    return sn.to_news_schema(sn.align_columns(raw), "fnspid").groupBy("date", "ticker", "headline", "source").agg(F.count("*").alias("n"))


@query(
    "SRC03_enforce_schema",
    "date:t source n:i",
    "news",
    "SELECT CASE WHEN source <> 'reddit' THEN date END AS date, 'x' AS source, count(*) AS n FROM news GROUP BY ALL",
)
def _(m: Market):
    broken = F.when(F.col("source") == "reddit", "not a date").otherwise(F.col("date").cast("string"))
    return sn.to_news_schema(m.news.withColumn("date", broken), "x").groupBy("date", "source").agg(F.count("*").alias("n"))


@query(
    "SRC04_empty_relation",
    "source n:i empty_rows:i fields",
    "news",
    "SELECT source, count(*) AS n, 0 AS empty_rows, 'date:timestamp,ticker:string,headline:string,source:string' AS fields FROM news GROUP BY 1",
)
def _(m: Market):
    """A connector whose folder is absent gives the typed empty relation, which unions with any news."""
    none = sn.load_landed(m.spark, "nyt", f"{folder(m)}/absent")
    stamped = m.news.withColumn("date", F.col("date").cast("timestamp")).select("date", "ticker", "headline", "source")
    fields = ",".join(f"{n}:{t}" for n, t in none.dtypes)
    return none.unionByName(stamped).groupBy("source").agg(F.count("*").alias("n")).withColumns({"empty_rows": F.lit(none.count()), "fields": F.lit(fields)})


_UNIQ = "SELECT DISTINCT headline, '{s}' AS source FROM news"


@query("SRC05_feed_json", "headline source", "news", _UNIQ.format(s="yahoo_finance"))
def _(m: Market):
    nested = F.struct(F.col("headline").alias("title"), iso().alias("pubDate"), F.lit(None).cast("string").alias("displayTime"))
    flat = F.col("source").isin("reddit", "newsapi")
    raw = m.news.select(
        "ticker",
        F.when(flat, F.col("headline")).alias("title"),
        F.lit(None).cast("string").alias("pubDate"),
        F.lit(None).cast("string").alias("displayTime"),
        F.when(flat, F.unix_timestamp(F.col("date").cast("timestamp"))).alias("providerPublishTime"),
        F.when(~flat, nested).alias("content"),
    )
    return sn.flatten_feed(parse(raw, sc.FEED_JSON)).where("date is not null")


@query("SRC06_guardian_json", "headline source", "news", _UNIQ.format(s="guardian"))
def _(m: Market):
    item = F.struct(F.col("headline").alias("webTitle"), iso().alias("webPublicationDate"), F.struct(F.when(F.col("source") == "reddit", F.col("headline")).alias("headline")).alias("fields"))
    return sn.flatten_guardian(parse(m.news.select("ticker", F.struct(F.array(item).alias("results")).alias("response")), sc.GUARDIAN_JSON))


@query("SRC07_nyt_json", "headline source", "news", _UNIQ.format(s="nyt"))
def _(m: Market):
    item = F.struct(F.struct(F.col("headline").alias("main")).alias("headline"), iso().alias("pub_date"))
    return sn.flatten_nyt(parse(m.news.select("ticker", F.struct(F.array(item).alias("docs")).alias("response")), sc.NYT_JSON))


@query("SRC08_newsapi_json", NEWS + " n:i", "news", "SELECT date, ticker, headline, 'newsapi' AS source, count(*) AS n FROM news WHERE source <> 'reddit' GROUP BY ALL")
def _(m: Market):
    title = F.when(F.col("source") == "reddit", "[Removed] gone").otherwise(F.concat(F.lit("  "), F.col("headline")))
    item = F.struct(title.alias("title"), iso().alias("publishedAt"))
    rows = sn.flatten_newsapi(parse(m.news.select("ticker", F.array(item).alias("articles")), sc.NEWSAPI_JSON))
    return rows.groupBy("date", "ticker", "headline", "source").agg(F.count("*").alias("n"))


@query("SRC09_compact_date_json", NEWS + " n:i", "news", "SELECT date, ticker, headline, 'gdelt' AS source, count(*) AS n FROM news WHERE source <> 'reddit' GROUP BY ALL")
def _(m: Market):
    seen = F.when(F.col("source") == "reddit", "n/a").when(F.col("source") == "newsapi", F.date_format("date", "yyyyMMdd")).otherwise(F.date_format("date", "yyyyMMdd'T'000000'Z'"))
    item = F.struct(F.col("headline").alias("title"), seen.alias("seendate"), F.lit("u").alias("url"), F.lit("d").alias("domain"))
    rows = sn.flatten_gdelt(parse(m.news.select("ticker", F.array(item).alias("articles")), sc.GDELT_JSON))
    return rows.groupBy("date", "ticker", "headline", "source").agg(F.count("*").alias("n"))


@query(
    "SRC10_filing_hits",
    "date:t ticker headline n:i",
    "news",
    "SELECT date, ticker, ticker || ' 8-K item 2.02 filing: ' || CASE WHEN source = 'reddit' THEN ticker ELSE source END AS headline, count(*) AS n FROM news GROUP BY ALL",
)
def _(m: Market):
    names = F.when(F.col("source") != "reddit", F.col("source"))
    day = F.col("date").cast("string")
    hit = F.struct(F.struct(F.when(F.col("source") == "guardian", day).alias("file_date"), day.alias("period_of_report"), names.alias("display_names")).alias("_source"))
    raw = m.news.select("ticker", F.lit("2.02").alias("item"), F.struct(F.array(hit).alias("hits")).alias("hits"))
    return sn.flatten_filings(parse(raw, sc.FILINGS_JSON)).groupBy("date", "ticker", "headline").agg(F.count("*").alias("n"))


@query(
    "SRC11_feed_entries",
    "ticker headline",
    "news",
    """SELECT DISTINCT k AS ticker, headline FROM news JOIN (VALUES ('GS', '(?i)\\b(GS|Goldman Sachs)\\b'), ('B3', '(?i)\\b(B3|Brand#3)\\b')) v(k, p) ON regexp_matches(headline, p)""",
)
def _(m: Market):
    entries = m.news.select(F.col("headline").alias("title"), F.lit(None).cast("string").alias("summary"), F.when(F.col("source") != "reddit", F.col("date").cast("timestamp")).alias("published"))
    return sn.flatten_entries(entries, "feed", m.now, {"GS": ["Goldman Sachs"], "B3": ["Brand#3"]})


_TICKERS = [f"Brand#{i}" for i in range(1, 26)]


@query("SRC12_wide_snapshot_scan", "date:t ticker close:d", "px", "SELECT date, ticker, close FROM px")
def _(m: Market):
    path = folder(m)
    so.save_wide_panel(m.px, _TICKERS, path)
    return so.load_wide_panel(m.spark, path, _TICKERS)


@query("SRC13_snapshot_round_trip", "min_date:t max_date:t rows:i", "news", "SELECT min(date) AS min_date, max(date) AS max_date, count(*) AS rows FROM news")
def _(m: Market):
    path = folder(m)
    so.save_snapshot({"news": m.news, "prices": m.px}, path)
    so.load_snapshot(m.spark, path, ["news", "prices"], strict=True)
    return m.spark.read.schema("min_date date, max_date date, rows long").json(f"{path}/metadata")


@query("SRC14_split_round_trip", "label_name n:i", "scored", "SELECT label_name, count(*) AS n FROM scored GROUP BY 1")
def _(m: Market):
    path = folder(m)
    so.save_splits(ml.stratified_split(m.scored, "label_name", "headline", "headline_id"), path)
    parts = [so.load_split(m.spark, path, s) for s in ("train", "val", "test")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("label_name").agg(F.count("*").alias("n"))


@query("SRC18_cache_merge", "label_name n:i", "scored", "SELECT label_name, count(*) AS n FROM (SELECT headline, max(CASE WHEN source = 'reddit' THEN 'new' ELSE 'old' END) AS l0, CASE WHEN bool_or(source = 'reddit') THEN 'new' ELSE 'old' END AS label_name FROM scored GROUP BY 1) GROUP BY 1")
def _(m: Market):
    keyed = m.scored.select(so.cache_key("headline", "m").alias("cache_key"), "confidence", "source")
    old = keyed.where("source <> 'reddit'").select("cache_key", F.lit("old").alias("label_name"), "confidence")
    new = keyed.where("source = 'reddit'").select("cache_key", F.lit("new").alias("label_name"), "confidence")
    cache = so.open_cache(m.spark, folder(m), 8)
    cache.merge(old, order=["confidence"])
    cache.merge(new, order=["confidence"])
    return cache.read().groupBy("label_name").agg(F.count("*").alias("n"))


@query(
    "SRC19_usable_keyword_weights",
    "keyword avg_CAR:d",
    "news",
    "SELECT keyword, avg_CAR FROM (SELECT source AS keyword, (count(*) % 17 - 8) / 1000.0::DOUBLE AS avg_CAR, CASE WHEN count(*) % 3 = 0 THEN 'A' WHEN count(*) % 3 = 1 THEN 'B' ELSE 'C' END AS g FROM news GROUP BY source, ticker) WHERE g <> 'C' AND abs(avg_CAR) >= 0.003",
)
def _(m: Market):
    n = F.count("*")
    rows = m.news.groupBy("source", "ticker").agg(((n % 17 - 8) / 1000.0).alias("avg_CAR"), F.when(n % 3 == 0, "A").when(n % 3 == 1, "B").otherwise("C").alias("signal_grade"))
    return kw.usable_weights(rows.withColumnRenamed("source", "keyword"))


@query("SRC20_observations", "series date:t value:d", "macro", "SELECT series, date, value FROM macro WHERE value < 1000")
def _(m: Market):
    text = F.when(F.col("value") < 1000, F.col("value").cast("string")).otherwise(".")
    item = F.struct(F.col("date").cast("string").alias("date"), text.alias("value"))
    return sn.flatten_observations(parse(m.macro.select("series", F.array(item).alias("observations")), sc.OBSERVATIONS_JSON))


@query("SRC21_price_panel", "ticker days:i volume:d2", "px", "SELECT ticker, count(*) AS days, sum(volume) AS volume FROM px GROUP BY 1")
def _(m: Market):
    ghost = m.px.select("date", F.lit("GHOST").alias("ticker"), F.lit(None).cast("double").alias("close"), F.lit(None).cast("double").alias("volume"))
    from tapewire.operators.panel import price_panel

    return price_panel(m.px.unionByName(ghost), m.cal).groupBy("ticker").agg(F.count("*").alias("days"), F.sum("volume").alias("volume"))


@query(
    "SRC25_run_states",
    "stage status code n:i stamped:i",
    "news",
    """SELECT source AS stage, 'failed' AS status, CASE WHEN contains(t, 'coverage') THEN 'INSUFFICIENT_COVERAGE' WHEN contains(t, 'missing') OR contains(t, 'empty') OR contains(t, 'not found') THEN 'MISSING_DATA' WHEN contains(t, 'model') THEN 'MODEL_ERROR' ELSE 'UNEXPECTED_ERROR' END AS code,
 count(*) AS n, count(*) AS stamped FROM (SELECT source, lower(headline) || CASE headline_id % 4 WHEN 0 THEN ' missing' WHEN 1 THEN ' coverage' WHEN 2 THEN ' model' ELSE '' END AS t FROM news) GROUP BY 1, 2, 3 UNION ALL
 SELECT source, 'started', 'OK', 1, 1 FROM (SELECT DISTINCT source FROM news)""",
)
def _(m: Market):
    """Two appends to the run log: the stages' starts, then an error for each headline; read back and counted."""
    path = folder(m)
    tails = F.when(F.pmod("headline_id", F.lit(4)) == 0, " missing").when(F.pmod("headline_id", F.lit(4)) == 1, " coverage").when(F.pmod("headline_id", F.lit(4)) == 2, " model").otherwise("")
    text = F.concat("headline", tails)
    so.append_state(so.state_rows(m.news.select(F.col("source").alias("stage")).distinct(), "started"), path)
    so.append_state(so.state_rows(m.news.select(F.col("source").alias("stage"), text.alias("message")), "failed", so.error_code(F.col("message"))), path)
    return so.load_states(m.spark, path).groupBy("stage", "status", "code").agg(F.count("*").alias("n"), F.count("timestamp_utc").alias("stamped"))


@query("SF03_cache_key", "headline cache_key", "news", "SELECT DISTINCT headline, sha256(headline || '|m') AS cache_key FROM news")
def _(m: Market):
    return m.news.select("headline").distinct().withColumn("cache_key", so.cache_key("headline", "m"))


@query(
    "JN11_cached_scoring",
    "label_name n:i",
    "scored",
    "SELECT CASE WHEN headline IN (SELECT headline FROM scored WHERE source = 'reddit') THEN 'cached' ELSE 'fresh' END AS label_name, count(*) AS n FROM scored GROUP BY 1",
)
def _(m: Market):
    known = m.scored.where("source = 'reddit'").select(so.cache_key("headline", "m").alias("cache_key"), F.lit("cached").alias("label_name"), F.lit(1.0).alias("confidence"))
    fresh = lambda df: df.withColumn("label_name", F.lit("fresh")).withColumn("confidence", F.lit(0.5))
    cache = so.open_cache(m.spark, folder(m), 8)
    cache.merge(known)
    scored = so.score_with_cache(m.news.select("headline_id", "headline"), cache, fresh, "m")
    return scored.groupBy("label_name").agg(F.count("*").alias("n"))


@query(
    "ML01_batch_scoring",
    "label_name n:i",
    "news",
    "SELECT CASE WHEN 0.6 * normalised_score > 0.05 THEN 'positive' WHEN 0.6 * normalised_score < -0.05 THEN 'negative' ELSE 'neutral' END AS label_name, count(*) AS n FROM lexnews GROUP BY 1",
    LEX_CTES,
)
def _(m: Market):
    scorer = ml.lexicon_scorer()
    return scorer(m.news.select("headline_id", "headline")).groupBy("label_name").agg(F.count("*").alias("n"))


@query(
    "UDF01_pluggable_scorer",
    "label_name n:i",
    "news",
    "SELECT CASE WHEN length(headline) % 2 = 0 THEN 'positive' ELSE 'negative' END AS label_name, count(*) AS n FROM news GROUP BY 1",
)
def _(m: Market):
    def load():
        import pandas as pd

        def predict(texts):
            even = texts.str.len() % 2 == 0
            return pd.DataFrame({"label_name": even.map({True: "positive", False: "negative"}), "confidence": 0.9})

        return predict

    return ml.batch_scorer(load)(m.news.select("headline_id", "headline")).groupBy("label_name").agg(F.count("*").alias("n"))


@query(
    "UDF05_phrase_rows",
    "headline phrase",
    "news",
    "SELECT headline, unnest(list_concat(bull, bear)) AS phrase FROM lexed",
    LEX_CTES,
)
def _(m: Market):
    rows = score_texts(m.news.select("headline").distinct())
    return rows.select("headline", F.explode_outer(F.concat("matched_bullish", "matched_bearish")).alias("phrase")).where("phrase is not null")
