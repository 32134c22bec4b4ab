"""News connectors: landed JSON and CSV to the four-column news schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapewire import config
from tapewire import schemas as sc
from tapewire.operators.keywords import match_tickers

# Column names accepted by the external headline loader (fixed values).
COLUMN_ALIASES = {
    "date": ["date", "datetime", "published_at", "publishedat"],
    "ticker": ["ticker", "symbol", "stock"],
    "headline": ["headline", "title", "text", "news"],
}


def read_news_csv(spark: SparkSession, path: str) -> DataFrame:
    """Combined news table; a missing path raises at once."""
    return spark.read.schema(sc.NEWS).option("header", True).csv(path)


def empty_news(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], sc.NEWS)


def to_news_schema(df: DataFrame, source: str | Column) -> DataFrame:
    """Cast any frame with date, ticker, headline to the news schema; unreadable dates become NULL."""
    date = F.col("date") if dict(df.dtypes)["date"].startswith("timestamp") else F.try_to_timestamp(F.col("date").cast("string"))
    return df.select(
        date.cast("timestamp").alias("date"),
        F.col("ticker").cast("string").alias("ticker"),
        F.col("headline").cast("string").alias("headline"),
        (F.lit(source) if isinstance(source, str) else source).alias("source"),
    )


def align_columns(df: DataFrame) -> DataFrame:
    """Rename known column variants; raise when one of date, ticker, headline is missing."""
    target = {alias: name for name, aliases in COLUMN_ALIASES.items() for alias in aliases}
    found: dict[str, str] = {}
    for col in df.columns:
        name = target.get(col.lower())
        if name and name not in found:
            found[name] = col
    missing = set(COLUMN_ALIASES) - set(found)
    if missing:
        raise ValueError(f"missing columns: {sorted(missing)}")
    return df.select(*[F.col(c).alias(n) for n, c in found.items()])


def load_external(spark: SparkSession, path: str, source: str = "fnspid") -> DataFrame:
    return to_news_schema(align_columns(spark.read.option("header", True).csv(path)), source)


def _unique(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.dropDuplicates(keys)


def flatten_feed(raw: DataFrame, source: str = "yahoo_finance") -> DataFrame:
    """Flat or nested feed items; date from pubDate, displayTime or epoch seconds."""
    title = F.trim(F.coalesce("content.title", "title"))
    text_date = F.coalesce("content.pubDate", "content.displayTime", "pubDate", "displayTime")
    date = F.coalesce(F.try_to_timestamp(text_date), F.timestamp_seconds("providerPublishTime"))
    rows = raw.select(date.alias("date"), "ticker", title.alias("headline")).where("headline <> ''")
    return _unique(to_news_schema(rows, source), ["headline"])


def flatten_guardian(raw: DataFrame, source: str = "guardian") -> DataFrame:
    rows = raw.select("ticker", F.explode("response.results").alias("r"))
    rows = rows.select(F.try_to_timestamp("r.webPublicationDate").alias("date"), "ticker", F.coalesce("r.fields.headline", "r.webTitle").alias("headline"))
    return _unique(to_news_schema(rows, source), ["headline"])


def flatten_nyt(raw: DataFrame, source: str = "nyt") -> DataFrame:
    rows = raw.select("ticker", F.explode("response.docs").alias("d"))
    rows = rows.select(F.try_to_timestamp("d.pub_date").alias("date"), "ticker", F.col("d.headline.main").alias("headline"))
    return _unique(to_news_schema(rows, source), ["headline"])


def flatten_newsapi(raw: DataFrame, source: str = "newsapi") -> DataFrame:
    rows = raw.select("ticker", F.explode("articles").alias("a"))
    rows = rows.select(F.try_to_timestamp("a.publishedAt").alias("date"), "ticker", F.trim("a.title").alias("headline"))
    return to_news_schema(rows.where("headline <> '' and not contains(headline, '[Removed]')"), source)


def flatten_gdelt(raw: DataFrame, source: str = "gdelt") -> DataFrame:
    """Compact timestamps, else the first eight digits as a date, else the row is dropped."""
    rows = raw.select("ticker", F.explode("articles").alias("a"))
    seen = F.col("a.seendate")
    date = F.coalesce(
        F.try_to_timestamp(seen, F.lit("yyyyMMdd'T'HHmmssX")), F.try_to_timestamp(F.substring(seen, 1, 8), F.lit("yyyyMMdd"))
    )
    rows = rows.select(date.alias("date"), "ticker", F.trim("a.title").alias("headline"))
    return to_news_schema(rows.where("headline <> '' and lower(headline) <> '[removed]' and date is not null"), source)


def flatten_filings(raw: DataFrame, source: str = "sec_edgar") -> DataFrame:
    rows = raw.select("ticker", "item", F.explode("hits.hits").alias("h"))
    names = F.coalesce("h._source.display_names", "ticker")
    base = F.format_string("%s 8-K item %s filing", "ticker", "item")
    rows = rows.select(
        F.coalesce("h._source.file_date", "h._source.period_of_report").alias("date"),
        "ticker",
        F.when(names != "", F.concat(base, F.lit(": "), names)).otherwise(base).alias("headline"),
    )
    return to_news_schema(rows, source)


def flatten_entries(entries: DataFrame, source: str, today: Column, aliases: dict[str, list[str]] | None = None) -> DataFrame:
    """Feed entries matched to tickers; a missing date becomes ``today``."""
    rows = match_tickers(entries, aliases or config.TICKER_ALIASES)
    rows = rows.select(F.coalesce("published", today).alias("date"), "ticker", F.trim("title").alias("headline"))
    return _unique(to_news_schema(rows, source), ["ticker", "headline"])


def flatten_observations(raw: DataFrame) -> DataFrame:
    """Observation lists to (series, date, value); non-numeric values drop out."""
    rows = raw.select("series", F.explode("observations").alias("o"))
    return rows.select("series", F.to_date("o.date").alias("date"), F.expr("try_cast(o.value as double)").alias("value")).where("value is not null")


CONNECTORS = {
    "yahoo_finance": (sc.FEED_JSON, flatten_feed),
    "guardian": (sc.GUARDIAN_JSON, flatten_guardian),
    "nyt": (sc.NYT_JSON, flatten_nyt),
    "newsapi": (sc.NEWSAPI_JSON, flatten_newsapi),
    "gdelt": (sc.GDELT_JSON, flatten_gdelt),
    "sec_edgar": (sc.FILINGS_JSON, flatten_filings),
}


def load_landed(spark: SparkSession, name: str, path: str) -> DataFrame:
    """Read one connector's landed JSON lines; an absent folder gives the typed empty table."""
    schema, flatten = CONNECTORS[name]
    try:
        raw = spark.read.schema(schema).json(path)
    except Exception as exc:  # noqa: BLE001
        if "PATH_NOT_FOUND" in str(exc):
            return empty_news(spark)
        raise
    return flatten(raw)
