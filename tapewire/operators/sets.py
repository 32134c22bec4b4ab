"""Unions, ordered de-duplication and other set operations on news tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tapewire import config
from tapewire.schemas import NEWS


def drop_blank(news: DataFrame) -> DataFrame:
    return news.where("headline is not null and date is not null and trim(headline) <> ''")


def fixed_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """Project to a fixed list; a missing column becomes NULL."""
    return df.select(*[F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in columns])


def keep_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """First row per key in the given order (``dropDuplicates`` has no order).

    ``row_number = 1`` is pruned map-side, so a hot key sends one row per task.
    """
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def source_weight(source: Column | str, weights: dict[str, float] | None = None) -> Column:
    table = weights or config.SOURCE_WEIGHTS
    lookup = F.create_map(*[F.lit(v) for kv in table.items() for v in kv])
    col = F.col(source) if isinstance(source, str) else source
    return F.coalesce(F.try_element_at(lookup, col), F.lit(config.DEFAULT_SOURCE_WEIGHT))


def drop_syndicated(news: DataFrame, keys: list[str] | None = None, prefix: int | None = None) -> DataFrame:
    """One row per lower-case headline: the most credible source wins.

    The duplicate key is the digest of the whole headline, or of its first ``prefix`` characters where a
    feed cuts its headlines.
    """
    head = F.lower("headline") if prefix is None else F.substring(F.lower("headline"), 1, prefix)
    rows = news.withColumn("_head", F.sha2(head, 256)).withColumn("_w", source_weight("source"))
    order = [F.desc("_w"), F.desc("date"), F.col("headline")]
    if "headline_id" in news.columns:
        order.append(F.col("headline_id"))
    return keep_first(rows, [*(keys or []), "_head"], order).drop("_head", "_w")


def ticker_headlines(news: DataFrame, ticker: str) -> DataFrame:
    """One ticker's headlines (any case), one row per text, newest first."""
    rows = news.where((F.upper("ticker") == ticker.upper()) & F.col("headline").isNotNull() & F.col("date").isNotNull())
    return keep_first(rows, ["headline"], [F.desc("date")]).orderBy(F.desc("date"))


def source_counts(news: DataFrame) -> DataFrame:
    return news.groupBy("source").agg(F.count("*").alias("n"))


def source_breakdown(news: DataFrame) -> DataFrame:
    """Map source -> count per ticker, built from counts so its size is the number of sources."""
    per = news.groupBy("ticker", "source").agg(F.count("*").alias("n"))
    return per.groupBy("ticker").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("source", "n")))).alias("source_breakdown"))


def combine_sources(frames: list[DataFrame]) -> DataFrame:
    """Union of sources in the news schema, blank rows dropped.  Sort at the sink with ``newest_first``."""
    columns = NEWS.fieldNames()
    out = frames[0].select(*columns)
    for frame in frames[1:]:
        out = out.unionByName(frame.select(*columns))
    return drop_blank(out)


def newest_first(news: DataFrame) -> DataFrame:
    return news.orderBy(F.desc("date"))


def merge_sentences(frames: list[DataFrame], order: list[Column], seed: int | None = None) -> DataFrame:
    """Union of labelled corpora with one row per text; a seed adds a repeatable shuffled order."""
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    out = keep_first(out, ["text"], order)
    return out if seed is None else out.orderBy(F.xxhash64("text", F.lit(seed)))


def expand_news(existing: DataFrame, added: list[DataFrame], tie: list[Column] | None = None) -> DataFrame:
    """Existing table plus new batches, earliest date per (ticker, headline)."""
    out = existing
    for frame in added:
        out = out.unionByName(frame, allowMissingColumns=True)
    return keep_first(drop_blank(out), ["ticker", "headline"], [F.col("date"), *(tie or [])])


def missing_tickers(universe: DataFrame, news: DataFrame) -> DataFrame:
    return universe.join(news.select("ticker").distinct(), "ticker", "left_anti")


def overlap_counts(df: DataFrame, keys: list[str], item: str, is_left: Column) -> DataFrame:
    """Sizes of intersection and symmetric difference of two item sets, by membership flags."""
    flags = df.groupBy(*keys, item).agg(F.bool_or(is_left).alias("a"), F.bool_or(~is_left).alias("b"))
    return flags.groupBy(*keys).agg(
        F.count_if(F.col("a") & F.col("b")).alias("in_both"), F.count_if(F.col("a") != F.col("b")).alias("only_one")
    )


def union_optional(frames: list[DataFrame | None]) -> DataFrame:
    present = [f for f in frames if f is not None]
    out = present[0]
    for frame in present[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out


def strata_key(label: str, text: str, id_col: str | None, seed: int) -> Column:
    """A seeded MD5 of a row's label, text and id, as every engine computes it."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (label, text, id_col) if c]
    return F.md5(F.concat_ws("|", *parts, F.lit(str(seed))).cast("binary"))


def sample_per_class(df: DataFrame, label: str, text: str, total: int, classes: int = 3, seed: int = config.RANDOM_SEED, id_col: str | None = None) -> DataFrame:
    """Up to total/classes rows per class, the first by a seeded MD5, so a rerun picks the same rows.

    Picked in two steps, first inside 64 slices of each class, so a dominant
    class is never ordered in one task.
    """
    size = total // classes
    rows = df.withColumn("_key", strata_key(label, text, id_col, seed)).withColumn("_slice", F.conv(F.substring("_key", 1, 2), 16, 10).cast("int") % 64)
    for keys in ([label, "_slice"], [label]):
        w = W.partitionBy(*keys).orderBy("_key")
        rows = rows.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= size).drop("_rn")
    return rows.drop("_slice", "_key")
