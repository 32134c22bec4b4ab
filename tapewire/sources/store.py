"""Tables on storage: snapshots, splits, metric sinks, run log, prediction cache."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tapewire.functions.settle import settle
from tapewire.operators.panel import pivot_panel, unpivot_panel
from tapewire.sources.keyed import KeyedTable

CACHE = "cache_key string, label_name string, confidence double"


def save_snapshot(tables: dict[str, DataFrame], path: str) -> None:
    """Write the tables as parquet and one metadata row with the news bounds."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
    meta = tables["news"].agg(F.min("date").alias("min_date"), F.max("date").alias("max_date"), F.count("*").alias("rows"))
    meta.coalesce(1).write.mode("overwrite").json(f"{path}/metadata")


def load_snapshot(spark: SparkSession, path: str, names: list[str], strict: bool = False) -> dict[str, DataFrame]:
    """Missing tables raise; strict mode also rejects empty ones."""
    tables = {n: spark.read.parquet(f"{path}/{n}") for n in names}
    if strict:
        for n, df in tables.items():
            if df.isEmpty():
                raise RuntimeError(f"empty table in strict mode: {n}")
    return tables


def save_wide_panel(prices: DataFrame, tickers: list[str], path: str, value: str = "close") -> None:
    pivot_panel(prices, tickers, value).write.mode("overwrite").option("header", True).csv(path)


def load_wide_panel(spark: SparkSession, path: str, tickers: list[str], value: str = "close") -> DataFrame:
    schema = "date DATE, " + ", ".join(f"`{t}` DOUBLE" for t in tickers)
    return unpivot_panel(spark.read.schema(schema).option("header", True).csv(path), value)


def save_splits(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").partitionBy("split").parquet(path)


def load_split(spark: SparkSession, path: str, split: str) -> DataFrame:
    return spark.read.parquet(path).where(F.col("split") == split)


def save_metric_table(df: DataFrame, path: str) -> None:
    """Small metric table as one CSV file with a header."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def flatten_class_metrics(metrics: DataFrame) -> DataFrame:
    """Overall row plus one row per class from a per-class map."""
    overall = metrics.select("model", F.lit("overall").alias("class"), "accuracy", "weighted_f1", "macro_f1")
    per = metrics.select("model", F.explode("per_class").alias("class", "v")).select("model", "class", "v.precision", "v.recall", "v.f1")
    return overall.unionByName(per, allowMissingColumns=True)


def save_json_report(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("overwrite").json(path)


def save_portfolio(results: DataFrame, ranked: DataFrame, path: str, run_id: str) -> None:
    """Archive under the run id, plus the latest copy and the ranked book."""
    for target in (f"{path}/archive/run={run_id}", f"{path}/latest"):
        results.write.mode("overwrite").option("header", True).csv(target)
    ranked.write.mode("overwrite").option("header", True).csv(f"{path}/ranked")


def load_portfolio(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of all archived runs, of the latest copy and of the ranked book, with their ``copy`` and ``run``."""

    def rows(part: str, kind: str, copy: str) -> DataFrame:
        return spark.read.schema(kind).option("header", True).csv(f"{path}/{part}").withColumn("copy", F.lit(copy))

    out = rows("archive", f"{schema}, run string", "archive")
    for part in ("latest", "ranked"):
        out = out.unionByName(rows(part, schema, part), allowMissingColumns=True)
    return out


HASH_LINES = 1 << 16


def content_hash(spark: SparkSession, path: str, block_lines: int = HASH_LINES) -> DataFrame:
    """One hash over the files of a folder, of any size: a hash tree over their lines.

    Leaves are SHA-256 of the bytes between line feeds, hashed where Spark reads them.  ``block_lines`` leaves
    in order make a block, a file's blocks and its length the file, and the files in path order the whole;
    each level hashes the hex digests below it.  Blocks go by the line's number in its file, which counts of
    lines per split give, so the hash does not depend on how Spark splits the files.  A file without line
    feeds is one row and must stay below 2 GB.  An empty folder has the hash of nothing.
    """
    meta = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"),
        F.col("_metadata.file_size").alias("size"),
        F.monotonically_increasing_id().alias("id"),
        F.sha2(F.col("value").cast("binary"), 256).alias("leaf"),
    )
    leaves = settle(meta)
    splits = leaves.groupBy("file", "start").agg(F.min("id").alias("first"), F.count("*").alias("lines"))
    # one row a split of some file: bounded by bytes over the split size
    before = W.partitionBy("file").orderBy("start").rowsBetween(W.unboundedPreceding, -1)
    splits = splits.select("file", "start", (F.coalesce(F.sum("lines").over(before), F.lit(0)) - F.col("first")).alias("shift"))
    numbered = leaves.join(splits, ["file", "start"]).withColumn("line", F.col("id") + F.col("shift"))

    def folded(order: str, col: str) -> Column:
        inside = F.sort_array(F.collect_list(F.struct(order, col)))
        return F.sha2(F.array_join(F.transform(inside, lambda x: x[col]), ""), 256)

    blocks = numbered.groupBy("file", "size", F.floor(F.col("line") / block_lines).alias("block")).agg(folded("line", "leaf").alias("digest"))
    files = blocks.groupBy("file", "size").agg(folded("block", "digest").alias("digest")).withColumn("digest", F.sha2(F.concat_ws(" ", "digest", "size"), 256))
    return files.agg(folded("file", "digest").alias("hash"))


STATES = "stage string, status string, code string, message string, timestamp_utc timestamp"


def state_rows(events: DataFrame, status: str, code: Column | str = "OK") -> DataFrame:
    """Run-log rows: ``events`` has the stage and, if there is one, the message; stamped with the job's time."""
    message = F.col("message") if "message" in events.columns else F.lit("")
    return events.select("stage", F.lit(status).alias("status"), (F.lit(code) if isinstance(code, str) else code).alias("code"), message.alias("message"), F.current_timestamp().alias("timestamp_utc"))


def load_states(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(STATES).parquet(path)


def append_state(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def error_code(message: Column) -> Column:
    """Error class from the exception text, first match wins."""
    low = F.lower(message)
    return (
        F.when(low.contains("coverage"), "INSUFFICIENT_COVERAGE")
        .when(low.contains("empty") | low.contains("missing") | low.contains("not found"), "MISSING_DATA")
        .when(low.contains("model"), "MODEL_ERROR")
        .otherwise("UNEXPECTED_ERROR")
    )


# ---- prediction cache -------------------------------------------------------


def cache_key(text: Column | str, model: str) -> Column:
    """SHA-256 of ``text|model`` in hex, whole: a shorter key would give texts each other's labels."""
    col = F.col(text) if isinstance(text, str) else text
    return F.sha2(F.concat_ws("|", col, F.lit(model)), 256)


def open_cache(spark: SparkSession, path: str, buckets: int = 64) -> KeyedTable:
    """The prediction cache: one row a key, in buckets by key."""
    return KeyedTable(spark, path, CACHE, ["cache_key"], buckets)


def score_with_cache(news: DataFrame, cache: KeyedTable, scorer: Callable[[DataFrame], DataFrame], model: str, text: str = "headline", version: int | None = None) -> DataFrame:
    """Scored news: only texts whose key is unknown reach the scorer, each once, and enter the cache.

    Only the buckets of the asked keys are read and rewritten.  ``version`` numbers the merge; texts that an
    earlier attempt under that number scored are scored again.
    """
    keyed = news.withColumn("cache_key", cache_key(text, model))
    asked = settle(keyed.groupBy("cache_key").agg(F.min(text).alias(text)))
    known = cache.lookup(asked, before=version).select("cache_key")
    cache.merge(scorer(asked.join(known, "cache_key", "left_anti")).select("cache_key", "label_name", "confidence"), version)
    after = None if version is None else version + 1
    return keyed.join(cache.lookup(asked, before=after), "cache_key", "left")
