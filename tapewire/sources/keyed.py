"""A table kept by key: a merge rewrites the buckets it touches and no others.

Rows lie in ``data/version=<v>/bucket=<b>``.  A merge writes its buckets whole under a new version and
then publishes them by appending one small file to the manifest, which names the newest version of each
bucket.  Readers go by the manifest, so a merge that fails before it is published changes nothing, and one
that is repeated under its old number (a replayed streaming batch) leaves what it left the first time.

There is one writer at a time.  Folders of older versions stay until ``copied`` writes the live rows to a
new table.  Choose ``buckets`` by the size of the table: a merge of k keys rewrites at most k buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapewire.functions.settle import settle

MANIFEST = "bucket int, version long"


class KeyedTable:
    """``keys`` identify a row; a null key part is a value like any other.

    ``bucket_by``: the keys (a part of them) that choose the bucket; rows are looked up by these.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: list[str], buckets: int = 64, bucket_by: list[str] | None = None) -> None:
        self.spark, self.path, self.keys, self.buckets = spark, path.rstrip("/"), keys, buckets
        self.bucket_by = bucket_by or keys
        self.schema = spark.createDataFrame([], schema).schema
        spark.createDataFrame([], MANIFEST).coalesce(1).write.mode("ignore").parquet(f"{self.path}/manifest")

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.bucket_by), F.lit(self.buckets)).cast("int")

    def published(self, before: int | None = None) -> dict[int, int]:
        """Newest version of each bucket, of the versions below ``before``; at most ``buckets`` entries."""
        rows = self.spark.read.schema(MANIFEST).parquet(f"{self.path}/manifest")
        if before is not None:
            rows = rows.where(F.col("version") < before)
        return {r["bucket"]: r["version"] for r in rows.groupBy("bucket").agg(F.max("version").alias("version")).collect()}

    def read(self, before: int | None = None) -> DataFrame:
        """All rows, as they were before a version."""
        return self._rows(self.published(before))

    def lookup(self, asked: DataFrame, before: int | None = None) -> DataFrame:
        """The rows whose ``bucket_by`` values occur in ``asked``; other buckets are not read."""
        some = asked.select(self.bucket_by).distinct()
        wanted = {r[0] for r in some.select(self.bucket()).distinct().collect()}
        live = self._rows({b: v for b, v in self.published(before).items() if b in wanted})
        return live.alias("live").join(some.alias("asked"), self._same(self.bucket_by, "live", "asked"), "left_semi")

    def merge(self, rows: DataFrame, version: int | None = None, order: list[str] | None = None) -> None:
        """New rows replace old ones of the same key.

        Of new rows with one key the one with the largest ``order`` columns stays, ties and no order going to
        the largest other columns, so that a key never has two rows.  Without a ``version`` the next one
        is taken.
        """
        names = self.schema.names
        others = [c for c in names if c not in self.keys]
        by = [*(order or []), *(c for c in others if c not in (order or []))]
        last = F.max(F.struct(*by)) if by else F.max(F.lit(True))
        fresh = settle(rows.groupBy(*self.keys).agg(last.alias("_last")).select(*[F.col(c) if c in self.keys else F.col(f"_last.{c}").alias(c) for c in names], self.bucket().alias("_bucket")))
        touched = sorted(r[0] for r in fresh.select("_bucket").distinct().collect())
        if not touched:
            return
        live = self.published(version)
        version = version if version is not None else max(self.published().values(), default=0) + 1
        old = self._rows({b: live[b] for b in touched if b in live})
        kept = old.alias("old").join(fresh.select(self.keys).alias("new"), self._same(self.keys, "old", "new"), "left_anti")
        out = kept.unionByName(fresh.drop("_bucket")).withColumn("bucket", self.bucket()).hint("rebalance", "bucket")
        out.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("bucket").parquet(f"{self.path}/data/version={version}")
        self._publish(touched, version)

    def copied(self, path: str, buckets: int | None = None) -> KeyedTable:
        """A new table of the live rows, without older versions."""
        out = KeyedTable(self.spark, path, self.schema.simpleString()[7:-1].replace(":", " "), self.keys, buckets or self.buckets, self.bucket_by)
        out.merge(self.read())
        return out

    def _publish(self, touched: list[int], version: int) -> None:
        self.spark.createDataFrame([(b, version) for b in touched], MANIFEST).coalesce(1).write.mode("append").parquet(f"{self.path}/manifest")

    def _rows(self, live: dict[int, int]) -> DataFrame:
        paths = [f"{self.path}/data/version={v}/bucket={b}" for b, v in sorted(live.items())]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    @staticmethod
    def _same(keys: list[str], a: str, b: str) -> Column:
        out = F.lit(True)
        for k in keys:
            out &= F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}"))
        return out
