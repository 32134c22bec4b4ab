"""Average ranks, exact quantiles and Spearman correlation without a single-task sort.

Inputs may hold counts of identical rows (column ``n``), so a hot value is one
row.  Two forms:

* ``bounded``: each key group is a cross-section or one ticker's history (at
  most tickers or days many rows); a plain window per key does it.
* unbounded: the counted values are range-partitioned by (keys, value), each range is counted, and a
  value's position is the offset of its range plus its position inside.  Ranges are cut by the values
  themselves, so dense or hot stretches are spread like any other.  The ranges are written once
  (``settle``), since the cut is sampled and both readers must see the same one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tapewire.functions.settle import settle
from tapewire.functions.stats import correlation_t

def value_positions(df: DataFrame, keys: list[str], col: str, n: str = "n", bounded: bool = False) -> DataFrame:
    """Per distinct value: count ``c``, first 0-based position ``lo`` in sorted order, group size ``size``."""
    counts = df.where(F.col(col).isNotNull()).groupBy(*keys, col).agg(F.sum(n).alias("c"))
    if bounded:
        by_value = W.partitionBy(*keys).orderBy(col).rowsBetween(W.unboundedPreceding, W.currentRow)
        return counts.withColumn("lo", F.sum("c").over(by_value) - F.col("c")).withColumn(
            "size", F.sum("c").over(W.partitionBy(*keys))
        )
    ranged = settle(counts.repartitionByRange(*keys, col).withColumn("_range", F.spark_partition_id()))
    # One row per key and range: bounded by the number of shuffle partitions.
    ranges = ranged.groupBy(*keys, "_range").agg(F.sum("c").alias("_n"))
    upto = W.partitionBy(*keys).orderBy("_range").rowsBetween(W.unboundedPreceding, W.currentRow)
    ranges = ranges.select(*keys, "_range", (F.sum("_n").over(upto) - F.col("_n")).alias("_before"), F.sum("_n").over(W.partitionBy(*keys)).alias("size"))
    inside = W.partitionBy(*keys, "_range").orderBy(col).rowsBetween(W.unboundedPreceding, W.currentRow)
    ranked = ranged.join(ranges, [*keys, "_range"])
    return ranked.select(*keys, col, "c", (F.col("_before") + F.sum("c").over(inside) - F.col("c")).alias("lo"), "size")


def average_rank(df: DataFrame, keys: list[str], col: str, n: str = "n", bounded: bool = False) -> DataFrame:
    """Keys, value, its average-tie rank (1-based) and the group size."""
    pos = value_positions(df, keys, col, n, bounded)
    return pos.select(*keys, col, (F.col("lo") + (F.col("c") + 1) / 2.0).alias("avg_rank"), "size")


def spearman(
    df: DataFrame, keys: list[str], x: str, y: str, n: str | None = None, bounded: bool = False, min_n: int = 2
) -> DataFrame:
    """Spearman correlation per key: keys, ``n``, ``ic`` (NULL when undefined) and ``t_stat``.

    Equal (x, y) rows are counted first.  Ranks are centred on their known mean
    (size+1)/2, so the moment sums do not cancel at large sizes.
    """
    flat = not keys
    if flat:
        df, keys = df.withColumn("_all", F.lit(0)), ["_all"]
    weight = F.col(n) if n else F.lit(1)
    points = (
        df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
        .groupBy(*keys, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
        .agg(F.sum(weight).alias("n"))
    )
    if bounded:
        size = F.sum("n").over(W.partitionBy(*keys))

        def centred(col: str) -> Column:
            upto = W.partitionBy(*keys).orderBy(col).rangeBetween(W.unboundedPreceding, W.currentRow)
            ties = F.sum("n").over(W.partitionBy(*keys, col))
            return F.sum("n").over(upto) - (ties - 1) / 2.0 - (size + 1) / 2.0

        ranked = points.select(*keys, "n", centred("x").alias("rx"), centred("y").alias("ry"))
    else:
        # Counted pairs are read three times below; settling them keeps the source scan single.
        points = settle(points)
        rx = average_rank(points, keys, "x").select(*keys, "x", (F.col("avg_rank") - (F.col("size") + 1) / 2.0).alias("rx"))
        ry = average_rank(points, keys, "y").select(*keys, "y", (F.col("avg_rank") - (F.col("size") + 1) / 2.0).alias("ry"))
        ranked = points.join(rx, [*keys, "x"]).join(ry, [*keys, "y"])
    moments = ranked.groupBy(*keys).agg(
        F.sum("n").alias("n"),
        F.sum(F.col("n") * F.col("rx") * F.col("ry")).alias("sxy"),
        F.sum(F.col("n") * F.col("rx") * F.col("rx")).alias("sxx"),
        F.sum(F.col("n") * F.col("ry") * F.col("ry")).alias("syy"),
    )
    spread = F.sqrt(F.col("sxx") * F.col("syy"))
    ic = F.when((F.col("n") >= min_n) & (spread > 0), F.col("sxy") / F.nullif(spread, F.lit(0.0)))
    out = moments.select(*keys, "n", ic.alias("ic")).withColumn("t_stat", correlation_t("ic", "n"))
    return out.drop("_all") if flat else out


def exact_quantiles(
    df: DataFrame, keys: list[str], col: str, probs: list[float], n: str = "n", bounded: bool = False
) -> DataFrame:
    """Linear-interpolation quantiles per key as an array column ``edges``.

    Only the values at the needed positions survive the aggregate.
    """
    pos = value_positions(df, keys, col, n, bounded)
    hi = F.col("lo") + F.col("c") - 1
    aggs = []
    for i, p in enumerate(probs):
        h = (F.col("size") - 1) * F.lit(float(p))
        low, up = F.floor(h), F.ceil(h)
        aggs.append(F.max(F.when((F.col("lo") <= low) & (hi >= low), F.col(col))).alias(f"a{i}"))
        aggs.append(F.max(F.when((F.col("lo") <= up) & (hi >= up), F.col(col))).alias(f"b{i}"))
        aggs.append(F.max(h - low).alias(f"f{i}"))
    cut = pos.groupBy(*keys).agg(*aggs)
    edge = [F.col(f"a{i}") + (F.col(f"b{i}") - F.col(f"a{i}")) * F.col(f"f{i}") for i in range(len(probs))]
    return cut.select(*keys, F.array(*edge).alias("edges"))


def bin_of(x: Column, edges: Column) -> Column:
    """1-based right-closed bin of ``x``; repeated edges collapse into fewer bins."""
    distinct = F.array_distinct(edges)
    return F.greatest(F.lit(1), F.size(F.filter(distinct, lambda e: e < x)))


def equal_frequency_bins(
    df: DataFrame, keys: list[str], col: str, bins: int, out: str = "bin", n: str | None = None, bounded: bool = False
) -> DataFrame:
    """Attach an equal-frequency bin.  The edges are one small row per key."""
    work = df.withColumn("_w", F.col(n) if n else F.lit(1))
    flat = not keys
    if flat:
        work, keys = work.withColumn("_all", F.lit(0)), ["_all"]
    edges = exact_quantiles(work, keys, col, [i / bins for i in range(bins + 1)], n="_w", bounded=bounded)
    joined = work.join(F.broadcast(edges) if flat else edges, keys)
    result = joined.withColumn(out, bin_of(F.col(col), F.col("edges"))).drop("edges", "_w")
    return result.drop("_all") if flat else result
