"""Trading calendar: positions, as-of lookups and rebalance schedules.

A calendar has one row per trading day, so it is bounded by the number of days
in the history (about 25,000 rows per century).  That bound is why this module,
and only this module plus the literal rule tables, uses explicit broadcasts and
windows without a partition key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tapewire.functions.dates import weekday_ordinal


def trading_calendar(prices: DataFrame) -> DataFrame:
    """(date, pos): the sorted distinct trading dates with their 0-based position."""
    days = prices.select("date").distinct()
    return days.select("date", (F.row_number().over(W.orderBy("date")) - 1).alias("pos"))


def with_pos(df: DataFrame, cal: DataFrame, date: str = "date", pos: str = "pos") -> DataFrame:
    """Attach the position of an exact trading date; other dates drop out."""
    days = cal.select(F.col("date").alias(date), F.col("pos").alias(pos))
    return df.join(F.broadcast(days), date)


def forward_positions(days: DataFrame, cal: DataFrame, date: str = "date") -> DataFrame:
    """Map each distinct day to the first trading position on or after it.

    Works on distinct days only: the calendar and the days are unioned and the
    next position is carried back, so no range join is needed.  Days after the
    last trading date have no row.
    """
    wanted = days.select(F.col(date).alias("day")).distinct().withColumn("pos", F.lit(None).cast("int"))
    marks = cal.select(F.col("date").alias("day"), "pos").unionByName(wanted)
    ahead = W.orderBy("day").rangeBetween(W.currentRow, W.unboundedFollowing)
    mapped = marks.withColumn("entry_pos", F.min("pos").over(ahead)).where(F.col("pos").isNull())
    return mapped.where(F.col("entry_pos").isNotNull()).select(F.col("day").alias(date), "entry_pos").distinct()


def as_of_forward(df: DataFrame, cal: DataFrame, date: str = "date") -> DataFrame:
    """Attach ``entry_pos``; rows dated after the last trading day drop out."""
    return df.join(F.broadcast(forward_positions(df, cal, date)), date)


def as_of_backward(
    df: DataFrame, series: DataFrame, value: str, default: float, date: str = "date", out: str | None = None
) -> DataFrame:
    """Attach the last ``series`` value dated on or before each day, else ``default``.

    ``series`` is one value per day, so the lookup is resolved on distinct days.
    """
    out = out or value
    wanted = df.select(F.col(date).alias("day")).distinct().withColumn("v", F.lit(None).cast("double"))
    known = series.select(F.col("date").alias("day"), F.col(value).cast("double").alias("v"))
    marks = known.withColumn("asked", F.lit(0)).unionByName(wanted.withColumn("asked", F.lit(1)))
    behind = W.orderBy("day").rangeBetween(W.unboundedPreceding, W.currentRow)
    filled = marks.withColumn(out, F.last("v", ignorenulls=True).over(behind)).where("asked = 1")
    lookup = filled.select(F.col("day").alias(date), F.coalesce(F.col(out), F.lit(default)).alias(out))
    return df.join(F.broadcast(lookup), date, "left")


def rebalance_dates(days: DataFrame, keys: list[str], hold: Column | str = "hold_days") -> DataFrame:
    """Greedy schedule per key: keep a date when it lies ``hold`` weekdays after the last kept one.

    ``days`` has the key columns, ``date`` and the hold length.  The choice is
    sequential by definition, so each key folds over its sorted distinct dates;
    that array is bounded by the calendar, never by the news volume.
    Returns keys, ``date`` and the 1-based ``rebalance_no``.
    """
    hold_col = F.col(hold) if isinstance(hold, str) else hold
    slots = days.select(
        *keys,
        hold_col.alias("_hold"),
        F.struct(
            F.col("date").alias("d"),
            weekday_ordinal("date").alias("upto"),
            weekday_ordinal(F.date_sub("date", 1)).alias("before"),
        ).alias("_slot"),
    )
    arrays = slots.groupBy(*keys).agg(F.sort_array(F.collect_set("_slot")).alias("_slots"), F.max("_hold").alias("_hold"))

    def keep(acc: Column, slot: Column, hold_days: Column) -> Column:
        last = F.element_at(acc, -1)
        due = slot["upto"] - last["before"] - 1 >= hold_days
        return F.when(F.size(acc) == 0, F.array(slot)).when(due, F.concat(acc, F.array(slot))).otherwise(acc)

    folded = F.aggregate(
        F.col("_slots"),
        F.slice(F.col("_slots"), 1, 0),
        lambda acc, slot: keep(acc, slot, F.col("_hold")),
    )
    kept = arrays.select(*keys, F.posexplode(folded).alias("_i", "_kept"))
    return kept.select(*keys, F.col("_kept.d").alias("date"), (F.col("_i") + 1).alias("rebalance_no"))


def date_bounds(df: DataFrame, pad_days: int = 0, date: str = "date") -> DataFrame:
    """First and last date with the scan end padded by ``pad_days``."""
    return df.agg(F.min(date).alias("start"), F.date_add(F.to_date(F.max(date)), pad_days).alias("end"))


def explode_params(df: DataFrame, rows: list[dict]) -> DataFrame:
    """Pair every row with every parameter set, as a generator instead of a join."""
    if not rows:
        raise ValueError("empty parameter grid")
    structs = [F.struct(*[F.lit(v).alias(k) for k, v in r.items()]) for r in rows]
    return df.select("*", F.explode(F.array(*structs)).alias("_p")).select(*df.columns, "_p.*")
