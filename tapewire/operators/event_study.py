"""Market-model event study for all keywords (and sources) in one job.

The abnormal return around a day depends on (ticker, day) only, so it is
computed once per panel slot.  Headlines are reduced to counts per (keyword,
ticker, day) and joined to it; a keyword that hits a third of all headlines is
still at most days x tickers rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapewire import config
from tapewire import keyword_data as kd
from tapewire.functions.stats import t_two_sided_p
from tapewire.operators.calendar import as_of_forward
from tapewire.operators.keywords import match
from tapewire.operators.panel import at_offset, benchmark_returns, by_ticker, simple_returns


def abnormal_returns(panel: DataFrame, bench: DataFrame | None = None, window: tuple[int, int] = config.EVENT_WINDOW, estimation: int = config.ESTIMATION_DAYS) -> DataFrame:
    """(ticker, pos, ar_<day>..., car) for every slot with enough history and a complete window."""
    bench = benchmark_returns(panel) if bench is None else bench
    pre, post = window
    rows = simple_returns(panel).join(F.broadcast(bench), "pos", "left")
    pair = F.col("ret").isNotNull() & F.col("bench_ret").isNotNull()
    rows = rows.withColumn("_y", F.when(pair, F.col("ret"))).withColumn("_x", F.when(pair, F.col("bench_ret")))
    frame = by_ticker().rangeBetween(pre - estimation + 1, pre - 1)
    n = F.count("_x").over(frame)
    slope = F.when(F.var_pop("_x").over(frame) > 0, F.covar_pop("_y", "_x").over(frame) / F.nullif(F.var_pop("_x").over(frame), F.lit(0.0)))
    beta = F.coalesce(slope, F.lit(0.0))
    rows = rows.withColumn("_n", n).withColumn("_beta", beta)
    rows = rows.withColumn("_alpha", F.avg("_y").over(frame) - F.col("_beta") * F.avg("_x").over(frame))
    days = list(range(pre, post + 1))
    ret_at = {d: at_offset("ret", d) for d in days}
    # The benchmark has a value on every day but the first.
    bench_at = {d: F.coalesce(at_offset("_b0", d), F.lit(0.0)) for d in days}
    rows = rows.withColumn("_b0", F.col("bench_ret"))
    history = F.least(F.col("pos") + pre, F.lit(estimation))
    cols = [(ret_at[d] - (F.col("_alpha") + F.col("_beta") * bench_at[d])).alias(f"ar_{d}") for d in days]
    rows = rows.where("close is not null").select("ticker", "pos", "_n", history.alias("_h"), *cols)
    car = sum((F.col(f"ar_{d}") for d in days), F.lit(0.0))
    return rows.where("_n >= 5 and _h >= 10").select("ticker", "pos", *[f"ar_{d}" for d in days], car.alias("car")).where("car is not null")


def keyword_events(news: DataFrame, cal: DataFrame, keywords: list[str] | DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, keyword, ticker, pos, n): headlines containing a keyword, counted per entry day.

    ``keywords``: a list written in the program, or a table with a column ``keyword``.
    """
    hits = match(news.select(*keys, "ticker", "date", "headline"), keywords).groupBy(*keys, "keyword", "ticker", "date").agg(F.count("*").alias("n"))
    entered = as_of_forward(hits, cal).withColumnRenamed("entry_pos", "pos")
    return entered.groupBy(*keys, "keyword", "ticker", "pos").agg(F.sum("n").alias("n"))


def event_study(events: DataFrame, abnormal: DataFrame, keys: tuple[str, ...] = (), min_events: int = config.MIN_EVENTS_PER_KEYWORD) -> DataFrame:
    """Mean, spread and share positive of the CARs and the mean AR per day, per (keys, keyword).

    The spread is the population standard deviation.
    """
    days = [c for c in abnormal.columns if c.startswith("ar_")]
    group = [*keys, "keyword"]
    found = events.groupBy(*group).agg(F.sum("n").alias("headlines")).where(F.col("headlines") >= min_events)
    rows = events.join(abnormal, ["ticker", "pos"])
    n = F.col("n")
    agg = rows.groupBy(*group).agg(
        F.sum("n").alias("event_count"),
        F.sum(n * F.col("car")).alias("s"),
        F.sum(n * F.col("car") * F.col("car")).alias("ss"),
        F.sum(F.when(F.col("car") > 0, n).otherwise(0)).alias("pos_n"),
        *[(F.sum(n * F.col(d)) / F.sum("n")).alias(d) for d in days],
    )
    mean = F.col("s") / F.col("event_count")
    var = F.greatest(F.lit(0.0), F.col("ss") / F.col("event_count") - mean * mean)
    agg = agg.where(F.col("event_count") >= min_events).join(found.select(*group), group, "left_semi")
    return agg.select(
        *group,
        "event_count",
        F.round(mean, 6).alias("avg_CAR"),
        F.round(F.sqrt(var), 6).alias("std_CAR"),
        F.round(F.col("pos_n") / F.col("event_count"), 4).alias("positive_pct"),
        *days,
    )


def event_cars(events: DataFrame, abnormal: DataFrame, keys: tuple[str, ...] = (), min_events: int = config.MIN_EVENTS_PER_KEYWORD) -> DataFrame:
    """Counted CAR rows of every (keys, keyword) group that reaches the minimum."""
    group = [*keys, "keyword"]
    rows = events.join(abnormal.select("ticker", "pos", "car"), ["ticker", "pos"])
    enough = rows.groupBy(*group).agg(F.sum("n").alias("k")).where(F.col("k") >= min_events)
    return rows.join(enough.select(*group), group, "left_semi")


def source_comparison(cars: DataFrame) -> DataFrame:
    """Event count and mean CAR per source."""
    return cars.groupBy("source").agg(
        F.sum("n").alias("events"), F.round(F.sum(F.col("n") * F.col("car")) / F.sum("n"), 6).alias("avg_CAR")
    )


def _grade(n: Column, car: Column, p: Column, listed: Column) -> Column:
    size = F.abs(car)
    base = F.when((size > 0.01) & (p < 0.05) & (n >= 10), "A").when((size > 0.005) & (p < 0.10) & (n >= 5), "B").otherwise("C")
    return F.when(listed & (base == "C") & (size > 0.002), "B").otherwise(base)


def keyword_summary(study: DataFrame) -> DataFrame:
    """t statistic, p-value and grade per keyword."""
    n, std = F.col("event_count"), F.col("std_CAR")
    t = F.when((n >= 2) & (std > 0), F.col("avg_CAR") / (F.nullif(std, F.lit(0.0)) / F.sqrt(n)))
    rows = study.withColumn("_t", t).withColumn("_p", F.coalesce(t_two_sided_p("_t", n - 1), F.lit(1.0)))
    listed = F.col("keyword").isin(kd.FINANCE_PHRASES)
    return rows.select(
        "keyword",
        "event_count",
        "avg_CAR",
        "std_CAR",
        "positive_pct",
        F.coalesce(F.round("_t", 4), F.lit(0.0)).alias("t_stat"),
        F.round("_p", 4).alias("p_value"),
        _grade(n, F.col("avg_CAR"), F.col("_p"), listed).alias("signal_grade"),
        listed.alias("is_finance_phrase"),
    )


def car_heatmap(study: DataFrame, window: tuple[int, int] = config.EVENT_WINDOW, top: int = 10) -> DataFrame:
    """Top keywords by |mean CAR| with the mean AR of each event day as columns."""
    days = range(window[0], window[1] + 1)
    best = study.orderBy(F.desc(F.abs("avg_CAR")), "keyword").limit(top)
    return best.select("keyword", *[F.col(f"ar_{d}").alias(f"day_{'m' if d < 0 else 'p'}{abs(d)}") for d in days])
