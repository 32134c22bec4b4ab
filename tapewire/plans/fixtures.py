"""Market views over the given tables.

The tables hold orders and line items, not news and prices.  These views map
them: line items become daily prices per brand, orders become headlines,
monthly and daily totals become macro and commodity series.  All views are
lazy; each is a plain projection or aggregate of the whole table, so the work
grows with it.  Money is summed in whole cents so every engine and every
partitioning gives the same number.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapewire.functions.labels import signal_of
from tapewire.functions.settle import settle
from tapewire.operators.calendar import trading_calendar
from tapewire.operators.panel import price_panel

# Texts that name the terms which the lexicon and the keyword studies look for.
TEMPLATES = [
    "{ticker}: record earnings in the quarter",
    "Revenue of {ticker} falls short as margins slip",
    "{ticker} raises guidance for the year",
    "Board of {ticker} approves share buyback",
    "Regulator opens investigation into {ticker}",
    "{ticker} plans restructuring, finance chief leaves",
    "Strong growth lifts earnings at {ticker}",
    "{ticker} lowers dividend to keep cash",
    "{ticker} closes acquisition of a supplier",
    "Weak guidance sends {ticker} down",
    "Pressure on profit at {ticker} amid losses",
    "{ticker} sees revenue ahead of plan",
    "{ticker} starts cost programme and restructuring",
    "{ticker} upgraded after strong results",
    "Antitrust investigation names {ticker}",
]
SOURCES = {
    "1-URGENT": "sec_edgar",
    "2-HIGH": "reuters",
    "3-MEDIUM": "guardian",
    "4-NOT SPECIFIED": "newsapi",
    "5-LOW": "reddit",
}
LABELS = {"F": "negative", "O": "neutral", "P": "positive"}
KEYWORDS = ["investigation", "guidance", "share buyback", "restructuring", "dividend", "earnings", "upgraded", "acquisition"]
SERIES = ["cpi", "unemployment", "payrolls", "gdp", "fed_funds", "yield_10yr", "yield_2yr"]
# Base and step of each macro series: value = base + step * (cents mod 1000).
SERIES_SCALE = {
    "cpi": (250.0, 0.02),
    "unemployment": (3.0, 0.005),
    "payrolls": (100.0, 0.3),
    "gdp": (100.0, 0.01),
    "fed_funds": (0.0, 0.006),
    "yield_10yr": (1.0, 0.005),
    "yield_2yr": (1.0, 0.005),
}
COMMODITIES = ["oil", "gas", "copper", "gold"]
COMMODITY_SCALE = {"oil": (70.0, 0.03), "gas": (3.0, 0.001), "copper": (4.0, 0.0004), "gold": (1900.0, 0.1)}


def _lookup(mapping: dict[str, str], col: str) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(v) for kv in mapping.items() for v in kv]), F.col(col))


class Market:
    """Lazy views for one data directory."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark = spark
        self.sf_dir = sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def px(self) -> DataFrame:
        """(date, ticker, close, volume): brand as ticker; Saturday and Sunday roll on to Monday.

        Read from the line items once; bounded by days x tickers.
        """
        shipped = F.to_date("l_shipdate")
        items = self.table("lineitem").select(
            F.date_add(shipped, F.when(F.weekday(shipped) >= 5, 7 - F.weekday(shipped)).otherwise(0)).alias("date"),
            "l_partkey",
            (F.round(F.col("l_discount") * 100).cast("long") - F.round(F.col("l_tax") * 100).cast("long")).alias("net"),
            "l_quantity",
        )
        parts = self.table("part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("ticker"))
        rows = items.join(parts, "l_partkey")
        bars = rows.groupBy("date", "ticker").agg(
            (F.lit(100.0) + F.sum("net").cast("double") / F.count("*")).alias("close"), F.sum("l_quantity").alias("volume")
        )
        return settle(bars)

    @cached_property
    def cal(self) -> DataFrame:
        return trading_calendar(self.px)

    @cached_property
    def panel(self) -> DataFrame:
        return price_panel(self.px, self.cal)

    @cached_property
    def news(self) -> DataFrame:
        """(headline_id, date, ticker, headline, source) from orders."""
        o = self.table("orders")
        ticker = F.concat(F.lit("Brand#"), (1 + F.pmod("o_custkey", F.lit(25))).cast("string"))
        texts = F.array(*[F.lit(t) for t in TEMPLATES])
        template = F.element_at(texts, (F.pmod("o_orderkey", F.lit(15)) + 1).cast("int"))
        return o.select(
            F.col("o_orderkey").alias("headline_id"),
            F.to_date("o_orderdate").alias("date"),
            ticker.alias("ticker"),
            F.replace(template, F.lit("{ticker}"), ticker).alias("headline"),
            _lookup(SOURCES, "o_orderpriority").alias("source"),
            "o_orderstatus",
            "o_totalprice",
        )

    @cached_property
    def scored(self) -> DataFrame:
        """News with label, confidence and signal."""
        label = _lookup(LABELS, "o_orderstatus")
        conf = F.least(F.lit(1.0), F.lit(0.3) + F.col("o_totalprice") / 600000.0)
        rows = self.news.withColumn("label_name", label).withColumn("confidence", conf)
        return rows.withColumn("signal", signal_of("label_name")).drop("o_orderstatus", "o_totalprice")

    @cached_property
    def weekly(self) -> DataFrame:
        """Scored news dated to the Monday of its week, so that cross-sections have enough names."""
        return self.scored.withColumn("date", F.to_date(F.date_trunc("week", "date")))

    @cached_property
    def sectors(self) -> DataFrame:
        """(ticker, sector): five groups by brand number, the last one left out."""
        brands = self.table("part").select(F.col("p_brand").alias("ticker")).distinct()
        number = F.pmod(F.regexp_extract("ticker", r"(\d+)", 1).cast("int"), F.lit(5))
        return brands.select("ticker", F.concat(F.lit("Sector"), number.cast("string")).alias("sector")).where(number < 4)

    def _cents(self, col: str) -> Column:
        return F.round(F.col(col) * 100).cast("long")

    @cached_property
    def vix(self) -> DataFrame:
        """(date, level) between 10 and 34 from daily order totals."""
        daily = self.table("orders").groupBy(F.to_date("o_orderdate").alias("date")).agg(F.sum(self._cents("o_totalprice")).alias("c"))
        return daily.select("date", (F.lit(10.0) + F.pmod("c", F.lit(2400)) / 100.0).alias("level"))

    @cached_property
    def macro(self) -> DataFrame:
        """(series, date, value): seven monthly series."""
        names = F.array(*[F.lit(s) for s in SERIES])
        base = F.array(*[F.lit(SERIES_SCALE[s][0]) for s in SERIES])
        step = F.array(*[F.lit(SERIES_SCALE[s][1]) for s in SERIES])
        slot = (F.pmod("o_orderkey", F.lit(7)) + 1).cast("int")
        month = F.to_date(F.date_trunc("month", "o_orderdate"))
        m = self.table("orders").groupBy(month.alias("date"), slot.alias("k")).agg(F.sum(self._cents("o_totalprice")).alias("c"))
        value = F.element_at(base, F.col("k")) + F.element_at(step, F.col("k")) * F.pmod("c", F.lit(1000))
        return m.select(F.element_at(names, F.col("k")).alias("series"), "date", value.alias("value"))

    @cached_property
    def commodities(self) -> DataFrame:
        """(series, date, price): four daily series."""
        names = F.array(*[F.lit(s) for s in COMMODITIES])
        base = F.array(*[F.lit(COMMODITY_SCALE[s][0]) for s in COMMODITIES])
        step = F.array(*[F.lit(COMMODITY_SCALE[s][1]) for s in COMMODITIES])
        slot = (F.pmod("l_orderkey", F.lit(4)) + 1).cast("int")
        d = self.table("lineitem").groupBy(F.to_date("l_shipdate").alias("date"), slot.alias("k")).agg(
            F.sum(self._cents("l_extendedprice")).alias("c")
        )
        price = F.element_at(base, F.col("k")) + F.element_at(step, F.col("k")) * F.pmod("c", F.lit(1000))
        return d.select(F.element_at(names, F.col("k")).alias("series"), "date", price.alias("price"))

    @cached_property
    def documents(self) -> DataFrame:
        return self.table("documents")

    @property
    def now(self) -> Column:
        """Fixed reference time so recency weights repeat."""
        return F.lit("2001-08-02 00:00:00").cast("timestamp")


