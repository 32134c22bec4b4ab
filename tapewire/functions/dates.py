"""Date expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnLike = Column | str


def _c(x: ColumnLike) -> Column:
    return F.col(x) if isinstance(x, str) else x


def weekday_ordinal(day: ColumnLike) -> Column:
    """Number of Monday-Friday days from Monday 1969-12-29 up to and including ``day``."""
    n = F.datediff(_c(day), F.lit("1969-12-29").cast("date"))
    full, rest = F.floor((n + 1) / 7), F.pmod(n + 1, F.lit(7))
    return (full * 5 + F.least(F.lit(5), rest)).cast("int")


def weekday_gap(first: ColumnLike, last: ColumnLike) -> Column:
    """Weekdays in the closed range [first, last], minus one.

    Closed form, so no date sequence is materialised.
    """
    return weekday_ordinal(last) - weekday_ordinal(F.date_sub(_c(first), 1)) - 1


def period_label(day: ColumnLike, freq: str) -> Column:
    """Calendar label: ``YYYY`` (year), ``YYYY-Qn`` (quarter) or ``YYYY-MM`` (month)."""
    d = _c(day)
    if freq == "year":
        return F.year(d).cast("string")
    if freq == "quarter":
        return F.concat(F.year(d).cast("string"), F.lit("-Q"), F.quarter(d).cast("string"))
    if freq == "month":
        return F.date_format(d, "yyyy-MM")
    raise ValueError(f"unknown frequency {freq!r}")


def period_start(day: ColumnLike, freq: str) -> Column:
    return F.to_date(F.date_trunc(freq, _c(day).cast("timestamp")))


def period_end(day: ColumnLike, freq: str) -> Column:
    months = {"year": 12, "quarter": 3, "month": 1}[freq]
    return F.date_sub(F.to_date(F.add_months(period_start(day, freq), months)), 1)


def days_old(now: ColumnLike, ts: ColumnLike, missing: float = 30.0) -> Column:
    """Age in days, never negative; an unreadable timestamp counts as ``missing`` days."""
    age = (F.unix_timestamp(_c(now).cast("timestamp")) - F.unix_timestamp(_c(ts).cast("timestamp"))) / 86400.0
    return F.coalesce(F.greatest(F.lit(0.0), age), F.lit(missing))


def recency_weight(now: ColumnLike, ts: ColumnLike, decay: float) -> Column:
    return F.exp(-F.lit(decay) * days_old(now, ts))
