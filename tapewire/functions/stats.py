"""Statistical column expressions that stay in the JVM."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from tapewire.functions.dates import ColumnLike, _c

_SIMPSON_STEPS = 512


def _cos_power_integral(upper: Column, power: Column) -> Column:
    """Simpson integral of cos(u)**power for u in [0, upper]."""
    step = upper / F.lit(float(_SIMPSON_STEPS))

    def term(i: Column) -> Column:
        weight = F.when((i == 0) | (i == _SIMPSON_STEPS), 1.0).when(F.pmod(i, F.lit(2)) == 1, 4.0).otherwise(2.0)
        base = F.greatest(F.cos(i * step), F.lit(0.0))
        return weight * F.pow(base, power)

    nodes = F.sequence(F.lit(0), F.lit(_SIMPSON_STEPS))
    total = F.aggregate(nodes, F.lit(0.0), lambda acc, i: acc + term(i))
    return total * step / 3.0


def t_two_sided_p(t: ColumnLike, df: ColumnLike) -> Column:
    """Two-sided Student-t tail probability for statistic ``t`` with ``df`` degrees.

    With u = atan(x / sqrt(df)) the density becomes cos(u)**(df-1), so the
    central mass is a ratio of two smooth integrals and no gamma function is
    needed.  Beyond 12/sqrt(df) the density is below 1e-30, which bounds the
    range for large ``df``.  Meant for rows that are already aggregated.
    """
    stat, degrees = F.abs(_c(t)).cast("double"), _c(df).cast("double")
    theta = F.atan(stat / F.sqrt(degrees))
    limit = F.least(F.lit(math.pi / 2), 12.0 / F.sqrt(degrees))
    inside = _cos_power_integral(F.least(theta, limit), degrees - 1)
    whole = _cos_power_integral(limit, degrees - 1)
    p = F.greatest(F.lit(0.0), F.lit(1.0) - inside / whole)
    return F.when(stat.isNull() | degrees.isNull() | (degrees <= 0), None).otherwise(p)


def correlation_t(r: ColumnLike, n: ColumnLike) -> Column:
    """t statistic of a correlation; NULL when |r| is 1 or n is below 3."""
    rho, size = _c(r), _c(n)
    ok = (size > 2) & (F.abs(rho) < 1)
    return F.when(ok, rho * F.sqrt((size - 2) / F.nullif(1 - rho * rho, F.lit(0.0))))


def correlation_p(r: ColumnLike, n: ColumnLike) -> Column:
    rho, size = _c(r), _c(n)
    return F.when(F.abs(rho) >= 1, F.lit(0.0)).otherwise(t_two_sided_p(correlation_t(rho, size), size - 2))


def clip(x: ColumnLike, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), _c(x)))


def ratio(num: ColumnLike, den: ColumnLike) -> Column:
    """num / den with NULL for a zero or missing denominator (ANSI mode raises on x/0)."""
    return _c(num) / F.nullif(_c(den).cast("double"), F.lit(0.0))


def sharpe(mean_excess: Column, std: Column, periods: Column) -> Column:
    return F.when(std > 0, mean_excess / F.nullif(std, F.lit(0.0)) * F.sqrt(periods)).otherwise(F.lit(0.0))
