"""Returns of a period do not depend on the order of its trades."""

import datetime as dt
import random
from fractions import Fraction

from tapewire.operators import longshort as ls

SCHEMA = "run string, rebalance_date date, ticker string, hold_days int, signal double, position int, period_return double, ls_return double"


def trades(spark, returns, position=1):
    days = [dt.date(2024, 1, 1), dt.date(2024, 1, 8), dt.date(2024, 1, 15)]
    rows = [("r", d, f"T{i}", 2, float(i), position, x, x) for d in days for i, x in enumerate(returns)]
    return spark.createDataFrame(rows, SCHEMA).coalesce(1)


def test_trades_that_cancel_are_no_win(spark):
    t = trades(spark, [0.1, 0.2, -0.3])
    assert [r.net_return for r in ls.period_pnl(t, ["run"]).collect()] == [0.0] * 3
    got = ls.run_metrics(t, p_value=False).first()
    assert (got.win_rate, got.total_return) == (0.0, 0.0)


def test_unfit_returns_are_not_left_out(spark):
    t = trades(spark, [0.1, float("nan"), 0.2])
    assert all(r.net_return != r.net_return for r in ls.period_pnl(t, ["run"]).collect())


def test_side_means_are_exact(spark):
    assert [r.net_return for r in ls.side_curve(trades(spark, [0.1, 0.2, 0.3]), ["run"]).collect()] == [0.1] * 3
    assert [r.net_return for r in ls.side_curve(trades(spark, [0.3, 0.2, 0.1], -1), ["run"]).collect()] == [0.1] * 3


def test_both_sides_together_are_exact(spark):
    rng = random.Random(3)
    whole = [(i, side, rng.randrange(-50000, 50000)) for i in range(100) for side in (1, -1) for _ in range(5)]
    rows = [("r", dt.date(2024, 1, 1) + dt.timedelta(days=i), "T", 2, 0.0, side, 0.0, x / 1e6) for i, side, x in whole]
    got = {r.rebalance_date: r.net_return for r in ls.side_curve(spark.createDataFrame(rows, SCHEMA), ["run"]).collect()}
    for i in range(100):
        sums = [Fraction(sum(x for j, s, x in whole if (j, s) == (i, side)), 5 * 10**6) for side in (1, -1)]
        assert got[dt.date(2024, 1, 1) + dt.timedelta(days=i)] == float(sum(sums) / 2)
