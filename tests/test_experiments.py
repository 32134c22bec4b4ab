"""Parameter studies on small markets."""

import datetime as dt
import random

import pytest

from tapewire.operators.calendar import trading_calendar
from tapewire.operators.panel import price_panel
from tapewire.plans import experiments as ex


@pytest.fixture(scope="module")
def flat_market(spark):
    """Three headlines per ticker and day whose mean is 0 or 1/3: nothing reaches 0.45."""
    rng = random.Random(5)
    days = [dt.date(2024, 1, 1) + dt.timedelta(days=i) for i in range(12)]
    names = [f"T{i}" for i in range(6)]
    px = spark.createDataFrame([(d, t, 100 + rng.random(), 10.0) for d in days for t in names], "date date, ticker string, close double, volume double")
    rows = [(d, t, s) for d in days for t in names for s in (1, -1, rng.choice([0, 1]))]
    news = [(i, d, t, "earnings", 0.9, s) for i, (d, t, s) in enumerate(rows)]
    scored = spark.createDataFrame(news, "headline_id long, date date, ticker string, headline string, confidence double, signal int")
    cal = trading_calendar(px)
    return scored, price_panel(px, cal), cal


def test_threshold_without_positions_has_no_hit_rate(flat_market):
    got = {r.config: r for r in ex.threshold_ablation(*flat_market).collect()}
    idle = [r for r in got.values() if r.n_active == 0]
    assert idle and all(r.hit_rate_1d is None and r.sharpe is None for r in idle)
    assert got["loose"].n_active > 0 and got["loose"].hit_rate_1d is not None


def test_horizon_without_positions_has_no_hit_rate(flat_market):
    rows = ex.horizon_ablation(*flat_market).collect()
    assert rows and all(r.hit_rate is None for r in rows)


def test_keyword_variants_without_positions_count_no_trades(flat_market):
    rows = ex.keyword_ablation(*flat_market, {"earnings": 0.001}).collect()
    assert len(rows) == 3 and all(r.total_trades == 0 and r.hit_rate is None and r.sharpe_ratio is None for r in rows)


def test_inversion_without_positions_counts_no_trades(flat_market):
    rows = ex.inversion_study(*flat_market).collect()
    assert {r.variant for r in rows} == {"normal", "inverted"}
    assert all(r.total_trades == 0 and r.hit_rate is None and r.win_rate is None for r in rows)


def test_equal_runs_have_equal_sharpe_and_the_first_name_wins(spark):
    rng = random.Random(0)
    r = [round(rng.uniform(-0.05, 0.05), 6) for _ in range(12)]
    rows = [("a", i, x) for i, x in enumerate(r)] + [("b", i, r[i]) for i in reversed(range(12))]
    returns = spark.createDataFrame(rows, "run string, idx int, r double").coalesce(1)
    assert ex.reality_check(returns, draws=20).first().best_strategy == "a"
