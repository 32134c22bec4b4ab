"""Operators against brute force on small fixtures."""

import datetime as dt
import math
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapewire import lexicon_data as ld
from tapewire.functions.dates import weekday_gap
from tapewire.functions.stats import correlation_p, t_two_sided_p
from tapewire.operators import calendar as cal
from tapewire.operators import event_study as es
from tapewire.operators import keywords as kw
from tapewire.operators import lexicon as lx
from tapewire.operators import longshort as ls
from tapewire.operators import ml
from tapewire.operators import ranks as rk
from tapewire.operators import sets as st
from tapewire.operators import signals as sg
from tapewire.plans import experiments as ex
from tapewire.sources import news as sn
from tapewire.sources import store as so

HEADLINES = [
    "Acme earnings beat and raised guidance after record quarter",
    "Acme did not beat expectations this quarter",
    "Profit warning: Acme lower guidance, layoffs announced",
    "Acme surges; shares surge again as demand surge continues",
    "Unable to avoid bankruptcy, firm faces chapter 11",
    "Game-changing breakthrough beats estimates",
    "Recall of heartbeats device is not a product recall",
    "No clear record high in line with expectations",
    "Buyback and dividend increase lift Acme to record",
    "",
    "nothing here",
]


def brute_score(text):
    """Plain restatement of the rule: longest phrase first, each character span used once."""
    low = text.lower()
    words = re.findall(r"[a-z0-9]+(?:[-'][a-z0-9]+)*", low)
    table = [(p, w) for d in (ld.BULLISH, ld.BEARISH, ld.NEUTRAL) for p, w in d.items()]
    table.sort(key=lambda r: -len(r[0]))
    used, total = [], 0.0
    for phrase, weight in table:
        parts = re.findall(r"[a-z0-9]+(?:[-'][a-z0-9]+)*", phrase)
        flip = any(
            words[i : i + len(parts)] == parts and set(words[max(0, i - 3) : i]) & set(ld.NEGATION_WORDS) for i in range(len(words))
        )
        for m in re.finditer(f"(?={re.escape(phrase)})", low):
            a, b = m.start(), m.start() + len(phrase)
            if (a and low[a - 1].isalpha()) or (b < len(low) and low[b].isalpha()):
                continue
            if any(s <= a < e or s < b <= e for s, e in used):
                continue
            used.append((a, b))
            total += weight * (-0.8 if flip else 1)
    for need, bonus, _ in ld.COMBINATIONS:
        total += bonus if all(n in low for n in need) else 0
    return total


def test_lexicon_on_long_dense_texts(spark):
    rng = random.Random(6)
    pool = [*ld.BULLISH, *ld.BEARISH, *ld.NEUTRAL, *ld.NEGATION_WORDS, "acme", "the", "beatsx", "é"]
    texts = [" ".join(rng.choice(pool) for _ in range(n)) + rng.choice(["", "."]) for n in (3, 10, 40, 40, 200, 200, 400)]
    texts.append(" ".join(["earnings beat not record"] * 5000))
    df = spark.createDataFrame(list(enumerate(texts)), "id int, headline string")
    start = time.perf_counter()
    got = {r.id: r for r in lx.score_texts(df).collect()}
    assert time.perf_counter() - start < 60
    for i, t in enumerate(texts[:-1]):
        assert got[i].raw_score == pytest.approx(brute_score(t), abs=1e-6), t[:200]
    assert len(got[len(texts) - 1].matched_bullish) >= 5000


@pytest.mark.parametrize("dedupe", [False, True])
def test_lexicon_matches_brute_force(spark, dedupe):
    df = spark.createDataFrame([(i, h) for i, h in enumerate(HEADLINES)], "id int, headline string")
    got = {r.headline: r.raw_score for r in lx.score_texts(df, dedupe=dedupe).collect()}
    for h in HEADLINES:
        assert got[h] == pytest.approx(brute_score(h), abs=1e-9), h


def test_long_text_is_scored_whole(spark):
    text = "filler word " * 5000 + "bankruptcy"
    row = lx.score_texts(spark.createDataFrame([(text,)], "headline string")).first()
    assert row.matched_bearish == ["bankruptcy"]


def test_t_tail_known_values(spark):
    df = spark.createDataFrame([(2.0, 10.0), (1.0, 1.0), (0.0, 5.0), (3.0, 1e6), (1.96, 400.0), (50.0, 30.0)], "t double, df double")
    got = [r.p for r in df.select(t_two_sided_p("t", "df").alias("p")).collect()]
    want = [0.0733880347707, 0.5, 1.0, math.erfc(3 / math.sqrt(2)), 0.0506896, 0.0]
    assert got == pytest.approx(want, abs=2e-6)
    r = spark.range(1).select(correlation_p(F.lit(1.0), F.lit(8)).alias("p")).first().p
    assert r == 0.0


def test_weekday_gap(spark):
    days = [dt.date(2000, 1, 1) + dt.timedelta(days=i) for i in range(0, 40, 3)]
    pairs = [(a, b) for a in days for b in days if a <= b]
    df = spark.createDataFrame(pairs, "a date, b date").select("a", "b", weekday_gap("a", "b").alias("g"))
    for r in df.collect():
        assert r.g == np.busday_count(r.a, r.b + dt.timedelta(days=1)) - 1


def test_rebalance_is_greedy(spark):
    rng = random.Random(1)
    days = sorted({dt.date(2020, 1, 1) + dt.timedelta(days=rng.randrange(400)) for _ in range(150)})
    df = spark.createDataFrame([(h, d) for h in (1, 3, 7) for d in days], "hold_days int, date date")
    got = {}
    for r in cal.rebalance_dates(df, ["hold_days"]).collect():
        got.setdefault(r.hold_days, []).append((r.rebalance_no, r.date))
    for h in (1, 3, 7):
        want = []
        for d in days:
            if not want or np.busday_count(want[-1], d + dt.timedelta(days=1)) - 1 >= h:
                want.append(d)
        assert [d for _, d in sorted(got[h])] == want


def _numpy_spearman(x, y):
    def ranks(v):
        v = np.asarray(v)
        return np.array([(v < a).sum() + ((v == a).sum() + 1) / 2 for a in v])

    return np.corrcoef(ranks(x), ranks(y))[0, 1]


@pytest.mark.parametrize("bounded", [False, True])
def test_spearman_with_ties_and_hot_value(spark, bounded):
    rng = np.random.default_rng(3)
    x = np.where(rng.random(600) < 0.4, 0.0, np.round(rng.normal(size=600), 2))
    y = np.round(x + rng.normal(size=600), 1)
    df = spark.createDataFrame([("k", float(a), float(b)) for a, b in zip(x, y)], "k string, x double, y double")
    row = rk.spearman(df, ["k"], "x", "y", bounded=bounded).first()
    assert row.n == 600
    assert row.ic == pytest.approx(_numpy_spearman(x, y), abs=1e-12)


def test_exact_quantiles_and_bins(spark):
    rng = np.random.default_rng(5)
    v = np.concatenate([rng.normal(size=501), np.full(300, 0.25), rng.normal(scale=1e6, size=100)])
    df = spark.createDataFrame([(float(a),) for a in v], "v double").withColumn("n", F.lit(1))
    probs = [0, 0.2, 0.4, 0.6, 0.8, 1]
    edges = rk.exact_quantiles(df, [], "v", probs).first().edges
    assert edges == pytest.approx(np.quantile(v, probs), rel=1e-12)
    same = spark.createDataFrame([(1.0,)] * 50, "v double")
    assert {r.bin for r in rk.equal_frequency_bins(same, [], "v", 5).collect()} == {1}
    total = rk.equal_frequency_bins(df, [], "v", 5).groupBy("bin").count().agg(F.sum("count")).first()[0]
    assert total == len(v)


def test_keyword_table_equals_listed(spark):
    news = spark.createDataFrame([(i, h) for i, h in enumerate(HEADLINES)], "headline_id int, headline string")
    words = ["beat", "e", "record high", "chapter 11", "Acme", "guidance", "zzz", "expectations this quarter"]
    a = {(r.headline_id, r.keyword) for r in kw.match_listed(news, words).collect()}
    table = spark.createDataFrame([(w,) for w in words], "keyword string")
    b = [(r.headline_id, r.keyword) for r in kw.match_table(news, table).collect()]
    assert a == set(b) and len(b) == len(a)
    assert a == {(i, w) for i, h in enumerate(HEADLINES) for w in words if w.lower() in h.lower()}


def test_keyword_filter(spark):
    cases = {"fda approval": True, "item 2.02": False, "12345": False, "shares": False, "apple": False, "restructuring": True, "abc": False, "0001318605": False, "exhibit 99": False}
    df = spark.createDataFrame([(k,) for k in cases], "k string")
    assert {r.k: r.m for r in df.select("k", kw.is_meaningful(F.col("k")).alias("m")).collect()} == cases


def _signals(spark, n_days=30, n_tickers=8):
    rng = random.Random(2)
    start = dt.date(2021, 1, 4)
    days = [start + dt.timedelta(days=i) for i in range(n_days * 2) if (start + dt.timedelta(days=i)).weekday() < 5][:n_days]
    px = [(d, f"T{t}", 100 + rng.random() * 5, 1000.0 + t) for d in days for t in range(n_tickers)]
    sig = [(d, f"T{t}", rng.uniform(-1, 1)) for d in days for t in range(n_tickers)]
    prices = spark.createDataFrame(px, "date date, ticker string, close double, volume double")
    return prices, spark.createDataFrame(sig, "date date, ticker string, signal double")


def test_long_short_invariants(spark):
    from tapewire.operators.panel import price_panel

    prices, signals = _signals(spark)
    calendar = cal.trading_calendar(prices)
    panel = price_panel(prices, calendar)
    runs = [ls.strategy("a"), ls.strategy("b", weighting="vol_scaled", hold_days=3), ls.strategy("c", cutoff=0.4)]
    book = ls.rebalance_book(ls.with_strategies(signals, runs), panel, calendar)
    for r in book.groupBy("run", "date", "position").agg(F.sum("weight").alias("w")).collect():
        assert r.w == pytest.approx(1.0)
    together = {tuple(r) for r in ls.long_short(ls.with_strategies(signals, runs), panel, calendar).where("run = 'b'").collect()}
    alone = {tuple(r) for r in ls.long_short(ls.with_strategies(signals, runs[1:2]), panel, calendar).collect()}
    assert together == alone and alone
    trades = ls.long_short(ls.with_strategies(signals, runs), panel, calendar)
    m = ls.run_metrics(trades).collect()
    assert {r.run for r in m} == {"a", "b", "c"} and all(r.max_drawdown <= 0 for r in m)
    rc = ex.reality_check(ex.aligned_returns(trades), draws=50).first()
    assert 0 <= rc.p_value <= 1 and rc.n_strategies == 3
    centred = ex.reality_check(ex.aligned_returns(trades), draws=50, centered=True).first()
    assert centred.p_value <= 1


def test_thin_cross_section_has_no_positions(spark):
    day = spark.createDataFrame([("r", "A", 1.0, 0.2), ("r", "B", 0.5, 0.2), ("r", "C", -1.0, 0.2)], "run string, ticker string, signal double, cutoff double")
    assert {r.position for r in ls.rank_positions(day, ["run"]).collect()} == {0}


def test_zscore_flat_group_is_zero(spark):
    df = spark.createDataFrame([("d", 1.0), ("d", 1.0), ("e", 3.0)], "date string, v double")
    assert {r.z for r in df.withColumn("z", sg.zscore("v", ["date"])).collect()} == {0.0}


def test_confident_fallback(spark):
    df = spark.createDataFrame([(1, 0.2), (2, 0.4)], "id int, confidence double")
    assert sg.confident_or_all(df).count() == 2
    assert sg.confident_or_all(df, 0.3).count() == 1


def test_event_study_perfect_market(spark):
    """Identical tickers follow the benchmark, so every abnormal return is zero."""
    from tapewire.operators.panel import price_panel

    rng = random.Random(4)
    days = [dt.date(2021, 1, 1) + dt.timedelta(days=i) for i in range(90)]
    level, rows = 100.0, []
    for d in days:
        level *= 1 + rng.uniform(-0.02, 0.02)
        rows += [(d, t, level, 1.0) for t in ("A", "B")]
    panel = price_panel(spark.createDataFrame(rows, "date date, ticker string, close double, volume double"))
    ar = es.abnormal_returns(panel)
    assert ar.count() > 50
    assert ar.agg(F.max(F.abs("car"))).first()[0] < 1e-9


def test_sources_reject_bad_input(spark, tmp_path):
    with pytest.raises(ValueError):
        sn.align_columns(spark.createDataFrame([("x",)], "date string"))
    with pytest.raises(Exception):
        sn.read_news_csv(spark, str(tmp_path / "absent")).count()
    assert sn.load_landed(spark, "nyt", str(tmp_path / "absent")).count() == 0
    path = tmp_path / "feed.json"
    path.write_text('{"ticker":"A","title":" Flat ","providerPublishTime":86400}\n{"ticker":"B","content":{"title":"Nested","pubDate":"2024-01-02T03:04:05Z"}}\n{"ticker":"C","title":"  "}\n')
    rows = {r.headline: r for r in sn.load_landed(spark, "yahoo_finance", str(path)).collect()}
    assert set(rows) == {"Flat", "Nested"} and rows["Flat"].date == dt.datetime(1970, 1, 2)


def test_cache_scores_each_text_once(spark, tmp_path):
    seen = []

    def scorer(df):
        seen.append(sorted(r.headline for r in df.collect()))
        return df.withColumn("label_name", F.lit("positive")).withColumn("confidence", F.lit(0.8))

    news = spark.createDataFrame([("a",), ("a",), ("b",)], "headline string")
    cache = so.open_cache(spark, str(tmp_path), 4)
    scored = so.score_with_cache(news, cache, scorer, "m")
    assert seen[-1] == ["a", "b"] and scored.count() == 3
    so.score_with_cache(news, cache, scorer, "m")
    assert seen[-1] == []


def test_keep_first_and_sample(spark):
    df = spark.createDataFrame([("a", 2), ("a", 1), ("b", 5)], "k string, v int")
    assert {(r.k, r.v) for r in st.keep_first(df, ["k"], [F.col("v")]).collect()} == {("a", 1), ("b", 5)}
    rows = spark.range(300).selectExpr("id % 3 as label", "cast(id as string) as text")
    a = {r.text for r in st.sample_per_class(rows, "label", "text", 30).collect()}
    assert len(a) == 30 and a == {r.text for r in st.sample_per_class(rows, "label", "text", 30).collect()}


def test_token_text_is_made_once_a_row(spark):
    """No lambda of the scorer holds the cutting into tokens, which would then run for each phrase found."""
    df = spark.createDataFrame([("no growth, not strong growth; unstrong growth and growth",), (None,), ("nothing",)], "headline string")
    out = lx.score_texts(df)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("array_join(regexp_extract_all(") == plan.count("array(concat( , array_join(regexp_extract_all(") == 1
    got = {r.headline: r for r in out.collect()}
    assert got[None].raw_score == got["nothing"].raw_score == 0.0


def test_whole_words_at_both_ends(spark):
    lex = lx.Lexicon(bullish={"gain": 1.0, "a gain": 4.0}, bearish={"cut": -2.0}, neutral={}, combinations=[], negations=["not"])
    texts = {"gain gains again gain": 2.0, "a gain, ba gain": 5.0, "\u00e9cut cut\u00e9 cut1 1cut": -4.0, "not gain gain": -1.6, "cutcut cut": -2.0}
    got = {r.headline: r.raw_score for r in lx.score_texts(spark.createDataFrame([(t,) for t in texts], "headline string"), lexicon=lex).collect()}
    assert got == pytest.approx(texts)


def test_quality_defaults(spark):
    r = ml.quality_report(spark.createDataFrame([("m",)], "model string")).first()
    # accuracy .40 -> 2.75, f1 .375 -> 2.667, ic .02 -> 2, hit .5 -> 4
    assert r.predictive_score == pytest.approx(2.70, abs=0.011)
    assert r.risk_score == pytest.approx(0.45 * 3 + 0.35 * 2 + 0.20 * 2, abs=0.011)
    assert r.verdict == "Fair"


def test_stream_scorer_survives_repeated_batches(spark, tmp_path):
    from tapewire.streaming.jobs import incremental_scorer

    calls = []

    def scorer(df):
        calls.append(sorted(r.headline for r in df.collect()))
        return df.withColumn("label_name", F.upper("headline")).withColumn("confidence", F.lit(0.9))

    cache, out = so.open_cache(spark, str(tmp_path / "cache"), 4), str(tmp_path / "out")
    body = incremental_scorer(cache, scorer, "m", out)
    first = spark.createDataFrame([("a",), ("b",), ("a",)], "headline string")
    second = spark.createDataFrame([("b",), ("c",)], "headline string")
    body(first, 0)
    body(first, 0)  # a replay
    body(second, 1)
    body(second, 1)  # a replay after a failure between the two writes
    assert calls == [["a", "b"], ["a", "b"], ["c"], ["c"]]
    rows = sorted((r.batch, r.headline, r.label_name) for r in spark.read.parquet(out).collect())
    assert rows == [(0, "a", "A"), (0, "a", "A"), (0, "b", "B"), (1, "b", "B"), (1, "c", "C")]


def test_walk_forward_without_folds(spark):
    scored = spark.createDataFrame([], "headline_id long, date date, ticker string, headline string, source string, label_name string, confidence double, signal int")
    panel = spark.createDataFrame([], "date date, ticker string, close double, volume double, pos long")
    got = ex.walk_forward(scored, panel, spark.createDataFrame([], "date date, pos long"), spark.createDataFrame([], "date date, level double"))
    assert set(got) == {"oos", "periods", "ablation", "choices", "costs"}
    assert all(df.isEmpty() for df in got.values())


def test_registered_models_are_of_full_size(spark, sf_dir, monkeypatch):
    import __spark_entry__ as entry

    class Stop(Exception):
        pass

    def stop(*args, **options):
        raise Stop(options)

    monkeypatch.setattr(ml, "fit_alpha", stop)
    monkeypatch.setattr(ml, "fit_text_classifier", stop)
    for name in ("ML05_text_classifier", "ML06_alpha_model", "ML07_feature_importances"):
        with pytest.raises(Stop) as e:
            entry.queries()[name](spark, sf_dir)
        assert e.value.args == ({},)


def test_macro_f1(spark):
    got = ml.macro_f1(spark.createDataFrame([(0, 0.0)] * 8 + [(1, 0.0), (1, 1.0)], "label int, prediction double"))
    assert got == pytest.approx((16 / 17 + 2 / 3) / 2)
