"""Keyword tables against plain substring search."""

import random
import time

import pytest
from pyspark.sql import functions as F

from tapewire.operators import keywords as kw
from tapewire.operators import patterns as pt
from tapewire.operators import recommend as rc

TEXTS = ["Acme raises GUIDANCE", "guidance guidance", "", None, "ÀÉ Straße İstanbul", "aaaa", "no match at all", "x" * 500 + "needle" + "y" * 500]
WORDS = ["guidance", "Guidance", "a", "aa", "É", "straße", "i̇s", "needle", "", None, "zzz", "e g", "guid"]


def plain(text, words):
    return sorted(w for w in set(words) if w and text is not None and w.lower() in text.lower())


@pytest.mark.parametrize("chars", [4 << 20, 40])
def test_keyword_arrays(spark, monkeypatch, chars):
    monkeypatch.setattr(pt, "SHARD_CHARS", chars)
    rng = random.Random(2)
    words = WORDS + ["".join(rng.choice("abcé ") for _ in range(rng.randrange(1, 5))) for _ in range(80)]
    texts = TEXTS + ["".join(rng.choice("abcéÉ ") for _ in range(rng.randrange(0, 40))) for _ in range(100)]
    rows = spark.createDataFrame([(k, t, "x", [k]) for k, t in enumerate(texts)], "id int, headline string, low string, extra array<int>")
    table = spark.createDataFrame([(w, "z") for w in words * 2], "keyword string, more string")
    got = {r.id: r for r in pt.with_keywords(rows, table).collect()}
    assert {k: r.keywords for k, r in got.items()} == {k: plain(t, words) for k, t in enumerate(texts)}
    assert got[3].headline is None and got[5].extra == [5]
    hits = sorted((r.id, r.keyword) for r in kw.match_table(rows, table).collect())
    assert hits == sorted((k, w) for k, t in enumerate(texts) for w in plain(t, words))
    assert kw.match_table(rows, table.limit(0)).count() == 0
    assert [r.keywords for r in pt.with_keywords(rows.limit(1), table.limit(0)).collect()] == [[]]
    assert pt.with_keywords(rows.limit(0), table).collect() == []


@pytest.mark.parametrize("chars", [4 << 20, 40])
def test_weight_tables_equal_weight_lists(spark, monkeypatch, chars):
    monkeypatch.setattr(pt, "SHARD_CHARS", chars)
    weights = {"guidance": 0.01, "a": -0.2, "needle": 0.05, "é": 0.05, "aa": 0.2, "straße": -0.003}
    rows = spark.createDataFrame([(k, t, 0.5) for k, t in enumerate(TEXTS)], "id int, headline string, signal double")
    table = spark.createDataFrame(list(weights.items()), "keyword string, avg_CAR double")
    want = rows.withColumn("adjusted", kw.adjusted_signal(F.col("headline"), F.col("signal"), weights)).withColumn("keyword_w", kw.impact_weight(F.col("headline"), weights)).withColumn("best", kw.best_keyword(F.col("headline"), weights))
    want = {r.id: r for r in want.where("headline is not null").collect()}
    got = {r.id: r.adjusted for r in kw.adjusted_signals(rows, table).collect()}
    assert got[3] == 0.5
    assert {k: v for k, v in got.items() if k != 3} == pytest.approx({k: r.adjusted for k, r in want.items()})
    got = {r.id: r.keyword_w for r in kw.impact_weights(rows, table).collect()}
    assert {k: v for k, v in got.items() if k != 3} == pytest.approx({k: r.keyword_w for k, r in want.items()})
    got = {r.id: r for r in pt.with_weights(rows, table).collect()}
    assert {k: r.best_keyword for k, r in got.items() if k != 3} == {k: r.best for k, r in want.items()}
    twice = pt.with_weights(rows, table.unionAll(table)).where("id = 0").first()
    assert twice.keyword_total == pytest.approx(2 * (0.01 - 0.2))


def test_long_texts_take_linear_time(spark):
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdefgh") for _ in range(8)) for _ in range(20000)]
    table = spark.createDataFrame([(w,) for w in words], "keyword string")
    texts = [(k, " ".join(rng.choice(words) for _ in range(20000))) for k in range(4)]
    rows = spark.createDataFrame(texts, "id int, headline string")
    pt.with_keywords(rows.limit(1), table).count()
    start = time.perf_counter()
    got = {r.id: r.n for r in pt.with_keywords(rows, table).select("id", F.size("keywords").alias("n")).collect()}
    assert time.perf_counter() - start < 10
    assert all(got[k] >= len(set(t.split())) for k, t in texts)


def test_recommendation_weights_from_a_table(spark):
    rows = [(f"h{k}", "2024-01-01", "A", "reuters", t, "negative", 0.9) for k, t in enumerate(["guidance cut", "share buyback", "nothing"])]
    scored = spark.createDataFrame(rows, "headline_id string, date string, ticker string, source string, headline string, label_name string, confidence double").withColumn("date", F.to_date("date"))
    weights = {"guidance": 0.004, "share buyback": 0.02}
    now = F.lit("2024-01-02").cast("timestamp")
    cols = ["headline_id", "keyword_w", "best_kw"]
    a = rc.weighted_rows(scored, weights, now).select(cols).orderBy("headline_id").collect()
    b = rc.weighted_rows(scored, spark.createDataFrame(list(weights.items()), "keyword string, avg_CAR double"), now).select(cols).orderBy("headline_id").collect()
    assert a == b and b[1].keyword_w == pytest.approx(1.2)


def test_terms_are_counted_in_the_row(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["alpha", "beta", "the", "x", "été", "a1"]) for _ in range(n)) for n in (0, 1, 2, 30)] + [None]
    got = {(r.id, r.term): r.tf for r in kw.text_terms(spark.createDataFrame(list(enumerate(texts)), "id int, text string"), "id", "text", ["the"]).collect()}
    want: dict = {}
    for k, t in enumerate(texts):
        w = [x for x in (t or "").split() if len(x) > 1 and x != "the"]
        for term in w + [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)]:
            want[k, term] = want.get((k, term), 0) + 1
    assert got == want
    scores = spark.createDataFrame([(f"{k}", 1.0 - k / 1000) for k in range(300)] + [("profit margin", 0.1), ("revenue growth", 0.05)], "term string, score double")
    assert [r.term for r in kw.top_meaningful(scores, 2).collect()] == ["profit margin", "revenue growth"]
    assert kw.top_meaningful(scores, 9).count() == 2
