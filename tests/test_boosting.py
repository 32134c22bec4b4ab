"""Boosted trees against a plain implementation over all rows at once."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapewire.operators import boosting as bo
from tapewire.operators import ml


def table(spark, n=400, seed=5):
    rng = np.random.default_rng(seed)
    x = rng.integers(0, 6, (n, 3)).astype(float)
    y = np.where(x[:, 0] + rng.normal(0, 0.6, n) > 3.5, 2, np.where(x[:, 1] > 2, 1, 0))
    rows = [(*map(float, r), int(k)) for r, k in zip(x, y, strict=True)]
    return x, y, spark.createDataFrame(rows, "a double, b double, c double, y int")


def plain(x, y, classes, rounds, depth, rate):
    """Exact greedy splits on the values themselves, every row in every round."""
    share = np.bincount(y, minlength=classes) + 1
    margin = np.repeat(np.log(share / share.sum())[None, :], len(x), 0)

    def grow(rows, g, h, left):
        if left == 0:
            return np.full(len(x), -rate * g[rows].sum() / (h[rows].sum() + bo.REGULAR))
        score = lambda m: g[m].sum() ** 2 / (h[m].sum() + bo.REGULAR)
        best = (1e-9, None)
        for f in range(x.shape[1]):
            for v in np.unique(x[:, f])[:-1]:
                a, b = rows & (x[:, f] <= v), rows & (x[:, f] > v)
                if h[a].sum() >= bo.LEAST and h[b].sum() >= bo.LEAST:
                    gain = score(a) + score(b) - score(rows)
                    if gain > best[0] + 1e-9:
                        best = (gain, (f, v))
        if best[1] is None:
            return grow(rows, g, h, 0)
        f, v = best[1]
        return np.where(x[:, f] <= v, grow(rows & (x[:, f] <= v), g, h, left - 1), grow(rows & (x[:, f] > v), g, h, left - 1))

    for _ in range(rounds):
        e = np.exp(margin - margin.max(1, keepdims=True))
        p = e / e.sum(1, keepdims=True)
        step = np.zeros_like(margin)
        for c in range(classes):
            step[:, c] = grow(np.ones(len(x), bool), p[:, c] - (y == c), p[:, c] * (1 - p[:, c]), depth)
        margin += step
    e = np.exp(margin - margin.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def test_probabilities_equal_the_plain_ones(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(bo, "RENEW", 3)
    x, y, df = table(spark)
    fitted = bo.fit_boosted(df.repartition(3), ["a", "b", "c"], "y", rounds=7, depth=3, rate=0.3, share=1.0)
    got = np.array([r.probability for r in fitted.transform(df.withColumn("k", F.monotonically_increasing_id())).orderBy("k").collect()])
    want = plain(x, y, 3, 7, 3, 0.3)
    assert np.abs(got - want).max() < 1e-5
    assert (got.argmax(1) == y).mean() > 0.8
    path = str(tmp_path / "model")
    fitted.write().overwrite().save(path)
    loaded = bo.BoostedModel.load(path)
    assert np.allclose([r.probability for r in loaded.transform(df).collect()], [r.probability for r in fitted.transform(df).collect()])
    assert [n for n, _ in fitted.importances()][-1] == "c" and sum(v for _, v in fitted.importances()) == pytest.approx(1)
    # a table without a column, with nulls and NaN, in another order and with columns of its own
    odd = spark.createDataFrame([(None, "q", 5.0), (float("nan"), "q", 0.0)], "b double, probability_note string, a double")
    same = spark.createDataFrame([(5.0, 0.0, 0.0), (0.0, 0.0, 0.0)], "a double, b double, c double")
    assert [r.probability for r in fitted.transform(odd).collect()] == [r.probability for r in fitted.transform(same).collect()]
    assert fitted.transform(odd.limit(0)).collect() == []


def test_draws_repeat_and_bad_input_raises(spark):
    _, _, df = table(spark, 120)
    one, two = (bo.fit_boosted(df.coalesce(1), ["a", "b"], "y", rounds=2, depth=2, share=0.5).content() for _ in range(2))
    assert one == two
    with pytest.raises(ValueError, match="rows"):
        bo.fit_boosted(df.where("y > 9"), ["a"], "y", rounds=1)
    with pytest.raises(ValueError, match="byte"):
        bo.fit_boosted(df, ["a"], "y", bins=500)


def test_uniform_without_a_model(spark):
    out = ml.alpha_probabilities(None, spark.createDataFrame([(1.0,)], "x double")).first()
    assert out.prob_up == pytest.approx(1 / 3)


def test_few_tasks_add_up_in_one_stage(spark):
    """A level of a round is one stage where the tasks' sums may go straight to the driver."""
    rdd = spark.sparkContext.parallelize(range(12), 12).map(lambda k: np.full(3, k))
    spark.sparkContext.setJobGroup("one-stage", "")
    try:
        assert bo._added(rdd).tolist() == [66, 66, 66]
        status = spark.sparkContext.statusTracker()
        assert [len(status.getJobInfo(j).stageIds) for j in status.getJobIdsForGroup("one-stage")] == [1]
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert bo._added(spark.sparkContext.parallelize(range(40), 40).map(lambda k: np.full(3, k))).tolist() == [780] * 3


def test_training_rows_evaluate_the_vectors_once(spark, sf_dir, monkeypatch):
    """The split and the fit read settled rows: the plan of the vectors is not part of what they read."""
    from tapewire.plans.fixtures import Market
    from tapewire.plans.queries import models

    seen = []
    monkeypatch.setattr(models.ml, "stratified_split", lambda df, *a: seen.append(df) or df)
    models.training_rows(Market(spark, sf_dir))
    assert "parquet" not in seen[0]._jdf.queryExecution().optimizedPlan().toString().lower()
