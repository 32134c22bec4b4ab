"""The text classifier cuts texts into terms once, in time linear in the text."""

import time

import pytest
from pyspark.ml.feature import HashingTF
from pyspark.sql import functions as F

from tapewire.operators import ml


def test_terms_are_words_and_pairs(spark):
    texts = ["", "One", "one two", "a b a b, c"]
    want = [[""], ["one", "one"], ["one", "two", "one two"], ["a", "b", "a", "b", "c", "a b", "b a", "a b", "b c"]]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    plain = spark.createDataFrame(list(enumerate(want)), "id int, g array<string>")
    counted = HashingTF(inputCol="g", outputCol="_tf", numFeatures=1 << 16).transform(plain)
    got = {r.id: r._tf for r in ml.with_terms(df).collect()}
    assert got == {r.id: r._tf for r in counted.collect()}


def test_long_texts_take_linear_time(spark):
    """One text of 150,000 words: a slice of the array for each of its words took minutes."""
    df = spark.range(1).select(F.array_join(F.transform(F.sequence(F.lit(1), F.lit(150_000)), lambda i: (i % 977).cast("string")), " ").alias("text"))
    t = time.time()
    assert ml.with_terms(df).first()._tf.values.sum() == pytest.approx(2 * 150_000 - 1)
    assert time.time() - t < 20


def test_rows_with_terms_need_no_text(spark):
    rows = [(i, ["good news today", "bad news today"][i % 2], i % 2) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, text string, label int")
    both = [ml.fit_text_classifier(x, x, features=256) for x in (df, ml.with_terms(df, features=256))]
    with_text, without = both[0].transform(df), ml.of_terms(both[1]).transform(ml.with_terms(df, features=256))
    assert {(r.id, r.prediction) for r in with_text.collect()} == {(r.id, r.prediction) for r in without.collect()} == {(i, float(y)) for i, _, y in rows}


def test_split_sends_cuts_to_the_rows(spark):
    df = spark.range(200).selectExpr("id", "cast(id % 2 as string) AS label", "cast(id as string) AS text")
    out = ml.stratified_split(df, "label", "text", "id")
    assert "Join LeftOuter" not in out._jdf.queryExecution().optimizedPlan().toString() and "rightHint=(strategy=broadcast)" in out._jdf.queryExecution().optimizedPlan().toString()
    assert {(r.label, r.split): r["count"] for r in out.groupBy("label", "split").count().collect()} == {(y, s): n for y in "01" for s, n in (("train", 70), ("val", 15), ("test", 15))}
