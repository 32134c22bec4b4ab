import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tapewire.llm import language, language_model, quality, token_counts, toxicity
from tapewire.llm.queries import QUERIES
from tapewire.llm.words import slices
from tests.llm.helpers import awkward, frame, words


def test_language_held_out(spark, sf_dir):
    got = QUERIES["op3_language_id"](spark, sf_dir).toPandas()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang").toPandas()
    m = got.merge(docs, on="doc_id")
    assert len(m) == len(docs) and m.score.between(0, 1).all()
    held = m[m.held_out]
    assert set(held.doc_id) == {i for i in docs.doc_id if zlib.crc32(str(i).encode()) % 4 == 2}
    assert (held.lang == held.lang_pred).mean() > 0.95


def test_language_awkward(spark):
    train = frame(spark, [(1, "der die das und", "de", "s"), (2, "the and of", "en", "s"), (3, None, "fr", "s"), (4, "x", None, "s")])
    model = language.fit(train)
    assert model.languages == ("de", "en", "fr")
    rows = awkward() + [(900, "12 34 !?"), (901, "the of and"), (902, "und die")]
    got = language.predict(frame(spark, rows), model, "doc_id", "text", F.col("source")).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    assert by[900]["lang_pred"] == by[300]["lang_pred"] == by[301]["lang_pred"] == "und" and by[900]["score"] == 0
    assert by[901]["lang_pred"] == "en" and by[902]["lang_pred"] == "de"
    none = language.fit(train.limit(0))
    assert {r["lang_pred"] for r in language.predict(frame(spark, rows), none, "doc_id").collect()} == {"und"}
    assert language.predict(frame(spark, []), model, "doc_id").collect() == []


def test_language_matches_plain_bayes(spark):
    texts = [("aab abc", "x"), ("bbc bcc", "y"), ("abc", "x")]
    model = language.fit(frame(spark, [(k, t, la, "s") for k, (t, la) in enumerate(texts)]))
    feats = lambda t: [int(f) for _, _, parts in language.ngrams(pa.array([t])) for part in parts for f in part if f < 1 << language.BITS]
    z = []
    for la in ("x", "y"):
        own = [f for t, b in texts if b == la for f in feats(t)]
        z.append(math.log(sum(b == la for _, b in texts) / 3) + sum(math.log((own.count(f) + 0.5) / (len(own) + 0.5 * 2**language.BITS)) for f in feats("abcc")))
    got = language.predict(frame(spark, [(1, "ABCC")]), model, "doc_id").first()
    assert got["lang_pred"] == ("x", "y")[int(np.argmax(z))]
    assert got["score"] == pytest.approx(1 / (1 + math.exp(min(z) - max(z))))


def test_toxicity(spark):
    rng = random.Random(5)
    clean = [f"c{k}" for k in range(300)]
    rows, labels = [], []
    for k in range(900):
        text = [rng.choice(clean) for _ in range(rng.randrange(5, 60))]
        bad = k % 6 == 0
        if bad:
            text.insert(rng.randrange(len(text)), rng.choice(["scumbag", "Idiotic", "idiots", "vermin!"]))
        rows.append((k, " ".join(text)))
        labels.append((k, 0 if bad and k % 12 == 0 else 1, int(bad)))
    docs, lab = frame(spark, rows), spark.createDataFrame(labels[:600] + [(None, 1, 1), (3, None, None), (5000, 1, 1)], "doc_id long, quality int, toxic int")
    chain = toxicity.fit(docs, lab, toxicity.toxicity_labels())
    got = toxicity.score(docs.withColumn("p_toxic", F.lit("old")), chain)
    assert got.columns == [*docs.columns, "p_toxic", "p_toxic_junk"]
    flag = {r["doc_id"]: r["p_toxic"] >= 0.5 for r in got.collect()}
    assert all(flag[k] == bool(t) for k, _, t in labels)
    odd = toxicity.score(frame(spark, awkward()), chain).collect()
    assert len(odd) == len(awkward()) and not any(r["p_toxic"] >= 0.5 for r in odd)
    constant = toxicity.fit(docs, lab.limit(0), toxicity.toxicity_labels())
    assert {r["p_toxic"] for r in toxicity.score(docs, constant).collect()} == {0.5}
    assert toxicity.score(frame(spark, []), chain).collect() == []


def test_quality_held_out(spark, sf_dir):
    got = QUERIES["op6_quality_classifier"](spark, sf_dir).toPandas()
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").toPandas()
    assert len(got) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert got.score.between(0, 1).all() and ((got.score >= 0.5) == (got.predicted == 1)).all()
    m = got.merge(labels, on="doc_id")
    assert (m[m.held_out].predicted == m[m.held_out].quality).mean() > 0.9


def test_quality_gradient_and_awkward(spark):
    rng = np.random.default_rng(0)
    shapes = [(quality.N_FEATURES, 4), (4,), (4, 3), (4, 3), (3,), (4,), (1,)]
    params = [rng.normal(0, 0.3, s) for s in shapes]
    bag, x, y = np.array([0, 2, 3, 7]), rng.normal(0, 1, (7, quality.N_FEATURES)), np.array([1.0, 0.0, 1.0])
    loss = lambda: -np.mean(y * np.log(p := quality._forward(x, bag, tuple(params))[-1]) + (1 - y) * np.log(1 - p))
    for k, g in enumerate(quality._gradient(x, bag, y, tuple(params))):
        at = tuple(rng.integers(0, s) for s in shapes[k])
        old = params[k][at]
        params[k][at] = old + 1e-5
        up = loss()
        params[k][at] = old - 1e-5
        down = loss()
        params[k][at] = old
        assert g[at] == pytest.approx((up - down) / 2e-5, rel=1e-3, abs=1e-7)
    rows = awkward()
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)] + [(None, 1), (300, None)], "doc_id long, quality int")
    model = quality.fit(frame(spark, rows), labels)
    got = quality.score(frame(spark, rows), model).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    assert len({r["score"] for r in got if r["doc_id"] in (300, 301, 302)}) == 1
    constant = quality.fit(frame(spark, rows), labels.limit(0))
    assert {r["score"] for r in quality.score(frame(spark, rows), constant).collect()} == {0.5}
    assert quality.score(frame(spark, []), model).collect() == []


def test_quality_trains_on_all_passages(spark, monkeypatch):
    rows = [(k, " ".join([f"w{k}"] * (64 * (200 if k == 3 else 2)))) for k in range(8)]
    labels = spark.createDataFrame([(k, k % 2) for k in range(8)], "doc_id long, quality int")
    seen = []
    gradient = quality._gradient
    monkeypatch.setattr(quality, "_gradient", lambda x, bag, *more: seen.append(np.diff(bag)) or gradient(x, bag, *more))
    quality.fit(frame(spark, rows), labels)
    assert sorted(seen[0]) == [2] * 7 + [200]


def test_language_model(spark):
    rows = awkward()
    train = F.coalesce(F.col("doc_id") % 7 != 2, F.lit(False))
    docs = frame(spark, rows).withColumn("train", train)
    got = language_model.scores(docs, "train").collect()
    learned = [words(t, True) + [None] for i, t in rows if i is not None and i % 7 != 2]
    count: dict = {}
    for w in learned:
        for x in w:
            count[x] = count.get(x, 0) + 1
    n, v = sum(count.values()), len(count)
    want = []
    for i, t in rows:
        w = words(t, True) + [None]
        want.append((-1 if i is None else i, len(w), sum(x in count for x in w), round(sum(math.log10((count.get(x, 0) + 1) / (n + v + 1)) for x in w), 5)))
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_tokens"], r["n_known"], round(r["base_score"], 5)) for r in got) == sorted(want)
    assert {r["train_tokens"] for r in got} == {n}
    assert sum(r["score"] for r in got) > sum(r["base_score"] for r in got) and all(r["score"] < 0 for r in got)
    again = language_model.scores(docs, "train").collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    untrained = language_model.scores(docs.withColumn("train", F.lit(False)), "train").collect()
    assert all(r["score"] == r["base_score"] == 0 and r["n_known"] == 0 for r in untrained)
    assert language_model.scores(docs.limit(0), "train").collect() == []


def test_language_model_learns_pairs_of_many_contexts(spark):
    """More previous words than 1,024 classes could keep apart: each is followed by a word of its own."""
    docs = spark.range(40000).select(F.col("id").alias("doc_id"), F.expr("concat('a', id % 4000, ' b', id % 4000)").alias("text"), F.lit(True).alias("train"))
    got = language_model.scores(docs, "train").agg(F.avg("score"), F.count("*")).first()
    assert got[1] == 40000 and got[0] > math.log10(1 / 4000) - 0.25


def test_language_model_deals_hot_tokens_over_shards(spark):
    """A third of all tokens is one word: its pairs do not meet in one shard, and its counts stay whole."""
    text = F.concat_ws(" ", F.transform(F.sequence(F.lit(0), F.lit(199)), lambda k: F.concat(F.lit("the x"), F.pmod(F.hash(k, "id"), F.lit(3000)), F.lit(" y"), F.pmod(F.hash("id", k), F.lit(3000)))))
    docs = spark.range(300).select(F.col("id").alias("doc_id"), text.alias("text"), F.lit(True).alias("train"))
    rows = docs.select("doc_id", F.lit(False).alias("held_out"), "text")
    token = next(language_model._tokens(pa.array(["the"])))[2][0]
    hot = language_model._hot(rows, 48)
    assert token in hot
    sent = language_model._blocks(rows, 48, hot).filter(lambda m: m[1][0] == "pairs").map(lambda m: (m[0], np.frombuffer(m[1][3], np.uint64))).collect()
    assert len({s for s, t in sent if token in t}) > 40
    got = language_model.scores(docs, "train").collect()
    counts: dict = {}
    texts = [words(r["text"], True) + [None] for r in docs.collect()]
    for w in texts:
        for x in w:
            counts[x] = counts.get(x, 0) + 1
    n, v = sum(counts.values()), len(counts)
    assert sorted(round(r["base_score"], 5) for r in got) == sorted(round(sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w), 5) for w in texts)
    assert all(r["n_known"] == r["n_tokens"] for r in got)


def test_language_model_is_a_distribution():
    """Over the vocabulary and one unseen token the parent and each context restaurant add up to 1."""
    rng = np.random.default_rng(2)
    token = np.sort(rng.integers(0, 2**63, 300, dtype=np.uint64) & ~np.uint64(1023))
    key = np.unique((token[:, None] | rng.integers(0, 5, (300, 8)).astype(np.uint64)).ravel())
    shard = language_model.Shard(key, rng.integers(1, 900, len(key)), 0)
    s = shard.sums()
    g = {"V": 300.0, "d1": 0.7, "d0": 0.6, "customers": s["customers"], "history": [{"tables": s["tables"], "parent_customers": s["tables"].sum(), "parent_tables": 300.0}]}
    for sweep in (1, 2):
        t, n, own = shard.replay(g, sweep)[-1]
        g["history"].append({"tables": np.bincount(shard.context, t, 1024), "parent_customers": n.sum(), "parent_tables": own.sum()})
    state = g["history"][-1]
    parent = shard.parent(n, own, state, g)
    unseen = (1.0 + g["d0"] * state["parent_tables"]) / (g["V"] + 1) / (1.0 + state["parent_customers"])
    assert parent.sum() + unseen == pytest.approx(1)
    for k in range(5):
        room = 1.0 + g["d1"] * state["tables"][k]
        here = np.bincount(shard.of[shard.context == k], (shard.count - g["d1"] * t)[shard.context == k], 300)
        assert ((here + room * parent).sum() + room * unseen) / (1.0 + g["customers"][k]) == pytest.approx(1)
    assert (t >= 1).all() and (t <= shard.count).all() and (own <= n).all()


def test_seating_is_the_restaurant_rule():
    rng = np.random.default_rng(4)
    c = np.full(20000, 6)
    t = language_model._seat(c, np.full(20000, 0.7), 0.5, rng)
    p = {1: 1.0}
    for seated in range(1, 6):
        q: dict = {}
        for k, x in p.items():
            new = 0.7 / (seated - 0.5 * k + 0.7)
            q[k + 1], q[k] = q.get(k + 1, 0) + x * new, q.get(k, 0) + x * (1 - new)
        p = q
    assert t.mean() == pytest.approx(sum(k * x for k, x in p.items()), rel=0.01)
    assert (language_model._seat(np.array([0, 1, 5000]), np.ones(3), 0.5, rng) <= [0, 1, 5000]).all()


@pytest.fixture(scope="module")
def encode():
    import os

    path = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers") + "/byte_bpe_50k.tiktoken"
    if not os.path.exists(path):
        pytest.skip("no vocabulary file")
    return path, token_counts._encoder(token_counts.read_ranks(path), token_counts.PATTERN)


def test_segment_tree(encode):
    rng = random.Random(1)
    for _ in range(300):
        text = "".join(rng.choice("ab  \n\t.é 'sI1　") for _ in range(rng.choice([0, 5, 600, 3000])))
        parts = token_counts.cuts(text)
        tree = token_counts.SegmentTree(parts, encode[1](parts), encode[1])
        assert tree.n_tokens == encode[1]([text])[0]
        for _ in range(4):
            at, gone, new = rng.randrange(len(text) + 2), rng.choice([0, 0, 1, 5, 700]), rng.choice(["", " ", "x", "\n\n", "long words here " * 60])
            tree.edit(at, gone, new)
            text = text[:at] + new + text[at + gone :]
            assert tree.text() == text and tree.n_tokens == encode[1]([text])[0]


def test_edited_counts(spark, encode):
    rows = awkward()
    docs = frame(spark, rows)
    first = token_counts.edited(docs, encode[0], token_counts.sample_edits()).collect()
    assert len(first) == len(rows)
    assert sorted(r["n_tokens"] for r in first) == sorted(encode[1]([t or "" for _, t in rows]))
    assert all(r["n_tokens_after"] == encode[1]([r["text_after"]])[0] == sum(r["leaf_tokens"]) for r in first)
    long_ = next(r for r in first if r["doc_id"] == 400)
    assert long_["n_encoded"] < 5000  # of 170,000 characters
    # stored leaves serve a second round of edits
    stored = spark.createDataFrame([(r["doc_id"], r["text_after"], {"chars": r["leaf_chars"], "tokens": r["leaf_tokens"]}) for r in first], "doc_id long, text string, leaves struct<chars:array<int>,tokens:array<int>>")
    edit = F.when(F.col("doc_id") % 2 == 0, F.array(F.struct(F.lit(3).alias("at"), F.lit(None).cast("int").alias("deleted"), F.lit("zz ").alias("inserted"))))
    second = token_counts.edited(stored, encode[0], edit, leaves="leaves").collect()
    assert all(r["n_tokens_after"] == encode[1]([r["text_after"]])[0] for r in second)
    assert all(r["n_encoded"] == 0 for r in second if r["doc_id"] is None or r["doc_id"] % 2)
    assert token_counts.edited(docs.limit(0), encode[0], token_counts.sample_edits()).collect() == []
