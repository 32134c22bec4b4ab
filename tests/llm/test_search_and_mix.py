import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from tapewire.llm import mixing, topk
from tapewire.llm.queries import ORACLE_SQL, QUERIES
from tests.llm.helpers import SCHEMA, awkward, frame, shingles, words


def brute_top(vectors, k=20, every=20):
    whole = {i: np.floor(64.0 * np.array(v, float)).astype(np.int64) for i, v in vectors}
    out = []
    for q, x in whole.items():
        if q % every == 0:
            best = sorted((-int(x @ y), i) for i, y in whole.items() if i != q and len(y) == len(x))[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("shard_rows", [8192, 150])
def test_top_k(spark, shard_rows):
    rng = np.random.default_rng(3)
    centres = rng.normal(0, 1, (6, 8))
    rows = [(i, (centres[i % 6] + rng.normal(0, 0.05, 8)).astype(np.float32).tolist()) for i in range(900)]
    rows += [(2000 + i, rows[0][1]) for i in range(60)] + [(3000, [1.0, 2.0]), (3020, [3.0, 4.0])]
    bad = [(4000, None), (4020, [1.0] * 7 + [None]), (4040, [float("nan")] * 8), (4060, [float("inf")] * 8), (4080, []), (None, rows[0][1])]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows + bad], "vec_id long, embedding array<float>, shard string, dim int")
    got = topk.top_k(df, F.col("vec_id") % 20 == 0, shard_rows=shard_rows).collect()
    assert sorted(tuple(r) for r in got) == brute_top(rows)
    assert topk.top_k(df.limit(0), F.col("vec_id") % 20 == 0).collect() == []


def test_top_k_of_large_components(spark):
    """Products beyond 2**53 are exact; what no long holds raises."""
    big = 2.0**24
    rows = [(0, [big, 1.0]), (1, [big, 1.0]), (2, [big, 0.5]), (3, [-big, 3.0]), (4, [big - 2**-6, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.top_k(df, F.col("vec_id") == 3).collect()]
    whole = {i: [int(np.floor(64 * x)) for x in v] for i, v in rows}
    want = sorted((-sum(a * b for a, b in zip(whole[3], whole[i], strict=True)), i) for i in whole if i != 3)
    if all(abs(s) < 2**63 for s, _ in want):
        assert sorted(got) == [(3, k + 1, i, -s) for k, (s, i) in enumerate(want)]
    with pytest.raises(Exception, match="beyond a long"):
        topk.top_k(spark.createDataFrame([(0, [2.0**57]), (1, [1.0])], "vec_id long, embedding array<double>"), F.col("vec_id") == 0).collect()
    with pytest.raises(Exception, match="beyond a long"):
        topk.top_k(spark.createDataFrame([(0, [2.0**40]), (1, [2.0**40])], "vec_id long, embedding array<double>"), F.col("vec_id") == 0).collect()


def water_line(sizes, weights=(3, 1, 2), share=1.5):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[k % 3] for k, s in enumerate(names)}
    full: set = set()
    while True:
        rest = share * sum(sizes.values()) - sum(2 * sizes[s] for s in full)
        target = {s: 2 * sizes[s] if s in full else rest * w[s] / sum(w[x] for x in names if x not in full) for s in names}
        over = {s for s in names if s not in full and target[s] > 2 * sizes[s] + 1e-9}
        if not over:
            return target
        full |= over


def test_mix(spark):
    rng = random.Random(2)
    rows = [(k, " ".join(["w"] * rng.randrange(1, 60)), "en", rng.choice(["a", "b", "b", "b", "Z", None, "é"])) for k in range(900)]
    rows += [(k, t, "en", "a") for k, (_, t) in enumerate(awkward(), 2000)] + [(None, "x y", "en", "b"), (7, None, "en", "only"), (7, "", "en", "only")]
    docs = frame(spark, rows)
    got = mixing.mix(docs).collect()
    assert sorted(map(str, mixing.mix(docs.repartition(7)).collect())) == sorted(map(str, got))
    sizes: dict = {}
    for _, t, _, s in rows:
        sizes[s] = sizes.get(s, 0) + len(words(t))
    target = water_line(sizes)
    assert len(got) == len(rows) and sorted(r["size"] for r in got) == sorted(len(words(r[1])) for r in rows)
    for s in sizes:
        own = [r for r in got if r["source"] == s]
        assert {r["source_size"] for r in own} == {sizes[s]} and own[0]["target"] == pytest.approx(target[s])
        assert abs(sum(r["taken"] for r in own) - target[s]) <= max(1, 0.01 * target[s]) + (30000 if s == "a" else 60)
    assert all(r["taken"] in (0, r["size"], 2 * r["size"]) for r in got)
    assert mixing.mix(frame(spark, [])).collect() == []
    assert [r["taken"] for r in mixing.mix(frame(spark, [(1, None), (2, "")])).collect()] == [0, 0]


def test_multipliers_meet_the_targets(spark):
    counts = spark.createDataFrame([("a", 3, 50), ("a", 40, 5), ("a", 900, 1), ("b", 10, 10), ("c", 7, 4)], "source string, size long, n long")
    targets = spark.createDataFrame([("a", 1250, 1700.0), ("b", 100, 40.0), ("c", 28, 56.0)], "source string, source_size long, target double")
    found = {r["source"]: r for r in mixing.tilt(counts, targets).collect()}
    assert found["c"]["full"]
    for s, want in (("a", 1700.0), ("b", 40.0)):
        rows = [r for r in counts.collect() if r["source"] == s]
        assert sum(r["n"] * r["size"] * min(2.0, np.exp(found[s]["m"] * r["size"] / found[s]["mean"])) for r in rows) == pytest.approx(want, rel=1e-4)


def test_pipeline_stages(spark, sf_dir):
    assert [n for n, _ in corpus_pipeline.STAGES][0] == "toxicity" and len(corpus_pipeline.STAGES) == 5
    rng = random.Random(8)
    base = [f"p{rng.randrange(900)}" for _ in range(90)]
    item = spark.read.parquet(f"{sf_dir}/benchmark.parquet").orderBy("item_id").first()["text"]
    lone = [f"q{rng.randrange(900)}" for _ in range(80)]
    rows = [(1, " ".join(base)), (2, " ".join(base[:-1] + ["new"])), (3, " ".join(lone[:40] + base[10:75] + lone[40:])), (4, "a b c " + item), (5, "clean words only here"), (None, "no id"), (6, None), (5, "clean words only here")]
    docs = frame(spark, rows, "en")
    near = {r["doc_id"]: r for r in corpus_pipeline.drop_near_copies(spark, docs, sf_dir).collect()}
    assert set(near) == {1, 3, 4, 5, 6, None}
    kept = corpus_pipeline.drop_near_copies(spark, docs, sf_dir)
    assert kept.columns == [f.name for f in SCHEMA.fields] and kept.where("doc_id = 5").count() == 1
    cut = {r["doc_id"]: r["text"] for r in corpus_pipeline.cut_repeats(spark, kept, sf_dir).collect()}
    assert cut[3] == " ".join(lone) and cut[1] == " ".join(base) and cut[6] is None
    clean = {r["doc_id"] for r in corpus_pipeline.drop_leaked(spark, docs, sf_dir).collect()}
    assert clean == {1, 2, 3, 5, 6, None}
    mixed = corpus_pipeline.mix_sources(spark, kept, sf_dir)
    assert mixed.columns == [*corpus_pipeline.COLUMNS, "n_words", "copies"]


def test_pipeline_run(spark, sf_dir):
    got = corpus_pipeline.run(spark, sf_dir).toPandas()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").toPandas()
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").toPandas()
    assert got.doc_id.is_unique and set(got.doc_id) <= set(docs.doc_id) and got.copies.between(1, 2).all()
    sets = [(shingles(t)) for t in got.text]
    for y in map(shingles, items.text):
        assert not any(100 * len(x & y) >= 80 * len(y) for x in sets)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_queries_match_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings", "labels", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    want = con.execute(ORACLE_SQL[name]).to_arrow_table().to_pylist()
    got = [r.asDict() for r in QUERIES[name](spark, sf_dir).collect()]
    key = lambda r: tuple((c, r[c]) for c in sorted(r))
    assert sorted(map(key, got)) == sorted(map(key, want))


def test_registered():
    names = entry.queries()
    assert "pipeline" in names and all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 14))
