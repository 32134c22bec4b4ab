import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tapewire.llm import decontaminate, ngram_join, substring_dedup
from tapewire.llm import words as W
from tests.llm.helpers import awkward, frame, prose, shingles, words


def test_words_match_bytes_split():
    texts = [t for _, t in awkward()]
    for lower in (False, True):
        got = []
        for w in W.slices(pa.array(texts, pa.string()), lower=lower, limit=5000):
            got += [[bytes(w.raw[a:b]) for a, b in zip(w.starts[lo:hi], w.ends[lo:hi], strict=True)] for lo, hi in zip(w.bounds[:-1], w.bounds[1:], strict=True)]
        assert got == [words(t) for t in texts]


def test_window_hashes_tell_windows_apart():
    seen = defaultdict(set)
    for w in W.slices(pa.array([t for _, t in awkward()], pa.string()), lower=True, limit=5000):
        for k, (s, lo) in enumerate(zip(W.shingle_sets(w), w.bounds[:-1], strict=True)):
            texts = [bytes(w.raw[a:b]).lower() for a, b in zip(w.starts[lo : w.bounds[k + 1]], w.ends[lo : w.bounds[k + 1]], strict=True)]
            assert len(s) == len(shingles(b" ".join(texts).decode()))
            for h in s.tolist():
                seen[h].add(True)
    starts = W.window_starts(np.array([0, 3, 3, 20, 21]), 5)
    assert starts.tolist() == list(range(3, 16))


def brute_components(rows):
    sets, parent = defaultdict(set), {}
    for i, t in rows:
        if i is not None:
            parent[i] = i
            sets[i].add(frozenset(shingles(t)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(parent)
    for a in ids:
        for b in ids:
            if a < b and any(x and y and 100 * len(x & y) >= 80 * len(x | y) for x in sets[a] for y in sets[b]):
                p, q = find(a), find(b)
                parent[max(p, q)] = min(p, q)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("turns", [1])
def test_jaccard_components(spark, monkeypatch, turns):
    monkeypatch.setattr(ngram_join, "PIVOT_TURNS", turns)
    rows = awkward()
    got = ngram_join.jaccard_components(frame(spark, rows)).collect()
    want = brute_components(rows)
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_shingles"]) for r in got) == sorted((-1 if i is None else i, len(shingles(t))) for i, t in rows)
    assert all(r["component_id"] == (None if r["doc_id"] is None else want[r["doc_id"]]) for r in got)


def test_jaccard_components_of_nothing(spark):
    assert ngram_join.jaccard_components(frame(spark, [])).collect() == []
    got = ngram_join.jaccard_components(frame(spark, [(1, None), (2, "")])).collect()
    assert sorted(tuple(r) for r in got) == [(1, 0, 1), (2, 0, 2)]


def brute_repeats(rows, size=13):
    first = {}
    for i, t in rows:
        w = words(t)
        for k in range(len(w) - size + 1):
            if i is not None:
                key = tuple(w[k : k + size])
                first[key] = min(first.get(key, i), i)
    out = []
    for i, t in rows:
        w, gone = words(t), set()
        for k in range(len(w) - size + 1):
            if i is not None and first[tuple(w[k : k + size])] < i:
                gone |= set(range(k, k + size))
        out.append((-1 if i is None else i, len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode()))
    return sorted(out)


def test_remove_repeats(spark):
    rows = awkward()
    got = substring_dedup.remove_repeats(frame(spark, rows)).collect()
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in got) == brute_repeats(rows)


def test_texts_of_one_id_with_colliding_short_hashes(spark):
    """Two texts of one doc_id whose hashes agree in their last 16 bits, one of them with a repeat."""
    rng = random.Random(4)
    passage = prose(rng, 40)
    long = " ".join(prose(rng, 300) + passage)
    tries = spark.range(300000).select(F.concat(F.lit("a b c"), F.col("id").cast("string")).alias("t")).where(F.pmod(F.xxhash64("t"), F.lit(65536)) == F.pmod(F.xxhash64(F.lit(long)), F.lit(65536)))
    short = tries.first()["t"]
    rows = [(1, " ".join(passage)), (5, long), (5, short), (5, short)]
    got = substring_dedup.remove_repeats(frame(spark, rows)).collect()
    assert sorted((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in got) == brute_repeats(rows)


def test_sketch_loses_no_repeat_when_full(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "BLOCK_WINDOWS", 500)
    monkeypatch.setattr(substring_dedup, "MAX_BITS", 18)
    rows = awkward(9)
    got = substring_dedup.remove_repeats(frame(spark, rows).repartition(5)).collect()
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in got) == brute_repeats(rows)


def test_remove_repeats_carries_columns(spark):
    rows = awkward()
    got = substring_dedup.remove_repeats(frame(spark, rows), carry=["lang", "source", "score"], original=True)
    assert got.columns == ["doc_id", "n_words", "n_removed", "text", "lang", "source", "score"]
    by = {(r["doc_id"], r["n_removed"]): r["text"] for r in got.collect()}
    assert by[(302, 0)] == " \n\t " and by[(301, 0)] is None
    assert substring_dedup.remove_repeats(frame(spark, [])).collect() == []


def test_pack_round_trip():
    rng = np.random.default_rng(1)
    for n, top in ((0, 1), (1, 1 << 18), (5000, 1 << 18), (20, 1 << 18), (3, 4)):
        x = np.sort(rng.integers(0, top, n))
        assert substring_dedup._unpack(substring_dedup._pack(x)).tolist() == x.tolist()


def test_leaks(spark):
    rows = awkward()
    texts = dict(r for r in rows if r[0] is not None)
    w = texts[400].split()
    items = [(1, " ".join(w[100:140])), (2, " ".join(w[200:240] + ["z"] * 3)), (3, " ".join(w[:20] + ["q"] * 20)), (4, "one"), (5, None), (6, ""), (None, "one"), (7, " ".join(texts[0].split()[:50])), (1, " ".join(w[100:140])), (8, " ".join(w[300:330]).upper())]
    items += [(9, "red FOX jump"), (10, "fox"), (11, "one two"), (12, "lazy dog red"), (13, "w1 w1 w1 w1")]
    rows += [(500, "the red fox jump over a lazy dog"), (501, "Fox"), (502, "red fox"), (503, "a lazy"), (504, "dog red fox jump")]
    item_frame = frame(spark, items).withColumnRenamed("doc_id", "item_id")
    got = decontaminate.leaks(frame(spark, rows), item_frame).collect()
    best = defaultdict(float)
    for i, t in rows:
        for j, u in items:
            x, y = shingles(t), shingles(u)
            if 0 < len(words(u)) < 5:  # a short item: these words in a row
                x = {tuple(words(t, lower=True)[k : k + len(words(u))]) for k in range(len(words(t)))}
            if i is not None and j is not None and y and 100 * len(x & y) >= 80 * len(y):
                best[(i, j)] = max(best[(i, j)], len(x & y) / len(y))
    assert {(r["doc_id"], r["item_id"]): r["containment"] for r in got} == dict(best) and len(got) == len(best)
    assert (400, 1) in best and (400, 2) in best and (400, 3) not in best and (400, 8) in best
    assert (500, 9) in best and (504, 9) in best and (501, 10) in best and (500, 12) not in best
    assert decontaminate.leaks(frame(spark, []), item_frame).collect() == []
    assert decontaminate.leaks(frame(spark, rows), item_frame.limit(0)).collect() == []
