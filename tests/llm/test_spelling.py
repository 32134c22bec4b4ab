"""Spelling variants against brute force."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tapewire.llm import spelling
from tests.llm.helpers import awkward, frame


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if abs(len(a) - len(b)) != 1:
        return False
    long, short = (a, b) if len(a) > len(b) else (b, a)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def brute(count, ratio=10):
    form, told = {}, {}
    for w, n in count.items():
        others = [(x, m) for x, m in count.items() if near(w, x)]
        best = min(others, key=lambda t: (-t[1], t[0]), default=None)
        form[w] = best[0] if best and best[1] >= ratio * n else None
        told[w] = len(others)
    out = []
    for w, n in count.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w] or "", root, n, told[w], count[form[w]] if form[w] is not None else -1))
    return sorted(out)


def rows_of(df):
    return sorted((r["word"], r["form"] or "", r["root"], r["n"], r["n_near"], -1 if r["form_n"] is None else r["form_n"]) for r in df.collect())


def test_numbers_of_nodes():
    rng = random.Random(5)
    words = sorted({"".join(rng.choice("abé") for _ in range(rng.randrange(0, 9))) for _ in range(400)})
    cuts = [0, 1, 2, 90, 91, 150, len(words)]
    lasts = [words[k - 1] for k in cuts[1:]]
    of: dict = {}
    for part, (lo, hi) in enumerate(zip(cuts, cuts[1:], strict=False)):
        nodes = spelling.Nodes(lasts, part)
        for w in words[lo:hi]:
            for i, x in enumerate(nodes(w).tolist()):
                assert of.setdefault(w[:i], x) == x
    assert len(set(of.values())) == len(of)


@pytest.mark.parametrize("chars", [2 << 20, 300])
def test_variants(spark, monkeypatch, chars):
    monkeypatch.setattr(spelling, "RANGE_CHARS", chars)
    rng = random.Random(8)
    count: Counter = Counter()
    for _ in range(60):
        w = "".join(rng.choice("abcé") for _ in range(rng.randrange(1, 8)))
        count[w] += rng.choice([1, 30, 900, 20000])
        for _ in range(6):
            k = rng.randrange(len(w) + 1)
            count[w[:k] + rng.choice(["", "a", "é", "bb"]) + w[k + rng.randrange(2) :]] += rng.choice([1, 2, 40, 700])
    count["x" * 5000] += 5
    count["x" * 4999] += 500
    count["x" * 4998 + "yx"] += 50000
    rows = [(w, n, "z", 1) for w, n in count.items()] + [(None, 3, "z", 1), ("gone", None, "z", 1), ("zero", 0, "z", 1)]
    count["abca"] += 7
    rows.append(("abca", 7, "z", 1))
    df = spark.createDataFrame(rows, "word string, n long, p string, wid int").repartition(5)
    assert rows_of(spelling.variants(df)) == brute(count)
    assert rows_of(spelling.variants(df, ratio=2)) == brute(count, 2)
    assert spelling.variants(df.limit(0)).collect() == []
    with pytest.raises(ValueError, match="ratio"):
        spelling.variants(df, ratio=1)


def test_slipped_words(spark):
    rng = random.Random(2)
    letters = "abcdeÉé×÷ÀÿZ"
    stock = ["".join(rng.choice(letters) for _ in range(rng.randrange(5, 12))) for _ in range(60)]
    rows = [(k, rng.choice([" ", "-", "1", "ā"]).join(rng.choice(stock) for _ in range(40))) for k in range(80)] + awkward() + [(None, " ".join(stock))]
    want: Counter = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = 1 if i is None else zlib.crc32(f"{i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                want[run] += 1
    got = {r["word"]: r["n"] for r in spelling.slipped_words(frame(spark, rows)).collect()}
    assert got == {w: n for w, n in want.items() if n >= 2}
    assert spelling.slipped_words(frame(spark, [])).collect() == []


def test_shared_prefix():
    rng = np.random.default_rng(1)
    for _ in range(300):
        a, b = ("".join("ab"[x] for x in rng.integers(0, 2, rng.integers(0, 7))) for _ in range(2))
        want = next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))
        assert spelling._shared(a, b) == want
