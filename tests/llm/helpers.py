"""Small tables with awkward rows, and brute-force words."""

import random

from pyspark.sql.types import LongType, StringType, StructField, StructType

#: names that operators use inside
CLASHING = ["tag", "shard", "h", "n", "s", "block", "token", "component", "held_out", "score", "size", "copies", "row", "label"]
SCHEMA = StructType([StructField("doc_id", LongType()), StructField("text", StringType()), StructField("lang", StringType()), StructField("source", StringType()), StructField("n_chars", LongType())])
WIDE = StructType([*SCHEMA.fields, *(StructField(c, StringType()) for c in CLASHING)])


def frame(spark, rows, lang=None, source="s"):
    """rows: (doc_id, text) or (doc_id, text, lang, source)."""
    out = []
    for r in rows:
        i, t, la, so = (*r, lang, source)[:4] if len(r) == 2 else r
        out.append((i, t, la, so, len(t) if t is not None else None, *["x"] * len(CLASHING)))
    return spark.createDataFrame(out, WIDE)


def words(text, lower=False):
    raw = (text or "").encode()
    return (raw.lower() if lower else raw).split()


def shingles(text, size=5):
    w = words(text, lower=True)
    if len(w) >= size:
        return {tuple(w[k : k + size]) for k in range(len(w) - size + 1)}
    return {tuple(w)} if w else set()


def prose(rng: random.Random, n: int, vocabulary: int = 400) -> list[str]:
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def awkward(seed: int = 3):
    """(doc_id, text): copies, near copies, shared passages, short, empty, null and long texts, repeated rows."""
    rng = random.Random(seed)
    base, passage = prose(rng, 120), prose(rng, 30)
    rows = []
    for k in range(40):
        near = list(base)
        for _ in range(k % 5):
            near[rng.randrange(len(near))] = f"v{rng.randrange(50)}"
        rows.append((k, " ".join(near)))
    rows += [(100 + k, " ".join(base)) for k in range(12)]
    rows += [(200 + k, " ".join(prose(rng, 60) + passage + prose(rng, 20 * k))) for k in range(10)]
    rows += [(300, ""), (301, None), (302, " \n\t "), (303, "one"), (304, "ONE"), (305, "one two"), (306, "a\x1cb c d e f"), (307, "É é ÀÉ wörd 😀 x y")]
    rows += [(400, " ".join(prose(rng, 30000, 5000))), (401, "x" * 70000), (402, "rep " * 3000)]
    rows += [(None, " ".join(base)), (None, None), (5, rows[5][1]), (6, " ".join(prose(rng, 50))), (303, "one")]
    return rows
