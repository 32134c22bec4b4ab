"""Toxicity categories by a classifier chain.

Categories are predicted in a fixed order.  The model of a category is linear in the presence of
hashed text features (lower-cased words and their first 3 to 6 bytes, which catch inflected forms) and
in the log-odds of all earlier categories.  For training, those come from models that did not see the
row (out-of-fold predictions over folds by id hash), as at prediction time.

Training uses a bounded sample of labelled rows (``SAMPLE`` rows, those with the smallest id hash).
Features are counted over it on the executors; the ``FEATURES`` of largest chi-square that
speak for a category are kept by their 64-bit hashes, so no unrelated word shares a weight.  Scoring reads every whole text once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tapewire.llm.tables import small_batches
from tapewire.llm.words import Words, mix64, prefix_hashes, slices

SAMPLE = 8192
FEATURES = 4096
MIN_DOCS = 3
MIN_CHI = 10.83  # one in a thousand features without relation gets here
FOLDS = 5
STEMS = (3, 4, 5, 6)
_FILTER_BITS = 20


def features(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """(document number, feature hash) of every word and stem in a slice; repeats are not removed."""
    if not len(w.starts):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    doc = np.repeat(np.arange(w.n_docs), np.diff(w.bounds))
    docs, out, stems = [doc], [w.hashes], prefix_hashes(w.raw)
    for k in STEMS:
        long_ = np.flatnonzero(w.ends - w.starts >= k)
        docs.append(doc[long_])
        out.append(stems(w.starts[long_], k))
    return np.concatenate(docs), np.concatenate(out)


@dataclass(frozen=True)
class Chain:
    """Sorted feature hashes and, for each category in order, intercept, weights and chain weights."""

    categories: tuple[str, ...]
    hashes: np.ndarray
    models: tuple[tuple[float, np.ndarray, np.ndarray], ...]

    def filter(self) -> np.ndarray:
        hit = np.zeros(1 << _FILTER_BITS, bool)
        hit[(self.hashes & np.uint64((1 << _FILTER_BITS) - 1)).astype(np.int64)] = True
        return hit

    def present(self, w: Words, hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (document, feature number) pairs."""
        doc, h = features(w)
        keep = hit[(h & np.uint64((1 << _FILTER_BITS) - 1)).astype(np.int64)]
        doc, h = doc[keep], h[keep]
        at = np.searchsorted(self.hashes, h)
        at[at == len(self.hashes)] = 0
        keep = self.hashes[at] == h if len(self.hashes) else np.zeros(len(h), bool)
        pair = np.unique(doc[keep] * len(self.hashes) + at[keep])
        return pair // max(1, len(self.hashes)), pair % max(1, len(self.hashes))

    def predict(self, doc: np.ndarray, feature: np.ndarray, n: int) -> np.ndarray:
        """Probabilities, one column a category."""
        logits = np.zeros((n, len(self.categories)))
        for j, (bias, weights, chain) in enumerate(self.models):
            logits[:, j] = bias + np.bincount(doc, weights[feature], n) + np.clip(logits[:, :j], -8, 8) @ chain
        return _sigmoid(logits)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


def _fit(doc: np.ndarray, feature: np.ndarray, n_features: int, extra: np.ndarray, y: np.ndarray, l2: float = 1e-5, steps: int = 800) -> tuple[float, np.ndarray, np.ndarray]:
    """Logistic regression on sparse presence and dense extra columns by accelerated gradient steps."""
    n = len(y)
    if n == 0 or y.min() == y.max():
        level = 0.0 if n == 0 else (8.0 if y[0] else -8.0)
        return level, np.zeros(n_features), np.zeros(extra.shape[1])
    # curvature bound of each column: the loss never rises by more than these steps allow
    load = np.bincount(doc, minlength=n) + 1.0 + np.abs(extra).sum(1)
    dw = 0.25 * np.bincount(feature, load[doc], n_features) / n + l2
    db, dc = 0.25 * load.mean() + 1e-12, 0.25 * (np.abs(extra) * load[:, None]).mean(0) + l2
    w, b, c = np.zeros(n_features), float(np.log(y.mean() / (1 - y.mean()))), np.zeros(extra.shape[1])
    aw, ab, ac, t, last = w, b, c, 1.0, np.inf
    for _ in range(steps):
        z = ab + np.bincount(doc, aw[feature], n) + extra @ ac
        loss = np.logaddexp(0, z).mean() - (y * z).mean() + 0.5 * l2 * (aw @ aw + ac @ ac)
        if loss > last:  # restart the momentum
            t = 1.0
        last = loss
        r = (_sigmoid(z) - y) / n
        nw = np.maximum(aw - (np.bincount(feature, r[doc], n_features) + l2 * aw) / dw, 0.0)  # a word never excuses another
        nb, nc = ab - r.sum() / db, ac - (extra.T @ r + l2 * ac) / dc
        u = (1 + np.sqrt(1 + 4 * t * t)) / 2
        k = (t - 1) / u
        aw, ab, ac = nw + k * (nw - w), nb + k * (nb - b), nc + k * (nc - c)
        w, b, c, t = nw, nb, nc, u
    return b, w, c


def _cut(z: np.ndarray, y: np.ndarray) -> float:
    """The middle of the widest gap between scores among cuts with the fewest errors; 0 for one class."""
    if len(y) == 0 or y.min() == y.max():
        return 0.0
    order = np.argsort(z, kind="stable")
    z, y = z[order], y[order]
    errors = np.concatenate(([0], np.cumsum(y)))[1:-1] + (1 - y).sum() - np.cumsum(1 - y)[:-1]
    gap = np.diff(z)
    best = np.flatnonzero((errors == errors[gap > 0].min()) & (gap > 0)) if (gap > 0).any() else []
    if not len(best):
        return 0.0
    k = best[np.argmax(gap[best])]
    return float((z[k] + z[k + 1]) / 2)


def fit(docs: DataFrame, labels: DataFrame, categories: dict[str, Column], doc_id: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> Chain:
    """Learns the chain.  ``categories``: name and 0/1 column over ``labels``, in chain order.

    Rows with a null id or a null category are no training rows; of repeated labels the smallest counts.
    Without training rows, or for a category of one class, the model is constant (probability 0.5, or
    next to the class).
    """
    small_batches(docs.sparkSession)
    names = tuple(categories)
    y = labels.select(F.col(doc_id).cast("long").alias("id"), *[c.cast("int").alias(f"y{k}") for k, c in enumerate(categories.values())]).dropna()
    y = y.groupBy("id").agg(*[F.min(f"y{k}").alias(f"y{k}") for k in range(len(names))])
    y = y.orderBy(F.xxhash64("id"), "id").limit(sample)  # the bounded sample; its ids may be broadcast
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text")).join(F.broadcast(y), "id")
    ys = [f"y{k}" for k in range(len(names))]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label = np.stack([batch.column(2 + k).to_numpy() for k in range(len(names))], 1).max(1)
            held, marks = [], []
            for w in slices(batch.column(1), lower=True):
                doc, h = features(w)
                pair = _distinct(doc, h)
                held.append(pair[1])
                marks.append(label[w.first + pair[0]])
            if not held:
                continue
            h, inverse = np.unique(np.concatenate(held), return_inverse=True)
            mark = np.concatenate(marks)
            pos, both = np.bincount(inverse, mark, len(h)), np.bincount(inverse, minlength=len(h))
            yield pa.record_batch({"h": pa.array(h.view(np.int64)), "pos": pa.array(pos.astype(np.int64)), "n": pa.array(both.astype(np.int64))})

    any_ = F.greatest(*ys, F.lit(0)) if len(ys) else F.lit(0)
    n_pos, n_all = rows.agg(F.sum(any_), F.count("*")).first()
    n_pos = n_pos or 0
    counts = rows.mapInArrow(count, "h long, pos long, n long").groupBy("h").agg(F.sum("pos").alias("pos"), F.sum("n").alias("n")).where(F.col("n") >= MIN_DOCS)
    a, n = F.col("pos").cast("double"), F.col("n").cast("double")
    gap = a * n_all - n * n_pos
    strength = n_all * gap * gap / F.greatest(n * (n_all - n) * n_pos * (n_all - n_pos), F.lit(1.0))
    chi = counts.withColumn("chi", strength).where((gap > 0) & (F.col("chi") >= MIN_CHI)).orderBy(F.desc("chi"), "h").limit(FEATURES)
    hashes = np.sort(np.array([r["h"] for r in chi.select("h").collect()], np.int64).view(np.uint64))
    shape = Chain(names, hashes, ())
    hit = shape.filter()

    def present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w in slices(batch.column(1), lower=True):
                doc, feature = shape.present(w, hit)
                cut = np.searchsorted(doc, np.arange(w.n_docs + 1))
                lists = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(feature, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(w.first, w.n_docs), lists, *(batch.column(2 + k).slice(w.first, w.n_docs) for k in range(len(names)))], ["id", "f", *ys])

    got = rows.mapInArrow(present, "id long, f array<int>, " + ", ".join(f"{k} int" for k in ys)).toArrow().sort_by("id").combine_chunks()
    m = got.num_rows
    lists = got.column("f").combine_chunks()
    feature = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    doc = np.repeat(np.arange(m), np.array([len(x) for x in lists.to_pylist()], np.int64)) if m else np.zeros(0, np.int64)
    fold = (mix64(got.column("id").to_numpy().astype(np.int64).view(np.uint64)) % np.uint64(FOLDS)).astype(int)
    out_of_fold, models = np.zeros((m, len(names))), []
    for j in range(len(names)):
        target = got.column(ys[j]).to_numpy().astype(float)
        bias, weights, chain = _fit(doc, feature, len(hashes), out_of_fold[:, :j], target)
        for k in range(FOLDS):
            train = fold != k
            number = np.cumsum(train) - 1
            own = train[doc]
            b, w, c = _fit(number[doc[own]], feature[own], len(hashes), out_of_fold[train][:, :j], target[train])
            z = b + np.bincount(doc, w[feature], m) + out_of_fold[:, :j] @ c
            out_of_fold[fold == k, j] = np.clip(z[fold == k], -8, 8)
        # probability 0.5 stands where out-of-fold predictions err least
        at = _cut(out_of_fold[:, j], target)
        out_of_fold[:, j] = np.clip(out_of_fold[:, j] - at, -8, 8)
        models.append((bias - at, weights, chain))
    return Chain(names, hashes, tuple(models))


def _distinct(doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
    return doc[new], h[new]


def score(docs: DataFrame, chain: Chain, text: str = "text") -> DataFrame:
    """All columns of ``docs`` and one probability ``p_<category>`` for each category.

    Null and empty texts have no feature and get the intercept's probability.  Columns of ``docs`` with a
    name of a result are replaced.
    """
    small_batches(docs.sparkSession)
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((chain.categories, chain.hashes, chain.models, chain.filter()))
    names = [f"p_{c}" for c in chain.categories]
    kept = docs.select(*[docs[c] for c in docs.columns if c not in names])
    at = kept.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        *parts_of, hit = shared.value
        model = Chain(*parts_of)
        for batch in batches:
            parts = []
            for w in slices(batch.column(at), lower=True):
                parts.append(model.predict(*model.present(w, hit), w.n_docs))
            p = np.concatenate(parts) if parts else np.zeros((0, len(names)))
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(p[:, k]) for k in range(len(names)))], [*batch.schema.names, *names])

    return kept.mapInArrow(run, StructType([*kept.schema.fields, *(StructField(name, DoubleType()) for name in names)]))


def toxicity_labels() -> dict[str, Column]:
    """The categories that the label table supports: toxic, and toxic junk (toxic and of low quality)."""
    toxic = F.col("toxic") == 1
    return {"toxic": toxic, "toxic_junk": F.when(toxic.isNull(), None).otherwise(toxic & F.coalesce(F.col("quality") == 0, F.lit(False)))}
