"""Quality scores by attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` words (one empty passage without words).  Each passage is
encoded from its own text: shares of pairs of neighbouring character classes (case, digits, kinds of
marks, line ends), word length, and the shares of words new in the document and equal to the last one.  A hidden layer, a gated
attention (tanh times sigmoid) over the passages and a logistic layer on the attention-weighted passage
are trained together from document labels only, by Adam on whole bags.

Training uses a bounded sample of labelled documents (``SAMPLE``, those with the smallest id hash) with all their
passages.  Their encodings are streamed to a file of the driver, of which a batch at a time is in memory; every
passage of every document is scored.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapewire.llm.tables import saved, small_batches
from tapewire.llm.words import Words, slices

PASSAGE = 64
SAMPLE = 4096
HIDDEN, GATE = 32, 16
EPOCHS, BATCH, RATE, DECAY = 30, 128, 3e-3, 1e-4

# classes: other, lower, upper, digit, space, line end, non-ASCII, sentence marks, then single marks
_MARKS = "!|%&$#*@<>{}=_/\\~^+"
_CLASS = np.zeros(256, np.int64)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[[32, 9]], _CLASS[[10, 11, 12, 13]], _CLASS[128:] = 1, 2, 3, 4, 5, 6
_CLASS[[ord(c) for c in ".,;:?'\"()-"]] = 7
_CLASS[[ord(c) for c in _MARKS[:6]]] = np.arange(8, 14)
_CLASS[[ord(c) for c in _MARKS[6:]]] = 14
N_CLASS = 15
N_FEATURES = N_CLASS * N_CLASS + 5


def encode(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """(bag bounds, passage features) of a slice: at least one passage a document."""
    n_words = np.diff(w.bounds)
    per_doc = np.maximum(1, -(-n_words // PASSAGE))
    bag = np.concatenate(([0], np.cumsum(per_doc)))
    n = int(bag[-1])
    out = np.zeros((n, N_FEATURES))
    if not len(w.starts):
        return bag, out
    doc = np.repeat(np.arange(w.n_docs), n_words)
    place = np.arange(len(w.starts)) - w.bounds[doc]
    passage = bag[doc] + place // PASSAGE
    # a character belongs to the passage of the word that it starts or follows
    head = np.zeros(len(w.raw), np.int64)
    first = np.flatnonzero(np.diff(passage, prepend=-1))
    cls = _CLASS[w.raw]
    head[w.starts[first]] = 1
    of_char = np.cumsum(head) - 1
    used = passage[first]
    pair = cls[:-1] * N_CLASS + cls[1:]
    same = (of_char[1:] == of_char[:-1]) & (of_char[:-1] >= 0)
    counts = np.bincount(used[of_char[:-1][same]] * (N_CLASS * N_CLASS) + pair[same], minlength=n * N_CLASS * N_CLASS).reshape(n, -1)
    total = np.maximum(counts.sum(1, keepdims=True), 1)
    out[:, : N_CLASS * N_CLASS] = np.sqrt(counts / total)
    words = np.maximum(np.bincount(passage, minlength=n), 1)
    order = np.lexsort((np.arange(len(doc)), w.hashes, doc))
    new = np.ones(len(doc))
    new[order[1:]] = (doc[order[1:]] != doc[order[:-1]]) | (w.hashes[order[1:]] != w.hashes[order[:-1]])
    again = np.zeros(len(doc))
    again[1:] = (doc[1:] == doc[:-1]) & (w.hashes[1:] == w.hashes[:-1])
    out[:, -5] = np.bincount(passage, again, n) / words
    out[:, -4] = np.bincount(passage, w.ends - w.starts, n) / words / 10
    out[:, -3] = np.bincount(passage, new, n) / words
    out[:, -2] = np.bincount(passage, minlength=n) / PASSAGE
    out[:, -1] = 1.0
    return bag, out


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    scale: np.ndarray
    params: tuple[np.ndarray, ...]

    def score(self, bag: np.ndarray, x: np.ndarray) -> np.ndarray:
        return _forward((x - self.mean) / self.scale, bag, self.params)[-1]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


def _forward(x: np.ndarray, bag: np.ndarray, params: tuple[np.ndarray, ...]) -> tuple:
    w, b, v, u, g, c, c0 = params
    h = np.tanh(x @ w + b)
    t, s = np.tanh(h @ v), _sigmoid(h @ u)
    e = (t * s) @ g
    start, size = bag[:-1], np.diff(bag)
    a = np.exp(e - np.repeat(np.maximum.reduceat(e, start), size))
    a = a / np.repeat(np.add.reduceat(a, start), size)
    z = np.add.reduceat(a[:, None] * h, start, axis=0)
    return h, t, s, a, z, _sigmoid(z @ c + c0)


def _gradient(x: np.ndarray, bag: np.ndarray, y: np.ndarray, params: tuple[np.ndarray, ...]) -> list[np.ndarray]:
    w, b, v, u, g, c, c0 = params
    h, t, s, a, z, p = _forward(x, bag, params)
    start, size = bag[:-1], np.diff(bag)
    d = (p - y) / len(y)
    dz = np.repeat(d[:, None] * c[None, :], size, axis=0)
    da = (dz * h).sum(1)
    de = a * (da - np.repeat(np.add.reduceat(a * da, start), size))
    dt, ds = de[:, None] * g * s * (1 - t * t), de[:, None] * g * t * s * (1 - s)
    dh = (a[:, None] * dz + dt @ v.T + ds @ u.T) * (1 - h * h)
    return [x.T @ dh, dh.sum(0), h.T @ dt, h.T @ ds, (t * s).T @ de, z.T @ d, np.array([d.sum()])]


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", doc_id: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> Model:
    """Learns from the labelled documents (label 0 or 1).

    Null ids and labels are left out; of repeated labels the smallest counts.  All passages of a training
    document are learned from.  With fewer than two classes the model is constant.
    """
    small_batches(docs.sparkSession)
    y = labels.select(F.col(doc_id).cast("long").alias("id"), F.col(label).cast("int").alias("y")).dropna().groupBy("id").agg(F.min("y").alias("y"))
    y = y.orderBy(F.xxhash64("id"), "id").limit(sample)  # bounded, so it may be broadcast
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text")).join(F.broadcast(y), "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w in slices(batch.column(1)):
                bag, x = encode(w)
                ids, ys, blobs = batch.column(0).slice(w.first, w.n_docs), batch.column(2).slice(w.first, w.n_docs), []
                for lo, hi in zip(bag[:-1], bag[1:], strict=True):
                    blobs.append(x[lo:hi].astype(np.float32).tobytes())
                yield pa.record_batch({"id": ids, "y": ys, "x": pa.array(blobs, pa.binary())})

    with tempfile.TemporaryFile() as file:
        ids, ys, sizes = [], [], []
        for row in saved(rows.mapInArrow(run, "id long, y int, x binary")).toLocalIterator():
            ids.append(row["id"])
            ys.append(row["y"])
            sizes.append(len(row["x"]) // (4 * N_FEATURES))
            file.write(row["x"])
        file.flush()
        every = np.memmap(file, np.float32, "r", shape=(sum(sizes), N_FEATURES)) if ids else np.zeros((0, N_FEATURES), np.float32)
        start = np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))
        order = sorted(range(len(ids)), key=lambda i: (ids[i], sizes[i]))
        return _train(every, [slice(start[i], start[i + 1]) for i in order], np.array([ys[i] for i in order], float))


def _train(every: np.ndarray, bags: list[slice], ys: np.ndarray) -> Model:
    """The model of bags, given as slices of all passages."""
    rng = np.random.Generator(np.random.PCG64(7))
    shapes = [(N_FEATURES, HIDDEN), (HIDDEN,), (HIDDEN, GATE), (HIDDEN, GATE), (GATE,), (HIDDEN,), (1,)]
    params = [rng.normal(0, 1 / np.sqrt(s[0]), s) if len(s) > 1 else rng.normal(0, 0.1, s) for s in shapes]
    if len(set(ys.tolist())) < 2:
        level = 0.0 if not len(ys) else (4.0 if ys[0] else -4.0)
        return Model(np.zeros(N_FEATURES), np.ones(N_FEATURES), tuple([*[np.zeros(s) for s in shapes[:-1]], np.array([level])]))
    mean = sum(every[at].sum(0, dtype=float) for at in bags) / len(every)
    scale = np.sqrt(sum(((every[at] - mean) ** 2).sum(0) for at in bags) / len(every)) + 1e-2
    params[-1][0] = np.log(ys.mean() / (1 - ys.mean()))
    m, v, step = [np.zeros(s) for s in shapes], [np.zeros(s) for s in shapes], 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(bags))
        for lo in range(0, len(order), BATCH):
            at = order[lo : lo + BATCH]
            bag = np.concatenate(([0], np.cumsum([bags[i].stop - bags[i].start for i in at])))
            grads = _gradient((np.concatenate([every[bags[i]] for i in at]) - mean) / scale, bag, ys[at], tuple(params))
            step += 1
            rate = RATE * (1 - 0.9 * epoch / EPOCHS)
            for k, g in enumerate(grads):
                m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
                params[k] = params[k] - rate * (m[k] / (1 - 0.9**step) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8) + DECAY * params[k])
    return Model(mean, scale, tuple(params))


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", *more: Column) -> DataFrame:
    """(doc_id, *more, score) for each row; null and wordless texts are one empty passage."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((model.mean, model.scale, model.params))
    rows = docs.select(F.col(text).alias("text__"), F.col(doc_id).cast("long").alias("doc_id"), *more)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*shared.value)
        for batch in batches:
            parts = [own.score(*encode(w)) for w in slices(batch.column(0))]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(np.concatenate(parts) if parts else np.zeros(0))], [*batch.schema.names[1:], "score"])

    fields = ", ".join(f"`{c}` {t}" for c, t in rows.drop("text__").dtypes)
    return rows.mapInArrow(run, f"{fields}, score double")
