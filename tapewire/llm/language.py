"""Language identification: multinomial naive Bayes over hashed character n-grams.

Character 1- to 3-grams of the lower-cased text are hashed to ``2**BITS`` features.  Every training
document is counted whole.  Counts are summed by (language, block of features) on the executors; the
log-probability matrix (languages x features) is broadcast, and batches are scored in numpy as sparse
sums: one look-up for each n-gram and language, added up by document.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapewire.llm.tables import small_batches
from tapewire.llm.words import as_strings, buffers

BITS = 16
ORDERS = (1, 2, 3)
BLOCK = 1024
SMOOTHING = 0.5
UNKNOWN = "und"
_SLICE = 1 << 20
_LETTER = re.compile(r"[^\W\d_]")
_LOWER = np.array([ord(chr(i).lower()) if len(chr(i).lower()) == 1 else i for i in range(0x600)], np.uint32)


def ngrams(column: pa.Array) -> Iterator[tuple[int, np.ndarray, list[np.ndarray]]]:
    """(first text, n + 1 character bounds, one feature array for each order) of slices of a column.

    An n-gram that would cross the end of its text has the feature ``2**BITS``, which weighs nothing.
    """
    raw, offsets = buffers(as_strings(column))
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + _SLICE, side="right")) - 1)
        part = raw[offsets[i] : offsets[j]]
        lead = np.concatenate(([0], np.cumsum((part & 0xC0) != 0x80)))
        bounds = lead[offsets[i : j + 1] - offsets[i]]
        c = np.frombuffer(part.tobytes().decode("utf-8", "replace").encode("utf-32-le", "replace"), np.uint32)
        low = c < len(_LOWER)
        c = np.where(low, _LOWER[np.where(low, c, 0)], c).astype(np.uint64)
        out = []
        for order in ORDERS:
            h = np.full(len(c), np.uint64(order))
            for k in range(order):
                h[: len(c) - k] = (h[: len(c) - k] ^ c[k:]) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(29)
            f = ((h * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - BITS)).astype(np.int32)
            for back in range(1, order):
                at = bounds[1:] - back
                f[at[at >= bounds[:-1]]] = 1 << BITS
            out.append(f)
        yield i, bounds, out
        i = j


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    log_prior: np.ndarray
    log_prob: np.ndarray  # languages x (2**BITS + 1), the last column 0


def fit(docs: DataFrame, lang: str = "lang", text: str = "text") -> Model:
    """Learns from all rows with a non-null language; a null text adds to the prior only.

    Without such rows the model knows no language and answers ``und``.
    """
    small_batches(docs.sparkSession)
    rows = docs.where(F.col(lang).isNotNull()).select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        docs_of: dict[str, int] = {}
        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), object)
            for first, bounds, parts in ngrams(batch.column(1)):
                own = langs[first : first + len(bounds) - 1]
                for one in set(own.tolist()):
                    which = own == one
                    docs_of[one] = docs_of.get(one, 0) + int(which.sum())
                    mask = np.repeat(which, np.diff(bounds))
                    sums = total.setdefault(one, np.zeros((1 << BITS) + 1, np.int64))
                    for f in parts:
                        sums += np.bincount(f[mask], minlength=(1 << BITS) + 1)
        for one, sums in total.items():
            sums = sums[: 1 << BITS].reshape(-1, BLOCK)
            kind = np.uint8 if sums.max() < 1 << 8 else np.uint16 if sums.max() < 1 << 16 else np.uint32 if sums.max() < 1 << 32 else np.uint64
            yield pa.record_batch(
                {
                    "lang": pa.array([one] * len(sums)),
                    "block": pa.array(np.arange(len(sums)), pa.int32()),
                    "docs": pa.array([docs_of[one]] * len(sums), pa.int64()),
                    "width": pa.array([np.dtype(kind).itemsize] * len(sums), pa.int32()),
                    "counts": pa.array([x.astype(kind).tobytes() for x in sums], pa.binary()),
                }
            )

    def add(key, table):
        sums = np.zeros(BLOCK, np.int64)
        for width, blob in zip(table.column("width").to_pylist(), table.column("counts").to_pylist(), strict=True):
            sums += np.frombuffer(blob, f"<u{width}").astype(np.int64)
        return pa.table({"lang": [key[0].as_py()], "block": pa.array([key[1].as_py()], pa.int32()), "docs": pa.array([sum(table.column("docs").to_pylist())], pa.int64()), "width": pa.array([8], pa.int32()), "counts": pa.array([sums.tobytes()], pa.binary())})

    schema = "lang string, block int, docs long, width int, counts binary"
    got = rows.mapInArrow(count, schema).groupBy("lang", "block").applyInArrow(add, schema).collect()
    names = tuple(sorted({r["lang"] for r in got}))
    counts, prior = np.zeros((len(names), 1 << BITS)), np.zeros(len(names))
    for r in got:
        k = names.index(r["lang"])
        counts[k, r["block"] * BLOCK : (r["block"] + 1) * BLOCK] = np.frombuffer(bytes(r["counts"]), np.int64)
        prior[k] = r["docs"]
    log_prob = np.log((counts + SMOOTHING) / (counts + SMOOTHING).sum(1, keepdims=True)) if names else counts
    return Model(names, np.log(prior / max(prior.sum(), 1)) if names else prior, np.concatenate((log_prob, np.zeros((len(names), 1))), 1))


def predict(docs: DataFrame, model: Model, doc_id: str, text: str = "text", *more: Column) -> DataFrame:
    """(doc_id, *more, lang_pred, score) for each row: the most probable language and its posterior.

    A null text or one without a letter is ``und`` with score 0, as is everything under a model without
    languages; equally probable languages go to the first by name.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.log_prior, model.log_prob))
    rows = docs.select(F.col(text).alias("text__"), F.col(doc_id).cast("long").alias("doc_id"), *more)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, prior, table = shared.value
        for batch in batches:
            texts = batch.column(0)
            named, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
            known = [k for k, t in enumerate(texts.to_pylist()) if t and _LETTER.search(t)] if names else []
            some = texts.take(pa.array(known, pa.int64()))
            for first, bounds, parts in ngrams(some):
                z = np.tile(prior, (len(bounds) - 1, 1))
                for f in parts:
                    for k in range(len(names)):
                        z[:, k] += np.add.reduceat(table[k][f], bounds[:-1])
                best = z.argmax(1)
                p = 1.0 / np.exp(z - z.max(1, keepdims=True)).sum(1)
                for at, (b, s) in enumerate(zip(best.tolist(), p.tolist(), strict=True)):
                    named[known[first + at]], score[known[first + at]] = names[b], s
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(named, pa.string()), pa.array(score)], [*batch.schema.names[1:], "lang_pred", "score"])

    fields = ", ".join(f"`{c}` {t}" for c, t in rows.drop("text__").dtypes)
    return rows.mapInArrow(run, f"{fields}, lang_pred string, score double")
