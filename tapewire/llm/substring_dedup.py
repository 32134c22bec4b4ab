"""Substring de-duplication with a count-min prefilter.

A window is ``size`` consecutive words of one document.  Every word covered by a window whose word
sequence also starts in a document of smaller id is removed; windows are judged on the input.

1. Each block of documents writes a count-min sketch of its windows (positions of the counters it
   touches, by shard of the counter array).  Shards are merged on the executors; the merged counters
   give never less than a window's count.
2. A second scan looks windows up in the merged sketch and sends on only those estimated to occur
   twice or more.  They are grouped exactly, by 80-bit keys, in shards of the key space.  Of equal
   windows in one block only the smallest document's are sent, so a window that a third of all
   documents share costs a shard one entry a block.
3. Removed positions go back to the documents, which are read once more and cut.

The sketch has about two counters a window and depth two, up to ``MAX_BITS``; beyond that it
over-estimates more often, which sends more windows to step 2 and changes no result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tapewire.llm.tables import bitmap, in_bitmap, small_batches
from tapewire.llm.words import slices, window_hashes, window_starts

DEPTH = 2
MIN_BITS, MAX_BITS = 18, 30
SHARD_BITS = 18
#: Bitmap of the doc_ids that stand for several texts; a false hit costs bytes only.
MIXED_BITS = 20
BLOCK_WINDOWS = 2 << 20
_ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def _pack(x: np.ndarray) -> bytes:
    """Sorted small integers as differences of one or two bytes; the largest value carries on."""
    gap = np.diff(x, prepend=0)
    base, kind = (255, np.uint8) if len(x) == 0 or x[-1] < 250 * len(x) else (65535, np.uint16)
    over = gap // base
    out = np.full(len(x) + int(over.sum()), base, kind)
    out[np.arange(len(x)) + np.cumsum(over)] = gap % base
    return bytes([kind().itemsize]) + out.tobytes()


def _unpack(blob: bytes) -> np.ndarray:
    v = np.frombuffer(blob, np.uint8 if blob[0] == 1 else np.uint16, offset=1)
    return np.cumsum(v, dtype=np.int64)[v != np.iinfo(v.dtype).max]


def _cells(h: np.ndarray, row: int, bits: int) -> np.ndarray:
    return ((h * _ODD[row]) >> np.uint64(64 - bits)).astype(np.int64)


def repeated_sketch(docs: DataFrame, text: str, size: int, bits: int) -> np.ndarray:
    """For each row of the merged sketch, a packed bitmap of the counters that reached two."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(h: np.ndarray) -> pa.RecordBatch:
            rows, shards, blobs = [], [], []
            for row in range(DEPTH):
                x = np.sort(_cells(h, row, bits))
                x = x[np.concatenate(([True] * min(2, len(x)), x[2:] != x[:-2]))]
                shard = x >> SHARD_BITS
                at = np.flatnonzero(np.diff(shard, prepend=-1))
                for lo, hi in zip(at, [*at[1:], len(x)], strict=True):
                    rows.append(row)
                    shards.append(int(shard[lo]))
                    blobs.append(_pack(x[lo:hi] & ((1 << SHARD_BITS) - 1)))
            return pa.record_batch({"row": pa.array(rows, pa.int32()), "shard": pa.array(shards, pa.int64()), "at": pa.array(blobs, pa.binary())})

        held, n = [], 0
        for batch in batches:
            for w in slices(batch.column(0)):
                h = window_hashes(w.hashes, size)
                held.append(h[window_starts(w.bounds, size)])
                n += len(held[-1])
                if n >= BLOCK_WINDOWS:
                    yield flush(np.concatenate(held))
                    held, n = [], 0
        if n:
            yield flush(np.concatenate(held))

    def merge(key, table):
        count = np.zeros(1 << SHARD_BITS, np.int32)
        for blob in table.column("at").to_pylist():
            count += np.bincount(_unpack(blob), minlength=1 << SHARD_BITS).astype(np.int32)
        bit = np.packbits(count >= 2, bitorder="little").tobytes()
        return pa.table({"row": pa.array([key[0].as_py()], pa.int32()), "shard": pa.array([key[1].as_py()], pa.int64()), "at": pa.array([bit], pa.binary())})

    schema = "row int, shard long, at binary"
    parts = docs.select(text).mapInArrow(sketch, schema).groupBy("row", "shard").applyInArrow(merge, schema).toArrow()
    out = np.zeros((DEPTH, (1 << bits) // 8), np.uint8)
    step = (1 << SHARD_BITS) // 8
    for row, shard, blob in zip(parts["row"].to_pylist(), parts["shard"].to_pylist(), parts["at"], strict=True):
        out[row, shard * step : (shard + 1) * step] = np.frombuffer(blob.as_buffer(), np.uint8)
    return out


def _estimated_repeated(sketch: np.ndarray, bits: int, h: np.ndarray) -> np.ndarray:
    hit = np.ones(len(h), bool)
    for row in range(DEPTH):
        at = _cells(h[hit], row, bits)
        hit[hit] = (sketch[row][at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
    return hit


def _narrow(x: np.ndarray) -> tuple[int, bytes]:
    """Whole numbers less their minimum in as few bytes as their range needs."""
    low = int(x.min())
    gap = (x - low).view(np.uint64) if x.dtype == np.int64 else x - x.dtype.type(low)
    top = int(gap.max())
    kind = np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.uint64
    return low, bytes([np.dtype(kind).itemsize]) + gap.astype(kind).tobytes()


def _wide(low: int, blob: bytes) -> np.ndarray:
    kind = {2: np.uint16, 4: np.uint32, 8: np.uint64}[blob[0]]
    return np.frombuffer(blob, kind, offset=1).astype(np.uint64).view(np.int64) + low


def _columns(doc: np.ndarray, tag: np.ndarray, pos: np.ndarray) -> dict:
    low, docs = _narrow(doc)
    first, places = _narrow(pos)
    return {"low": low, "doc": docs, "tag": tag.tobytes() if tag.any() else b"", "first": first, "pos": places}


_SPANS = "low long, doc binary, tag binary, first long, pos binary"
_SPAN_FIELDS = [("low", pa.int64()), ("doc", pa.binary()), ("tag", pa.binary()), ("first", pa.int64()), ("pos", pa.binary())]


def _read(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    got = [table.column(c).to_pylist() for c, _ in _SPAN_FIELDS]
    doc = [_wide(low, b) for low, b in zip(got[0], got[1], strict=True)]
    pos = [_wide(low, b) for low, b in zip(got[3], got[4], strict=True)]
    tag = [np.frombuffer(b, np.int64) if b else np.zeros(len(d), np.int64) for b, d in zip(got[2], doc, strict=True)]
    return np.concatenate(doc), np.concatenate(tag), np.concatenate(pos)


def _prime(n: int) -> int:
    """The smallest prime from ``n`` on, so that regular ids spread over buckets."""
    while any(n % k == 0 for k in range(2, int(n**0.5) + 1)):
        n += 1
    return n


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 13, carry: list[str] | None = None, original: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept) for each input row; ``kept`` is the text of kept words
    joined by one space.  ``carry`` names columns to pass through (not doc_id, tag, id_hash or shard).  With
    ``original`` the text column is called ``text``, and uncut texts, null among them, stay as they are.

    A null text has no words.  A row with a null doc_id keeps all its words and takes part in no
    comparison.  Rows of equal doc_id never cut each other; repeated rows are cut alike and stay
    repeated.  Other columns are ignored.
    """
    small_batches(docs.sparkSession)
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    bits = int(np.clip(np.round(np.log2(max(total, 1) / 3)), MIN_BITS, MAX_BITS))
    n_shards = max(256, total >> 21)
    n_buckets = _prime(max(64, total >> 23))
    out_name = "text" if original else "kept"
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), *(carry or []))
    # rows of one doc_id are told apart by their text's hash, where there are several texts; elsewhere the tag is 0
    rows = rows.withColumn("tag", F.xxhash64("text")).withColumn("id_hash", F.xxhash64("doc_id"))
    known = rows.where("doc_id IS NOT NULL")
    mixed = known.groupBy("id_hash").agg(F.min("tag").alias("t1"), F.max("tag").alias("t2")).where("t1 <> t2")
    several = spark.sparkContext.broadcast(bitmap(mixed, "id_hash", MIXED_BITS))

    def tags_of(batch: pa.RecordBatch | pa.Table) -> np.ndarray:
        tag, id_hash = (np.asarray(batch.column(c).to_numpy(), np.int64) for c in ("tag", "id_hash"))
        return np.where(in_bitmap(several.value, MIXED_BITS, id_hash.view(np.uint64)), tag, 0)

    shared = spark.sparkContext.broadcast(repeated_sketch(known, "text", size, bits))

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(parts: list[tuple]) -> list[dict]:
            h, h2, doc, tag, pos = (np.concatenate([p[k] for p in parts]) for k in range(5))
            order = np.lexsort((h2, h))
            h, h2, doc, tag, pos = h[order], h2[order], doc[order], tag[order], pos[order]
            head = np.concatenate(([True], (h[1:] != h[:-1]) | (h2[1:] != h2[:-1])))
            start = np.flatnonzero(head)
            low = np.repeat(np.minimum.reduceat(doc, start), np.diff(np.append(start, len(h))))
            cut = doc > low
            out = cut_rows(doc[cut], tag[cut], pos[cut])
            keep = ~cut
            h, h2, doc, tag, pos = h[keep], h2[keep], doc[keep], tag[keep], pos[keep]
            shard = (h >> np.uint64(32)).astype(np.int64) * n_shards >> 32
            at = np.flatnonzero(np.diff(shard, prepend=-1))
            for lo, hi in zip(at, [*at[1:], len(h)], strict=True):
                s = slice(lo, hi)
                out.append({"cut": False, "shard": int(shard[lo]), "h": h[s].tobytes(), "h2": h2[s].tobytes()} | _columns(doc[s], tag[s], pos[s]))
            return out

        held, n = [], 0
        for batch in batches:
            ids, tags = batch.column(0).to_numpy(), tags_of(batch)
            for w in slices(batch.column(1)):
                at = window_starts(w.bounds, size)
                h = window_hashes(w.hashes, size)[at]
                hit = _estimated_repeated(shared.value, bits, h)
                if not hit.any():
                    continue
                at, h = at[hit], h[hit]
                which = np.searchsorted(w.bounds, at, side="right") - 1
                h2 = (window_hashes(w.hashes, size, 1)[at] >> np.uint64(48)).astype(np.uint16)
                held.append((h, h2, ids[w.first + which], tags[w.first + which], at - w.bounds[which]))
                n += len(h)
                if n >= BLOCK_WINDOWS:
                    yield pa.RecordBatch.from_pylist(flush(held), arrow)
                    held, n = [], 0
        if n:
            yield pa.RecordBatch.from_pylist(flush(held), arrow)

    def cut_rows(doc: np.ndarray, tag: np.ndarray, pos: np.ndarray) -> list[dict]:
        """Positions to cut, by bucket of documents."""
        if not len(doc):
            return []
        bucket = np.mod(doc, n_buckets)
        order = np.lexsort((pos, doc, bucket))
        doc, tag, pos, bucket = doc[order], tag[order], pos[order], bucket[order]
        at = np.flatnonzero(np.diff(bucket, prepend=-1))
        return [{"cut": True, "shard": int(bucket[lo]), "h": None, "h2": None} | _columns(doc[lo:hi], tag[lo:hi], pos[lo:hi]) for lo, hi in zip(at, [*at[1:], len(doc)], strict=True)]

    arrow = pa.schema([("cut", pa.bool_()), ("shard", pa.int64()), ("h", pa.binary()), ("h2", pa.binary()), *_SPAN_FIELDS])

    def group(key, table):
        if table.column("cut")[0].as_py():  # cut already where they were found
            return table.select(["shard", *(c for c, _ in _SPAN_FIELDS)])
        doc, tag, pos = _read(table)
        h = np.concatenate([np.frombuffer(b, np.uint64) for b in table.column("h").to_pylist()])
        h2 = np.concatenate([np.frombuffer(b, np.uint16) for b in table.column("h2").to_pylist()])
        order = np.lexsort((h2, h))
        h, h2, doc, tag, pos = h[order], h2[order], doc[order], tag[order], pos[order]
        start = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (h2[1:] != h2[:-1]))))
        low = np.repeat(np.minimum.reduceat(doc, start), np.diff(np.append(start, len(h))))
        cut = doc > low
        return pa.Table.from_pylist(cut_rows(doc[cut], tag[cut], pos[cut]), arrow).select(["shard", *(c for c, _ in _SPAN_FIELDS)])

    found = known.select("doc_id", "text", "tag", "id_hash").mapInArrow(candidates, f"cut boolean, shard long, h binary, h2 binary, {_SPANS}")
    cuts = found.groupBy("cut", "shard").applyInArrow(group, f"shard long, {_SPANS}")

    def apply(key, texts, spans):
        n = texts.num_rows
        more = {c: texts.column(c) for c in carry or []}
        n_words, n_removed, kept = np.zeros(n, np.int64), np.zeros(n, np.int64), [""] * n
        if spans.num_rows:
            doc, tag, pos = _read(spans)
            order = np.lexsort((pos, tag, doc))
            doc, tag, pos = doc[order], tag[order], pos[order]
        else:
            doc, tag, pos = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        ids, tags = texts.column("doc_id").to_pylist(), tags_of(texts).tolist()
        texts = texts.column("text").combine_chunks()
        if isinstance(texts, pa.ChunkedArray):
            texts = pa.concat_arrays(texts.chunks)
        for k in range(n):
            words = texts[k].as_buffer().to_pybytes().split() if texts[k].is_valid else []
            n_words[k] = len(words)
            lo, hi = (np.searchsorted(doc, ids[k]), np.searchsorted(doc, ids[k], side="right")) if ids[k] is not None else (0, 0)
            if hi > lo:
                at = pos[lo:hi][tag[lo:hi] == tags[k]]
                edge = np.bincount(at, minlength=len(words) + 1) - np.bincount(at + size, minlength=len(words) + 1)[: len(words) + 1]
                gone = np.cumsum(edge[: len(words)]) > 0
                n_removed[k] = int(gone.sum())
                words = [word for word, g in zip(words, gone.tolist(), strict=True) if not g]
            kept[k] = None if original and not n_removed[k] else b" ".join(words)
        kept = pa.array(kept, pa.binary()).cast(pa.string())
        if original:
            kept = pc.if_else(pa.array(n_removed > 0), kept, texts.cast(pa.string()))
        return pa.table({"doc_id": pa.array(ids, pa.int64()), "n_words": n_words, "n_removed": n_removed, out_name: kept} | more)

    spread = F.coalesce(F.pmod("doc_id", F.lit(n_buckets)), F.pmod(F.xxhash64("text"), F.lit(n_buckets)))  # a null text hashes like any other
    left = rows.withColumn("shard", spread)
    schema = [StructField("doc_id", LongType()), StructField("n_words", LongType()), StructField("n_removed", LongType()), StructField(out_name, StringType())]
    schema += [docs.schema[c] for c in carry or []]
    return left.groupBy("shard").cogroup(cuts.groupBy("shard")).applyInArrow(apply, StructType(schema))
