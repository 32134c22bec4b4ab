"""TF-IDF over blocks of documents: terms leave a block once, not once a document.

Rows are dealt by a hash of their id over blocks of a bounded number of characters, so rows of one id meet.  A
block counts its terms in numpy and sends each distinct one, with its document frequency in the block, to the
shard of the term.  A shard adds the frequencies up and answers every block in the order in which the block
sent its terms, so no term travels back.  The block then has what its weights need.  Terms stay what they
are: no hash stands for one.

A block and a shard are what a task holds at a time; a term has one entry a block in its shard, however many
documents contain it.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from typing import NamedTuple
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

#: Characters of the texts of a block, and of those whose terms fall to one shard.
BLOCK_CHARS, SHARD_CHARS = 4 << 20, 6 << 20
_SENT = "block long, shard long, size long, data binary"
_BATCH_ROWS = 1 << 16


class Counted(NamedTuple):
    """A block's distinct terms by shard, and per (term, row) how often the row has it."""

    terms: pa.Array
    starts: np.ndarray  # of each shard in ``terms``, and the end
    term: np.ndarray
    row: np.ndarray
    tf: np.ndarray


def counted(words: pa.Array, stop: list[str], shards: int) -> Counted:
    """``words``: texts whose words are parted by blanks.  The order of the terms depends on the texts only, not on that of the rows."""
    parts = pc.split_pattern(words, " ")
    row = np.repeat(np.arange(len(words)), pc.fill_null(pc.list_value_length(parts), 0).to_numpy(zero_copy_only=False))
    coded = pc.list_flatten(parts).dictionary_encode()
    known = pc.and_(pc.greater_equal(pc.utf8_length(coded.dictionary), 2), pc.invert(pc.is_in(coded.dictionary, value_set=pa.array(stop, pa.string()))))
    names = coded.dictionary.filter(known)
    by_name = pc.sort_indices(names).to_numpy()
    rank = np.full(len(coded.dictionary), -1, np.int64)
    rank[np.flatnonzero(known.to_numpy(zero_copy_only=False))[by_name]] = np.arange(len(names))
    names, code = names.take(by_name), rank[coded.indices.to_numpy(zero_copy_only=False)]
    row, code = row[code >= 0], code[code >= 0]
    n, two = len(names), row[1:] == row[:-1]
    terms, at = np.unique(np.concatenate([code, n + code[:-1][two] * n + code[1:][two]]), return_inverse=True)
    entries, tf = np.unique(at * len(words) + np.concatenate([row, row[1:][two]]), return_counts=True)
    single = np.searchsorted(terms, n)
    first, second = np.divmod(terms[single:] - n, max(n, 1))
    texts = pa.concat_arrays([names.take(terms[:single]), pc.binary_join_element_wise(names.take(first), names.take(second), " ")])
    marks = np.fromiter((crc32(w) for w in names.cast(pa.binary()).to_pylist()), np.uint64, n)
    marks = np.concatenate([marks[terms[:single]], marks[first] * np.uint64(0x9E3779B97F4A7C15) + marks[second]]) * np.uint64(0xC2B2AE3D27D4EB4F)
    shard = (marks >> np.uint64(32)) % np.uint64(shards)
    order = np.argsort(shard, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    starts = np.searchsorted(shard[order], np.arange(shards + 1, dtype=np.uint64))
    term, row = np.divmod(entries, max(len(words), 1))
    return Counted(texts.take(order), starts, place[term], row, tf)


def _packed(*arrays: np.ndarray | pa.Buffer) -> tuple[int, bytes]:
    raw = b"".join(memoryview(a) for a in arrays)
    return len(raw), pa.compress(raw, codec="zstd", asbytes=True)


def _sent(rows: list[tuple[int, int, int, bytes]]) -> pa.Table:
    return pa.table([pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True) if rows else [()] * 4, (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["block", "shard", "size", "data"])


def _strings(data: bytes, lengths: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
    return pa.LargeStringArray.from_buffers(len(lengths), pa.py_buffer(offsets), pa.py_buffer(data))


def send(block: int, got: Counted) -> pa.Table:
    """For each shard the document frequencies in the block, the lengths and the characters of its terms."""
    df = np.bincount(got.term, minlength=len(got.terms)).astype(np.uint32)
    offsets = pc.binary_length(got.terms).to_numpy(zero_copy_only=False).astype(np.uint32)
    ends = np.concatenate([[0], np.cumsum(offsets, dtype=np.int64)])
    data = memoryview(got.terms.buffers()[2] or b"")
    rows = []
    for k in np.flatnonzero(np.diff(got.starts)).tolist():
        a, b = got.starts[k], got.starts[k + 1]
        rows.append((block, k, *_packed(np.array([b - a], np.uint32), df[a:b], offsets[a:b], data[ends[a] : ends[b]])))
    return _sent(rows)


def answer(table: pa.Table) -> pa.Table:
    """The document frequencies over all blocks, in the order in which each block sent its terms."""
    dfs, lengths, data = [], [], []
    for size, packed in zip(table["size"].to_pylist(), table["data"], strict=True):
        raw = pa.decompress(packed.as_buffer(), size, codec="zstd", asbytes=True)
        n = int(np.frombuffer(raw, np.uint32, 1)[0])
        dfs.append(np.frombuffer(raw, np.uint32, n, 4))
        lengths.append(np.frombuffer(raw, np.uint32, n, 4 + 4 * n))
        data.append(raw[4 + 8 * n :])
    at = _strings(b"".join(data), np.concatenate(lengths)).dictionary_encode().indices.to_numpy()
    total = np.bincount(at, np.concatenate(dfs))[at].astype(np.uint32)
    parts = np.split(total, np.cumsum([len(x) for x in dfs])[:-1])
    return _sent([(b, s, *_packed(x)) for b, s, x in zip(table["block"].to_pylist(), table["shard"].to_pylist(), parts, strict=True)])


def received(got: Counted, answers: pa.Table) -> np.ndarray:
    """Document frequencies of the block's terms."""
    parts = sorted(zip(answers["shard"].to_pylist(), answers["size"].to_pylist(), answers["data"], strict=True), key=lambda x: x[0])
    df = np.concatenate([np.empty(0, np.uint32), *(np.frombuffer(pa.decompress(x.as_buffer(), n, codec="zstd", asbytes=True), np.uint32) for _, n, x in parts)])
    if len(df) != len(got.terms):
        raise ValueError(f"{len(df)} document frequencies for {len(got.terms)} terms: the texts changed while they were read")
    return df.astype(np.int64)


def weighted(df: DataFrame, id_col: str, text: str, stop: list[str], min_df: int, max_df: float, schema: StructType, take: Callable[[pa.Array, Counted, np.ndarray, np.ndarray, np.ndarray], pa.Table]) -> DataFrame:
    """``take(ids, counted, entries, weights, df)`` of every block: ``entries`` are those of terms within the bounds, ``weights`` theirs."""
    n_docs, chars = df.agg(F.count("*"), F.coalesce(F.sum(F.length(text)), F.lit(0))).first()
    blocks = max(df.sparkSession.sparkContext.defaultParallelism, math.ceil(chars / BLOCK_CHARS))
    shards = max(1, math.ceil(chars / SHARD_CHARS))
    words = F.regexp_replace(F.lower(F.col(text)), r"[^\p{L}\p{N}_]+", " ")
    rows = df.select(F.pmod(F.xxhash64(F.col(id_col)), F.lit(blocks)).alias("block"), F.col(id_col).alias("id"), words.alias("words"))

    def out(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        return send(key[0].as_py(), counted(table["words"].combine_chunks(), stop, shards))

    def weigh(table: pa.Table, answers: pa.Table) -> pa.Table:
        got = counted(table["words"].combine_chunks(), stop, shards)
        found = received(got, answers)
        entries = np.flatnonzero(((found >= min_df) & (found <= max_df * n_docs))[got.term])
        raw = (1.0 + np.log(got.tf[entries])) * (np.log((1.0 + n_docs) / (1.0 + found)) + 1.0)[got.term[entries]]
        ids = table["id"].combine_chunks()
        same = ids.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)[got.row[entries]]
        rows = take(ids, got, entries, raw / np.sqrt(np.bincount(same, raw * raw))[same], found)
        return pa.Table.from_batches(rows.to_batches(max_chunksize=_BATCH_ROWS), rows.schema)

    frequencies = rows.groupBy("block").applyInArrow(out, _SENT).groupBy("shard").applyInArrow(answer, _SENT)
    return rows.groupBy("block").cogroup(frequencies.groupBy("block")).applyInArrow(weigh, schema)


def weights(df: DataFrame, id_col: str, text: str, stop: list[str], min_df: int, max_df: float, floor: float | None = None) -> DataFrame:
    """(id, term, weight) of at least ``floor``."""

    def take(ids: pa.Array, got: Counted, entries: np.ndarray, weight: np.ndarray, _: np.ndarray) -> pa.Table:
        if floor is not None:
            entries, weight = entries[weight >= floor], weight[weight >= floor]
        return pa.table([ids.take(got.row[entries]), got.terms.take(got.term[entries]), weight], names=[id_col, "term", "weight"])

    schema = StructType([StructField(id_col, df.schema[id_col].dataType), StructField("term", StringType()), StructField("weight", DoubleType())])
    return weighted(df, id_col, text, stop, min_df, max_df, schema, take)


def totals(df: DataFrame, id_col: str, text: str, stop: list[str], min_df: int, max_df: float, least_df: int) -> DataFrame:
    """(term, total): sums of weights of the terms in at least ``least_df`` documents."""

    def take(ids: pa.Array, got: Counted, entries: np.ndarray, weight: np.ndarray, found: np.ndarray) -> pa.Table:
        total = np.bincount(got.term[entries], weight, len(got.terms)).astype(np.float64)  # whole numbers where there are no entries
        kept = np.flatnonzero((total > 0) & (found >= least_df))
        return pa.table([got.terms.take(kept), total[kept]], names=["term", "total"])

    schema = StructType([StructField("term", StringType()), StructField("total", DoubleType())])
    return weighted(df, id_col, text, stop, min_df, max_df, schema, take).groupBy("term").agg(F.sum("total").alias("total"))
