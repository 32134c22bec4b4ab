"""Benchmark decontamination by a size-partitioned MinHash containment search.

An item leaks into a document when the document has at least ``num / den`` of the item's distinct
word shingles, wherever they stand in it.  Items are short and documents long, so their Jaccard
similarity is near zero; the search therefore asks for containment:

* items are partitioned by size.  Each partition has its own signature length: a document that has
  ``ceil(t n)`` of ``n`` shingles lacks at most ``n - ceil(t n)``, so of the item's bottom-k MinHash
  (its k smallest hash values) with ``k = n - ceil(t n) + 1`` it has at least one.  With k chosen for
  the largest size of the partition no item can be missed;
* documents are partitioned by size as well; a partition meets only items small enough for it;
* candidates (a document with one value of an item's signature) are verified by exact containment, and
  nothing else is: an item's shingles are joined to its candidates only;
* an item of fewer words than a shingle is one short shingle; documents look up their windows of those
  lengths that occur among the items, too.

Two bitmaps of fixed size tell the scan which shingles of a document can matter.  False positives of
the bitmaps cost rows and are sorted out by the joins; the item table may be of any size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapewire.llm.tables import bitmap, in_bitmap, saved, small_batches
from tapewire.llm.words import Words, shingle_sets, slices, window_hashes, window_starts

BITMAP_BITS = 26


def _item_shingles(items: DataFrame, item_id: str, text: str, size: int, num: int, den: int) -> DataFrame:
    """(item_id, variant, n, part, token, signature, short) with one row for each distinct shingle.

    ``short``: the words of an item of fewer than ``size`` words, else 0.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w in slices(batch.column(1), lower=True):
                ids = batch.column(0).slice(w.first, w.n_docs).to_pylist()
                for item, s, words in zip(ids, shingle_sets(w, size), np.diff(w.bounds).tolist(), strict=True):
                    n = len(s)
                    if item is None or n == 0:
                        continue
                    part = n.bit_length()  # sizes 2**(part - 1) to 2**part - 1
                    top = (1 << part) - 1
                    k = min(n, top - -(-num * top // den) + 1)
                    yield pa.record_batch(
                        {
                            "item_id": pa.array(np.full(n, item), pa.int64()),
                            "variant": pa.array(np.full(n, int(s[0])).astype(np.uint64).view(np.int64), pa.int64()),
                            "n": pa.array(np.full(n, n), pa.int64()),
                            "part": pa.array(np.full(n, part), pa.int32()),
                            "token": pa.array(s.view(np.int64), pa.int64()),
                            "signature": pa.array(np.arange(n) < k),  # sets are sorted by hash
                            "short": pa.array(np.full(n, words if words < size else 0), pa.int32()),
                        }
                    )

    rows = items.select(F.col(item_id).cast("long").alias("item_id"), F.col(text).alias("text"))
    return rows.mapInArrow(scan, "item_id long, variant long, n long, part int, token long, signature boolean, short int")


def leaks(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", size: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """(doc_id, item_id, n_item, n_shared, containment): one row for each item found in a document.

    Words are cut and A-Z lowered as for the other shingle operators.  An item of fewer words than ``size`` is
    one shingle, found wherever a document has these words in a row.  Null ids, null and wordless texts take
    part in nothing.  Repeated documents or items give one row a pair; of rows with equal ids and
    different texts the best containment counts.  Other columns are ignored.
    """
    small_batches(docs.sparkSession)
    spark = docs.sparkSession
    table = saved(_item_shingles(items, item_id, item_text, size, num, den).dropDuplicates(["item_id", "variant", "n", "token"]))
    every = spark.sparkContext.broadcast(bitmap(table, "token", BITMAP_BITS))
    heads = spark.sparkContext.broadcast(bitmap(table.where("signature"), "token", BITMAP_BITS))

    lengths = sorted(r[0] for r in table.where("short > 0").select("short").distinct().collect())  # fewer than size

    def shingles(w: Words) -> list[np.ndarray]:
        """The sets of a slice's texts, with their windows of the short items' lengths."""
        sets = shingle_sets(w, size)
        for length in lengths:
            windows, at = window_hashes(w.hashes, length), window_starts(w.bounds, length)
            cut = np.searchsorted(at, w.bounds)
            hit = in_bitmap(every.value, BITMAP_BITS, windows[at]) if len(at) else np.zeros(0, bool)
            for k in range(len(sets)):
                mine = slice(cut[k], cut[k + 1])
                if hit[mine].any():
                    sets[k] = np.union1d(sets[k], windows[at[mine][hit[mine]]])
        return sets

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w in slices(batch.column(1), lower=True):
                ids = batch.column(0).slice(w.first, w.n_docs).to_pylist()
                sets = shingles(w)
                bounds = np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int64)
                flat = np.concatenate(sets)
                hit = in_bitmap(every.value, BITMAP_BITS, flat)
                head = hit.copy()
                head[hit] = in_bitmap(heads.value, BITMAP_BITS, flat[hit])
                count = np.concatenate(([0], np.cumsum(head)))
                for k in np.flatnonzero(count[bounds[1:]] > count[bounds[:-1]]):
                    lo, hi = bounds[k], bounds[k + 1]
                    if ids[k] is None:
                        continue
                    token = flat[lo:hi][hit[lo:hi]]
                    m = len(token)
                    yield pa.record_batch(
                        {
                            "doc_id": pa.array(np.full(m, ids[k]), pa.int64()),
                            "text_key": pa.array(np.full(m, int(flat[lo])).astype(np.uint64).view(np.int64), pa.int64()),
                            "part": pa.array(np.full(m, int(hi - lo).bit_length()), pa.int32()),
                            "token": pa.array(token.view(np.int64), pa.int64()),
                            "head": pa.array(head[lo:hi][hit[lo:hi]]),
                        }
                    )

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    hits = saved(rows.mapInArrow(probe, "doc_id long, text_key long, part int, token long, head boolean"))
    of_item = table.withColumnRenamed("part", "item_part")
    pair = ["doc_id", "text_key", "part", "item_id", "variant", "n"]
    # a document of partition p has fewer than 2**p shingles and must have t n of them
    fits = F.pow(F.lit(2.0), F.col("part")) * den > F.col("n") * num
    candidates = hits.where("head").join(of_item.where("signature"), "token").where(fits).select(pair).distinct()
    asked = candidates.join(of_item.select("item_id", "variant", "n", "token"), ["item_id", "variant", "n"])
    there = hits.select("doc_id", "text_key", "part", "token").distinct()
    shared = asked.join(there, ["doc_id", "text_key", "part", "token"]).groupBy(pair).agg(F.count("*").alias("n_shared"))
    exact = shared.where(F.col("n_shared") * den >= F.col("n") * num)
    best = exact.groupBy("doc_id", "item_id").agg(F.max(F.struct((F.col("n_shared") / F.col("n")).alias("containment"), "n", "n_shared")).alias("x"))
    return best.select("doc_id", "item_id", F.col("x.n").alias("n_item"), F.col("x.n_shared").alias("n_shared"), F.col("x.containment").alias("containment"))
