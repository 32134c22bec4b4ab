"""N-gram Jaccard join by a grouped prefix join.

Two documents link when the Jaccard similarity of their sets of word shingles reaches a threshold
``num / den``.  Shingles have one global order: rare ones first, frequent ones last.
Two linked sets must share a shingle of their prefixes (the first ``n - ceil(t n) + 1``), so:

1. one scan counts shingles in hashed counters of fixed size (the order affects speed, never results);
2. one scan writes for each document its set's size, key and prefix;
3. sets with the same prefix and size form a group; groups, not documents, enter the prefix join;
4. group pairs that share a prefix shingle pass the size and the positional filter, are expanded
   to their distinct sets and verified on the exact sets.

Equal sets are never paired with each other, and no bucket emits all its pairs: first each bucket is
verified against its smallest group only, then, while it holds sets of several components, against a
few more of its sets.  Links inside a connected component cannot change components, so at last only
sets of a bucket that are in different components by then are paired.  All links between components
are found that way; component ids are those of the full join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapewire.llm.substring_dedup import SHARD_BITS, _pack, _unpack
from tapewire.llm.tables import bitmap, in_bitmap, roots, saved, small_batches
from tapewire.llm.words import set_key, shingle_sets, slices

#: Hashed counters that order shingles by frequency: 2**COUNTER_BITS bytes are broadcast.
COUNTER_BITS = 24
BLOCK_SHINGLES = 1 << 20
ID_BITMAP_BITS = 26
#: Turns in which each bucket is verified against one more of its sets, before the rest is paired.
PIVOT_TURNS = 1


def _signed(x: np.ndarray | list) -> pa.Array:
    return pa.array(np.asarray(x, np.uint64).view(np.int64), pa.int64())


def _cells(h: np.ndarray) -> np.ndarray:
    return ((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - COUNTER_BITS)).astype(np.int64)


def shingle_frequency(docs: DataFrame, text: str, size: int) -> np.ndarray:
    """One byte for each of ``2**COUNTER_BITS`` hashed counters: how many sets touch it, on a log scale."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        seen: set[int] = set()
        n = 0

        def flush():
            x = np.sort(_cells(np.concatenate(held)))
            shard = x >> SHARD_BITS
            at = np.flatnonzero(np.diff(shard, prepend=-1))
            blobs = [_pack(x[lo:hi] & ((1 << SHARD_BITS) - 1)) for lo, hi in zip(at, [*at[1:], len(x)], strict=True)]
            return pa.record_batch({"shard": pa.array(shard[at], pa.int64()), "at": pa.array(blobs, pa.binary())})

        for batch in batches:
            for w in slices(batch.column(0), lower=True):
                for s in shingle_sets(w, size):
                    key = int(set_key(s))
                    if len(s) and key not in seen:  # copies are one group later
                        seen.add(key)
                        held.append(s)
                        n += len(s)
                if n >= BLOCK_SHINGLES:
                    yield flush()
                    held, n, seen = [], 0, set()
        if held:
            yield flush()

    def merge(key, table):
        total = np.zeros(1 << SHARD_BITS, np.int64)
        for blob in table.column("at").to_pylist():
            total += np.bincount(_unpack(blob), minlength=1 << SHARD_BITS)
        scale = np.minimum(255, np.round(6 * np.log2(1 + total))).astype(np.uint8)
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int64()), "at": pa.array([scale.tobytes()], pa.binary())})

    schema = "shard long, at binary"
    parts = docs.select(text).mapInArrow(count, schema).groupBy("shard").applyInArrow(merge, schema).toArrow()
    out = np.zeros(1 << COUNTER_BITS, np.uint8)
    for shard, blob in zip(parts["shard"].to_pylist(), parts["at"], strict=True):
        out[shard << SHARD_BITS : (shard + 1) << SHARD_BITS] = np.frombuffer(blob.as_buffer(), np.uint8)
    return out


def _prefixes(docs: DataFrame, doc_id: str, text: str, size: int, num: int, den: int) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(shingle_frequency(docs, text, size))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequency = shared.value
        for batch in batches:
            ids = batch.column(0)
            for w in slices(batch.column(1), lower=True):
                sets = shingle_sets(w, size)
                every = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
                often = frequency[_cells(every)]
                n, s1, s2, g1, g2, prefix, lo = [], [], [], [], [], [], 0
                for s in sets:
                    hi = lo + len(s)
                    p = len(s) - -(-num * len(s) // den) + 1 if len(s) else 0
                    head = s[np.argsort(often[lo:hi], kind="stable")[:p]]  # sets are sorted by hash: ties stay so
                    n.append(len(s))
                    s1.append(set_key(s))
                    s2.append(set_key(s, 1))
                    g1.append(set_key(head, len(s) + 2))
                    g2.append(set_key(head, len(s) + 3))
                    prefix.append(head)
                    lo = hi
                flat = np.concatenate(prefix) if prefix else np.zeros(0, np.uint64)
                offsets = np.concatenate(([0], np.cumsum([len(x) for x in prefix])))
                yield pa.record_batch(
                    {
                        "doc_id": ids.slice(w.first, w.n_docs),
                        "n": pa.array(n, pa.int64()),
                        "s1": _signed(s1),
                        "s2": _signed(s2),
                        "g1": _signed(g1),
                        "g2": _signed(g2),
                        "prefix": pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), _signed(flat)),
                    }
                )

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    out = saved(rows.mapInArrow(scan, "doc_id long, n long, s1 long, s2 long, g1 long, g2 long, prefix array<long>"))
    shared.destroy()
    return out


def _verified(docs: DataFrame, doc_id: str, text: str, pairs: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose exact sets reach the threshold, written."""
    spark = docs.sparkSession
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).select(F.xxhash64("id").alias("h"))
    wanted = spark.sparkContext.broadcast(bitmap(ids, "h", ID_BITMAP_BITS))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = batch.column(2).to_numpy().view(np.uint64)
            keep = np.flatnonzero(in_bitmap(wanted.value, ID_BITMAP_BITS, h) & batch.column(0).is_valid().to_numpy(zero_copy_only=False))
            some = batch.take(pa.array(keep))
            for w in slices(some.column(1), lower=True):
                found = shingle_sets(w, size)
                yield pa.record_batch({"id": some.column(0).slice(w.first, w.n_docs), "s": pa.array([x.tobytes() for x in found], pa.binary())})

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for k, (x, y) in enumerate(zip(batch.column("x"), batch.column("y"), strict=True)):
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if min(len(p), len(q)) * den < max(len(p), len(q)) * num:
                    continue
                if len(p) > len(q):
                    p, q = q, p
                at = np.searchsorted(q, p)
                at[at == len(q)] = 0
                both = int((q[at] == p).sum())
                if den * both >= num * (len(p) + len(q) - both):
                    keep.append(k)
            at = pa.array(keep, pa.int64())
            yield pa.record_batch({"a": batch.column("a").take(at), "b": batch.column("b").take(at)})

    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    table = rows.withColumn("h", F.xxhash64("id")).mapInArrow(sets, "id long, s binary")
    left = pairs.join(table.select(F.col("id").alias("a"), F.col("s").alias("x")), "a")
    full = left.join(table.select(F.col("id").alias("b"), F.col("s").alias("y")), "b")
    out = saved(full.select("a", "b", "x", "y").mapInArrow(compare, "a long, b long").distinct())
    wanted.destroy()  # its job is done
    return out


def jaccard_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each input row.

    Links need ``den * intersection >= num * union``.  A document of fewer words than ``size`` is one
    shingle; a null or wordless text has no shingle and no link.  A null doc_id stays, has a null
    component and links nothing.  Rows of equal doc_id are one vertex; repeated rows stay rows.
    Other columns are ignored.
    """
    small_batches(docs.sparkSession)
    nodes = _prefixes(docs, doc_id, text, size, num, den)
    some = nodes.where("doc_id IS NOT NULL AND n > 0")
    of_set = some.groupBy("s1", "s2", "n").agg(F.min("doc_id").alias("rep"), F.min("g1").alias("g1"), F.min("g2").alias("g2"))
    members = saved(some.join(of_set, ["s1", "s2", "n", "g1", "g2"]).select("doc_id", "rep", "n", "g1", "g2").distinct())
    reps = members.where("doc_id = rep").drop("doc_id")
    groups = reps.groupBy("g1", "g2", "n").agg(F.min("rep").alias("gid"))
    in_group = saved(reps.join(groups, ["g1", "g2", "n"]).select("rep", "gid", "n"))  # read five times: plans stay short

    first = some.join(groups.withColumnRenamed("gid", "doc_id"), ["doc_id", "g1", "g2", "n"]).select("doc_id", "n", "prefix").dropDuplicates(["doc_id", "n"])
    rows = first.select(F.col("doc_id").alias("gid"), "n", F.posexplode("prefix").alias("pos", "token"))
    lows = rows.groupBy("token").agg(F.min(F.struct("gid", "n", "pos")).alias("low"), F.max("gid").alias("high")).where("low.gid < high")
    bucket = saved(rows.join(lows.hint("shuffle_hash"), "token").select("token", "gid", "n", "pos", "low"))

    def fits(n1: str, p1: str, n2: str, p2: str):
        """Size filter, and the largest possible overlap given where the shared shingle stands."""
        n1, p1, n2, p2 = F.col(n1), F.col(p1), F.col(n2), F.col(p2)
        small, large = F.least(n1, n2), F.greatest(n1, n2)
        return (small * den >= large * num) & (F.least(n1 - p1, n2 - p2) * (num + den) >= (n1 + n2) * num)

    pivots = bucket.where("gid <> low.gid").where(fits("n", "pos", "low.n", "low.pos")).select(F.col("low.gid").alias("a"), F.col("gid").alias("b"))
    inside = in_group.where("rep <> gid").select(F.col("gid").alias("a"), F.col("rep").alias("b"))
    pairs = saved(pivots.unionAll(inside).distinct())
    links = _verified(docs, doc_id, text, pairs, size, num, den)

    # what a bucket or a group holds, by set; a group is a bucket of its own
    by_set = in_group.withColumnRenamed("n", "n_")
    held = bucket.select("token", "gid", "n", "pos").join(by_set, "gid").where("n = n_").select("token", "rep", "n", "pos")
    held = held.unionAll(in_group.select((-F.xxhash64("gid", "n")).alias("token"), "rep", "n", F.lit(0).alias("pos")))
    for turn in range(PIVOT_TURNS + 1):
        label = roots(links).withColumnRenamed("vertex", "rep")
        entry = held.join(label, "rep", "left").select("token", "rep", "n", "pos", F.coalesce("component", "rep").alias("component"))
        mixed = entry.groupBy("token").agg(F.min("component").alias("c1"), F.max("component").alias("c2")).where("c1 < c2").select("token")
        held = saved(entry.join(mixed, "token"))  # a bucket within one component is done
        if turn == PIVOT_TURNS:
            break
        # every set of a bucket against a member drawn by hash
        drawn = held.groupBy("token").agg(F.min(F.struct(F.xxhash64("rep", F.lit(turn)), F.col("rep").alias("r"), F.col("n").alias("m"), F.col("pos").alias("p"), F.col("component").alias("c"))).alias("low"))
        tried = held.join(drawn, "token").where("component <> low.c").where(fits("n", "pos", "low.m", "low.p"))
        tried = tried.select(F.least("rep", "low.r").alias("a"), F.greatest("rep", "low.r").alias("b")).distinct()
        tried = saved(tried.join(pairs, ["a", "b"], "left_anti"))
        pairs = pairs.unionAll(tried)
        links = links.unionAll(_verified(docs, doc_id, text, tried, size, num, den))
        held = held.drop("component")

    # what is left: all pairs of sets of a bucket that are in different components
    # components meet under the same filters first, at the best that their sets have in the bucket
    each = held.groupBy("token", "component").agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.max(F.col("n") - F.col("pos")).alias("rest"))
    end = lambda k: each.select("token", *[F.col(c).alias(f"{x}{k}") for c, x in (("component", "c"), ("lo", "lo"), ("hi", "hi"), ("rest", "rest"))])
    near = (F.col("hi1") * den >= F.col("lo2") * num) & (F.col("hi2") * den >= F.col("lo1") * num)
    near &= F.least("rest1", "rest2") * (num + den) >= (F.col("lo1") + F.col("lo2")) * num
    two = end(1).join(end(2), "token").where("c1 < c2").where(near).select("token", "c1", "c2")
    side = lambda k: held.select("token", F.col("component").alias(f"c{k}"), F.col("rep").alias(f"r{k}"), F.col("n").alias(f"n{k}"), F.col("pos").alias(f"p{k}"))
    cross = two.join(side(1), ["token", "c1"]).join(side(2), ["token", "c2"]).where(fits("n1", "p1", "n2", "p2"))
    cross = saved(cross.select(F.least("r1", "r2").alias("a"), F.greatest("r1", "r2").alias("b")).distinct().join(pairs, ["a", "b"], "left_anti"))
    more = _verified(docs, doc_id, text, cross, size, num, den)

    # rows of equal doc_id with different sets are one vertex
    many = members.groupBy("doc_id").agg(F.min("rep").alias("r1"), F.max("rep").alias("r2")).where("r1 < r2").select("doc_id", "r1")
    same = members.join(many, "doc_id").where("rep <> r1").select(F.col("r1").alias("a"), F.col("rep").alias("b"))
    final = roots(links.unionAll(more.select("a", "b")).unionAll(same))
    of_doc = members.groupBy("doc_id").agg(F.min("rep").alias("rep"))
    got = of_doc.join(final.select(F.col("vertex").alias("rep"), "component"), "rep", "left").select("doc_id", F.coalesce("component", "rep").alias("component"))
    return nodes.select("doc_id", "n").join(got, "doc_id", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))
