"""Shared folders, bounded bitmaps and connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; a temporary folder only in local mode without one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    got = spark.sparkContext.getCheckpointDir()
    if got:
        return got.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    folder = tempfile.mkdtemp(prefix="llm-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's Arrow batch size: rows hold whole texts, and a task keeps a batch in the
    JVM and in Python at once."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(key, None)
        if now is None or not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


def saved(df: DataFrame) -> DataFrame:
    """The rows written as Parquet in the shared folder and read back: lineage ends here, and a
    lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/llm-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


BITMAP_CELL = 1 << 16


def bitmap(hashes: DataFrame, column: str, bits: int) -> np.ndarray:
    """A packed bitmap with bit ``hash mod 2**bits`` set for every value of a long column.

    Its size is ``2**bits / 8`` bytes whatever the input is.  Partial cells are merged on the
    executors; the driver gets the merged cells only.
    """
    mask = (1 << bits) - 1

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h = b.column(0).drop_null().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            at = np.unique(h & np.uint64(mask))
            cell = (at >> np.uint64(16)).astype(np.int64)
            ids, lo = np.unique(cell, return_index=True)
            parts = np.split((at & np.uint64(0xFFFF)).astype(np.uint16), lo[1:]) if len(ids) else []
            yield pa.record_batch({"cell": pa.array(ids, pa.int64()), "at": pa.array([p.tobytes() for p in parts], pa.binary())})

    def merge(key, table):
        bit = np.zeros(BITMAP_CELL, np.uint8)
        for blob in table.column("at").to_pylist():
            bit[np.frombuffer(blob, np.uint16)] = 1
        return pa.table({"cell": pa.array([key[0].as_py()], pa.int64()), "at": pa.array([np.packbits(bit, bitorder="little").tobytes()], pa.binary())})

    schema = "cell long, at binary"
    rows = hashes.select(column).mapInArrow(cells, schema).groupBy("cell").applyInArrow(merge, schema).collect()
    out = np.zeros(max(1, (1 << bits) // 8), np.uint8)
    step = BITMAP_CELL // 8
    for r in rows:
        lo = r["cell"] * step
        part = np.frombuffer(bytes(r["at"]), np.uint8)[: len(out) - lo]
        out[lo : lo + len(part)] = part
    return out


def in_bitmap(bitmap_: np.ndarray, bits: int, h: np.ndarray) -> np.ndarray:
    at = h & np.uint64((1 << bits) - 1)
    return (bitmap_[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


BLOCK_EDGES = 1 << 20


def _stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(vertex, smallest vertex reached, whether no edge has the vertex as ``u``) for each vertex of an edge
    list that reaches a smaller one."""
    ids, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(ids))
    while True:
        x, y = root[a], root[b]
        if (x == y).all():
            break
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while ((up := root[root]) != root).any():
            root = up
    below = np.flatnonzero(root != np.arange(len(ids)))
    loose = np.ones(len(ids), bool)
    loose[a] = False
    return ids[below], ids[root[below]], loose[below]


def _contracted(edges: DataFrame, whole: bool = False) -> DataFrame:
    """Blocks of edges (u, v) as stars around each block's smallest vertices.  ``whole``: rows are sorted
    by u, and no block ends between rows of one u."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(u: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
            u, v, loose = _stars(u, v)
            return pa.record_batch({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64()), "loose": pa.array(loose)})

        held: list[tuple[np.ndarray, np.ndarray]] = []
        n = 0
        for batch in batches:
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            n += batch.num_rows
            if n >= BLOCK_EDGES:
                u, v = (np.concatenate(x) for x in zip(*held, strict=True))
                cut = np.searchsorted(u, u[-1]) if whole else n
                if cut:
                    yield flush(u[:cut], v[:cut])
                held, n = [(u[cut:], v[cut:])], n - cut
        if n:
            yield flush(*(np.concatenate(x) for x in zip(*held, strict=True)))

    return edges.select("u", "v").mapInArrow(run, "u long, v long, loose boolean")


def roots(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(vertex, component) for every vertex of an edge list that reaches a smaller one; component is the
    smallest vertex reached.

    Every round contracts blocks of edges to stars, lets each vertex's rows meet (one a block at most, so
    none is hot) and links its parents there, and then points each vertex at its parent's parent by an
    equi-join that adaptive execution splits when a hub is hot.  The edge list is a star forest once all
    rows of a vertex are where they meet and no parent has a parent.  A round has three shuffles in two
    short plans, as the driver keeps plans and tasks of each; the edge list is written in between and no
    list reaches the driver.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v")
    while True:
        met = saved(_contracted(_contracted(e).repartition("u").sortWithinPartitions("u"), whole=True))
        low = met.groupBy(F.col("u").alias("parent")).agg(F.min("v").alias("low"))
        e = met.join(low, F.col("v") == F.col("parent"), "left")
        e = saved(e.select("u", F.coalesce("low", "v").alias("v"), (F.col("loose") | F.col("low").isNotNull()).alias("open")))
        if e.where("open").isEmpty():
            return e.select(F.col("u").alias("vertex"), F.col("v").alias("component"))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(vertex, component) for every vertex that has an edge to another one, as ``roots`` with the smallest vertices."""
    e = roots(edges, a, b)
    return e.unionAll(e.select(F.col("component").alias("vertex"), "component").distinct())
