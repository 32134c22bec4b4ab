"""Gradient boosting for several classes (softmax), one regression tree a class and round.

Features are cut into at most ``bins`` ranges by their quantiles and kept as blocks of bytes.  A tree grows
level by level: each block adds up gradients and Hessians by (class, node, feature, bin), the blocks' sums
are added by task and, where there are many tasks, in a tree of them, and the driver picks the splits; what
reaches it is bounded by ``DIRECT`` x classes x nodes x features x bins.  Gradients are whole numbers (2**-24 units), so sums do not depend on the order of
blocks and a refit gives the same trees.

Margins of the blocks are cached and renewed every ``RENEW`` rounds; a lost executor's blocks are read again
from the shared folder and the trees since are applied again.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.ml import Transformer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from tapewire import config
from tapewire.functions.settle import settle

RENEW = 10
#: Sums of at most so many tasks go straight to the driver; a tree costs a second stage for each level of each round.
DIRECT = 16
UNIT = float(1 << 24)
#: Added to the Hessian sums, and the least of them in a child.
REGULAR, LEAST = 1.0, 1e-3


def _softmax(margin: np.ndarray) -> np.ndarray:
    e = np.exp(margin - margin.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def _leaves(binned: np.ndarray, tree: dict, depth: int) -> np.ndarray:
    """The node of each row after ``depth`` levels of a complete binary tree; 0 is the root of each level."""
    node = np.zeros(len(binned), np.int64)
    for level in range(depth):
        at = (1 << level) - 1 + node
        feature, cut = tree["feature"][at], tree["bin"][at]
        node = 2 * node + (binned[np.arange(len(binned)), feature] > cut)
    return node


def _margins(binned: np.ndarray, start: np.ndarray, trees: list[list[dict]], depth: int) -> np.ndarray:
    out = start.copy()
    for of_class in trees:
        for c, tree in enumerate(of_class):
            out[:, c] += tree["value"][_leaves(binned, tree, depth)]
    return out


def _drawn(block: int, n: int, turn: int, share: float, seed: int) -> np.ndarray:
    """The rows of a block that take part in a round."""
    return np.random.Generator(np.random.PCG64([seed, turn, block])).random(n) < share


def _histograms(block: int, binned: np.ndarray, label: np.ndarray, margin: np.ndarray, partial: list[dict], level: int, bins: int, turn: int, share: float, seed: int) -> np.ndarray:
    """Sums (class, node, feature, bin, gradient or Hessian) of a block's drawn rows, in units."""
    classes, (_, features), nodes = margin.shape[1], binned.shape, 1 << level
    out = np.zeros((classes, nodes, features, bins, 2), np.int64)
    some = np.flatnonzero(_drawn(block, len(binned), turn, share, seed))
    if not len(some):
        return out
    binned, p = binned[some], _softmax(margin[some])
    for c in range(classes):
        g = np.rint((p[:, c] - (label[some] == c)) * UNIT)
        h = np.rint(p[:, c] * (1 - p[:, c]) * UNIT)
        at = (_leaves(binned, partial[c], level)[:, None] * features + np.arange(features)) * bins + binned
        for k, w in enumerate((g, h)):
            out[c, ..., k] = np.bincount(at.ravel(), np.repeat(w, features), nodes * features * bins).astype(np.int64).reshape(nodes, features, bins)
    return out


def _split(sums: np.ndarray, tree: dict, level: int, last: bool, rate: float) -> None:
    """Puts the best split of each node of a level into the tree; leaf values after the last level."""
    left = np.cumsum(sums, axis=2) / UNIT  # node, feature, bin
    whole = left[:, :, -1:, :]
    right = whole - left
    gain = sum(x[..., 0] ** 2 / (x[..., 1] + REGULAR) for x in (left, right)) - whole[..., 0] ** 2 / (whole[..., 1] + REGULAR)
    gain[(left[..., 1] < LEAST) | (right[..., 1] < LEAST)] = 0.0
    flat = gain.reshape(len(gain), -1)
    best = flat.argmax(1)  # the first feature and bin of equal ones
    feature, cut = np.divmod(best, gain.shape[2])
    none = flat[np.arange(len(flat)), best] <= 1e-9
    feature[none], cut[none] = 0, gain.shape[2] - 1  # all rows go left
    at = (1 << level) - 1 + np.arange(len(gain))
    tree["feature"][at], tree["bin"][at] = feature, cut
    tree["gain"][at] = np.where(none, 0.0, flat[np.arange(len(flat)), best])
    if last:
        n = np.arange(len(gain))
        for side, x in enumerate((left, right)):
            g, h = x[n, feature, cut, 0], x[n, feature, cut, 1]
            tree["value"][2 * n + side] = -rate * g / (h + REGULAR)


class BoostedModel(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Class probabilities of boosted trees; saved and loaded by the ML writer.

    Columns that a table lacks, nulls and NaN count as 0, so that any table can be scored.
    """

    trees = Param(Params._dummy(), "trees", "columns, classes, depth, start and trees as JSON", TypeConverters.toString)

    def __init__(self, trees: dict | None = None) -> None:
        super().__init__()
        if trees is not None:
            self._set(trees=json.dumps(trees))

    def content(self) -> dict:
        return json.loads(self.getOrDefault(self.trees))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        model = self.content()
        names, start, depth = model["columns"], np.array(model["start"]), model["depth"]
        trees = [[{"feature": np.array(t["feature"]), "cut": np.array(t["cut"], float), "value": np.array(t["value"])} for t in of_class] for of_class in model["trees"]]
        rows = aligned(dataset, names)
        schema = StructType([*dataset.schema.fields, StructField("probability", ArrayType(DoubleType()))])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                n = b.num_rows
                x = b.column(b.num_columns - 1).flatten().to_numpy(zero_copy_only=False).reshape(n, len(names))
                margin = np.repeat(start[None, :], n, 0)
                rows = np.arange(n)
                for of_class in trees:
                    for c, t in enumerate(of_class):
                        node = np.zeros(n, np.int64)
                        for level in range(depth):
                            at = (1 << level) - 1 + node
                            node = 2 * node + (x[rows, t["feature"][at]] > t["cut"][at])
                        margin[:, c] += t["value"][node]
                p = _softmax(margin)
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(list(p), pa.list_(pa.float64()))], names=[*b.schema.names[:-1], "probability"])

        out = rows.mapInArrow(run, schema)
        best = F.array_position("probability", F.array_max("probability")) - 1  # the first of equal ones
        return out.withColumn("prediction", best.cast("double"))

    def importances(self) -> list[tuple[str, float]]:
        """Share of each column in the gain of all splits, largest first, ties by name."""
        model = self.content()
        total = np.zeros(len(model["columns"]))
        for of_class in model["trees"]:
            for t in of_class:
                np.add.at(total, t["feature"], t["gain"])
        share = total / (total.sum() or 1.0)
        return sorted(zip(model["columns"], share.tolist(), strict=True), key=lambda kv: (-kv[1], kv[0]))


def aligned(df: DataFrame, columns: list[str]) -> DataFrame:
    """All columns and an array ``_x`` of the named ones; missing columns, nulls and NaN are 0."""
    value = lambda c: F.nanvl(F.coalesce(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)) if c in df.columns else F.lit(0.0)
    return df.withColumn("_x", F.array(*[value(c) for c in columns]))


def _edges(df: DataFrame, columns: list[str], bins: int) -> list[np.ndarray]:
    """Rising cuts of each column: a value is in the bin of the number of cuts below it."""
    got = aligned(df, columns).select(*[F.col("_x")[k].alias(f"c{k}") for k in range(len(columns))])
    cuts = got.approxQuantile(got.columns, [k / bins for k in range(1, bins)], 0.1 / bins)
    return [np.unique(c) if c else np.zeros(0) for c in cuts]


def _blocks(df: DataFrame, columns: list[str], label: str, edges: list[np.ndarray], classes: int) -> RDD:
    """(number, binned, label) of each block, from rows written to the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, len(columns))
            binned = np.stack([np.searchsorted(e, x[:, f]) for f, e in enumerate(edges)], 1).astype(np.uint8)
            yield pa.record_batch({"n": pa.array([b.num_rows]), "x": pa.array([binned.tobytes()], pa.binary()), "y": pa.array([b.column(1).to_numpy().astype(np.uint8).tobytes()], pa.binary())})

    rows = aligned(df.where((F.col(label) >= 0) & (F.col(label) < classes)), columns).select("_x", F.col(label).cast("int").alias("_y"))
    table = settle(rows.mapInArrow(run, "n long, x binary, y binary").where("n > 0").withColumn("k", F.monotonically_increasing_id()))

    def decoded(r) -> tuple:
        return r["k"], np.frombuffer(bytes(r["x"]), np.uint8).reshape(r["n"], len(columns)), np.frombuffer(bytes(r["y"]), np.uint8)

    # a level is one short job: no more tasks than cores
    return table.coalesce(max(1, table.sparkSession.sparkContext.defaultParallelism)).rdd.map(decoded)


def _added(sums: RDD) -> np.ndarray:
    """The sum of the tasks' arrays."""
    return sums.reduce(np.add) if sums.getNumPartitions() <= DIRECT else sums.treeReduce(np.add)


def fit_boosted(df: DataFrame, columns: list[str], label: str, classes: int = 3, rounds: int = 200, depth: int = 4, rate: float = 0.05, share: float = 0.8, bins: int = 32, seed: int = config.RANDOM_SEED) -> BoostedModel:
    """Boosted trees on the rows whose ``label`` is a class from 0 to ``classes - 1``.

    The margins start at the classes' log shares (one row added to each).  Raises ValueError without rows.
    ``bins`` may be at most 256.  Every row is used; a round draws ``share`` of them.
    """
    if not 2 <= bins <= 256:
        raise ValueError("a bin is one byte")
    edges = _edges(df, columns, bins)
    blocks = _blocks(df, columns, label, edges, classes).persist(StorageLevel.MEMORY_AND_DISK)
    counts = blocks.map(lambda b: np.bincount(b[2], minlength=classes)).fold(np.zeros(classes, np.int64), np.add)
    if not counts.sum():
        raise ValueError("no labelled rows")
    start = np.log((counts + 1) / (counts + 1).sum())
    state = blocks.map(lambda b: (*b, np.repeat(start[None, :], len(b[1]), 0))).persist(StorageLevel.MEMORY_AND_DISK)
    done: list[list[dict]] = []
    recent: list[list[dict]] = []
    for turn in range(rounds):
        inner = (1 << depth) - 1
        grown = [{"feature": np.zeros(inner, np.int64), "bin": np.full(inner, bins - 1), "gain": np.zeros(inner), "value": np.zeros(1 << depth)} for _ in range(classes)]
        for level in range(depth):

            def sums(items: Iterator[tuple], recent: list = recent, grown: list = grown, level: int = level, turn: int = turn) -> Iterator[np.ndarray]:
                total = None
                for k, binned, y, margin in items:
                    one = _histograms(k, binned, y, _margins(binned, margin, recent, depth), grown, level, bins, turn, share, seed)
                    total = one if total is None else total + one
                if total is not None:
                    yield total

            got = _added(state.mapPartitions(sums))
            for c in range(classes):
                _split(got[c], grown[c], level, level == depth - 1, rate)
        done.append(grown)
        recent = [*recent, grown]
        if len(recent) == RENEW:
            trees, before = recent, state
            state = before.map(lambda b, trees=trees: (b[0], b[1], b[2], _margins(b[1], b[3], trees, depth))).persist(StorageLevel.MEMORY_AND_DISK)
            state.count()
            before.unpersist()
            recent = []
    state.unpersist()
    blocks.unpersist()

    def cut(tree: dict) -> list[float]:
        """Bins as values; the last bin's cut lies above all values."""
        return [float(edges[f][b]) if b < len(edges[f]) else 1.7e308 for f, b in zip(tree["feature"], tree["bin"], strict=True)]

    trees = [[{"feature": t["feature"].tolist(), "cut": cut(t), "value": t["value"].tolist(), "gain": t["gain"].tolist()} for t in of_class] for of_class in done]
    return BoostedModel({"columns": columns, "classes": classes, "depth": depth, "start": start.tolist(), "trees": trees})
