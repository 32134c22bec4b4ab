"""Exact top-k search by inner product: ball-tree branch and bound in shards.

Vectors are dealt to shards of a bounded number of rows.  A shard's vectors form a ball tree; a node's
largest possible inner product with a query q is ``q . centre + |q| radius``.  A query visits the leaves
of a shard in order of that bound and stops where the bound falls below its current k-th score.

Each query first searches its home shard.  The k-th score found there is shared: the other shards start
from it, so that most of their nodes are cut at once.  Every shard meets all queries in blocks; its
answers (at most k a query, and none below the shared score) are merged by query.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapewire.llm.tables import saved, small_batches

SHARD_ROWS = 8192
QUERY_BLOCK = 4096
LEAF = 128


def ball_tree(x: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int]], np.ndarray, np.ndarray, np.ndarray]:
    """(row order, leaf spans, leaf centres, leaf radii, parent bounds chain) of a ball tree over rows.

    Nodes are split at the median along the direction of their two mutually far points.  Inner nodes are
    returned as spans of leaves with centre and radius, widest first, in the last array's rows:
    first leaf, last leaf + 1, radius, centre.
    """
    order = np.arange(len(x))
    leaves: list[tuple[int, int]] = []
    inner: list[tuple[int, int, int, int]] = []  # lo, hi, first leaf, last leaf + 1

    def split(lo: int, hi: int, depth: int) -> None:
        first = len(leaves)
        if hi - lo <= LEAF or depth > 40:
            leaves.append((lo, hi))
            return
        rows = x[order[lo:hi]]
        a = rows[np.argmax(((rows - rows.mean(0)) ** 2).sum(1))]
        b = rows[np.argmax(((rows - a) ** 2).sum(1))]
        mid = (hi - lo) // 2
        part = np.argpartition(rows @ (b - a), mid)
        order[lo:hi] = order[lo:hi][part]
        split(lo, lo + mid, depth + 1)
        split(lo + mid, hi, depth + 1)
        inner.append((lo, hi, first, len(leaves)))

    split(0, len(x), 0)
    ball = lambda lo, hi: (c := x[order[lo:hi]].mean(0), np.sqrt((((x[order[lo:hi]] - c) ** 2).sum(1)).max()))
    balls = [ball(lo, hi) for lo, hi in leaves]
    nodes = sorted(inner, key=lambda s: s[0] - s[1])
    table = np.array([[f, t, (b := ball(lo, hi))[1], *b[0]] for lo, hi, f, t in nodes]) if nodes else np.zeros((0, 3 + x.shape[1]))
    return order, leaves, np.array([c for c, _ in balls]), np.array([r for _, r in balls]), table


def search(ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, q: np.ndarray, kth: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query number, id, score) of the best k rows of each query that score ``kth[query]`` or more.

    Rows with the query's own id are left out.  Values are whole numbers in float64 where that is exact,
    else in int64, and where that could overflow in Python's whole numbers; a product beyond a long
    raises ValueError.
    """
    largest = float(np.abs(x.astype(np.float64)).max(initial=0)) * float(np.abs(q.astype(np.float64)).max(initial=0)) * x.shape[1]
    exact = float(np.abs(x).max(initial=0)) * float(np.abs(q).max(initial=0)) * x.shape[1] < 2**52
    xf, qf = x.astype(np.float64), q.astype(np.float64)
    order, leaves, centres, radii, inner = ball_tree(xf)
    norm = np.sqrt((qf**2).sum(1))
    slack = 1e-9 * norm * (np.sqrt((xf**2).sum(1)).max(initial=0) + 1) + 1e-6
    kth = kth.astype(np.float64).copy()
    bound = np.full((len(q), len(leaves)), np.inf)
    for first, last, radius, *centre in inner:  # a cut node cuts all leaves below it
        most = qf @ np.array(centre) + norm * radius + slack
        first, last = int(first), int(last)
        bound[:, first:last] = np.minimum(bound[:, first:last], most[:, None])
        if (most < kth).all():
            bound[:, first:last] = -np.inf
    bound = np.minimum(bound, qf @ centres.T + norm[:, None] * radii[None, :] + slack[:, None])
    rank = np.argsort(-bound, axis=1)
    best_q, best_id, best_s = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    active = np.arange(len(q))
    for turn in range(len(leaves)):
        leaf = rank[active, turn]
        go = bound[active, leaf] >= kth[active]
        active, leaf = active[go], leaf[go]
        if not len(active):
            break
        new_q, new_id, new_s = [best_q], [best_id], [best_s]
        for one in np.unique(leaf):
            who = active[leaf == one]
            rows = order[leaves[one][0] : leaves[one][1]]
            s = (qf[who] @ xf[rows].T) if exact else (q[who] @ x[rows].T) if largest < 2**62 else _whole_products(q[who], x[rows])
            hit = (s >= kth[who][:, None]) & (ids[rows][None, :] != query_ids[who][:, None])
            a, b = np.nonzero(hit)
            new_q.append(who[a])
            new_id.append(ids[rows[b]])
            new_s.append(s[a, b].astype(np.int64))
        qs, vs, ss = np.concatenate(new_q), np.concatenate(new_id), np.concatenate(new_s)
        at = np.lexsort((vs, -ss, qs))
        qs, vs, ss = qs[at], vs[at], ss[at]
        start = np.flatnonzero(np.concatenate(([True], qs[1:] != qs[:-1]))) if len(qs) else np.zeros(0, np.int64)
        place = np.arange(len(qs)) - np.repeat(start, np.diff(np.append(start, len(qs))))
        keep = place < k
        best_q, best_id, best_s = qs[keep], vs[keep], ss[keep]
        full = place == k - 1
        kth[qs[full]] = np.maximum(kth[qs[full]], ss[full])
    return best_q, best_id, best_s


def _whole_products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    s = q.astype(object) @ x.T.astype(object)
    if max(map(abs, s.flat), default=0) >= 2**63:
        raise ValueError("an inner product is beyond a long")
    return s.astype(np.int64)


def whole_vectors(df: DataFrame, vec_id: str, vector: str, scale: float = 64.0) -> DataFrame:
    """(vec_id, dim, v) with ``floor(scale * x)`` as whole numbers.

    Rows with a null id, a null or empty vector, or a null or non-finite component are left out.  A finite
    component whose whole number is 2**62 or more raises an error: no score could be held in a long.
    """
    large = F.raise_error(F.lit("a vector component is beyond a long")).cast("long")
    whole = lambda c: F.when(F.abs(c.cast("double") * F.lit(scale)) < F.lit(float(2**62)), F.floor(c.cast("double") * F.lit(scale))).otherwise(large)
    x = F.transform(F.col(vector), whole)
    fine = F.forall(F.col(vector), lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < F.lit(float("inf"))))
    rows = df.where(F.col(vec_id).isNotNull() & (F.size(vector) > 0)).where(fine)
    return rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.size(vector).alias("dim"), x.cast("array<long>").alias("v"))


def _matrix(table: pa.Table) -> np.ndarray:
    flat = np.concatenate([np.asarray(c.flatten().to_numpy(zero_copy_only=False), np.int64) for c in table.column("v").chunks])
    return flat.reshape(table.num_rows, -1)


def top_k(df: DataFrame, is_query: Column, k: int = 20, vec_id: str = "vec_id", vector: str = "embedding", shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best other rows of every query, ties to the smaller id.

    ``is_query`` is a condition over ``vec_id``.  Vectors of different length are not compared.  Rows with
    a query's own id are not its candidates; repeated rows under other ids are.  Repeated queries of one
    id and equal vectors give one answer.
    """
    small_batches(df.sparkSession)
    every = saved(whole_vectors(df, vec_id, vector))
    shards = max(1, -(-every.count() // shard_rows))
    place = F.pmod(F.xxhash64("vec_id", "v"), F.lit(shards)).cast("int")
    data = every.withColumn("shard", place)
    queries = saved(every.where(is_query).distinct().withColumn("home", place).withColumn("block", F.pmod(F.xxhash64("v"), F.lit(1 << 30)).cast("int")))
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    queries = queries.withColumn("block", F.pmod("block", F.lit(blocks)))

    def find(key, rows, asked):
        empty = pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.int64())})
        if not rows.num_rows or not asked.num_rows:
            return empty
        ids, query_ids = rows.column("vec_id").to_numpy(), asked.column("vec_id").to_numpy()
        kth = np.array([-np.inf if s is None else s for s in asked.column("kth").to_pylist()])
        which, found, score = search(ids, _matrix(rows), query_ids, _matrix(asked), kth, k)
        return pa.table({"query_id": pa.array(query_ids[which], pa.int64()), "vec_id": pa.array(found, pa.int64()), "score": pa.array(score, pa.int64())})

    schema = "query_id long, vec_id long, score long"
    key = ["dim", "shard", "block"]
    of_block = data.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))) if blocks > 1 else data.withColumn("block", F.lit(0))
    asked = queries.withColumn("shard", F.col("home")).withColumn("kth", F.lit(None).cast("long"))
    home = saved(of_block.groupBy(key).cogroup(asked.select("vec_id", "v", "kth", *key).groupBy(key)).applyInArrow(find, schema))
    shared = home.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("s")).where(F.col("n") >= k)
    rest = queries.join(shared.select(F.col("query_id").alias("vec_id"), F.col("s").alias("kth")), "vec_id", "left")
    rest = rest.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).where("shard <> home")
    other = of_block.groupBy(key).cogroup(rest.select("vec_id", "v", "kth", *key).groupBy(key)).applyInArrow(find, schema)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return home.unionAll(other).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
