"""Mixing sources to target weights by entropy balancing.

Each source gets a token target; document rates ``r`` solve

    minimise  sum(r log r - r)   subject to   sum over a source of r * size = its target,  0 <= r <= 2,

whose solution is the exponential tilt ``r = min(2, exp(m z))`` with ``z = size / mean size`` and one
multiplier ``m`` for each source.  The multipliers minimise the convex dual
``sum phi(m z) - m target / mean``, phi being exp up to log 2 and linear beyond.

Every Newton iteration is one distributed aggregate (gradient and curvature of all sources at once)
over counts of equal (source, size), which documents are reduced to before anything is shuffled by
source; multipliers stay a table.  Steps are kept in a bracket, so that a step out of it halves it.

Rates become copies: the whole part, and one more copy for documents whose fraction exceeds a hash of
their id by most; the cut is chosen for each source from a histogram of that excess, so the words taken
come within about one histogram cell of the target and reruns agree.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapewire.llm.tables import saved

MAX_RATE = 2.0
ITERATIONS = 40
TOLERANCE = 1e-6
CELLS = 1 << 16


def n_words(text: Column) -> Column:
    """Words of a text (null: none), counted as word starts."""
    trimmed = F.regexp_replace(F.coalesce(text, F.lit("")), "[^\\x20\\x09-\\x0D]+", "x")
    return F.length(F.translate(trimmed, " \t\n\x0b\f\r", "")).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (3.0, 1.0, 2.0), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(source, source_size, target) from one row (source, source_size) for each source.

    Sources by code point, null last, have the weights in turn.  ``share`` times all sizes are dealt by
    weight; a target stops at ``cap`` times its source, and the excess goes to the others by weight until
    none is above.  In closed form: with sources in order of ``source_size / weight``, those before the
    water line are full.  ``source_size`` stands for words; sources without words get 0.

    The window functions here see one row a source, summed beforehand.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    s = sizes.withColumn("w", w).withColumn("limit", cap * F.col("source_size"))
    line = Window.orderBy(F.col("limit") / F.col("w"), F.col("source").isNull(), F.col("source"))
    s = s.withColumn("total", share * F.sum("source_size").over(Window.partitionBy()))
    before = F.coalesce(F.sum("limit").over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    from_here = F.sum("w").over(line.rowsBetween(0, Window.unboundedFollowing))
    s = s.withColumn("level", (F.col("total") - before) / from_here)
    s = s.withColumn("full", F.col("limit") <= F.col("level") * F.col("w"))
    level = F.min(F.when(~F.col("full"), F.struct(F.col("limit") / F.col("w"), F.col("level").alias("at")))).over(Window.partitionBy())
    s = s.withColumn("open", level["at"])
    target = F.when(F.col("full"), F.col("limit")).otherwise(F.col("open") * F.col("w"))
    return s.select("source", "source_size", target.alias("target"))


def tilt(counts: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, mean, m, full) with the multiplier of each source; counts: (source, size, n), size > 0."""
    mean = counts.groupBy("source").agg((F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("mean"))
    state = targets.join(mean, F.equal_null(targets["source"], mean["source"])).select(targets["source"], "source_size", "target", "mean")
    state = state.withColumn("full", F.col("target") >= MAX_RATE * F.col("source_size"))
    # at m = 0 every rate is 1; beyond these bounds every rate is out of reach of its target
    state = state.select("*", F.lit(0.0).alias("m"), F.lit(None).cast("double").alias("lo"), F.lit(None).cast("double").alias("hi"), F.lit(False).alias("done"))
    state = saved(state)
    top = math.log(MAX_RATE)
    for _ in range(ITERATIONS):
        open_ = state.where("NOT full AND NOT done")
        u = F.least(F.col("m") * F.col("z"), F.lit(top))
        at = counts.join(open_.select(F.col("source").alias("s"), "mean", "m"), F.equal_null("source", "s")).withColumn("z", F.col("size") / F.col("mean"))
        sums = at.groupBy("s").agg(F.sum(F.exp(u) * F.col("z") * F.col("n")).alias("g"), F.sum(F.when(F.col("m") * F.col("z") < top, F.exp(u) * F.col("z") * F.col("z") * F.col("n")).otherwise(0.0)).alias("h"))
        now = state.join(sums, F.equal_null("source", "s"), "left")
        gap = F.col("g") - F.col("target") / F.col("mean")
        lo = F.when(gap < 0, F.col("m")).otherwise(F.col("lo"))
        hi = F.when(gap >= 0, F.col("m")).otherwise(F.col("hi"))
        now = now.withColumns({"gap": gap, "lo": lo, "hi": hi})
        newton = F.col("m") - F.col("gap") / F.nullif("h", F.lit(0.0))
        middle = F.when(F.col("lo").isNull(), F.col("hi") - 1 - F.abs("hi")).when(F.col("hi").isNull(), F.col("lo") + 1 + F.abs("lo")).otherwise((F.col("lo") + F.col("hi")) / 2)
        inside = newton.isNotNull() & (F.coalesce(newton > F.col("lo"), F.lit(True))) & (F.coalesce(newton < F.col("hi"), F.lit(True))) & (F.abs(newton - F.col("m")) < 4 + F.abs("m"))
        done = F.col("full") | F.col("done") | F.coalesce(F.abs("gap") * F.col("mean") <= TOLERANCE * F.col("target"), F.lit(True))
        now = now.withColumn("done_", done).withColumn("m", F.when(F.col("done_"), F.col("m")).when(inside, newton).otherwise(middle))
        state = saved(now.select("source", "source_size", "target", "mean", "full", "m", "lo", "hi", F.col("done_").alias("done")))
        if state.where("NOT done").isEmpty():
            break
    return state.select("source", "mean", F.round("m", 9).alias("m"), "full")


def _rated(docs: DataFrame, plan: DataFrame) -> DataFrame:
    """Adds ``base`` copies and the ``cell`` of the excess of a hash over the rate's fraction."""
    rate = F.when(F.col("size") == 0, 0.0).when(F.col("full"), MAX_RATE).otherwise(F.least(F.exp(F.least(F.col("m") * F.col("size") / F.col("mean"), F.lit(1.0))), F.lit(MAX_RATE)))
    uniform = F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(-1)), "size", F.lit("mix")), F.lit(1 << 30)) / float(1 << 30)
    out = docs.join(plan, F.equal_null("source", "s")).withColumn("rate", rate).withColumn("base", F.floor("rate").cast("long"))
    return out.withColumn("cell", F.floor((uniform - (F.col("rate") - F.col("base")) + 1.0) * (CELLS / 2)).cast("long"))


def _more():
    return (F.col("size") > 0) & (F.col("base") < MAX_RATE)


def mixing_plan(sized: DataFrame, weights: tuple[float, ...], share: float) -> DataFrame:
    """One row a source: (s, source_size, target, mean, m, full, cut); sized: (doc_id, source, size)."""
    counts = saved(sized.where("size > 0").groupBy("source", "size").agg(F.count("*").alias("n")))
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = saved(source_targets(sizes, weights, share, MAX_RATE))
    found = tilt(counts, targets).withColumnRenamed("source", "s")
    plan = saved(targets.join(found, F.equal_null("source", "s"), "left").select(F.col("source").alias("s"), "source_size", "target", "mean", "m", "full"))
    cells = _rated(sized, plan).groupBy("source", "cell").agg(F.sum(F.when(_more(), F.col("size")).otherwise(0)).alias("more"), F.sum(F.col("size") * F.col("base")).alias("sure"), F.max("target").alias("target"))
    run = Window.partitionBy("source").orderBy("cell")
    cells = cells.withColumn("sure", F.sum("sure").over(Window.partitionBy("source"))).withColumn("after", F.sum("more").over(run))
    error, none = F.abs(F.col("sure") + F.col("after") - F.col("target")), F.abs(F.col("sure") - F.col("target"))
    cut = cells.groupBy("source").agg(F.min_by("cell", error).alias("cut"), F.min(error).alias("e"), F.min(none).alias("e0"))
    cut = cut.select("source", F.when(F.col("e") < F.col("e0"), F.col("cut")).otherwise(F.lit(-1)).alias("cut"))
    return saved(plan.join(cut, F.equal_null("source", "s"), "left").drop("source"))


def _sized(docs: DataFrame, doc_id: str, text: str, source: str, *more: str) -> DataFrame:
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(source).cast("string").alias("source"), n_words(F.col(text)).alias("size"), *more)


def _copies(docs: DataFrame, plan: DataFrame) -> DataFrame:
    copies = F.when(F.col("size") == 0, 1).otherwise(F.col("base") + F.when(_more() & (F.col("cell") <= F.col("cut")), 1).otherwise(0))
    return _rated(docs, plan).withColumn("copies", copies.cast("long"))


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[float, ...] = (3.0, 1.0, 2.0), share: float = 1.5) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken, copies) for each input row; ``taken = copies * size``.

    A null or wordless text has size 0, takes nothing and stays once (``copies`` 1).  A null source is a
    source of its own.  Null and repeated doc_ids are rows like others; rows with equal id and size in
    one source are taken alike.  Other columns are ignored.
    """
    sized = saved(_sized(docs, doc_id, text, source))
    out = _copies(sized, mixing_plan(sized, weights, share))
    return out.select("doc_id", "source", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def mixed_documents(docs: DataFrame, weights: tuple[float, ...] = (3.0, 1.0, 2.0), share: float = 1.5) -> DataFrame:
    """The documents the mix takes, with ``size`` and ``copies`` (1 or 2) added; ``docs`` has doc_id, text, source."""
    plan = mixing_plan(saved(_sized(docs, "doc_id", "text", "source")), weights, share)
    packed = _sized(docs, "doc_id", "text", "source", F.struct(*docs.columns).alias("row"))
    return _copies(packed, plan).where("copies > 0").select("row.*", F.col("size").alias("n_words"), "copies")
