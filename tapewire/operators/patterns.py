"""Literal patterns of a table of any size in texts, by Aho-Corasick automata.

The table is dealt by hash over shards of a bounded number of characters.  A shard is collected and sent to
the tasks; each builds its automaton once and runs every text of an Arrow batch through it, which takes
time in proportion to the text's length and its matches, whatever the number of patterns.  Several shards
are passes over the rows one after the other: texts are never joined, shuffled or cut into rows.

Matching ignores case as ``lower`` on both sides does.  Null and empty patterns match nothing, null texts
contain nothing.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, DoubleType, StringType, StructField, StructType

from tapewire.functions.batches import bounded_batches
from tapewire.functions.settle import settle

#: Characters of the patterns of a shard, its share of the automaton's overhead included.
SHARD_CHARS = 4 << 20
_OVERHEAD = 16

Entry = tuple[str, str, float]  # lower-cased pattern, pattern, value


def _shards(table: DataFrame, keyword: str, value: Column) -> list[Broadcast]:
    rows = table.where(F.length(keyword) > 0).select(F.lower(keyword).alias("low"), F.col(keyword).alias("keyword"), value.cast("double").alias("value"))
    rows = settle(rows.groupBy("low", "keyword").agg(F.sum("value").alias("value")))
    chars = rows.agg(F.sum(F.length("low") + _OVERHEAD)).first()[0] or 0
    n = 1 + chars // SHARD_CHARS
    shard = F.pmod(F.xxhash64("low"), F.lit(n))
    return [table.sparkSession.sparkContext.broadcast([tuple(r) for r in rows.where(shard == k).collect()]) for k in range(n)]


def finder(entries: list[Entry]) -> Callable[[str | None], list[Entry]]:
    """The entries whose pattern a lower-cased text contains, in order of the pattern."""
    import ahocorasick

    by_low: dict[str, list[Entry]] = {}
    for e in entries:
        by_low.setdefault(e[0], []).append(e)
    lows = sorted(by_low)
    machine = ahocorasick.Automaton()
    for k, low in enumerate(lows):
        machine.add_word(low, k)
    if lows:
        machine.make_automaton()

    def find(text: str | None) -> list[Entry]:
        found = sorted({k for _, k in machine.iter(text)}) if text and lows else []
        return [e for k in found for e in by_low[lows[k]]]

    return find


Fold = Callable[[object, list[Entry]], object]


def _folded(rows: DataFrame, table: DataFrame, text: str, keyword: str, value: Column, out: str, kind: DataType, arrow: pa.DataType, fold: Fold) -> DataFrame:
    """``rows`` with a column ``out`` folded over the matches of all shards; it starts as null."""
    bounded_batches(rows.sparkSession)
    names = rows.columns
    got = rows.withColumn("_low", F.lower(F.col(text))).withColumn(out, F.lit(None).cast(kind))
    schema = StructType([*rows.schema.fields, StructField("_low", StringType()), StructField(out, kind)])
    for shard in _shards(table, keyword, value):

        def run(batches: Iterator[pa.RecordBatch], shard: Broadcast = shard) -> Iterator[pa.RecordBatch]:
            find = None
            for b in batches:
                find = find or finder(shard.value)
                last = [fold(a, find(t)) for a, t in zip(b.column(b.num_columns - 1).to_pylist(), b.column(b.num_columns - 2).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(last, arrow)], names=b.schema.names)

        got = got.mapInArrow(run, schema)
    return got.select(*names, out)


def with_keywords(rows: DataFrame, table: DataFrame, text: str = "headline", keyword: str = "keyword", out: str = "keywords") -> DataFrame:
    """``rows`` with the array of the table's keywords that ``text`` contains, as they are written there, sorted."""
    fold = lambda a, found: (a or []) + [e[1] for e in found]
    got = _folded(rows, table, text, keyword, F.lit(0.0), out, ArrayType(StringType()), pa.list_(pa.string()), fold)
    return got.withColumn(out, F.sort_array(out))


BEST = StructType([StructField("abs_car", DoubleType()), StructField("k", StringType()), StructField("car", DoubleType())])


def with_weights(rows: DataFrame, weights: DataFrame, text: str = "headline", keyword: str = "keyword", value: str = "avg_CAR") -> DataFrame:
    """``rows`` with ``keyword_total``, the summed values of the contained keywords (0 without one), and
    ``best_keyword``, the one with the largest absolute value, ties to the last by name (null without one).

    Values of a keyword that the table holds twice are added up.  Keywords without a value count as 0.
    """
    arrow = pa.struct([("total", pa.float64()), ("best", pa.struct([("abs_car", pa.float64()), ("k", pa.string()), ("car", pa.float64())]))])
    kind = StructType([StructField("total", DoubleType()), StructField("best", BEST)])

    def fold(a: dict | None, found: list[Entry]) -> dict:
        values = [(e[2] or 0.0, e[0]) for e in found]
        some = [{"abs_car": abs(v), "k": k, "car": v} for v, k in values]
        if a and a["best"]:
            some.append(a["best"])
        return {"total": math.fsum([a["total"] if a else 0.0, *(v for v, _ in values)]), "best": max(some, key=lambda s: (s["abs_car"], s["k"], s["car"]), default=None)}

    got = _folded(rows, weights, text, keyword, F.col(value), "_kw", kind, arrow, fold)
    return got.select(*rows.columns, F.col("_kw.total").alias("keyword_total"), F.col("_kw.best").alias("best_keyword"))
