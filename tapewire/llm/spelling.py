"""Spelling variants: exact neighbours at one inserted, deleted or replaced character, by pairs of trie nodes.

Two tries hold the words, one forward and one reversed.  Their nodes are numbered, so a word's cut at
position i is a pair of integers: the node of what stands before, and the reversed trie's node of what
stands behind.

* skipped position: (prefix node i, suffix node i + 1), the word without its character i;
* cut: (prefix node i, suffix node i), the whole word.

Words that share a skipped pair differ in that character only.  A word's skipped pair equal to another's
cut pair means that the other is the word without that character.  Equal pairs of integers are equal
strings, so nothing needs to be verified.  Of equal neighbouring characters only the last is skipped
towards cuts: each pair of words then meets once.

Words are sorted over ranges to number a trie.  A node that lies in several ranges is a prefix of the last
word of one of them; these words are few (one a range) and sent to all tasks, which number their prefixes
alike, below zero.  All other nodes lie within one range and are numbered there.

A bucket (words of one skipped pair, and the one word of that cut pair) is bounded by the alphabet.  It emits
no pairs: a word needs the bucket's size and its best other member only, which windows give.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tapewire.llm.tables import saved

#: Characters of a range of sorted words.
RANGE_CHARS = 2 << 20
_LOCAL_BITS = 40


def _shared(a: str, b: str) -> int:
    """Length of the longest common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    lo, hi = 0, n  # a[:lo] is shared, a[:hi] is not
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid
    return lo


class Nodes:
    """Numbers of the trie nodes on the way to each word of one range; words must come sorted."""

    def __init__(self, lasts: list[str], part: int):
        """``lasts``: the rising last words of all ranges; ``part``: the number of this one."""
        self.around = [(x, self._top(lasts, x)) for x in lasts[max(0, part - 1) : part + 1]]
        self.next = part << _LOCAL_BITS
        self.word, self.path = "", np.zeros(1, np.int64)
        self.path[0] = self.around[0][1][0]

    @staticmethod
    def _top(lasts: list[str], word: str) -> np.ndarray:
        """Numbers below zero of a last word's prefixes: a prefix is named by the first last word that has it."""
        base = np.concatenate(([0], np.cumsum([len(x) + 1 for x in lasts])))
        out = np.zeros(len(word) + 1, np.int64)
        end, k = len(word), lasts.index(word)
        while end >= 0:
            below = _shared(lasts[k - 1], word) if k else -1
            out[below + 1 : end + 1] = -1 - base[k] - np.arange(below + 1, end + 1)
            end, k = min(end, below), k - 1
        return out

    def __call__(self, word: str) -> np.ndarray:
        top, numbers = max(((_shared(word, x), n) for x, n in self.around), key=lambda t: t[0])
        path = np.empty(len(word) + 1, np.int64)
        path[: top + 1] = numbers[: top + 1]
        old = max(top, min(_shared(word, self.word), len(self.path) - 1))
        path[top + 1 : old + 1] = self.path[top + 1 : old + 1]
        new = len(word) - old
        path[old + 1 :] = np.arange(self.next, self.next + new)
        self.next += new
        self.word, self.path = word, path
        return path


def _ranged(words: DataFrame, key: str, chars: int) -> tuple[DataFrame, list[tuple[int, str]]]:
    """The rows with the number of their range of ``key``, and the last key of each range."""
    parts = 1 + chars // RANGE_CHARS
    table = saved(words.repartitionByRange(parts, key).withColumn("part", F.spark_partition_id()))
    lasts = [tuple(r) for r in table.groupBy("part").agg(F.max(key)).orderBy("part").collect()]
    return table, lasts


def _lists(rows: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate(([0], np.cumsum([len(x) for x in rows])))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(rows) if rows else np.zeros(0, np.int64)))


def _paths(table: DataFrame, lasts: list[tuple[int, str]], key: str, reverse: bool) -> DataFrame:
    """(wid, word, n, path, tail) of the forward trie, (wid, path) of the reversed one.

    ``wid`` rises with the words' order; ``tail`` tells for each character whether the next one differs.
    """
    order = {part: k for k, (part, _) in enumerate(lasts)}
    ends = table.sparkSession.sparkContext.broadcast([x for _, x in lasts])

    def run(group: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        t = t.sort_by(key)
        part = order[group[0].as_py()]
        nodes = Nodes(ends.value, part)
        words = t.column(key).to_pylist()
        paths = [nodes(w) for w in words]
        if reverse:
            return pa.table({"wid": t.column("wid"), "path": _lists([p[::-1] for p in paths])})
        tails = [np.array([x != y for x, y in zip(w, w[1:], strict=False)] + [True] * bool(w), np.int64) for w in words]
        wid = pa.array((part << _LOCAL_BITS) + np.arange(len(words)), pa.int64())
        return pa.table({"wid": wid, "word": t.column(key).cast(pa.string()), "n": t.column("n"), "path": _lists(paths), "tail": _lists(tails)})

    schema = "wid long, path array<long>" if reverse else "wid long, word string, n long, path array<long>, tail array<long>"
    return table.groupBy("part").applyInArrow(run, schema)


def _neighbours(words: DataFrame) -> DataFrame:
    """(wid, n_near, best): how many near words each word has, and the first of them by n and order.

    ``best``: struct of n and the negated wid, so that its maximum is the largest n, ties to the first word.
    Words without a near word are missing.
    """
    length = F.size("tail")
    cuts = F.zip_with("path", "suffix", lambda p, s: F.struct(p.alias("p"), s.alias("s"), F.lit(0).cast("long").alias("tail"), F.lit(False).alias("skip")))
    behind = F.slice("suffix", F.lit(2), length)
    before = F.zip_with(F.slice("path", F.lit(1), length), "tail", lambda p, t: F.struct(p.alias("p"), t.alias("t")))
    skipped = F.zip_with(before, behind, lambda a, s: F.struct(a["p"].alias("p"), s.alias("s"), a["t"].alias("tail"), F.lit(True).alias("skip")))
    pairs = words.select("wid", "n", F.explode_outer(F.concat(cuts, skipped)).alias("x")).select("wid", "n", "x.*")
    bucket = W.partitionBy("p", "s")
    some = pairs.withColumn("all", F.count(F.lit(1)).over(bucket)).where("all > 1")
    me = F.struct("n", (-F.col("wid")).alias("w"))
    by_rank = bucket.orderBy(F.desc("skip"), F.desc("n"), "wid")
    some = some.withColumns({"me": me, "at": F.row_number().over(by_rank), "then": F.lead(F.when(F.col("skip"), me)).over(by_rank)})
    whole = lambda c: c.over(bucket)
    some = some.withColumns(
        {
            "skips": whole(F.count_if("skip")),
            "tails": whole(F.count_if(F.col("tail") == 1)),
            "cut": whole(F.max(F.when(~F.col("skip"), F.col("me")))),
            "top": whole(F.max(F.when(F.col("skip"), F.col("me")))),
            "top_tail": whole(F.max(F.when(F.col("tail") == 1, F.col("me")))),
        }
    )
    other = F.when(F.col("at") == 1, F.col("then")).otherwise(F.col("top"))
    shorter = F.when(F.col("tail") == 1, F.col("cut"))
    near = F.when(F.col("skip"), F.col("skips") - 1 + F.when(shorter.isNotNull(), 1).otherwise(0)).otherwise(F.col("tails"))
    best = F.when(F.col("skip"), F.greatest(other, shorter)).otherwise(F.col("top_tail"))
    return some.select("wid", near.alias("k"), best.alias("b")).where("k > 0").groupBy("wid").agg(F.sum("k").alias("n_near"), F.max("b").alias("best"))


def variants(words: DataFrame, word: str = "word", n: str = "n", ratio: int = 10) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for each distinct word.

    Near words differ by exactly one inserted, deleted or replaced character (code point); case counts.
    ``form``: the near word with the largest n, ties to the first in code-point order, if its n is at least
    ``ratio`` times the word's; else null.  ``root``: the end of the way along forms, the word itself without
    one.  Forms grow by the ratio at each step, so ways are short; they are followed by doubling.

    Rows of an equal word are added up; null words and words whose sum is null or below 1 take no part.  The empty
    word is a word.  An empty table gives no rows.  Other columns are ignored.  Raises ValueError for a
    ratio below 2.
    """
    if ratio < 2:
        raise ValueError("a ratio below 2 could lead in circles")
    given = saved(words.where(F.col(word).isNotNull()).groupBy(F.col(word).alias("word")).agg(F.sum(F.col(n).cast("long")).alias("n")).where("n >= 1"))
    chars, least, most = given.agg(F.sum(F.length("word") + 1), F.min("n"), F.max("n")).first()
    if chars is None:
        return given.select("word", *(F.lit(None).cast("string").alias(c) for c in ("form", "root")), "n", F.lit(0).cast("long").alias("n_near"), F.lit(None).cast("long").alias("form_n"))
    forward = saved(_paths(*_ranged(given, "word", chars), "word", False))
    turned = forward.select("wid", F.reverse("word").alias("reversed"))
    backward = _paths(*_ranged(turned, "reversed", chars), "reversed", True).withColumnRenamed("path", "suffix")
    near = _neighbours(forward.join(backward, "wid"))
    lone = F.struct(F.lit(None).cast("long").alias("n"), F.lit(None).cast("long").alias("w"))
    told = forward.select("wid", "word", "n").join(near, "wid", "left").withColumn("best", F.when(F.col("best.n") >= F.col("n") * ratio, F.col("best")).otherwise(lone))
    told = saved(told.select("wid", "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.col("best.n").alias("form_n"), (-F.col("best.w")).alias("to")))
    way = told.where("to IS NOT NULL").select("wid", F.col("to").alias("end"))
    steps = 0
    while least * ratio ** (steps + 1) <= most:
        steps += 1
    reached = 1
    while reached < steps:
        way = saved(way.alias("a").join(way.select(F.col("wid").alias("end"), F.col("end").alias("further")), "end", "left").select("wid", F.coalesce("further", "end").alias("end")))
        reached *= 2
    name = told.select(F.col("wid").alias("to"), F.col("word").alias("form"))
    last = told.select(F.col("wid").alias("end"), F.col("word").alias("root"))
    got = told.join(name, "to", "left").join(way, "wid", "left").join(last, "end", "left")
    return got.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def slipped_words(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", every: int = 31, length: int = 7, at_least: int = 2) -> DataFrame:
    """(word, n): runs of letters of whole texts, some with a planted slip, and how often they occur.

    Runs are maximal runs of A-Z, a-z and U+00C0 to U+00FF, lower-cased in A-Z.  Where the crc32 of
    ``<doc_id>:<run>`` is divisible by ``every``, the character at its remainder by the run's length is left
    out.  Words of at least ``length`` characters and ``at_least`` occurrences are returned.  A null text
    has no words; a null doc_id plants no slip.  Other columns are ignored.
    """
    lowered = F.translate(F.col(text), UPPER, LOWER)
    # a shorter run cannot become a word
    runs = docs.select(F.col(doc_id).cast("string").alias("doc_id"), F.explode_outer(F.regexp_extract_all(lowered, F.lit("[a-zÀ-ÿ]{%d,}" % length), F.lit(0))).alias("run")).where("run IS NOT NULL")
    h = F.crc32(F.concat("doc_id", F.lit(":"), "run"))
    slip = (h % F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), slip), F.substring("run", slip + 2, F.length("run")))
    word = F.when(h % every == 0, cut).otherwise(F.col("run"))
    return runs.select(word.alias("word")).where(F.length("word") >= length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= at_least)
