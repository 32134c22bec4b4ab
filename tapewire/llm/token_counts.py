"""Edit-aware token counts: a segment tree of pre-token runs for each document.

A text is cut into leaves of about ``LEAF`` characters, only where a printable character meets a space or
line feed: every pattern of the supported byte-level vocabularies ends a pre-token there whatever stands
around, so the tokens of a text are the tokens of its leaves.  The tree holds characters and tokens below
each node.  An edit descends by character sums, re-encodes the leaves it touches (and a neighbour where
the edit spoils the cut between them: the boundary context), and updates the sums above them.

Leaves are arrays of a row and can be stored; ``edited`` builds the trees that a row lacks.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from tapewire.llm.tables import small_batches

LEAF = 512
#: The pre-token pattern of the byte-level rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_CUT = re.compile(r"(?<=[!-~À-ɏ])(?=[ \n])")


def cuts(text: str) -> list[str]:
    """The leaves of a text, at least one."""
    out, lo = [], 0
    while len(text) - lo > LEAF:
        m = _CUT.search(text, lo + LEAF)
        if m is None:
            break
        out.append(text[lo : m.start()])
        lo = m.start()
    return [*out, text[lo:]]


def _joint(left: str, right: str) -> bool:
    """Whether two neighbouring leaves may stay apart."""
    return _CUT.match((left[-1:] + right[:1]), 1) is not None if left and right else not left and not right


class SegmentTree:
    """Leaves of a text with their characters and tokens, and sums over a complete binary tree."""

    def __init__(self, leaves: list[str], tokens: list[int], encode: Callable[[list[str]], list[int]]):
        self.encode, self.encoded = encode, 0
        self._build(leaves, tokens)

    def _build(self, leaves: list[str], tokens: list[int]) -> None:
        self.leaves = list(leaves)
        self.size = 1 << max(0, (len(leaves) - 1).bit_length())
        pad = [0] * (self.size - len(leaves))
        self.chars = [0] * self.size + [len(x) for x in leaves] + pad
        self.tokens = [0] * self.size + list(tokens) + pad
        for k in range(self.size - 1, 0, -1):
            self.chars[k] = self.chars[2 * k] + self.chars[2 * k + 1]
            self.tokens[k] = self.tokens[2 * k] + self.tokens[2 * k + 1]

    @property
    def n_tokens(self) -> int:
        return self.tokens[1]

    def text(self) -> str:
        return "".join(self.leaves)

    def _find(self, at: int) -> tuple[int, int]:
        """(leaf, characters before it): the leaf that holds the character at ``at``, or the last one."""
        k, before = 1, 0
        at = min(at, max(0, self.chars[1] - 1))
        while k < self.size:
            k *= 2
            if at - before >= self.chars[k]:
                before += self.chars[k]
                k += 1
        return min(k - self.size, len(self.leaves) - 1), before

    def _set(self, leaf: int, text: str, tokens: int) -> None:
        self.leaves[leaf] = text
        k = leaf + self.size
        self.chars[k], self.tokens[k] = len(text), tokens
        while k > 1:
            k //= 2
            self.chars[k] = self.chars[2 * k] + self.chars[2 * k + 1]
            self.tokens[k] = self.tokens[2 * k] + self.tokens[2 * k + 1]

    def edit(self, at: int, deleted: int, inserted: str) -> None:
        """Replaces ``deleted`` characters from ``at`` on; positions beyond the text are its end."""
        total = self.chars[1]
        at = min(max(at, 0), total)
        deleted = min(max(deleted, 0), total - at)
        if not deleted and not inserted:
            return
        lo, before = self._find(at)
        hi = self._find(at + deleted - 1)[0] if deleted else lo
        part = "".join(self.leaves[lo : hi + 1])
        part = part[: at - before] + inserted + part[at - before + deleted :]
        while lo > 0 and not (self.leaves[lo - 1] and _joint(self.leaves[lo - 1], part)):
            lo -= 1
            part = self.leaves[lo] + part
        while hi + 1 < len(self.leaves) and not (self.leaves[hi + 1] and _joint(part, self.leaves[hi + 1])):
            hi += 1
            part += self.leaves[hi]
        new = cuts(part)
        counts = self.encode(new)
        self.encoded += len(part)
        if len(new) > hi - lo + 1:  # more leaves than places: the tree is laid out anew
            old = self.tokens[self.size : self.size + len(self.leaves)]
            self._build(self.leaves[:lo] + new + self.leaves[hi + 1 :], old[:lo] + counts + old[hi + 1 :])
            return
        for k in range(lo, hi + 1):
            j = k - lo
            self._set(k, new[j] if j < len(new) else "", counts[j] if j < len(new) else 0)


def read_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a byte-level vocabulary file (base64 token and rank a line)."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def _encoder(ranks: dict[bytes, int], pattern: str) -> Callable[[list[str]], list[int]]:
    import tiktoken

    own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return lambda texts: [len(own.encode_ordinary(x)) for x in texts]


def edited(docs: DataFrame, vocabulary: str, edits: Column, doc_id: str = "doc_id", text: str = "text", leaves: str | None = None, pattern: str = PATTERN) -> DataFrame:
    """(doc_id, n_tokens, n_tokens_after, n_encoded, text_after, leaf_chars, leaf_tokens) for each row.

    ``edits``: array<struct<at int, deleted int, inserted string>>, applied in order, positions in
    characters of the text as it is by then; a null array or edit changes nothing, null fields are 0 and
    "".  ``n_encoded``: characters encoded again for the edits.  ``leaves``: a column of
    struct<chars array<int>, tokens array<int>> from an earlier run over the same text; without it, or where
    it is null, the tree is built.  A null text counts as empty (0 tokens).  Other columns are ignored.
    The vocabulary file is read on the driver and sent along; its size is that of the vocabulary.
    """
    spark: SparkSession = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(read_ranks(vocabulary))
    kind = "struct<chars:array<int>,tokens:array<int>>"
    old = F.col(leaves).cast(kind) if leaves else F.lit(None).cast(kind)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), edits.alias("edits"), old.alias("old"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = None
        for batch in batches:
            encode = encode or _encoder(shared.value, pattern)
            out: dict[str, list] = {c: [] for c in ("doc_id", "n_tokens", "n_tokens_after", "n_encoded", "text_after", "leaf_chars", "leaf_tokens")}
            for r in batch.to_pylist():
                if r["old"] is None:
                    parts = cuts(r["text"])
                    counts = encode(parts)
                else:
                    ends = [0]
                    for n in r["old"]["chars"]:
                        ends.append(ends[-1] + n)
                    parts, counts = [r["text"][a:b] for a, b in zip(ends, ends[1:], strict=False)], r["old"]["tokens"]
                tree = SegmentTree(parts, counts, encode)
                before = tree.n_tokens
                for e in r["edits"] or []:
                    if e is not None:
                        tree.edit(e["at"] or 0, e["deleted"] or 0, e["inserted"] or "")
                for c, v in zip(out, (r["doc_id"], before, tree.n_tokens, tree.encoded, tree.text(), [len(x) for x in tree.leaves], tree.tokens[tree.size : tree.size + len(tree.leaves)]), strict=True):
                    out[c].append(v)
            yield pa.RecordBatch.from_pydict(out, arrow)

    ints = pa.list_(pa.int32())
    arrow = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_tokens_after", pa.int64()), ("n_encoded", pa.int64()), ("text_after", pa.string()), ("leaf_chars", ints), ("leaf_tokens", ints)])
    many = ArrayType(IntegerType())
    schema = StructType([StructField(c, LongType()) for c in ("doc_id", "n_tokens", "n_tokens_after", "n_encoded")] + [StructField("text_after", StringType()), StructField("leaf_chars", many), StructField("leaf_tokens", many)])
    return rows.mapInArrow(run, schema)


def sample_edits(doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> Column:
    """Three edits of each document, placed by a hash of its id: a deletion of 16 characters, an insertion of
    its language tag, and a replacement of 8 characters by a marker."""
    n = F.coalesce(F.length(text), F.lit(0))
    at = lambda k: F.pmod(F.xxhash64(F.col(doc_id), F.lit(k)), (n + 1).cast("long")).cast("int")
    one = lambda k, deleted, inserted: F.struct(at(k).alias("at"), F.lit(deleted).alias("deleted"), inserted.alias("inserted"))
    return F.array(one(1, 16, F.lit("")), one(2, 0, F.concat(F.lit(" ["), F.coalesce(F.col(lang), F.lit("")), F.lit("] "))), one(3, 8, F.lit("<cut>")))
