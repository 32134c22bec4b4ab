"""Alignment of two tokenizers by pointer jumping, with corpus-wide counts of linked ids.

Both vocabularies tile the same bytes (a space and the text).  Every token points to the token farthest
right that overlaps it: a token of A to the token of B that holds its last byte, and back.  Doubling these
successors over whole arrays (``next = next[next]``) takes each token to the last token of its component in
a number of rounds logarithmic in the longest chain.  That token labels the group.

Neither tokenizer joins a non-space with a space behind it, so a text is cut there into units, a word each
as a rule, that are encoded and aligned on their own; the tokens of a text are those of its units.  A unit
is encoded once a task and aligned once a block, however often it comes.

A text's figures need counts of the whole corpus, but neither texts nor links are collected by id:

1. one scan writes for each block of units, and each of ``SHARDS`` shards of B ids, the id pairs with the
   texts that hold them (binary arrays), and a row for each text with all that needs no counts;
2. counts of pairs are summed inside the tasks, by (shard, salt), and by shard; all pairs of a B id lie in
   one shard, so its highest count is known there;
3. the shard's table meets the block messages of the shard, dealt over salts, and each text gets its
   partial sums.

Tables of a shard are bounded by the product of the vocabularies; frequent ids are pre-aggregated in a block,
and a shard's messages are dealt over more salts as the blocks grow.
"""

from __future__ import annotations

import hashlib
import json
import re
import zlib
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapewire.llm.tables import saved, small_batches

#: Bytes of text in a block.
BLOCK = 4 << 20
SHARDS = 64
#: Blocks whose messages for one shard meet in one group.
BLOCKS_A_SALT = 512
#: Aligned units kept by a task; beyond that the store starts anew.
KEPT_UNITS = 1 << 19
#: Pairs of a piece of a shard's table, and of what a task holds before it passes sums on.
TABLE_PIECE = 1 << 18
HELD_PAIRS = 1 << 21
_ID_BITS = 20
#: The cut between units: a character that no tokenizer takes for white space, before a space.
_UNIT = re.compile(r" [^ ]*(?:(?<![^\s᠎▁]) [^ ]*)*")


def units(text: str) -> list[str]:
    """A space and the text, cut where a non-space meets a space."""
    return _UNIT.findall(" " + text)


class ByteLevel:
    """Vocabulary A: a byte-level BPE file of the ``tokenizers`` library, as bytes and ids.

    Its merges must stand in the order of their ids, as they do in files that have a rank for each token;
    the ranks then give the same tokens as the merges.  A file of another kind raises ValueError.
    """

    def __init__(self, raw: bytes, pattern: str):
        import tiktoken

        model = json.loads(raw)["model"]
        vocab = model["vocab"]
        parts = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        first = len(vocab) - len(parts)
        ids = [vocab["".join(p)] for p in parts]
        if any(b <= a for a, b in zip(ids, ids[1:], strict=False)):
            raise ValueError("the merges are not in the order of their ids")
        byte = byte_level_decoder()
        merged = set(ids)
        ranks = {bytes(byte[c] for c in t): i for t, i in vocab.items() if i in merged or len(t) == 1}
        if len(ranks) < 256 or first < 256:
            raise ValueError("not a byte-level vocabulary")
        self.model = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.sizes = np.zeros(max(vocab.values()) + 1, np.int64)
        for token, i in ranks.items():
            self.sizes[i] = len(token)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [self.model.encode_ordinary(t) for t in texts]


def byte_level_decoder() -> dict[str, int]:
    """Byte of each character of a byte-level vocabulary: printable Latin-1 stands for itself, the
    other bytes, in order, for the characters from U+0100 on."""
    out, spare = {}, 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174:
            out[chr(b)] = b
        else:
            out[chr(spare)] = b
            spare += 1
    return out


class Pieces:
    """Vocabulary B: a sentencepiece file that puts a space before a text and falls back to bytes."""

    def __init__(self, raw: bytes):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=raw)
        n = self.model.get_piece_size()
        self.pieces = [self.model.id_to_piece(i) for i in range(n)]
        if any("▁" in p.lstrip("▁") for p in self.pieces):
            raise ValueError("a piece reaches over a space: texts cannot be cut there")
        self.bytes = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(self.pieces)]
        self.sizes = np.array([len(b) for b in self.bytes], np.int64)
        self.space = self.model.piece_to_id("▁")

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Units, each with its space, which the model adds itself; of a lone space it makes nothing."""
        got = self.model.encode([t[1:] for t in texts], num_threads=1)
        return [g if len(t) > 1 else [self.space] for g, t in zip(got, texts, strict=True)]


def component_labels(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each token of A and of B, the number of the token of B that is last in its component.

    ``ends_a`` and ``ends_b``: rising ends of two tilings of the same bytes.  Tokens of A have the numbers
    0 to n_a - 1, those of B follow.
    """
    n_a, n_b = len(ends_a), len(ends_b)
    nxt = np.empty(n_a + n_b, np.int64)
    nxt[:n_a] = n_a + np.searchsorted(ends_b, ends_a)  # holds the last byte of the token
    back = np.searchsorted(ends_a, ends_b)
    nxt[n_a:] = np.where(ends_a[np.minimum(back, n_a - 1)] > ends_b, back, n_a + np.arange(n_b))  # itself where both end
    while True:
        further = nxt[nxt]
        if np.array_equal(further, nxt):
            return nxt[:n_a] - n_a, nxt[n_a:] - n_a
        nxt = further


def overlaps(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token numbers (of A, of B) of every overlapping pair: one for each stretch between two ends."""
    every = np.sort(np.concatenate((ends_a, ends_b)), kind="stable")  # two rising runs: a merge
    every = every[np.flatnonzero(np.diff(every, prepend=-1))]
    return np.searchsorted(ends_a, every), np.searchsorted(ends_b, every)


def pack(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Shard, B id and A id in one number; sorting it sorts by shard, then by B id."""
    shard = (b * 0x9E3779B1 >> 7) % SHARDS
    return (shard << (2 * _ID_BITS)) | (b << _ID_BITS) | a


def shard_of(pair: np.ndarray) -> np.ndarray:
    return pair >> (2 * _ID_BITS)


def target_of(pair: np.ndarray) -> np.ndarray:
    return (pair >> _ID_BITS) & ((1 << _ID_BITS) - 1)


def id_words(n: int, inside: str, last: str) -> np.ndarray:
    """Decimal ids with the mark that follows them inside a list, then with that of a list's end."""
    return np.array([f"{i}{inside}".encode() for i in range(n)] + [f"{i}{last}".encode() for i in range(n)], object)


def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """All values, and the n + 1 bounds of the lists in them."""
    bounds = np.concatenate(([0], np.cumsum(np.fromiter(map(len, lists), np.int64, len(lists)))))
    return np.fromiter(chain.from_iterable(lists), np.int64, int(bounds[-1])), bounds


class Aligner:
    """Aligned units, each as (tokens of A, tokens of B, groups, packed links, groups as bytes ended by ";").

    None stands for a unit whose tokens of A or of B do not give its bytes.
    """

    def __init__(self, a: ByteLevel, b: Pieces):
        self.a, self.b = a, b
        self.words_a, self.words_b = id_words(len(a.sizes), ",", "|"), id_words(len(b.sizes), ",", ";")
        self.kept: dict[str, tuple | None] = {}

    def __call__(self, some: list[str]) -> list[tuple | None]:
        if len(self.kept) > KEPT_UNITS:
            self.kept = {}
        kept = self.kept
        new = [u for u in some if u not in kept]
        fresh = dict(zip(new, self._aligned(new), strict=True)) if new else {}
        kept.update((u, x) for u, x in fresh.items() if len(u) <= 64)
        return [fresh[u] if u in fresh else kept[u] for u in some]

    def _aligned(self, new: list[str]) -> list[tuple | None]:
        raw = [u.encode() for u in new]
        all_a, all_b = self.a.encode(new), self.b.encode(new)
        of_b = self.b.bytes.__getitem__
        sizes = np.add.reduceat(*_padded(self.a.sizes, all_a))
        good = [b"".join(map(of_b, y)) == r for y, r in zip(all_b, raw, strict=True)]
        good = np.array(good) & (sizes == np.fromiter(map(len, raw), np.int64, len(raw)))
        some = np.flatnonzero(good)
        out: list = [None] * len(new)
        if len(some):
            for k, x in zip(some.tolist(), self._table([all_a[k] for k in some], [all_b[k] for k in some]), strict=True):
                out[k] = x
        return out

    def _table(self, all_a: list[list[int]], all_b: list[list[int]]) -> Iterator[tuple]:
        """Units, one after the other, are two tilings of the same bytes."""
        a, bounds_a = _flat(all_a)
        b, bounds_b = _flat(all_b)
        ends_a, ends_b = np.cumsum(self.a.sizes[a]), np.cumsum(self.b.sizes[b])
        last_a, last_b = component_labels(ends_a, ends_b)
        closes = last_b == np.arange(len(b))  # one in each group
        closed = np.concatenate(([0], np.cumsum(closes)))
        group_a, group_b = closed[last_a], closed[last_b]
        n_all = int(closed[-1])
        a_before = np.concatenate(([0], np.cumsum(np.bincount(group_a, minlength=n_all))))  # tokens of A in earlier groups
        b_before = np.concatenate(([0], np.cumsum(np.bincount(group_b, minlength=n_all))))
        tail_a = np.diff(group_a, append=n_all) != 0
        pieces = np.empty(len(a) + len(b), object)
        pieces[np.arange(len(a)) + b_before[group_a]] = self.words_a[a + tail_a * (len(self.words_a) // 2)]
        pieces[np.arange(len(b)) + a_before[group_b + 1]] = self.words_b[b + closes * (len(self.words_b) // 2)]
        x, y = overlaps(ends_a, ends_b)
        links = pack(a[x], b[y]).tobytes()
        n_a, n_b, n_groups = np.diff(bounds_a), np.diff(bounds_b), np.diff(closed[bounds_b])
        link_at = np.concatenate(([0], np.cumsum(n_a + n_b - n_groups))) * 8
        text_at, link_at = (bounds_a + bounds_b).tolist(), link_at.tolist()
        flat = pieces.tolist()
        for k, (p, q, g) in enumerate(zip(n_a.tolist(), n_b.tolist(), n_groups.tolist(), strict=True)):
            yield p, q, g, links[link_at[k] : link_at[k + 1]], b"".join(flat[text_at[k] : text_at[k + 1]])


def _padded(sizes: np.ndarray, lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Sizes of the values of non-empty lists and the starts of the lists."""
    values, bounds = _flat(lists)
    return sizes[values], bounds[:-1]


def _packed(x: np.ndarray, kind) -> bytes:
    return zlib.compress(np.ascontiguousarray(x, kind).tobytes(), 1)


def _opened(blob: bytes, kind) -> np.ndarray:
    return np.frombuffer(zlib.decompress(blob), kind)


def _pairs_out(pairs: np.ndarray) -> bytes:
    return _packed(np.diff(pairs, prepend=0), np.int64)


def _pairs_in(blob: bytes) -> np.ndarray:
    return np.cumsum(_opened(blob, np.int64))


def _small(x: np.ndarray) -> bytes:
    """Whole numbers from 0 on, with their width in front."""
    top = int(x.max()) if len(x) else 0
    kind = np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.uint64
    return bytes([np.dtype(kind).itemsize]) + _packed(x, kind)


def _large(blob: bytes) -> np.ndarray:
    return _opened(blob[1:], {1: np.uint8, 2: np.uint16, 4: np.uint32, 8: np.uint64}[blob[0]]).astype(np.int64)


_FIELDS = [("row", pa.int64()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string()), ("block", pa.int64()), ("shard", pa.int32()), ("first", pa.int64()), ("pairs", pa.binary()), ("counts", pa.binary()), ("runs", pa.binary()), ("docs", pa.binary()), ("times", pa.binary())]
_SCHEMA = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, block long, shard int, first long, pairs binary, counts binary, runs binary, docs binary, times binary"


def _batch(columns: dict) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    return pa.record_batch([pa.array(columns[c], t) if c in columns else pa.nulls(n, t) for c, t in _FIELDS], schema=pa.schema(_FIELDS))


def _messages(doc: np.ndarray, links: np.ndarray, first: int, block: int) -> pa.RecordBatch:
    """The links of a block by shard: pairs, their counts, and the texts of each with its share."""
    base = int(doc.min())
    span = int(doc.max()) - base + 1
    pairs, pair_no = np.unique(links, return_inverse=True)
    cell, times = np.unique(pair_no * span + (doc - base), return_counts=True)
    held = cell // span
    runs = np.bincount(held, minlength=len(pairs))
    counts = np.bincount(held, weights=times, minlength=len(pairs)).astype(np.int64)
    shards, lo = np.unique(shard_of(pairs), return_index=True)
    hi = [*lo[1:], len(pairs)]
    at = np.concatenate(([0], np.cumsum(runs)))
    out: dict[str, list] = {c: [] for c in ("block", "shard", "first", "pairs", "counts", "runs", "docs", "times")}
    for s, x, y in zip(shards, lo, hi, strict=True):
        row = (block, int(s), first + base, _pairs_out(pairs[x:y]), _small(counts[x:y]), _small(runs[x:y]), _small(cell[at[x] : at[y]] % span), _small(times[at[x] : at[y]]))
        for c, v in zip(out, row, strict=True):
            out[c].append(v)
    return _batch(out)


def _scan(docs: DataFrame, vocabulary_a: bytes, vocabulary_b: bytes, pattern: str) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast((vocabulary_a, vocabulary_b))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = None
        start = TaskContext.get().partitionId() << 40
        row = block = start
        for batch in batches:
            aligner = aligner or Aligner(ByteLevel(shared.value[0], pattern), Pieces(shared.value[1]))
            n = batch.num_rows
            sums = np.zeros((4, n), np.int64)  # n_a, n_b, n_groups, n_links
            good = np.ones(n, bool)
            hashes: list = [None] * n
            held, size = [], 0  # (text number, units) of the block

            def block_of(held: list) -> Iterator[pa.RecordBatch]:
                nonlocal block
                number: dict[str, int] = {}
                place = number.setdefault
                of = np.array([place(u, len(number)) for _, part in held for u in part], np.int64)
                doc = np.repeat([k for k, _ in held], [len(part) for _, part in held])
                table = aligner(list(number))
                failed = np.array([x is None for x in table], bool)
                good[doc[failed[of]]] = False
                keep = good[doc]
                if not keep.any():
                    return
                of, doc = of[keep], doc[keep]
                none = (0, 0, 0, b"", b"")
                n_a, n_b, n_groups, packed, text = zip(*[x or none for x in table], strict=True)
                width = np.array(n_a) + n_b - n_groups
                for k, column in enumerate((np.array(n_a), np.array(n_b), np.array(n_groups), width)):
                    sums[k] += np.bincount(doc, weights=column[of], minlength=n).astype(np.int64)
                first = np.cumsum(width) - width
                links = np.frombuffer(b"".join(packed), np.int64)
                width, first = width[of], first[of]
                at = np.flatnonzero(np.diff(doc, prepend=-1)).tolist()
                order = of.tolist()
                for lo, hi in zip(at, [*at[1:], len(doc)], strict=True):
                    part = b"".join([text[u] for u in order[lo:hi]])[:-1]  # the last mark is held back
                    if hashes[doc[lo]] is None:
                        hashes[doc[lo]] = hashlib.sha256(part)
                    else:
                        hashes[doc[lo]].update(b";" + part)
                link = np.repeat(first - (np.cumsum(width) - width), width) + np.arange(int(width.sum()))
                yield _messages(np.repeat(doc, width), links[link], row, block)
                block += 1

            for k, raw in enumerate(batch.column(1)):
                try:
                    text = raw.as_buffer().to_pybytes().decode() if raw.is_valid else ""
                except UnicodeDecodeError:
                    text = ""
                found = units(text) if text else []
                good[k] = bool(found)
                if size + len(text) > BLOCK and held:
                    yield from block_of(held)
                    held, size = [], 0
                if len(text) > BLOCK:  # several blocks, if all of it is given back
                    step = max(1, len(found) * BLOCK // len(text))
                    parts = [found[lo : lo + step] for lo in range(0, len(found), step)]
                    good[k] = all(x is not None for part in parts for x in aligner(list(dict.fromkeys(part))))
                    for part in parts if good[k] else []:
                        yield from block_of([(k, part)])
                elif found:
                    held.append((k, found))
                    size += len(text)
            if held:
                yield from block_of(held)
            sums *= good
            sha = [h.hexdigest() if g else "" for g, h in zip(good, hashes, strict=True)]
            yield _batch({"row": row + np.arange(n), "doc_id": batch.column(0), "n_a": sums[0], "n_b": sums[1], "n_groups": sums[2], "n_links": sums[3], "groups_sha256": sha})
            row += n

    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, _SCHEMA)


def _summed(messages: DataFrame, salts: int) -> DataFrame:
    """(shard, pairs, counts, best): counts of each pair over the corpus, pieces of a shard's table."""

    def merge(parts: list) -> tuple[np.ndarray, np.ndarray]:
        pairs = np.concatenate([p for p, _ in parts])
        order = np.argsort(pairs, kind="stable")
        pairs = pairs[order]
        lo = np.flatnonzero(np.diff(pairs, prepend=-1))
        return pairs[lo], np.add.reduceat(np.concatenate([c for _, c in parts])[order], lo)

    def pieces(pairs: np.ndarray, counts: np.ndarray, columns: Callable) -> Iterator[pa.RecordBatch]:
        for lo in range(0, len(pairs), TABLE_PIECE):
            yield columns(pairs[lo : lo + TABLE_PIECE], counts[lo : lo + TABLE_PIECE])

    def one(shard: int, salt: int) -> Callable:
        return lambda p, c: pa.record_batch({"shard": pa.array([shard], pa.int32()), "salt": pa.array([salt], pa.int32()), "pairs": pa.array([_pairs_out(p)], pa.binary()), "counts": pa.array([_small(c)], pa.binary())})

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        n, salt = 0, TaskContext.get().partitionId() % salts

        def flush():
            pairs, counts = merge(held)
            held.clear()
            shards, lo = np.unique(shard_of(pairs), return_index=True)
            for s, x, y in zip(shards.tolist(), lo.tolist(), [*lo[1:].tolist(), len(pairs)], strict=True):
                yield from pieces(pairs[x:y], counts[x:y], one(s, salt))

        for b in batches:
            for p, c in zip(b.column("pairs").to_pylist(), b.column("counts").to_pylist(), strict=True):
                held.append((_pairs_in(p), _large(c)))
                n += len(held[-1][0])
                if n >= HELD_PAIRS:
                    yield from flush()
                    n = 0
        if held:
            yield from flush()

    def fold(batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray]:
        held: list = []
        n, kept = 0, 0
        for b in batches:
            for p, c in zip(b.column("pairs").to_pylist(), b.column("counts").to_pylist(), strict=True):
                held.append((_pairs_in(p), _large(c)))
                n += len(held[-1][0])
                if n >= HELD_PAIRS + 2 * kept:
                    held = [merge(held)]
                    n = kept = len(held[0][0])
        return merge(held)

    def by_salt(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from pieces(*fold(batches), one(key[0].as_py(), 0))

    def by_shard(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, counts = fold(batches)
        target = target_of(pairs)
        top = np.zeros(int(target.max()) + 1, np.int64)
        np.maximum.at(top, target, counts)
        best = counts == top[target]
        for lo in range(0, len(pairs), TABLE_PIECE):
            hi = lo + TABLE_PIECE
            yield pa.record_batch({"shard": pa.array([key[0].as_py()], pa.int32()), "pairs": pa.array([_pairs_out(pairs[lo:hi])], pa.binary()), "counts": pa.array([_small(counts[lo:hi])], pa.binary()), "best": pa.array([_packed(np.packbits(best[lo:hi]), np.uint8)], pa.binary())})

    kind = "shard int, salt int, pairs binary, counts binary"
    sums = messages.select("pairs", "counts").mapInArrow(inside, kind)
    if salts > 1:
        sums = sums.groupBy("shard", "salt").applyInArrow(by_salt, kind)
    return sums.groupBy("shard").applyInArrow(by_shard, "shard int, pairs binary, counts binary, best binary")


def _answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (shard, salt), a shard's table before its messages: partial sums by text."""
    now, parts, table = None, [], None
    for b in batches:
        for r in b.to_pylist():
            if now != (r["shard"], r["salt"]):
                now, parts, table = (r["shard"], r["salt"]), [], None
            if r["best"] is not None:
                pairs = _pairs_in(r["pairs"])
                parts.append((pairs, _large(r["counts"]), np.unpackbits(_opened(r["best"], np.uint8))[: len(pairs)]))
                continue
            if table is None:
                pairs = np.concatenate([p for p, _, _ in parts])
                order = np.argsort(pairs)
                table = pairs[order], np.concatenate([c for _, c, _ in parts])[order], np.concatenate([f for _, _, f in parts]).astype(np.int64)[order]
                parts = []
            at = np.repeat(np.searchsorted(table[0], _pairs_in(r["pairs"])), _large(r["runs"]))
            doc, times = _large(r["docs"]), _large(r["times"])
            # whole numbers: sums by text in integers, not in doubles
            order = np.argsort(doc, kind="stable")
            who, lo = np.unique(doc[order], return_index=True)
            count = np.add.reduceat((table[1][at] * times)[order], lo)
            best = np.add.reduceat((table[2][at] * times)[order], lo)
            yield pa.record_batch({"row": pa.array(who + r["first"], pa.int64()), "count_sum": pa.array(count, pa.int64()), "n_best": pa.array(best, pa.int64())})


def aligned(docs: DataFrame, vocabulary_a: bytes, vocabulary_b: bytes, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) for each row.

    ``vocabulary_a``: content of a byte-level BPE file, ``pattern`` its pre-token pattern; ``vocabulary_b``:
    content of a sentencepiece file.  Both encode a space and the text, without special tokens.  A link is
    a pair of overlapping tokens; an id pair's count is the number of links that hold it in all rows.
    ``n_best``: links whose count is the highest of their B id; ``count_sum``: counts summed over the links.
    ``groups_sha256``: of the groups as ``a1,a2|b1;a3|b2``.

    A text that is null, empty, not valid UTF-8 or not given back by both tokenizers has no tokens: zeros and
    an empty hash.  Repeated rows and rows with a null or repeated doc_id count and stay as rows of their own.
    An empty table gives no rows.  Other columns are ignored.  Lowers the session's Arrow batch size.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    table = saved(_scan(rows, vocabulary_a, vocabulary_b, pattern))
    texts = table.where("shard IS NULL").select("row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
    messages = table.where("shard IS NOT NULL")
    blocks = messages.agg(F.count("*")).first()[0] // SHARDS + 1
    salts = -(-blocks // BLOCKS_A_SALT)
    counts = saved(_summed(messages, salts))
    names = ["shard", "salt", "first", "pairs", "counts", "runs", "docs", "times", "best"]
    told = counts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).withColumns({"first": F.lit(None).cast("long"), **{c: F.lit(None).cast("binary") for c in ("runs", "docs", "times")}})
    asked = messages.withColumns({"salt": F.pmod(F.xxhash64("block"), F.lit(salts)).cast("int"), "best": F.lit(None).cast("binary")})
    # counts of the messages are of no use here
    both = told.select(names).unionByName(asked.withColumn("counts", F.lit(None).cast("binary")).select(names))
    dealt = both.repartition("shard", "salt").sortWithinPartitions("shard", "salt", F.col("best").isNull())
    sums = dealt.mapInArrow(_answers, "row long, count_sum long, n_best long").groupBy("row").agg(F.sum("count_sum").alias("count_sum"), F.sum("n_best").alias("n_best"))
    got = texts.join(sums, "row", "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return got.select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")
