"""Language-model scores from a hierarchical Pitman-Yor model.

Tokens are the lower-cased words of a text and one end.  A restaurant stands for a context, the token before
(at a text's start the end token): 48 bits of its hash.  All context restaurants share one parent, the restaurant
of single tokens, whose base is uniform over the vocabulary and one unseen token.  Tables of a context
restaurant are customers of its parent.

Seating is sampled by Gibbs sweeps.  In a sweep the customers of every (context, token) are seated anew by
the Chinese-restaurant rule, given the tables of the context and the parent's probabilities from the sweep
before; then the parent's customers.  From ``EXACT_SEATS`` customers on, groups of a sixteenth of those
seated are seated at once.

Three kinds of parts have one partitioner, so that what was shuffled once is read again without a shuffle:
blocks of documents, shards of tokens, which hold all pairs with these tokens, and shards of contexts.  A block
sends each of its pairs once, with the count in training texts, which may be 0.  A token shard sends the contexts
of its pairs once and after each sweep the tables by context, without the keys; context shards add them and send
the sums back in the same order.  Random numbers depend on shard and sweep alone: a repeated task seats alike, and
a later job replays the sweeps from the table counts instead of storing seatings.  Only sums over all shards
reach the driver.

A task holds one block's tokens, or one shard's pairs, in few arrays of their length: what is sorted is ranked in
32 bits, read messages go as soon as their arrays are there, and sweeps follow each other without being kept.

Hot tokens, those with more than ``1 / (HOT_PER_SHARD * shards)`` of the tokens of a sample of texts, have their pairs
dealt over all shards by context.  Their customers and tables at the parent are summed over the shards and seated on
the driver (at most ``HOT_PER_SHARD * shards`` tokens).  Which tokens these are changes the work, not the model.

The score averages the predictive probabilities of the last ``SAMPLES`` sweeps for each pair.  Shards send its
log10 back to the blocks, which sum by document.  All counts are of the whole corpus.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import RDD, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapewire.llm.tables import small_batches
from tapewire.llm.words import slices

SWEEPS, SAMPLES = 3, 2
EXACT_SEATS = 256
STRENGTH = 1.0
BLOCK_TOKENS = 2 << 20
SENT_BYTES = 4 << 20
MIN_SHARDS, SHARD_BYTES = 48, 1 << 24
CONTEXT_BYTES = 6
HOT_PER_SHARD, HOT_SAMPLE = 4, 32
_SLOT = np.uint64(1023)
_END = np.uint64(0x5EED0F7E47E4D000)


def _tokens(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first text, token bounds, tokens, tokens before) of slices."""
    for w in slices(column, lower=True):
        n = np.diff(w.bounds)
        bounds = w.bounds + np.arange(len(w.bounds))
        token = np.full(int(bounds[-1]), _END)
        token[np.arange(len(w.hashes)) + np.repeat(np.arange(w.n_docs), n)] = w.hashes
        yield w.first, bounds, token, np.concatenate((np.array([_END]), token[:-1]))


def _context(before: np.ndarray) -> np.ndarray:
    return before >> np.uint64(64 - 8 * CONTEXT_BYTES)


def _part(high: np.ndarray, n: int) -> np.ndarray:
    """The shard of keys by their highest 32 bits."""
    return (high * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def _spans(x: np.ndarray) -> Iterator[tuple[int, slice]]:
    at = np.flatnonzero(np.diff(x, prepend=-1))
    for lo, hi in zip(at, [*at[1:], len(x)], strict=True):
        yield int(x[lo]), slice(lo, hi)


def _heads(*sorted_: np.ndarray) -> np.ndarray:
    """Where runs of equal keys start."""
    n = len(sorted_[0])
    new = np.zeros(n, bool)
    new[:1] = True
    for x in sorted_:
        new[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(new)


def _numbers(head: np.ndarray, n: int) -> np.ndarray:
    """The number of the run that each of ``n`` places is in."""
    out = np.zeros(n, np.int32)
    out[head[1:]] = 1
    return np.cumsum(out, out=out)


def _ranks(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values, sorted, and the place of each value among them.  Empties the list."""
    x = np.concatenate(parts)
    parts.clear()
    order = np.argsort(x)
    x = x[order]
    head = _heads(x)
    rank = np.empty(len(x), np.int32)
    rank[order] = _numbers(head, len(x))
    return x[head], rank


def _thin(x: np.ndarray, size: int) -> bytes:
    """The low bytes of each number."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size]).tobytes()


def _wide(blob: bytes, size: int) -> np.ndarray:
    out = np.zeros((len(blob) // size, 8), np.uint8)
    out[:, :size] = np.frombuffer(blob, np.uint8).reshape(-1, size)
    return out.reshape(-1).view("<u8")


def _small(x: np.ndarray) -> bytes:
    """Counts of mostly one byte."""
    large = np.flatnonzero(x >= 255)
    return len(x).to_bytes(8, "little") + np.minimum(x, 255).astype(np.uint8).tobytes() + large.astype(np.uint32).tobytes() + x[large].astype(np.uint64).tobytes()


def _counts(blob: bytes) -> np.ndarray:
    n = int.from_bytes(blob[:8], "little")
    out = np.frombuffer(blob, np.uint8, n, 8).astype(np.int64)
    m = (len(blob) - 8 - n) // 12
    if m:
        out[np.frombuffer(blob, np.uint32, m, 8 + n)] = np.frombuffer(blob, np.uint64, m, 8 + n + 4 * m).astype(np.int64)
    return out


def _narrow(parts: list[np.ndarray]) -> np.ndarray:
    """Counts in a row, in 32 bits if they fit."""
    return np.concatenate(parts, dtype=np.int32 if all(x.max(initial=0) < 2**31 for x in parts) else np.int64, casting="unsafe")


def _seat(c: np.ndarray, mass: np.ndarray, discount: float, rng: np.random.Generator) -> np.ndarray:
    """Tables after ``c`` customers of one dish took seats; ``mass`` is the weight of opening a table."""
    t = np.minimum(c, 1).astype(np.float64)
    order = np.flatnonzero(c > 1)  # most dishes have one customer, who is seated
    order = order[np.argsort(-c[order], kind="stable")]
    c_, t_, m_ = c[order], t[order], mass[order]
    less, seated = -c_, 1
    while True:
        n = int(np.searchsorted(less, -seated, side="left"))  # dishes with more customers than seated
        if not n:
            break
        group = 1 if seated < EXACT_SEATS else seated // 16
        p = m_[:n] / (seated - discount * t_[:n] + m_[:n])
        if group == 1:
            t_[:n] += rng.random(n) < p
        else:
            t_[:n] += rng.binomial(np.minimum(group, c_[:n] - seated), p)
        seated += group
    t[order] = t_
    return t


class Shard:
    """The customers of a shard's tokens, sorted by token.  ``context``: each pair's place in the lists by context
    of ``g``; without it the lowest ten bits of the key are that place."""

    def __init__(self, key: np.ndarray, count: np.ndarray, number: int, context: np.ndarray | None = None, hot: np.ndarray | None = None):
        self.count, self.number = count, number
        token = key & ~_SLOT if context is None else key
        self.context = (key & _SLOT).astype(np.int64) if context is None else context
        head = _heads(token)
        self.head, self.token = head, token[head]
        self.of = np.repeat(np.arange(len(head), dtype=np.int32), np.diff(np.append(head, len(key))))
        self.total = np.add.reduceat(count, head) if len(head) else np.zeros(0, np.int64)
        hot = np.zeros(0, np.uint64) if hot is None else hot
        self.is_hot = np.isin(self.token, hot)  # tokens of which other shards have pairs, too
        self.n_hot, self.hot = len(hot), np.searchsorted(hot, self.token[self.is_hot])

    def whole(self, x: np.ndarray, of_hot: np.ndarray | None) -> np.ndarray:
        """Numbers by token with those of hot tokens over all shards put in."""
        if of_hot is None or not len(self.hot):
            return x
        x = x.copy()
        x[self.is_hot] = of_hot[self.hot]
        return x

    def part(self, x: np.ndarray) -> np.ndarray:
        """This shard's share of the numbers of hot tokens."""
        return np.bincount(self.hot, x[self.is_hot], self.n_hot).astype(float)

    def sums(self) -> dict:
        """Customers and tables by context before the first sweep."""
        return {"customers": np.bincount(self.context, self.count), "tables": np.bincount(self.context, self.count > 0)}

    def replay(self, g: dict, sweeps: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(tables by (token, context), the parent's customers and tables by token) after each sweep."""
        return list(self.steps(g, sweeps))

    def steps(self, g: dict, sweeps: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """What ``replay`` lists, one sweep at a time."""
        t, own = np.minimum(self.count, 1).astype(float), np.minimum(self.total, 1).astype(float)
        n = self._by_token(t)
        for s in range(sweeps):
            before = g["history"][s]
            p = self.parent(self.whole(n, before.get("hot_customers")), self.whole(own, before.get("hot_tables")), before, g)
            rng = np.random.Generator(np.random.PCG64([11, self.number, s]))
            del t
            mass = g["d1"] * before["tables"][self.context]
            mass += STRENGTH
            mass *= p[self.of]
            t = _seat(self.count, mass, g["d1"], rng)
            del mass
            n = self._by_token(t)
            own = _seat(n.astype(np.int64), np.full(len(n), (STRENGTH + g["d0"] * before["parent_tables"]) / (g["V"] + 1)), g["d0"], rng)
            yield t, n, own

    def _by_token(self, t: np.ndarray) -> np.ndarray:
        return np.add.reduceat(t, self.head) if len(self.head) else np.zeros(0)

    @staticmethod
    def parent(n: np.ndarray, own: np.ndarray, state: dict, g: dict) -> np.ndarray:
        return (n - g["d0"] * own + (STRENGTH + g["d0"] * state["parent_tables"]) / (g["V"] + 1)) / (STRENGTH + state["parent_customers"])


def _read(items: Iterator[tuple], *kinds: str) -> dict[str, list]:
    """The messages of these kinds of a partition."""
    out: dict[str, list] = {k: [] for k in kinds}
    for _, message in items:
        if message[0] in out:
            out[message[0]].append(message[1:])
    return out


class _Pairs:
    """A token shard from the messages of all blocks, with its contexts in order.  Takes contexts and counts out of
    the messages."""

    def __init__(self, messages: list[tuple], number: int, n: int, hot: np.ndarray):
        token = np.concatenate([np.repeat(np.frombuffer(m[2], np.uint64), np.frombuffer(m[3], np.uint32)) for m in messages])
        context = np.concatenate([_wide(m[4], CONTEXT_BYTES) for m in messages])
        count = np.concatenate([_counts(m[5]) for m in messages])
        messages[:] = [m[:4] for m in messages]
        order = np.lexsort((context, token))
        token = token[order]
        context = context[order]
        count = count[order]
        head = _heads(token, context)
        self.place = np.empty(len(order), np.int32)
        self.place[order] = _numbers(head, len(order))
        del order
        count = np.add.reduceat(count, head)
        token = token[head]
        self.contexts, at = _ranks([context[head]])
        del context, head
        self.shard = Shard(token, count, number, at, hot)
        self.spans = list(_spans(_part(self.contexts >> np.uint64(8 * CONTEXT_BYTES - 32), n)))

    def state(self, g: dict, got: list[tuple]) -> dict:
        """``g`` with this shard's lists by context."""
        lists = {}
        for sweep in {m[0] for m in got}:
            parts = {m[1]: m for m in got if m[0] == sweep}
            lists[sweep] = [_narrow([_counts(parts[c][k]) for c, _ in self.spans]) for k in (2, 3) if parts[self.spans[0][0]][k] is not None]
        got.clear()
        return g | {"customers": lists[0][1], "history": [h | {"tables": lists[s][0]} for s, h in enumerate(g["history"])]}


def _at(key: int) -> int:
    return key


def _discount(ones: float, twos: float) -> float:
    return float(np.clip(ones / max(ones + 2 * twos, 1), 0.1, 0.95))


def _hot(rows: DataFrame, n: int) -> np.ndarray:
    """The frequent tokens of a sample of texts, sorted."""
    most = HOT_PER_SHARD * n

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, token, _ in _tokens(batch.column(0)):
                known, c = np.unique(token, return_counts=True)
                keep = c * 2 * most > len(token)
                yield pa.record_batch({"token": pa.array(known[keep].view(np.int64)), "c": pa.array(c[keep], pa.int64()), "n": pa.array(np.where(np.arange(keep.sum()) == 0, len(token), 0), pa.int64())})

    some = rows.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(HOT_SAMPLE)) == 0).select("text")
    got = some.mapInArrow(count, "token long, c long, n long").groupBy("token").agg(F.sum("c").alias("c"), F.sum("n").alias("n"))
    total = got.agg(F.sum("n")).first()[0] or 0
    hot = got.where(F.col("c") * most > total).select("token").toArrow().column(0).to_numpy().view(np.uint64)
    return np.sort(hot)


def _pairs(tokens: list[np.ndarray], learned: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The place of each token's pair among the distinct pairs, and their tokens, contexts and counts of ``learned``.

    ``tokens``: those of whole texts, each with its end; the list is emptied.
    """
    known, rank = _ranks(tokens)
    pair = rank.astype(np.int64)
    pair <<= 32
    pair[0] |= np.searchsorted(known, _END)
    pair[1:] |= rank[:-1]
    del rank
    order = np.argsort(pair)
    pair = pair[order]
    head = _heads(pair)
    count = np.add.reduceat(learned[order], head, dtype=np.int32)
    place = np.empty(len(order), np.int32)
    place[order] = _numbers(head, len(order))
    del order
    pair = pair[head]
    return place, known[pair >> 32], _context(known[pair & 0xFFFFFFFF]), count


def _blocks(rows: DataFrame, n: int, hot: np.ndarray) -> RDD:
    """Messages of blocks of documents: pairs to token shards, the documents themselves to the block's partition."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, blocks = TaskContext.get().partitionId(), 0

        def flush(held: list[tuple]) -> Iterator[pa.RecordBatch]:
            nonlocal blocks
            block, home = task << 24 | blocks, (task * 7919 + blocks) % n
            blocks += 1
            size, ids, out_, valid = (np.concatenate([h[k] for h in held]) for k in range(1, 5))
            tokens = [h[0] for h in held]
            held.clear()
            place, token, context, count = _pairs(tokens, np.repeat(out_ == 0, size))
            shard = _part(np.where(np.isin(token, hot), context >> np.uint64(8 * CONTEXT_BYTES - 32), token >> np.uint64(32)), n)
            order = np.argsort(shard, kind="stable")
            moved = np.empty(len(order), np.int32)
            moved[order] = np.arange(len(order), dtype=np.int32)
            place = moved[place]
            del moved
            token = token[order]
            context = context[order]
            count = count[order]
            shard = shard[order]
            del order
            width = 3 if len(token) < 1 << 24 else 8
            out = [{"to": home, "kind": "docs", "block": block, "home": width, "a": _thin(place, width), "b": size.astype(np.uint64).tobytes(), "c": ids.tobytes(), "d": (out_ | valid << 1).astype(np.uint8).tobytes()}]
            del place
            held_bytes = len(out[0]["a"])
            for s, at in _spans(shard):
                if held_bytes >= SENT_BYTES:
                    yield pa.RecordBatch.from_pylist(out, arrow)
                    out, held_bytes = [], 0
                first = _heads(token[at])
                one = (token[at][first].tobytes(), np.diff(np.append(first, at.stop - at.start)).astype(np.uint32).tobytes(), _thin(context[at], CONTEXT_BYTES), _small(count[at]))
                out.append({"to": s, "kind": "pairs", "block": block, "home": home, "a": one[0], "b": one[1], "c": one[2], "d": one[3]})
                held_bytes += sum(map(len, one))
            yield pa.RecordBatch.from_pylist(out, arrow)

        held, n_tokens = [], 0
        for batch in batches:
            ids = batch.column(0)
            valid = ids.is_valid().to_numpy(zero_copy_only=False).astype(np.uint8)
            ids = ids.fill_null(0).to_numpy()
            out_ = batch.column(1).to_numpy(zero_copy_only=False).astype(np.uint8)
            for at, bounds, token, _ in _tokens(batch.column(2)):
                part = slice(at, at + len(bounds) - 1)
                held.append((token, np.diff(bounds), ids[part], out_[part], valid[part]))
                n_tokens += len(token)
                if n_tokens >= BLOCK_TOKENS:
                    yield from flush(held)
                    n_tokens = 0
        if n_tokens:
            yield from flush(held)

    arrow = pa.schema([("to", pa.int64()), ("kind", pa.string()), ("block", pa.int64()), ("home", pa.int64()), *((c, pa.binary()) for c in "abcd")])
    sent = rows.mapInArrow(scan, "to long, kind string, block long, home long, a binary, b binary, c binary, d binary")
    return sent.rdd.map(lambda r: (r[0], (r[1], r[2], r[3], *(bytes(x) for x in r[4:])))).partitionBy(n, _at)


def scores(docs: DataFrame, train: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row.

    ``train``: a boolean column; rows where it is null or false are held out.  ``base_score``: the text's
    log10 probability under single tokens with one added to each count; ``score``: under the model.  A null
    text counts as empty: one end.  Null and repeated doc_ids are rows like others.  Without training rows
    every token has the base's probability.  Other columns are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), (~F.coalesce(F.col(train), F.lit(False))).alias("held_out"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    n_bytes = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(MIN_SHARDS, n_bytes // SHARD_BYTES)
    hot = _hot(rows, n)
    base = _blocks(rows, n, hot)

    def sweep(g: dict | None, s: int):
        """Sends tables by context after ``s`` sweeps, with sums over the shard; before the first also keys and customers."""

        def run(number: int, items: Iterator[tuple]) -> Iterator[tuple]:
            got = _read(items, "pairs", "tables")
            if not got["pairs"]:
                return
            own = _Pairs(got["pairs"], number, n, hot)
            x = own.shard
            if s == 0:
                by, once = x.sums(), x.total[~x.is_hot]
                total = np.array([(once > 0).sum(), x.total.sum(), (x.count == 1).sum(), (x.count == 2).sum(), (once == 1).sum(), (once == 2).sum(), (x.count > 0).sum()], float)
                total = np.concatenate((total, x.part(x.total), x.part(np.add.reduceat(x.count > 0, x.head, dtype=float))))
                by = (by["tables"].astype(np.int64), by["customers"].astype(np.int64))
            else:
                for t, customers, tables in x.steps(own.state(g, got["tables"]), s):  # noqa: B007
                    pass
                by, total = (np.bincount(x.context, t).astype(np.int64), None), np.concatenate(([customers.sum(), tables[~x.is_hot].sum()], x.part(customers)))
            yield number, ("total", s, total)
            for c, at in own.spans:
                yield c, ("sums", s, number, _small(by[0][at]), None if s else _small(by[1][at]), None if s else _thin(own.contexts[at], CONTEXT_BYTES))

        return run

    def add(s: int):
        """Adds tables, before the first sweep also customers, by context and sends them back."""

        def run(number: int, items: Iterator[tuple]) -> Iterator[tuple]:
            got = _read(items, "sums", "total")
            for sweep_, total in got["total"]:
                if sweep_ == s:
                    yield -1, ("total", total)
            if not got["sums"]:
                return
            first = sorted((m for m in got["sums"] if m[0] == 0), key=lambda m: m[1])
            now = sorted((m for m in got["sums"] if m[0] == s), key=lambda m: m[1])
            known, at = np.unique(np.concatenate([_wide(m[4], CONTEXT_BYTES) for m in first]), return_inverse=True)
            tables = np.bincount(at, np.concatenate([_counts(m[2]) for m in now]), len(known)).astype(np.int64)[at]
            customers = None if s else np.bincount(at, np.concatenate([_counts(m[3]) for m in now]), len(known)).astype(np.int64)[at]
            lo = 0
            for m in first:
                hi = lo + len(m[4]) // CONTEXT_BYTES
                yield m[1], ("tables", s, number, _small(tables[lo:hi]), None if s else _small(customers[lo:hi]))
                lo = hi

        return run

    def summed(messages: RDD, size: int) -> np.ndarray:
        return messages.filter(lambda m: m[0] == -1).map(lambda m: m[1][1]).treeAggregate(np.zeros(size), np.add, np.add)

    keys = base.mapPartitionsWithIndex(sweep(None, 0)).partitionBy(n, _at)
    back = keys.mapPartitionsWithIndex(add(0))
    got = summed(back, 7 + 2 * len(hot))
    v, n_tokens, ones, twos, words_once, words_twice, n_pairs = got[:7]
    hot_total, hot_customers = np.split(got[7:], 2)
    v, words_once, words_twice = v + (hot_total > 0).sum(), words_once + (hot_total == 1).sum(), words_twice + (hot_total == 2).sum()
    told = base.union(back.filter(lambda m: m[0] >= 0).partitionBy(n, _at))
    g = {"V": v, "N": n_tokens, "d1": _discount(ones, twos), "d0": _discount(words_once, words_twice), "history": [{"parent_customers": n_pairs, "parent_tables": v, "hot_customers": hot_customers, "hot_tables": np.minimum(hot_total, 1)}]}
    for s in range(1, SWEEPS + 1):
        back = keys.union(told.mapPartitionsWithIndex(sweep(g, s)).partitionBy(n, _at)).mapPartitionsWithIndex(add(s))
        got, before = summed(back, 2 + len(hot)), g["history"][-1]
        mass = np.full(len(hot), (STRENGTH + g["d0"] * before["parent_tables"]) / (v + 1))
        hot_tables = _seat(got[2:].astype(np.int64), mass, g["d0"], np.random.Generator(np.random.PCG64([13, s])))
        g = g | {"history": [*g["history"], {"parent_customers": got[0], "parent_tables": got[1] + hot_tables.sum(), "hot_customers": got[2:], "hot_tables": hot_tables}]}
        told = told.union(back.filter(lambda m: m[0] >= 0).partitionBy(n, _at))

    def score(number: int, items: Iterator[tuple]) -> Iterator[tuple]:
        """Log10 probabilities of the pairs of each block, in its order, and training counts of its tokens."""
        got = _read(items, "pairs", "tables")
        if not got["pairs"]:
            return
        own = _Pairs(got["pairs"], number, n, hot)
        x, here = own.shard, own.state(g, got["tables"])
        p = np.zeros(len(x.count))
        for k, ((t, customers, tables), state) in enumerate(zip(x.steps(here, SWEEPS), here["history"][1:], strict=True)):
            if k < SWEEPS - SAMPLES:
                continue
            up = x.parent(x.whole(customers, state["hot_customers"]), x.whole(tables, state["hot_tables"]), state, here)
            one = g["d1"] * state["tables"][x.context]
            one += STRENGTH
            one *= up[x.of]
            one += x.count - g["d1"] * t
            one /= STRENGTH + here["customers"][x.context]
            p += one
            del one
        in_training = x.whole(x.total, hot_total.astype(np.int64))
        p = np.log10(p / SAMPLES).astype(np.float32)
        lo = 0
        for block, home, token, size, *_ in got["pairs"]:
            size = np.frombuffer(size, np.uint32)
            hi = lo + int(size.sum())
            yield home, ("scores", block, number, p[own.place[lo:hi]].tobytes(), _small(in_training[np.searchsorted(x.token, np.frombuffer(token, np.uint64))]), size.tobytes())
            lo = hi

    def add_up(items: Iterator[tuple]) -> Iterator[tuple]:
        """Sums by document."""
        got = _read(items, "docs", "scores")
        for block, width, place, size, ids, marks in got["docs"]:
            parts = sorted((m for m in got["scores"] if m[0] == block), key=lambda m: m[1])
            total = np.concatenate([np.repeat(_counts(m[3]), np.frombuffer(m[4], np.uint32)) for m in parts])
            place, size = _wide(place, width).astype(np.int64), np.frombuffer(size, np.uint64).astype(np.int64)
            doc = np.repeat(np.arange(len(size)), size)
            by = lambda x: np.bincount(doc, x[place], len(size))
            p = np.concatenate([np.frombuffer(m[2], np.float32) for m in parts]).astype(float)
            yield ids, marks, size.tobytes(), by(total > 0).astype(np.int64).tobytes(), by(np.log10((total + 1) / (g["N"] + g["V"] + 1))).tobytes(), by(p).tobytes()

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                marks = np.frombuffer(r["marks"], np.uint8)
                size = np.frombuffer(r["size"], np.int64)
                cols = [pa.array(np.frombuffer(r["ids"], np.int64), mask=marks & 2 == 0), pa.array(marks & 1 == 1), size, np.frombuffer(r["known"], np.int64), np.full(len(size), int(g["N"])), np.frombuffer(r["base"], np.float64), np.frombuffer(r["score"], np.float64)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    sent = told.mapPartitionsWithIndex(score).partitionBy(n, _at)
    blobs = spark.createDataFrame(base.filter(lambda m: m[1][0] == "docs").union(sent).mapPartitions(add_up), "ids binary, marks binary, size binary, known binary, base binary, score binary")
    return blobs.mapInArrow(unpack, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
