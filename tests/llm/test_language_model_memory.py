"""What a task of the language model holds, in bytes a token or pair, and that its blocks stay whole."""

import tracemalloc

import numpy as np
import pyarrow as pa

from tapewire.llm import language_model


class Rows:
    """Takes the function that ``_blocks`` gives to Spark."""

    def mapInArrow(self, function, schema):
        self.scan = function
        return self

    @property
    def rdd(self):
        return self

    def map(self, function):
        return self

    def partitionBy(self, n, function):
        return self


class Task:
    @staticmethod
    def get():
        return Task

    @staticmethod
    def partitionId():
        return 0


def peak(function):
    """Bytes at most while the function runs, and its result."""
    tracemalloc.start()
    try:
        got = function()
        return tracemalloc.get_traced_memory()[1], got
    finally:
        tracemalloc.stop()


def test_a_block_is_cut_into_few_arrays(monkeypatch):
    """A whole block of 2 million tokens: under 80 bytes a token at once, and its messages have every pair."""
    monkeypatch.setattr(language_model, "TaskContext", Task)
    word = np.random.default_rng(5).zipf(1.3, 2_600_000) % 300_000
    texts = [" ".join(f"w{x}" for x in part) for part in np.array_split(word, 1000)]
    batches = [pa.record_batch({"doc_id": pa.array(range(k, k + 50), pa.int64()), "held_out": [i % 7 == 2 for i in range(k, k + 50)], "text": texts[k : k + 50]}) for k in range(0, 1000, 50)]
    list(language_model._tokens(pa.array(["warm up"])))
    rows, hot = Rows(), np.zeros(0, np.uint64)
    language_model._blocks(rows, 48, hot)
    most, sent = peak(lambda: [r for b in rows.scan(iter(batches)) for r in b.to_pylist()])
    assert most < 80 * language_model.BLOCK_TOKENS

    docs = {r["block"]: r for r in sent if r["kind"] == "docs"}
    assert len(docs) == 2
    for block, doc in docs.items():
        mine = sorted((r for r in sent if r["kind"] == "pairs" and r["block"] == block), key=lambda r: r["to"])
        token = np.concatenate([np.repeat(np.frombuffer(r["a"], np.uint64), np.frombuffer(r["b"], np.uint32)) for r in mine])
        context = np.concatenate([language_model._wide(r["c"], language_model.CONTEXT_BYTES) for r in mine])
        count = np.concatenate([language_model._counts(r["d"]) for r in mine])
        assert len(np.unique(np.rec.fromarrays([token, context]))) == len(token)
        place = language_model._wide(doc["a"], doc["home"]).astype(np.int64)
        ids = np.frombuffer(doc["c"], np.int64)
        parts = [(t, b) for _, _, t, b in language_model._tokens(pa.array([texts[i] for i in ids]))]
        assert (token[place] == np.concatenate([t for t, _ in parts])).all()
        assert (context[place] == language_model._context(np.concatenate([b for _, b in parts]))).all()
        learned = np.repeat(ids % 7 != 2, np.frombuffer(doc["b"], np.uint64).astype(np.int64))
        assert (count == np.bincount(place, learned, len(token))).all()


def test_a_shard_is_seated_in_few_arrays():
    """Half a million pairs from four blocks, read and seated: under 80 bytes a pair."""
    rng = np.random.default_rng(6)
    messages = []
    for block in range(4):
        key = np.unique(np.rec.fromarrays([rng.integers(1, 20_000, 500_000, dtype=np.uint64) << np.uint64(40), rng.zipf(1.2, 500_000).astype(np.uint64) % np.uint64(100_000) << np.uint64(20)]))
        token, first = np.unique(key.f0, return_index=True)
        messages.append((block, 0, token.tobytes(), np.diff(np.append(first, len(key))).astype(np.uint32).tobytes(), language_model._thin(key.f1, language_model.CONTEXT_BYTES), language_model._small(rng.zipf(1.8, len(key)) % 1000)))
    n = sum(len(m[4]) // language_model.CONTEXT_BYTES for m in messages)

    def run():
        own = language_model._Pairs(messages, 0, 48, np.zeros(0, np.uint64))
        by = own.shard.sums()
        state = {"parent_customers": 1e6, "parent_tables": 2e4, "tables": by["tables"]}
        return own, own.shard.replay({"V": 2e4, "d0": 0.5, "d1": 0.5, "history": [state]}, 1)[-1]

    most, (own, (t, _, _)) = peak(run)
    assert most < 80 * n
    assert own.shard.count.sum() > 0 and (t <= own.shard.count).all()
    again = own.shard.replay({"V": 2e4, "d0": 0.5, "d1": 0.5, "history": [{"parent_customers": 1e6, "parent_tables": 2e4, "tables": own.shard.sums()["tables"]}]}, 1)[-1][0]
    assert (t == again).all()
