"""Token alignment against a plain implementation over whole texts."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tapewire.llm import token_alignment as ta
from tapewire.llm.queries import TOKENIZERS, contents
from tapewire.llm.token_counts import PATTERN
from tests.llm.helpers import awkward, frame

ODD = ["a", "b", "é", "the", " ", "  ", "\n", "\t", " \n", "'s", "1", "2024", "!", "...", "▁", "\x1c", "\x85", "\xa0", "᠎", "😀", "中文", "<s>", "</s>", "<unk>", "<0x0A>", "<|endoftext|>", "\x00", "ﬁ", "é", "\r\n", "   "]


def models():
    return contents(f"{TOKENIZERS}/byte_bpe_50k.json"), contents(f"{TOKENIZERS}/piece_bpe_32k.model")


def odd_texts(n, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice(ODD) for _ in range(rng.randrange(1, 14))) for _ in range(n)]


def plain(rows):
    """By the two libraries over whole texts, byte by byte."""
    raw_a, raw_b = models()
    a = Tokenizer.from_str(raw_a.decode())
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_proto=raw_b)
    byte = ta.byte_level_decoder()
    per, counts = [], Counter()
    for i, text in rows:
        links, groups, n_a, n_b = [], [], 0, 0
        if text:
            xs = a.encode(" " + text, add_special_tokens=False).ids
            ys = b.encode(text)
            bx = [bytes(byte[c] for c in a.id_to_token(x)) for x in xs]
            by = [bytes([int(b.id_to_piece(y)[3:5], 16)]) if b.is_byte(y) else b.id_to_piece(y).replace("▁", " ").encode() for y in ys]
            if b"".join(bx) == b"".join(by) == (" " + text).encode():
                n_a, n_b = len(xs), len(ys)
                ea, eb = np.cumsum([len(t) for t in bx]).tolist(), np.cumsum([len(t) for t in by]).tolist()
                j = 0
                for k, x in enumerate(xs):
                    lo = ea[k - 1] if k else 0
                    while eb[j] <= lo:
                        j += 1
                    m = j
                    while m < n_b and (eb[m - 1] if m else 0) < ea[k]:
                        links.append((x, ys[m]))
                        m += 1
                p = q = 0
                for end in sorted(set(ea) & set(eb)):
                    u, v = ea.index(end, p) + 1, eb.index(end, q) + 1
                    groups.append(",".join(map(str, xs[p:u])) + "|" + ",".join(map(str, ys[q:v])))
                    p, q = u, v
        counts.update(links)
        per.append((i, n_a, n_b, len(groups), links, ";".join(groups)))
    top: dict = {}
    for (x, y), c in counts.items():
        top[y] = max(top.get(y, 0), c)
    out = []
    for i, n_a, n_b, n_groups, links, text in per:
        best = sum(counts[p] == top[p[1]] for p in links)
        out.append((-1 if i is None else i, n_a, n_b, n_groups, len(links), best, sum(counts[p] for p in links), hashlib.sha256(text.encode()).hexdigest() if text else ""))
    return sorted(out)


def test_pointer_jumping_labels_components():
    rng = np.random.default_rng(4)
    for _ in range(200):
        n = int(rng.integers(1, 60))
        ends = [np.unique(np.append(rng.integers(1, n + 1, rng.integers(1, n + 1)), n)) for _ in range(2)]
        common = np.intersect1d(*ends)
        for label, e in zip(ta.component_labels(*ends), ends, strict=True):
            assert ends[1][label].tolist() == common[np.searchsorted(common, e)].tolist()


def test_units_give_the_tokens_of_whole_texts():
    raw_a, raw_b = models()
    whole = Tokenizer.from_str(raw_a.decode())
    whole.encode_special_tokens = True
    a, b = ta.ByteLevel(raw_a, PATTERN), ta.Pieces(raw_b)
    for text in [*odd_texts(3000), *(t for _, t in awkward() if t)]:
        u = ta.units(text)
        assert "".join(u) == " " + text
        assert [i for x in a.encode(u) for i in x] == whole.encode(" " + text, add_special_tokens=False).ids
        assert [i for x in b.encode(u) for i in x] == b.model.encode(text)


@pytest.mark.parametrize(("block", "salt", "held"), [(4 << 20, 512, 1 << 21), (900, 1, 500)])
def test_alignment(spark, monkeypatch, block, salt, held):
    monkeypatch.setattr(ta, "BLOCK", block)
    monkeypatch.setattr(ta, "BLOCKS_A_SALT", salt)
    monkeypatch.setattr(ta, "KEPT_UNITS", held)
    monkeypatch.setattr(ta, "HELD_PAIRS", held)
    monkeypatch.setattr(ta, "TABLE_PIECE", held)
    rows = awkward() + list(enumerate(odd_texts(150), 1000)) + [(2000, "ok " * 900 + "▁ " + "ok " * 900)]
    got = ta.aligned(frame(spark, rows), *models(), PATTERN).collect()
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(tuple(-1 if r[c] is None else r[c] for c in names) for r in got) == plain(rows)


def test_alignment_of_nothing(spark):
    assert ta.aligned(frame(spark, []), *models(), PATTERN).collect() == []
    got = ta.aligned(frame(spark, [(1, None), (None, ""), (1, None)]), *models(), PATTERN).collect()
    assert sorted(map(str, (tuple(r) for r in got))) == ["(1, 0, 0, 0, 0, 0, 0, '')"] * 2 + ["(None, 0, 0, 0, 0, 0, 0, '')"]
