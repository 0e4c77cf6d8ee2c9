"""FM-index and window search against brute force, without Spark."""

import random
import re

import numpy as np

from pairsmith.llm.decontam import Phrases, cut, merge, word_hashes
from pairsmith.llm.fm_index import BitRank, FMIndex, WaveletMatrix, suffix_order


def test_rank_and_access():
    rng = np.random.default_rng(1)
    bits = rng.integers(0, 2, 300).astype(np.uint8)
    assert (BitRank(bits).ones(np.arange(301)) == np.concatenate(([0], np.cumsum(bits)))).all()
    seq = rng.integers(0, 11, 500)
    w = WaveletMatrix(seq, 4)
    pos = np.arange(500)
    assert (w.access(pos) == seq).all()
    for c in range(16):
        got = w.rank(np.full(501, c), np.arange(501))[0]
        assert (got == np.concatenate(([0], np.cumsum(seq == c)))).all()


def test_suffix_order_and_search():
    rng = random.Random(2)
    for _ in range(60):
        seq = np.array([rng.choice([0, 1, 1, 2, 3]) for _ in range(rng.randint(0, 90))] + [0])
        n = len(seq)

        def suffix(i):  # separators are unlike each other, ordered by place
            out = []
            for j in range(i, n):
                out.append((int(seq[j]), j if seq[j] == 0 else 0))
                if seq[j] == 0:
                    break
            return out
        order = suffix_order(seq)
        assert order.tolist() == sorted(range(n), key=suffix)
        index = FMIndex(seq)
        assert (np.sort(index.locate(np.arange(n))) == np.arange(n)).all()
        for size in (1, 2, 3):
            pats = np.array([[0] * (3 - size) + [rng.randint(1, 4) for _ in range(size)] for _ in range(20)])
            lo, hi = index.search(pats, np.full(20, size))
            for p, a, b in zip(pats, lo, hi):
                want = [i for i in range(n - size + 1) if seq[i:i + size].tolist() == p[3 - size:].tolist()]
                assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def words(t):
    low = re.sub("[A-Z]", lambda m: m.group().lower(), t)
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def test_find_against_brute_force():
    rng = random.Random(3)
    vocab = ["the", "Of", "é", "x1", "ZZ", "中"]
    for window in (3, 10):
        for _ in range(30):
            def text(n):
                return "".join(rng.choice(vocab) + rng.choice([" ", "-", "\n", "_."]) for _ in range(n))
            docs = [text(rng.randint(0, 60)) for _ in range(8)] + [None, "", "!!"]
            items = [(str(i), text(rng.randint(0, window + 3)).encode()) for i in range(6)]
            counts, spans, found = Phrases(items, window).find([t if t is None else t.encode() for t in docs])
            for d, t in enumerate(docs):
                ws = words(t or "")
                assert counts[d] == len(ws)
                hit, ids = set(), set()
                for name, body in items:
                    iw = words(body.decode())
                    size = min(window, len(iw))
                    for k in range(len(iw) - size + 1 if size else 0):
                        for s in range(len(ws) - size + 1):
                            if ws[s:s + size] == iw[k:k + size]:
                                hit.update(range(s, s + size))
                                ids.add(name)
                assert {w for a, b in spans.get(d, []) for w in range(a, b)} == hit
                assert found.get(d, set()) == ids


def test_cut_and_merge():
    assert merge([(5, 7), (0, 2), (2, 3)]) == [(0, 3), (5, 7)]
    assert cut(b"A b, c d.", [(1, 3)]) == b"A  d."


def test_long_word_and_case():
    h, n = word_hashes([b"x" * 9000 + b" AB ab", None])
    assert n.tolist() == [3, 0] and h[1] == h[2]
