"""What grows with the corpus in op8: anchors shared by chance, uneven buckets, records of every batch to every bucket."""

import random
from collections import Counter

import numpy as np

from tidegraph.llm import suffixes


def prose(rng, n):
    syllables = ["ta", "ren", "o", "lich", "ke", "is", "vor", "un", "ga", "the", "mi", "sol"]
    text = "".join(rng.choice(syllables) + (" " if rng.random() < 0.3 else "") for _ in range(n // 3))
    return text.encode()


def documents(seed, n=300, size=6000):
    rng = random.Random(seed)
    texts = [prose(rng, size) for _ in range(n)]
    return b"".join(texts), np.cumsum([len(t) for t in texts])


def test_few_anchors_are_shared_by_chance():
    data, ends = documents(1)
    _, _, code, doc = suffixes.anchors(np.frombuffer(data, np.uint8), ends)
    docs = Counter(c for c, _ in set(zip(code.tolist(), doc.tolist())))
    assert sum(docs[c] > 1 for c in code.tolist()) < 0.01 * len(code)


def test_anchors_are_dealt_evenly():
    data, ends = documents(2)
    code = np.unique(suffixes.anchors(np.frombuffer(data, np.uint8), ends)[2])
    part = ((code >> np.uint64(32)).astype(np.int64) * 50) >> 32
    assert np.bincount(part, minlength=50).max() < 1.3 * len(code) / 50


def test_edges_are_windows_of_smaller_ids():
    rng = np.random.default_rng(5)
    strings, codes, least = [], [], []
    for code in range(40):
        base = rng.integers(97, 100, suffixes.WIDEST).astype(np.uint8)
        for _ in range(rng.integers(1, 6)):
            own = base.copy()
            own[rng.integers(0, 30)] = 1
            own[rng.integers(60, suffixes.WIDEST)] = 2
            strings.append(own.tobytes() + bytes([suffixes.WIDEST - suffixes.LENGTH + 1]))
            codes.append(code)
            least.append(int(rng.integers(0, 1000)))
    strings = np.array(strings, f"S{suffixes.WIDEST + 1}")
    codes, least = np.array(codes, np.uint64), np.array(least, np.int64)
    first = {}
    for s, i in zip(strings.tolist(), least.tolist()):
        for k in range(suffixes.WIDEST - suffixes.LENGTH + 1):
            w = s[k : k + suffixes.LENGTH]
            first[w] = min(first.get(w, i), i)
    want = {(n, k) for n, (s, i) in enumerate(zip(strings.tolist(), least.tolist())) for k in range(suffixes.WIDEST - suffixes.LENGTH + 1) if first[s[k : k + suffixes.LENGTH]] < i}
    for together in (7, 1 << 16):
        got = {(n, k + j) for n, k, m in zip(*(x.tolist() for x in suffixes._edges(strings, least, codes, together))) for j in range(m)}
        assert got == want and want
