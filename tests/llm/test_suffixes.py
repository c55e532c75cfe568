import hashlib
import random

import numpy as np
import pytest

from tidegraph.llm import suffixes

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA)


def plain(rows):
    """(n_bytes, n_removed, n_spans, sha of the rest) of each row, in order."""
    least = {}
    raws = [(i, (t or "").encode()) for i, t in rows]
    for i, b in raws:
        for k in range(len(b) - 49):
            w = b[k : k + 50]
            least[w] = min(least.get(w, i), i)
    out = []
    for i, b in raws:
        gone = bytearray(len(b))
        for k in range(len(b) - 49):
            if least[b[k : k + 50]] < i:
                gone[k : k + 50] = b"\1" * 50
        spans = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def answer(df):
    rows = df.selectExpr("doc_id", "n_bytes", "spans", "kept").collect()
    return sorted((r["doc_id"], r["n_bytes"], sum(s["end"] - s["start"] for s in r["spans"]), len(r["spans"]), hashlib.sha256(bytes(r["kept"])).hexdigest()) for r in rows)


def corpus(seed, n=120):
    rng = random.Random(seed)
    text = lambda m, letters="abcdefghijkl é": "".join(rng.choice(letters) for _ in range(m))
    base = [text(400) for _ in range(6)]
    passage = text(130)
    rows = []
    for k in range(n):
        t = list(rng.choice(base))
        for _ in range(rng.randrange(6)):
            t[rng.randrange(len(t))] = rng.choice("xyz\0")
        t = "".join(t)
        kind = rng.randrange(6)
        if kind == 0:
            t = text(rng.randrange(120)) + passage + text(rng.randrange(120))
        elif kind == 1:
            t = text(rng.randrange(90), "ab") * 3
        elif kind == 2:
            t = "line of text that is here again and again, it is. " * rng.randrange(5) + t[rng.randrange(300) :]
        rows.append((k * 3 - 20, t))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("parameters", [{}, {"hot": 3, "bucket_bytes": 2000, "together": 50}])
def test_against_brute_force(spark, parameters):
    rows = corpus(1) + [(1000, None), (1001, ""), (1002, "x" * 49), (1003, "x" * 50), (1004, "x" * 5000)]
    docs = docs_of(spark, rows).repartition(5)
    assert answer(suffixes.deduplicate(docs, **parameters)) == plain(rows)


def test_query_against_brute_force(spark, sf_dir):
    got = sorted(tuple(r) for r in suffixes.op8_suffix_levels(spark, sf_dir).collect())
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert got == plain(rows)


def test_edges(spark):
    t = "a passage of more than fifty bytes that several documents have in common, "
    rows = [(1, t), (1, t), (None, t), (None, t + "x"), (0, "other"), (2, t * 300)]
    got = suffixes.deduplicate(docs_of(spark, rows).selectExpr("*", "1 AS batch", "2 AS ids", "3 AS found")).collect()
    by = sorted((r["doc_id"] if r["doc_id"] is not None else 99, len(r["kept"])) for r in got)
    assert by == [(0, 5), (1, len(t)), (1, len(t)), (2, 0), (99, 0), (99, 1)]
    assert suffixes.deduplicate(docs_of(spark, [])).count() == 0


def test_equal_windows_have_equal_anchors():
    rng = random.Random(9)
    a = bytes(rng.randrange(97, 101) for _ in range(3000))
    b = bytes(rng.randrange(97, 101) for _ in range(70)) + a[500:1500] + b"q" * 200
    owner = []
    for buf in (a, b):
        own = {}
        for s, m, code, _ in zip(*suffixes.anchors(np.frombuffer(buf, np.uint8), np.array([len(buf)]), chunk=700)):
            own |= {k: code for k in range(s, s + m)}
        assert set(own) == set(range(len(buf) - 49))
        owner.append(own)
    assert all(owner[0][500 + k] == owner[1][70 + k] for k in range(951))


def test_levels_merge_geometrically():
    rng = np.random.default_rng(1)
    index, seen, sizes = suffixes.Levels(), {}, []
    for k in range(40):
        w = np.array([b"%050d" % x for x in rng.integers(0, 900, 60)], "S50")
        ids = np.sort(rng.integers(k * 5, k * 5 + 8, 60))
        hit = index.add(w, ids)
        for x, i in zip(w, ids.tolist()):
            seen[x] = min(seen.get(x, i), i)
        assert [bool(h) for h in hit] == [i > seen[x] for x, i in zip(w, ids.tolist())]
        sizes.append(len(index.levels))
    assert max(sizes) <= 8
