import random
import re

import numpy as np

import corpus_pipeline
from tests.llm.test_mixing_simhash import docs_of
from tidegraph.llm import common, shingles


def plain_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return frozenset(" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def plain_roots(sets, similarity=0.8):
    up = list(range(len(sets)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, x in enumerate(sets):
        for b, y in enumerate(sets[:a]):
            if x == y or len(x & y) / max(1, len(x | y)) >= similarity:
                i, j = root(a), root(b)
                up[max(i, j)] = min(i, j)
    return [root(k) for k in range(len(sets))]


def test_dedup_stage_against_all_pairs(spark, sf_dir):
    docs = common.read(spark, sf_dir, "documents")
    rows = sorted((r["doc_id"], r["text"]) for r in docs.collect())
    roots = plain_roots([plain_set(t) for _, t in rows])
    kept = corpus_pipeline.dedup_stage(spark, docs, sf_dir)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [rows[k][0] for k, r in enumerate(roots) if r == k]


def test_a_reworded_document_goes(spark):
    rng = random.Random(2)
    words = [f"w{rng.randrange(10**6)}" for _ in range(400)]
    near, far = list(words), list(words)
    for k in range(10, 400, 100):
        near[k] = "other"
    for k in range(10, 400, 30):
        far[k] = "other"
    one, two, three = (plain_set(" ".join(w)) for w in (words, near, far))
    assert len(one & two) / len(one | two) >= 0.8 > len(one & three) / len(one | three)
    rows = [(3, " ".join(words), "a"), (2, " ".join(near), "a"), (1, " ".join(far), "a")]
    assert sorted(r["doc_id"] for r in shingles.keep_one(docs_of(spark, rows)).collect()) == [1, 2]


def test_linked_against_all_pairs():
    rng = np.random.default_rng(4)
    for _ in range(20):
        sets = [np.unique(rng.integers(0, 30, n)).astype(np.uint64) for n in rng.integers(0, 25, 60)]
        for similarity in (0.5, 0.8, 1.0):
            plain = [frozenset(s.tolist()) for s in sets]
            assert shingles.linked(sets, similarity).tolist() == plain_roots(plain, similarity)


def test_edges(spark):
    assert shingles.keep_one(docs_of(spark, [])).count() == 0
    long = "word and other " * 5000
    rows = [(1, None, "a"), (2, " ", "a"), (5, long, None), (4, long.upper(), "b"), (4, long.upper(), "b"), (None, "quite another text here", "b"), (7, "é", "a")]
    clash = docs_of(spark, rows).selectExpr("*", "1 AS root", "2 AS node", "3 AS class", "4 AS band")
    assert sorted(r["doc_id"] or -1 for r in shingles.keep_one(clash).collect()) == [-1, 1, 4, 7]


def test_the_row_that_stays_is_chosen_by_class(spark):
    rows = [
        (1, "one clean text of its own", "a"), (1, "quite another text with that id", "a"), (1, "quite another text with that id", "b"),
        (None, "a copy without an id", "a"), (None, "a copy without an id", "b"), (5, "a copy without an id", "c"),
        (None, "copies that have no id", "a"), (None, "copies that have no id", "a"), (0, "quite another text with that id", "a"),
    ]
    got = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["text"]) for r in shingles.keep_one(docs_of(spark, rows)).collect())
    assert got == [(-1, "copies that have no id"), (0, "quite another text with that id"), (1, "one clean text of its own"), (5, "a copy without an id")]
