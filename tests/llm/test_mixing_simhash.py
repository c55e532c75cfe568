import random

import duckdb
import numpy as np
import pytest
import xxhash

from tidegraph.llm import components, mixing, simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], SCHEMA)


def plain_fingerprint(text):
    import re

    t = (text or "").translate({c: c + 32 for c in range(65, 91)})
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def plain_components(prints, distance=2):
    rows = list(prints)
    up = {i: i for i, _ in rows}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, (i, p) in enumerate(rows):
        for j, q in rows[a + 1 :]:
            if (p ^ q).bit_count() <= distance:
                x, y = root(i), root(j)
                up[max(x, y)] = min(x, y)
    return {i: root(i) for i, _ in rows}


def test_fingerprint_by_the_definition():
    rng = random.Random(1)
    texts = ["", " \t", "One", "a B", "a b c", "É x\x1fy Z  a\n\nb c d"] + [" ".join(rng.choice(["The", "cat", "ü", "dog\t", "x."]) for _ in range(rng.randrange(1, 60))) for _ in range(60)]
    for t in texts:
        assert simhash.fingerprint(t) == plain_fingerprint(t)


@pytest.mark.parametrize("distance", [0, 1, 2, 3])
def test_trie_walk_against_all_pairs(distance):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    x = np.unique(np.concatenate([base] + [base ^ (np.uint64(1) << rng.integers(0, 64, 60, dtype=np.uint64)) for _ in range(6)]))
    found = {(x[a], x[b]) for i, j in simhash.trie_links(x, None, distance) for a, b in zip(i, j)}
    assert found == {(a, b) for k, a in enumerate(x) for b in x[k + 1 :] if int(a ^ b).bit_count() <= distance}
    y = np.unique(base ^ np.uint64(5))
    found = {(x[a], y[b]) for i, j in simhash.trie_links(x, y, distance) for a, b in zip(i, j)}
    assert found == {(a, b) for a in x for b in y if int(a ^ b).bit_count() <= distance}


@pytest.mark.parametrize("large", [50_000, 4])
def test_links_give_all_components(spark, large):
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(8)]
    values = {b ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(4))) for b in base for _ in range(12)} | {0, 1, 2, (1 << 64) - 1}
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    found = simhash.links(spark.createDataFrame([(v,) for v in signed], "fp long"), 2, large, 30)
    roots = {r["node"]: r["root"] for r in components.components(found).collect()}
    plain = plain_components([(v, v & ((1 << 64) - 1)) for v in signed])
    classes = lambda of: {frozenset(w for w in signed if of(w) == of(v)) for v in signed}
    assert classes(lambda v: roots.get(v, v)) == classes(plain.get)


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 60)] + [(100, 101)], "src long, dst long")
    got = {r["node"]: r["root"] for r in components.components(edges).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100}


def test_simhash_query_against_brute_force(spark, sf_dir):
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.op2_simhash_trie(spark, sf_dir).collect()}
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    prints = [(r["doc_id"], plain_fingerprint(r["text"])) for r in rows]
    plain = plain_components(sorted(prints))
    assert got == {i: (f"{p:016x}", plain[i]) for i, p in prints}


def test_simhash_edges(spark):
    long = "word and other " * 5000
    rows = [(1, None, "a"), (2, "", "a"), (5, long, None), (4, long, "b"), (4, long, "b"), (None, "quite another text here", "b"), (7, "One two three four", "a")]
    got = sorted((r["doc_id"] or -1, r["component_id"] or -1) for r in simhash.near_duplicates(docs_of(spark, rows)).collect())
    assert got == [(-1, -1), (1, 1), (2, 1), (4, 4), (4, 4), (5, 4), (7, 7)]
    kept = simhash.keep_one(docs_of(spark, rows))
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert sorted(r["doc_id"] or -1 for r in kept.collect()) == [-1, 1, 4, 7]
    assert simhash.near_duplicates(docs_of(spark, [])).count() == 0
    clash = docs_of(spark, rows).selectExpr("*", "1 AS fp", "2 AS node", "3 AS component_id")
    assert simhash.near_duplicates(clash).count() == 7


def test_mix_against_sql(spark, sf_dir):
    got = mixing.op4_mix_sources(spark, sf_dir).toPandas().sort_values("doc_id").reset_index(drop=True)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS FROM '{sf_dir}/documents.parquet'")
    want = con.execute(mixing.OP4_SQL).df().sort_values("doc_id").reset_index(drop=True)
    assert list(got.columns) == list(want.columns)
    for c in got:
        assert np.allclose(got[c], want[c], rtol=1e-12), c
    by = got.merge(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source").toPandas()).groupby("source").agg(taken=("taken", "sum"), target=("target", "first"))
    assert (abs(by.taken - by.target) <= 0.01 * by.target + 8).all()


def test_mix_edges(spark):
    rows = [(1, None, "a"), (2, "", None), (3, "x " * 50_000, "b"), (4, "one two", "b"), (4, "one two", "b"), (None, "a b c", None), (6, "", "c"), (6, "", "c")]
    clash = docs_of(spark, rows).selectExpr("*", "1 AS size", "2 AS rank", "3 AS slot", "4 AS target")
    got = mixing.mix(clash).collect()
    assert len(got) == len(rows) and all(0 <= r["taken"] <= 2 * r["size"] for r in got)
    assert sum(r["taken"] for r in got) == pytest.approx(1.5 * sum(r["size"] for r in got), rel=0.01)
    assert mixing.mix(docs_of(spark, [])).count() == 0
    assert {r["source_size"] for r in got if r["size"] == 0} == {0, 3}
    mixed = mixing.apply_mix(docs_of(spark, rows))
    assert mixed.columns == ["doc_id", "text", "lang", "source", "n_chars"] and set(r["doc_id"] for r in mixed.collect()) <= {None, 3, 4}


def test_schedule_is_even_from_its_start(spark):
    rows = [(i, "w " * 40, s) for i in range(300) for s in ("a", "b", "c")]
    pieces, _ = mixing.schedule(docs_of(spark, rows), block=16)
    early = pieces.where("slot < 200").groupBy("source").sum("n_words").collect()
    by = {r[0]: r[1] for r in early}
    total = sum(by.values())
    assert abs(by["a"] / total - 4 / 9) < 0.03 and abs(by["b"] / total - 1.5 / 9) < 0.03  # a stops at twice its size
