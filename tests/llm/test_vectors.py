"""Vector codes against plain Lloyd rounds in Python's integers."""

import math

import duckdb
import numpy as np
import pytest

from tidegraph.llm import common, vectors


def plain(rows, parts, entries, rounds):
    kept = [(i, lab, [max(-(1 << 63), min((1 << 63) - 1, math.floor(4096 * x))) for x in v]) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = max(1, -(-max((len(v) for *_, v in kept), default=0) // parts))
    kept = [(i, lab, v + [0] * (parts * width - len(v)), v) for i, lab, v in kept]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[3]))[:entries]
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [[cut(r[2], p) for r in first] for p in range(parts)]

    def nearest(p, v):
        apart = [sum((a - b) ** 2 for a, b in zip(cut(v, p), c)) for c in books[p]]
        return min(range(len(apart)), key=lambda k: (apart[k], k)), min(apart)

    for _ in range(rounds):
        for p in range(parts):
            taken = [[] for _ in books[p]]
            for r in kept:
                taken[nearest(p, r[2])[0]].append(cut(r[2], p))
            books[p] = [[sum(c) // len(t) for c in zip(*t)] if t else old for t, old in zip(taken, books[p])]
    out = []
    for i, lab, v, _ in kept:
        near = [nearest(p, v) for p in range(parts)]
        error = sum(d for _, d in near)
        out.append((i, lab, "".join(f"{k:02x}" for k, _ in near), error if error < 1 << 63 else None))
    return out, books


@pytest.mark.parametrize("seed,size,dims", [(1, 300, 16), (2, 700, 24), (3, 5, 16), (4, 64, 5)])
def test_against_plain_rounds(spark, seed, size, dims):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 0.2, (6, dims))
    rows = [(k, np.round((centres[k % 6] + rng.normal(0, 0.05, dims)) * 64).tolist(), k % 3 if k % 7 else None) for k in rng.permutation(size).tolist()]
    rows = [(i, [x / 64 for x in v], lab) for i, v, lab in rows]  # on a coarse grid, so that distances tie
    rows += [(0, None, 1), (1, rows[0][1][:-1] + [None], 1), (2, [math.nan] * dims, 1), (3, [math.inf] + [0.0] * (dims - 1), 2), (None, rows[1][1], 4), (7, rows[2][1], 4), (size, rows[3][1][: dims - 3], 4), (size + 1, [], 4)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, label int, v string").repartition(3)
    codes, books = vectors.compressed(df)
    want, want_books = plain(rows, 8, 16, 6)
    key = lambda r: tuple((x is None, x or 0) if not isinstance(x, str) else x for x in r)
    assert sorted((tuple(r) for r in codes.collect()), key=key) == sorted(want, key=key)
    assert books.tolist() == want_books
    sums = {}
    for _, lab, _, e in want:
        sums[lab] = sums.get(lab, 0) + e
    assert {(r.label, r.label_error) for r in vectors.with_label_errors(codes).collect()} == set(sums.items())


def test_huge_components(spark):
    rows = [(k, [float((-1) ** k * 10.0 ** (2 * k)), 1.0 * k, 3e300, -5e18], k % 2) for k in range(40)]
    codes, books = vectors.compressed(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), parts=2, entries=4, rounds=3)
    want, want_books = plain([(i, v, lab) for i, v, lab in rows], 2, 4, 3)
    assert sorted(map(tuple, codes.collect())) == sorted(want, key=lambda r: r[0]) and books.tolist() == want_books
    errors = {r.label_error for r in vectors.with_label_errors(codes).collect()}
    assert errors == {None} or any(e is not None for _, _, _, e in want)


def test_boxes_never_drop_the_nearest():
    rng = np.random.default_rng(4)
    for _ in range(60):
        d, k, n = rng.integers(1, 5), rng.integers(1, 9), rng.integers(1, 300)
        points, entries = rng.integers(-6, 7, (n, d)), rng.integers(-6, 7, (k, d))
        tree, owner = vectors.Tree.of(points), np.full(n, -1)
        sums, counts = tree.assigned(entries, owner)
        apart = ((points[:, None] - entries[None]) ** 2).sum(axis=2)
        want = apart.argmin(axis=1)
        assert (owner == want[tree.rows]).all()
        assert (counts == np.bincount(want, minlength=k)).all()
        assert all((sums[e] == points[want == e].sum(axis=0)).all() for e in range(k))


def test_empty(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    codes, _ = vectors.compressed(df)
    assert vectors.with_label_errors(codes).collect() == []


def test_query_against_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf_dir}/embeddings.parquet'")
    assert sorted(map(tuple, vectors.op11_vector_codes(spark, sf_dir).collect())) == sorted(con.execute(vectors.OP11_SQL).fetchall())
    assert common.read(spark, sf_dir, "embeddings").count() > 0
