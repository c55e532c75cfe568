"""SimHash near-duplicates: fingerprints of word shingles, joined by walking a binary trie against itself.

Fingerprints: words are what stands between white space after lower-casing A-Z; every shingle (the whole sequence where
there are fewer words) is hashed by XXH64 with seed 42, and a bit is set if it is set in over half of the hashes. Two
uses have their own lengths and budgets of differing bits:

- `near_duplicates`: 64 bits of three-word shingles, repeats included; pairs within `distance` bits are linked, exactly.
  No word: fingerprint zero, which links like any other. Two fingerprints within the distance agree on one of
  distance + 1 bands of bits, so each band turns the fingerprints so that its bits come first and deals them by these.
- `near_classes`: LONG bits of five-word shingles (each once), for texts whose shingle sets have a Jaccard similarity
  of 0.8 or more. A bit of such a pair differs with a chance of at most 0.19, so the budget grows with the depth
  (`budget_by_depth`), and the walk is made for TABLES turns of the fingerprint, each dealt by its first EXACT bits.
  What the walk finds are candidates; whole shingle sets decide (module shingles).

Join: in a group the trie is walked as pairs of nodes, adding up differing bits and leaving a pair once there are more
than the budget allows, or once all that stands below both nodes is linked already. A group that holds more than
`large` fingerprints is cut into subtrees by its next bits, and pairs of subtrees whose prefixes already differ in too
many bits are never made. A task keeps a spanning forest of the links it finds: all components, fewer rows.

Defined results: a null text is an empty one; null ids are documents whose ids count for nothing in a component (it is
null if all are); repeated rows stay; an empty table gives no rows. Every row of the input gives one row.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common
from .components import components

SPACE = re.compile(rb"[\x20\x09-\x0D]+")
LOWER = bytes(range(256)).lower()
#: Names of passing columns beside those of an input that is handed on.
KEPT, ORDER = "_simhash_kept_", "_simhash_order_"


def fingerprint(text: str, width: int = 3, seed: int = 42) -> int:
    """The unsigned fingerprint of one text."""
    words = SPACE.sub(b" ", text.encode("utf-8", "surrogatepass").translate(LOWER)).strip(b" ")
    if not words:
        return 0
    ends = np.flatnonzero(np.frombuffer(words, np.uint8) == 32)
    n = len(ends) + 1
    starts = [0, *(ends + 1).tolist()]
    stops = [*ends.tolist(), len(words)]
    digest = xxhash.xxh64_intdigest
    if n <= width:
        return digest(words, seed)
    hashes = np.array([digest(words[a:b], seed) for a, b in zip(starts, stops[width - 1 :])], np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 4096):
        ones += np.unpackbits(hashes[at : at + 4096].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long."""

    def make():
        def f(batch):
            seen: dict[str, int] = {}
            out = []
            for text in common.texts_of(batch, "text"):
                fp = seen.get(text)
                if fp is None:
                    fp = seen[text] = fingerprint(text)
                out.append(fp)
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.array(out, np.uint64).view(np.int64), pa.int64())], ["doc_id", "fp"])

        return f

    return common.map_batches(common.id_and_text(docs, id_column, text_column), make, "doc_id long, fp long")


def trie_links(left: np.ndarray, right: np.ndarray | None, distance: int, exact: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of two sorted arrays of unsigned fingerprints, or of one and itself, at distance bits or fewer; the first `exact` bits have to agree."""
    budget = np.where(np.arange(64) < exact, 0, distance)
    return walk(left[:, None], None if right is None else right[:, None], budget, distance)


def walk(left: np.ndarray, right: np.ndarray | None, budget: np.ndarray, total: int, forest: Forest | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of rows of left and right (of left and itself where right is None) that differ in at most `total` bits.

    A row is a fingerprint as 64-bit words; rows are sorted by the first, whose bits are the trie's levels: the first d
    bits of a pair may differ in budget[d - 1] of them. The pairs of trie nodes of one depth are held as ranges of the
    rows; one step goes a bit down in all of them at once. Pairs of few leaves leave the walk and are settled by all
    their bits. With a forest over the rows of left, then right, which the caller keeps up to date with what is found,
    pairs of nodes whose rows are all linked already are left too.
    """
    same = right is None
    right = left if same else right
    a = np.array([[0, len(left), 0, len(right), 0]], np.int64)  # from, to, from, to, differing bits so far
    for depth in range(64):
        alone = same & (a[:, 0] == a[:, 2]) & (a[:, 1] - a[:, 0] == 1)
        a = a[(a[:, 1] > a[:, 0]) & (a[:, 3] > a[:, 2]) & ~alone]
        a = _apart(a, forest, len(left), same)
        if not len(a):
            return
        small = (a[:, 1] - a[:, 0]) * (a[:, 3] - a[:, 2]) <= 16
        yield from _settle(left, right, a[small], same, total)
        a = a[~small]
        if not len(a):
            return
        bit = np.uint64(1) << np.uint64(63 - depth)
        cut_l, cut_r = _cut(left[:, 0], a[:, 0], a[:, 1], bit), _cut(right[:, 0], a[:, 2], a[:, 3], bit)
        lows_l, lows_r = np.stack([a[:, 0], cut_l], 1), np.stack([a[:, 2], cut_r], 1)
        highs_l, highs_r = np.stack([cut_l, a[:, 1]], 1), np.stack([cut_r, a[:, 3]], 1)
        mirrored = same & (a[:, 0] == a[:, 2]) & (a[:, 1] == a[:, 3])
        within = a[:, 4] < budget[depth]
        parts = [
            np.concatenate([lows_l, lows_r, a[:, 4:]], 1),
            np.concatenate([highs_l, highs_r, a[:, 4:]], 1),
            np.concatenate([lows_l, highs_r, a[:, 4:] + 1], 1)[within],
            np.concatenate([highs_l, lows_r, a[:, 4:] + 1], 1)[within & ~mirrored],
        ]
        a = np.concatenate(parts)
    a = a[(a[:, 1] > a[:, 0]) & (a[:, 3] > a[:, 2])]
    yield from _settle(left, right, _apart(a, forest, len(left), same), same, total)


def _apart(a: np.ndarray, forest: Forest | None, n: int, same: bool) -> np.ndarray:
    """Without the pairs of nodes that the forest holds in one tree."""
    if forest is None or not len(a):
        return a
    roots = forest.roots(np.arange(len(forest.up)))
    changes = np.concatenate([[0], np.cumsum(roots[1:] != roots[:-1])])
    at = 0 if same else n
    one = (changes[a[:, 0]] == changes[a[:, 1] - 1]) & (changes[a[:, 2] + at] == changes[a[:, 3] - 1 + at])
    return a[~(one & (roots[a[:, 0]] == roots[a[:, 2] + at]))]


def _cut(values: np.ndarray, lo: np.ndarray, hi: np.ndarray, bit: np.uint64) -> np.ndarray:
    """For each range the first index at which the bit is set."""
    keys = (values[np.minimum(lo, len(values) - 1)] & ~(bit | (bit - np.uint64(1)))) | bit
    return np.clip(np.searchsorted(values, keys), lo, hi)


def _settle(left, right, a, same, total) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    cells = np.cumsum((a[:, 1] - a[:, 0]) * (a[:, 3] - a[:, 2]))
    for p in np.split(a, np.searchsorted(cells, np.arange(1 << 20, cells[-1] if len(cells) else 0, 1 << 20))):
        n_r = p[:, 3] - p[:, 2]
        n = (p[:, 1] - p[:, 0]) * n_r
        of = np.repeat(np.arange(len(p)), n)
        k = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
        i, j = p[of, 0] + k // n_r[of], p[of, 2] + k % n_r[of]
        if same:
            i, j = i[i < j], j[i < j]
        differ = np.bitwise_count(left[i, 0] ^ right[j, 0]).astype(np.int16)
        for word in range(1, left.shape[1]):
            keep = differ <= total
            i, j, differ = i[keep], j[keep], differ[keep]
            differ += np.bitwise_count(left[i, word] ^ right[j, word])
        keep = differ <= total
        if keep.any():
            yield i[keep], j[keep]


def trees(left: np.ndarray, right: np.ndarray | None, budget: np.ndarray, total: int) -> Forest:
    """A forest over the rows of left, then right, of all that walk() links. Neighbours in the sorted order come first:
    they tie large groups of near copies together, so that the walk needn't go down in them."""
    rows = left if right is None else np.concatenate([left, right])
    forest, order = Forest(len(rows)), np.argsort(rows[:, 0], kind="stable")
    for gap in (1, 2, 3):
        i, j = order[:-gap], order[gap:]
        near = np.bitwise_count(rows[i] ^ rows[j]).sum(axis=1, dtype=np.int64) <= total
        forest.link(i[near], j[near])
    if right is None or len(left) and len(right):
        for i, j in walk(left, right, budget, total, forest):
            forest.link(i, j if right is None else j + len(left))
    return forest


class Forest:
    """Union-find over indices; the root of a tree is its smallest index."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def link(self, i: np.ndarray, j: np.ndarray) -> None:
        up = self.up
        while len(i):
            a, b = self.roots(i), self.roots(j)
            hi, lo = np.maximum(a, b), np.minimum(a, b)
            rest = hi != lo
            i, j, hi, lo = i[rest], j[rest], hi[rest], lo[rest]
            np.minimum.at(up, hi, lo)

    def roots(self, i: np.ndarray) -> np.ndarray:
        up = self.up
        r = up[i]
        while True:
            s = up[r]
            if (s == r).all():
                up[i] = r
                return r
            r = s


def _bands(distance: int) -> list[tuple[int, int]]:
    edges = [round(64 * k / (distance + 1)) for k in range(distance + 2)]
    return list(zip(edges[:-1], edges[1:]))


def links(distinct: DataFrame, distance: int = 2, large: int = 50_000, together: int = 20_000) -> DataFrame:
    """src and dst: a spanning forest, task by task, of the pairs of fingerprints (column fp) within distance bits."""
    bands = _bands(distance)
    turned = F.explode(F.array(*[F.struct(F.lit(k).alias("band"), _turned(lo).alias("w0"), F.shiftrightunsigned(_turned(lo), 64 - hi + lo).alias("key")) for k, (lo, hi) in enumerate(bands)]))
    dealt = distinct.select(F.col("fp").alias("id"), turned.alias("g")).select("id", "g.*")
    budgets = [np.where(np.arange(64) < hi - lo, 0, distance) for lo, hi in bands]
    sizes = dealt.groupBy("band", "key").agg(F.count("*").alias("n"))
    return forests(dealt, sizes, distinct.count(), ["w0"], min(hi - lo for lo, hi in bands) + 1, budgets, distance, large, together)


def forests(dealt: DataFrame, sizes: DataFrame, n: int, words: list[str], behind: int, budgets: list[np.ndarray], total: int, large: int, together: int) -> DataFrame:
    """src and dst: a spanning forest, task by task, of the links between ids.

    dealt has a row for each of n ids and each band: band, key (the band's first bits, which have to agree), id, and the
    turned fingerprint's words; sizes has the count n of rows of each band and key. Groups of equal keys share a task until it holds about `together` rows; a group above
    `large` has a task for each pair of its subtrees, cut by bits that begin at `behind`.
    """
    buckets = max(1, n // together)
    dealt = dealt.join(sizes.where(F.col("n") > large), ["band", "key"], "left")
    bits = F.least(F.lit(12), F.ceil(F.log2(F.col("n") / F.lit(large))) + 1).cast("int")
    dealt = dealt.withColumn("bits", F.when(F.col("n").isNull(), 0).otherwise(bits))
    dealt = dealt.withColumn("low", F.shiftleft("w0", behind)).withColumn("node", F.expr("CASE WHEN bits = 0 THEN 0L ELSE shiftrightunsigned(low, 64 - bits) END"))
    most = max(int(b[behind + 11]) for b in budgets)
    masks = F.array(*[F.lit(m).cast("long") for m in range(1 << 12) if m.bit_count() <= most])
    others = F.transform(F.filter(masks, lambda m: m < F.expr("shiftleft(1L, bits)")), lambda m: F.col("node").bitwiseXOR(m))
    cells = dealt.withColumn("other", F.explode(F.when(F.col("bits") == 0, F.array(F.lit(0).cast("long"))).otherwise(others))).select(
        *words,
        "id",
        "band",
        F.when(F.col("bits") == 0, F.pmod(F.xxhash64("key"), F.lit(buckets)) - buckets).otherwise(F.col("key")).alias("cell"),
        F.least("node", "other").alias("p"),
        F.greatest("node", "other").alias("q"),
        (F.col("node") > F.col("other")).alias("second"),
    )

    def joined(key, table):
        band, _, p, q = (x.as_py() for x in key)
        rows = np.stack([table.column(w).to_numpy().view(np.uint64) for w in words], axis=1)
        order = np.argsort(rows[:, 0], kind="stable")
        second = table.column("second").to_numpy()[order]
        rows, ids = rows[order], table.column("id").to_numpy()[order]
        if p == q:
            forest = trees(rows, None, budgets[band], total)
        else:
            ids = np.concatenate([ids[~second], ids[second]])
            forest = trees(rows[~second], rows[second], budgets[band], total)
        roots = forest.roots(np.arange(len(ids)))
        least = ids.copy()  # a tree is told as its ids tied to the least of them, so other tasks tell of it alike
        np.minimum.at(least, roots, ids)
        tied = ids != least[roots]
        return pa.table({"src": ids[tied], "dst": least[roots[tied]]})

    return cells.groupBy("band", "cell", "p", "q").applyInArrow(joined, "src long, dst long")


def contracted(links: DataFrame) -> DataFrame:
    """Links of the same components with about one for each src: it is tied to the least dst it has, as are its other dsts.

    A src has a dst for each task that tells of it at most, so no array grows with the data.
    """
    of = links.groupBy("src").agg(F.collect_set("dst").alias("dsts")).withColumn("least", F.array_min("dsts"))
    others = F.transform(F.filter("dsts", lambda d: d > F.col("least")), lambda d: F.struct(d.alias("src"), F.col("least").alias("dst")))
    ties = F.explode(F.concat(F.array(F.struct("src", F.col("least").alias("dst"))), others))
    return of.select(ties.alias("tie")).select("tie.src", "tie.dst").distinct()


def _turned(lo: int):
    """fp turned left by lo bits."""
    return F.shiftleft("fp", lo).bitwiseOR(F.shiftrightunsigned("fp", 64 - lo)) if lo else F.col("fp")


def near_duplicates(docs: DataFrame, distance: int = 2, **columns) -> DataFrame:
    """doc_id, fp and component_id, the smallest id among all that links reach, for every row of docs.

    Fingerprints of over a thousandth of all rows (so a thousand of them at most) are told to the rows by a broadcast,
    so that no task gets all rows of one; the others by a join.
    """
    prints = common.written(fingerprints(docs, **columns), "simhash-prints")
    distinct = common.written(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "simhash-distinct")
    classes = components(common.written(links(distinct, distance), "simhash-links", gathered=True))
    inside = distinct.join(classes, distinct["fp"] == classes["node"]).select("fp", "root", "least")
    smallest = inside.groupBy("root").agg(F.min("least").alias("component_id"))
    named = inside.join(smallest, "root").select("fp", "component_id")
    of = distinct.join(named, "fp", "left").select("fp", "n", F.coalesce("component_id", "least").alias("component_id"))
    of = common.written(of, "simhash-classes")
    often = of.where(F.col("n") > prints.count() // 1000 + 1).select(F.col("fp").alias("often"), F.col("component_id").alias("known"))
    told = prints.join(F.broadcast(often), F.col("fp") == F.col("often"), "left")
    rest = told.where("often IS NULL").select("doc_id", "fp").join(of.select("fp", "component_id"), "fp")
    return told.where("often IS NOT NULL").select("doc_id", "fp", F.col("known").alias("component_id")).union(rest.select("doc_id", "fp", "component_id"))


def keep_one(docs: DataFrame, distance: int = 2) -> DataFrame:
    """The rows of docs, with all their columns, that stay: of each component the document of the smallest id.

    Rows without an id can't be named, so they stay; of rows that repeat an id the one of the smallest hash stays.
    """
    kept = near_duplicates(docs, distance).where("doc_id = component_id").select(F.struct(F.col("doc_id").alias("id")).alias(KEPT)).distinct()
    named = docs.where("doc_id IS NOT NULL").join(kept, F.col("doc_id").cast("long") == F.col(f"{KEPT}.id"))
    first = W.partitionBy(F.col(f"{KEPT}.id")).orderBy(F.xxhash64("text"))
    named = named.withColumn(ORDER, F.row_number().over(first)).where(f"{ORDER} = 1").select(docs.columns)
    return named.unionByName(docs.where("doc_id IS NULL"))


#: The long fingerprints of near_classes: bits, how far a turn goes, how many turns, first bits that have to agree.
LONG, STRIDE, TABLES, EXACT = 1024, 21, 48, 8
#: Of a turned fingerprint the words that a pair is settled by, and in how many of their bits it may differ. The bits of
#: a pair at 0.8 differ with a chance of 0.15: 29 of 192, with a deviation of 5.
WORDS, MOST = 3, 46


def budget_by_depth() -> np.ndarray:
    """None of the first EXACT bits may differ, two up to 12 bits on, and one more for each 6 bits after these."""
    below = np.arange(1, 65) - EXACT
    return np.where(below <= 0, 0, 2 + np.maximum(0, -(-(below - 12) // 6)))


def long_fingerprint(hashes: np.ndarray) -> bytes:
    """A bit is set if it is set in over half of the hashes; each hash gives LONG bits by one mixing for each word."""
    ones = np.zeros(LONG, np.int64)
    for at in range(0, len(hashes), 255):  # as many as a byte can count
        x = hashes[at : at + 255, None] * _FACTORS
        x ^= x >> np.uint64(31)
        x *= np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
        ones += np.unpackbits(x.view(np.uint8), axis=1).sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * ones > len(hashes)).tobytes()


_FACTORS = np.random.default_rng(42).integers(0, 1 << 63, LONG // 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def turned(bits: list[bytes]) -> Iterator[np.ndarray]:
    """For each of TABLES bands the words of the turned fingerprints."""
    flat = np.unpackbits(np.frombuffer(b"".join(bits), np.uint8).reshape(-1, LONG // 8), axis=1)
    flat = np.concatenate([flat, flat[:, : 64 * WORDS]], axis=1)
    for band in range(TABLES):
        yield np.packbits(flat[:, STRIDE * band : STRIDE * band + 64 * WORDS], axis=1).view(">u8").astype(np.uint64)


def near_links(prints: DataFrame, large: int = 50_000, together: int = 50_000) -> DataFrame:
    """src and dst: a spanning forest, task by task, of the ids of prints (id, bits) that may be near-duplicates."""
    names = [f"w{k}" for k in range(WORDS)]

    def deal():
        def f(batch):
            for band, words in enumerate(turned(batch.column("bits").to_pylist())):
                key = pa.array((words[:, 0] >> np.uint64(64 - EXACT)).astype(np.int64))
                own = [pa.array(np.full(len(words), band, np.int32)), key, batch.column("id"), *(pa.array(words[:, k].view(np.int64)) for k in range(WORDS))]
                yield pa.RecordBatch.from_arrays(own, ["band", "key", "id", *names])

        return f

    def count():
        def f(batch):
            counts = np.stack([np.bincount((words[:, 0] >> np.uint64(64 - EXACT)).astype(np.int64), minlength=1 << EXACT) for words in turned(batch.column("bits").to_pylist())])
            band, key = np.nonzero(counts)
            return pa.RecordBatch.from_arrays([pa.array(band.astype(np.int32)), pa.array(key), pa.array(counts[band, key])], ["band", "key", "n"])

        return f

    dealt = common.map_batches(prints, deal, "band int, key long, id long, " + ", ".join(f"{w} long" for w in names))
    sizes = common.map_batches(prints, count, "band int, key long, n long").groupBy("band", "key").agg(F.sum("n").alias("n"))
    return forests(dealt, sizes, prints.count(), names, EXACT, [budget_by_depth()] * TABLES, MOST, large, together)


def op2_simhash_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(common.read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
