"""Whole sets of word shingles, which decide about the candidates of the SimHash trie (module simhash).

A text is the set of its shingles of five words (words as in simhash; the whole sequence where there are fewer), known
by 64-bit hashes. Two texts are linked where their sets' Jaccard similarity is 0.8 or more; texts without words are alike.

Candidates come from the trie walk over long SimHash fingerprints, as components of pairs. Inside a component every
pair is settled by the sets themselves, so no pair under 0.8 is linked and no pair of the component is passed over:
first all its texts meet the component's least text; what isn't near that one then meets all others, in cells of two
blocks of texts, so that a task never holds more than two blocks, whatever a component's size.

Scale: texts are known by their hash, so copies count once. A large group of near copies is settled by its first
meeting, one row a text; only its texts that aren't near the least one are repeated, once for each other block.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common, simhash
from .components import components
from .simhash import LOWER

#: Names of passing columns beside those of an input that is handed on.
ROW, STAY = "_near_row_", "_near_stay_"


class Words(dict):
    """XXH64 of the words met, of which it knows at most `most` at once."""

    def __init__(self, most: int = 200_000):
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word, 42)
        return h


WORDS = Words()
#: The place of a word in its shingle, by a factor for each.
PLACES = np.random.default_rng(7).integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: str, width: int = 5) -> np.ndarray:
    """The hashes of a text's different shingles, sorted: its words' XXH64, each times a factor of its place, summed and mixed."""
    words = text.encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(WORDS.__getitem__, words), np.uint64, len(words))
    width = min(width, len(words))
    total = np.full(len(words) - width + 1, width, np.uint64)
    for k in range(width):
        total += h[k : len(h) - width + 1 + k] * PLACES[k]
    total ^= total >> np.uint64(32)
    return np.unique(total * np.uint64(0xD6E8FEB86659FD93))


def linked(sets: list[np.ndarray], similarity: float) -> np.ndarray:
    """For each set the number of the first set that it reaches over pairs of at least this similarity."""
    sizes = np.array([len(s) for s in sets])
    tokens = np.unique(np.concatenate(sets), return_inverse=True)[1]
    own = np.split(tokens, np.cumsum(sizes)[:-1])
    roots = np.full(len(sets), -1)

    def postings(left):
        token, of = np.concatenate([own[k] for k in left]), np.repeat(left, sizes[left])
        order = np.argsort(token, kind="stable")
        starts = np.searchsorted(token[order], np.arange(tokens.max(initial=-1) + 2))
        return of[order], starts

    left = np.arange(len(sets))
    of, starts = postings(left)
    held = len(left)
    for first in range(len(sets)):
        if roots[first] >= 0:
            continue
        roots[first], waiting = first, [first]
        while waiting:
            k = waiting.pop()
            left = left[roots[left] < 0]
            if not len(left):
                break
            if 2 * len(left) < held:
                of, starts = postings(left)
                held = len(left)
            if sizes[k]:
                at, n = starts[own[k]], starts[own[k] + 1] - starts[own[k]]
                shared = np.bincount(of[np.repeat(at - np.cumsum(n) + n, n) + np.arange(n.sum())], minlength=len(sets))[left]
                near = left[shared / (sizes[k] + sizes[left] - shared) >= similarity]
            else:
                near = left[sizes[left] == 0]
            roots[near] = first
            waiting += near.tolist()
    return roots


def alike(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    if not len(a) or not len(b):
        return len(a) == len(b)
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared / (len(a) + len(b) - shared) >= similarity


def near_classes(docs: DataFrame, similarity: float = 0.8, width: int = 5, block: int = 2000) -> DataFrame:
    """text_key and class, the least key of all texts that links reach, of each text that has near-duplicates.

    docs has text_key, a hash of the text, and text. Pairs of under 0.8 aren't looked for: the walk's budgets are for 0.8.
    """
    docs = docs.select("text_key", F.col("text").cast("string").alias("text"))
    out = "id long, bits binary"
    prints = common.map_batches(docs, lambda: _of_new_texts(width, simhash.long_fingerprint, ["id", "bits"]), out)
    prints = common.written(prints.groupBy("id").agg(F.first("bits").alias("bits")), "near-prints")
    candidates = components(common.written(simhash.contracted(simhash.near_links(prints)), "near-links", gathered=True))
    wanted = docs.join(candidates, docs["text_key"] == candidates["node"]).select("text_key", "text", "root")
    sets = common.map_batches(wanted, lambda: _of_new_texts(width, lambda hashes: hashes.tobytes(), ["text_key", "hashes"], "root"), "text_key long, hashes binary, root long")
    sets = common.written(sets, "near-sets")
    return settled(sets, similarity, block)


def _of_new_texts(width: int, make, names: list[str], *more: str):
    """A batch function: a row of key and make(shingles) for every key that the task hasn't met, with more columns."""
    seen: set[int] = set()

    def f(batch):
        rows, at = [], []
        for k, (key, text) in enumerate(zip(batch.column("text_key").to_pylist(), common.texts_of(batch, "text"))):
            if key not in seen:
                seen.add(key)
                rows.append((key, make(shingles(text, width))))
                at.append(k)
        own = [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())]
        return pa.RecordBatch.from_arrays([*own, *(batch.column(c).take(pa.array(at, pa.int64())) for c in more)], [*names, *more])

    return f


def settled(sets: DataFrame, similarity: float = 0.8, block: int = 2000) -> DataFrame:
    """text_key and class of the texts of sets (text_key, hashes, root: a component of candidates) that have near-duplicates."""

    def meet():
        def f(batch):
            pairs = zip(batch.column("hashes").to_pylist(), batch.column("least").to_pylist())
            near = [alike(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64), similarity) for a, b in pairs]
            return pa.RecordBatch.from_arrays([batch.column("text_key"), batch.column("root"), pa.array(near, pa.bool_())], ["text_key", "root", "near"])

        return f

    def settle(table):
        keys, at = np.unique(table.column("text_key").to_numpy(), return_index=True)
        hashes = table.column("hashes")
        roots = linked([np.frombuffer(hashes[int(k)].as_py(), np.uint64) for k in at], similarity)
        tied = roots != np.arange(len(keys))
        return pa.table({"src": keys[tied], "dst": keys[roots[tied]]})

    least = sets.where("text_key = root").groupBy("root").agg(F.first("hashes").alias("least"))
    least = common.written(least, "near-least")  # so both sides of the join are plain shuffles, of which skewed ones are split
    met = common.map_batches(sets.join(least, "root").select("text_key", "root", "hashes", "least"), meet, "text_key long, root long, near boolean")
    met = common.written(met.groupBy("root", "text_key").agg(F.first("near").alias("near")), "near-met")
    sizes = met.groupBy("root").agg(F.count_if("near").alias("n_near"), F.count_if(~F.col("near")).alias("n_far"))
    open_ = sizes.where("n_far > 0").withColumnRenamed("root", "open_root")
    members = met.join(open_, F.col("root") == F.col("open_root"))
    blocks = lambda n: F.greatest(F.lit(1), F.ceil(F.col(n) / F.lit(block)))
    at = F.when(F.col("near"), F.pmod(F.xxhash64("text_key"), blocks("n_near"))).otherwise(F.pmod(F.xxhash64("text_key"), blocks("n_far")))
    far_blocks, near_blocks = F.sequence(F.lit(0).cast("long"), blocks("n_far") - 1), F.sequence(F.lit(0).cast("long"), blocks("n_near") - 1)
    cell = lambda a, kind, b: F.struct(a.alias("a"), F.lit(kind).alias("kind"), b.alias("b"))
    together = F.array(cell(F.lit(0).cast("long"), "all", F.lit(0).cast("long")))
    of_near = F.transform(far_blocks, lambda i: cell(i, "near", F.col("at")))
    of_far = F.concat(
        F.transform(near_blocks, lambda j: cell(F.col("at"), "near", j)),
        F.transform(far_blocks, lambda i: cell(F.least(i, F.col("at")), "far", F.greatest(i, F.col("at")))),
    )
    cells = F.when(F.col("n_near") + F.col("n_far") <= block, together).when(F.col("near"), of_near).otherwise(of_far)
    dealt = members.withColumn("at", at).select("text_key", F.col("root").alias("of"), F.explode(cells).alias("cell"))
    with_sets = sets.join(dealt, (sets["text_key"] == dealt["text_key"]) & (sets["root"] == dealt["of"])).select(sets["text_key"], "hashes", "root", "cell")
    found = with_sets.groupBy("root", "cell").applyInArrow(settle, "src long, dst long")
    first = members.where("near AND text_key <> root").select(F.col("root").alias("src"), F.col("text_key").alias("dst"))
    rest = components(common.written(found.union(first), "near-ties", gathered=True)).select(F.col("node").alias("text_key"), F.col("root").alias("class"))
    whole = sizes.where("n_far = 0").select(F.col("root").alias("whole_root"))
    plain = met.join(whole, F.col("root") == F.col("whole_root")).select("text_key", F.col("root").alias("class"))
    return plain.union(rest)


def keep_one(docs: DataFrame, similarity: float = 0.8, width: int = 5) -> DataFrame:
    """The rows of docs, with all their columns, that stay: of each class of near-duplicates the row of the smallest id.

    Rows without an id come last; rows of one id are ordered by a hash of their text, then of all their columns.
    """
    columns = docs.columns
    own = docs.withColumn(ROW, F.struct(F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("text_key"), F.col("doc_id").alias("id")))
    keyed = own.select(F.col(f"{ROW}.text_key").alias("text_key"), F.col(f"{ROW}.id").alias("row_id"), F.col("text").alias("text"))
    classes = near_classes(keyed, similarity, width)
    rows = keyed.groupBy("text_key", "row_id").agg(F.count("*").alias("n"))
    rows = rows.join(classes, "text_key", "left").withColumn("class", F.coalesce("class", "text_key"))
    first = F.min(F.struct(F.col("row_id").isNull().alias("late"), "row_id", "text_key", "n")).alias("r")
    stay = rows.groupBy("class").agg(first).select(F.struct("r.text_key", "r.row_id", "r.n").alias(STAY))
    stay = common.written(stay, "shingle-stay")
    named = own.join(stay, (F.col(f"{ROW}.text_key") == F.col(f"{STAY}.text_key")) & F.col(f"{ROW}.id").eqNullSafe(F.col(f"{STAY}.row_id")))
    once = W.partitionBy(F.col(f"{STAY}.text_key"), F.col(f"{STAY}.row_id")).orderBy(F.xxhash64(*columns))
    repeated = named.where(f"{STAY}.n > 1").withColumn(ROW, F.row_number().over(once)).where(f"{ROW} = 1")
    return named.where(f"{STAY}.n = 1").select(columns).unionByName(repeated.select(columns))
