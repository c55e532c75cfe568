"""Toxicity: a convolutional text classifier over hashed word embeddings, trained here in numpy.

A word's embedding is the sum of those of its buckets, of the whole word and of its first letters (STEMS), so that stems
are known under any ending. Filters of widths 1, 2 and 3 run over the words of the whole text and are pooled by their maximum;
a logistic unit reads the pooled values. A threshold is set for each language on rows kept back from training, drawn
towards that of all languages by as much as its toxic rows are few (n of them count n / (n + PRIOR)), and a score is the logistic of the distance to the threshold of the text's own language, so 0.5 is that threshold. The
language is found in the text by which languages' commonest words it has, never read from a column.

The model comes from all labelled rows but those with crc32(id) mod 5 = 0. They are dealt to shards of some SHARD rows by a hash of
their ids; a shard's task takes its rows one by one in a pass, and after each pass the shards' steps are averaged: an embedding's over
the shards that moved it, all else over all. So a pass takes a task as long whatever the input. Embeddings have the buckets
that one training row in a thousand has, and rarer ones whose rows are toxic much more or less often than others. It is some
MB whatever the input, and all rows are scored where they are read.

Defined results: a null text is an empty one; it has a score; null ids count as held out; rows that repeat stay; a
document that has several labels is toxic if one says so; with no labels every score is that of an unsure no; an empty
table gives no rows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

BUCKETS = 1 << 22
STEMS = (4, 6)
DIM = 8
FILTERS = 8
WIDTHS = (1, 2, 3)
COLUMNS = FILTERS * sum(WIDTHS)
#: Of embeddings at first; and the share of words that a training pass leaves out.
SPREAD, DROPPED = 0.02, 0.5
#: Toxic rows kept back at which a language's own threshold and that of all languages count alike.
PRIOR = 10
#: Labelled rows of a shard; every so-manieth of them sets thresholds only.
SHARD, KEPT_BACK = 4096, 4
#: Training rows that a bucket is in at least; one row in so many makes it common; deviations that mark a rarer one.
LEAST, COMMON_ONE, MARKED = 4, 1000, 4.0
#: Documents that training passes give about, in so many passes at least. Parts of a logit that held-out rows are counted by.
UPDATES, PASSES, CELLS = 20_000, 3, 1024
#: Commonest words of each language that a threshold is kept for; texts without any go to the first.
COMMON = {
    "en": frozenset(b"the of and to in is that for it with was on are be this".split()),
    "de": frozenset("der die und das den von zu mit sich des auf für ist im dem nicht".encode().split()),
    "fr": frozenset("le la les et des en du une que est pour qui dans au".encode().split()),
    "es": frozenset("el los las y por con una del se para al lo como su".encode().split()),
}
LANGUAGES = tuple(COMMON)

_KEPT = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or 48 <= c <= 57 or c >= 128 else 32 for c in range(256))


def words(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_KEPT).split()


def buckets(word: bytes) -> tuple[int, ...]:
    letters = word.decode("utf-8", "replace")
    return (zlib.crc32(word) % BUCKETS, *(zlib.crc32(b"%d" % n + letters[:n].encode()) % BUCKETS for n in STEMS))


def language(of: list[bytes]) -> int:
    met = set(of)
    counts = [len(known & met) for known in COMMON.values()]
    return counts.index(max(counts))


class Words(dict):
    """Numbers words as they come, with the rows of their buckets among the model's."""

    def __init__(self, row_of: dict[int, int]):
        self.row_of, self.rows = row_of, []  # type: dict[int, int], list[tuple[int, ...]]

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self.rows)
        self.rows.append(tuple(self.row_of.get(b, 0) for b in buckets(word)))
        return n


def pooled(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The filters' maxima over the words, and where they are. p: a row of partial sums for each word."""
    best, at, column = [], [], 0
    for width in WIDTHS:
        n = len(p)
        total = np.zeros((n + width - 1, FILTERS), np.float32)  # words beyond either end count as nothing
        for k in range(width):
            total[width - 1 - k : width - 1 - k + n] += p[:, column : column + FILTERS]
            column += FILTERS
        where = total.argmax(axis=0)
        best.append(total[where, np.arange(FILTERS)])
        at.append(where)
    return np.concatenate(best), np.concatenate(at)


#: Of every column of the filters: its filter's place among the maxima, and how far its word is from the maximum's.
_FILTER_OF = np.concatenate([n * FILTERS + np.arange(FILTERS) for n, width in enumerate(WIDTHS) for _ in range(width)])
_SHIFT = np.repeat([k - width + 1 for width in WIDTHS for k in range(width)], FILTERS)


class Model:
    """row_of: the model's row for a bucket (others have row 0, which is zero); e, w: embeddings and filters."""

    def __init__(self, row_of, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.row_of = row_of
        self.e = rng.normal(0, SPREAD, (len(row_of) + 1, DIM)).astype(np.float32)
        self.e[0] = 0
        self.w = rng.normal(0, 0.5, (DIM, COLUMNS)).astype(np.float32)
        self.v = np.abs(rng.normal(0, 0.5, FILTERS * len(WIDTHS))).astype(np.float32) * np.where(np.arange(FILTERS * len(WIDTHS)) % 4 == 3, -1, 1).astype(np.float32)
        self.b = -1.0
        self.limits, self.sums = np.zeros(len(LANGUAGES)), None

    def logit(self, features: np.ndarray) -> float:
        return float(np.maximum(features, 0) @ self.v + self.b)

    def parameters(self) -> list[np.ndarray]:
        """Embeddings and their sums of squared gradients, then filters, weights and offset with theirs."""
        if self.sums is None:
            self.sums = [np.full_like(self.e, 0.1), np.full_like(self.w, 0.1), np.full_like(self.v, 0.1), np.full(1, 0.1)]
        return [self.e, self.sums[0], self.w, self.sums[1], self.v, self.sums[2], np.array([self.b]), self.sums[3]]

    def train(self, docs: list[np.ndarray], table: np.ndarray, labels: np.ndarray, passes: int, rate: float = 0.15, seed: int = 7) -> None:
        """docs: each document's words by number; table: the rows of each word. Adagrad; gradients reach the words at the maxima only."""
        rng = np.random.default_rng(seed)
        self.parameters()
        g_e, g_w, g_v, g_b = self.sums
        for _ in range(passes):
            for i in rng.permutation(len(docs)):
                y = labels[i]
                rows = table[docs[i][rng.random(len(docs[i])) >= DROPPED]]
                if not len(rows):
                    continue
                x = self.e[rows].sum(axis=1)
                f, at = pooled(x @ self.w)
                slope = 1 / (1 + np.exp(-self.logit(f))) - y
                if abs(slope) < 1e-3:
                    continue
                d_f = np.where(f > 0, slope * self.v, 0).astype(np.float32)
                d_v = slope * np.maximum(f, 0) + 1e-4 * self.v
                word = at[_FILTER_OF] + _SHIFT  # of every column of the filters
                fine = (word >= 0) & (word < len(x)) & (d_f[_FILTER_OF] != 0)
                words_at, columns = word[fine], np.flatnonzero(fine)
                d = d_f[_FILTER_OF[columns]]
                d_w = np.zeros_like(self.w)
                d_w[:, columns] = x[words_at].T * d
                pull = (self.w[:, columns] * d).T
                used, where = np.unique(rows[words_at], return_inverse=True)
                d_e = np.zeros((len(used), DIM), np.float32)
                np.add.at(d_e, where.ravel(), np.repeat(pull, rows.shape[1], axis=0))
                d_e[used == 0] = 0
                g_e[used] += d_e**2
                self.e[used] -= rate * d_e / np.sqrt(g_e[used])
                g_w += d_w**2
                self.w -= rate * d_w / np.sqrt(g_w)
                g_v += d_v**2
                self.v -= rate * d_v / np.sqrt(g_v)
                g_b += slope**2
                self.b -= float(rate * slope / np.sqrt(g_b[0]))

    def table(self, rows: list[tuple[int, ...]]) -> np.ndarray:
        """The filters' partial sums for words given by their rows."""
        return self.e[np.array(rows, np.int64).reshape(-1, 1 + len(STEMS))].sum(axis=1) @ self.w


class Scorer:
    """Scores texts; knows at most `most` words at once."""

    def __init__(self, model: Model, most: int = 150_000):
        self.model, self.most = model, most
        self._forget()

    def _forget(self):
        self.words, self.sums = Words(self.model.row_of), np.zeros((0, COLUMNS), np.float32)

    def logit(self, text: str) -> tuple[float, int]:
        of = words(text)
        if not of:
            return self.model.b, 0
        if len(self.words) > self.most:
            self._forget()
        ids = np.fromiter(map(self.words.__getitem__, of), np.int64, len(of))
        if len(self.words.rows) > len(self.sums):
            self.sums = self._grown(self.model.table(self.words.rows[len(self.sums) :]))
        return self.model.logit(pooled(self.sums[ids])[0]), language(of)

    def _grown(self, fresh: np.ndarray) -> np.ndarray:
        n, m = len(self.sums), len(self.sums) + len(fresh)
        store = self.sums.base if self.sums.base is not None else self.sums
        if len(store) < m:
            store = np.zeros((max(2 * m, 4096), COLUMNS), np.float32)
            store[:n] = self.sums
        store[n:m] = fresh
        return store[:m]

    def score(self, text: str) -> float:
        logit, lang = self.logit(text)
        return float(1 / (1 + np.exp(-np.clip(logit - self.model.limits[lang], -30, 30))))


def limit_of(logits: np.ndarray, labels: np.ndarray, n: np.ndarray | None = None, low: np.ndarray | None = None) -> float:
    """The threshold of the best F1; of those the middle of the gap. A row, or n of them between low and logits with so many labels."""
    n, low = np.ones(len(logits)) if n is None else n, logits if low is None else low
    order = np.argsort(-logits, kind="stable")
    hits = np.cumsum(labels[order])
    f1 = 2 * hits / (np.cumsum(n[order]) + max(1, labels.sum()))
    k = int(f1.argmax())
    nxt = logits[order[k + 1]] if k + 1 < len(order) else low[order[k]] - 1
    return float((low[order[k]] + nxt) / 2)


def limits_by_language(logits: np.ndarray, labels: np.ndarray, langs: np.ndarray, n: np.ndarray | None = None, low: np.ndarray | None = None) -> np.ndarray:
    """Of n toxic rows of a language its own threshold counts n / (n + PRIOR), that of all rows the rest."""
    n, low = np.ones(len(logits)) if n is None else n, logits if low is None else low
    everywhere = limit_of(logits, labels, n, low) if labels.any() else 0.0
    limits = np.full(len(LANGUAGES), everywhere)
    for k in range(len(LANGUAGES)):
        own = langs == k
        if toxic := labels[own].sum():
            limits[k] += toxic / (toxic + PRIOR) * (limit_of(logits[own], labels[own], n[own], low[own]) - everywhere)
    return limits


class Shard:
    """Labelled rows as numbers: buckets of words, words of all rows with their ends, labels, languages, and which set thresholds only."""

    KINDS = (("buckets", "<u4"), ("words", "<u4"), ("ends", "<i8"), ("labels", "u1"), ("langs", "u1"))

    def __init__(self, **arrays: np.ndarray):
        self.__dict__ |= arrays
        self.buckets = self.buckets.reshape(-1, 1 + len(STEMS))
        self.held = np.arange(len(self.ends)) % KEPT_BACK == 0

    @classmethod
    def of(cls, rows: list[tuple[int, str, int]], most: int = 150_000) -> Shard:
        """Of (id, text, label) rows. At most `most` words are known at once; a word forgotten gets another number."""
        rows = sorted(rows, key=lambda r: (zlib.crc32(b"order:%d" % r[0]), r[0]))
        number: dict[bytes, int] = {}
        parts, fresh, of, langs, n = [], [], [], [], 0
        for _, text, _ in rows:
            if len(number) > most:
                parts.append(np.array(fresh, "<u4"))
                number, fresh, n = {}, [], n + len(fresh)
            mine = words(text)
            for w in mine:
                if w not in number:
                    number[w] = n + len(fresh)
                    fresh.append(buckets(w))
            of.append(np.array([number[w] for w in mine], "<u4"))
            langs.append(language(mine))
        parts.append(np.array(fresh, "<u4").reshape(-1, 1 + len(STEMS)))
        ends = np.cumsum([len(x) for x in of], dtype=np.int64)
        return cls(buckets=np.concatenate(parts), words=np.concatenate([np.zeros(0, "<u4"), *of]), ends=ends, labels=np.array([y for _, _, y in rows], np.uint8), langs=np.array(langs, np.uint8))

    def packed(self) -> bytes:
        columns = [np.ascontiguousarray(getattr(self, name)).astype(kind) for name, kind in self.KINDS]
        return zstandard.compress(np.array([c.size for c in columns], "<i8").tobytes() + b"".join(c.tobytes() for c in columns), 3)

    @classmethod
    def unpacked(cls, raw: bytes) -> Shard:
        raw = zstandard.decompress(raw)
        at, arrays = 8 * len(cls.KINDS), {}
        for (name, kind), n in zip(cls.KINDS, np.frombuffer(raw, "<i8", len(cls.KINDS)).tolist()):
            arrays[name] = np.frombuffer(raw, kind, n, at)
            at += arrays[name].nbytes
        return cls(**arrays)

    def docs(self, which: np.ndarray) -> list[np.ndarray]:
        starts = np.concatenate([[0], self.ends[:-1]]).astype(np.int64)
        return [self.words[a:b] for a, b in zip(starts[which].tolist(), self.ends[which].tolist())]

    def seen(self) -> np.ndarray:
        """Of every bucket, how many training rows have it, and how many toxic ones."""
        out = np.zeros((2, BUCKETS), np.uint32)
        for of, toxic in zip(self.docs(~self.held), self.labels[~self.held].tolist()):
            out[: 1 + toxic, np.unique(self.buckets[np.unique(of)])] += 1
        return out

    def rows(self, kept: np.ndarray) -> np.ndarray:
        """The model's rows of the words' buckets; kept: the model's buckets, sorted."""
        if not len(kept):
            return np.zeros(self.buckets.shape, np.int64)
        at = np.minimum(np.searchsorted(kept, self.buckets), len(kept) - 1)
        return np.where(kept[at] == self.buckets, at + 1, 0)

    def train(self, model: Model, passes: int, seed: int) -> None:
        model.train(self.docs(~self.held), self.rows(np.array(list(model.row_of), np.uint32)), self.labels[~self.held], passes, seed=seed)

    def cells(self, model: Model) -> list[tuple[int, int, int, int, float, float]]:
        """Language, part of a logit, rows, toxic rows, least and largest logit, of the rows that set thresholds."""
        sums = model.e[self.rows(np.array(list(model.row_of), np.uint32))].sum(axis=1) @ model.w
        out: dict[tuple[int, int], list] = {}
        for of, y, lang in zip(self.docs(self.held), self.labels[self.held].tolist(), self.langs[self.held].tolist()):
            z = model.logit(pooled(sums[of])[0]) if len(of) else model.b
            c = out.setdefault((lang, int(np.floor(np.clip(z, -64, 64) * CELLS))), [0, 0, z, z])
            c[:] = c[0] + 1, c[1] + y, min(c[2], z), max(c[3], z)
        return [(*k, *c) for k, c in out.items()]


def chosen(seen: np.ndarray, toxic: np.ndarray, n: int, n_toxic: int) -> np.ndarray:
    """Which buckets get embeddings, of counts among n training rows of which n_toxic are toxic."""
    share = n_toxic / max(1, n)
    off = np.abs(toxic - seen * share) >= MARKED * np.sqrt(np.maximum(seen * share * (1 - share), 1e-9))
    return (seen >= LEAST) & ((seen * COMMON_ONE >= n) | off)


def passes_of(n: int) -> int:
    return max(PASSES, -(-UPDATES // max(1, n)))


def limits_of(cells: list) -> np.ndarray:
    lang, _, n, hits, low, high = (np.array(x) for x in zip(*sorted(cells)))
    return limits_by_language(high, hits.astype(np.float64), lang, n, low)


def fit(rows: list[tuple[int, str, int]]) -> Model:
    """A model of (id, text, label) rows, as one shard."""
    shard = Shard.of(rows)
    used = shard.labels[~shard.held]
    model = Model({int(b): k + 1 for k, b in enumerate(np.flatnonzero(chosen(*shard.seen().astype(np.int64), len(used), int(used.sum()))))})
    if len(rows) and shard.labels.min() < shard.labels.max():
        shard.train(model, passes_of(len(used)), seed=7)
        model.limits = limits_of(shard.cells(model))
    return model


def held_out(doc_id):
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5 == 0


def labelled(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, int]:
    """doc_id, text and label of every labelled row that may be learnt from, with its shard, and the number of shards."""
    marked = (
        labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL")
        .groupBy(F.col("doc_id").cast("long").alias("train_id"))
        .agg(F.max(F.col("toxic").cast("int")).alias("train_label"))
        .where(~held_out(F.col("train_id")))
    )
    shards = max(1, round(marked.count() / SHARD))
    open_docs = common.id_and_text(docs).where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    rows = open_docs.join(marked, F.col("doc_id") == F.col("train_id")).groupBy("doc_id", "train_label").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    return rows.select(F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int").alias("shard"), "doc_id", "text", (F.col("train_label") > 0).cast("int").alias("label")), shards


def packed(rows: DataFrame, shards: int) -> DataFrame:
    """A row for each shard: its number, its rows as numbers, and how many rows and toxic rows train and are there in all."""

    def pack(key, table):
        shard = Shard.of(list(zip(*(table.column(c).to_pylist() for c in ("doc_id", "text", "label")))))
        used = shard.labels[~shard.held]
        counts = [len(used), int(used.sum()), len(shard.labels), int(shard.labels.sum())]
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "data": pa.array([shard.packed()], pa.binary())} | {f"n{k}": pa.array([n], pa.int64()) for k, n in enumerate(counts)})

    return rows.repartition(shards, "shard").groupBy("shard").applyInArrow(pack, "shard int, data binary, n0 long, n1 long, n2 long, n3 long")


def _each(shards: DataFrame, f, schema: str) -> DataFrame:
    """Rows that f(number, shard) yields as tuples."""

    def make():
        def run(batch):
            names = [c.split()[0] for c in schema.split(", ")]
            kinds = [{"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "binary": pa.binary()}[c.split()[1]] for c in schema.split(", ")]
            for k in range(batch.num_rows):
                for row in f(batch.column("shard")[k].as_py(), Shard.unpacked(batch.column("data")[k].as_py())):
                    yield pa.RecordBatch.from_arrays([pa.array([x], kind) for x, kind in zip(row, kinds)], names)

        return run

    return common.map_batches(shards.select("shard", "data"), make, schema, rows=1)


#: Buckets, and rows of embeddings, that one task sums.
BLOCK = 1 << 16


def buckets_of(shards: DataFrame, n: int, n_toxic: int) -> np.ndarray:
    """The buckets that get embeddings, sorted: each one's rows are counted over all shards."""

    def count(_, shard):
        seen = shard.seen()
        for block in range(BUCKETS // BLOCK):
            yield block, zstandard.compress(seen[:, block * BLOCK : (block + 1) * BLOCK].astype("<u4").tobytes(), 1)

    def add(key, table):
        total = np.zeros((2, BLOCK), np.int64)
        for raw in table.column("seen"):
            total += np.frombuffer(zstandard.decompress(raw.as_py()), "<u4").reshape(2, BLOCK)
        at = np.flatnonzero(chosen(*total, n, n_toxic)) + key[0].as_py() * BLOCK
        return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "at": pa.array([at.astype("<u4").tobytes()], pa.binary())})

    found = _each(shards, count, "block int, seen binary").groupBy("block").applyInArrow(add, "block int, at binary").collect()
    return np.concatenate([np.zeros(0, "<u4"), *(np.frombuffer(r["at"], "<u4") for r in sorted(found, key=lambda r: r["block"]))])


def passed(shards: DataFrame, model: Model, passes: int, seed: int) -> None:
    """Passes over all shards, each from the same model, which then gets their mean steps."""
    model.parameters()
    sent = shards.sparkSession.sparkContext.broadcast(model)

    def train(number, shard):
        own = Model.__new__(Model)
        own.__dict__ |= {k: v.copy() if isinstance(v, np.ndarray) else v for k, v in sent.value.__dict__.items()}
        own.sums = [x.copy() for x in sent.value.sums]
        shard.train(own, passes, seed * 1_000_003 + number)
        (e, g, *before), (own_e, own_g, *after) = sent.value.parameters(), own.parameters()
        moved = np.flatnonzero((own_g != g).any(axis=1))
        steps = np.concatenate([own_e[moved] - e[moved], own_g[moved] - g[moved]], axis=1)
        cuts = np.searchsorted(moved, np.arange(0, len(e) + BLOCK, BLOCK))
        for block, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist())):
            if a < b:
                yield block, number, moved[a:b].astype("<u4").tobytes(), steps[a:b].astype("<f4").tobytes()
        yield -1, number, b"", np.concatenate([(y - x).ravel() for x, y in zip(before, after)]).astype("<f8").tobytes()

    def mean(key, table):
        block, parts = key[0].as_py(), sorted(zip(*(table.column(c).to_pylist() for c in ("number", "at", "steps"))))
        if block < 0:
            at, total = np.zeros(0, "<u4"), sum(np.frombuffer(x, "<f8") for _, _, x in parts) / len(parts)
        else:
            sums, times = np.zeros((BLOCK, 2 * DIM)), np.zeros(BLOCK)
            for _, at, x in parts:
                at = np.frombuffer(at, "<u4") - np.uint32(block * BLOCK)
                sums[at] += np.frombuffer(x, "<f4").reshape(-1, 2 * DIM)
                times[at] += 1
            at = np.flatnonzero(times)
            total = sums[at] / times[at][:, None]
            at = at + block * BLOCK
        return pa.table({"block": pa.array([block], pa.int32()), "at": pa.array([at.astype("<u4").tobytes()], pa.binary()), "steps": pa.array([total.astype("<f8").tobytes()], pa.binary())})

    steps = _each(shards, train, "block int, number int, at binary, steps binary").groupBy("block").applyInArrow(mean, "block int, at binary, steps binary").collect()
    e, g, *rest = model.parameters()
    for r in steps:
        step = np.frombuffer(r["steps"], "<f8")
        if r["block"] >= 0:
            at, step = np.frombuffer(r["at"], "<u4"), step.reshape(-1, 2 * DIM)
            e[at] += step[:, :DIM].astype(np.float32)
            g[at] += step[:, DIM:].astype(np.float32)
            continue
        for x in rest:
            x += step[: x.size].reshape(x.shape).astype(x.dtype)
            step = step[x.size :]
        model.b = float(rest[4][0])
    sent.unpersist()


def trained(docs: DataFrame, labels: DataFrame) -> Model:
    """A model of all labelled rows of docs that may be learnt from."""
    shards = common.written(packed(*labelled(docs, labels)), "toxicity-shards")
    n, n_toxic, n_all, toxic_all = (x or 0 for x in shards.agg(*(F.sum(f"n{k}") for k in range(4))).first())
    with common.settings(docs.sparkSession, **{"spark.sql.files.openCostInBytes": "1g"}):  # a file a task: shards are work, not bytes
        model = Model({int(b): k + 1 for k, b in enumerate(buckets_of(shards, n, n_toxic))})
        if toxic_all in (0, n_all):
            return model
        rounds = (passes_of(n),) if shards.count() == 1 else (1,) * passes_of(n)
        for k, passes in enumerate(rounds):
            passed(shards, model, passes, 7 + k)
        model.sums = None
        sent = docs.sparkSession.sparkContext.broadcast(model)
        cells = _each(shards, lambda _, shard: shard.cells(sent.value), "lang int, cell int, n long, hits long, low double, high double")
        cells = cells.groupBy("lang", "cell").agg(F.sum("n"), F.sum("hits"), F.min("low"), F.max("high")).collect()
    model.limits = limits_of([tuple(r) for r in cells])
    return model


def score(docs: DataFrame, model: Model, **columns) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of docs."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        scorer = Scorer(sent.value)

        def f(batch):
            scores = np.array([scorer.score(t) for t in common.texts_of(batch, "text")], np.float64)
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64())], ["doc_id", "score"])

        return f

    scored = common.map_batches(common.id_and_text(docs, **columns), make, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def reject(docs: DataFrame, model: Model) -> DataFrame:
    """docs, with all their columns, without the rows that the model calls toxic."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        scorer = Scorer(sent.value)
        return lambda batch: batch.filter(pa.array([scorer.score(t) < 0.5 for t in common.texts_of(batch, "text")], pa.bool_()))

    return common.map_batches(docs, make, docs.schema)


def op5_toxicity_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents")
    return score(docs, trained(docs, common.read(spark, sf_dir, "labels")))
