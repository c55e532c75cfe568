"""Product-quantised codes of vectors by the filtering form of Lloyd's iterations.

Vectors are dealt to blocks as they lie in their partitions; for each of its parts a block builds a balanced kd-tree
whose nodes keep their bounding box, sum and count. Trees are written once in the shared folder. A round sends the
codebooks (a few entries) to the tasks: a node carries the entries that could be nearest to a point of its box, entries
that are beaten in the whole box go, and a node with one entry left gives its sum and count at once. Tasks hand on
one sum for each component of an entry, so that the driver sees as much in every round as a codebook has.

All arithmetic is on whole numbers: with 64 bits where no square can be too large for them, else with Python's integers.

Defined results: a null vector, and one that holds null, NaN or an infinite component, is left out; repeated ids and null
ids are rows like others (among the smallest ids null comes last, equal ids by their vectors); a vector that is shorter
than the longest counts as if zeros followed, as does a length that the parts don't divide; components whose 4096-fold
is beyond a long count as the nearest long; fewer vectors than entries give smaller codebooks; an error or a sum of
errors beyond a long is null; an empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
LEAF = 16
#: Components of a block of vectors, which is what one row of the table of trees holds.
BLOCK = 1 << 18
LONGEST = (1 << 63) - 1

CODES = "vec_id long, label long, code string, error long"
TREE = "dtype string, rows binary, points binary, low binary, high binary, sums binary"
BLOCKS = f"ids array<long>, labels array<long>, trees array<struct<{TREE.replace(' ', ': ').replace(',:', ',')}>>"


class Tree:
    """A balanced kd-tree: level l has 2**l nodes, node k of n points holds points[n k >> l : n (k + 1) >> l].

    rows are the points' places in their block. low, high and sums have a row a node, level by level.
    """

    def __init__(self, rows: np.ndarray, points: np.ndarray, low: np.ndarray, high: np.ndarray, sums: np.ndarray):
        self.rows, self.points, self.low, self.high, self.sums = rows, points, low, high, sums
        self.depth = depth_of(len(points))

    @classmethod
    def of(cls, points: np.ndarray) -> Tree:
        n = len(points)
        rows = np.arange(n)
        low, high, sums = [], [], []
        for level in range(depth_of(n) + 1):
            starts = edges_of(n, level)[:-1]
            ordered = points[rows]
            low.append(np.minimum.reduceat(ordered, starts))
            high.append(np.maximum.reduceat(ordered, starts))
            sums.append(np.add.reduceat(ordered, starts))
            if level < depth_of(n):
                node = np.repeat(np.arange(len(starts)), np.diff(edges_of(n, level)))
                widest = np.argmax(high[-1] - low[-1], axis=1)
                key = ordered[np.arange(n), widest[node]]
                rows = rows[np.lexsort((np.unique(key, return_inverse=True)[1] if key.dtype == object else key, node))]
        return cls(rows, points[rows], *map(np.concatenate, (low, high, sums)))

    def assigned(self, entries: np.ndarray, owner: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Sums and counts of the points nearest to each entry (the first among equals); owner gets each point's entry."""
        n, k = len(self.points), len(entries)
        sums = np.zeros((k, self.points.shape[1]), dtype=self.points.dtype)
        counts = np.zeros(k, dtype=np.int64)
        nodes, alive = np.zeros(1, dtype=np.int64), np.ones((1, k), dtype=bool)
        for level in range(self.depth + 1):
            edges, at = edges_of(n, level), (1 << level) - 1 + nodes
            if not len(nodes):
                break
            alive = unbeaten(entries, self.low[at], self.high[at], alive)
            sole = alive.sum(axis=1) == 1
            winner = alive[sole].argmax(axis=1)
            np.add.at(sums, winner, self.sums[at[sole]])
            np.add.at(counts, winner, np.diff(edges)[nodes[sole]])
            if owner is not None:
                for node, entry in zip(nodes[sole].tolist(), winner.tolist()):
                    owner[edges[node] : edges[node + 1]] = entry
            nodes, alive = nodes[~sole], alive[~sole]
            if level < self.depth:
                nodes, alive = np.concatenate([2 * nodes, 2 * nodes + 1]), np.concatenate([alive, alive])
        if len(nodes):  # leaves where several entries are left
            edges = edges_of(n, self.depth)
            sizes = np.diff(edges)[nodes]
            points = np.repeat(edges[nodes] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
            apart = squared(self.points[points][:, None, :] - entries[None, :, :])
            nearest = np.argmin(apart, axis=1)
            np.add.at(sums, nearest, self.points[points])
            np.add.at(counts, nearest, 1)
            if owner is not None:
                owner[points] = nearest
        return sums, counts


def depth_of(n: int) -> int:
    return max(0, math.ceil(math.log2(n / LEAF))) if n else 0


def edges_of(n: int, level: int) -> np.ndarray:
    return (np.arange((1 << level) + 1) * n) >> level


def squared(x: np.ndarray) -> np.ndarray:
    return (x * x).sum(axis=-1)


def unbeaten(entries: np.ndarray, low: np.ndarray, high: np.ndarray, alive: np.ndarray) -> np.ndarray:
    """Which of the living entries aren't beaten by the one nearest to the middle anywhere in a box.

    The difference of two squared distances is linear, so it is least at the corner that lies towards the other entry.
    """
    far = squared(2 * entries[None, :, :] - (low + high)[:, None, :])
    best = np.where(alive, far, far.max() + 1).argmin(axis=1)
    of_best = entries[best][:, None, :]
    corner = np.where(entries[None, :, :] > of_best, high[:, None, :], low[:, None, :])
    lead = squared(entries[None, :, :] - corner) - squared(of_best - corner)
    index = np.arange(len(entries))[None, :]
    kept = (lead < 0) | ((lead == 0) & (index < best[:, None])) | (index == best[:, None])
    return alive & kept


def whole(column: Column, scale: int = SCALE) -> Column:
    return F.transform(column, lambda v: F.floor(v.cast("double") * F.lit(float(scale))))


def sound(column: Column) -> Column:
    """Whether a vector is there and all its components are numbers."""
    good = lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < F.lit(math.inf))
    return column.isNotNull() & F.coalesce(F.forall(column, good), F.lit(False))


def matrix(vectors: pa.ListArray, width: int) -> np.ndarray:
    """Vectors as rows, with zeros after short ones; of 64-bit integers where their squares fit, else of Python's."""
    flat, ends = vectors.flatten().to_numpy(zero_copy_only=False), vectors.offsets.to_numpy() - vectors.offsets[0].as_py()
    lengths = np.diff(ends)
    if (lengths == width).all():
        out = flat.reshape(len(lengths), width).astype(np.int64)
    else:
        out = np.zeros((len(lengths), width), dtype=np.int64)
        out[np.repeat(np.arange(len(lengths)), lengths), np.arange(len(flat)) - np.repeat(ends[:-1], lengths)] = flat
    return out


def safe(points: np.ndarray, most: int) -> np.ndarray:
    """The same numbers with room for squared distances where none is larger than most."""
    return points.astype(np.int64) if 16 * (most + 1) ** 2 * max(1, points.shape[-1]) < LONGEST else points.astype(object)


def _packed(tree: Tree) -> dict:
    if tree.points.dtype == object:
        kind, sums = "<i8", np.array([str(v) for v in tree.sums.ravel()], dtype="S40")
    else:
        kind, sums = next(f"<i{b}" for b in (2, 4, 8) if b == 8 or abs(tree.points).max(initial=0) < 1 << (8 * b - 1)), tree.sums.astype("<i8")
    raw = lambda x: x.astype(kind).tobytes()
    return {"dtype": kind, "rows": tree.rows.astype("<i4").tobytes(), "points": raw(tree.points), "low": raw(tree.low), "high": raw(tree.high), "sums": sums.tobytes()}


def _unpacked(raw: dict, width: int, most: int) -> Tree:
    points, low, high = (safe(np.frombuffer(raw[c], raw["dtype"]).reshape(-1, width), most) for c in ("points", "low", "high"))
    if points.dtype == object:
        sums = np.array([int(v) for v in np.frombuffer(raw["sums"], "S40")], dtype=object).reshape(-1, width)
    else:
        sums = np.frombuffer(raw["sums"], "<i8").reshape(-1, width)
    return Tree(np.frombuffer(raw["rows"], "<i4"), points, low, high, sums)


def trees(kept: DataFrame, parts: int, width: int, most: int) -> DataFrame:
    """A row for each block of kept (vec_id, label, v): its ids, labels and a tree for each part."""
    rows = max(1, min(8192, BLOCK // (parts * width)))

    def make():
        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            vectors = safe(matrix(batch.column("v"), parts * width), most).reshape(-1, parts, width)
            built = [_packed(Tree.of(vectors[:, p])) for p in range(parts)] if batch.num_rows else []
            schema = pa.schema([("ids", pa.list_(pa.int64())), ("labels", pa.list_(pa.int64())), ("trees", pa.list_(pa.struct([(c.split()[0], pa.string() if c.endswith("string") else pa.binary()) for c in TREE.split(", ")])))])
            columns = [[batch.column("vec_id").to_pylist()], [batch.column("label").to_pylist()], [built]]
            return pa.RecordBatch.from_arrays([pa.array(c if batch.num_rows else [], t) for c, t in zip(columns, schema.types)], schema=schema)

        return f

    return common.map_batches(kept, make, BLOCKS, rows)


def _over_blocks(blocks: DataFrame, one: Callable[[dict], Iterator[tuple]], schema: str, last: Callable[[], Iterator[tuple]] | None = None) -> DataFrame:
    """Rows of one(block) for every block, then those of last(), a task at a time."""
    kinds = [pa.decimal128(38, 0) if "decimal" in c else pa.string() if "string" in c else pa.int64() for c in schema.split(", ")]
    names = [c.split()[0] for c in schema.split(", ")]

    def out(rows) -> pa.RecordBatch:
        rows = list(rows)
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names)

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                yield out(one(batch.slice(k, 1).to_pylist()[0]))
        if last:
            yield out(last())

    return blocks.mapInArrow(run, schema)


def _sums(blocks: DataFrame, codebooks: np.ndarray, width: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """For each part and entry the sum (by component) and the number of the parts that are nearest to it."""
    sums = np.zeros(codebooks.shape, dtype=object)
    counts = np.zeros(codebooks.shape[:2], dtype=object)

    def one(block):
        for p, raw in enumerate(block["trees"]):
            more, n = _unpacked(raw, width, most).assigned(safe(codebooks[p], most))
            sums[p] += more.astype(object)
            counts[p] += n.astype(object)
        return ()

    def last():
        for (p, e), n in np.ndenumerate(counts):
            if n:
                yield p, e, -1, Decimal(int(n))
                for at, total in enumerate(sums[p, e]):
                    yield p, e, at, Decimal(int(total))

    told = _over_blocks(blocks, one, "part long, entry long, position long, total decimal(38,0)", last)
    all_sums, all_counts = np.zeros_like(sums), np.zeros_like(counts)
    for p, e, at, total in told.groupBy("part", "entry", "position").agg(F.sum("total").alias("total")).collect():  # parts x entries x (width + 1)
        if at < 0:
            all_counts[p, e] = int(total)
        else:
            all_sums[p, e, at] = int(total)
    return all_sums, all_counts


def compressed(
    vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS
) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, label, code, error of every sound vector, in a table; the codebooks, parts x entries x width)."""
    spark = vectors.sparkSession
    x = F.col(vector_column)
    kept = vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(label_column).cast("long").alias("label"), x).where(sound(x)).select("vec_id", "label", whole(x).alias("v"))
    largest = F.greatest(F.array_max("v"), -F.greatest(F.array_min("v"), F.lit(-LONGEST)))
    dims, most = kept.agg(F.max(F.size("v")), F.max(largest)).first()
    if dims is None:
        return spark.createDataFrame([], CODES), np.zeros((parts, 0, 1), dtype=object)
    width, most = max(1, -(-dims // parts)), most or 0
    first = kept.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).select("v").collect()
    padded = np.array([[*r.v, *[0] * (parts * width - len(r.v))] for r in first], dtype=object)
    codebooks = padded.reshape(len(first), parts, width).transpose(1, 0, 2).copy()
    with common.settings(spark, **{"spark.sql.execution.arrow.maxRecordsPerBatch": "8192"}):
        blocks = common.written(trees(kept, parts, width, most), "vector-trees")
    with common.settings(spark, **{"spark.sql.execution.arrow.maxRecordsPerBatch": "4"}):  # a block is a row
        for _ in range(rounds):
            sums, counts = _sums(blocks, codebooks, width, most)
            used = counts > 0
            codebooks[used] = sums[used] // counts[used][:, None]

        def one(block):
            n = len(block["ids"])
            codes, errors = np.zeros((n, parts), dtype=np.int64), np.zeros(n, dtype=object)
            for p, raw in enumerate(block["trees"]):
                tree, own = _unpacked(raw, width, most), safe(codebooks[p], most)
                owner = np.zeros(n, dtype=np.int64)
                tree.assigned(own, owner)
                codes[tree.rows, p] = owner
                errors[tree.rows] += squared(tree.points - own[owner]).astype(object)
            for vec_id, label, code, error in zip(block["ids"], block["labels"], codes.tolist(), errors.tolist()):
                yield vec_id, label, "".join(f"{c:02x}" for c in code), error if error <= LONGEST else None

        return common.written(_over_blocks(blocks, one, CODES), "vector-codes"), codebooks


def with_label_errors(codes: DataFrame) -> DataFrame:
    """codes and label_error, the sum of the errors of equal labels (nulls together).

    Labels of over a thousandth of all rows, a thousand at most, are told to their rows; the others are joined by label.
    """
    sums = codes.groupBy("label").agg(F.try_sum("error").alias("label_error"), F.count("*").alias("n"), F.count("error").alias("sound"))
    sums = sums.select("label", F.when(F.col("n") == F.col("sound"), F.col("label_error")).alias("label_error"), "n")
    sums = common.written(sums, "vector-labels", gathered=True)
    common_ones = sums.where(F.col("n") > codes.count() / 1000).select(F.col("label").alias("of"), "label_error")
    rare = sums.join(F.broadcast(common_ones), F.col("label").eqNullSafe(F.col("of")), "left_anti").select(F.col("label").alias("of"), "label_error")
    near = codes.join(F.broadcast(common_ones), F.col("label").eqNullSafe(F.col("of"))).drop("of")
    rest = codes.join(F.broadcast(common_ones), F.col("label").eqNullSafe(F.col("of")), "left_anti")
    return near.union(rest.join(rare, F.col("label").eqNullSafe(F.col("of"))).drop("of"))


def digest(codebooks: np.ndarray) -> str:
    return hashlib.sha256(",".join(str(int(v)) for v in codebooks.ravel()).encode()).hexdigest()


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, codebooks = compressed(common.read(spark, sf_dir, "embeddings"))
    return with_label_errors(codes).select("vec_id", "code", "error", "label_error", F.lit(digest(codebooks)).alias("codebooks_sha256"))


def _sql() -> str:
    """The same rounds, unrolled; all numbers are whole and far below 2**53, so that doubles hold them exactly."""
    out = f"""WITH kept AS MATERIALIZED (SELECT vec_id, label, [floor({SCALE} * x::DOUBLE) for x in embedding] AS v, len(embedding) // {PARTS} AS w FROM embeddings
  WHERE embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR isnan(x) OR isinf(x)]) = 0),
 cut AS MATERIALIZED (SELECT vec_id, label, part, v[part * w + 1 : (part + 1) * w] AS x FROM kept CROSS JOIN (SELECT range AS part FROM range({PARTS}))),
 c0 AS MATERIALIZED (SELECT part, entry, x AS c FROM (SELECT part, x, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry FROM cut) WHERE entry < {ENTRIES})"""
    for r in range(ROUNDS + 1):
        out += f""",
 a{r} AS MATERIALIZED (SELECT vec_id, label, part, any_value(x) AS x, min({{'d': list_dot_product(x, x) - 2 * list_dot_product(x, c) + list_dot_product(c, c), 'entry': entry}}) AS best
  FROM cut JOIN c{r} USING (part) GROUP BY vec_id, label, part)"""
        if r < ROUNDS:
            out += f""",
 m{r} AS (SELECT part, entry, list(v ORDER BY place) AS c FROM (SELECT part, entry, place, floor(sum(v) / count(*)) AS v
  FROM (SELECT part, best.entry AS entry, unnest(x) AS v, unnest(range(len(x))) AS place FROM a{r}) GROUP BY part, entry, place) GROUP BY part, entry),
 c{r + 1} AS MATERIALIZED (SELECT part, entry, coalesce(m{r}.c, c{r}.c) AS c FROM c{r} LEFT JOIN m{r} USING (part, entry))"""
    return out + f""",
 coded AS (SELECT vec_id, label, string_agg(printf('%02x', best.entry::INT), '' ORDER BY part) AS code, sum(best.d)::BIGINT AS error FROM a{ROUNDS} GROUP BY vec_id, label),
 book AS (SELECT sha256(string_agg(v::BIGINT::VARCHAR, ',' ORDER BY part, entry, place)) AS codebooks_sha256 FROM (SELECT part, entry, unnest(c) AS v, unnest(range(len(c))) AS place FROM c{ROUNDS}))
 SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM coded CROSS JOIN book"""


OP11_SQL = _sql()
