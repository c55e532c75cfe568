"""Document fingerprints by a quartile bucket digest: byte triplets are hashed to buckets, each bucket's count gives way
to the quartile it lies in, and a length code and the quartiles' ratios go before. Two digests differ by a bounded
score, the sum of bucket, length and ratio differences up to MOST; their likeness is 1 less its share of MOST.

In order of falling ids every document meets the next one. Splits of the ids (at most `most_parts`, found by a quantile
sketch) deal texts to parts once; a part also gets the first document of the part that follows it, so the walk down a
part streams its rows and holds two texts, and nothing else crosses parts.

Defined results: a null text is an empty one; null ids come last; documents that share an id follow each other by a
hash of their texts; the first document follows the last; every row gives one row; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

BUCKETS = 128
MOST = 320


def digest(raw: bytes) -> str:
    """Two hex digits of length, two of the quartiles' ratios, and a digit for every two buckets."""
    b = np.frombuffer(raw, np.uint8)
    if len(b) < 3:
        counts = np.zeros(BUCKETS, np.int64)
    else:
        t = b[:-2].astype(np.uint32)
        t <<= 8
        t |= b[1:-1]
        t <<= 8
        t |= b[2:]
        t *= np.uint32(0x9E3779B1)
        t >>= 25
        counts = np.bincount(t, minlength=BUCKETS)
    ordered = np.sort(counts)
    q1, q2, q3 = (int(ordered[BUCKETS * k // 4 - 1]) for k in (1, 2, 3))
    codes = ((counts > q1).astype(np.uint8) + (counts > q2) + (counts > q3)).reshape(-1, 4)
    packed = (codes[:, 0] << 6 | codes[:, 1] << 4 | codes[:, 2] << 2 | codes[:, 3]).astype(np.uint8)
    length = min(255, round(math.log(len(raw) + 1) / math.log(1.1)))
    ratios = (15 * q1 // q3 << 4 | 15 * q2 // q3) if q3 else 0
    return bytes((length, ratios)).hex() + packed.tobytes().hex()


def difference(a: str, b: str) -> int:
    """0 for equal digests, MOST at most."""
    if a == b:
        return 0
    x, y = (np.frombuffer(bytes.fromhex(d), np.uint8) for d in (a, b))
    split = lambda v: np.stack([v[2:] >> 6, v[2:] >> 4 & 3, v[2:] >> 2 & 3, v[2:] & 3]).astype(np.int16)
    apart = np.abs(split(x) - split(y))
    total = int(apart.sum()) + 3 * int((apart == 3).sum())
    total += min(24, abs(int(x[0]) - int(y[0]))) * 2
    total += abs((int(x[1]) >> 4) - (int(y[1]) >> 4)) + abs((int(x[1]) & 15) - (int(y[1]) & 15))
    return min(MOST, total)


def likeness(a: str, b: str) -> float:
    return 1 - difference(a, b) / MOST


def edited(text: str, following: str) -> str:
    """The text with its last half replaced by as much of the start of another."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def parts(docs: DataFrame, rows_a_part: int = 4000, most_parts: int = 65536) -> tuple[DataFrame, int]:
    """doc_id, text, part, tail and their order key, dealt and sorted: a tail row follows its part's last row only."""
    docs = common.id_and_text(docs)
    ids = docs.select("doc_id").where("doc_id IS NOT NULL")
    n = max(1, min(most_parts, -(-ids.count() // rows_a_part)))
    splits = ids.approxQuantile("doc_id", [k / n for k in range(1, n)], 1 / (4 * n)) if n > 1 else []
    splits = sorted({int(s) for s in splits})

    def part_of(of: np.ndarray) -> np.ndarray:  # from the highest ids down
        return len(splits) - np.searchsorted(np.array(splits, np.int64), of, side="right")

    def make_ids():
        def f(batch):
            of = batch.column("doc_id").to_numpy(zero_copy_only=False)
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(part_of(of), pa.int64())], ["doc_id", "part"])

        return f

    firsts = {r["part"]: r["doc_id"] for r in common.map_batches(ids, make_ids, "doc_id long, part long").groupBy("part").agg(F.max("doc_id").alias("doc_id")).collect()}
    nameless = docs.where("doc_id IS NULL").agg(F.min(F.xxhash64(F.coalesce("text", F.lit("")))).alias("h")).first()["h"]
    used = sorted(firsts)
    if nameless is not None:
        used.append(len(splits) + 1)
    before = {p: used[k - 1] for k, p in enumerate(used)}

    def make():
        def f(batch):
            known = batch.column("doc_id").is_valid().to_numpy(zero_copy_only=False)
            of = batch.column("doc_id").fill_null(0).to_numpy(zero_copy_only=False)
            part = np.where(known, part_of(of), len(splits) + 1)
            h = batch.column("h").to_numpy(zero_copy_only=False)
            first = np.array([firsts.get(p, 0) for p in part.tolist()], np.int64)
            heads = np.flatnonzero(np.where(known, of == first, h == (nameless or 0)))
            own = pa.RecordBatch.from_arrays([*batch.columns, pa.array(part, pa.int64()), pa.array(np.zeros(len(part), bool))], [*batch.schema.names, "part", "tail"])
            yield own
            if len(heads):
                copy = batch.take(pa.array(heads))
                to = pa.array([before[p] for p in part[heads].tolist()], pa.int64())
                yield pa.RecordBatch.from_arrays([*copy.columns, to, pa.array(np.ones(len(heads), bool))], own.schema.names)

        return f

    hashed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"))
    dealt = common.map_batches(hashed, make, "doc_id long, text string, h long, part long, tail boolean")
    return dealt.repartition(len(splits) + 2, "part").sortWithinPartitions("part", "tail", F.desc_nulls_last("doc_id"), "h"), n


def fingerprints(docs: DataFrame, remembered: int = 500) -> DataFrame:
    """For every row its digest, that of its text edited by the next document's, and its likeness to that and to the next."""
    walked, _ = parts(docs)
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def run(batches):
        held, known = None, {}

        def of(text):
            if text not in known:
                if len(known) >= remembered:
                    known.clear()
                known[text] = digest(text.encode("utf-8", "surrogatepass"))
            return known[text]

        for batch in batches:
            out = []
            for doc_id, text, part, tail in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "part", "tail"))):
                if held and held[2] == part:
                    own, new = of(held[1]), edited(held[1], text).encode("utf-8", "surrogatepass")
                    own_edited, nxt = digest(new), of(text)
                    out.append((held[0], len(held[1]), hashlib.sha256(new).hexdigest(), own, own_edited, likeness(own, own_edited), likeness(own, nxt)))
                held = None if tail else (doc_id, text, part)
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kinds[k]) for k in range(7)], names)

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return walked.mapInArrow(run, schema)


def op6_quartile_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(common.read(spark, sf_dir, "documents"))
