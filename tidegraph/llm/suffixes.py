"""Suffix-array dedup: bytes covered by a string of LENGTH bytes that also starts in a document of a smaller id.

Strings of LENGTH bytes (windows) are known by their anchor, the least hash among the SEED-byte strings inside, so equal
windows have equal anchors at equal places; consecutive windows of one anchor form a stretch of text. The steps:

1. Documents are packed into batches of some MB in the shared folder.
2. Every batch deals its distinct anchors, with counts of documents, over the cluster; those that lie in one document
   only go. What comes back to a batch are its anchors that other documents have too.
3. Every batch deals the stretches of these, equal ones only once, by anchor. A task takes what it gets in the order
   of ids through logarithmic families of suffix arrays: a new batch of strings gets a suffix array (sorted strings,
   each with the smallest id), is merge-scanned against the arrays of all levels for whole matches, and joins them as a
   new level, levels of like size being merged. Whole stretches go through a family first, which settles those that
   others have whole; of the different stretches of an anchor all windows then go through another one. Strings are
   compared byte by byte; hashes only deal and filter.
4. The windows found return to their batches, which remove the bytes that they cover.

Scale: a frequent passage gives a batch's record for its inner stretches, however many documents of the batch have it.
Its edges differ in every document, so the stretches of an anchor that over `hot` documents have are cut into single
windows, which are dealt by their own hash. Tasks are as many as the anchors and stretches found need, each bounded in
bytes. Nothing but counts comes to the driver.

Defined results: a null text is an empty one; a null id is larger than any other; rows of one id are not smaller than
each other, so they take nothing from one another; every row gives one row; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

LENGTH = 50
#: Of 24 bytes few are the same by chance in a corpus of billions; 16 are, the more the larger it is.
SEED = 24
#: Bytes of the longest stretch: its windows all have one seed inside.
WIDEST = 2 * LENGTH - SEED
NAMELESS = (1 << 63) - 1
LOW = np.uint64((1 << 24) - 1)
SIX = np.uint64((1 << 48) - 1)


def anchors(buf: np.ndarray, ends: np.ndarray, chunk: int = 1 << 19):
    """Stretches of windows that share an anchor: first window, number of windows, anchor's hash, document's number.

    buf: the bytes of all documents; ends: where each of them ends. No window reaches over an end.
    """
    if len(buf) < LENGTH:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.uint64, np.int64))
    starts = np.concatenate([[0], ends[:-1]])
    long = ends - starts >= LENGTH
    step = np.zeros(len(buf) - LENGTH + 2, np.int32)
    step[starts[long]] += 1
    step[ends[long] - LENGTH + 1] -= 1
    valid = np.cumsum(step[:-1]).astype(bool)
    parts = []
    for at in range(0, len(valid), chunk):
        parts.append(_anchors(buf[at : min(len(buf), at + chunk + LENGTH - 1)], valid[at : at + chunk], at))
    first, count, code = (np.concatenate([p[k] for p in parts]) for k in range(3))
    return first, count, code, np.searchsorted(ends, first, side="right")


def _eights(buf: np.ndarray) -> np.ndarray:
    """The eight bytes from every place on, as a number."""
    return np.ndarray((len(buf) - 7,), "<u8", buffer=np.ascontiguousarray(buf), strides=(1,))


def _hashed(length: int, eight) -> np.ndarray:
    """Hashes of strings of so many bytes; eight(k) gives the eight bytes of each from its k-th on."""
    h = eight(0) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(32)
    for k in (*range(8, length - 8, 8), length - 8):
        h += eight(k) * np.uint64(0xC2B2AE3D27D4EB4F)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
    return h


def _spread(h: np.ndarray) -> np.ndarray:
    """Minima of hashes are small; these are even over all numbers, for they deal anchors out. One to one."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(32))


def _dealt_to(codes: np.ndarray, buckets: int) -> np.ndarray:
    return (((codes >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)


def _anchors(buf, valid, offset):
    words = _eights(buf)
    h = _hashed(SEED, lambda k: words[k : k + len(buf) - SEED + 1])
    least = (h & ~LOW) | np.arange(len(h), dtype=np.uint64)
    width, most = 1, LENGTH - SEED + 1
    while width < most:  # minima of ever wider runs of seeds, the first one among equals
        more = min(width, most - width)
        least = np.minimum(least[:-more], least[more:])
        width += more
    at = np.flatnonzero(valid)
    own = (least[at] & LOW).astype(np.int64)
    new = np.ones(len(at), bool)
    new[1:] = (own[1:] != own[:-1]) | (at[1:] != at[:-1] + 1)
    begin = np.flatnonzero(new)
    return at[begin] + offset, np.diff(np.append(begin, len(at))), _spread(h[own[begin]])


def six(codes: np.ndarray) -> bytes:
    """48 bits of each code."""
    return codes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def unsix(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.reshape(-1).view("<u8")


def merged(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two sorted arrays of distinct strings as one: the strings, where each is from (places of b go on behind those of
    a), and whether the one before is the same. The stable sort takes the arrays as two runs and merges them in one scan."""
    both = np.concatenate([a, b])
    order = np.argsort(both, kind="stable")
    both = both[order]
    same = np.zeros(len(both), bool)
    same[1:] = both[1:] == both[:-1]
    return both, order, same


def few(counts: np.ndarray) -> bytes:
    """A byte for each count, and behind them all the counts of 255 and more."""
    return np.minimum(counts, 255).astype(np.uint8).tobytes() + counts[counts >= 255].astype("<u4").tobytes()


def unfew(raw: bytes, n: int) -> np.ndarray:
    counts = np.frombuffer(raw, np.uint8, n).astype(np.int64)
    counts[counts == 255] = np.frombuffer(raw, "<u4", offset=n)
    return counts


class Levels:
    """The logarithmic family: suffix arrays as sorted distinct strings of one width, each with the smallest id that has it."""

    def __init__(self):
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, strings: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Indexes a batch of strings (fixed-width bytes); whether each also starts in a smaller id, so far."""
        order = np.argsort(strings, kind="stable")
        w, d = strings[order], ids[order]
        new = np.ones(len(w), bool)
        new[1:] = w[1:] != w[:-1]
        group = np.cumsum(new) - 1
        least = np.full(group[-1] + 1 if len(w) else 0, NAMELESS)
        np.minimum.at(least, group, d)
        own, smallest = w[new], least.copy()
        for level, low in self.levels:
            _, of, same = merged(level, own)
            at = np.flatnonzero(same)
            mine = of[at] - len(level)
            smallest[mine] = np.minimum(smallest[mine], low[of[at - 1]])
        found = np.empty(len(w), bool)
        found[order] = d > smallest[group]
        self._push(own, least)
        return found

    def _push(self, w, low):
        while self.levels and len(self.levels[-1][0]) <= 2 * len(w):
            w, low = self._joined(w, low)
        if len(w):
            self.levels.append((w, low))

    def _joined(self, w, low):
        v, other = self.levels.pop()
        both, of, same = merged(v, w)
        low = np.concatenate([other, low])[of]
        at = np.flatnonzero(same)
        low[at - 1] = np.minimum(low[at - 1], low[at])
        return both[~same], low[~same]

    def one(self) -> tuple[np.ndarray, np.ndarray]:
        """All levels merged into one, which stays."""
        w, low = self.levels.pop()
        while self.levels:
            w, low = self._joined(w, low)
        self.levels.append((w, low))
        return w, low


def pack(docs: DataFrame, size: int = 8 << 20) -> DataFrame:
    """batch, ids, ends and data (compressed) of consecutive documents, up to about size bytes together."""

    def run(batches):
        place, n = (TaskContext.get().partitionId() << 33), 0
        ids, texts, total = [], [], 0

        def out():
            nonlocal ids, texts, total, n
            row = pa.RecordBatch.from_arrays(
                [
                    pa.array([place + n], pa.int64()),
                    pa.array([np.array([NAMELESS if i is None else i for i in ids], "<i8").tobytes()], pa.binary()),
                    pa.array([np.array([i is None for i in ids], bool).tobytes()], pa.binary()),
                    pa.array([np.cumsum([len(t) for t in texts]).astype("<i8").tobytes()], pa.binary()),
                    pa.array([zstandard.compress(b"".join(texts), 6)], pa.binary()),
                ],
                ["batch", "ids", "nameless", "ends", "data"],
            )
            n += 1
            ids, texts, total = [], [], 0
            return row

        for batch in (b.slice(k, 500) for b in batches for k in range(0, b.num_rows, 500)):
            for i, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                ids.append(i)
                texts.append((t or "").encode("utf-8", "surrogatepass"))
                total += len(texts[-1])
                if total >= size or len(ids) >= 100_000:
                    yield out()
        if ids:
            yield out()

    return common.id_and_text(docs).mapInArrow(run, "batch long, ids binary, nameless binary, ends binary, data binary")


def unpack(row: dict) -> tuple[np.ndarray, np.ndarray, bytes]:
    """ids, ends and bytes."""
    return np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["ends"], "<i8"), zstandard.decompress(row["data"])


def _stream(df: DataFrame, f, schema: str) -> DataFrame:
    """Rows one by one as dictionaries to f, which yields dictionaries of the schema."""
    names = [c.strip().split(" ")[0] for c in schema.split(",")]
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    types = [kinds[c.strip().split(" ")[1]] for c in schema.split(",")]

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                (row,) = batch.slice(k, 1).to_pylist()
                rows = list(f(row))
                yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in zip(names, types)], names)

    return df.mapInArrow(run, schema)


def shared_anchors(packed: DataFrame, buckets: int, hot: int) -> DataFrame:
    """batch, codes and hot codes: 48 bits of the batch's anchors that lie in several documents."""

    def deal(row):
        ids, ends, data = unpack(row)
        _, _, code, doc = anchors(np.frombuffer(data, np.uint8), ends)
        order = np.lexsort((ids[doc], code))
        code, of = code[order], ids[doc][order]
        fresh = np.ones(len(code), bool)
        fresh[1:] = (code[1:] != code[:-1]) | (of[1:] != of[:-1]) | (of[1:] == NAMELESS)
        code = code[fresh]
        distinct, count = np.unique(code, return_counts=True)
        part = _dealt_to(distinct, buckets)
        cuts = np.searchsorted(part, np.arange(buckets + 1))
        for b in range(buckets):
            if cuts[b] < cuts[b + 1]:
                s = slice(cuts[b], cuts[b + 1])
                yield {"bucket": b, "batch": row["batch"], "codes": six(distinct[s]), "counts": few(count[s])}

    def meet(key, table):
        batches = table.column("batch").to_pylist()
        codes = [unsix(x) for x in table.column("codes").to_pylist()]
        counts = np.concatenate([unfew(x, len(c)) for x, c in zip(table.column("counts").to_pylist(), codes)])
        of = np.repeat(np.arange(len(codes)), [len(c) for c in codes])
        code = np.concatenate(codes)
        distinct, group = np.unique(code, return_inverse=True)
        total = np.bincount(group, counts)[group]
        out = {"batch": [], "codes": [], "hot": []}
        keep = np.flatnonzero(total >= 2)
        cuts = np.searchsorted(of[keep], np.arange(len(batches) + 1))
        for k, batch in enumerate(batches):
            mine = keep[cuts[k] : cuts[k + 1]]
            if len(mine):
                out["batch"].append(batch)
                out["codes"].append(six(code[mine]))
                out["hot"].append(six(code[mine[total[mine] > hot]]))
        return pa.table({"batch": pa.array(out["batch"], pa.int64()), "codes": pa.array(out["codes"], pa.binary()), "hot": pa.array(out["hot"], pa.binary())})

    dealt = _stream(packed, deal, "bucket int, batch long, codes binary, counts binary")
    return dealt.groupBy("bucket").applyInArrow(meet, "batch long, codes binary, hot binary")


def _strings(buf: np.ndarray, first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Stretches as strings of one width: their bytes, zeros, and their number of windows as the last byte, so equal ones are of equal length."""
    out = np.zeros((len(first), WIDEST + 1), np.uint8)
    out[:, :WIDEST] = np.lib.stride_tricks.sliding_window_view(np.concatenate([buf, np.zeros(WIDEST, np.uint8)]), WIDEST)[first]
    out[:, :WIDEST][np.arange(WIDEST) >= (count + LENGTH - 1)[:, None]] = 0
    out[:, WIDEST] = count
    return out.view(f"S{WIDEST + 1}").reshape(-1)


def _windows_of(count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of every window of stretches with so many windows: its stretch's number, and its number within."""
    of = np.repeat(np.arange(len(count)), count)
    return of, np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)


def _records(row: dict, buckets: int, at_once: int = 1 << 18):
    """The stretches of a batch that other documents may have, as (bucket, records), so many stretches at once (a batch may
    be one very long document). They are sorted, and each distinct one is there once."""
    ids, ends, data = unpack(row)
    buf = np.frombuffer(data, np.uint8)
    first, count, code, doc = anchors(buf, ends)
    known = np.sort(np.concatenate([unsix(x) for x in row["codes"]]))
    warm = np.sort(np.concatenate([unsix(x) for x in row["hot"]]))
    low = code & SIX
    among = lambda s: s[np.minimum(np.searchsorted(s, low), len(s) - 1)] == low if len(s) else np.zeros(len(low), bool)
    kept, is_hot = among(known), among(warm)
    single, k = _windows_of(count[at := np.flatnonzero(kept & is_hot)])
    place = first[at][single] + k
    words = _eights(buf)
    keys = _spread(_hashed(LENGTH, lambda k: words[place + k]))
    whole = np.flatnonzero(kept & ~is_hot)
    first, count, code, doc = (np.concatenate(x) for x in ((first[whole], place), (count[whole], np.ones(len(place), np.int64)), (code[whole], keys), (doc[whole], doc[at][single])))
    order = np.lexsort((first, ids[doc]))
    for part in np.split(order, range(at_once, len(order), at_once)):
        if len(part):
            yield from _sorted_records(_strings(buf, first[part], count[part]), code[part], ids[doc[part]], first[part], buckets)


def _sorted_records(strings: np.ndarray, codes: np.ndarray, ids: np.ndarray, places: np.ndarray, buckets: int):
    """The suffix array of a batch's stretches, which come in the order of ids, cut by bucket: distinct strings, codes, the
    smallest id of each, and the places that this id and that larger ones have it at."""
    part = _dealt_to(codes, buckets)
    order = np.argsort(strings, kind="stable")
    order = order[np.argsort(part[order], kind="stable")]
    strings, codes, ids, places, part = strings[order], codes[order], ids[order], places[order], part[order]
    new = np.ones(len(order), bool)
    new[1:] = strings[1:] != strings[:-1]
    begin = np.flatnonzero(new)
    end = np.append(begin[1:], len(order))
    own = np.add.reduceat(ids == ids[begin][np.cumsum(new) - 1], begin)
    cuts = np.flatnonzero(np.diff(part[begin], prepend=-1))
    for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(begin)]):
        s = begin[a:b]
        yield int(part[s[0]]), _write_records(strings[s], codes[s], ids[s], own[a:b], end[a:b] - s, places[s[0] : end[b - 1]])


def _write_records(strings, codes, ids, own, together, places) -> bytes:
    columns = (np.array([len(strings)], "<i8"), codes.astype("<u8"), ids.astype("<i8"), own.astype("<u4"), together.astype("<u4"), strings, places.astype("<u4"))
    return zstandard.compress(b"".join(c.tobytes() for c in columns), 1)


def _read_records(raw: bytes) -> tuple[np.ndarray, ...]:
    raw = zstandard.decompress(raw)
    n, at, columns = int(np.frombuffer(raw, "<i8", 1)[0]), 8, []
    for kind in ("<u8", "<i8", "<u4", "<u4", f"S{WIDEST + 1}"):
        columns.append(np.frombuffer(raw, kind, n, at))
        at += columns[-1].nbytes
    return (*columns, np.frombuffer(raw, "<u4", offset=at))


def _whole(index: Levels, strings: np.ndarray, ids: np.ndarray, together: int) -> np.ndarray:
    """Of each string, whether it also starts in a smaller id: they go through the family in the order of ids, so many at once."""
    found = np.zeros(len(strings), bool)
    order = np.argsort(ids, kind="stable")
    for at in range(0, len(order), together):
        part = order[at : at + together]
        found[part] = index.add(strings[part], ids[part])
    return found


def _edges(kinds: np.ndarray, least: np.ndarray, codes: np.ndarray, together: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows that also start in a smaller id, of distinct stretches: stretch's number, first window, number of windows.

    Only the different stretches of an anchor can share windows. Of theirs, those with a hash that no other window has go
    first; the rest goes through a family of levels."""
    _, group, n = np.unique(codes, return_inverse=True, return_counts=True)
    several = np.flatnonzero(n[group] > 1)
    bytes_of = np.frombuffer(kinds[several].tobytes(), np.uint8)
    of, k = _windows_of(bytes_of.reshape(-1, WIDEST + 1)[:, WIDEST].astype(np.int64))
    if not len(of):
        return of, k, k
    place = of * (WIDEST + 1) + k
    words = _eights(bytes_of)
    h = _hashed(LENGTH, lambda k: words[place + k])
    order = np.argsort(h)
    h = h[order]
    again = np.zeros(len(h), bool)
    again[1:] = h[1:] == h[:-1]
    again[:-1] |= again[1:]
    left = np.sort(order[again])
    windows = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(bytes_of, LENGTH)[place[left]]).view(f"S{LENGTH}").reshape(-1)
    at = left[_whole(Levels(), windows, least[several][of[left]], together)]
    begin = np.flatnonzero((np.diff(at, prepend=-2) != 1) | (np.diff(of[at], prepend=-1) != 0))
    return several[of[at[begin]]], k[at[begin]], np.diff(np.append(begin, len(at)))


def _found(table, together: int):
    """Of all records that met in a bucket: pairs of first window and number of windows, by batch."""
    parts = [_read_records(raw) for raw in table.column("records").to_pylist()]
    codes, ids, own, have, strings, places = (np.concatenate([p[k] for p in parts]) for k in range(6))
    batch = np.repeat(np.array(table.column("batch").to_pylist(), np.int64), [len(p[0]) for p in parts])
    del parts
    index = Levels()
    again = _whole(index, strings, ids, together)
    kinds, least = index.one()
    kind = np.searchsorted(kinds, strings)
    code = np.zeros(len(kinds), np.uint64)
    code[kind] = codes
    of_kind, x, n = _edges(kinds, least, code, together)
    count = np.frombuffer(strings.tobytes(), np.uint8).reshape(-1, WIDEST + 1)[:, WIDEST].astype(np.int64)
    of, k = _windows_of(have.astype(np.int64))  # records of the places, and the number of each among its record's
    known = (k >= own[of]) | again[of]
    begin, runs = np.searchsorted(of_kind, np.arange(len(kinds))), np.bincount(of_kind, minlength=len(kinds))
    rest = np.flatnonzero(~known)
    rest = rest[runs[kind[of[rest]]] > 0]
    which, k = _windows_of(runs[kind[of[rest]]])
    run = begin[kind[of[rest[which]]]] + k
    places = places.astype(np.int64)
    start = np.concatenate([places[known], places[rest[which]] + x[run]])
    length = np.concatenate([count[of[known]], n[run]])
    to = np.concatenate([batch[of[known]], batch[of[rest[which]]]])
    order = np.argsort(to, kind="stable")
    pairs, to = np.stack([start, length], axis=1)[order], to[order]
    cuts = np.flatnonzero(np.diff(to, prepend=-1)).tolist()
    return [(int(to[a]), pairs[a:b].astype("<i8").tobytes()) for a, b in zip(cuts, [*cuts[1:], len(to)])]


def repeats(packed: DataFrame, bucket_bytes: int = 8 << 20, bucket_anchors: int = 1 << 21, hot: int = 20_000, together: int = 1 << 16) -> DataFrame:
    """batch and found: (first window, number of windows) pairs of all windows that start in a document of a smaller id."""
    size = packed.agg(F.sum(F.length("data"))).first()[0] or 0
    buckets = max(1, size // (5 * bucket_anchors))  # a byte in about 14 is an anchor; data are compressed
    back = common.written(shared_anchors(packed, buckets, hot), "suffix-shared")
    stretches = (back.agg(F.sum(F.length("codes"))).first()[0] or 0) // 6
    many = max(1, stretches * WIDEST // bucket_bytes)
    asked = back.groupBy("batch").agg(F.collect_list("codes").alias("codes"), F.collect_list("hot").alias("hot"))
    joined = packed.join(asked, "batch", "left").select(*packed.columns, "codes", "hot")  # of the same shape as the join in deduplicate

    def deal(row):
        for bucket, records in _records(row, many) if row["codes"] else ():
            yield {"bucket": bucket, "batch": row["batch"], "records": records}

    def meet(key, table):
        out = _found(table, together)
        return pa.table({"batch": pa.array([b for b, _ in out], pa.int64()), "found": pa.array([x for _, x in out], pa.binary())})

    dealt = _stream(joined, deal, "bucket int, batch long, records binary")
    return dealt.groupBy("bucket").applyInArrow(meet, "batch long, found binary")


def deduplicate(docs: DataFrame, **parameters) -> DataFrame:
    """doc_id, n_bytes, spans (removed bytes, array of start and end) and kept (the other bytes) for every row of docs."""
    packed = common.written(pack(docs), "suffix-packed")
    found = repeats(packed, **parameters)  # not written in between: both joins read the one shuffle of the batches
    joined = packed.join(found.groupBy("batch").agg(F.collect_list("found").alias("found")), "batch", "left").select(*packed.columns, "found")
    spans_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    names = ["doc_id", "n_bytes", "spans", "kept"]

    def cut(row):
        ids, ends, data = unpack(row)
        nameless = np.frombuffer(row["nameless"], bool)
        step = np.zeros(len(data) + 1, np.int32)
        for raw in row["found"] or []:
            pairs = np.frombuffer(raw, "<i8").reshape(-1, 2)
            np.add.at(step, pairs[:, 0], 1)
            np.add.at(step, pairs[:, 0] + pairs[:, 1] + LENGTH - 1, -1)
        gone = np.cumsum(step[:-1], dtype=np.int32) > 0
        start = 0
        for i, no_name, end in zip(ids.tolist(), nameless.tolist(), ends.tolist()):
            own = gone[start:end]
            edges = np.flatnonzero(np.diff(own.view(np.int8), prepend=np.int8(0), append=np.int8(0))).reshape(-1, 2).tolist()
            kept, at = [], start
            for a, b in edges:
                kept.append(data[at : start + a])
                at = start + b
            kept.append(data[at:end])
            yield None if no_name else i, end - start, [{"start": a, "end": b} for a, b in edges], b"".join(kept)
            start = end

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                rows = list(cut(batch.slice(k, 1).to_pylist()[0]))
                for at in range(0, len(rows), 500):
                    part = rows[at : at + 500]
                    yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in part], t) for j, t in enumerate((pa.int64(), pa.int64(), spans_type, pa.binary()))], names)

    return joined.mapInArrow(run, "doc_id long, n_bytes long, spans array<struct<start: long, end: long>>, kept binary")


def op8_suffix_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = deduplicate(common.read(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
