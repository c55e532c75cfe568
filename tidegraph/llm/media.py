"""Media columns by signature: an Aho-Corasick pass locates magic bytes, validators confirm each format's structure and
length, declared types are corrected by what stands at the start, and whole media inside other bytes are carved out.

Formats read and written: 8-bit mono WAVE and Sun audio, 8-bit grey BMP and PNG. Also recognised and carved: GIF, JPEG.

Defined results: null bytes have no type and no payload; a null text is stored as an empty one; rows that repeat stay;
null ids stay null; bytes of any length are read whole; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import common

UNIT = 192
PNG = b"\x89PNG\r\n\x1a\n"
MAGIC = {b"RIFF": "wav", b".snd": "au", b"BM": "bmp", PNG: "png", b"GIF87a": "gif", b"GIF89a": "gif", b"\xff\xd8\xff": "jpeg"}
STORED = ("wav", "bmp", "png", "au")
#: Grey levels as a BMP palette.
GREYS = bytes(v for g in range(256) for v in (g, g, g, 0))


def write(kind: str, payload: bytes, width: int = UNIT) -> bytes:
    """The payload as 8-bit samples of a format; of images, a row has `width` samples, which divides the payload."""
    n = len(payload)
    if kind == "wav":
        odd = n & 1
        return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + n + odd, b"WAVE", b"fmt ", 16, 1, 1, 8000, 8000, 1, 8, b"data", n) + payload + b"\0" * odd
    if kind == "au":
        return struct.pack(">4sIIIII", b".snd", 24, n, 2, 8000, 1) + payload
    rows = n // width
    if kind == "bmp":  # rows from the top, so the height is negative
        return struct.pack("<2sIHHIIiiHHIIiiII", b"BM", 1078 + n, 0, 0, 1078, 40, width, -rows, 1, 8, 0, n, 2835, 2835, 256, 0) + GREYS + payload
    if kind == "png":
        lines = np.zeros((rows, width + 1), np.uint8)
        lines[:, 1:] = np.frombuffer(payload, np.uint8).reshape(rows, width)
        chunk = lambda name, body: struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))
        return PNG + chunk(b"IHDR", struct.pack(">IIBBBBB", width, rows, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines.tobytes(), 1)) + chunk(b"IEND", b"")
    raise ValueError(kind)


def _png_chunks(b: bytes, at: int):
    at += 8
    while at + 12 <= len(b):
        n = int.from_bytes(b[at : at + 4], "big")
        if at + 12 + n > len(b) or zlib.crc32(b[at + 4 : at + 8 + n]) != int.from_bytes(b[at + 8 + n : at + 12 + n], "big"):
            return
        yield b[at + 4 : at + 8], at + 8, n
        at += 12 + n


def end_of(kind: str, b: bytes, at: int) -> int:
    """Where a medium that begins at a place ends; -1 if its structure or lengths don't hold."""
    left = len(b) - at
    if kind == "wav":
        if left < 44 or b[at + 8 : at + 12] != b"WAVE":
            return -1
        end, at = at + 8 + int.from_bytes(b[at + 4 : at + 8], "little"), at + 12
        seen = []
        while at + 8 <= end <= len(b):
            seen.append(b[at : at + 4])
            at += 8 + (n := int.from_bytes(b[at + 4 : at + 8], "little")) + (n & 1)
        return end if at == end and b"fmt " in seen and b"data" in seen else -1
    if kind == "au":
        head, n = (int.from_bytes(b[at + k : at + k + 4], "big") for k in (4, 8))
        return at + head + n if left >= 24 and 24 <= head and head + n <= left and int.from_bytes(b[at + 20 : at + 24], "big") > 0 else -1
    if kind == "bmp":
        if left < 54:
            return -1
        n, zero, start, head, width, height, planes, bits = struct.unpack("<IIIIiiHH", b[at + 2 : at + 30])
        row = (width * bits + 31) // 32 * 4 if width > 0 else 0
        fine = n <= left and not zero and head >= 40 and planes == 1 and bits in (1, 4, 8, 24, 32) and row and start + row * abs(height) == n
        return at + n if fine else -1
    if kind == "png":
        first = True
        for name, start, n in _png_chunks(b, at):
            if first and (name != b"IHDR" or n != 13):
                return -1
            first = False
            if name == b"IEND":
                return start + n + 4
        return -1
    if kind == "gif":
        if left < 14:
            return -1
        p = at + 13 + (3 << ((b[at + 10] & 7) + 1) if b[at + 10] & 128 else 0)
        while p < len(b):
            if b[p] == 0x3B:
                return p + 1
            if b[p] == 0x2C and p + 11 < len(b):
                p += 11 + (3 << ((b[p + 9] & 7) + 1) if b[p + 9] & 128 else 0)
            elif b[p] == 0x21:
                p += 2
            else:
                return -1
            while p < len(b) and b[p]:
                p += b[p] + 1
            p += 1
        return -1
    p = at + 2
    while p + 4 <= len(b) and b[p] == 0xFF:
        mark, n = b[p + 1], int.from_bytes(b[p + 2 : p + 4], "big")
        if mark < 0xC0 or n < 2:
            return -1
        p += 2 + n
        if mark == 0xDA:  # coded data last until a mark that isn't a restart or a stuffed byte
            while (p := b.find(b"\xff", p)) >= 0 and p + 1 < len(b) and (b[p + 1] == 0 or 0xD0 <= b[p + 1] <= 0xD7):
                p += 2
            if p < 0 or p + 1 >= len(b):
                return -1
            if b[p + 1] == 0xD9:
                return p + 2
    return -1


def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for magic, kind in MAGIC.items():
        found.add_word(magic.decode("latin-1"), (kind, len(magic)))
    found.make_automaton()
    return found


def sniff(b: bytes, magic: ahocorasick.Automaton) -> list[tuple[str, int, int]]:
    """(type, start, end) of the medium at the start, if there is one, and of every whole medium inside, by place."""
    found, inside = [], 0
    for last, (kind, length) in magic.iter(b.decode("latin-1")):
        at = last - length + 1
        if at < inside and at:
            continue  # in an embedded medium that has been carved whole
        end = end_of(kind, b, at)
        if end > 0:
            found.append((kind, at, end))
            inside = end if at else 0
    return found


def read_back(kind: str | None, b: bytes) -> bytes | None:
    """The samples of a medium as write() stored them; None of what isn't one of these formats."""
    if kind not in STORED or b is None:
        return None
    if kind == "wav":
        at = 12
        while b[at : at + 4] != b"data":
            n = int.from_bytes(b[at + 4 : at + 8], "little")
            at += 8 + n + (n & 1)
        return b[at + 8 : at + 8 + int.from_bytes(b[at + 4 : at + 8], "little")]
    if kind == "au":
        head, n = (int.from_bytes(b[k : k + 4], "big") for k in (4, 8))
        return b[head : head + n]
    if kind == "bmp":
        return b[int.from_bytes(b[10:14], "little") : int.from_bytes(b[2:6], "little")]
    width, packed = 0, []
    for name, start, n in _png_chunks(b, 0):
        if name == b"IHDR":
            width = int.from_bytes(b[start : start + 4], "big")
        elif name == b"IDAT":
            packed.append(b[start : start + n])
    lines = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(-1, width + 1)
    return lines[:, 1:].tobytes()


def padded(text: str, unit: int = UNIT) -> bytes:
    raw = text.encode("utf-8", "surrogatepass")
    return raw + b" " * (max(1, -(-len(raw) // unit)) * unit - len(raw))


def stored(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The batch function of store."""
    texts = common.texts_of(batch, "text")
    payloads = [padded(t) for t in texts]
    sums = [zlib.crc32(p) for p in payloads]
    out = [
        batch.column("doc_id"),
        pa.array([len(t.encode("utf-8", "surrogatepass")) for t in texts], pa.int64()),
        pa.array([STORED[(s >> 8) % len(STORED)] for s in sums], pa.string()),
        pa.array([write(STORED[s % len(STORED)], p) for s, p in zip(sums, payloads)], pa.binary()),
    ]
    return pa.RecordBatch.from_arrays(out, ["doc_id", "n_bytes", "declared", "media"])


def store(docs: DataFrame, **columns) -> DataFrame:
    """doc_id, n_bytes, declared (a type, often a wrong one) and media of every row's text; types follow the content."""
    return common.map_batches(common.id_and_text(docs, **columns), lambda: stored, "doc_id long, n_bytes long, declared string, media binary", 500)


def inspected(media_column: str = "media"):
    """The batch function of inspect."""
    magic = automaton()
    kind = pa.list_(pa.struct([("type", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def f(batch):
        found = [sniff(b, magic) if b is not None else [] for b in batch.column(media_column).to_pylist()]
        detected = pa.array([x[0][0] if x and x[0][1] == 0 else None for x in found], pa.string())
        carved = pa.array([[{"type": k, "start": a, "end": b} for k, a, b in x if a] for x in found], kind)
        return pa.RecordBatch.from_arrays([*batch.columns, detected, carved], [*batch.schema.names, "detected", "carved"])

    return f


def inspect(media: DataFrame, media_column: str = "media") -> DataFrame:
    """media with detected (the type at the start) and carved, an array of (type, start, end) of media inside."""
    media = media.drop("detected", "carved")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in media.schema.fields)
    return common.map_batches(media, lambda: inspected(media_column), f"{kinds}, detected string, carved array<struct<type: string, start: long, end: long>>", 500)


def feature(kind: str, declared: str, samples: np.ndarray, carved: int) -> str:
    steps = np.abs(np.diff(samples.astype(np.int16)))
    return f"{kind},declared={declared},samples={len(samples)},mean={samples.mean():.3f},deviation={samples.std():.3f},step={steps.mean():.3f},carved={carved}"


def op9_media_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.id_and_text(common.read(spark, sf_dir, "documents"))

    def make():
        inspect_batch = inspected()

        def f(batch):
            batch, rows = inspect_batch(stored(batch)), []
            for n, declared, media, kind, carved in zip(*(batch.column(c).to_pylist() for c in ("n_bytes", "declared", "media", "detected", "carved"))):
                payload = read_back(kind, media)
                rows.append((
                    n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(),
                    feature(kind, declared, np.frombuffer(payload, np.uint8), len(carved)),
                ))
            names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array([r[k] for r in rows], kinds[k]) for k in range(7))], ["doc_id", *names])

        return f

    return common.map_batches(
        docs, make, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string", 500
    )
