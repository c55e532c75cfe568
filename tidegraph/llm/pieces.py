"""SentencePiece encoding and decoding by a Viterbi search whose forward scores are shared among words.

A text is marked as the library marks it (a mark before the text and for every space) and cut into marked words; no
piece of the vocabulary reaches over such a cut, which is checked when it is loaded. The distinct words of a batch are
sorted, which lays them out as a depth-first walk of their trie: each word starts from the forward scores of the
prefix that it shares with the one before. The segmentation has the largest sum of piece scores, with earlier starts
first among equals, as the library's own search over scores has; a character that no piece covers becomes its bytes.

The vocabulary has merge ranks for scores, so the result is the best segmentation under these scores (what the library
gives for the same file read as a score model), not the order of merges. A mark in the text itself becomes its bytes,
so decoding gives every text back exactly.

Scale: rows are encoded where they are read, without a shuffle; the driver sends the vocabulary (its size is the file's)
and a task keeps a bounded number of words that it has met.

Defined results: a null text has null pieces, an empty one none; ids may be null or repeated; empty tables give no rows;
all columns of the input but one called piece_ids are handed on by encode.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import common

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK, LITERAL = "▁", "\udc81"  # a lone surrogate, which no text can hold, stands for a mark in the text
UNKNOWN = 10.0


def vocabulary(path: str = MODEL) -> dict:
    """Pieces with (score, id), the ids of single bytes, and the bytes of each id."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces, of_byte, raw = {}, [0] * 256, []
    for i in range(model.vocab_size()):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            of_byte[int(piece[3:5], 16)] = i
            raw.append(bytes([int(piece[3:5], 16)]))
        elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
            raw.append(b"")
        else:
            pieces[piece] = (model.get_score(i), i)
            raw.append(piece.replace(MARK, " ").encode())
            if MARK in piece.lstrip(MARK) or "\n" in piece:
                raise ValueError(f"piece {i} reaches over words")
    return {"pieces": pieces, "of_byte": of_byte, "raw": raw}


UNIT = re.compile(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n")


def units(text: str) -> list[str]:
    return UNIT.findall(MARK + text.replace(MARK, LITERAL).replace(" ", MARK))


class Codec:
    """most: words remembered at once."""

    def __init__(self, vocab: dict, most: int = 400_000):
        self.pieces, self.of_byte, self.raw = vocab["pieces"], vocab["of_byte"], vocab["raw"]
        self.longest = max(map(len, self.pieces))
        self.unknown = min(s for s, _ in self.pieces.values()) - UNKNOWN
        self.most, self.known = most, {}

    def _bytes_of(self, char: str) -> list[int]:
        return [self.of_byte[b] for b in (MARK if char == LITERAL else char).encode("utf-8", "surrogatepass")]

    def search(self, words: list[str]) -> None:
        """Segments sorted distinct words into self.known, as bytes of 32-bit ids."""
        get, longest, unknown, known = self.pieces.get, self.longest, self.unknown, self.known
        best, start, ident = [0.0], [0], [0]
        before = ""
        for word in words:
            n, same = len(word), 0
            top = min(n, len(before))
            while same < top and word[same] == before[same]:
                same += 1
            del best[same + 1 :], start[same + 1 :], ident[same + 1 :]
            for end in range(same + 1, n + 1):
                score, begin, i = None, 0, -1
                for a in range(end - longest if end > longest else 0, end):
                    hit = get(word[a:end])
                    if hit is not None and (score is None or best[a] + hit[0] > score):
                        score, begin, i = best[a] + hit[0], a, hit[1]
                if hit is None and (score is None or best[end - 1] + unknown > score):  # no piece for the last character
                    score, begin, i = best[end - 1] + unknown, end - 1, -1
                best.append(score)
                start.append(begin)
                ident.append(i)
            out, end = [], n
            while end:
                begin = start[end]
                if ident[end] < 0:
                    out += self._bytes_of(word[begin])[::-1]
                else:
                    out.append(ident[end])
                end = begin
            known[word] = np.array(out[::-1], "<i4").tobytes()
            before = word

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as bytes of 32-bit integers."""
        cut = [units(t) if t else [] for t in texts]
        fresh = set().union(*cut).difference(self.known) if cut else set()
        if len(self.known) + len(fresh) > self.most:
            self.known.clear()
            fresh = set().union(*cut)
        self.search(sorted(fresh))
        get = self.known.__getitem__
        return [b"".join(map(get, u)) for u in cut]

    def decode(self, ids: np.ndarray) -> str:
        raw = b"".join(map(self.raw.__getitem__, ids.tolist()))
        return (raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "surrogatepass")


def _slices(batch: pa.RecordBatch, rows: int = 1000):
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def encode(docs: DataFrame, vocab: dict, text_column: str = "text") -> DataFrame:
    """docs with piece_ids array<int>."""
    docs = docs.drop("piece_ids")
    sent = docs.sparkSession.sparkContext.broadcast(vocab)

    def make():
        codec = Codec(sent.value)

        def f(batch):
            for part in _slices(batch):
                texts = part.column(text_column).to_pylist()
                ids = codec.encode([t or "" for t in texts])
                ends = np.cumsum([0, *(len(x) // 4 for x in ids)]).astype(np.int32)
                mask = pa.array([t is None for t in texts], pa.bool_())
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(ids), "<i4")), mask=mask)
                yield pa.RecordBatch.from_arrays([*part.columns, lists], [*part.schema.names, "piece_ids"])

        return f

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return common.map_batches(docs, make, f"{kinds}, piece_ids array<int>")


def decode(encoded: DataFrame, vocab: dict, ids_column: str = "piece_ids", text_column: str = "decoded") -> DataFrame:
    """encoded with its pieces' text in another column; null pieces give null."""
    encoded = encoded.drop(text_column)
    sent = encoded.sparkSession.sparkContext.broadcast(vocab)

    def make():
        codec = Codec(sent.value)

        def f(batch):
            for part in _slices(batch):
                lists = part.column(ids_column)
                texts = [None if x is None else codec.decode(np.array(x, np.int64)) for x in lists.to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], [*part.schema.names, text_column])

        return f

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema.fields)
    return common.map_batches(encoded, make, f"{kinds}, `{text_column}` string")


def digests(docs: DataFrame, vocab: dict) -> DataFrame:
    """doc_id, n_pieces, ids_sha256 (of the 32-bit ids) and decoded_sha256, the text that the ids decode to; both ways in one pass."""
    sent = docs.sparkSession.sparkContext.broadcast(vocab)

    def make():
        codec = Codec(sent.value)

        def f(batch):
            for part in _slices(batch):
                ids = codec.encode(common.texts_of(part, "text"))
                back = [codec.decode(np.frombuffer(x, "<i4")).encode("utf-8", "surrogatepass") for x in ids]
                columns = [
                    part.column("doc_id"),
                    pa.array([len(x) // 4 for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in ids]),
                    pa.array([hashlib.sha256(x).hexdigest() for x in back]),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_pieces", "ids_sha256", "decoded_sha256"])

        return f

    return common.map_batches(common.id_and_text(docs), make, "doc_id long, n_pieces long, ids_sha256 string, decoded_sha256 string")


def op7_pieces_viterbi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(common.read(spark, sf_dir, "documents"), vocabulary())
