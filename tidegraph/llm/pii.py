"""Personal data by anchor expansion: an Aho-Corasick pass finds at-signs, plus signs, digits, schemes and identifier
cues, and a parser for each kind of anchor grows it to its borders in the text and checks what it has.

Base kinds: email, ip, card, phone, as the leftmost non-overlapping matches of their patterns, each parsed from its
anchor and dropped if it fails its check. Kinds of the method: url (from a scheme), iban and ssn (from a cue in any case,
over punctuation and connecting words such as number or is).
Positions are code points, ends exclusive.

Defined results: a null text is an empty one, without spans; every input row gives one row, repeated rows too; null
ids stay null; texts of any length are read whole, in one pass; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import common

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "url", "iban", "ssn")
CUES = {"iban": "iban", "ssn": "ssn", "social security": "ssn"}

LOWER = bytes(range(256)).lower()
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
SCHEME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+.-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DIGITS = re.compile(r"[0-9]+")
QUAD = re.compile(r"[0-9]+(?:\.[0-9]+){3}")
CHAIN = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
REST_OF_URL = re.compile(r"[^\s<>\"'`{}|\\^\x00-\x1f]+")
#: What may stand between a cue and its number: white space, punctuation and connecting words.
LEAD = r"""(?:[\s:;,.#=*"'`()\[\]<>/_–—-]++|(?i:numbers?|num|nr|nos?|is|are|was|codes?|card|account)(?![A-Za-z0-9]))*+"""
IBAN = re.compile(LEAD + r"([A-Za-z]{2}[0-9]{2}(?:\x20?[A-Za-z0-9]){11,30})")
SSN = re.compile(LEAD + r"([0-9]{3}-[0-9]{2}-[0-9]{4})(?![0-9])")


def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for sign, kind in [("@", "at"), ("+", "plus"), ("://", "scheme"), *((str(d), "digit") for d in range(10))]:
        found.add_word(sign, (kind, len(sign)))
    for cue, kind in CUES.items():
        found.add_word(cue, (kind, len(cue)))
    found.make_automaton()
    return found


def lowered(text: str) -> str:
    """The text with A-Z in lower case, at equal length."""
    return text.encode("utf-8", "surrogatepass").translate(LOWER).decode("utf-8", "surrogatepass")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) << (k & 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and part <= "255"


def iban_holds(code: str) -> bool:
    return int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def spans(text: str, anchors: ahocorasick.Automaton) -> list[tuple[int, int, str]]:
    """(start, kind's place in KINDS, end) of every span of one text, sorted by start, then kind."""
    found = []
    email_end = quad_end = chain_end = run_end = url_end = 0
    for last, (kind, length) in anchors.iter(lowered(text)):
        at = last - length + 1
        if kind == "digit":
            if at < run_end:
                continue
            run_end = DIGITS.match(text, at).end()
            if at >= quad_end and (m := QUAD.match(text, at)):
                quad_end = m.end()
                if all(map(octet, m.group().split("."))):
                    found.append((at, 1, quad_end))
            if at >= chain_end and (m := CHAIN.match(text, at)):
                chain_end = m.end()
                digits = m.group().replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and luhn(digits):
                    found.append((at, 2, chain_end))
        elif kind == "at":
            start = at
            while start > email_end and text[start - 1] in LOCAL:
                start -= 1
            if start < at and (m := DOMAIN.match(text, at + 1)):
                email_end = m.end()
                found.append((start, 0, email_end))
        elif kind == "plus":
            if m := PHONE.match(text, at):
                if 10 <= sum(c.isdigit() for c in m.group()) <= 15:
                    found.append((at, 3, m.end()))
        elif kind == "scheme":
            start = at
            while start > url_end and text[start - 1] in SCHEME:
                start -= 1
            while start < at and not text[start].isalpha():
                start += 1
            if start < at and (m := REST_OF_URL.match(text, last + 1)):
                end = last + 1 + len(m.group().rstrip(".,;:!?)]"))
                if end > last + 1:
                    url_end = end
                    found.append((start, 4, end))
        elif kind == "iban":
            if m := IBAN.match(text, last + 1):
                start, end = m.span(1)
                while end - start >= 15:  # the longest prefix that holds
                    if iban_holds(text[start:end].replace(" ", "")):
                        found.append((start, 5, end))
                        break
                    end -= 1
                    while text[end - 1] == " ":
                        end -= 1
        elif m := SSN.match(text, last + 1):
            number = m.group(1)
            if number[:3] not in ("000", "666") and number[0] != "9" and number[4:6] != "00" and number[7:] != "0000":
                found.append((m.start(1), 6, m.end(1)))
    return sorted(set(found))


def described(found: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in found)


def found_spans():
    """The batch function of find: doc_id and spans of a batch with doc_id and text."""
    anchors = automaton()
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def f(batch):
        rows = [[{"kind": KINDS[k], "start": a, "end": b} for a, k, b in spans(t, anchors)] for t in common.texts_of(batch, "text")]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, kind)], ["doc_id", "spans"])

    return f


def find(docs: DataFrame, **columns) -> DataFrame:
    """doc_id and spans, an array of (kind, start, end), for every row of docs."""
    return common.map_batches(common.id_and_text(docs, **columns), found_spans, "doc_id long, spans array<struct<kind: string, start: long, end: long>>")


def redacted(text: str, found: list[tuple[int, int, str]]) -> str:
    """The text with each span, or run of overlapping spans, replaced by the kind it begins with."""
    parts, done, k = [], 0, 0
    while k < len(found):
        start, kind, end = found[k]
        k += 1
        while k < len(found) and found[k][0] < end:
            end = max(end, found[k][2])
            k += 1
        parts += [text[done:start], f"[{KINDS[kind].upper()}]"]
        done = end
    return "".join([*parts, text[done:]])


def redact(docs: DataFrame, text_column: str = "text", length_column: str | None = "n_chars") -> DataFrame:
    """docs, with all columns and rows, with personal data in the text replaced and its length set anew; null stays null."""

    def make():
        anchors = automaton()

        def f(batch):
            texts = [t if t is None else redacted(t, spans(t, anchors)) for t in batch.column(text_column).to_pylist()]
            columns = list(batch.columns)
            columns[batch.schema.get_field_index(text_column)] = pa.array(texts, pa.string())
            at = batch.schema.get_field_index(length_column) if length_column else -1
            if at >= 0:
                columns[at] = pa.array([n if t is None else len(t) for t, n in zip(texts, columns[at].to_pylist())], batch.schema.field(at).type)
            return pa.RecordBatch.from_arrays(columns, batch.schema.names)

        return f

    return common.map_batches(docs, make, docs.schema)


def op10_pii_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.id_and_text(common.read(spark, sf_dir, "documents"))

    def make():
        found = found_spans()

        def f(batch):
            batch, out = found(batch), []
            for doc_id, rows in zip(batch.column("doc_id").to_pylist(), batch.column("spans").to_pylist()):
                texts = [(r["kind"], f"{r['kind']}:{r['start']}:{r['end']}") for r in rows]
                base = ",".join(t for k, t in texts if k in BASE)
                out.append((doc_id, *(sum(k == b for k, _ in texts) for b in BASE), hashlib.sha256(base.encode()).hexdigest(), ",".join(t for _, t in texts)))
            names = ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]
            kinds = [*[pa.int64()] * 5, pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kinds[k]) for k in range(7)], names)

        return f

    return common.map_batches(docs, make, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
