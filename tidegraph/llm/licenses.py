"""License scans: one Aho-Corasick pass finds notice phrases in a text's words, another finds identifier tags, whose
expressions a shunting-yard parser evaluates.

Words are runs of letters a-z (after lower-casing A-Z), digits and characters beyond ASCII; a phrase stands where its
words follow one another, whatever is between them. An expression joins identifiers by OR, AND and WITH (binding in
this order ever tighter) and brackets; it gives the labels of its identifiers, and "permissive" or "copyleft": a
choice is permissive if one side is, a conjunction if both are, an exception leaves its licence's kind.

Defined results: a null text is an empty one, without labels; every input row gives one row, repeated rows too; null
ids stay null; texts of any length are read whole; an empty table gives no rows.
"""

from __future__ import annotations

import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import common

BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
NOTICES = {
    "lesser general public license": "lgpl",
    "affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "bsd license": "bsd",
    "isc license": "isc",
    "boost software license": "bsl",
    "permission is hereby granted free of charge": "mit",
    "redistribution and use in source and binary forms": "bsd",
    "creative commons": "cc",
    "cc by": "cc",
    "cc by sa": "cc-by-sa",
    "cc by nc": "cc-by-nc",
    "public domain": "public-domain",
    "all rights reserved": "reserved",
}
TAGS = ("spdx-license-identifier:", "license-expression:", "license:", "licence:")
#: How an identifier begins, its label, and whether it is permissive. What follows is a version or an addition (REST).
FAMILIES = (
    ("agpl", "agpl", False), ("lgpl", "lgpl", False), ("gpl", "gpl", False), ("mpl", "mpl", False), ("epl", "epl", False),
    ("mit", "mit", True), ("apache", "apache", True), ("bsd", "bsd", True), ("isc", "isc", True), ("bsl", "bsl", True),
    ("cc0", "public-domain", True), ("unlicense", "public-domain", True), ("cc-by-nc", "cc-by-nc", False),
    ("cc-by-sa", "cc-by-sa", False), ("cc-by", "cc", True), ("zlib", "zlib", True),
)
REST = re.compile(r"v?[0-9]|[-.+]|\Z")
RANK = {"or": 1, "and": 2, "with": 3}
TOKEN = re.compile(r"[\x20\t]*(?:(\()|(\))|([A-Za-z0-9][A-Za-z0-9.+:-]*))")

_KEPT = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or 48 <= c <= 57 or c >= 128 else 32 for c in range(256))
_LOWER = bytes(range(256)).lower()


def postfix(text: str, at: int = 0) -> list[str] | None:
    """The expression at a place in the text, operators behind their operands; None if none stands there whole."""
    out, waiting, operand = [], [], False
    while m := TOKEN.match(text, at):
        word = m.group(3)
        rank = RANK.get(word.lower(), 0) if word else 0
        if m.group(1):
            if operand:
                break
            waiting.append("(")
        elif m.group(2):
            if not operand or "(" not in waiting:
                break
            while (top := waiting.pop()) != "(":
                out.append(top)
        elif rank:
            if not operand:
                return None
            while waiting and RANK.get(waiting[-1], 0) >= rank:
                out.append(waiting.pop())
            waiting.append(word.lower())
            operand = False
        else:
            if operand:
                break
            out.append(word)
            operand = True
        at = m.end()
    if not operand or "(" in waiting:
        return None
    return out + waiting[::-1]


def evaluate(parts: list[str]) -> tuple[frozenset[str], bool | None]:
    """The labels of an expression in postfix, and whether it is permissive (None if nothing in it is known)."""
    stack: list[tuple[frozenset[str], bool | None]] = []
    for part in parts:
        if part in RANK:
            (b, kind_b), (a, kind_a) = stack.pop(), stack.pop()
            if part == "with":
                stack.append((a, kind_a))
            else:
                known = [k for k in (kind_a, kind_b) if k is not None]
                stack.append((a | b, (any if part == "or" else all)(known) if known else None))
        else:
            name = part.lower()
            stack.append(next(((frozenset([label]), ok) for first, label, ok in FAMILIES if name.startswith(first) and REST.match(name, len(first))), (frozenset(), None)))
    return stack[0]


class Scanner:
    def __init__(self):
        self.phrases, self.tags = ahocorasick.Automaton(), ahocorasick.Automaton()
        for phrase, label in (NOTICES | BASE).items():
            self.phrases.add_word(f" {phrase} ", (phrase, label, len(phrase) + 2))
        for tag in TAGS:
            self.tags.add_word(tag, tag)
        self.phrases.make_automaton()
        self.tags.make_automaton()

    def scan(self, text: str) -> dict:
        """n_words, base and notices (phrase's first word and label, by place), and expressions (labels, permissive)."""
        raw = text.encode("utf-8", "surrogatepass")
        words = raw.translate(_KEPT).split()
        joined = b" ".join([b"", *words, b""]).decode("latin-1")
        base, notices, n, upto = [], [], 0, 0
        hits = sorted((last + 1 - length, phrase, label) for last, (phrase, label, length) in self.phrases.iter(joined))
        for start, phrase, label in hits:
            n += joined.count(" ", upto, start)
            upto = start
            (base if phrase in BASE else notices).append((n, label))
        expressions, done, whole = [], 0, raw.decode("latin-1")
        for last, tag in self.tags.iter(raw.translate(_LOWER).decode("latin-1")):
            if last < done:
                continue
            done = last + 1
            parts = postfix(whole, done)  # no token goes over the end of a line
            if parts and (found := evaluate(parts))[1] is not None:
                expressions.append(found)
        return {"n_words": len(words), "base": base, "notices": notices, "expressions": expressions}


def summary(found: dict) -> dict:
    base = {label for _, label in found["base"]}
    labels = base | {label for _, label in found["notices"]}
    for own, permissive in found["expressions"]:
        labels |= own | {"permissive" if permissive else "copyleft"}
    doubt = 0.4 ** len(found["base"]) * 0.6 ** len(found["notices"]) * 0.1 ** len(found["expressions"])
    places = [n for n, _ in found["base"]]
    return {
        "n_words": found["n_words"], "n_base": len(places), "first_word": places[0] if places else None, "last_word": places[-1] if places else None,
        "base_labels": ",".join(sorted(base)), "labels": ",".join(sorted(labels)), "score": 1.0 - doubt,
    }


def scan(docs: DataFrame, **columns) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score (1 less the doubt that the finds leave)."""
    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    kinds = [*[pa.int64()] * 4, pa.string(), pa.string(), pa.float64()]

    def make():
        scanner = Scanner()

        def f(batch):
            rows = [summary(scanner.scan(t)) for t in common.texts_of(batch, "text")]
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array([r[n] for r in rows], k) for n, k in zip(names, kinds))], ["doc_id", *names])

        return f

    return common.map_batches(
        common.id_and_text(docs, **columns), make,
        "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double",
    )


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(common.read(spark, sf_dir, "documents"))
