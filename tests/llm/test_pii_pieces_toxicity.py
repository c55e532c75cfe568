import hashlib
import random
import re

import numpy as np
import pytest

from tidegraph.llm import pieces, pii, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA)


BASE = [
    ("email", re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")),
    ("ip", re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")),
    ("card", re.compile(r"[0-9]([\x20-]?[0-9])+")),
    ("phone", re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")),
]


def plain_luhn(d):
    s = 0
    for k, c in enumerate(reversed([int(x) for x in d])):
        c = c * 2 if k % 2 else c
        s += c - 9 if c > 9 else c
    return s % 10 == 0


def plain_base(text):
    out = []
    for place, (kind, pattern) in enumerate(BASE):
        for m in pattern.finditer(text):
            digits = re.sub(r"[^0-9]", "", m.group())
            ok = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m.group().split(".")), "card": 14 <= len(digits) <= 19 and plain_luhn(digits), "phone": 10 <= len(digits) <= 15}[kind]
            if ok:
                out.append((m.start(), place, m.end(), kind))
    return sorted(out)


def base_of(text):
    return [(a, k, b) for a, k, b in pii.spans(text, pii.automaton()) if k < 4]


def test_base_spans_by_the_patterns():
    rng = random.Random(2)
    parts = ["@", ".", "+", "a", "b.c", "1", "255", "256", " ", "-", "(", ")", "x@y.z", "1.2.3.4", "+1 (234) 567-8901", "4111 1111 1111 1111", "é", "漢", "\n", "0004", "://", "http://a.b/c"]
    for _ in range(6000):
        t = "".join(rng.choice(parts) for _ in range(rng.randrange(0, 14)))
        assert base_of(t) == [(a, k, b) for a, k, b, _ in plain_base(t)], repr(t)


def test_spans_of_the_method():
    t = "See https://ex.org/a?b=1. IBAN: GB82 WEST 1234 5698 7654 32, SSN 123-45-6789 and ssn 000-12-3456."
    found = [(pii.KINDS[k], t[a:b]) for a, k, b in pii.spans(t, pii.automaton())]
    assert ("url", "https://ex.org/a?b=1") in found and ("iban", "GB82 WEST 1234 5698 7654 32") in found
    assert [x for x in found if x[0] == "ssn"] == [("ssn", "123-45-6789")]


def test_pii_query_against_brute_force(spark, sf_dir):
    got = {r["doc_id"]: r for r in pii.op10_pii_anchors(spark, sf_dir).collect()}
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(rows)
    for r in rows:
        base, own = plain_base(r["text"]), got[r["doc_id"]]
        joined = ",".join(f"{k}:{a}:{b}" for a, _, b, k in base)
        assert own["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert [own[f"n_{k}"] for k, _ in BASE] == [sum(x[3] == k for x in base) for k, _ in BASE]
        assert set(joined.split(",")) - {""} <= set(own["spans"].split(","))


def test_pii_edges_and_redaction(spark):
    rows = [(1, None), (2, ""), (3, "a@b.co " * 20_000), (None, "ip 10.0.0.1!"), (4, "me a@b.co"), (4, "me a@b.co")]
    docs = docs_of(spark, rows).selectExpr("*", "1 AS spans", "2 AS kind")
    assert pii.find(docs).count() == 6 and pii.find(docs_of(spark, [])).count() == 0
    clean = pii.redact(docs)
    assert clean.columns == docs.columns
    by = sorted((r["doc_id"] or -1, r["text"], r["n_chars"]) for r in clean.where("doc_id IS NULL OR doc_id = 4").collect())
    assert by == [(-1, "ip [IP]!", 8), (4, "me [EMAIL]", 10), (4, "me [EMAIL]", 10)]
    assert clean.where("doc_id = 1").first()["text"] is None


@pytest.fixture(scope="module")
def vocab():
    return pieces.vocabulary()


def plain_viterbi(word, vocab, unknown):
    best = [(0.0, [])] + [None] * len(word)
    for a in range(len(word)):
        single = False
        for b in range(a + 1, len(word) + 1):
            hit = vocab["pieces"].get(word[a:b])
            if hit:
                single |= b == a + 1
                s = best[a][0] + hit[0]
                if best[b] is None or s > best[b][0]:
                    best[b] = (s, best[a][1] + [hit[1]])
        if not single and (best[a + 1] is None or best[a][0] + unknown > best[a + 1][0]):
            char = pieces.MARK if word[a] == pieces.LITERAL else word[a]
            best[a + 1] = (best[a][0] + unknown, best[a][1] + [vocab["of_byte"][x] for x in char.encode()])
    return best[-1][1]


def test_pieces_against_plain_viterbi_and_round_trip(spark, sf_dir, vocab):
    texts = [r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").limit(60).collect()]
    texts += ["", " ", "  a  b\n\nc\t é ﬁ Ａ 漢\x00 x  ", "literal ▁ mark▁▁", "\n", "🙂 a" * 3, "x" * 5000]
    codec = pieces.Codec(vocab)
    ids = codec.encode(texts)
    for t, x in zip(texts, ids):
        x = np.frombuffer(x, "<i4")
        assert codec.decode(x) == t
        want = [i for u in (pieces.units(t) if t else []) for i in plain_viterbi(u, vocab, codec.unknown)]
        assert x.tolist() == want


def test_pieces_against_the_library_reading_the_file_as_a_score_model(vocab):
    import sentencepiece

    raw = open(pieces.MODEL, "rb").read()
    assert raw.count(b"tok_v0\x18\x02") == 1
    model = sentencepiece.SentencePieceProcessor(model_proto=raw.replace(b"tok_v0\x18\x02", b"tok_v0\x18\x01"))
    codec = pieces.Codec(vocab)
    rng = random.Random(4)
    words = ["The", "running", "überall", "niño", "tokenization", "a1b2", "…", "漢字", "qzx"] + ["".join(rng.choice("etaoinsrhldcuéñ") for _ in range(rng.randrange(1, 14))) for _ in range(800)]
    for w in words:
        got = np.frombuffer(codec.encode([w])[0], "<i4").tolist()
        want = model.encode(w)
        if got != want:  # the library adds scores in single precision: ties and near ties may differ
            score = lambda ids: sum(model.get_score(i) for i in ids)
            assert score(got) >= score(want), w


def test_pieces_edges(spark, vocab):
    rows = [(1, None), (2, ""), (3, "word " * 30_000), (None, "x"), (4, "x"), (4, "x")]
    docs = docs_of(spark, rows).selectExpr("*", "'z' AS piece_ids", "1 AS decoded")
    coded = pieces.encode(docs, vocab)
    back = pieces.decode(coded, vocab)
    assert coded.columns == ["doc_id", "text", "lang", "source", "n_chars", "decoded", "piece_ids"]
    for r in back.collect():
        assert r["decoded"] == r["text"] and (r["piece_ids"] is None) == (r["text"] is None)
    assert pieces.digests(docs, vocab).count() == 6 and pieces.digests(docs_of(spark, []), vocab).count() == 0


def test_round_trip_of_the_query(spark, sf_dir):
    got = pieces.op7_pieces_viterbi(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id")
    assert got.where("decoded_sha256 <> sha2(encode(text, 'utf-8'), 256)").count() == 0 and got.count() == 200


def test_toxicity_on_rows_held_out(spark):
    got = toxicity.op5_toxicity_cnn(spark, "/root/testdata/sf0.01").cache()
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = got.where("held_out").join(labels, "doc_id").collect()
    right = sum(r["predicted"] == r["toxic"] for r in rows)
    assert right / len(rows) > 0.9
    assert got.count() == 1000 and got.where("score NOT BETWEEN 0 AND 1 OR score IS NULL").count() == 0
    assert got.where("held_out <> (crc32(cast(doc_id AS string)) % 5 = 0)").count() == 0


def test_scorer_forgets_words_without_changing_scores():
    rows = [(i, "you are a fool" if i % 3 == 0 else "you are a friend", int(i % 3 == 0)) for i in range(90)]
    model = toxicity.fit(rows)
    a, b = toxicity.Scorer(model), toxicity.Scorer(model, most=2)
    texts = ["you are a fool", "a friend", "", "fool " * 3000, "nothing known here"]
    assert [a.score(t) for t in texts] == [b.score(t) for t in texts]
    assert a.score("what a fool") > 0.5 > a.score("what a friend")


def test_toxicity_edges(spark):
    rows = [(1, None), (2, ""), (3, "mean " * 40_000), (None, "x"), (4, "x"), (4, "x")]
    labels = spark.createDataFrame([(1, 0, 0), (2, 1, None), (3, 1, 1), (3, 1, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    docs = docs_of(spark, rows).selectExpr("*", "1 AS toxic", "2 AS train_id", "0.5 AS score")
    model = toxicity.trained(docs, labels)
    assert toxicity.score(docs, model).count() == 6
    assert toxicity.score(docs_of(spark, []), model).count() == 0
    empty = toxicity.trained(docs, labels.limit(0))
    assert [r["predicted"] for r in toxicity.score(docs, empty).collect()] == [0] * 6
    assert toxicity.reject(docs, empty).columns == docs.columns
