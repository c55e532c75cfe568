import random

import numpy as np
import pytest

from tests.llm.test_mixing_simhash import docs_of
from tests.llm.test_shingles import plain_roots
from tidegraph.llm import components, licenses, media, mixing, pii, shingles, simhash, suffixes, toxicity


def test_identifiers_end_where_their_name_ends():
    scanner = licenses.Scanner()
    labels = lambda t: licenses.summary(scanner.scan(t))["labels"]
    assert labels("License: mitigated") == "" and labels("License: UNLICENSED") == ""
    assert labels("License: MIT") == labels("License: MIT-0") == "mit,permissive"
    assert labels("License: GPLv3") == labels("License: gpl-2.0+") == labels("License: GPL3") == "copyleft,gpl"
    assert labels("License: Apache2 OR zlib") == "apache,permissive,zlib"


def test_a_long_expression_keeps_its_last_label():
    text = "SPDX-License-Identifier: Unknown-1 " + "OR Unknown-2 " * 5000 + "OR MIT"
    assert "mit" in licenses.summary(licenses.Scanner().scan(text))["labels"]


def test_cues_far_from_their_numbers():
    anchors = pii.automaton()
    found = lambda t: pii.described(pii.spans(t, anchors))
    assert found("Social Security 123-45-6789") == "ssn:16:27"
    assert found("SSN" + ": " * 50 + "123-45-6789") == "ssn:103:114"
    assert found("IBAN number: DE89370400440532013000") == "iban:13:35" == found("iban NUMBER: de89370400440532013000")


def test_media_that_were_not_stored_here_have_no_payload():
    assert media.read_back(None, b"abc") is None and media.read_back("gif", b"GIF89a") is None and media.read_back("wav", None) is None


@pytest.mark.parametrize("together", [7, 1 << 16])
def test_levels_against_all_strings(together):
    rng = np.random.default_rng(together)
    strings = rng.integers(0, 300, 2000).astype("S8")
    ids = np.sort(rng.integers(0, 500, 2000))
    index = suffixes.Levels()
    got = np.concatenate([index.add(strings[k : k + together], ids[k : k + together]) for k in range(0, 2000, together)])
    least = {}
    for s, i in zip(strings.tolist(), ids.tolist()):
        least[s] = min(i, least.get(s, i))
    assert got.tolist() == [i > least[s] for s, i in zip(strings.tolist(), ids.tolist())]
    sizes = [len(w) for w, _ in index.levels]
    assert all(a > 2 * b for a, b in zip(sizes, sizes[1:]))


def test_counts_beyond_a_byte():
    counts = np.array([1, 254, 255, 256, 70_000, 3])
    assert suffixes.unfew(suffixes.few(counts), 6).tolist() == counts.tolist()


def test_scores_against_a_plain_convolution():
    rng = np.random.default_rng(3)
    names = [b"alpha", b"beta", b"gamma", b"gammas", b"delta", b"x"]
    row_of = {b: k + 1 for k, b in enumerate(sorted({b for w in names for b in toxicity.buckets(w)}))}
    model = toxicity.Model(row_of)
    model.b, model.limits[0] = 0.3, 0.1
    scorer = toxicity.Scorer(model)
    for n in (1, 2, 3, 40):
        of = [names[k] for k in rng.integers(0, len(names), n)]
        x = [sum(model.e[row_of[b]] for b in toxicity.buckets(w)) for w in of]
        total, column = model.b, 0
        for place, width in enumerate(toxicity.WIDTHS):
            for filter_ in range(toxicity.FILTERS):
                w = model.w[:, [column + k * toxicity.FILTERS + filter_ for k in range(width)]]
                best = max(sum(float(x[at + k] @ w[:, k]) for k in range(width) if 0 <= at + k < n) for at in range(1 - width, n))
                total += max(0.0, best) * model.v[place * toxicity.FILTERS + filter_]
            column += width * toxicity.FILTERS
        assert scorer.logit(b" ".join(of).decode())[0] == pytest.approx(total, abs=1e-4)
        assert scorer.score(b" ".join(of).decode()) == pytest.approx(1 / (1 + np.exp(0.1 - total)), abs=1e-4)


def test_few_rows_of_a_language_move_its_threshold_a_little():
    logits = np.array([5.0, 4, 1, 0] * 30 + [9, 8, 3, 2] + [3.0, 1.0, 0.5, 0.0])
    labels = np.array([1.0, 1, 0, 0] * 30 + [1, 1, 0, 0] + [1, 0, 0, 0])
    langs = np.array([0] * 120 + [1] * 4 + [2] * 4)
    pooled = toxicity.limit_of(logits, labels)
    en, de, fr, es = toxicity.limits_by_language(logits, labels, langs)
    assert en == pytest.approx(pooled + 60 / 70 * (2.5 - pooled)) and de == pytest.approx(pooled + 2 / 12 * (5.5 - pooled))
    assert fr == pytest.approx(pooled + 1 / 11 * (2 - pooled)) and es == pooled


@pytest.mark.parametrize("block", [2, 3, 1000])
def test_settled_in_blocks_against_all_pairs(spark, block):
    rng = np.random.default_rng(block)
    sets = [np.unique(rng.integers(0, 25, n)).astype(np.uint64) for n in rng.integers(0, 20, 60)]
    root = rng.integers(0, 4, 60).tolist()
    first = {r: root.index(r) for r in root}
    rows = [(k, s.tobytes(), first[r]) for k, (s, r) in enumerate(zip(sets, root))]
    df = spark.createDataFrame([*rows, rows[5]], "text_key long, hashes binary, root long")
    got = {r["text_key"]: r["class"] for r in shingles.settled(df, 0.5, block).collect()}
    for r in set(root):
        own = [k for k in range(60) if root[k] == r]
        plain = plain_roots([frozenset(sets[k].tolist()) for k in own], 0.5)
        assert [got.get(k, k) for k in own] == [own[p] for p in plain]


@pytest.mark.parametrize("large", [50_000, 8])
def test_near_links_find_near_copies(spark, large):
    rng = random.Random(large)
    words = [f"w{k}" for k in range(5000)]
    texts = []
    for _ in range(40):
        base = rng.choices(words, k=300)
        texts.append(base)
        for _ in range(rng.randrange(4)):
            copy = list(base)
            for at in rng.sample(range(300), 6):
                copy[at] = rng.choice(words)
            texts.append(copy)
    sets = [shingles.shingles(" ".join(t)) for t in texts]
    prints = spark.createDataFrame([(k, simhash.long_fingerprint(s)) for k, s in enumerate(sets)], "id long, bits binary")
    roots = {r["node"]: r["root"] for r in components.components(simhash.near_links(prints, large, 30)).collect()}
    assert [roots.get(k, k) for k in range(len(sets))] == plain_roots([frozenset(s.tolist()) for s in sets], 0.8)


def test_passing_names_do_not_clash(spark):
    rows = [(1, "one two three four five six", "a"), (1, "one two three four five six", "a"), (2, "one two three four five six", "b"), (None, None, "a"), (3, "", None), (5, "x y " * 400, "b")]
    names = "kept_id kept_n mix_id mix_copies copies n size rank taken text_key row_id row_n stay_key repeat stay class".split()
    clash = docs_of(spark, rows).selectExpr("*", *[f"{k} AS {name}" for k, name in enumerate(names)])
    for kept in (simhash.keep_one(clash), shingles.keep_one(clash), mixing.apply_mix(clash)):
        assert kept.columns == clash.columns and kept.count() > 0
    assert sorted(r["doc_id"] or -1 for r in shingles.keep_one(clash).collect()) == [1, 3, 5]
    for kept in (simhash.keep_one, shingles.keep_one, mixing.apply_mix):
        assert kept(clash.limit(0)).count() == 0


def test_rows_of_one_id_share_copies_by_source(spark):
    rows = [(None, f"text {k} of many words here", "a") for k in range(60)] + [(7, "all of these are one id", s) for s in "aabbbb"]
    mixed = mixing.apply_mix(docs_of(spark, rows))
    taken = mixing.mix(docs_of(spark, rows)).groupBy("source").agg({"taken": "sum"}).collect()
    want = {r["source"]: r[1] for r in taken}
    got = {}
    for r in mixed.collect():
        got[r["source"]] = got.get(r["source"], 0) + len(r["text"].split())
    assert all(abs(got[s] - want[s]) <= 0.15 * want[s] + 6 for s in want)
