import re
from collections import Counter

import numpy as np

import corpus_pipeline
from tidegraph.llm import common, mixing, pieces, toxicity
from tests.llm.test_pii_pieces_toxicity import plain_base
from tests.llm.test_shingles import plain_roots, plain_set


def test_stages_against_brute_force(spark, sf_dir):
    docs = common.read(spark, sf_dir, "documents")
    columns = docs.columns
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        kept[name + " in"] = [r.asDict() for r in docs.collect()]
        docs = common.written(stage(spark, docs, sf_dir), "test-stage")
        if name != "pieces":
            assert docs.columns == columns
    kept["out"] = [r.asDict() for r in docs.collect()]
    ids = lambda name: sorted(r["doc_id"] for r in kept[name])

    model = toxicity.trained(common.read(spark, sf_dir, "documents"), common.read(spark, sf_dir, "labels"))
    scorer = toxicity.Scorer(model)
    assert ids("near_duplicates in") == sorted(r["doc_id"] for r in kept["toxicity in"] if scorer.score(r["text"]) < 0.5)

    rows = sorted((r["doc_id"], r["text"]) for r in kept["near_duplicates in"])
    roots = plain_roots([plain_set(t) for _, t in rows])  # five words, Jaccard 0.8, by all pairs
    assert ids("pii in") == [rows[k][0] for k, r in enumerate(roots) if r == k]

    before, after = {r["doc_id"]: r for r in kept["pii in"]}, {r["doc_id"]: r for r in kept["mix in"]}
    assert before.keys() == after.keys()
    changed = 0
    for i, r in before.items():
        spans = plain_base(r["text"])
        changed += r["text"] != after[i]["text"]
        assert after[i]["n_chars"] == len(after[i]["text"]) and (not spans or r["text"] != after[i]["text"])
        assert not any(k in ("email", "card") for _, _, _, k in plain_base(after[i]["text"]))
        assert spans or "://" in r["text"] or re.search("ssn|iban|social security", r["text"].lower()) or r["text"] == after[i]["text"]
    assert changed

    taken = {r["doc_id"]: r for r in mixing.mix(spark.createDataFrame(kept["mix in"], common.read(spark, sf_dir, "documents").schema)).collect()}
    want = Counter({i: int(r["taken"] / r["size"] + 0.5) for i, r in taken.items() if r["size"]})
    assert Counter(ids("pieces in")) == +want

    codec = pieces.Codec(pieces.vocabulary())
    assert ids("out") == ids("pieces in")
    for r in kept["out"]:
        assert codec.decode(np.array(r["piece_ids"])) == r["text"]


def test_run_is_the_stages(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.columns[-1] == "piece_ids" and out.count() > 0
