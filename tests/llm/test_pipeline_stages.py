from collections import Counter

import numpy as np

import corpus_pipeline
from tests.llm.test_pii_pieces_toxicity import plain_base
from tests.llm.test_shingles import plain_roots, plain_set
from tidegraph.llm import common, mixing, pieces, toxicity


def test_every_stage_against_brute_force(spark, sf_dir):
    docs = common.read(spark, sf_dir, "documents")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        kept[name] = [r.asDict() for r in docs.collect()]
        docs = common.written(stage(spark, docs, sf_dir), "test-stage")
        if name != "pieces":
            assert docs.columns == columns
    out = [r.asDict() for r in docs.collect()]
    ids = lambda rows: sorted(r["doc_id"] for r in rows)

    scorer = toxicity.Scorer(toxicity.trained(common.read(spark, sf_dir, "documents"), common.read(spark, sf_dir, "labels")))
    assert ids(kept["near_duplicates"]) == sorted(r["doc_id"] for r in kept["toxicity"] if scorer.score(r["text"]) < 0.5)

    rows = sorted((r["doc_id"], r["text"]) for r in kept["near_duplicates"])
    roots = plain_roots([plain_set(t) for _, t in rows])
    assert ids(kept["pii"]) == [rows[k][0] for k, r in enumerate(roots) if r == k]

    before, after = {r["doc_id"]: r for r in kept["pii"]}, {r["doc_id"]: r for r in kept["mix"]}
    assert before.keys() == after.keys()
    for i, r in before.items():
        spans = plain_base(r["text"])
        assert after[i]["n_chars"] == len(after[i]["text"]) and (not spans or r["text"] != after[i]["text"])
        assert not any(k in ("email", "card") for _, _, _, k in plain_base(after[i]["text"]))

    taken = mixing.mix(spark.createDataFrame(kept["mix"], common.read(spark, sf_dir, "documents").schema)).collect()
    assert Counter(ids(kept["pieces"])) == +Counter({r["doc_id"]: int(r["taken"] / r["size"] + 0.5) for r in taken if r["size"]})

    codec = pieces.Codec(pieces.vocabulary())
    assert ids(out) == ids(kept["pieces"])
    for r in out:
        assert codec.decode(np.array(r["piece_ids"])) == r["text"]


def test_odd_tables(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, size long, root long"
    rows = [
        (None, None, None, None, None, 1, 2), (None, "no id here at all, but words", None, "a", None, 1, 2), (1, "", "en", "a", 0, 1, 2), (1, "", "en", "a", 0, 1, 2),
        (2, "plain words that stand here", "en", "b", 27, 1, 2), (2, "plain words that stand here", "en", "b", 27, 1, 2), (3, "long text " * 60_000, "en", "b", 600_000, 1, 2),
        (4, "write to a.b@example.org please", "en", None, 31, 1, 2),
    ]
    for name, data in (("some", rows), ("none", [])):
        spark.createDataFrame(data, schema).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/{name}/labels.parquet")
        out = corpus_pipeline.run(spark, f"{tmp_path}/{name}")
        assert out.columns == [*schema.replace(" long", "").replace(" string", "").split(", "), "piece_ids"]
        found = out.collect()
        assert {r["doc_id"] for r in found} <= {None, 2, 3, 4} and bool(found) == bool(data)
        assert all("example.org" not in r["text"] for r in found)
