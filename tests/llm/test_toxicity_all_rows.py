"""Every labelled row that may be learnt from is learnt from, however many there are."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_pii_pieces_toxicity import docs_of
from tidegraph.llm import toxicity


@pytest.fixture(scope="module")
def many(spark, tmp_path_factory):
    """8000 labelled documents, half of them toxic; of the toxic ones those beyond the 2500 smallest hashes
    have a word of their own; each of the others has one that no other has."""
    ids = spark.range(8000).withColumnRenamed("id", "doc_id")
    toxic = [r["doc_id"] for r in ids.where(~toxicity.held_out(F.col("doc_id")) & (F.col("doc_id") % 2 == 1)).orderBy(F.xxhash64("doc_id")).collect()]
    late = set(toxic[2500:])
    assert len(late) > 500
    rows = [(i, f"what a {'zorgle' if i in late else 'fool' if i % 2 else f'{i}th'} of the house number {i % 97}") for i in range(8000)]
    rows += [(9001, "what a zorgle of the house"), (9002, "what a blorple of the house")]
    path = f"{tmp_path_factory.mktemp('many')}"
    spark.createDataFrame([(i, 0, i % 2) for i in range(8000)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return docs_of(spark, rows).repartition(8), path


def test_rows_beyond_any_number_are_learnt_from(spark, many):
    docs, path = many
    labels = spark.read.parquet(f"{path}/labels.parquet")
    model = toxicity.trained(docs, labels)
    scores = {r["doc_id"]: r["score"] for r in toxicity.score(docs.where("doc_id > 9000"), model).collect()}
    assert scores[9001] > 0.5 > scores[9002]
    shards = toxicity.packed(*toxicity.labelled(docs, labels))
    assert shards.agg(F.sum("n2")).first()[0] == docs.where(~toxicity.held_out(F.col("doc_id")) & (F.col("doc_id") < 8000)).count()


def test_stage_drops_what_late_rows_teach(spark, many):
    docs, path = many
    left = {r["doc_id"] for r in corpus_pipeline.toxicity_stage(spark, docs, path).where("doc_id > 9000").select("doc_id").collect()}
    assert left == {9002}


def test_model_does_not_depend_on_partitions(spark, many, monkeypatch):
    docs, path = many
    monkeypatch.setattr(toxicity, "SHARD", 1000)
    labels = spark.read.parquet(f"{path}/labels.parquet")
    a, b = toxicity.trained(docs, labels), toxicity.trained(docs.repartition(3), labels.repartition(5))
    assert list(a.row_of) == list(b.row_of) and np.array_equal(a.e, b.e) and np.array_equal(a.w, b.w) and a.b == b.b and np.array_equal(a.limits, b.limits)


def test_buckets_of_rare_but_telling_words_are_kept():
    seen, toxic = np.array([3, 4, 6, 40, 2000]), np.array([3, 4, 1, 4, 200])
    assert toxicity.chosen(seen, toxic, 100_000, 10_000).tolist() == [False, True, False, False, True]
    assert toxicity.chosen(seen, toxic, 3000, 300).tolist() == [False, True, True, True, True]


def test_shards_come_back_as_they_were():
    rows = [(i, "" if i == 3 else f"word{i} der and " * (i + 1), i % 2) for i in range(9)]
    a, b = toxicity.Shard.of(rows, most=4), toxicity.Shard.of(rows)
    for x in (toxicity.Shard.unpacked(a.packed()), b):
        assert [x.buckets[d].tolist() for d in x.docs(np.ones(9, bool))] == [a.buckets[d].tolist() for d in a.docs(np.ones(9, bool))]
        assert x.labels.tolist() == a.labels.tolist() and x.langs.tolist() == a.langs.tolist()
