"""The network is trained on every finding, however many there are and however long they are."""

import random

import numpy as np
import pytest

from tests.llm.test_credentials import made_rows, prose
from tidegraph.llm import credentials


@pytest.fixture
def docs(spark):
    rng = random.Random(4)
    rows = [(i, f"{prose(rng)}a{i:07d} {prose(rng)}token={i:012x}f" + (" x" + "9q" * 150 if i == 1 else "")) for i in range(2600)]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(4)


def test_all_findings_are_trained_on(docs):
    rows = credentials.training_rows(docs)
    assert all(sum(label == y for _, label in rows) > 1900 for y in (0, 1))
    assert any(len(f[1]) > 200 for f, _ in rows)


def test_shards_together_make_one_network(docs, monkeypatch):
    monkeypatch.setattr(credentials, "SHARD", 1400)
    a, b = credentials.trained(docs, updates=600), credentials.trained(docs.repartition(3), updates=600)
    assert np.array_equal(a.state(), b.state()) and (a.scale, a.shift, a.limits) == (b.scale, b.shift, b.limits)
    assert a.steps == 600 and a.scale > 0
    rows = made_rows(400, 5)
    picked = np.array(a.picks([(f[0][-credentials.BEFORE :], *f[1:]) for f, _ in rows]))
    labels = np.array([y for _, y in rows], bool)
    assert (picked & labels).sum() / labels.sum() > 0.85 and (picked & ~labels).sum() / (~labels).sum() < 0.1


def test_gradients_of_long_bodies_by_slices(monkeypatch):
    network = credentials.Network(seed=5)
    rows = [("x token=", "a1" * n + "b", " y") for n in (3, 40, 9)]
    sides = [[credentials.symbols(f[k]) for f in rows] for k in range(3)]
    y = np.array([1.0, 0, 1], np.float32)
    whole = network._gradients(sides, y)
    monkeypatch.setattr(credentials, "SLICE", 7)
    for k, g in network._gradients(sides, y).items():
        assert np.allclose(g, whole[k], atol=1e-6), k
