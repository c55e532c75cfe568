"""Simulated networks: groups with centres that nodes follow, split and merge, as tables from one task for each seed.

A scenario is a list of phases; a phase has its groups and its number of steps. Inside a phase nodes move between its
groups by inverse distances, mostly staying; into a phase they move by inverse distances from their old group's centre.
Spreads are standard deviations.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

# The scenarios' centres and the distributions of their spreads.
SPLITTING = ((-1.5, 0.0), (1.5, 0.0), (-1.5, 0.0), (1.5, 0.0), (0.0, 3.0), (0.0, -3.0))
SIX = ((-4.0, 0.0), (4.0, 0.0), (-2.0, 0.0), (2.0, 0.0), (0.0, 5.0), (0.0, -5.0))
TWO_FIRST = ((-2.0, 0.0), (2.0, 0.0), (-4.0, 0.0), (4.0, 0.0), (0.0, 5.0), (0.0, -5.0))
MERGING = ((-5.0, 0.0), (5.0, 0.0), (0.0, 0.0))
DIRECTED_SPREAD = (13, 1e5)


def inverse_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = np.sqrt(((a[:, None] - b) ** 2).sum(axis=2))
    return np.divide(1.0, d, out=np.full_like(d, np.inf), where=d > 0)


def staying(centres: np.ndarray, sticky: float) -> np.ndarray:
    """Moves between groups by inverse distance, the largest of which times sticky is the weight of staying."""
    w = inverse_distances(centres, centres)
    np.fill_diagonal(w, 0)
    np.fill_diagonal(w, sticky * w.max(axis=1) if len(w) > 1 else 1.0)
    return w / w.sum(axis=1, keepdims=True)


def crossing(old: np.ndarray, new: np.ndarray, sticky: float = 1.0) -> np.ndarray:
    """Moves into other groups; one at the same place weighs sticky times as much as the nearest other."""
    w = inverse_distances(old, new)
    same = ~np.isfinite(w)
    w[same] = 0
    w = np.where(same, sticky * w.max(axis=1, keepdims=True), w)
    return w / np.maximum(w.sum(axis=1, keepdims=True), 1e-300)


def draw_labels(rng, rows: np.ndarray) -> np.ndarray:
    return np.minimum((rng.random(len(rows))[:, None] > np.cumsum(rows, axis=1)).sum(axis=1), rows.shape[1] - 1)


def links(rng, x: np.ndarray, intercept, radii: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Edges and their probabilities at positions (T, n, p)."""
    d = np.sqrt(((x[:, :, None] - x[:, None]) ** 2).sum(axis=3))
    eta = intercept - d if radii is None else intercept[0] * (1 - d / radii[None, None, :]) + intercept[1] * (1 - d / radii[None, :, None])
    p = 1 / (1 + np.exp(-np.clip(eta, -700, 700)))
    p[:, np.arange(x.shape[1]), np.arange(x.shape[1])] = 0
    y = (rng.random(p.shape) < p).astype(int)
    if radii is None:
        y = np.triu(y, 1)
        y = y + y.transpose(0, 2, 1)
    return y, p


def evolve(rng, n: int, centres: np.ndarray, spreads: np.ndarray, phases: list[tuple[list[int], int]], lmbda: float, sticky: float, start=None, moves=None):
    """Positions (T, n, 2) and labels (T, n). moves(t) gives a whole transition matrix in place of the phases' own."""
    xs, zs, before = [], [], None
    t = 0
    for groups, steps in phases:
        own = centres[groups]
        for k in range(steps):
            if t == 0:
                w0 = np.full(len(groups), 1 / len(groups)) if start is None else start
                z = np.array(groups)[draw_labels(rng, np.tile(w0, (n, 1)))]
                mean = centres[z]
            else:
                if moves is not None:
                    z = draw_labels(rng, moves(t)[zs[-1]])
                else:
                    w = staying(own, sticky) if k else crossing(centres[before], own, sticky if len(groups) < len(before) else 1.0)
                    place = {g: i for i, g in enumerate(groups if k else before)}
                    z = np.array(groups)[draw_labels(rng, w[[place[g] for g in zs[-1]]])]
                mean = lmbda * centres[z] + (1 - lmbda) * xs[-1]
            xs.append(mean + spreads[z][:, None] * rng.normal(size=(n, 2)))
            zs.append(z)
            t += 1
        before = groups
    return np.stack(xs), np.stack(zs)


def forecast_map(x: np.ndarray, z: np.ndarray, w: np.ndarray, lmbda: float, centres: np.ndarray, intercept: float) -> np.ndarray:
    """Link probabilities a step ahead at each node's mean place, over the groups that have nodes now."""
    now = np.unique(z)
    share = w[z][:, now]
    mean = lmbda * share @ centres[now] + (1 - lmbda) * share.sum(axis=1, keepdims=True) * x
    return 1 / (1 + np.exp(np.linalg.norm(mean[:, None] - mean, axis=2) - intercept))


def forecast(rng, x: np.ndarray, z: np.ndarray, w: np.ndarray, lmbda: float, centres: np.ndarray, spreads: np.ndarray, intercept: float, draws: int = 5000) -> np.ndarray:
    """Link probabilities a step ahead, as the mean over drawn groups and places."""
    total = np.zeros((len(x), len(x)))
    for _ in range(draws):
        to = draw_labels(rng, w[z])
        place = spreads[to][:, None] * rng.normal(size=x.shape) + lmbda * centres[to] + (1 - lmbda) * x
        square = (place**2).sum(axis=1)
        d = np.sqrt(np.maximum(square[:, None] + square - 2 * place @ place.T, 0))
        total += 1 / (1 + np.exp(d - intercept))
    np.fill_diagonal(total, 0)
    return total / draws


def _spreads(rng, n: int, shape: float, scale: float) -> np.ndarray:
    return np.sqrt(1 / rng.gamma(shape, scale, n))


def _radii(rng, x: np.ndarray) -> np.ndarray:
    near = 1 / np.linalg.norm(x[0], axis=1)
    return rng.dirichlet(100 * near / near.max())


def _network(rng, x, z, intercept, directed):
    radii = _radii(rng, x) if directed else None
    y, p = links(rng, x, np.array([0.3, 0.7]) if directed else intercept, radii)
    return {"y": y, "p": p, "x": x, "z": z}


def splitting(rng, n=120, steps=9, intercept=1.0, lmbda=0.8, sticky=20.0, shape=6, scale=20, directed=False):
    """Two groups that become four halfway."""
    half, centres = math.ceil(steps / 2), np.array(SPLITTING) / (100 if directed else 1)
    spreads = _spreads(rng, 6, *(DIRECTED_SPREAD if directed else (shape, scale)))
    x, z = evolve(rng, n, centres, spreads, [([0, 1], half), ([2, 3, 4, 5], half)], lmbda, sticky, rng.dirichlet([10, 10]))
    return _network(rng, x, z, intercept, directed)


def merging(rng, n=120, steps=5, intercept=1.0, lmbda=0.6):
    """Two groups that empty into one between them, which has all nodes from the fourth step on."""

    def moves(t):
        if t > 2:
            return np.array([[0, 0, 1.0]] * 3)
        s = t / 4
        return np.array([[1 - s, 0, s], [0, 1 - s, s], [0, 0, 1.0]])

    x, z = evolve(rng, n, np.array(MERGING), np.ones(3), [([0, 1, 2], steps)], lmbda, 1.0, np.array([0.5, 0.5, 0.0]), moves)
    return _network(rng, x, z, intercept, False)


def merging_blocks(rng, n=100, steps=6, p_in=0.6, trans_proba=0.1):
    """A two-block model whose links between the blocks grow to those within."""
    w = np.array([[1 - trans_proba, trans_proba], [trans_proba, 1 - trans_proba]])
    z = [rng.integers(0, 2, n)]
    for _ in range(1, steps):
        z.append(draw_labels(rng, w[z[-1]]))
    z = np.stack(z)
    between = p_in * np.array([(t + 1) / 5 if t < 4 else 1.0 for t in range(steps)])
    p = np.where(z[:, :, None] == z[:, None], p_in, between[:, None, None])
    y = np.triu((rng.random(p.shape) < p).astype(int), 1)
    return {"y": y + y.transpose(0, 2, 1), "p": p, "x": np.zeros((steps, n, 2)), "z": z}


def static_communities(rng, n=100, steps=5, groups=6, difficulty="easy", intercept=1.0, lmbda=0.8):
    """Up to six groups whose nodes never leave them."""
    if groups > 6:
        raise ValueError("six groups at most")
    shape, scale = {"easy": (6, 20), "hard": (6, 0.5)}.get(difficulty, (3, 0.5))
    x, z = evolve(rng, n, np.array(SIX)[:groups], _spreads(rng, groups, shape, scale), [(list(range(groups)), steps)], lmbda, 20.0, rng.dirichlet([10] * groups), lambda t: np.eye(groups))
    return _network(rng, x, z, intercept, False)


def homogeneous(rng, n=120, steps=6, difficulty="easy", lmbda=0.8, intercept=1.0, sticky=20.0):
    """Six groups all along; the step after the last is there too, for forecasts."""
    centres, spreads = np.array(SIX), _spreads(rng, 6, 3 if difficulty == "hard" else 6, 0.5)
    x, z = evolve(rng, n, centres, spreads, [(list(range(6)), steps + 1)], lmbda, sticky, rng.dirichlet([10] * 6))
    return _network(rng, x, z, intercept, False) | {"ahead": forecast(rng, x[-2], z[-2], staying(centres, sticky), lmbda, centres, spreads, intercept)}


def inhomogeneous(rng, n=120, difficulty="easy", lmbda=0.9, intercept=1.0, sticky=20.0):
    """Two groups that become six, then four; ten steps."""
    spreads = _spreads(rng, 6, 3 if difficulty == "hard" else 6, 0.5)
    x, z = evolve(rng, n, np.array(TWO_FIRST), spreads, [([0, 1], 3), (list(range(6)), 3), ([0, 1, 2, 3], 4)], lmbda, sticky)
    centres = np.array(TWO_FIRST)[:4]
    return _network(rng, x, z, intercept, False) | {"ahead": forecast(rng, x[-2], z[-2], staying(centres, sticky), lmbda, centres, spreads, intercept)}


def splitting_and_merging(rng, n=120, steps=9, difficulty="easy", lmbda=0.9, intercept=1.0, sticky=20.0, directed=False):
    """Two groups, six, then four, a third of the steps each, and one step more."""
    third, centres = math.ceil(steps / 3), np.array(TWO_FIRST) / (100 if directed else 1)
    spreads = _spreads(rng, 6, *(DIRECTED_SPREAD if directed else (6, 20 if difficulty == "easy" else 0.5)))
    x, z = evolve(rng, n, centres, spreads, [([0, 1], third), (list(range(6)), third), ([0, 1, 2, 3], third + 1)], lmbda, sticky)
    return _network(rng, x, z, intercept, directed)


def lookup_table(rng, draws=10_000, low=0.1, high=2.5, bins=100, variance=0.5, intercept=1.0) -> np.ndarray:
    """For half distances of two centres: the ratio of link probabilities across and within, and the half distance."""
    expit = lambda v: 1 / (1 + np.exp(-v))
    out = []
    for m in np.linspace(low, high, bins):
        e = math.sqrt(variance) * rng.normal(size=(4, draws, 2))
        inside = expit(intercept - np.linalg.norm(e[0] - e[1], axis=1)).mean()
        across = expit(intercept - np.linalg.norm(e[2] - e[3] + [2 * m, 0], axis=1)).mean()
        out.append((across / inside, m))
    return np.array(out)


def detection_limit(rng, n=120, steps=4, trans_proba=0.2, lmbda=0.8, ratio=0.5, spread=0.5, intercept=1.0):
    """Two groups just as far apart as a ratio of link probabilities needs."""
    table = lookup_table(np.random.default_rng(42))
    m = table[np.abs(table[:, 0] - ratio).argmin(), 1]
    w = np.array([[1 - trans_proba, trans_proba], [trans_proba, 1 - trans_proba]])
    x, z = evolve(rng, n, np.array([[m, 0], [-m, 0]]), np.full(2, spread), [([0, 1], steps)], lmbda, 1.0, None, lambda t: w)
    return _network(rng, x, z, intercept, False)


SCENARIOS = {
    "splitting": splitting, "merging": merging, "merging_blocks": merging_blocks, "static_communities": static_communities, "homogeneous": homogeneous,
    "inhomogeneous": inhomogeneous, "splitting_and_merging": splitting_and_merging, "detection_limit": detection_limit,
}


def simulate(spark: SparkSession, scenario: str, seeds: list[int], **parameters) -> DataFrame:
    """seed, part ("edge", "label", "position" or "ahead"), t, i, j, z, x, p: one task for each seed.

    p is an edge's probability; rows "ahead" have every pair's probability at the last step, forecast from the one before.
    """

    def run(batches):
        for batch in batches:
            for seed in batch["seed"]:
                s = SCENARIOS[scenario](np.random.default_rng(int(seed)), **parameters)
                t, i, j = np.nonzero(s["y"])
                yield pd.DataFrame({"seed": seed, "part": "edge", "t": t, "i": i, "j": j, "z": None, "x": None, "p": s["p"][t, i, j]})
                if "ahead" in s:
                    i, j = np.triu_indices(len(s["ahead"]), 1)
                    yield pd.DataFrame({"seed": seed, "part": "ahead", "t": len(s["z"]) - 1, "i": i, "j": j, "z": None, "x": None, "p": s["ahead"][i, j]})
                rows = [(seed, part, t, i, None, int(s["z"][t, i]), s["x"][t, i].tolist(), None) for part in ("label", "position") for t in range(len(s["z"])) for i in range(s["z"].shape[1])]
                yield pd.DataFrame(rows, columns=["seed", "part", "t", "i", "j", "z", "x", "p"])

    jobs = spark.createDataFrame([(s,) for s in seeds], "seed long").repartition(len(seeds), "seed")
    return jobs.mapInPandas(run, "seed long, part string, t int, i int, j int, z int, x array<double>, p double")


def edges_of(simulated: DataFrame, seed: int) -> DataFrame:
    return simulated.where(f"part = 'edge' AND seed = {int(seed)}").selectExpr("t", "i AS src", "j AS dst")


def labels_of(simulated: DataFrame, seed: int) -> DataFrame:
    return simulated.where(f"part = 'label' AND seed = {int(seed)}").selectExpr("t", "i AS node", "z")
