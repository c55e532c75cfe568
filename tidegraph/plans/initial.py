"""Starting values: distances by scaling, groups by k-means, intercepts by Newton steps, rotations by SVD."""

from __future__ import annotations

import numpy as np


def procrustes(reference: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The rotation R, one for all steps, that brings x R nearest to the reference."""
    p = x.shape[-1]
    u, _, v = np.linalg.svd(x.reshape(-1, p).T @ reference.reshape(-1, p))
    return u @ v


def path_lengths(y: np.ndarray) -> np.ndarray:
    """Shortest undirected paths of one step; pairs without one get the longest path plus 1."""
    n = len(y)
    linked = (y + y.T) > 0
    d = np.full((n, n), -1)
    frontier, k = np.eye(n, dtype=bool), 0
    while frontier.any():
        d[frontier] = k
        frontier = ((frontier.astype(np.float32) @ linked) > 0) & (d < 0)
        k += 1
    return np.where(d < 0, d.max() + 1, d).astype(float)


def gmds(y: np.ndarray, p: int, directed: bool, lmbda: float = 10.0) -> np.ndarray:
    """Classical scaling of the first step; later ones lean on the step before, and are turned to it."""
    steps, n, _ = y.shape
    centre = np.eye(n) - 1 / n
    out = np.zeros((steps, n, p))
    for t in range(steps):
        gram = centre @ (-0.5 * path_lengths(y[t]) ** 2) @ centre
        if t:
            gram = gram / (1 + lmbda) + lmbda / (1 + lmbda) * out[t - 1] @ out[t - 1].T
        values, vectors = np.linalg.eigh(gram)
        top = np.argsort(-values)[:p]
        out[t, :, : len(top)] = vectors[:, top] * np.sqrt(np.maximum(values[top], 1e-9))
        if t:
            out[t] = out[t] @ procrustes(out[t - 1], out[t])
    return out / n if directed else out


def kmeans_labels(x: np.ndarray, k: int, rng, rounds: int = 50, var_reg: float = 1e-3, fixed_clusters: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Groups of whole trajectories (T, n, p): labels, centres averaged over steps, variances averaged over all axes.

    Without fixed_clusters each step has its own centres (T, k, p).
    """
    steps, n, p = x.shape
    flat = x.transpose(1, 0, 2).reshape(n, -1)
    k_used = min(k, n)
    centres = flat[[rng.integers(n)]]
    while len(centres) < k_used:  # each new centre is drawn by its squared distance from the nearest one
        d = ((flat[:, None] - centres) ** 2).sum(axis=2).min(axis=1)
        centres = np.vstack([centres, flat[rng.choice(n, p=d / d.sum()) if d.sum() > 0 else rng.integers(n)]])
    labels = None
    for _ in range(rounds):
        new = ((flat[:, None] - centres) ** 2).sum(axis=2).argmin(axis=1)
        if labels is not None and (new == labels).all():
            break
        labels = new
        for g in range(k_used):
            if (labels == g).any():
                centres[g] = flat[labels == g].mean(axis=0)
    mu, sigma = np.zeros((k, p)), np.full(k, max(x.var(), var_reg))
    mu[:k_used] = centres.reshape(k_used, steps, p).mean(axis=1)
    mu[k_used:] = rng.normal(0, max(x.std(), 1e-3), (k - k_used, p))
    for g in range(k_used):
        if (labels == g).any():
            v = x[:, labels == g].var(axis=1).mean()
            sigma[g] = v if v > 0 else var_reg
    if not fixed_clusters:
        moving = np.tile(mu, (steps, 1, 1))
        moving[:, :k_used] = centres.reshape(k_used, steps, p).transpose(1, 0, 2)
        return labels, moving, sigma
    return labels, mu, sigma


def intercept_mle(y: np.ndarray, x: np.ndarray, radii: np.ndarray | None, rounds: int = 50) -> tuple[np.ndarray, float]:
    """Undirected: (b0, scale) of b0 - scale d. Directed: (b_in, b_out) with scale 1. Damped Newton steps for both."""
    steps, n, _ = y.shape
    d = np.sqrt(np.maximum(((x[:, :, None] - x[:, None]) ** 2).sum(axis=3), 0))
    if radii is None:
        pick = np.triu(np.ones((n, n), bool), 1)
        dist, target = d[:, pick].ravel(), y[:, pick].ravel()
        features, theta = np.stack([np.ones_like(dist), -dist], axis=1), np.array([0.0, 1.0])
    else:
        pick = ~np.eye(n, dtype=bool)
        dist, target = d[:, pick].ravel(), y[:, pick].ravel()
        r_src, r_dst = (np.broadcast_to(a, (steps, n, n))[:, pick].ravel() for a in (radii[:, None], radii[None, :]))
        features, theta = np.stack([1 - dist / r_dst, 1 - dist / r_src], axis=1), np.zeros(2)
    value = lambda th: target @ (features @ th) - np.logaddexp(0, features @ th).sum() - 1e-3 * (th**2).sum()
    now = value(theta)
    for _ in range(rounds):
        prob = 1 / (1 + np.exp(-np.clip(features @ theta, -500, 500)))
        grad = features.T @ (target - prob) - 2e-3 * theta
        hess = (features * (prob * (1 - prob))[:, None]).T @ features + 2e-3 * np.eye(2)
        step, size = np.linalg.solve(hess, grad), 1.0
        while size > 1e-6 and value(theta + size * step) < now:
            size /= 2
        theta = theta + size * step
        if abs((new := value(theta)) - now) < 1e-8:
            break
        now = new
    if radii is None:
        return theta[:1], float(np.clip(theta[1], 0.05, 20.0))
    return theta, 1.0
