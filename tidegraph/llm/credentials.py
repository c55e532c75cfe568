"""Secrets: patterns of known shapes, and a character convolutional network over every candidate and what stands around it.

Base kinds: assign, access and hex, as the leftmost non-overlapping matches of their patterns, dropped if they fail their
lengths. A candidate is a run of token characters, of eight or more with a digit among them. The network reads the
characters before it, all of its own and those behind it, and gives a logit; a candidate outside all base spans whose
calibrated score reaches its threshold is a span of the kind secret.

The network is trained here, in numpy, on labelled findings: all different candidates of the documents themselves but those with
crc32(id) mod 5 = 0, labelled by whether they lie in a base span that has a letter, with their cue in half of the cases
replaced by another, and as many made up in known shapes and put in the surroundings of the first. Findings are dealt to
shards of some SHARD by their hash; each shard's task takes its share of updates, ROUNDS times, and after each the shards' networks are averaged. Every
fourth finding is kept from training: on these the logits are calibrated (a scale and a shift) and the thresholds set, one
for candidates behind a cue, one for the rest: the least that at most a hundredth as many false findings as there are true
ones reach, but none that costs a recall of `recall`, and not below one half.

Defined results: a null text is an empty one, without spans; every row gives one row, repeated rows too; null ids stay
null and give no training rows; texts and candidates of any length are read whole; an empty table gives no rows. Extra
columns are not read.
"""

from __future__ import annotations

import hashlib
import random
import re
import string

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
BASE = ("assign", "access", "hex")
KINDS = (*BASE, "secret")

CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{8,}")
DIGIT = re.compile(r"[0-9]")
LETTER = re.compile(r"[A-Za-z]")
#: Characters around a candidate that the network reads.
BEFORE, BEHIND = 24, 8
#: What names a secret in front of it; decides which threshold holds, and makes up surroundings.
CUES = ("password", "passwd", "passphrase", "pwd", "secret", "client_secret", "token", "auth_token", "apikey", "api_key", "access_key", "private key", "bearer", "credential")
CUE = re.compile(r"(?:passw|passphrase|pwd|secret|token|api_?key|access_?key|private.?key|bearer|credential)", re.IGNORECASE | re.ASCII)

DIM, FILTERS, HIDDEN = 12, 24, 16
#: Symbols: ASCII, other letters, other characters, and one for no character.
LETTERS, OTHERS, NONE = 128, 129, 130
SIDES = (("before", 5, BEFORE), ("body", 3, None), ("behind", 3, BEHIND))
#: Characters of a body that are folded at once.
SLICE = 4096
#: Findings of a shard, and how often the networks of several shards are averaged. Parts of a logit that kept-back findings are counted by.
SHARD, ROUNDS, CELLS = 4096, 5, 1024


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's place in KINDS, end), sorted."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 12]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text) if m.end() - m.start() >= 16]
    return sorted(found)


def candidates(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in CANDIDATE.finditer(text) if DIGIT.search(text, *m.span())]


def inside(spans: list[tuple[int, int]], of: list[tuple[int, int, int]]) -> list[int]:
    """For every one of the sorted spans the place of the first of the others that it overlaps, or -1. Both are sorted by start."""
    out, k = [], 0
    for start, end in spans:
        while k < len(of) and of[k][2] <= start:
            k += 1
        at = next((j for j in range(k, len(of)) if of[j][0] >= end or of[j][2] > start), len(of))
        out.append(at if at < len(of) and of[at][0] < end else -1)
    return out


def around(text: str, start: int, end: int) -> tuple[str, str, str]:
    return text[max(0, start - BEFORE) : start], text[start:end], text[end : end + BEHIND]


def symbols(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    if codes.size and codes.max() > 127:
        return np.array([ord(c) if c < "\x80" else LETTERS if c.isalpha() else OTHERS for c in text], np.int16)
    return codes.astype(np.int16)


def padded(texts: list[np.ndarray], width: int) -> np.ndarray:
    out = np.full((len(texts), max(width, *map(len, texts))), NONE, np.int16)
    for row, t in zip(out, texts):
        row[: len(t)] = t
    return out


class Network:
    def __init__(self, seed: int = 13):
        rng = np.random.default_rng(seed)
        self.p = {"e": rng.normal(0, 0.3, (NONE + 1, DIM))}
        self.p["e"][NONE] = 0
        for name, width, _ in SIDES:
            self.p[f"w_{name}"] = rng.normal(0, (width * DIM) ** -0.5 * 2, (width, DIM, FILTERS))
            self.p[f"c_{name}"] = np.zeros(FILTERS)
        pools = FILTERS * 4 + 1
        self.p |= {"h": rng.normal(0, pools**-0.5, (pools, HIDDEN)), "g": np.zeros(HIDDEN), "v": rng.normal(0, HIDDEN**-0.5, HIDDEN), "b": np.zeros(1)}
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}
        self.first, self.second = ({k: np.zeros_like(v) for k, v in self.p.items()} for _ in range(2))
        self.scale, self.shift, self.limits, self.steps = 1.0, 0.0, (0.5, 0.5), 0

    def _filtered(self, name: str, width: int, ids: np.ndarray) -> np.ndarray:
        x, w = self.p["e"][ids], self.p[f"w_{name}"]
        n = ids.shape[1] - width + 1
        return np.maximum(sum(x[:, k : k + n] @ w[k] for k in range(width)) + self.p[f"c_{name}"], 0)

    def features(self, findings: list[tuple[str, str, str]]) -> np.ndarray:
        """A row for each finding: maxima over each side and the body, the body's means, and its length's logarithm."""
        parts = []
        for k, (name, width, most) in enumerate(SIDES):
            texts = [symbols(f[k]) for f in findings]
            if most is not None:
                parts.append(self._filtered(name, width, padded(texts, max(most, width))).max(axis=1))
                continue
            best, total = np.zeros((len(texts), FILTERS), np.float32), np.zeros((len(texts), FILTERS), np.float32)
            lengths = np.array([max(1, len(t) - width + 1) for t in texts])
            for i in np.argsort(lengths, kind="stable").tolist():
                for at in range(0, lengths[i], SLICE):
                    out = self._filtered(name, width, padded([texts[i][at : at + SLICE + width - 1]], width))[0]
                    best[i] = np.maximum(best[i], out.max(axis=0))
                    total[i] += out.sum(axis=0)
            parts += [best, total / lengths[:, None], np.log(lengths)[:, None].astype(np.float32)]
        return np.concatenate(parts, axis=1)

    def logits(self, findings: list[tuple[str, str, str]]) -> np.ndarray:
        if not findings:
            return np.zeros(0)
        hidden = np.maximum(self.features(findings) @ self.p["h"] + self.p["g"], 0)
        return hidden @ self.p["v"] + self.p["b"][0]

    def scores(self, findings: list[tuple[str, str, str]]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * self.logits(findings) + self.shift, -30, 30)))

    def picks(self, findings: list[tuple[str, str, str]]) -> list[bool]:
        return [s >= self.limits[bool(CUE.search(f[0]))] for s, f in zip(self.scores(findings), findings)]

    def train(self, findings: list[tuple[str, str, str]], labels: np.ndarray, updates: int = 1500, size: int = 64, rate: float = 0.004, seed: int = 13) -> None:
        """Adam over batches, going on from the moments and steps that there are."""
        rng = np.random.default_rng([seed, self.steps])
        ids = [[symbols(f[k]) for f in findings] for k in range(3)]
        for step in range(self.steps + 1, self.steps + updates + 1):
            rows = rng.integers(0, len(findings), min(size, len(findings)))
            grads = self._gradients([[side[r] for r in rows] for side in ids], labels[rows])
            for k, g in grads.items():
                self.first[k] += 0.1 * (g - self.first[k])
                self.second[k] += 0.001 * (g * g - self.second[k])
                self.p[k] -= rate * (self.first[k] / (1 - 0.9**step)) / (np.sqrt(self.second[k] / (1 - 0.999**step)) + 1e-8)
            self.p["e"][NONE] = 0
        self.steps += updates

    def state(self) -> np.ndarray:
        """Parameters and both moments, one after the other."""
        return np.concatenate([x[k].ravel() for x in (self.p, self.first, self.second) for k in self.p]).astype(np.float64)

    def put(self, state: np.ndarray) -> None:
        for x in (self.p, self.first, self.second):
            for k, v in self.p.items():
                x[k] = state[: v.size].reshape(v.shape).astype(np.float32)
                state = state[v.size :]

    def _gradients(self, sides: list[list[np.ndarray]], y: np.ndarray) -> dict[str, np.ndarray]:
        """Bodies are as long as the longest of their batch, but those of over SLICE characters are taken one by one, by slices."""
        long = [r for r, body in enumerate(sides[1]) if len(body) > SLICE]
        short = [r for r in range(len(y)) if len(sides[1][r]) <= SLICE]
        grads = {k: 1e-4 * v if k in "vh" else np.zeros_like(v) for k, v in self.p.items()}
        for rows in ([short] if short else []) + [[r] for r in long]:
            for k, g in self._summed([[side[r] for r in rows] for side in sides], y[rows], len(y)).items():
                grads[k] += g
        return grads

    def _summed(self, sides: list[list[np.ndarray]], y: np.ndarray, n: int) -> dict[str, np.ndarray]:
        kept, parts = [], []
        for (name, width, most), texts in zip(SIDES, sides):
            ids = padded(texts, most or width)
            lengths = np.array([max(1, len(t) - width + 1) for t in texts])
            places = ids.shape[1] - width + 1
            best, at, total = np.full((len(y), FILTERS), -1, self.p["v"].dtype), np.zeros((len(y), FILTERS), int), 0
            for a in range(0, places, SLICE):
                out = self._sliced(name, width, most, ids, lengths, a)
                mine, where = out.max(axis=1), out.argmax(axis=1) + a
                at, best, total = np.where(mine > best, where, at), np.maximum(mine, best), total + out.sum(axis=1)
            kept.append((name, width, most, ids, at, lengths, places))
            parts.append(best)
            if most is None:
                parts += [total / lengths[:, None], np.log(lengths)[:, None].astype(np.float32)]
        f = np.concatenate(parts, axis=1).astype(np.float32)
        hidden = np.maximum(f @ self.p["h"] + self.p["g"], 0)
        slope = ((1 / (1 + np.exp(-np.clip(hidden @ self.p["v"] + self.p["b"][0], -30, 30))) - y) / n).astype(np.float32)
        d_hidden = slope[:, None] * self.p["v"] * (hidden > 0)
        grads = {"v": hidden.T @ slope, "b": slope.sum(keepdims=True), "h": f.T @ d_hidden, "g": d_hidden.sum(axis=0)}
        grads |= {k: np.zeros_like(v) for k, v in self.p.items() if k not in grads}
        d_f, column = d_hidden @ self.p["h"].T, 0
        for name, width, most, ids, at, lengths, places in kept:
            d_best = d_f[:, column : column + FILTERS]
            column += FILTERS
            if most is None:
                d_mean = d_f[:, None, column : column + FILTERS] / lengths[:, None, None]
                column += FILTERS + 1
            for a in range(0, places, SLICE):
                out = self._sliced(name, width, most, ids, lengths, a)
                t = out.shape[1]
                d = np.zeros_like(out)
                row, filter_ = np.nonzero((at >= a) & (at < a + t))
                d[row, at[row, filter_] - a, filter_] = d_best[row, filter_]
                if most is None:
                    d += d_mean
                d *= out > 0
                own = ids[:, a : a + t + width - 1]
                x, w = self.p["e"][own], self.p[f"w_{name}"]
                grads[f"c_{name}"] += d.sum(axis=(0, 1))
                grads[f"w_{name}"] += np.stack([np.einsum("btd,btf->df", x[:, k : k + t], d, optimize=True) for k in range(width)])
                d_x = np.zeros_like(x)
                for k in range(width):
                    d_x[:, k : k + t] += d @ w[k].T
                np.add.at(grads["e"], own.ravel(), d_x.reshape(-1, DIM))
        return grads

    def _sliced(self, name: str, width: int, most: int | None, ids: np.ndarray, lengths: np.ndarray, a: int) -> np.ndarray:
        """What the filters give at SLICE places from a on; places behind a body's end give nothing."""
        out = self._filtered(name, width, ids[:, a : a + SLICE + width - 1])
        return out if most is not None else out * (np.arange(a, a + out.shape[1])[None, :, None] < lengths[:, None, None])

    def cells(self, findings: list[tuple[str, str, str]], labels: np.ndarray) -> list[tuple[int, int, int, int, float, float, float]]:
        """Whether behind a cue, part of a logit, findings, true ones, sum of logits, the least and the largest, of kept-back findings."""
        out: dict[tuple[int, int], list] = {}
        for z, y, f in zip(self.logits(findings).tolist(), labels.tolist(), findings):
            c = out.setdefault((int(bool(CUE.search(f[0]))), int(np.floor(np.clip(z, -64, 64) * CELLS))), [0, 0, 0.0, z, z])
            c[:] = c[0] + 1, c[1] + int(y), c[2] + z, min(c[3], z), max(c[4], z)
        return [(*k, *c) for k, c in out.items()]

    def calibrate(self, cells: list[tuple[int, int, int, int, float, float, float]], recall: float) -> None:
        """A scale and a shift of the logits by Newton steps, then the thresholds."""
        if not cells:
            return
        cued, _, n, true, total, low, high = (np.array(x, np.float64) for x in zip(*sorted(cells)))
        z, start = total / n, np.array([1.0, 0.0])
        theta, design = start, np.stack([z, np.ones_like(z)], axis=1)
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(design @ theta, -30, 30)))
            grad = design.T @ (n * p - true) + 1e-2 * (theta - start)
            hess = (design * (n * p * (1 - p))[:, None]).T @ design + 1e-2 * np.eye(2)
            theta = theta - np.linalg.solve(hess, grad)
        self.scale, self.shift = map(float, theta)
        score = lambda x: float(1 / (1 + np.exp(-np.clip(self.scale * x + self.shift, -30, 30))))
        limits = []
        for group in (cued == 0, cued == 1):
            hits, misses = true[group].sum(), (n - true)[group].sum()
            up, down = np.flatnonzero(group)[np.argsort(low[group], kind="stable")], np.flatnonzero(group)[np.argsort(-high[group], kind="stable")]
            rare = float(np.nextafter(score(high[down[np.searchsorted(np.cumsum((n - true)[down]), int(0.01 * hits), side="right")]]), 2)) if misses > 0.01 * hits else 0.5
            limits.append(max(0.5, min(rare, score(low[up[np.searchsorted(np.cumsum(true[up]), int((1 - recall) * hits), side="right")]]))) if hits else 0.5)
        self.limits = tuple(limits)


def made_up(rng: random.Random, left: str, right: str) -> tuple[tuple[str, str, str], int]:
    """A finding of a known shape in given surroundings: secrets behind cues or bare, and what looks like them."""
    some = lambda letters, low, high: "".join(rng.choice(letters) for _ in range(rng.randint(low, high)))
    alnum, hexes, b64, digits = string.ascii_letters + string.digits, "0123456789abcdef", string.ascii_letters + string.digits + "+/", string.digits
    cue = lambda: left[: rng.randint(0, 8)] + " " + (c := rng.choice(CUES), rng.choice([c, c.upper(), c.title()]))[1] + rng.choice([": ", " = ", "=", " ", ' = "', "='", " is "])
    secret = rng.random() < 0.5
    if secret:
        shape = rng.randrange(5)
        if shape == 0:
            body = some(b64, 18, 60) + rng.choice(["", "=", "=="])
        elif shape == 1:
            body = some(alnum, 20, 44)
        elif shape == 2:
            body = some(string.ascii_lowercase, 2, 4) + "_" + some(alnum, 16, 40)
        elif shape == 3:
            body = some(hexes, 20, 64)
        else:
            return ((cue(), some(alnum, 6, 16) + some(digits, 2, 3), right), 1)  # a short one is one behind a cue only
        return ((cue() if rng.random() < 0.6 else left, body + rng.choice(digits), right), 1)
    words = lambda k: [some(string.ascii_lowercase, 2, 8) for _ in range(k)]
    shape = rng.randrange(9)
    if shape == 0:
        body = some(digits, 8, 19)
    elif shape == 1:
        body = ".".join(some(digits, 1, 3) for _ in range(rng.randint(3, 5)))
    elif shape == 2:
        body = f"{rng.randint(1900, 2099)}-{rng.randint(1, 12):02d}-{rng.randint(1, 28):02d}"
    elif shape == 3:
        body = "-".join(some(hexes, n, n) for n in (8, 4, 4, 4, 12))
    elif shape == 4:
        body = "/".join(words(3)) + rng.choice(["/", "-v", "."]) + some(digits, 1, 3)
    elif shape == 5:
        body = rng.choice("-_.").join(words(2)) + some(digits, 1, 4)
    elif shape == 6:
        body = f"mail{rng.randint(1, 99)}.{rng.choice(words(1))}.com"
    elif shape == 7:
        body = "-".join(some(digits, n, n) for n in (3, 3, 4))
    else:
        body = "".join(words(2)).title() + some(digits, 1, 4)
    return ((left, body + ("0" if len(body) < 8 else ""), right), 0)


def findings(docs: DataFrame) -> DataFrame:
    """before, body, behind and label of the candidates of all rows of docs, those of repeated documents too."""

    def make():
        def f(batch):
            out = []
            for text in common.texts_of(batch, "text"):
                spans, base = candidates(text), base_spans(text)
                for (start, end), at in zip(spans, inside(spans, base)):
                    label = int(at >= 0 and bool(LETTER.search(text, start, end)))
                    out.append((*(p.encode("utf-8", "replace").decode() for p in around(text, start, end)), label))
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.int32() if k == 3 else pa.string()) for k in range(4)], ["before", "body", "behind", "label"])

        return f

    return common.map_batches(docs.select("text"), make, "before string, body string, behind string, label int")


def labelled(docs: DataFrame) -> DataFrame:
    """The different labelled findings of documents that may be learnt from, with a hash of each."""
    named = common.id_and_text(docs).where(F.col("doc_id").isNotNull() & (F.crc32(F.col("doc_id").cast("string")) % 5 != 0))
    return findings(named).distinct().withColumn("place", F.xxhash64("before", "body", "behind"))


def training_rows(docs: DataFrame) -> list[tuple[tuple[str, str, str], int]]:
    """All labelled findings in the driver, for tests and small tables; the query trains where they are."""
    return [((r.before, r.body, r.behind), r.label) for r in labelled(docs).collect()]


def mixed(rows: list[tuple[tuple[str, str, str], int]], made: int, seed: int) -> tuple[list[tuple[str, str, str]], np.ndarray, np.ndarray]:
    """Findings with replaced cues and made-up ones, their labels, and which are kept back."""
    rng = random.Random(seed)
    plain = [f for f, label in rows if not label] or [("", "", "")]
    rows = [((f[0] if not label or rng.random() < 0.5 else rng.choice(plain)[0][:8] + " " + rng.choice(CUES) + rng.choice([": ", "=", " "]), *f[1:]), label) for f, label in rows]
    for _ in range(made):
        left, _, right = rng.choice(plain)
        rows.append(made_up(rng, left, right))
    rows = [((f[0][-BEFORE:], *f[1:]), label) for f, label in rows]
    rng.shuffle(rows)
    return [f for f, _ in rows], np.array([label for _, label in rows], np.float32), np.arange(len(rows)) % 4 == 0


def fit(rows: list[tuple[tuple[str, str, str], int]], recall: float = 0.95, made: int = 3000, seed: int = 13) -> Network:
    """A network of these rows, as one shard."""
    network = Network()
    found, labels, held = mixed(rows, made, seed)
    if len(found):
        network.train([f for f, out in zip(found, held) if not out], labels[~held])
        network.calibrate(network.cells([f for f, out in zip(found, held) if out], labels[held]), recall)
    return network


#: Parts of a network's parameters, each summed over the shards by one task.
PARTS = 16


def trained(docs: DataFrame, recall: float = 0.95, made: int = 3000, updates: int = 1500) -> Network:
    """A network of all labelled findings of docs. Of a shard's findings as many are made up as there are, `made` at least."""
    rows = common.written(labelled(docs), "credentials-findings")
    shards = max(1, round(rows.count() / SHARD))
    dealt = rows.withColumn("shard", F.pmod("place", F.lit(shards)).cast("int"))
    if not rows.head(1):  # then all are made up
        return fit([], recall, made)
    network, rounds = Network(), ROUNDS if shards > 1 else 1

    def each(f, schema: str) -> DataFrame:
        def run(key, table):
            own = sorted(zip(*(table.column(c).to_pylist() for c in ("place", "before", "body", "behind", "label"))))
            number = key[0].as_py()
            found, labels, held = mixed([(r[1:4], r[4]) for r in own], max(made, len(own)), 13 + number)
            return pa.Table.from_pylist(list(f(number, found, labels, held)), kinds)

        kinds = pa.schema([(c.split()[0], {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "binary": pa.binary()}[c.split()[1]]) for c in schema.split(", ")])
        return dealt.repartition(shards, "shard").groupBy("shard").applyInArrow(run, schema)

    def mean(key, table):
        states = [np.frombuffer(x, "<f8") for _, x in sorted(zip(table.column("number").to_pylist(), table.column("state").to_pylist()))]
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "state": pa.array([(sum(states) / len(states)).tobytes()], pa.binary())})

    for _ in range(rounds):
        sent = docs.sparkSession.sparkContext.broadcast(network)

        def train(number, found, labels, held):
            own = Network()
            own.put(sent.value.state())
            own.steps = sent.value.steps
            own.train([f for f, out in zip(found, held) if not out], labels[~held], updates // rounds, seed=13 + number)
            for part, x in enumerate(np.array_split(own.state(), PARTS)):
                yield {"part": part, "number": number, "state": x.astype("<f8").tobytes()}

        met = each(train, "part int, number int, state binary").groupBy("part").applyInArrow(mean, "part int, state binary").collect()
        network = Network()
        network.put(np.concatenate([np.frombuffer(r.state, "<f8") for r in sorted(met, key=lambda r: r.part)]))
        network.steps = sent.value.steps + updates // rounds
        sent.unpersist()
    sent = docs.sparkSession.sparkContext.broadcast(network)
    names = ("cued", "cell", "n", "hits", "total", "low", "high")
    count = lambda number, found, labels, held: (dict(zip(names, c)) for c in sent.value.cells([f for f, out in zip(found, held) if out], labels[held]))
    cells = each(count, "cued int, cell int, n long, hits long, total double, low double, high double")
    cells = cells.groupBy("cued", "cell").agg(F.sum("n"), F.sum("hits"), F.array_sort(F.collect_list("total")), F.min("low"), F.max("high")).collect()
    network.calibrate([(*r[:4], sum(r[4]), *r[5:]) for r in cells], recall)  # sums in one order, so reruns agree
    return network


def spans(text: str, network: Network) -> list[tuple[int, int, int]]:
    """(start, kind's place in KINDS, end) of every span of one text, sorted by start, then kind."""
    base, found = base_spans(text), candidates(text)
    apart = [s for s, at in zip(found, inside(found, base)) if at < 0]
    picked = network.picks([around(text, *s) for s in apart])
    return sorted(base + [(start, 3, end) for (start, end), yes in zip(apart, picked) if yes])


def find(docs: DataFrame, network: Network, **columns) -> DataFrame:
    """doc_id and spans, an array of (kind, start, end), for every row of docs."""
    sent = docs.sparkSession.sparkContext.broadcast(network)  # some hundred KB whatever the input
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def make():
        def f(batch):
            rows = [[{"kind": KINDS[k], "start": a, "end": b} for a, k, b in spans(t, sent.value)] for t in common.texts_of(batch, "text")]
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, kind)], ["doc_id", "spans"])

        return f

    return common.map_batches(common.id_and_text(docs, **columns), make, "doc_id long, spans array<struct<kind: string, start: long, end: long>>")


def op13_secret_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents")
    found = find(docs, trained(docs))
    text = lambda only: F.array_join(F.transform(F.filter("spans", only), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, BASE), F.sha2(text(lambda s: s["kind"].isin(*BASE)), 256).alias("base_sha256"), text(lambda s: F.lit(True)).alias("spans"))
