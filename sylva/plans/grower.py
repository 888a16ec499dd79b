"""Growing one tree: histograms in Arrow batches, splits on the driver.

A level of a tree is one pass over the binned table: every task adds up its rows
with ``numpy.bincount`` into cells (leaf, feature, bin), the cells of all tasks are
summed by one aggregation, and the driver scores them. Of two siblings only the
smaller is counted; the other is its parent less it. The driver and a task hold
``MAX_CELLS`` cells at most; leaves beyond that go through in turns, without subtraction.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sylva.functions.losses import NUMPY

MAX_CELLS = 4_000_000


@dataclass
class Grown:
    """A tree over bins: node i splits ``feature`` at ``border`` (bin > border, or bin == border if ``equal``) or is a leaf (feature -1)."""

    feature: list[int] = field(default_factory=lambda: [-1])
    border: list[int] = field(default_factory=lambda: [0])
    equal: list[bool] = field(default_factory=lambda: [False])
    left: list[int] = field(default_factory=lambda: [0])
    right: list[int] = field(default_factory=lambda: [0])
    depth: list[int] = field(default_factory=lambda: [0])
    values: np.ndarray | None = None  # (nodes, outputs)
    sums: dict[int, np.ndarray] = field(default_factory=dict)  # node -> channels, as its split counted it

    def split(self, at: int, feature: int, border: int, equal: bool) -> tuple[int, int]:
        self.feature[at], self.border[at], self.equal[at] = feature, border, equal
        for side in (self.left, self.right):
            side[at] = len(self.feature)
            for column, value in ((self.feature, -1), (self.border, 0), (self.equal, False), (self.left, 0), (self.right, 0), (self.depth, self.depth[at] + 1)):
                column.append(value)
        return self.left[at], self.right[at]

    def leaves(self) -> list[int]:
        return [i for i, f in enumerate(self.feature) if f < 0]

    def compiled(self) -> tuple:
        return tuple(np.array(x) for x in (self.feature, self.border, self.equal, self.left, self.right)) + (max(self.depth),)


def walk(tree: tuple, bins: np.ndarray) -> np.ndarray:
    """The node each row ends in; ``bins`` is (features, rows)."""
    feature, border, equal, left, right, depth = tree
    at = np.zeros(bins.shape[1], dtype=np.int64)
    rows = np.arange(bins.shape[1])
    for _ in range(depth):
        f = feature[at]
        inner = f >= 0
        v = bins[np.maximum(f, 0), rows]
        go = np.where(equal[at], v == border[at], v > border[at])
        at = np.where(inner, np.where(go, right[at], left[at]), at)
    return at


@dataclass
class Rows:
    """What a pass needs to turn a batch into bins, derivatives and weights."""

    features: int
    outputs: int
    targets: int
    ders: Callable | None  # None: columns der, der2 are there
    fresh: list = field(default_factory=list)  # (compiled tree, values) since approx was written
    scale: float = 1.0  # of approx and fresh trees (model shrink)
    bootstrap: str = "No"
    subsample: float = 1.0
    temperature: float = 1.0
    threshold: float = 0.0
    noise: float = 0.0

    def columns(self) -> list[str]:
        out = [*[f"b{i}" for i in range(self.features)], *[f"l{i}" for i in range(self.targets)], "weight", *[f"a{i}" for i in range(self.outputs)]]
        return out + ["der", "der2"] * (self.ders is None) + ["u"] * (self.bootstrap != "No") + ["z"] * (self.noise > 0)

    def bins(self, b: pa.RecordBatch) -> np.ndarray:
        return np.stack([b.column(f"b{i}").to_numpy(zero_copy_only=False) for i in range(self.features)]) if self.features else np.zeros((0, b.num_rows), dtype=np.int16)

    def approx(self, b: pa.RecordBatch, bins: np.ndarray) -> np.ndarray:
        a = np.stack([b.column(f"a{i}").to_numpy(zero_copy_only=False) for i in range(self.outputs)], axis=1) * self.scale
        for tree, values in self.fresh:
            a += values[walk(tree, bins)]
        return a

    def derivatives(self, b: pa.RecordBatch, a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if self.ders is None:
            d, d2 = (b.column(c).to_numpy(zero_copy_only=False)[:, None] for c in ("der", "der2"))
        else:
            t = np.stack([b.column(f"l{i}").to_numpy(zero_copy_only=False) for i in range(self.targets)], axis=1)
            one = self.outputs == 1
            w = b.column("weight").to_numpy(zero_copy_only=False)
            d, d2 = self.ders(a[:, 0] if one else a, t[:, 0] if self.targets == 1 else t, w)
            d, d2 = (np.asarray(x, dtype=float).reshape(len(a), -1) for x in (d, d2))
        if self.noise > 0:
            d = d + self.noise * b.column("z").to_numpy(zero_copy_only=False)[:, None]
        return d, d2

    def sampled(self, b: pa.RecordBatch, d: np.ndarray) -> np.ndarray:
        w = b.column("weight").to_numpy(zero_copy_only=False).astype(float)
        if self.bootstrap == "No":
            return w
        u = b.column("u").to_numpy(zero_copy_only=False)
        if self.bootstrap == "Bayesian":
            return w * (-np.log(u)) ** self.temperature
        if self.bootstrap == "Bernoulli":
            return w * (u < self.subsample)
        if self.bootstrap == "Poisson":
            k, p, total = np.zeros(len(u)), np.exp(-1.0), 0.0
            for i in range(20):
                total += p
                k += u > total
                p /= i + 1
            return w * k
        size = np.sqrt((d * d).sum(axis=1) + self.temperature)  # MVS: the chance grows with the derivative
        chance = np.minimum(1.0, size / self.threshold) if self.threshold > 0 else np.ones(len(u))
        return w * np.where(u < chance, 1.0 / chance, 0.0)


def pointwise(ders: Callable) -> Callable:
    """A loss's derivatives as a function of approx, target and weight."""
    return lambda a, t, w: ders(a, t, NUMPY)


def _sums(df: DataFrame, run, width: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(cells, sums): rows (cell, v0 ..) of all tasks added up."""
    schema = "cell long, " + ", ".join(f"v{i} double" for i in range(width))
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = conf.get(name)
    conf.set(name, "50000")  # rows are a few numbers each
    try:
        got = df.mapInArrow(run, schema).groupBy("cell").agg(*[F.sum(f"v{i}").alias(f"v{i}") for i in range(width)]).toArrow()
    finally:
        conf.set(name, before)
    return got.column("cell").to_numpy(), np.stack([got.column(f"v{i}").to_numpy() for i in range(width)], axis=1) if got.num_rows else np.zeros((0, width))


def _emit(total: np.ndarray) -> pa.RecordBatch:
    """Rows of a (cells, channels) array that count something."""
    cell = np.flatnonzero(total[:, -1])
    return pa.RecordBatch.from_arrays([pa.array(cell), *[pa.array(np.ascontiguousarray(total[cell, i])) for i in range(total.shape[1])]], ["cell", *[f"v{i}" for i in range(total.shape[1])]])


def histograms(frame: DataFrame, rows: Rows, tree: Grown, nodes: list[int], bins: list[int], chosen: list[int]) -> np.ndarray:
    """(node, cell, channel): summed derivatives by output, weights, rows; a feature's cells follow each other."""
    offset = np.concatenate([[0], np.cumsum([bins[f] for f in chosen])]).astype(np.int64)
    width, channels = int(offset[-1]), rows.outputs + 2
    out = np.zeros((len(nodes), width, channels))
    per = max(1, MAX_CELLS // max(1, width * channels))
    for first in range(0, len(nodes), per):
        part = nodes[first : first + per]
        slot = np.full(len(tree.feature), -1)
        slot[part] = np.arange(len(part))
        compiled = tree.compiled()

        def run(batches, part=part, slot=slot):
            total = np.zeros((len(part) * width, channels))
            for b in batches:
                x = rows.bins(b)
                at = slot[walk(compiled, x)]
                d, _ = rows.derivatives(b, rows.approx(b, x))
                w = rows.sampled(b, d)
                keep = np.flatnonzero((at >= 0) & (w != 0))
                at, w, d = at[keep] * width, w[keep], d[keep]
                for k, f in enumerate(chosen):
                    cell = at + offset[k] + x[f][keep]
                    for i in range(channels):
                        values = d[:, i] * w if i < channels - 2 else w if i == channels - 2 else None
                        total[:, i] += np.bincount(cell, weights=values, minlength=len(total))
            yield _emit(total)

        cell, got = _sums(frame.select(*rows.columns()), run, channels, 2)
        out[first : first + len(part)].reshape(-1, channels)[cell] = got
    return out


def leaf_sums(frame: DataFrame, rows: Rows, tree: Grown, hessian: Callable | None = None) -> np.ndarray:
    """(node, channel) over unsampled weights: derivatives by output, second derivatives by output (or the packed upper half of ``hessian``), weight, rows."""
    compiled, n, k = tree.compiled(), len(tree.feature), rows.outputs
    upper = np.triu_indices(k)
    channels = k + (len(upper[0]) if hessian else k) + 2

    def run(batches):
        total = np.zeros((n, channels))
        for b in batches:
            x = rows.bins(b)
            at, a = walk(compiled, x), rows.approx(b, x)
            d, d2 = rows.derivatives(b, a)
            w = b.column("weight").to_numpy(zero_copy_only=False).astype(float)
            if hessian:
                d2 = hessian(a)[:, upper[0], upper[1]]
            for i, v in enumerate([*(d * w[:, None]).T, *(d2 * w[:, None]).T, w]):
                total[:, i] += np.bincount(at, weights=v, minlength=n)
            total[:, -1] += np.bincount(at, minlength=n)
        yield _emit(total)

    cell, got = _sums(frame.select(*rows.columns()), run, channels, 1)
    out = np.zeros((n, channels))
    out[cell] = got
    return out


def der_scale(frame: DataFrame, rows: Rows) -> tuple[float, float, float]:
    """Sum of squared derivatives, of their sizes, and rows: for noise and for sampling thresholds."""

    def run(batches):
        total = np.zeros((1, 3))
        for b in batches:
            x = rows.bins(b)
            d, _ = rows.derivatives(b, rows.approx(b, x))
            total += [[(d * d).sum(), np.sqrt((d * d).sum(axis=1)).sum(), len(d)]]
        yield _emit(total)

    _, got = _sums(frame.select(*[c for c in rows.columns() if c != "u"]), run, 3, 1)
    return tuple(got[0]) if len(got) else (0.0, 0.0, 0.0)


def mvs_threshold(frame: DataFrame, rows: Rows, share: float) -> float:
    """The size m at which sum of min(1, size / m) is ``share`` of the rows, from a histogram of sizes by 1/64 powers of two."""

    def run(batches):
        total = np.zeros((8192, 2))
        for b in batches:
            x = rows.bins(b)
            d, _ = rows.derivatives(b, rows.approx(b, x))
            size = np.sqrt((d * d).sum(axis=1) + rows.temperature)
            cell = np.clip(np.floor(np.log2(np.maximum(size, 1e-18)) * 64).astype(int) + 4096, 0, 8191)
            total[:, 0] += np.bincount(cell, weights=size, minlength=8192)
            total[:, 1] += np.bincount(cell, minlength=8192)
        yield _emit(total)

    cell, got = _sums(frame.select(*[c for c in rows.columns() if c != "u"]), run, 2, 1)
    order = np.argsort(cell)
    size, n = got[order, 0], got[order, 1]
    want = share * n.sum()
    if share >= 1 or not len(n):
        return 0.0
    below, above = np.cumsum(size), n.sum() - np.cumsum(n)  # with the threshold after cell i: sizes below it over m, all above it surely
    for s, a, edge in zip(below, above, 2.0 ** ((cell[order] - 4095) / 64), strict=True):
        if want > a and s / (want - a) <= edge:
            return float(s / (want - a))
    return float(below[-1] / want)


# scores ------------------------------------------------------------------------


def term_scores(der: np.ndarray, weight: np.ndarray, l2: float, score: str) -> tuple[np.ndarray, np.ndarray]:
    """Numerator and denominator terms of one side of a split, summed over outputs; ``der`` is (..., outputs)."""
    w = weight[..., None]
    some = w > 0
    safe = np.where(some, w, 1.0)
    if score in ("L2", "Cosine"):
        avg = np.where(some, der / (safe + l2) if l2 else der / safe, 0.0)
        return (avg * der).sum(axis=-1), (avg * avg * w).sum(axis=-1)
    square = der * der / safe
    if score == "SolarL2":
        factor = np.where(w > 1e-20, 1 + 2 * np.log(np.maximum(w, 0) + 1), 0.0)
    elif score == "LOOL2":
        factor = np.where(w > 1, w / np.where(w > 1, w - 1, 1.0), 0.0) ** 2
    else:  # SatL2
        factor = np.where(w > 2, w * (w - 2) / np.where(w > 2, w * w - 3 * w + 1, 1.0), 0.0)
    return np.where(some, factor * square, 0.0).sum(axis=-1), np.zeros(weight.shape)


def combined(up: np.ndarray, down: np.ndarray, score: str) -> np.ndarray:
    return up / np.sqrt(1e-100 + down) if score == "Cosine" else up


@dataclass
class Candidates:
    """All splits of some nodes: arrays over (node, split)."""

    feature: np.ndarray  # index into the frame's bins
    border: np.ndarray
    equal: np.ndarray
    left: np.ndarray  # (node, split, channel)
    right: np.ndarray


def candidates(hist: np.ndarray, bins: list[int], chosen: list[int], equal: list[bool]) -> Candidates:
    """Borders by running sums; one-hot features by one bin against the rest."""
    feature, border, kind, left, right, at = [], [], [], [], [], 0
    for f in chosen:
        h = hist[:, at : at + bins[f]]
        at += bins[f]
        whole = h.sum(axis=1, keepdims=True)
        if equal[f]:
            r = h if bins[f] > 2 else h[:, :1]
            l, n = whole - r, r.shape[1]
        else:
            l = np.cumsum(h, axis=1)[:, :-1]
            r, n = whole - l, bins[f] - 1
        feature.append(np.full(n, f))
        border.append(np.arange(n))
        kind.append(np.full(n, equal[f]))
        left.append(l)
        right.append(r)
    return Candidates(*[np.concatenate(x) for x in (feature, border, kind)], *[np.concatenate(x, axis=1) for x in (left, right)])
