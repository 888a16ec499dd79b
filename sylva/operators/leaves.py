"""Leaf values that are more than one quotient: exact quantiles, LogCosh, block Newton, monotone trees."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from sylva.plans import grower


def _residuals(b, rows: grower.Rows):
    x = rows.bins(b)
    a = rows.approx(b, x)
    t = b.column("l0").to_numpy(zero_copy_only=False)
    return x, (t[:, None] - a).astype(np.float32), b.column("weight").to_numpy(zero_copy_only=False).astype(float)


def _ordered(r: np.ndarray) -> np.ndarray:
    """32-bit floats as unsigned integers in the same order; -0.0 is 0.0."""
    u = (r + np.float32(0.0)).view(np.uint32)
    return np.where(u >> 31, ~u, u | np.uint32(1 << 31)).astype(np.uint32)


def _float(u: np.ndarray) -> np.ndarray:
    u = u.astype(np.uint32)
    return np.where(u >> 31, u & np.uint32(0x7FFFFFFF), ~u).astype(np.uint32).view(np.float32)


def quantiles(x: DataFrame, rows: grower.Rows, tree: grower.Grown, alphas: list[float], delta: float) -> tuple[np.ndarray, np.ndarray]:
    """Per node and output the weighted quantile of residuals, moved by ``delta`` to the side that balances; and node weights.

    The residuals' bits are settled a byte at a time: four passes of histograms, whatever a leaf holds.
    """
    compiled, n, k = tree.compiled(), len(tree.feature), rows.outputs
    prefix = np.zeros((n, k), dtype=np.uint64)
    below = np.zeros((n, k))  # weight under the prefix
    total = None
    for step in range(4):
        shift = 24 - 8 * step

        def run(batches, prefix=prefix, shift=shift, step=step):
            sums = np.zeros((n * k * 256, 2))
            for b in batches:
                bins, r, w = _residuals(b, rows)
                at = grower.walk(compiled, bins)
                for j in range(k):
                    u = _ordered(r[:, j]).astype(np.uint64)
                    keep = np.ones(len(u), dtype=bool) if not step else (u >> np.uint64(shift + 8)) == prefix[at, j]
                    cell = ((at * k + j) * 256 + (u >> np.uint64(shift) & np.uint64(255)).astype(np.int64))[keep]
                    sums[:, 0] += np.bincount(cell, weights=w[keep], minlength=len(sums))
                    sums[:, 1] += np.bincount(cell, minlength=len(sums))
            yield grower._emit(sums)

        cell, got = grower._sums(x.select(*rows.columns()), run, 2, 1)
        h = np.zeros((n * k * 256, 2))
        h[cell] = got
        h = h.reshape(n, k, 256, 2)
        if total is None:
            total = h[..., 0].sum(axis=2)
        need = total * np.array(alphas)
        run_ = below[:, :, None] + np.cumsum(h[..., 0], axis=2)
        some = h[..., 1] > 0
        reached = some & (run_ >= need[:, :, None] - np.finfo(float).eps)
        last = np.where(some.any(axis=2), 255 - some[:, :, ::-1].argmax(axis=2), 0)
        byte = np.where(reached.any(axis=2), reached.argmax(axis=2), last)
        below = below + np.where(np.arange(256) < byte[:, :, None], h[..., 0], 0.0).sum(axis=2)
        equal = np.take_along_axis(h[..., 0], byte[:, :, None], axis=2)[:, :, 0]
        prefix = prefix << np.uint64(8) | byte.astype(np.uint64)
    value = _float(prefix).astype(float)
    if delta > 0:
        value = value + np.where(below + equal * np.array(alphas) >= need - np.finfo(float).eps, -delta, delta)
    return np.where(total > 0, value, 0.0), total[:, 0]


def log_cosh(x: DataFrame, rows: grower.Rows, tree: grower.Grown, points: int = 63, precision: float = 1e-9) -> tuple[np.ndarray, np.ndarray]:
    """Per node the value v with sum(w tanh(v - r)) = 0: every pass tries ``points`` places of the interval left."""
    compiled, n = tree.compiled(), len(tree.feature)

    def span(batches):
        lo, hi, weight = np.full(n, np.inf), np.full(n, -np.inf), np.zeros(n)
        for b in batches:
            bins, r, w = _residuals(b, rows)
            at = grower.walk(compiled, bins)
            np.minimum.at(lo, at, r[:, 0].astype(float))
            np.maximum.at(hi, at, r[:, 0].astype(float))
            weight += np.bincount(at, weights=w, minlength=n)
        import pyarrow as pa

        yield pa.RecordBatch.from_arrays([pa.array(np.arange(n)), pa.array(lo), pa.array(hi), pa.array(weight)], ["node", "lo", "hi", "w"])

    from pyspark.sql import functions as F

    got = x.select(*rows.columns()).mapInArrow(span, "node long, lo double, hi double, w double").groupBy("node").agg(F.min("lo"), F.max("hi"), F.sum("w")).toArrow().to_pandas().sort_values("node")
    lo, hi, weight = (got.iloc[:, i].to_numpy(dtype=float).copy() for i in (1, 2, 3))
    empty = ~np.isfinite(lo)
    lo[empty] = hi[empty] = 0.0
    while (hi - lo).max(initial=0.0) > precision:
        grid = lo[:, None] + (hi - lo)[:, None] * np.arange(1, points + 1) / (points + 1)

        def run(batches, grid=grid):
            sums = np.zeros((n * points, 2))
            for b in batches:
                bins, r, w = _residuals(b, rows)
                at = grower.walk(compiled, bins)
                for a in range(0, len(at), 20_000):
                    part = at[a : a + 20_000]
                    value = np.tanh(grid[part] - r[a : a + 20_000, :1]) * w[a : a + 20_000, None]
                    cell = part[:, None] * points + np.arange(points)
                    sums[:, 0] += np.bincount(cell.ravel(), weights=value.ravel(), minlength=len(sums))
                    sums[:, 1] += np.bincount(cell.ravel(), minlength=len(sums))
            yield grower._emit(sums)

        cell, got = grower._sums(x.select(*rows.columns()), run, 2, 1)
        g = np.zeros(n * points)
        g[cell] = got[:, 0]
        up = (g.reshape(n, points) > 0).astype(int)
        first = np.where(up.any(axis=1), up.argmax(axis=1), points)
        edges = np.concatenate([lo[:, None], grid, hi[:, None]], axis=1)
        new_lo, new_hi = edges[np.arange(n), first], edges[np.arange(n), first + 1]
        if (new_hi - new_lo >= hi - lo).all():
            break
        lo, hi = new_lo, new_hi
    return lo[:, None], weight


def exact_leaf_values(at: DataFrame, alpha: float, blocks: int = 64) -> DataFrame:
    """(node, value): the least residual whose cumulated weight reaches alpha of the leaf's.

    Equal residuals are merged; sums of blocks between quantiles come first, so a leaf's residuals are in order only inside a block.
    """
    from pyspark.sql import functions as F

    from sylva.operators.encoding import block_of, prefix_sums

    r = at.groupBy("node", (F.col("label") - F.col("approx")).cast("float").alias("r")).agg(F.sum("weight").alias("w"))
    whole = r.groupBy("node").agg(F.sum("w").alias("all"))
    x = prefix_sums(r, ["node"], block_of(r, "r", blocks), ["r"], {"before": F.col("w")})
    return x.join(whole, "node").where(F.col("before") + F.col("w") >= alpha * F.col("all") - 1e-9).groupBy("node").agg(F.min("r").cast("double").alias("value"))


def exact_values(x: DataFrame, rows: grower.Rows, tree: grower.Grown, loss) -> tuple[np.ndarray, np.ndarray]:
    if loss.name == "LogCosh":
        return log_cosh(x, rows, tree)
    alpha = loss.params["alpha"]
    return quantiles(x, rows, tree, list(alpha) if isinstance(alpha, tuple) else [alpha], loss.params["delta"])


def block_newton(der: np.ndarray, packed: np.ndarray, l2: float) -> np.ndarray:
    """Per node the solution of (l2 - H) v = der; ``packed`` is the upper half of H."""
    n, k = der.shape
    h = np.zeros((n, k, k))
    i, j = np.triu_indices(k)
    h[:, i, j] = packed
    h[:, j, i] = packed
    a = np.eye(k) * l2 - h
    out = np.zeros((n, k))
    for m in range(n):
        if der[m].any():
            out[m] = np.linalg.lstsq(a[m], der[m], rcond=None)[0]
    return out


def levels(tree: grower.Grown) -> list[int]:
    """The feature of each level of a symmetric tree."""
    out, at = [], 0
    while tree.feature[at] >= 0:
        out.append(tree.feature[at])
        at = tree.left[at]
    return out


def isotonic(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The nearest ascending sequence by weighted squares: neighbours out of order are pooled."""
    blocks: list[list[float]] = []  # weight, weighted sum, length
    for v, w in zip(values, weights, strict=True):
        blocks.append([w, w * v, 1, v])
        while len(blocks) > 1:
            (w0, s0, n0, v0), (w1, s1, n1, v1) = blocks[-2:]
            a, b = s0 / w0 if w0 else v0, s1 / w1 if w1 else v1
            if a < b:
                break
            blocks[-2:] = [[w0 + w1, s0 + s1, n0 + n1, (v0 + v1) / 2]]
    return np.concatenate([np.full(n, s / w if w else v) for w, s, n, v in blocks])


def monotone(tree: grower.Grown, constraints: list[int], values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Values of a symmetric tree's leaves that rise (1) or fall (-1) along constrained levels.

    Leaves that agree in the free levels form a line: in the order of their constrained sides, first level first.
    """
    paths: dict[tuple, list[tuple[tuple, int]]] = {}
    stack = [(0, ())]
    while stack:
        at, path = stack.pop()
        if tree.feature[at] >= 0:
            stack += [(tree.left[at], (*path, 0)), (tree.right[at], (*path, 1))]
            continue
        free = tuple(s for s, c in zip(path, constraints, strict=True) if not c)
        rank = tuple(s if c > 0 else 1 - s for s, c in zip(path, constraints, strict=True) if c)
        paths.setdefault(free, []).append((rank, at))
    out = values.copy()
    for line in paths.values():
        order = [at for _, at in sorted(line)]
        for j in range(values.shape[1]):
            out[order, j] = isotonic(values[order, j], weights[order])
    return out
