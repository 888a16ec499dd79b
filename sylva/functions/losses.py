"""First and second derivatives of losses (ascent direction: der1 = -dL/da).

A pointwise loss is written once over a small set of functions and evaluates on
Columns (``SPARK``) or numpy arrays (``NUMPY``). Losses of several outputs work on
matrices, one column an output; grouped losses are in ``operators.ranking``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, functions as F


class SPARK:
    exp, abs, sign, power, tanh, cosh, ln = F.exp, F.abs, F.signum, F.power, F.tanh, F.cosh, F.ln
    lit = staticmethod(lambda v, like: F.lit(v))

    @staticmethod
    def where(cond, a, b):
        return F.when(cond, a).otherwise(b)

    @staticmethod
    def clip(x, lo, hi):
        return F.greatest(F.lit(lo), F.least(F.lit(hi), x))


class NUMPY:
    exp, abs, sign, power, tanh, cosh, ln, where, clip = np.exp, np.abs, np.sign, np.power, np.tanh, np.cosh, np.log, np.where, np.clip
    lit = staticmethod(lambda v, like: np.full(np.shape(like), float(v)))


def sigmoid(a, m=SPARK):
    return 1.0 - 1.0 / (1.0 + m.exp(a))


@dataclass(frozen=True)
class Loss:
    """``ders(approx, target, functions)`` gives both derivatives; ``check`` the targets that are legal (a Column)."""

    name: str
    ders: Callable
    check: Callable[[Column], Column] | None = None
    link: str = "Raw"
    outputs: int | str = 1  # or "classes" / "targets"
    grouped: bool = False
    params: dict = field(default_factory=dict)
    default_leaf: str = "Gradient"


def quantile(alpha: float = 0.5, delta: float = 1e-6) -> Loss:
    def ders(a, t, m=SPARK):
        r = t - a
        return m.where(m.abs(r) < delta, 0.0 * r, m.where(r > 0, alpha + 0.0 * r, alpha - 1.0 + 0.0 * r)), m.lit(0.0, a)

    return Loss(f"Quantile:alpha={alpha}", ders, params={"alpha": alpha, "delta": delta})


def huber(delta: float = 1.0) -> Loss:
    def ders(a, t, m=SPARK):
        r = t - a
        inside = m.abs(r) < delta
        return m.where(inside, r, m.sign(r) * delta), m.where(inside, m.lit(-1.0, a), m.lit(0.0, a))

    return Loss(f"Huber:delta={delta}", ders, params={"delta": delta})


def lq(q: float = 2.0) -> Loss:
    """For q < 2 the second derivative has no bound as the residual goes to 0; there (exactly 0) it is 0."""

    def ders(a, t, m=SPARK):
        e = m.abs(t - a)
        near = m.where(e > 0, e, 1.0 + 0.0 * e)
        curve = m.power(near, q - 2.0) * -q * (q - 1.0)
        return m.sign(t - a) * q * m.power(e, q - 1.0), curve if q == 2 else m.where(e > 0, curve, 0.0 * e)

    return Loss(f"Lq:q={q}", ders, params={"q": q})


def expectile(alpha: float = 0.5) -> Loss:
    def ders(a, t, m=SPARK):
        e = t - a
        k = m.where(e > 0, m.lit(alpha, a), m.lit(1.0 - alpha, a))
        return 2.0 * k * e, -2.0 * k

    return Loss(f"Expectile:alpha={alpha}", ders, params={"alpha": alpha})


def tweedie(variance_power: float = 1.5) -> Loss:
    p = variance_power

    def ders(a, t, m=SPARK):
        return t * m.exp((1 - p) * a) - m.exp((2 - p) * a), t * (1 - p) * m.exp((1 - p) * a) - (2 - p) * m.exp((2 - p) * a)

    return Loss(f"Tweedie:variance_power={p}", ders, lambda t: t >= 0, "Exponent", params={"variance_power": p})


def focal(alpha: float = 0.25, gamma: float = 2.0) -> Loss:
    def ders(a, t, m=SPARK):
        p = m.clip(sigmoid(a, m), 1e-13, 1 - 1e-13)
        at, pt, y = m.where(t == 1, m.lit(alpha, a), m.lit(1 - alpha, a)), m.where(t == 1, p, 1 - p), 2 * t - 1
        u, v = at * y * m.power(1 - pt, gamma), 1 - pt - gamma * pt * m.ln(pt)
        du, dv = -gamma * at * y * m.power(1 - pt, gamma - 1), -1 - gamma * (m.ln(pt) + 1)
        return u * v, (du * v + u * dv) * y * pt * (1 - pt)

    return Loss(f"Focal:alpha={alpha};gamma={gamma}", ders, lambda t: t.isin(0, 1), "Probability", params={"alpha": alpha, "gamma": gamma})


def _rmse(a, t, m=SPARK):
    return t - a, m.lit(-1.0, a)


def _logloss(a, t, m=SPARK):
    p = sigmoid(a, m)
    return t - p, -p * (1 - p)


def _logcosh(a, t, m=SPARK):
    return -m.tanh(a - t), -1.0 / (m.cosh(a - t) * m.cosh(a - t))


def _poisson(a, t, m=SPARK):
    return t - m.exp(a), -m.exp(a)


def _mape(a, t, m=SPARK):
    size = m.where(m.abs(t) > 1, m.abs(t), m.lit(1.0, t))
    return m.where(t > a, m.lit(1.0, a), m.lit(-1.0, a)) / size, m.lit(0.0, a)


# several outputs: approx is (rows, outputs), numpy only -------------------------


def softmax_rows(a: np.ndarray) -> np.ndarray:
    e = np.exp(a - a.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _one_hot(t: np.ndarray, k: int) -> np.ndarray:
    return (np.asarray(t).reshape(-1, 1) == np.arange(k)).astype(float)


def softmax_hessian(p: np.ndarray) -> np.ndarray:
    """(rows, k, k): p_i p_j off the diagonal, -p_i (1 - p_i) on it."""
    return p[:, :, None] * p[:, None, :] - np.eye(p.shape[1]) * p[:, :, None]


def _multiclass(a, t, m=NUMPY):
    p = softmax_rows(a)
    return _one_hot(t, a.shape[1]) - p, -p * (1 - p)


def _one_vs_all(a, t, m=NUMPY):
    p = sigmoid(a, NUMPY)
    return _one_hot(t, a.shape[1]) - p, -p * (1 - p)


def _multi_label(a, t, m=NUMPY):
    p = sigmoid(a, NUMPY)
    return t - p, -p * (1 - p)


def _uncertainty(a, t, m=NUMPY):
    """Outputs: mean and logarithm of the scale. The mean's step leaves the precision out."""
    r = np.asarray(t).reshape(-1) - a[:, 0]
    z = r * r * np.exp(-2.0 * a[:, 1])
    return np.stack([r, z - 1.0], axis=1), np.stack([np.full(len(r), -1.0), -2.0 * z], axis=1)


def multi_quantile(alpha: tuple[float, ...] = (0.5,), delta: float = 1e-6) -> Loss:
    parts = [quantile(x, delta) for x in alpha]

    def ders(a, t, m=NUMPY):
        t = np.asarray(t).reshape(-1)
        return np.stack([p.ders(a[:, i], t, NUMPY)[0] for i, p in enumerate(parts)], axis=1), np.zeros_like(a)

    return Loss(f"MultiQuantile:alpha={','.join(map(str, alpha))}", ders, outputs=len(alpha), params={"alpha": tuple(alpha), "delta": delta})


def _no_ders(a, t, m=SPARK):
    raise TypeError("derivatives of a grouped loss need the whole group: see operators.ranking")


def _grouped(name: str, leaf: str = "Gradient", **defaults) -> Callable[..., Loss]:
    def make(**params) -> Loss:
        unknown = set(params) - set(defaults)
        if unknown:
            raise ValueError(f"{name} has no parameters {sorted(unknown)}")
        return Loss(name, _no_ders, grouped=True, params=defaults | params, default_leaf=leaf)

    return make


LOSSES: dict[str, Callable[..., Loss]] = {
    "RMSE": lambda: Loss("RMSE", _rmse),
    "Logloss": lambda: Loss("Logloss", _logloss, lambda t: t.isin(0, 1), "Probability"),
    "CrossEntropy": lambda: Loss("CrossEntropy", _logloss, lambda t: t.between(0, 1), "Probability"),
    "MAE": lambda: Loss("MAE", quantile().ders, params={"alpha": 0.5, "delta": 1e-6}),
    "Quantile": quantile,
    "LogCosh": lambda: Loss("LogCosh", _logcosh),
    "Lq": lq,
    "Huber": huber,
    "Expectile": expectile,
    "Poisson": lambda: Loss("Poisson", _poisson, lambda t: t >= 0, "Exponent"),
    "Tweedie": tweedie,
    "MAPE": lambda: Loss("MAPE", _mape),
    "Focal": focal,
    "MultiClass": lambda: Loss("MultiClass", _multiclass, link="Softmax", outputs="classes"),
    "MultiClassOneVsAll": lambda: Loss("MultiClassOneVsAll", _one_vs_all, link="OneVsAll", outputs="classes"),
    "MultiLogloss": lambda: Loss("MultiLogloss", _multi_label, lambda t: t.isin(0, 1), "MultiLabel", "targets"),
    "MultiCrossEntropy": lambda: Loss("MultiCrossEntropy", _multi_label, lambda t: t.between(0, 1), "MultiLabel", "targets"),
    "RMSEWithUncertainty": lambda: Loss("RMSEWithUncertainty", _uncertainty, link="Uncertainty", outputs=2),
    "MultiQuantile": multi_quantile,
    "QueryRMSE": _grouped("QueryRMSE"),
    "QuerySoftMax": _grouped("QuerySoftMax", beta=1.0, **{"lambda_": 0.01}),
    "PairLogit": _grouped("PairLogit"),
    "PairLogitPairwise": _grouped("PairLogitPairwise"),
    "LambdaMart": _grouped("LambdaMart", metric="NDCG", sigma=1.0, top=-1, norm=True),
    "YetiRank": _grouped("YetiRank", permutations=10, decay=0.85),
    "YetiRankPairwise": _grouped("YetiRankPairwise", permutations=10, decay=0.85),
    "StochasticRank": _grouped("StochasticRank", metric="NDCG", sigma=1.0, mu=0.0, num_estimations=1),
}


def make_loss(name: str, **params) -> Loss:
    """By name, with parameters as arguments or in the name: ``Quantile:alpha=0.7``."""
    base, _, rest = name.partition(":")
    if base not in LOSSES:
        raise ValueError(f"unknown loss {base!r}; known: {sorted(LOSSES)}")
    for item in filter(None, rest.replace(";", ":").split(":")):
        key, eq, value = item.partition("=")
        if not eq:
            raise ValueError(f"no value for {key!r} in {name!r}")
        if "," in value:
            params[key] = tuple(float(v) for v in value.split(","))
        else:
            try:
                params[key] = float(value)
            except ValueError:
                params[key] = {"true": True, "false": False}.get(value.lower(), value)
    if base == "MultiQuantile" and isinstance(params.get("alpha"), float):
        params["alpha"] = (params["alpha"],)
    try:
        return LOSSES[base](**params)
    except TypeError as e:
        raise ValueError(f"{base}: {e}") from None


# several outputs as Columns over arrays --------------------------------------------


def softmax(approx: Column) -> Column:
    """Softmax of an array, shifted by its maximum."""
    e = F.transform(approx, lambda x: F.exp(x - F.array_max(approx)))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda s, y: s + y))


def multiclass_der1(approx: Column, target: Column) -> Column:
    return F.transform(softmax(approx), lambda p, i: F.when(i == target, 1.0).otherwise(0.0) - p)


def one_vs_all_der1(approx: Column, target: Column) -> Column:
    return F.transform(approx, lambda a, i: F.when(i == target, 1.0).otherwise(0.0) - sigmoid(a))


def uncertainty_ders(mean: Column, log_scale: Column, target: Column) -> tuple[Column, Column]:
    """Steps of mean and log scale under the normal likelihood; the mean's leaves the precision out."""
    r = target - mean
    return r, r * r * F.exp(-2 * log_scale) - 1
