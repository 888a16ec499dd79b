"""Metric descriptors (``NDCG:top=10:type=Exp``) and flat metrics as weighted aggregates."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

FLAT = {"RMSE", "Logloss", "CrossEntropy", "MSLE", "MAE", "MAPE", "Quantile"}
GROUPED = {"NDCG", "DCG", "PFound", "ERR", "MRR", "PrecisionAt", "RecallAt", "MAP", "QueryAUC"}
MAXIMISED = GROUPED
_PARAMS = {"NDCG": {"top", "type", "denominator"}, "DCG": {"top", "type", "denominator"}, "PFound": {"top", "decay"}, "ERR": {"top"}, "MRR": {"top", "border"}, "PrecisionAt": {"top", "border"}, "RecallAt": {"top", "border"}, "MAP": {"top", "border"}, "QueryAUC": {"type"}, "Quantile": {"alpha"}}


@dataclass(frozen=True)
class Metric:
    name: str
    params: dict[str, str] = field(default_factory=dict)

    @property
    def maximise(self) -> bool:
        return self.name in MAXIMISED

    def number(self, key: str, default: float) -> float:
        return float(self.params.get(key, default))


def parse_metric(text: str) -> Metric:
    """``Name:key=value:...``; unknown names or keys and repeated keys are errors."""
    name, *rest = text.split(":")
    if name not in FLAT | GROUPED:
        raise ValueError(f"unknown metric {name!r}")
    params: dict[str, str] = {}
    for part in rest:
        for item in part.split(";"):
            key, eq, value = item.partition("=")
            if not eq or key not in _PARAMS.get(name, set()):
                raise ValueError(f"{name} has no parameter {key!r}")
            if key in params:
                raise ValueError(f"{key!r} is given twice in {text!r}")
            params[key] = value
    return Metric(name, params)


def flat_term(m: Metric, approx: Column, target: Column) -> Column:
    if m.name == "RMSE":
        return (approx - target) * (approx - target)
    if m.name in ("Logloss", "CrossEntropy"):
        p = F.greatest(F.lit(1e-15), F.least(F.lit(1 - 1e-15), 1 / (1 + F.exp(-approx))))
        return -(target * F.ln(p) + (1 - target) * F.ln(1 - p))
    if m.name == "MSLE":
        return F.power(F.log1p(approx) - F.log1p(target), 2)
    if m.name == "MAE":
        return F.abs(approx - target)
    if m.name == "MAPE":
        return F.abs(approx - target) / F.greatest(F.lit(1.0), F.abs(target))
    alpha = m.number("alpha", 0.5)
    e = target - approx
    return F.when(e > 0, alpha * e).otherwise((alpha - 1) * e)


def eval_flat(df: DataFrame, metrics: list[str], approx: str, target: str, weight: str | None = None) -> DataFrame:
    """One row with a column per metric, all in one aggregation."""
    w = F.col(weight) if weight else F.lit(1.0)
    out = []
    for text in metrics:
        m = parse_metric(text)
        if m.name not in FLAT:
            raise ValueError(f"{text} needs groups")
        mean = F.sum(w * flat_term(m, F.col(approx), F.col(target))) / F.sum(w)
        out.append((F.sqrt(mean) if m.name == "RMSE" else mean).alias(text))
    return df.agg(*out)


def accuracy(df: DataFrame, label: str, predicted: str) -> DataFrame:
    return df.agg(F.avg((F.col(label).cast("double") == F.col(predicted).cast("double")).cast("double")).alias("accuracy"))


def r2(df: DataFrame, label: str, predicted: str) -> DataFrame:
    """1 - residual over total sum of squares; 1 for a constant label that is met, 0 for one that isn't."""
    y, p = F.col(label).cast("double"), F.col(predicted)
    left, whole = F.sum((y - p) * (y - p)), F.var_pop(y) * F.count(y)
    return df.agg(F.when(whole > 0, 1 - left / F.when(whole > 0, whole)).when(left == 0, 1.0).otherwise(0.0).alias("r2"))
