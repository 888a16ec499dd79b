"""Estimators with the usual surface over ``GBT``: fit, predict, score, parameters, files."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sylva.functions import metrics
from sylva.plans import export
from sylva.plans.gbt import GBT, Params
from sylva.plans.model import Model, sum_models
from sylva.sources.dataset import Dataset


class SylvaError(Exception):
    """Base of this module's errors."""


class ParameterError(SylvaError, ValueError):
    """An unknown or illegal parameter."""


class NotFittedError(SylvaError, RuntimeError):
    """The estimator has no model yet."""


class DataError(SylvaError, ValueError):
    """Data that don't suit the estimator."""


class Estimator:
    """``fit(data)`` takes a Dataset, or a DataFrame with roles as keywords (``row_id``, ``features``, ``label`` ...)."""

    kind, default_loss = "", "RMSE"

    def __init__(self, **params):
        self._params = params
        self.model: Model | None = None
        self._checked()

    def _checked(self) -> Params:
        try:
            return Params.of(**({"loss": self.default_loss} | self._params))
        except ValueError as e:
            raise ParameterError(str(e)) from None

    def get_params(self, deep: bool = True) -> dict:
        return dict(self._params)

    def set_params(self, **params) -> Estimator:
        before, self._params = self._params, self._params | params
        try:
            self._checked()
        except ParameterError:
            self._params = before
            raise
        return self

    @property
    def is_fitted(self) -> bool:
        return self.model is not None

    def __sklearn_is_fitted__(self) -> bool:
        return self.is_fitted

    @property
    def _estimator_type(self) -> str:
        return self.kind

    def __sklearn_tags__(self) -> dict:
        return {"estimator_type": self.kind, "requires_fit": True, "allow_nan": True, "categorical": True}

    def _data(self, data, roles: dict) -> Dataset:
        if isinstance(data, Dataset):
            return data.with_roles(**roles) if roles else data
        if not isinstance(data, DataFrame):
            raise DataError("data must be a Dataset or a DataFrame; see Dataset.from_any for other kinds")
        return Dataset(data, **{k: tuple(v) if isinstance(v, list) else v for k, v in roles.items()})

    def fit(self, data, eval_set: Dataset | None = None, **roles) -> Estimator:
        own = self._data(data, roles)
        if own.label is None and not own.targets:
            raise DataError("no label")
        try:
            self.model = GBT(**({"loss": self.default_loss} | self._params)).fit(own, eval_set)
        except ValueError as e:
            raise DataError(str(e)) from None
        return self

    def _fitted(self) -> Model:
        if self.model is None:
            raise NotFittedError("fit or load a model first")
        return self.model

    def predict(self, df: DataFrame, out: str = "prediction", kind: str = "RawFormulaVal") -> DataFrame:
        return self._fitted().predict(df, kind, out)

    def partial_dependence(self, df: DataFrame, *features: str) -> DataFrame:
        return self._fitted().partial_dependence(df, *features)

    def feature_importance(self, df: DataFrame | None = None) -> dict[str, float]:
        return self._fitted().importance(df)

    def save_model(self, spark, path: str) -> None:
        self._fitted().save(spark, path)

    @classmethod
    def load_model(cls, spark, path: str) -> Estimator:
        out = cls()
        out.model = Model.load(spark, path)
        return out

    def save_onnx(self, spark, path: str) -> None:
        export.save(self._fitted(), spark, path, "onnx")

    def save_json(self, spark, path: str) -> None:
        export.save(self._fitted(), spark, path, "json")


class Regressor(Estimator):
    kind = "regressor"

    def save_coreml(self, spark, path: str) -> None:
        export.save(self._fitted(), spark, path, "coreml")

    def score(self, df: DataFrame, label: str) -> float:
        """R2 of the predictions."""
        return metrics.r2(self.predict(df, "__p"), label, "__p").collect()[0][0]


class Classifier(Estimator):
    kind, default_loss = "classifier", "Logloss"

    @property
    def classes_(self) -> list[float]:
        return self._fitted().classes or [0.0, 1.0]

    def predict(self, df: DataFrame, out: str = "prediction", kind: str = "Class") -> DataFrame:
        return super().predict(df, out, kind)

    def predict_proba(self, df: DataFrame, out: str = "probabilities") -> DataFrame:
        return self._fitted().predict_proba(df, out)

    def score(self, df: DataFrame, label: str) -> float:
        """Accuracy of the classes."""
        return metrics.accuracy(self.predict(df, "__p"), label, "__p").collect()[0][0]


class Ranker(Estimator):
    kind, default_loss = "ranker", "YetiRank"

    def fit(self, data, eval_set: Dataset | None = None, **roles) -> Estimator:
        own = self._data(data, roles)
        if own.group is None:
            raise DataError("a ranker needs groups")
        return super().fit(own, eval_set)


def merged(estimators: list[Estimator], weights: list[float] | None = None) -> Estimator:
    """An estimator of the first one's kind whose model is the weighted sum."""
    out = type(estimators[0])(**estimators[0].get_params())
    out.model = sum_models([e._fitted() for e in estimators], weights)
    return out


def with_classes(df: DataFrame, prediction: str, names: list[str], out: str = "class_name") -> DataFrame:
    """The names of predicted class numbers."""
    return df.withColumn(out, F.element_at(F.array(*[F.lit(n) for n in names]), F.col(prediction).cast("int") + 1))
