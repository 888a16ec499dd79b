"""Scoring a stream with a fixed model."""

from __future__ import annotations

from pyspark.sql import DataFrame

from sylva.plans.model import Model


def score_stream(stream: DataFrame, model: Model, kind: str = "RawFormulaVal", out: str = "prediction") -> DataFrame:
    """Rows keep their order of arrival; scoring has no state, so no watermark is needed."""
    return model.predict(stream, kind, out)
