"""A DataFrame with the roles of its columns."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession, functions as F


@dataclass(frozen=True)
class Dataset:
    """Lazy; ``validate`` runs one aggregation."""

    df: DataFrame
    row_id: str
    features: tuple[str, ...] = ()
    cats: tuple[str, ...] = ()
    texts: tuple[str, ...] = ()
    vectors: tuple[str, ...] = ()
    label: str | None = None
    targets: tuple[str, ...] = ()  # of losses with several labels
    weight: str | None = None
    group: str | None = None
    subgroup: str | None = None
    baseline: str | None = None
    pairs: DataFrame | None = None  # winner, loser, weight

    @staticmethod
    def from_any(spark: SparkSession, data, row_id: str = "row_id", **roles) -> Dataset:
        """A DataFrame, a path of Parquet files, pandas, an Arrow table, anything with ``to_arrow``, or a 2-D float32 array."""
        if isinstance(data, str):
            data = spark.read.parquet(data)
        if hasattr(data, "to_arrow"):
            data = data.to_arrow()
        if hasattr(data, "dtype"):
            import pandas as pd

            if data.ndim != 2 or str(data.dtype) != "float32":
                raise TypeError("arrays must be 2-D and float32")
            data = pd.DataFrame(data, columns=[f"f{i}" for i in range(data.shape[1])])
            roles.setdefault("features", tuple(data.columns))
        if not isinstance(data, DataFrame):
            if row_id not in getattr(data, "columns", []) and row_id not in getattr(data, "column_names", []):
                n = len(data)
                data = data.assign(**{row_id: range(n)}) if hasattr(data, "assign") else data.append_column(row_id, [list(range(n))])
            data = spark.createDataFrame(data)
        return Dataset(data, row_id, **{k: tuple(v) if isinstance(v, list) else v for k, v in roles.items()})

    def with_roles(self, **roles) -> Dataset:
        return replace(self, **roles)

    def columns(self) -> list[str]:
        return [c for c in (self.row_id, *self.features, *self.cats, *self.texts, *self.vectors, self.label, *self.targets, self.weight, self.group, self.subgroup, self.baseline) if c]

    def ignore(self, names: list[str]) -> Dataset:
        unknown = set(names) - set(self.features) - set(self.cats)
        if unknown:
            raise ValueError(f"no such features: {sorted(unknown)}")
        return replace(self, features=tuple(f for f in self.features if f not in names), cats=tuple(c for c in self.cats if c not in names))

    def column(self, role: str, index: int = 0) -> DataFrame:
        """(row id, value) of a role's column: ``column("features", 2)``, ``column("label")``."""
        value = getattr(self, role, None) if role in ("features", "cats", "texts", "vectors", "targets", "label", "weight", "group", "subgroup", "baseline") else None
        name = value if isinstance(value, str) else value[index] if isinstance(value, tuple) and 0 <= index < len(value) else None
        if name is None:
            raise ValueError(f"no column {index} with the role {role!r}")
        return self.df.select(self.row_id, F.col(name).alias("value"))

    @property
    def num_row(self) -> int:
        return self.df.count()

    @property
    def num_col(self) -> int:
        return len(self.features) + len(self.cats) + len(self.texts) + len(self.vectors)

    def take(self, rows: DataFrame) -> Dataset:
        """Rows by id, as often as listed; pairs are dropped."""
        return replace(self, df=rows.select(self.row_id).join(self.df, self.row_id), pairs=None)

    def validate(self) -> Dataset:
        """Raises for repeated row ids, missing categories or labels, negative weights, vectors of different lengths, pairs of unknown rows."""
        checks = {"rows": F.count(F.lit(1)), "ids": F.count_distinct(self.row_id)}
        for c in self.cats:
            checks[f"category {c} is missing"] = F.count_if(F.col(c).isNull())
        if self.label:
            checks["the label is missing"] = F.count_if(F.col(self.label).isNull() | F.isnan(F.col(self.label).cast("double")))
        if self.weight:
            checks["a weight is negative or missing"] = F.count_if(F.col(self.weight).isNull() | (F.col(self.weight) < 0))
        for v in self.vectors:
            checks[f"lengths of {v}"] = F.count_distinct(F.size(v))
        got = self.df.agg(*[e.alias(k) for k, e in checks.items()]).collect()[0].asDict()
        if got["rows"] != got["ids"]:
            raise ValueError("row ids are missing or repeated")
        for k, n in got.items():
            if (k.startswith("lengths") and n > 1) or (k.endswith(("missing",)) and n):
                raise ValueError(f"{k}: {n}")
        if self.pairs is not None:
            ends = self.pairs.select(F.explode(F.array("winner", "loser")).alias(self.row_id))
            if ends.join(self.df.select(self.row_id), self.row_id, "left_anti").limit(1).count():
                raise ValueError("pairs name unknown rows")
        return self
