"""Tree models: application, storage, merging and explanation."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass, field
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from sylva.operators.binning import F32_MAX


@dataclass
class Node:
    """A split (feature, border or category, children) or a leaf (value: a number, or a list for several outputs); ``weight`` is the training weight that reached it."""

    feature: int = -1
    border: float = 0.0
    left: int = -1
    right: int = -1
    value: float | list[float] = 0.0
    weight: float = 0.0
    missing_right: bool = False
    category: str | None = None  # right if the feature equals it


@dataclass
class Ctr:
    """A target statistic as a feature: its table (a DataFrame with ``cats``, total, good, target_sum) and how a bin comes from it."""

    name: str
    cats: list[str]
    kind: str
    prior: float
    bins: int
    size: int  # distinct keys
    top: float = 0.0  # the largest total (Counter)
    table: DataFrame | None = None

    def value(self, good: Column, total: Column) -> Column:
        """The bin: the statistic, shifted and scaled to 0..1, times the number of bins."""
        shift, norm = -min(0.0, self.prior), max(1.0, self.prior) - min(0.0, self.prior)
        ctr = (good + self.prior) / (total + 1.0)
        return F.least(F.lit(self.bins - 1), F.floor((ctr + shift) / norm * self.bins)).cast("int")

    def of_table(self) -> Column:
        if self.kind == "Counter":
            return self.value(F.coalesce("total", F.lit(0)).cast("double"), F.lit(self.top))
        good = F.col("good") if self.kind in ("Borders", "Buckets") else F.col("target_sum")
        return self.value(F.coalesce(good.cast("double"), F.lit(0.0)), F.coalesce("total", F.lit(0)).cast("double"))


@dataclass
class Tree:
    nodes: list[Node] = field(default_factory=list)

    def passes(self, n: Node, features: list[Column]) -> Column:
        """Whether a row goes right at the node."""
        x = features[n.feature]
        if n.category is not None:
            return F.coalesce(x.cast("string") == F.lit(n.category), F.lit(False))
        v = x.cast("float")
        return F.when(v.isNull() | F.isnan(v), F.lit(n.missing_right)).otherwise(v > F.lit(n.border).cast("float"))

    def levels(self) -> list[int] | None:
        """The first node of each level if all nodes of a level split alike (a symmetric tree), else None."""
        out, now = [], [0]
        while any(self.nodes[i].feature >= 0 for i in now):
            kinds = {(self.nodes[i].feature, self.nodes[i].border, self.nodes[i].category) for i in now}
            if len(kinds) > 1:
                return None
            out.append(now[0])
            now = [c for i in now for c in (self.nodes[i].left, self.nodes[i].right)]
        return out

    def by_bits(self) -> tuple[list[Node], list[Node]] | None:
        """Splits and leaves of a symmetric tree; bit i of a leaf's number is set if split i passes."""
        levels = self.levels()
        if levels is None:
            return None
        leaves = []
        for leaf in range(1 << len(levels)):
            at = 0
            for i in range(len(levels)):
                at = self.nodes[at].right if leaf >> i & 1 else self.nodes[at].left
            leaves.append(self.nodes[at])
        return [self.nodes[i] for i in levels], leaves

    def leaf_index(self, features: list[Column]) -> Column:
        """The leaf's number: bits for a symmetric tree, else the node's."""
        both = self.by_bits()
        if both is None:
            return self.column(features, leaf=lambda i: F.lit(i))
        return sum((self.passes(n, features).cast("int") * (1 << i) for i, n in enumerate(both[0])), F.lit(0))

    def column(self, features: list[Column], at: int = 0, output: int | None = None, leaf: Callable[[int], Column] | None = None) -> Column:
        """The value (or ``output`` of it). A symmetric tree looks its leaf up by number, so the expression grows with depth, not with leaves."""
        if at == 0 and leaf is None and self.nodes[0].feature >= 0 and (both := self.by_bits()) is not None:
            values = [n.value if output is None else n.value[output] for n in both[1]]
            return F.element_at(F.array(*[F.lit(float(v)) for v in values]), self.leaf_index(features) + 1)
        n = self.nodes[at]
        if n.feature < 0:
            return leaf(at) if leaf else F.lit(float(n.value if output is None else n.value[output]))
        return F.when(self.passes(n, features), self.column(features, n.right, output, leaf)).otherwise(self.column(features, n.left, output, leaf))

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        """Leaf numbers of the rows of a float32 matrix."""
        at = np.zeros(len(x), dtype=np.int64)
        feature = np.array([n.feature for n in self.nodes])
        border = np.array([n.border for n in self.nodes], dtype=np.float32)
        left, right = np.array([n.left for n in self.nodes]), np.array([n.right for n in self.nodes])
        missing = np.array([n.missing_right for n in self.nodes])
        rows = np.arange(len(x))
        while True:
            open_ = feature[at] >= 0
            if not open_.any():
                return at
            i = rows[open_]
            v = x[i, feature[at[i]]]
            go = np.where(np.isnan(v), missing[at[i]], v > border[at[i]])
            at[i] = np.where(go, right[at[i]], left[at[i]])


def alike(trees: list[Tree], x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One row of a float32 matrix for each way through the trees' borders, and which of these stands for each row."""
    code = np.zeros(len(x), dtype=np.int64)
    first = np.zeros(min(1, len(x)), dtype=np.int64)
    for f in sorted({n.feature for t in trees for n in t.nodes if n.feature >= 0}):
        borders = np.unique(np.array([n.border for t in trees for n in t.nodes if n.feature == f], dtype=np.float32))
        v = x[:, f]
        bins = np.where(np.isnan(v), len(borders) + 1, np.searchsorted(borders, v))  # the number of borders below the value
        _, first, code = np.unique(code * (len(borders) + 2) + bins, return_index=True, return_inverse=True)
        if 2 * len(first) > len(x):  # hardly any are
            return x, np.arange(len(x))
    return x[first], code


#: Stands for a missing category.
MISSING = "\u0001"


def category(name: str) -> Column:
    """A column as a key of statistics; missing values are a category of their own."""
    return F.coalesce(_quoted(name).cast("string"), F.lit(MISSING))


def _quoted(name: str) -> Column:
    return F.col(name if re.fullmatch(r"\w+", name) else f"`{name}`")


@dataclass
class Model:
    features: list[str]
    trees: list[Tree] = field(default_factory=list)
    bias: float | list[float] = 0.0
    link: str = "Raw"
    borders: dict[str, list[float]] = field(default_factory=dict)
    history: dict[str, list[float]] = field(default_factory=dict)
    classes: list[float] | None = None
    ctrs: list[Ctr] = field(default_factory=list)
    cats: list[str] = field(default_factory=list)
    learning_rate: float = 0.0

    @property
    def outputs(self) -> int:
        return len(self.bias) if isinstance(self.bias, list) else 1

    @property
    def numeric(self) -> bool:
        """No categories: numpy may apply it."""
        return not self.cats and not self.ctrs and all(n.category is None for t in self.trees for n in t.nodes)

    def scale(self, k: float) -> None:
        """Multiply all that the model says."""
        times = lambda v: [x * k for x in v] if isinstance(v, list) else v * k
        self.bias = times(self.bias)
        for t in self.trees:
            for n in t.nodes:
                n.value = times(n.value)

    # application ---------------------------------------------------------

    def columns(self) -> list[Column]:
        return [_quoted(f) for f in self.features]

    def prepared(self, df: DataFrame) -> DataFrame:
        """``df`` with the columns of target statistics: a left join with each table; unseen keys count 0."""
        for cats in dict.fromkeys(tuple(c.cats) for c in self.ctrs):
            own = [c for c in self.ctrs if tuple(c.cats) == cats]
            keys = [f"__key{i}" for i in range(len(cats))]
            t = own[0].table.select(*[F.col(c).alias(k) for c, k in zip(own[0].table.columns, keys, strict=False)], "total", "good", "target_sum")
            joined = df.withColumns({k: category(c) for k, c in zip(keys, cats, strict=True)}).join(t, keys, "left")
            df = joined.withColumns({c.name: c.of_table() for c in own}).drop(*keys, "total", "good", "target_sum")
        return df

    def raw_column(self, start: int = 0, end: int | None = None) -> Column:
        cols = self.columns()
        if self.outputs == 1:
            out = F.lit(self.bias if start == 0 else 0.0)
            for t in self.trees[start:end]:
                out = out + t.column(cols)
            return out
        each = [F.lit(b if start == 0 else 0.0) for b in self.bias]
        for t in self.trees[start:end]:
            each = [e + t.column(cols, output=i) for i, e in enumerate(each)]
        return F.array(*each)

    def predict(self, df: DataFrame, kind: str = "RawFormulaVal", out: str = "prediction", start: int = 0, end: int | None = None) -> DataFrame:
        """Small models become one expression inside codegen, larger ones numpy over Arrow batches, where rows that no border tells apart go through the trees once."""
        trees, names = self.trees[start:end], df.columns
        if sum(len(t.nodes) for t in trees) * self.outputs <= 2000 or not self.numeric:
            got = self.prepared(df).withColumn(out, self.prediction(self.raw_column(start, end), kind))
            return got.select(*[_quoted(c) for c in names if c != out], out) if self.ctrs else got
        shared = df.sparkSession.sparkContext.broadcast(json.dumps([[asdict(n) for n in t.nodes] for t in trees]))
        bias, k = np.array(self.bias if isinstance(self.bias, list) else [self.bias], dtype=float) * (start == 0), self.outputs

        @F.pandas_udf("double" if k == 1 else "array<double>")
        def raw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
            own = [Tree([Node(**n) for n in t]) for t in json.loads(shared.value)]
            values = [np.array([n.value if n.feature < 0 else [0.0] * k if k > 1 else 0.0 for n in t.nodes], dtype=float).reshape(-1, k) for t in own]
            for frames in batches:
                rows, which = alike(own, frames.to_numpy(dtype=np.float32, na_value=np.nan))
                total = np.tile(bias, (len(rows), 1))
                for t, v in zip(own, values, strict=True):
                    total += v[t.leaf_of(rows)]
                total = total[which]
                yield pd.Series(total[:, 0] if k == 1 else list(total))

        packed = F.struct(*[c.cast("float").alias(f"f{i}") for i, c in enumerate(self.columns())])
        return df.withColumn(out, self.prediction(raw(packed), kind))

    def prediction(self, raw: Column, kind: str) -> Column:
        """A prediction type of the raw value (or array of values)."""
        if self.outputs == 1:
            return prediction(raw, kind)
        each = F.transform(raw, lambda x: 1 / (1 + F.exp(-x)))
        if self.link == "Softmax":
            e = F.transform(raw, lambda x: F.exp(x - F.array_max(raw)))
            each = F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda s, y: s + y))
        if self.link == "Uncertainty":
            kinds = {"RawFormulaVal": raw, "RMSEWithUncertainty": F.array(raw[0], F.exp(2 * raw[1]))}
        else:
            kinds = {"RawFormulaVal": raw, "Probability": each, "LogProbability": F.transform(each, lambda p: F.ln(p))}
            if self.link == "MultiLabel":
                kinds["Class"] = F.transform(raw, lambda x: (x > 0).cast("double"))
            elif self.classes:
                kinds["Class"] = F.element_at(F.array(*[F.lit(float(c)) for c in self.classes]), F.array_position(raw, F.array_max(raw)).cast("int"))
        if kind not in kinds:
            raise ValueError(f"no prediction type {kind!r} for this model")
        return kinds[kind]

    def predict_proba(self, df: DataFrame, out: str = "probabilities") -> DataFrame:
        """An array with the probability of each class; [1 - p, p] for two."""
        if self.outputs > 1:
            return self.predict(df, "Probability", out)
        got = self.predict(df, "Probability", out)
        return got.withColumn(out, F.array(1 - F.col(out), F.col(out)))

    def leaf_indexes(self, df: DataFrame, row_id: str, out: str = "leaves") -> DataFrame:
        """(row, an array with the leaf's number in every tree)."""
        return self.prepared(df).select(row_id, F.array(*[t.leaf_index(self.columns()) for t in self.trees]).alias(out))

    def leaf_weights(self, df: DataFrame, weight: str | None = None) -> DataFrame:
        """(tree, leaf, weight) over a table: one pass for all trees, one row a tree only inside the aggregation."""
        own = self.prepared(df).select((_quoted(weight) if weight else F.lit(1.0)).alias("w"), F.posexplode(F.array(*[t.leaf_index(self.columns()) for t in self.trees])).alias("tree", "leaf"))
        return own.groupBy("tree", "leaf").agg(F.sum("w").alias("weight"))

    def staged_predict(self, df: DataFrame, row_id: str, period: int = 1) -> DataFrame:
        """(row, trees, prediction) after every ``period`` trees."""
        cols, total, stages = self.columns(), F.lit(self.bias), []
        x = self.prepared(df).select(row_id, *[t.column(cols).alias(f"_t{i}") for i, t in enumerate(self.trees)])
        for i in range(len(self.trees)):
            total = total + F.col(f"_t{i}")
            if (i + 1) % period == 0 or i + 1 == len(self.trees):
                stages.append(F.struct(F.lit(i + 1).alias("trees"), total.alias("prediction")))
        return x.select(row_id, F.explode(F.array(*stages)).alias("s")).select(row_id, "s.trees", "s.prediction")

    def virtual_ensembles(self, df: DataFrame, count: int = 10, out: str = "ensembles", kind: str = "RawFormulaVal") -> DataFrame:
        """Predictions of ``count`` models that end at growing numbers of trees, an array; for kind TotalUncertainty
        [mean, variance of the means, mean of the variances] (models with uncertainty)."""
        n = len(self.trees)
        step = n // (2 * count) if count > 0 else 0
        if not step or step * count >= n:
            raise ValueError(f"{count} virtual ensembles need {2 * count + 1} trees")
        ends = [n - step * (count - 1 - i) for i in range(count)]
        each = [self.raw_column(0, e) for e in ends]
        if kind == "RawFormulaVal":
            return self.prepared(df).withColumn(out, F.array(*each))
        if self.link != "Uncertainty":
            raise ValueError("uncertainty needs a model of RMSEWithUncertainty")
        if kind == "VirtEnsembles":
            return self.prepared(df).withColumn(out, F.array(*[F.array(e[0], F.exp(2 * e[1])) for e in each]))
        got = self.prepared(df).withColumn("__ve", F.array(*each))
        mean = lambda f: F.aggregate("__ve", F.lit(0.0), lambda s, x: s + f(x)) / count
        got = got.withColumn("__mean", mean(lambda x: x[0]))
        return got.withColumn(out, F.array(F.col("__mean"), mean(lambda x: (x[0] - F.col("__mean")) * (x[0] - F.col("__mean"))), mean(lambda x: F.exp(2 * x[1])))).drop("__ve", "__mean")

    # storage -------------------------------------------------------------

    def to_json(self) -> str:
        own = {"features": self.features, "bias": self.bias, "link": self.link, "borders": self.borders, "history": self.history, "classes": self.classes, "cats": self.cats, "learning_rate": self.learning_rate}
        ctrs = [{k: getattr(c, k) for k in ("name", "cats", "kind", "prior", "bins", "size", "top")} for c in self.ctrs]
        return json.dumps(own | {"ctrs": ctrs, "trees": [[asdict(n) for n in t.nodes] for t in self.trees]})

    @staticmethod
    def from_json(text: str) -> Model:
        d = json.loads(text)
        trees = [Tree([Node(**n) for n in t]) for t in d.pop("trees")]
        for t in trees:
            for n in t.nodes:
                if n.feature >= len(d["features"]) or (n.feature >= 0 and not (0 < n.left < len(t.nodes) and 0 < n.right < len(t.nodes))):
                    raise ValueError("malformed tree")
        return Model(trees=trees, **(d | {"ctrs": [Ctr(**c) for c in d.get("ctrs", [])]}))

    def save(self, spark, path: str) -> None:
        """The model's JSON, and the tables of its statistics beside it."""
        spark.createDataFrame([(self.to_json(),)], "model string").coalesce(1).write.mode("overwrite").parquet(f"{path}/model")
        for i, c in enumerate(self.ctrs):
            c.table.write.mode("overwrite").parquet(f"{path}/ctr-{i}")

    @staticmethod
    def load(spark, path: str) -> Model:
        m = Model.from_json(spark.read.parquet(f"{path}/model").collect()[0]["model"])
        for i, c in enumerate(m.ctrs):
            c.table = spark.read.parquet(f"{path}/ctr-{i}")
        return m

    def tree_table(self, spark) -> DataFrame:
        rows = [(i, j, n.feature, float(n.border), n.left, n.right, [float(v) for v in (n.value if isinstance(n.value, list) else [n.value])], float(n.weight), n.missing_right, n.category) for i, t in enumerate(self.trees) for j, n in enumerate(t.nodes)]
        return spark.createDataFrame(rows, "tree int, node int, feature int, border double, left int, right int, value array<double>, weight double, missing_right boolean, category string")

    # explanation ---------------------------------------------------------

    def importance(self, df: DataFrame | None = None, weight: str | None = None) -> dict[str, float]:
        """PredictionValuesChange: how far a split moves the prediction, by weight (of training, or of ``df``), as shares of 100."""
        out, trees = np.zeros(len(self.features)), self.trees
        if df is not None:
            trees = [self._reweighted(t, {r["leaf"]: r["weight"] for r in rows}) for t, rows in self._by_tree(df, weight)]
        for t in trees:
            mean = _means(t)
            for n in t.nodes:
                if n.feature >= 0:
                    a, b = (t.nodes[c].weight for c in (n.left, n.right))
                    if a + b > 0:
                        m = (mean[n.left] * a + mean[n.right] * b) / (a + b)
                        out[n.feature] += float((a * (mean[n.left] - m) ** 2 + b * (mean[n.right] - m) ** 2).sum())
        total = out.sum()
        return dict(zip(self.features, (out / total * 100 if total else out).tolist(), strict=True))

    def _by_tree(self, df: DataFrame, weight: str | None):
        rows: dict[int, list] = {}
        for r in self.leaf_weights(df, weight).collect():  # leaves of the model
            rows.setdefault(r["tree"], []).append(r)
        return [(t, rows.get(i, [])) for i, t in enumerate(self.trees)]

    @staticmethod
    def _reweighted(t: Tree, weights: dict[int, float]) -> Tree:
        nodes = [Node(**asdict(n)) for n in t.nodes]
        both = t.by_bits()
        number = {id(n): i for i, n in enumerate(both[1])} if both else {id(n): i for i, n in enumerate(t.nodes)}
        for old, new in zip(t.nodes, nodes, strict=True):
            if old.feature < 0:
                new.weight = weights.get(number[id(old)], 0.0)
        for n in reversed(nodes):
            if n.feature >= 0:
                n.weight = nodes[n.left].weight + nodes[n.right].weight
        return Tree(nodes)

    def interactions(self) -> list[tuple[str, str, float]]:
        """Pairs of features, by how much of the leaves' values their splits leave together: the values of the leaves on
        unlike sides of two splits less those on like sides, in size; shares of 100."""
        score: dict[tuple[int, int], float] = {}

        def add(a: int, b: int, delta) -> None:
            if a != b:
                key = (min(a, b), max(a, b))
                score[key] = score.get(key, 0.0) + float(np.abs(delta).sum())

        for t in self.trees:
            both = t.by_bits()
            if both is not None:
                splits, leaves = both
                for i, j in combinations(range(len(splits)), 2):
                    add(splits[i].feature, splits[j].feature, sum((1 if (k >> i ^ k >> j) & 1 else -1) * np.asarray(n.value) for k, n in enumerate(leaves)))
                continue
            signed: dict[tuple[int, int], np.ndarray] = {}
            stack = [(0, ())]
            while stack:
                at, path = stack.pop()
                n = t.nodes[at]
                if n.feature >= 0:
                    stack += [(n.left, (*path, (at, 0))), (n.right, (*path, (at, 1)))]
                    continue
                for (u, x), (v, y) in combinations(path, 2):
                    signed[u, v] = signed.get((u, v), 0.0) + (1 if x != y else -1) * np.asarray(n.value)
            for (u, v), delta in signed.items():
                add(t.nodes[u].feature, t.nodes[v].feature, delta)
        total = sum(score.values()) or 1.0
        return sorted(((self.features[a], self.features[b], 100 * v / total) for (a, b), v in score.items()), key=lambda x: (-x[2], x[0], x[1]))

    def _explained(self, df: DataFrame, row_id: str, name: str, make: Callable, *keep: str) -> DataFrame:
        """(row, flat array, the columns ``keep``) of ``make(trees, x)`` over Arrow batches; numeric models of one output."""
        if not self.numeric or self.outputs > 1:
            raise ValueError("explanations need a numeric model of one output")
        shared, names, bias = df.sparkSession.sparkContext.broadcast(self.to_json()), [f"__f{i}" for i in range(len(self.features))], self.bias

        def run(frames):
            trees = Model.from_json(shared.value).trees
            for f in frames:
                x = f[names].to_numpy(dtype=np.float32, na_value=np.nan)
                yield pd.DataFrame({row_id: f[row_id], name: list(make(trees, x, bias)), **{k: f[k] for k in keep}})

        own = df.select(row_id, *[c.alias(n) for c, n in zip(self.columns(), names, strict=True)], *keep)
        kinds = dict(df.dtypes)
        return own.mapInPandas(run, f"{row_id} {kinds[row_id]}, {name} array<double>" + "".join(f", {k} {kinds[k]}" for k in keep))

    def shap(self, df: DataFrame, row_id: str) -> DataFrame:
        """(row, contributions of the features, then the expected value): exact Shapley values of the path-dependent expectation."""
        return self._explained(df, row_id, "shap", _shap_rows)

    def shap_interactions(self, df: DataFrame, row_id: str) -> DataFrame:
        """(row, a flat (features + 1) squared matrix): Shapley interaction values; rows add up to the Shapley values."""
        return self._explained(df, row_id, "shap", _interaction_rows)

    def sage(self, df: DataFrame, row_id: str) -> DataFrame:
        """(feature, value): the mean size of a feature's Shapley values."""
        each = self.shap(df, row_id).select(F.posexplode("shap").alias("at", "v")).where(F.col("at") < len(self.features))
        names = F.array(*[F.lit(f) for f in self.features])
        return each.groupBy("at").agg(F.avg(F.abs("v")).alias("value")).select(F.element_at(names, F.col("at") + 1).alias("feature"), "value")

    def loss_function_change(self, df: DataFrame, row_id: str, label: str, metric: str = "RMSE") -> DataFrame:
        """(feature, value): how much the metric worsens when a feature's Shapley values are taken from the prediction."""
        from sylva.functions.metrics import flat_term, parse_metric

        m = parse_metric(metric)
        x = self._explained(df.withColumn("__t", F.col(label).cast("double")), row_id, "shap", _shap_rows, "__t")
        total = F.aggregate("shap", F.lit(0.0), lambda s, v: s + v)
        mean = lambda a: (F.sqrt(F.avg(flat_term(m, a, F.col("__t")))) if m.name == "RMSE" else F.avg(flat_term(m, a, F.col("__t"))))
        row = x.withColumn("__a", total).agg(mean(F.col("__a")).alias("base"), *[mean(F.col("__a") - F.col("shap")[i]).alias(f"m{i}") for i in range(len(self.features))])
        return row.select(F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), (F.col(f"m{i}") - F.col("base")).alias("value")) for i, f in enumerate(self.features)])).alias("x")).select("x.*")

    def grid(self, feature: str) -> list[float]:
        """A value below, between and above the feature's borders."""
        if feature not in self.features or feature in self.cats:
            raise ValueError(f"no numeric feature {feature!r}")
        b = [x for x in self.borders.get(feature, []) if abs(x) < F32_MAX]
        return [b[0] - 1, *[(x + y) / 2 for x, y in zip(b, b[1:], strict=False)], b[-1] + 1] if b else [0.0]

    def partial_dependence(self, df: DataFrame, *features: str) -> DataFrame:
        """(value or value_0 and value_1, prediction): mean prediction with one or two features set to the places of their grids. One pass for all."""
        if len(features) not in (1, 2) or len(set(features)) != len(features):
            raise ValueError("one feature, or two different ones")
        if self.outputs > 1 or any(n.category is not None for t in self.trees for n in t.nodes):
            raise ValueError("partial dependence is for models of one output without one-hot splits")
        names, points, at = list(features), [()], 0
        for f in names:
            points = [(*p, v) for p in points for v in self.grid(f)]
        x, cols, frames = self.prepared(df), self.columns(), []
        for at in range(0, len(points), 200):
            aggs = []
            for i, p in enumerate(points[at : at + 200]):
                own = [F.lit(float(p[names.index(f)])) if f in names else c for f, c in zip(self.features, cols, strict=True)]
                aggs.append(F.avg(sum((t.column(own) for t in self.trees), F.lit(self.bias))).alias(f"g{i}"))
            labels = ["value"] if len(names) == 1 else ["value_0", "value_1"]
            rows = F.array(*[F.struct(*[F.lit(float(v)).alias(n) for v, n in zip(p, labels, strict=True)], F.col(f"g{i}").alias("prediction")) for i, p in enumerate(points[at : at + 200])])
            frames.append(x.agg(*aggs).select(F.explode(rows).alias("p")).select("p.*"))
        out = frames[0]
        for f in frames[1:]:
            out = out.unionByName(f)
        return out


def prediction(raw: Column, kind: str) -> Column:
    p = 1 / (1 + F.exp(-raw))
    kinds = {"RawFormulaVal": raw, "Probability": p, "LogProbability": F.ln(p), "Class": (raw > 0).cast("int"), "Exponent": F.exp(raw)}
    if kind not in kinds:
        raise ValueError(f"unknown prediction type {kind!r}")
    return kinds[kind]


def sum_models(models: list[Model], weights: list[float] | None = None) -> Model:
    weights = weights or [1.0] * len(models)
    if any(m.features != models[0].features for m in models):
        raise ValueError("models have different features")
    if len(weights) != len(models):
        raise ValueError("one weight for each model")
    if any(not m.numeric or m.outputs != models[0].outputs for m in models):
        raise ValueError("only numeric models with the same outputs can be merged")
    own = []
    for m, w in zip(models, weights, strict=True):
        copy = Model.from_json(m.to_json())
        copy.scale(w)
        own.append(copy)
    bias = own[0].bias if len(own) == 1 else np.sum([np.asarray(m.bias) for m in own], axis=0).tolist()
    borders = {f: sorted(set().union(*[m.borders.get(f, []) for m in own])) for f in own[0].features}
    return Model(own[0].features, [t for m in own for t in m.trees], bias, own[0].link, borders, classes=own[0].classes)


def _means(t: Tree) -> list[np.ndarray]:
    out = [np.asarray(n.value, dtype=float) for n in t.nodes]
    for i in range(len(t.nodes) - 1, -1, -1):  # children come after their parent
        n = t.nodes[i]
        if n.feature >= 0:
            a, b = t.nodes[n.left].weight, t.nodes[n.right].weight
            out[i] = (out[n.left] * a + out[n.right] * b) / (a + b) if a + b else (out[n.left] + out[n.right]) / 2
    return out


def _paths(t: Tree, x: np.ndarray):
    """For every leaf (value, {feature: (cover share, rows that follow)}): what a row's feature values decide on the way there."""
    stack = [(0, {})]
    while stack:
        at, path = stack.pop()
        n = t.nodes[at]
        if n.feature < 0:
            yield n.value, path
            continue
        v = x[:, n.feature]
        go = np.where(np.isnan(v), n.missing_right, v > np.float32(n.border))
        a, b = t.nodes[n.left].weight, t.nodes[n.right].weight
        for child, share, follow in ((n.left, a / (a + b) if a + b else 0.5, ~go), (n.right, b / (a + b) if a + b else 0.5, go)):
            z, o = path.get(n.feature, (1.0, np.ones(len(x), dtype=bool)))
            stack.append((child, path | {n.feature: (z * share, o & follow)}))


def _subset_weights(parts: list[tuple[float, np.ndarray]], rows: int) -> np.ndarray:
    """(size, row): summed Shapley weights of the subsets of the parts, by number of parts that follow the row."""
    w = np.zeros((len(parts) + 1, rows))
    w[0] = 1.0
    for l, (z, o) in enumerate(parts, 1):
        for i in range(l - 1, -1, -1):
            w[i + 1] += o * w[i] * (i + 1) / (l + 1)
            w[i] = z * w[i] * (l - i) / (l + 1)
    return w


def _without(w: np.ndarray, z: float, o: np.ndarray) -> np.ndarray:
    """The sum of the weights with one part taken out again."""
    m = len(w) - 1
    on, off, nxt = np.zeros(w.shape[1]), np.zeros(w.shape[1]), w[m].copy()
    for i in range(m - 1, -1, -1):
        step = nxt * (m + 1) / (i + 1)
        on += step
        nxt = w[i] - step * z * (m - i) / (m + 1)
        if z:
            off += w[i] * (m + 1) / (z * (m - i))
    return np.where(o, on, off)


def _shap_rows(trees: list[Tree], x: np.ndarray, bias: float) -> np.ndarray:
    out = np.zeros((len(x), x.shape[1] + 1))
    out[:, -1] = bias
    for t in trees:
        out[:, -1] += float(_means(t)[0])
        for value, path in _paths(t, x):
            parts = list(path.values())
            w = _subset_weights(parts, len(x))
            for f, (z, o) in path.items():
                out[:, f] += value * (o - z) * _without(w, z, o)
    return out


def _interaction_rows(trees: list[Tree], x: np.ndarray, bias: float) -> np.ndarray:
    n = x.shape[1] + 1
    out, whole = np.zeros((len(x), n, n)), _shap_rows(trees, x, bias)
    for t in trees:
        for value, path in _paths(t, x):
            for j, (zj, oj) in path.items():
                rest = {f: v for f, v in path.items() if f != j}
                w = _subset_weights(list(rest.values()), len(x))
                for f, (z, o) in rest.items():
                    out[:, f, j] += value * (oj - zj) * (o - z) * _without(w, z, o) / 2
    for f in range(n - 1):
        out[:, f, f] = whole[:, f] - out[:, f].sum(axis=1)
    out[:, -1, -1] = whole[:, -1]
    return out.reshape(len(x), -1)
