"""Gradient boosting: a driver loop over histogram passes (``plans.grower``)."""

from __future__ import annotations

import json
import math
import random
import time
import zlib
from collections.abc import Callable
from dataclasses import dataclass, fields, replace
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sylva.functions import stopping
from sylva.functions.losses import NUMPY, Loss, make_loss, softmax_hessian, softmax_rows
from sylva.functions.metrics import Metric, eval_flat, flat_term, parse_metric
from sylva.operators import binning, encoding, leaves as leaf_ops, querywise, ranking, sampling
from sylva.operators.leaves import exact_leaf_values
from sylva.plans import grower
from sylva.plans.model import Ctr, Model, Node, Tree
from sylva.sources.dataset import Dataset
from sylva.sources.store import discard, materialise

#: Legal values of the enumerations.
CHOICES = {
    "grow_policy": ("SymmetricTree", "Depthwise", "Lossguide", "Region"), "leaf_method": ("Gradient", "Newton", "Simple", "Exact"), "nan_mode": ("Min", "Max", "Forbidden"),
    "feature_border_type": ("Uniform", "Median", "UniformAndQuantiles", "GreedyLogSum", "GreedyMinEntropy", "MaxLogSum", "MinEntropy"),
    "score_function": ("Cosine", "L2", "SolarL2", "LOOL2", "SatL2"), "bootstrap_type": ("No", "Bayesian", "Bernoulli", "MVS", "Poisson"), "od_type": ("None", "Iter", "IncToDec", "Wilcoxon"),
    "auto_class_weights": ("None", "Balanced", "SqrtBalanced"), "model_shrink_mode": ("Constant", "Decreasing"), "sampling_unit": ("Object", "Group"), "sampling_frequency": ("PerTree",),
    "random_score_type": ("Normal", "NormalWithModelSizeDecrease"), "boosting_type": ("Plain",), "simple_ctr": ("Borders", "Buckets", "BinarizedTargetMeanValue", "Counter"),
    "combinations_ctr": ("Borders", "Buckets", "BinarizedTargetMeanValue", "Counter"), "counter_calc_method": ("SkipTest",), "final_ctr_computation_mode": ("Default",), "ctr_history_unit": ("Sample",),
    "leaf_estimation_backtracking": ("No",),
}
ALIASES = {"n_estimators": "iterations", "num_boost_round": "iterations", "num_trees": "iterations", "max_depth": "depth", "eta": "learning_rate", "reg_lambda": "l2_leaf_reg", "max_bin": "border_count", "loss_function": "loss", "objective": "loss", "random_state": "random_seed", "colsample_bylevel": "rsm", "leaf_estimation_method": "leaf_method", "num_leaves": "max_leaves", "min_child_samples": "min_data_in_leaf"}
#: Learning rate by table: (loss, best model kept, start at the mean) -> coefficients of the two logarithmic laws.
AUTO_RATE = {
    ("Logloss", True, True): (0.246, -5.127, -0.451, 0.978), ("Logloss", False, True): (0.408, -7.299, -0.928, 2.701), ("Logloss", True, False): (0.247, -5.158, -0.435, 0.934),
    ("Logloss", False, False): (0.427, -7.525, -0.917, 2.63), ("RMSE", True, True): (0.157, -4.062, -0.61, 1.557), ("RMSE", False, True): (0.158, -4.287, -0.813, 2.571),
    ("RMSE", True, False): (0.189, -4.383, -0.623, 1.439), ("RMSE", False, False): (0.178, -4.473, -0.76, 2.133),
}


def auto_learning_rate(loss: str, best_model: bool, from_average: bool, rows: int, iterations: int) -> float:
    """exp(a ln n + b), carried from 1000 iterations to the number wanted; 0.5 at most, six places."""
    if (loss, best_model, from_average) not in AUTO_RATE or rows <= 0 or iterations <= 0:
        raise ValueError("no automatic learning rate for this loss, table or number of iterations")
    a, b, c, d = AUTO_RATE[loss, best_model, from_average]
    law = lambda n: math.exp(c * math.log(n) + d)
    return math.floor(min(0.5, math.exp(a * math.log(rows) + b) * law(iterations) / law(1000)) * 1e6 + 0.5) / 1e6


@dataclass(frozen=True)
class Params:
    loss: str | Loss = "RMSE"
    custom_objective: Callable | None = None  # (approx, target, weight) -> (der1, der2), numpy arrays
    custom_metric: Callable | None = None  # (DataFrame, approx, target) -> Column aggregate, minimised
    iterations: int = 1000
    depth: int = 6
    learning_rate: float = 0.03
    auto_learning_rate: bool = False
    l2_leaf_reg: float = 3.0
    border_count: int = 254
    feature_border_type: str = "GreedyLogSum"
    nan_mode: str = "Min"
    score_function: str = "Cosine"
    grow_policy: str = "SymmetricTree"
    max_leaves: int = 31
    min_data_in_leaf: int = 1
    leaf_method: str = "Gradient"
    leaf_estimation_iterations: int = 1
    leaf_estimation_backtracking: str = "No"
    boost_from_average: bool = True
    boosting_type: str = "Plain"
    has_time: bool = False
    permutation_count: int = 4
    fold_len_multiplier: float = 2.0
    bootstrap_type: str = "No"
    subsample: float = 1.0
    bagging_temperature: float = 0.0
    mvs_reg: float = 0.0
    sampling_unit: str = "Object"
    sampling_frequency: str = "PerTree"
    random_seed: int = 0
    random_strength: float = 0.0
    random_score_type: str = "NormalWithModelSizeDecrease"
    rsm: float = 1.0
    model_shrink_rate: float = 0.0
    model_shrink_mode: str = "Constant"
    langevin: bool = False
    diffusion_temperature: float = 10000.0
    posterior_sampling: bool = False
    feature_weights: tuple[float, ...] = ()
    first_feature_use_penalties: tuple[float, ...] = ()
    per_object_feature_penalties: tuple[float, ...] = ()
    penalties_coefficient: float = 1.0
    monotone_constraints: tuple[int, ...] = ()
    class_weights: tuple[float, ...] = ()
    auto_class_weights: str = "None"
    scale_pos_weight: float = 1.0
    ignored_features: tuple[str, ...] = ()
    one_hot_max_size: int = 2
    max_ctr_complexity: int = 4
    simple_ctr: str = "Borders"
    simple_ctr_priors: tuple[float, ...] = (0.5,)
    combinations_ctr: str = "Borders"
    combinations_ctr_priors: tuple[float, ...] = (0.5,)
    ctr_border_count: int = 15
    counter_calc_method: str = "SkipTest"
    final_ctr_computation_mode: str = "Default"
    ctr_history_unit: str = "Sample"
    model_size_reg: float = 0.5
    eval_metric: str | None = None
    od_type: str = "None"
    od_pval: float = 0.0
    od_wait: int = 20
    early_stopping_rounds: int | None = None
    use_best_model: bool = False
    allow_const_label: bool = False
    thread_count: int = 0  # Spark's scheduler decides
    save_snapshot: bool = False
    snapshot_file: str | None = None  # a folder that driver and executors share
    snapshot_interval: float = 600.0
    checkpoint_trees: int = 10

    def __post_init__(self):
        for name, legal in CHOICES.items():
            if getattr(self, name) not in legal:
                raise ValueError(f"{name} must be one of {', '.join(legal)}; {getattr(self, name)!r} isn't")
        if not 1 <= self.depth <= 16:
            raise ValueError("depth must be from 1 to 16")
        if not 0 < self.rsm <= 1 or self.iterations < 0 or not 1 <= self.border_count <= 65535 or not 0 < self.subsample <= 1 or self.leaf_estimation_iterations < 1:
            raise ValueError("rsm, iterations, border_count, subsample or leaf_estimation_iterations out of range")
        if sum((bool(self.class_weights), self.auto_class_weights != "None", self.scale_pos_weight != 1.0)) > 1:
            raise ValueError("class_weights, auto_class_weights and scale_pos_weight exclude each other")
        if any(c not in (-1, 0, 1) for c in self.monotone_constraints):
            raise ValueError("monotone constraints are -1, 0 or 1")
        if any(self.monotone_constraints) and self.grow_policy != "SymmetricTree":
            raise ValueError("monotone constraints need symmetric trees")
        if self.save_snapshot and not self.snapshot_file:
            raise ValueError("save_snapshot needs snapshot_file")
        if self.od_type in ("IncToDec", "Wilcoxon") and not 0 < self.od_pval <= 1:
            raise ValueError(f"{self.od_type} needs od_pval in (0, 1]")
        if self.early_stopping_rounds is not None:
            object.__setattr__(self, "od_type", "Iter")
            object.__setattr__(self, "od_wait", self.early_stopping_rounds)

    @staticmethod
    def of(**kwargs) -> Params:
        """Unknown names are errors, with the nearest known one; common aliases are accepted."""
        import difflib

        named = {ALIASES.get(k, k): tuple(v) if isinstance(v, list) else v for k, v in kwargs.items()}
        known = {f.name for f in fields(Params)}
        for k in set(named) - known:
            near = difflib.get_close_matches(k, [*known, *ALIASES], 1)
            raise ValueError(f"unknown parameter {k!r}" + (f"; did you mean {near[0]!r}?" if near else ""))
        return Params(**named)


@dataclass
class Feature:
    """A column of bins: a numeric feature, a one-hot category or a target statistic."""

    name: str
    bins: int
    borders: list[float]  # of values, for numeric features and statistics
    categories: list[str] | None = None
    ctr: Ctr | None = None

    @property
    def equal(self) -> bool:
        return self.categories is not None


class GBT:
    """``fit(dataset)`` trains; every level of a tree is one pass over the binned table.

    The binned table (row id, bins, labels, weight, approx) is written once and again every
    ``checkpoint_trees`` trees, so lineage doesn't grow; trees in between are applied to the
    batches of a pass. Driver memory holds ``grower.MAX_CELLS`` cells and the borders, whatever the table's size.
    Ordered boosting, text and vector columns are refused.
    """

    def __init__(self, **params):
        self.params = Params.of(**params)

    # set-up ----------------------------------------------------------------

    def _loss(self) -> Loss:
        p = self.params
        if p.custom_objective is not None:
            return Loss("Custom", p.custom_objective)
        return make_loss(p.loss) if isinstance(p.loss, str) else p.loss

    def _checked(self, data: Dataset, loss: Loss) -> None:
        if data.texts or data.vectors:
            raise ValueError("the trainer doesn't use text or vector columns; make features of them first (operators.text, operators.vectors)")
        if loss.grouped and data.group is None:
            raise ValueError(f"{loss.name} needs groups")
        if loss.name in ("PairLogitPairwise", "YetiRankPairwise"):
            raise ValueError(f"{loss.name} needs pairwise scoring, which the trainer doesn't have")
        p = self.params
        if p.leaf_method == "Exact" and loss.name.partition(":")[0] not in ("MAE", "Quantile", "LogCosh", "MultiQuantile"):
            raise ValueError("exact leaves are for MAE, Quantile, MultiQuantile and LogCosh")
        weighted = p.class_weights or p.auto_class_weights != "None" or p.scale_pos_weight != 1.0
        if weighted and (loss.outputs != "classes" and loss.link != "Probability"):
            raise ValueError("class weights are for classification")

    def _features(self, data: Dataset, label: str, bound: float) -> tuple[list[Feature], DataFrame]:
        """The features, and the data with a column of bins for each statistic."""
        p, df = self.params, data.df
        names = list(data.features)
        borders = binning.select_borders(df, names, p.border_count, p.feature_border_type, p.nan_mode, row_id=data.row_id) if names else {}
        out = [Feature(f, len(borders[f]) + 1, borders[f]) for f in names]
        sizes = encoding.cardinalities(df, list(data.cats)) if data.cats else {}
        routes = {c: encoding.route(sizes[c], p.one_hot_max_size) for c in data.cats}
        for c in data.cats:
            if routes[c] == "OneHot":
                found = sorted(r[0] for r in df.select(F.col(c).cast("string")).where(F.col(c).isNotNull()).distinct().collect())
                out.append(Feature(c, len(found) + 1, [], found))  # bin 0: none of them
        by_ctr = [c for c in data.cats if routes[c] == "Ctr"]
        for cats in encoding.projections(by_ctr, p.max_ctr_complexity):
            kind, priors = (p.simple_ctr, p.simple_ctr_priors) if len(cats) == 1 else (p.combinations_ctr, p.combinations_ctr_priors)
            df, made = encoding.online_ctr(df, list(cats), label, bound, kind, list(priors), p.ctr_border_count, data.row_id, None if p.has_time else p.random_seed)
            for ctr in made:
                out.append(Feature(ctr.name, p.ctr_border_count, [b + 0.5 for b in range(p.ctr_border_count - 1)], ctr=ctr))
        return out, df

    def _weight(self, data: Dataset, df: DataFrame, classes: list[float] | None):
        p = self.params
        weight = F.col(data.weight).cast("double") if data.weight else F.lit(1.0)
        if data.label is None:
            return weight
        label = F.col(data.label).cast("double")
        if p.auto_class_weights != "None":
            got = encoding.class_weights(df, data.label, weight, p.auto_class_weights).limit(10_001).collect()
            if len(got) > 10_000:
                raise ValueError("over 10,000 classes")
            weight = weight * F.coalesce(*[F.when(label == float(r[0]), float(r[1])) for r in got])
        if p.class_weights:
            known = classes or [0.0, 1.0]
            if len(known) != len(p.class_weights):
                raise ValueError("one class weight for each class")
            weight = weight * F.coalesce(*[F.when(label == c, float(w)) for c, w in zip(known, p.class_weights, strict=True)])
        return weight * F.when(label == 1, p.scale_pos_weight).otherwise(1.0) if p.scale_pos_weight != 1.0 else weight

    # fit ---------------------------------------------------------------------

    def fit(self, data: Dataset, eval_set: Dataset | None = None, on_iteration: Callable[[int, Model], None] | None = None) -> Model:
        p, data, loss = self.params, data.ignore(list(self.params.ignored_features)), self._loss()
        self._checked(data, loss)
        targets = list(data.targets) if loss.outputs == "targets" else [data.label]
        if loss.outputs == "targets" and not data.targets:
            raise ValueError(f"{loss.name} needs targets")
        label = F.col(targets[0]).cast("double")
        for t in targets if loss.check is not None else []:
            if data.df.where(~F.coalesce(loss.check(F.col(t).cast("double")), F.lit(False))).limit(1).count():
                raise ValueError(f"labels don't suit {loss.name}")
        stats = data.df.agg(F.min(label), F.max(label), F.avg(label), F.var_pop(label), F.count(F.lit(1))).collect()[0]
        if stats[0] == stats[1] and not p.allow_const_label:
            raise ValueError("all labels are equal")
        classes = None
        if loss.outputs == "classes":
            classes = sorted(r[0] for r in data.df.select(label.alias("c")).distinct().limit(10_001).collect())
            if len(classes) > 10_000:
                raise ValueError("over 10,000 classes")
        outputs = len(classes) if classes else len(targets) if loss.outputs == "targets" else loss.outputs
        binary = stats[0] == 0 and stats[1] == 1
        feats, df = self._features(data, targets[0], 0.5 if binary or classes else float(stats[2]))
        if loss.outputs == "classes":
            coded = [sum((F.when(label == c, float(i)) for i, c in list(enumerate(classes))[1:]), F.when(label == classes[0], 0.0)) if len(classes) == 1 else F.coalesce(*[F.when(label == c, float(i)) for i, c in enumerate(classes)])]
        else:
            coded = [F.col(t).cast("double") for t in targets]
        start = np.zeros(outputs)
        if p.boost_from_average and loss.name == "RMSE":
            start[0] = stats[2]
        elif loss.name == "RMSEWithUncertainty":
            start[:] = [stats[2], 0.5 * math.log(max(stats[3], 1e-300))]
        base = F.col(data.baseline).cast("double") if data.baseline else F.lit(0.0)
        bins = [self._bin(f).cast("short" if f.bins < 32767 else "int").alias(f"b{i}") for i, f in enumerate(feats)]
        frame = materialise(df.select(
            F.col(data.row_id).alias("row_id"), *bins, *[c.alias(f"l{i}") for i, c in enumerate(coded)], self._weight(data, df, classes).alias("weight"),
            *[(base + F.lit(float(s))).alias(f"a{i}") for i, s in enumerate(start)], *([F.col(data.group).alias("group")] if data.group else []),
        ), "gbt")
        total_weight = frame.agg(F.sum("weight")).collect()[0][0] or 0.0
        rate = auto_learning_rate(loss.name, p.use_best_model, p.boost_from_average, stats[4], p.iterations) if p.auto_learning_rate else p.learning_rate
        run = _Run(p, loss, feats, frame, outputs, len(targets), rate, p.l2_leaf_reg * total_weight / max(stats[4], 1), stats[4], data.pairs)
        names = [f.name for f in feats]
        model = Model(names, [], float(start[0]) if outputs == 1 else start.tolist(), loss.link, {f.name: f.borders for f in feats if not f.equal}, classes=classes, ctrs=[f.ctr for f in feats if f.ctr], cats=[c for c in data.cats], learning_rate=rate)
        watch = _Watch(p, loss, eval_set, model) if eval_set is not None else None
        first, last_saved = run.resume(model), time.time()
        for i in range(first, p.iterations):
            shrink = run.shrink(i)
            if shrink != 1.0:
                model.scale(shrink)
            grown = run.grow(i)
            if grown is None:
                break
            model.trees.append(run.converted(grown))
            if p.save_snapshot and time.time() - last_saved >= p.snapshot_interval:
                run.save(i + 1)
                last_saved = time.time()
            if on_iteration:
                on_iteration(i, model)
            if watch and watch.stop(i, shrink):
                break
        if p.save_snapshot:
            run.save(len(model.trees))
        discard(run.frame)
        if watch:
            watch.finish()
        return model

    @staticmethod
    def _bin(f: Feature):
        if f.ctr is not None:
            return F.col(f"`{f.name}`")
        if f.equal:
            return F.coalesce(*[F.when(F.col(f"`{f.name}`").cast("string") == c, i + 1) for i, c in enumerate(f.categories)], F.lit(0))
        return binning.bin_of(F.col(f"`{f.name}`"), f.borders)


class _Run:
    """The state of one training: the frame, trees not yet in its approx, and the draws."""

    def __init__(self, p: Params, loss: Loss, feats: list[Feature], frame: DataFrame, outputs: int, targets: int, rate: float, l2: float, n: int, pairs: DataFrame | None):
        self.p, self.loss, self.feats, self.frame, self.outputs, self.rate, self.l2, self.n, self.pairs = p, loss, feats, frame, outputs, rate, l2, n, pairs
        self.done: list[grower.Grown] = []
        self.unused = set(range(len(feats)))
        ders = None
        if not loss.grouped:
            ders = _custom(p.custom_objective) if p.custom_objective is not None else grower.pointwise(loss.ders)
        self.rows = grower.Rows(len(feats), outputs, targets, ders)
        self.temperature = float(n) if p.posterior_sampling else p.diffusion_temperature
        if p.langevin or p.posterior_sampling:
            self.rows.noise = math.sqrt(2 / rate / self.temperature)
        self.rows.bootstrap, self.rows.subsample, self.rows.temperature = p.bootstrap_type, p.subsample, p.mvs_reg if p.bootstrap_type == "MVS" else p.bagging_temperature

    def shrink(self, i: int) -> float:
        """The factor on the model so far; also applied to the approx of later passes."""
        p = self.p
        rate = 1 / (2 * self.n) if p.posterior_sampling else p.model_shrink_rate
        if not rate or not i:
            return 1.0
        k = 1 - rate * self.rate if p.model_shrink_mode == "Constant" else 1 - rate / i
        self.rows.scale *= k
        self.rows.fresh = [(t, v * k) for t, v in self.rows.fresh]
        for t in self.done:
            t.values = t.values * k
        return k

    # one tree ----------------------------------------------------------------

    def grow(self, i: int) -> grower.Grown | None:
        p = self.p
        rng = random.Random(p.random_seed * 1_000_003 + i)
        usable = [k for k, f in enumerate(self.feats) if f.bins > 1]
        if not usable:
            return None
        chosen = [k for k in usable if p.rsm >= 1 or rng.random() < p.rsm] or [rng.choice(usable)]
        if self.loss.grouped:  # derivatives need whole groups, so the approx is brought up to date first
            self._write()
        unit = "group" if p.sampling_unit == "Group" and "group" in self.frame.columns else "row_id"
        x = self.frame
        if p.bootstrap_type != "No":
            x = x.withColumn("u", sampling.unit(unit, p.random_seed * 7919 + i))
        if self.rows.noise:
            x = x.withColumn("z", sampling.normal("row_id", p.random_seed * 104_729 + i))
        if self.loss.grouped:
            told = querywise.group_derivatives(self.frame.select("row_id", "group", F.col("l0").alias("label"), "weight", F.col("a0").alias("approx")), self.loss, self.pairs, p.random_seed + i)
            x = materialise(x.join(told, "row_id"), "gbt-ders")
        if p.bootstrap_type == "MVS":
            self.rows.threshold = grower.mvs_threshold(x, self.rows, p.subsample)
        noise = self._score_noise(x, i)
        tree = _grow(x, self.rows, self.feats, chosen, p, self.l2, noise, i, self.unused)
        if tree is not None:
            self._leaves(x, tree)
            self.unused -= {f for f in tree.feature if f >= 0}
            self.done.append(tree)
            self.rows.fresh.append((tree.compiled(), tree.values))
            if len(self.rows.fresh) >= p.checkpoint_trees:
                self._write()
        if self.loss.grouped:
            discard(x)
        return tree

    def _score_noise(self, x: DataFrame, i: int) -> float:
        p = self.p
        if not p.random_strength:
            return 0.0
        squares, _, n = grower.der_scale(x, self.rows)
        out = p.random_strength * math.sqrt(squares / max(n, 1))
        if p.random_score_type == "NormalWithModelSizeDecrease":
            left = math.exp(min(700.0, math.log(max(self.n, 1)) - len(self.done) * self.rate))
            out *= left / (1 + left)
        return out

    def _leaves(self, x: DataFrame, tree: grower.Grown) -> None:
        """Values by the leaf method, in ``leaf_estimation_iterations`` steps; then times the learning rate."""
        p, k = self.p, self.outputs
        values, compiled, kept = np.zeros((len(tree.feature), k)), tree.compiled(), list(self.rows.fresh)
        block = self.loss.name == "MultiClass" and p.leaf_method == "Newton"
        weights = None
        # without sampling and noise the splits' own sums are those of the leaves
        known = p.leaf_method in ("Gradient", "Simple") and p.leaf_estimation_iterations == 1 and p.bootstrap_type == "No" and all(i in tree.sums for i in tree.leaves())
        for _ in range(p.leaf_estimation_iterations):
            rows = replace(self.rows, fresh=[*kept, (compiled, values)] if values.any() else kept)
            if p.leaf_method == "Exact":
                step, weights = leaf_ops.exact_values(x, rows, tree, self.loss)
            else:
                if known:
                    s = np.zeros((len(tree.feature), k + 2))
                    for i in tree.leaves():
                        s[i] = tree.sums[i]
                else:
                    s = grower.leaf_sums(x, rows, tree, _softmax_block if block else None)
                weights = s[:, -2]
                if block:
                    step = leaf_ops.block_newton(s[:, :k], s[:, k:-2], self.l2)
                elif p.leaf_method == "Newton":
                    down = -s[:, k : 2 * k] + self.l2
                    step = np.where(down != 0, s[:, :k] / np.where(down != 0, down, 1.0), 0.0)
                else:
                    step = np.where(weights[:, None] > 0, s[:, :k] / np.where(weights > 0, weights + self.l2, 1.0)[:, None], 0.0)
            constraints = [p.monotone_constraints[f] if f < len(p.monotone_constraints) and not self.feats[f].equal else 0 for f in leaf_ops.levels(tree)] if any(p.monotone_constraints) else []
            values = values + step
            if any(constraints):
                values = leaf_ops.monotone(tree, constraints, values, weights)
        tree.values = values * self.rate
        tree.weights = weights

    def _write(self) -> None:
        """Bring the approx of the frame up to date."""
        if not self.rows.fresh and self.rows.scale == 1.0:
            return
        rows, names = self.rows, self.frame.columns

        def run(batches):
            for b in batches:
                a = rows.approx(b, rows.bins(b))
                new = {f"a{i}": pa.array(np.ascontiguousarray(a[:, i])) for i in range(rows.outputs)}
                yield pa.RecordBatch.from_arrays([new.get(c, b.column(c)) for c in names], names)

        new = materialise(self.frame.mapInArrow(run, self.frame.schema), "gbt")
        discard(self.frame)
        self.frame, self.rows.fresh, self.rows.scale = new, [], 1.0

    def converted(self, t: grower.Grown) -> Tree:
        nodes = []
        for i, f in enumerate(t.feature):
            if f < 0:
                v = t.values[i]
                nodes.append(Node(value=float(v[0]) if self.outputs == 1 else v.tolist(), weight=float(t.weights[i])))
                continue
            own = self.feats[f]
            if own.equal:
                nodes.append(Node(f, 0.0, t.left[i], t.right[i], category=own.categories[t.border[i] - 1] if t.border[i] else None))
            else:
                nodes.append(Node(f, own.borders[t.border[i]], t.left[i], t.right[i], missing_right=own.borders[-1] == binning.F32_MAX))
        for n in reversed(nodes):
            if n.feature >= 0:
                n.weight = nodes[n.left].weight + nodes[n.right].weight
        return Tree(nodes)

    # snapshots -----------------------------------------------------------------

    def fingerprint(self) -> str:
        """Of the parameters that shape the trees, and of the binned data."""
        skip = {"iterations", "save_snapshot", "snapshot_file", "snapshot_interval", "thread_count", "checkpoint_trees", "custom_objective", "custom_metric"}
        own = {f.name: str(getattr(self.p, f.name)) for f in fields(self.p) if f.name not in skip}
        cols = [c for c in self.frame.columns if c[0] in "bl" and c[1:].isdigit()]
        data = self.frame.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("row_id", "weight", *cols))).collect()[0]
        return f"{zlib.crc32(json.dumps(own, sort_keys=True).encode()):08x}-{data[0]}-{data[1]}"

    def save(self, trees: int) -> None:
        state = {"fingerprint": self.mark, "trees": [[t.feature, t.border, t.equal, t.left, t.right, t.depth, t.values.tolist(), t.weights.tolist()] for t in self.done]}
        if not all(np.isfinite(t.values).all() for t in self.done):
            raise ValueError("a leaf value isn't finite")
        spark = self.frame.sparkSession
        spark.createDataFrame([(trees, json.dumps(state))], "trees int, state string").coalesce(1).write.mode("append").parquet(self.p.snapshot_file)

    def resume(self, model: Model) -> int:
        """Take up the latest snapshot of this training, if there is one; the number of its trees."""
        if not self.p.save_snapshot:
            return 0
        self.mark = self.fingerprint()
        spark = self.frame.sparkSession
        jvm = spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.p.snapshot_file)
        if not path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(path):
            return 0
        last = spark.read.parquet(self.p.snapshot_file).orderBy(F.desc("trees")).limit(1).collect()
        if not last:
            return 0
        state = json.loads(last[0]["state"])
        if state["fingerprint"] != self.mark:
            raise ValueError("the snapshot belongs to other parameters or data")
        for f, b, e, l, r, d, v, w in state["trees"][: self.p.iterations]:
            t = grower.Grown(f, b, e, l, r, d, np.array(v))
            t.weights = np.array(w)
            self.done.append(t)
            self.unused -= {k for k in f if k >= 0}
            self.rows.fresh.append((t.compiled(), t.values))
            model.trees.append(self.converted(t))
        self._write()
        return len(self.done)


def _softmax_block(a: np.ndarray) -> np.ndarray:
    return softmax_hessian(softmax_rows(a))


def _custom(f: Callable) -> Callable:
    def ders(a, t, w):
        out = f(a, t, w)
        if any(not np.isfinite(x).all() for x in out):
            raise ValueError("the custom objective gave a derivative that isn't finite")
        return out

    return ders


def _grow(x: DataFrame, rows: grower.Rows, feats: list[Feature], chosen: list[int], p: Params, l2: float, noise: float, iteration: int, unused: set[int]) -> grower.Grown | None:
    tree = grower.Grown()
    bins, equal = [f.bins for f in feats], [f.equal for f in feats]
    ctr_sizes = [f.ctr.size for f in feats if f.ctr]
    factor = np.ones(len(feats))
    for k, f in enumerate(feats):
        if k < len(p.feature_weights):
            factor[k] = p.feature_weights[k]
        if f.ctr and p.model_size_reg:
            factor[k] *= (1 + f.ctr.size / max(ctr_sizes)) ** -p.model_size_reg
    penalty = np.zeros(len(feats))
    per_object = np.zeros(len(feats))
    for k in unused:
        penalty[k] = p.penalties_coefficient * p.first_feature_use_penalties[k] if k < len(p.first_feature_use_penalties) else 0.0
        per_object[k] = p.penalties_coefficient * p.per_object_feature_penalties[k] if k < len(p.per_object_feature_penalties) else 0.0
    rng = np.random.default_rng([p.random_seed & 0xFFFFFFFF, iteration])
    width = sum(bins[f] for f in chosen)
    hist: dict[int, np.ndarray] = {}  # of nodes that may still be split, while they fit
    room = max(1, grower.MAX_CELLS // (width * (rows.outputs + 2)))
    symmetric, leafwise = p.grow_policy == "SymmetricTree", p.grow_policy == "Lossguide"

    def counted(nodes: list[int], parents: dict[int, tuple[int, int, np.ndarray]]) -> np.ndarray:
        """Histograms of nodes: the smaller child by a pass, the larger as the rest of its parent."""
        need, rest = [], []
        for n in nodes:
            if n in parents:
                rest.append(n)
            else:
                need.append(n)
        got = dict(zip(need, grower.histograms(x, rows, tree, need, bins, chosen), strict=True)) if need else {}
        for n in rest:
            parent, sibling, whole = parents[n]
            h = whole - got[sibling]
            h[h[:, -1] <= 0.5] = 0.0
            got[n] = h
        return np.stack([got[n] for n in nodes])

    def scored(nodes: list[int], h: np.ndarray):
        c = grower.candidates(h, bins, chosen, equal)
        (lu, ld), (ru, rd) = (grower.term_scores(side[..., : rows.outputs], side[..., -2], l2, p.score_function) for side in (c.left, c.right))
        up, down = lu + ru, ld + rd
        if symmetric:
            value = grower.combined(up.sum(axis=0), down.sum(axis=0), p.score_function)[None]
            ok = ((c.left[..., -1].sum(axis=0) > 0) & (c.right[..., -1].sum(axis=0) > 0))[None]
            own, n = np.zeros(1), np.array([h[:, : bins[chosen[0]], -1].sum()])
        else:
            value = grower.combined(up, down, p.score_function)
            least = max(1, p.min_data_in_leaf)
            ok = (c.left[..., -1] >= least) & (c.right[..., -1] >= least)
            whole = h[:, : bins[chosen[0]]].sum(axis=1)
            own = grower.combined(*grower.term_scores(whole[:, : rows.outputs], whole[:, -2], l2, p.score_function), p.score_function)
            n = whole[:, -1]
        if noise:
            value = value + noise * rng.standard_normal(value.shape)
        value = value * factor[c.feature] - penalty[c.feature] - per_object[c.feature] * n[:, None]
        value = np.where(ok, value, -np.inf)
        best = value.argmax(axis=1)
        return [(value[i, b] - own[i], int(c.feature[b]), int(c.border[b]), bool(c.equal[b]), c.left[i, b] if not symmetric else c.left[:, b], c.right[i, b] if not symmetric else c.right[:, b]) for i, b in enumerate(best)]

    open_, leaves = [0], 1
    ready: dict[int, tuple] = {}
    parents: dict[int, tuple[int, int, np.ndarray]] = {}
    for _ in range(p.depth if not leafwise else p.max_leaves):
        fresh = [n for n in open_ if n not in ready]
        keep = len(fresh) <= room and len(hist) + len(fresh) <= 4 * room
        if symmetric:
            if not keep:
                parents = {}
            h = counted(fresh, parents) if keep else None
            if h is None:  # in turns: sums of scores need all leaves, so terms are added up by parts
                found = _by_parts(x, rows, tree, fresh, bins, chosen, equal, room, p, l2, factor, penalty, noise, rng)
            else:
                found = scored(fresh, h)[0]
            if found is None or not np.isfinite(found[0]):
                break
            splits = dict.fromkeys(open_, found)
            hist = dict(zip(fresh, h, strict=True)) if keep else {}
        else:
            for first in range(0, len(fresh), room):
                part = fresh[first : first + room]
                use = {n: v for n, v in parents.items() if n in part and (v[1] in part)}
                h = counted(part, use)
                ready |= dict(zip(part, scored(part, h), strict=True))
                if keep:
                    hist |= dict(zip(part, h, strict=True))
            can = {n: s for n, s in ready.items() if n in open_ and s[0] >= 1e-9 and tree.depth[n] < p.depth}
            if not can:
                break
            top = min(can, key=lambda n: (-can[n][0], n))
            splits = can if p.grow_policy == "Depthwise" else {top: can[top]}
        nxt, parents = [], {}
        for j, (n, (_, feature, border, same, left, right)) in enumerate(splits.items()):
            a, b = tree.split(n, feature, border, same)
            if left is not None:
                tree.sums[a], tree.sums[b] = (left[j], right[j]) if symmetric else (left, right)
            if n in hist:
                small, large = (a, b) if tree.sums[a][-1] <= tree.sums[b][-1] else (b, a)
                parents[large] = (n, small, hist.pop(n))
            ready.pop(n, None)
            nxt += [a, b]
            leaves += 1
        if leafwise:
            open_ = [n for n in open_ if n not in splits] + nxt
            if leaves >= p.max_leaves:
                break
        else:
            open_ = nxt
    return tree if len(tree.feature) > 1 else None


def _by_parts(x, rows, tree, nodes, bins, chosen, equal, room, p, l2, factor, penalty, noise, rng):
    """The split of a level whose leaves don't fit at once."""
    up = down = ok = c = None
    for first in range(0, len(nodes), room):
        c = grower.candidates(grower.histograms(x, rows, tree, nodes[first : first + room], bins, chosen), bins, chosen, equal)
        terms = [grower.term_scores(side[..., : rows.outputs], side[..., -2], l2, p.score_function) for side in (c.left, c.right)]
        u, d = (sum(t[i].sum(axis=0) for t in terms) for i in (0, 1))
        some = np.stack([c.left[..., -1].sum(axis=0), c.right[..., -1].sum(axis=0)])
        up, down, ok = (u, d, some) if up is None else (up + u, down + d, ok + some)
    value = grower.combined(up, down, p.score_function)
    if noise:
        value = value + noise * rng.standard_normal(value.shape)
    value = np.where((ok > 0).all(axis=0), value * factor[c.feature] - penalty[c.feature], -np.inf)
    b = int(value.argmax())
    return value[b], int(c.feature[b]), int(c.border[b]), bool(c.equal[b]), None, None


class _Watch:
    """The eval set's metric after every tree, and whether to stop."""

    def __init__(self, p: Params, loss: Loss, data: Dataset, model: Model):
        self.p, self.model, self.data = p, model, data
        self.metric = p.eval_metric or ("Logloss" if loss.link == "Probability" else "RMSE")
        if model.outputs > 1 and p.custom_metric is None:
            raise ValueError("eval sets of losses with several outputs need custom_metric")
        parsed = None if p.custom_metric else parse_metric(self.metric)
        self.sign = -1.0 if parsed is not None and parsed.maximise else 1.0
        self.curve: list[float] = []
        self.trees: list[Tree] = []
        self.scale = 1.0
        df = model.prepared(data.df)
        self.base = F.lit(model.bias) if model.outputs == 1 else F.array(*[F.lit(b) for b in model.bias])
        self.frame = materialise(df.withColumn("__raw", self.base), "gbt-eval") if model.outputs == 1 else df
        self.detector = stopping.detector(p.od_type, p.od_pval, p.od_wait)

    def stop(self, i: int, shrink: float) -> bool:
        p, m = self.p, self.model
        if m.outputs > 1:
            scored = m.predict(self.data.df, out="__raw")
        else:
            self.scale *= shrink
            pending = m.trees[len(self.trees) :]
            raw = F.col("__raw") * F.lit(self.scale) + sum((t.column(m.columns()) for t in pending), F.lit(0.0))
            scored = self.frame.withColumn("__raw", raw)
            if len(pending) >= p.checkpoint_trees or (shrink != 1.0 and len(pending) > 1):
                new = materialise(scored, "gbt-eval")
                discard(self.frame)
                self.frame, self.trees, self.scale, scored = new, list(m.trees), 1.0, new
        self.curve.append(self._value(scored))
        self.detector.add(-self.sign * self.curve[-1])
        return self.detector.stopped

    def _value(self, scored: DataFrame) -> float:
        d = self.data
        if self.p.custom_metric is not None:
            return scored.agg(self.p.custom_metric("__raw", d.label)).collect()[0][0]
        if parse_metric(self.metric).name in ranking.GROUPED:
            return ranking.eval_grouped(scored, self.metric, d.group, "__raw", d.label, d.row_id, d.weight).collect()[0][0]
        return eval_flat(scored, [self.metric], "__raw", d.label, d.weight).collect()[0][0]

    def finish(self) -> None:
        if self.model.outputs == 1:
            discard(self.frame)
        if self.curve:
            self.model.history[self.metric] = self.curve
            if self.p.use_best_model:
                best = min(range(len(self.curve)), key=lambda j: (self.sign * self.curve[j], j))
                self.model.trees = self.model.trees[: best + 1]


# cross-validation and search -----------------------------------------------------


def cv(data: Dataset, folds: int = 3, metrics: tuple[str, ...] = ("RMSE",), seed: int | None = None, inverted: bool = False, explicit: DataFrame | None = None, stratified: bool = False, **params) -> DataFrame:
    """(iteration, metric, mean, std) of the metrics on the held-out folds; std over folds, n - 1.

    ``explicit`` has (row id, fold): each fold's rows are held out, all others train. Otherwise ``sampling.kfold``,
    whole groups where there are groups, or equal shares of every label if ``stratified``.
    """
    if not metrics:
        raise ValueError("no metric")
    if data.pairs is not None:
        raise ValueError("cross-validation doesn't split pairs")
    if explicit is not None:
        unknown = explicit.join(data.df.select(data.row_id), data.row_id, "left_anti").limit(1).count()
        if unknown:
            raise ValueError("a fold names an unknown row")
        marked = data.df.join(explicit.select(data.row_id, "fold"), data.row_id, "left")
        numbers = sorted(r[0] for r in explicit.select("fold").distinct().collect())
    else:
        if folds < 2:
            raise ValueError("at least two folds")
        marked, numbers = sampling.kfold(data.df, data.row_id, folds, seed, data.group, data.label if stratified else None), range(folds)
    marked = materialise(marked, "gbt-folds")
    rows = []
    for k in numbers:
        test = F.coalesce(F.col("fold") == k, F.lit(False)) if not inverted else ~F.coalesce(F.col("fold") == k, F.lit(False))
        train, held = marked.where(~test).drop("fold"), marked.where(test).drop("fold")
        model = GBT(**params).fit(data.with_roles(df=train))
        staged = model.staged_predict(held, data.row_id).join(held.select(data.row_id, data.label, *([data.group] if data.group else [])), data.row_id)
        for m in metrics:
            parsed = parse_metric(m)
            if parsed.name in ranking.GROUPED:
                for n in range(1, len(model.trees) + 1):
                    rows.append((k, n - 1, m, ranking.eval_grouped(staged.where(F.col("trees") == n), m, data.group, "prediction", data.label, data.row_id).collect()[0][0]))
                continue
            mean = F.avg(flat_term(parsed, F.col("prediction"), F.col(data.label)))
            got = staged.groupBy("trees").agg((F.sqrt(mean) if parsed.name == "RMSE" else mean).alias("v")).collect()
            rows += [(k, r["trees"] - 1, m, r["v"]) for r in got]
    discard(marked)
    return aggregate_curves(data.df.sparkSession.createDataFrame(rows, "fold int, iteration int, metric string, value double"))


def aggregate_curves(each: DataFrame) -> DataFrame:
    """(iteration, metric, mean, std) of (fold, iteration, metric, value)."""
    return each.groupBy("iteration", "metric").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"))


def grid_search(data: Dataset, grid: dict[str, list], folds: int = 3, metric: str = "RMSE", refit: bool = True, sample: int | None = None, seed: int = 0, error_score: float | None = None, **params):
    """All (or ``sample`` random) combinations by cross-validation; the first of the best. Returns (best, results, model)."""
    cells = [dict(zip(grid, v, strict=True)) for v in product(*grid.values())]
    if sample is not None:
        cells = random.Random(seed).sample(cells, min(sample, len(cells)))
    parsed, results = parse_metric(metric), []
    for c in cells:
        try:
            curve = [r["mean"] for r in cv(data, folds, (metric,), **(params | c)).collect()]
            results.append((c, max(curve) if parsed.maximise else min(curve)))
        except ValueError:
            if error_score is None:
                raise
            results.append((c, error_score))
    best = min(range(len(results)), key=lambda i: (math.isnan(results[i][1]), -results[i][1] if parsed.maximise else results[i][1], i))
    model = GBT(**(params | results[best][0])).fit(data) if refit else None
    return results[best][0], results, model


def randomized_search(data: Dataset, grid: dict[str, list], n_iter: int = 10, **params):
    return grid_search(data, grid, sample=n_iter, **params)


def select_features(data: Dataset, keep: int, steps: int = 1, candidates: list[str] | None = None, importance: Callable[[Model, DataFrame], dict[str, float]] | None = None, **params) -> tuple[list[str], list[str]]:
    """(kept, dropped in order): train, rank, drop the least important candidates, in ``steps`` rounds of geometric size."""
    left = list(data.features)
    pool = [f for f in left if candidates is None or f in candidates]
    if not 0 < keep <= len(pool):
        raise ValueError("the number of features to keep is out of range")
    dropped: list[str] = []
    for k in range(steps):
        now = [f for f in pool if f in left]
        goal = keep if k == steps - 1 else round(len(pool) * (keep / len(pool)) ** ((k + 1) / steps))
        model = GBT(**params).fit(data.with_roles(features=tuple(left)))
        score = importance(model, data.df) if importance else model.importance()
        worst = sorted(now, key=lambda f: (score.get(f, 0.0), f))[: max(0, len(now) - goal)]
        dropped += worst
        left = [f for f in left if f not in worst]
    return [f for f in left if f in pool], dropped


def eval_metric(df: DataFrame, metric: str, approx: str, target: str, weight: str | None = None, group: str | None = None, row_id: str | None = None) -> float:
    if group is None:
        return eval_flat(df, [metric], approx, target, weight).collect()[0][0]
    return ranking.eval_grouped(df, metric, group, approx, target, row_id, weight).collect()[0][0]


def save_params(p: Params) -> str:
    return json.dumps({f.name: getattr(p, f.name) for f in fields(p) if f.name not in ("loss", "custom_objective", "custom_metric")} | {"loss": p.loss if isinstance(p.loss, str) else p.loss.name})


__all__ = ["GBT", "Metric", "NUMPY", "Params", "aggregate_curves", "auto_learning_rate", "cv", "eval_metric", "exact_leaf_values", "grid_search", "randomized_search", "replace", "save_params", "select_features"]
