"""Operators of the library against numpy, DuckDB and their own definitions."""

import math
import os

import numpy as np
import pytest

from pyspark.sql import functions as F
from sylva.functions import losses, metrics
from sylva.operators import binning, encoding, ranking, sampling, vectors
from sylva.plans.gbt import GBT, Params, cv, exact_leaf_values, grid_search
from sylva.plans.model import F32_MAX, Model, Node, Tree, sum_models
from sylva.plans import queries, queries_apply
from sylva.sources.dataset import Dataset

SF = "/root/testdata/sf0.001"
QUERIES, ORACLE_SQL = queries.QUERIES | queries_apply.QUERIES, queries.ORACLE_SQL | queries_apply.ORACLE_SQL


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    return c


def _rows(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(str(round(r[i], 6) if isinstance(r[i], float) else r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_equals_sql(spark, duck, name):
    df, sql = QUERIES[name](spark, SF), duck.sql(ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(sql.columns)
    assert _rows(df.collect(), df.columns) == _rows(sql.fetchall(), sql.columns)


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((400, 3))
    y = 2 * x[:, 0] - (x[:, 1] > 0.3) + 0.1 * rng.standard_normal(400)
    rows = [(i, float(a), float(b), None if i % 50 == 0 else float(c), float(t), float(t > 0), i // 40) for i, ((a, b, c), t) in enumerate(zip(x, y, strict=True))]
    df = spark.createDataFrame(rows, "row_id long, a double, b double, c double, y double, z double, g long")
    return Dataset(df, "row_id", ("a", "b", "c"), label="y")


@pytest.mark.parametrize("policy", ["SymmetricTree", "Depthwise", "Lossguide", "Region"])
def test_training_lowers_the_error(data, policy):
    m = GBT(iterations=8, depth=3, learning_rate=0.4, border_count=16, grow_policy=policy, max_leaves=6, checkpoint_trees=3).fit(data)
    got = metrics.eval_flat(m.predict(data.df), ["RMSE"], "prediction", "y").collect()[0][0]
    assert got < (1.2 if policy == "Region" else 0.9) and len(m.trees) == 8
    if policy == "Lossguide":
        assert all(sum(n.feature < 0 for n in t.nodes) <= 6 for t in m.trees)
    staged = {(r["row_id"], r["trees"]): r["prediction"] for r in m.staged_predict(data.df, "row_id", 4).collect()}
    last = {r["row_id"]: r["prediction"] for r in m.predict(data.df).collect()}
    assert all(abs(staged[i, 8] - v) < 1e-9 for i, v in last.items())


def test_first_tree_equals_numpy(data):
    m = GBT(iterations=1, depth=1, learning_rate=1.0, border_count=8, feature_border_type="Uniform", l2_leaf_reg=3.0).fit(data.ignore(["c"]))
    pdf = data.df.toPandas()
    der, best = pdf["y"] - pdf["y"].mean(), None
    for f in ("a", "b"):
        for b in m.borders[f]:
            right = pdf[f].astype("float32") > np.float32(b)
            sums = [(der[s].sum(), s.sum()) for s in (right, ~right)]
            score = sum(d * d / (n + 3) for d, n in sums) / math.sqrt(1e-100 + sum((d / (n + 3)) ** 2 * n for d, n in sums))
            if best is None or score > best[0] + 1e-12:
                best = (score, f, b, sums)
    root = m.trees[0].nodes[0]
    assert (m.features[root.feature], root.border) == best[1:3]
    (dr, nr), (dl, nl) = best[3]
    assert abs(m.trees[0].nodes[root.right].value - dr / (nr + 3)) < 1e-9 and abs(m.trees[0].nodes[root.left].value - dl / (nl + 3)) < 1e-9


def test_classification_and_options(data):
    z = data.with_roles(label="z")
    for extra in ({"leaf_method": "Newton"}, {"bootstrap_type": "Bayesian", "rsm": 0.7}, {"auto_class_weights": "Balanced"}, {"model_shrink_rate": 0.1}, {"langevin": True}):
        m = GBT(loss="Logloss", iterations=4, depth=3, learning_rate=0.5, border_count=16, **extra).fit(z)
        p = m.predict(z.df, "Probability")
        assert p.where((F.col("prediction") > 0.5) == (F.col("z") == 1)).count() > 320
    with pytest.raises(ValueError):
        GBT(loss="Logloss", iterations=1).fit(data)
    with pytest.raises(ValueError):
        Params.of(no_such=1)
    assert Params.of(n_estimators=5, max_depth=3).iterations == 5


def test_exact_leaves_early_stop_and_search(spark, data):
    m = GBT(loss="MAE", iterations=3, depth=2, learning_rate=0.5, leaf_method="Exact", border_count=8).fit(data)
    assert len(m.trees) == 3
    rows = spark.createDataFrame([(0, float(v), 0.0, 1.0) for v in (5, 1, 3, 9)], "node int, label double, approx double, weight double")
    assert exact_leaf_values(rows, 0.5).collect()[0]["value"] == 3
    m = GBT(iterations=6, depth=2, learning_rate=3.0, border_count=8, od_type="Iter", od_wait=2, use_best_model=True).fit(data, data)
    assert len(m.trees) < 6 and m.history["RMSE"]
    best, results, _ = grid_search(data, {"depth": [1, 2]}, folds=2, iterations=2, border_count=8, refit=False, learning_rate=0.5)
    assert len(results) == 2 and best in [c for c, _ in results]
    curve = cv(data, 2, ("RMSE",), iterations=2, depth=1, border_count=8)
    assert curve.count() == 2


def test_explanations(spark, data):
    m = GBT(iterations=4, depth=3, learning_rate=0.5, border_count=8, grow_policy="Depthwise").fit(data)
    shap = {r["row_id"]: r["shap"] for r in m.shap(data.df, "row_id").collect()}
    for r in m.predict(data.df).limit(50).collect():
        assert abs(sum(shap[r["row_id"]]) - r["prediction"]) < 1e-6
    imp = m.importance()
    assert abs(sum(imp.values()) - 100) < 1e-6 and imp["a"] == max(imp.values())
    assert m.interactions() and m.partial_dependence(data.df, "a").count() > 2
    again = Model.from_json(m.to_json())
    assert again.predict(data.df).exceptAll(m.predict(data.df)).count() == 0
    double = sum_models([m, m], [0.5, 0.5])
    a, b = (x.predict(data.df).agg(F.sum("prediction")).collect()[0][0] for x in (m, double))
    assert abs(a - b) < 1e-6
    big = Model(m.features, m.trees * 60, m.bias)
    one = big.predict(data.df).agg(F.sum("prediction")).collect()[0][0]
    assert abs(one - (a + 59 * (a - 400 * m.bias))) < 1e-4


def test_missing_values(spark):
    df = spark.createDataFrame([(float("nan"),), (None,), (-0.0,), (1.0,), (2.0,)], "x double")
    for mode, top in (("Min", 0), ("Max", 2)):
        b = binning.select_borders(df, ["x"], 3, "Uniform", mode)["x"]
        bins = [r[0] for r in df.select(binning.bin_of(F.col("x"), b)).collect()]
        assert bins[0] == bins[1] == (0 if mode == "Min" else len(b)) and (F32_MAX in b) == (mode == "Max")
    with pytest.raises(ValueError):
        binning.select_borders(df, ["x"], 3, "Uniform", "Forbidden")
    t = Tree([Node(0, 1.0, 1, 2, missing_right=True), Node(value=1.0), Node(value=2.0)])
    assert t.leaf_of(np.array([[np.nan], [0.5], [1.0], [1.5]], dtype=np.float32)).tolist() == [2, 1, 1, 2]


def test_missing_values_outside_the_sample(spark):
    df = spark.range(4000).select("id", F.when(F.col("id") != 17, F.col("id").cast("double")).alias("x"), F.when(F.col("id") != 18, F.col("id") / 2).otherwise(float("nan")).alias("y"))
    for kind in ("Uniform", "GreedyLogSum"):
        for row_id in ("id", None):
            low, top = (binning.select_borders(df, ["x", "y"], 5, kind, mode, 100, row_id) for mode in ("Min", "Max"))
            for f, i in (("x", 17), ("y", 18)):
                assert low[f][0] == binning.F32_MIN and top[f][-1] == F32_MAX and low[f][1:] == top[f][:-1] and len(low[f]) == 5
                bins = {r["id"]: (r["a"], r["b"]) for r in df.select("id", binning.bin_of(F.col(f), low[f]).alias("a"), binning.bin_of(F.col(f), top[f]).alias("b")).collect()}
                assert bins.pop(i) == (0, 5) and {a for a, _ in bins.values()} == {1, 2, 3, 4, 5} and {b for _, b in bins.values()} == {0, 1, 2, 3, 4}
            with pytest.raises(ValueError):
                binning.select_borders(df, ["x", "y"], 5, kind, "Forbidden", 100, row_id)


def test_exact_borders_are_optimal():
    from itertools import combinations

    v, n = np.arange(7.0), np.array([3, 1, 4, 1, 5, 9, 2])
    for kind in ("log", "entropy"):
        cost = lambda cuts: sum(float(binning._penalty(kind, n[a:b].sum())) for a, b in zip((0, *cuts), (*cuts, 7), strict=True))  # noqa: B023, E731
        got = tuple(int(x + 0.5) for x in binning.exact_splits(v, n, 2, kind))
        assert abs(cost(got) - min(cost(c) for c in combinations(range(1, 7), 2))) < 1e-9
    assert len(binning.greedy_splits(v, n, 3, "log")) == 3 and binning.greedy_splits(v[:1], n[:1], 3, "log") == []


def test_derivatives_are_derivatives(spark):
    value = {
        "RMSE": lambda a, t: -((t - a) ** 2) / 2, "Logloss": lambda a, t: t * a - math.log(1 + math.exp(a)), "Poisson": lambda a, t: t * a - math.exp(a),
        "LogCosh": lambda a, t: -math.log(math.cosh(a - t)), "Tweedie": lambda a, t: t * math.exp(-0.5 * a) / -0.5 - math.exp(0.5 * a) / 0.5,
        "Focal": lambda a, t: (0.25 if t else 0.75) * (1 - (p := (1 / (1 + math.exp(-a)) if t else 1 / (1 + math.exp(a))))) ** 2 * math.log(p), "Huber": lambda a, t: -((t - a) ** 2) / 2 if abs(t - a) < 1 else -abs(t - a) + 0.5,
    }
    rows = spark.createDataFrame([(0.3, 1.0), (-0.7, 0.0), (1.9, 1.0)], "a double, t double")
    for name, f in value.items():
        d1, d2 = losses.make_loss(name).ders(F.col("a"), F.col("t"))
        for r in rows.select("a", "t", d1.alias("d1"), d2.cast("double").alias("d2")).collect():
            up, mid, down = (f(r["a"] + e, r["t"]) for e in (1e-4, 0, -1e-4))
            assert abs((up - down) / 2e-4 - r["d1"]) < 1e-4 and abs((up - 2 * mid + down) / 1e-8 - r["d2"]) < 1e-3, name
    with pytest.raises(ValueError):
        losses.make_loss("Nope")


def test_metric_strings():
    m = metrics.parse_metric("NDCG:top=10:type=Exp")
    assert m.params == {"top": "10", "type": "Exp"} and m.maximise
    for bad in ("Nope", "NDCG:x=1", "NDCG:top=1:top=2", "NDCG:top"):
        with pytest.raises(ValueError):
            metrics.parse_metric(bad)


def test_cascade_metrics(spark):
    df = spark.createDataFrame([(1, 1, 3.0, 0.5), (2, 1, 2.0, 0.2), (3, 1, 1.0, 0.4)], "id long, g long, a double, t double")
    get = lambda m: ranking.group_values(df, m, "g", "a", "t", "id").collect()[0]["value"]
    assert abs(get("PFound") - (0.5 + 0.5 * 0.2 * 0.85 + 0.5 * 0.8 * 0.4 * 0.85**2)) < 1e-9
    assert abs(get("ERR") - (0.5 + 0.5 * 0.2 / 2 + 0.5 * 0.8 * 0.4 / 3)) < 1e-9


def test_sampling(spark):
    df = spark.range(4000).withColumnRenamed("id", "row_id")
    for kind, mean in (("Bayesian", 1.0), ("Bernoulli", 0.8), ("Poisson", 1.0)):
        assert abs(df.agg(F.avg(sampling.bootstrap_weight("row_id", kind, 3))).collect()[0][0] - mean) < 0.07
    mean, var = df.select(sampling.normal("row_id", 4).alias("x")).agg(F.avg("x"), F.var_pop("x")).collect()[0]
    assert abs(mean) < 0.06 and abs(var - 1) < 0.08


def test_vectors(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.standard_normal((40, 2)) * [3, 0.2], rng.standard_normal((40, 2)) * [3, 0.2] + [0, 2]])
    df = spark.createDataFrame([(i, [float(v) for v in r], int(i >= 40)) for i, r in enumerate(x)], "id long, v array<double>, c int")
    w = vectors.lda(df, "v", "c")[0]
    assert abs(w[1]) > 5 * abs(w[0])
    got = vectors.nearest(df, df.where("id < 5"), "id", "v", 3, max_bytes=40).collect()
    for q in range(5):
        want = np.lexsort((np.arange(80), ((x - x[q]) ** 2).sum(axis=1)))[:3].tolist()
        assert [r["neighbour"] for r in sorted(got, key=lambda r: r["rank"]) if r["query"] == q] == want


def test_dataset(spark):
    import pandas as pd

    d = Dataset.from_any(spark, pd.DataFrame({"x": [1.0, 2.0], "y": [0.0, 1.0]}), features=["x"], label="y").validate()
    assert d.columns() == ["row_id", "x", "y"] and d.take(d.df.limit(1)).df.count() == 1
    with pytest.raises(TypeError):
        Dataset.from_any(spark, np.zeros((2, 2)))
    with pytest.raises(ValueError):
        Dataset(spark.createDataFrame([(1, 1.0), (1, 2.0)], "row_id long, x double"), "row_id", ("x",)).validate()
    with pytest.raises(ValueError):
        d.ignore(["nope"])
    assert encoding.route(1) == "Skip" and encoding.route(2) == "OneHot" and encoding.route(3) == "Ctr"
    assert encoding.projections(["a", "b"], 2) == [("a",), ("b",), ("a", "b")]


# --- the trainer against a plain one ---


def plain_trainer(x, y, borders, policy, trees, depth, rate, l2, max_leaves):
    """Boosting for RMSE with the Cosine score by exhaustive search over rows: predictions of the training rows."""
    n = len(y)
    pred = np.full(n, y.mean())
    splits = [(f, b) for f in range(x.shape[1]) for b in borders[f]]

    def score(parts):
        up = down = 0.0
        for rows in parts:
            if rows.any():
                s, w = der[rows].sum(), rows.sum()
                avg = s / (w + l2)
                up, down = up + avg * s, down + avg * avg * w
        return up / math.sqrt(1e-100 + down)

    def halves(rows, f, b):
        return rows & ~(x[:, f] > b), rows & (x[:, f] > b)

    def best(rows):
        found = None
        for f, b in splits:
            left, right = halves(rows, f, b)
            if left.any() and right.any():
                v = score([left, right]) - score([rows])
                if found is None or v > found[0] + 1e-9:
                    found = (v, f, b)
        return found if found and found[0] >= 1e-9 else None

    for _ in range(trees):
        der = y - pred
        leaves = [np.ones(n, dtype=bool)]
        if policy == "SymmetricTree":
            for _ in range(depth):
                found = None
                for f, b in splits:
                    parts = [h for r in leaves for h in halves(r, f, b)]
                    if any(h.any() for h in parts[::2]) and any(h.any() for h in parts[1::2]):
                        v = score(parts)
                        if found is None or v > found[0] + 1e-9:
                            found = (v, f, b)
                leaves = [h for r in leaves for h in halves(r, found[1], found[2])]
        else:
            open_, done, level = [(leaves[0], 0)], [], 0
            while open_ and level < (max_leaves - 1 if policy == "Lossguide" else depth):
                level += 1
                got = [(best(r) if d < depth else None, i) for i, (r, d) in enumerate(open_)]
                can = [(g, i) for g, i in got if g]
                if not can:
                    break
                if policy == "Depthwise":
                    nxt = []
                    for (r, d), (g, _) in zip(open_, got, strict=True):
                        if g:
                            nxt += [(h, d + 1) for h in halves(r, g[1], g[2])]
                        else:
                            done.append((r, d))
                    open_ = nxt
                    continue
                g, i = max(can, key=lambda c: (c[0][0], -c[1]))
                r, d = open_.pop(i)
                new = [(h, d + 1) for h in halves(r, g[1], g[2])]
                if policy == "Region":
                    done += open_
                    open_ = new
                else:
                    open_ += new
            leaves = [r for r, _ in open_ + done]
        for rows in leaves:
            if rows.any():
                pred = pred + np.where(rows, rate * der[rows].sum() / (rows.sum() + l2), 0.0)
    return pred


@pytest.mark.parametrize("policy", ["SymmetricTree", "Depthwise", "Lossguide", "Region"])
def test_trees_equal_a_plain_trainer(data, policy):
    own = data.ignore(["c"])
    m = GBT(iterations=3, depth=3, learning_rate=0.5, border_count=7, feature_border_type="Uniform", grow_policy=policy, max_leaves=5, checkpoint_trees=2).fit(own)
    pdf = own.df.toPandas().sort_values("row_id")
    x = pdf[["a", "b"]].to_numpy(dtype=np.float32)
    want = plain_trainer(x, pdf["y"].to_numpy(), [m.borders["a"], m.borders["b"]], policy, 3, 3, 0.5, 3.0, 5)
    got = m.predict(own.df).toPandas().sort_values("row_id")["prediction"].to_numpy()
    assert np.abs(got - want).max() < 1e-6


def test_options_of_the_trainer(spark, data):
    rmse = lambda m, d=data: metrics.eval_flat(m.predict(d.df), ["RMSE"], "prediction", "y").collect()[0][0]
    base = {"iterations": 4, "depth": 3, "learning_rate": 0.5, "border_count": 16}
    plain = GBT(**base).fit(data)
    for extra in ({"bootstrap_type": "MVS", "subsample": 0.6}, {"model_shrink_rate": 0.1, "checkpoint_trees": 2}, {"random_strength": 1.0, "model_shrink_rate": 0.1, "model_shrink_mode": "Decreasing"}, {"posterior_sampling": True}):
        a, b = (GBT(**base, **extra).fit(data) for _ in range(2))
        assert rmse(a) < 1.3 and a.to_json() == b.to_json()  # reruns agree
    # every row counted once, whatever the sampling
    assert all(abs(t.nodes[0].weight - 400) < 1e-6 for t in plain.trees)
    up = GBT(**base, monotone_constraints=(0, 1, 0)).fit(data)
    line = [r["prediction"] for r in up.partial_dependence(data.df, "b").orderBy("value").collect()]
    assert all(x <= y + 1e-9 for x, y in zip(line, line[1:], strict=False))
    never = GBT(**base, first_feature_use_penalties=(0.0, 1e9, 1e9)).fit(data)
    assert {n.feature for t in never.trees for n in t.nodes if n.feature >= 0} == {0}
    for bad in ({"od_type": "Nonsense"}, {"score_function": "X"}, {"bootstrap_type": "X"}, {"boosting_type": "Ordered"}, {"class_weights": (1.0, 2.0), "scale_pos_weight": 2.0}, {"monotone_constraints": (2,)}):
        with pytest.raises(ValueError):
            Params.of(**bad)
    with pytest.raises(ValueError):
        GBT(iterations=1).fit(data.with_roles(texts=("c",)))
    with pytest.raises(ValueError, match="iterations"):
        Params.of(iteration=3)


def test_snapshots(data, tmp_path):
    base = {"depth": 2, "learning_rate": 0.5, "border_count": 8, "save_snapshot": True, "snapshot_file": str(tmp_path / "snap"), "snapshot_interval": 0.0}
    GBT(iterations=3, **base).fit(data)
    seen = []
    m = GBT(iterations=5, **base).fit(data, on_iteration=lambda i, _: seen.append(i))
    whole = GBT(iterations=5, depth=2, learning_rate=0.5, border_count=8).fit(data)
    assert seen == [3, 4] and len(m.trees) == 5
    a, b = (x.predict(data.df).toPandas()["prediction"].to_numpy() for x in (m, whole))
    assert np.abs(a - b).max() < 1e-9
    with pytest.raises(ValueError):
        GBT(iterations=5, **(base | {"depth": 3})).fit(data)


def test_losses_of_several_outputs(spark, data):
    df = data.df.withColumn("m", F.when(F.col("y") < -1, 3.0).when(F.col("y") < 1, 5.0).otherwise(8.0)).withColumn("z2", (F.col("b") > 0.3).cast("double"))
    d = Dataset(df, "row_id", ("a", "b"), label="m")
    base = {"iterations": 6, "depth": 3, "learning_rate": 0.5, "border_count": 16}
    for loss, method in (("MultiClass", "Newton"), ("MultiClass", "Gradient"), ("MultiClassOneVsAll", "Newton")):
        m = GBT(loss=loss, leaf_method=method, **base).fit(d)
        assert m.classes == [3.0, 5.0, 8.0]
        assert m.predict(df, "Class").where("prediction = m").count() > 330
    m = GBT(loss="MultiLogloss", **base).fit(d.with_roles(label=None, targets=("z", "z2")))
    assert m.predict(df, "Class").where("prediction[0] = z and prediction[1] = z2").count() > 330
    m = GBT(loss="RMSEWithUncertainty", **base).fit(d.with_roles(label="y"))
    assert metrics.eval_flat(m.predict(df).withColumn("p", F.col("prediction")[0]), ["RMSE"], "p", "y").collect()[0][0] < 1.2
    m = GBT(loss="MultiQuantile:alpha=0.1,0.9", leaf_method="Exact", **base).fit(d.with_roles(label="y"))
    inside = m.predict(df).where("y between prediction[0] and prediction[1]").count()
    assert 240 < inside < 400


def test_ranking(spark, data):
    df = data.df.withColumn("rel", F.when(F.col("y") < -1, 0.0).when(F.col("y") < 1, 1.0).otherwise(2.0))
    d = Dataset(df, "row_id", ("a", "b"), label="rel", group="g")
    ends = df.alias("x").join(df.alias("v"), (F.col("x.g") == F.col("v.g")) & (F.col("x.rel") > F.col("v.rel"))).select(F.col("x.row_id").alias("winner"), F.col("v.row_id").alias("loser"), F.lit(1.0).alias("weight"))
    ndcg = lambda m: ranking.eval_grouped(m.predict(df), "NDCG:top=5", "g", "prediction", "rel", "row_id").collect()[0][0]
    for loss in ("QueryRMSE", "QuerySoftMax", "YetiRank", "LambdaMart", "StochasticRank:num_estimations=5", "PairLogit"):
        m = GBT(loss=loss, iterations=4, depth=3, learning_rate=0.5, border_count=16).fit(d.with_roles(pairs=ends if loss == "PairLogit" else None))
        assert ndcg(m) > 0.85, loss
    with pytest.raises(ValueError):
        GBT(loss="QueryRMSE", iterations=1).fit(d.with_roles(group=None))
    with pytest.raises(ValueError):
        GBT(loss="YetiRankPairwise", iterations=1).fit(d)


def test_gradients_of_groups():
    from sylva.operators import querywise as q

    rng = np.random.default_rng(0)
    for _ in range(20):
        n = int(rng.integers(2, 7))
        t, a = rng.integers(0, 4, n).astype(float), rng.standard_normal(n)
        der, _ = q.lambda_mart(a, t, norm=False)
        want, order = np.zeros(n), np.argsort(-a, kind="stable")
        place = {d: 1 / math.log2(i + 2) for i, d in enumerate(order)}
        ideal = sum(v / math.log2(i + 2) for i, v in enumerate(sorted(t, reverse=True)))
        for i in range(n):
            for j in range(n):
                if t[i] > t[j]:
                    step = (t[i] - t[j]) * abs(place[i] - place[j]) / ideal / (1 + math.exp(a[i] - a[j]))
                    want[i] += step
                    want[j] -= step
        assert np.abs(der - want).max() < 1e-9
    # the stochastic gradient is that of the expected NDCG; without the last projection it would be unbiased
    t, a, rng = np.array([2.0, 0.0, 1.0, 0.0]), np.array([0.1, 0.4, -0.2, 0.0]), np.random.default_rng(1)
    der, _ = q.stochastic_rank(a, t, rng, num_estimations=4000)

    def expected(x, draws):
        order = np.argsort(-(x + draws), axis=1)
        d = 1 / np.log2(np.arange(4) + 2)
        return float((t[order] * d).sum(axis=1).mean() / (np.sort(t)[::-1] * d).sum())

    draws = np.random.default_rng(2).standard_normal((400_000, 4))
    step = 0.3
    slope = np.array([(expected(a + step * e, draws) - expected(a - step * e, draws)) / (2 * step) for e in np.eye(4)])
    z, slope = a - a.mean(), slope - slope.mean()
    slope = slope - (slope @ z) / (math.sqrt(z @ z) + q.STOCHASTIC_NU) ** 2 * z
    assert np.abs(der - slope).max() < 0.03
    w, l, size = q.yeti_pairs(np.array([2, 0, 1]), np.array([0.0, 3.0, 1.0]), 0.5)
    assert w.tolist() == [2, 1] and l.tolist() == [0, 0] and np.allclose(size, [0.15 * 1.0, 0.15 * 0.5 * 3.0])


def test_categories_in_training(spark):
    rng = np.random.default_rng(5)
    k = rng.integers(0, 30, 900)
    effect = rng.standard_normal(30) * 2
    rows = [(i, float(rng.standard_normal()), f"k{c}" if c else None, "ab"[i % 2], float(effect[c] + (i % 2) + 0.1 * rng.standard_normal())) for i, c in enumerate(k)]
    df = spark.createDataFrame(rows, "row_id long, x double, k string, o string, y double")
    d = Dataset(df, "row_id", ("x",), ("k", "o"), label="y")
    base = {"depth": 4, "learning_rate": 0.5, "border_count": 16}
    m = GBT(iterations=10, **base).fit(d)
    without = GBT(iterations=10, **base).fit(d.with_roles(cats=()))
    rmse = lambda m: metrics.eval_flat(m.predict(df), ["RMSE"], "prediction", "y").collect()[0][0]
    assert rmse(m) < 0.75 * rmse(without) and any(n.category is not None for t in m.trees for n in t.nodes) and m.ctrs
    new = spark.createDataFrame([(1, 0.0, "unseen", None, 0.0), (2, 0.0, None, "a", 0.0)], df.schema)
    assert m.predict(new).count() == 2 and m.predict(new).columns == [*df.columns, "prediction"]
    for kind in ("Buckets", "Counter", "BinarizedTargetMeanValue"):
        assert GBT(iterations=2, simple_ctr=kind, **base).fit(d).predict(df).count() == 900


def test_exact_leaves_equal_numpy(spark):
    from sylva.operators import leaves
    from sylva.plans import grower

    rng = np.random.default_rng(8)
    rows = [(i, int(rng.integers(0, 2)), float(np.float32(rng.choice([-2.5, -0.0, 0.0, 1e-20, 3.0, rng.standard_normal()]))), 0.0, float(rng.integers(0, 4))) for i in range(500)]
    frame = spark.createDataFrame(rows, "row_id long, b0 int, l0 double, a0 double, weight double")
    tree = grower.Grown()
    tree.split(0, 0, 0, False)
    spec = grower.Rows(1, 1, 1, grower.pointwise(losses.quantile().ders))
    for alpha in (0.1, 0.5, 0.8):
        got, weight = leaves.quantiles(frame, spec, tree, [alpha], 0.0)
        for node in (1, 2):
            own = sorted((r[2] + 0.0, r[4]) for r in rows if r[1] == node - 1)
            total, at = sum(w for _, w in own), 0.0
            for v, w in own:
                at += w
                if at >= alpha * total - 2**-52:
                    break
            assert abs(got[node, 0] - v) < 1e-9 and abs(weight[node] - total) < 1e-9
    value, _ = leaves.log_cosh(frame, spec, tree)
    for node in (1, 2):
        own = [(r[2], r[4]) for r in rows if r[1] == node - 1]
        assert abs(sum(w * math.tanh(value[node, 0] - r) for r, w in own)) < 1e-5
    frame = frame.select(F.col("b0").alias("node"), F.col("l0").alias("label"), F.col("a0").alias("approx"), "weight")
    by = {r["node"]: r["value"] for r in exact_leaf_values(frame, 0.5).collect()}
    assert all(abs(by[n - 1] - leaves.quantiles(spark.createDataFrame(rows, "row_id long, b0 int, l0 double, a0 double, weight double"), spec, tree, [0.5], 0.0)[0][n, 0]) < 1e-9 for n in (1, 2))


def test_isotonic_and_block_newton():
    from sylva.operators import leaves

    assert leaves.isotonic(np.array([1.0, 3.0, 2.0, 4.0]), np.array([1.0, 1.0, 3.0, 1.0])).tolist() == [1.0, 2.25, 2.25, 4.0]
    p = losses.softmax_rows(np.array([[0.1, 0.5, -0.3]]))
    h = losses.softmax_hessian(p)[0]
    i, j = np.triu_indices(3)
    d = np.array([[0.5, -0.2, -0.3]])
    assert np.allclose((np.eye(3) * 2.0 - h) @ leaves.block_newton(d, h[i, j][None], 2.0)[0], d[0])


def test_detectors():
    from sylva.functions import stopping

    assert stopping.wilcoxon([]) == 0.5 and stopping.wilcoxon([0.0]) == 0.5
    # all of 10 steps down: W = 55, mean 27.5, variance 96.25
    assert abs(stopping.wilcoxon([float(i + 1) for i in range(10)]) - math.erfc(27.5 / math.sqrt(96.25) / math.sqrt(2))) < 1e-12
    it = stopping.detector("Iter", 0.0, 2)
    for v, want in ((1.0, False), (0.5, False), (0.7, True)):
        it.add(v)
        assert it.stopped is want
    for kind in ("IncToDec", "Wilcoxon"):
        d = stopping.detector(kind, 0.05, 5)
        for v in range(20):
            d.add(float(v))
        assert not d.stopped
        for v in range(12):
            d.add(19.0 - 40 * v)
        assert d.stopped, kind


def test_greedy_borders_equal_rows():
    """By rows: a bin is cut at the ends of the run of its middle row's value."""

    def by_rows(rows, borders, kind):
        rows, bins, out = np.sort(rows), [(0, len(rows), 0)], []
        age = 0

        def best(lo, hi):
            mid = rows[lo + (hi - lo) // 2]
            cuts = [c for c in (int(np.searchsorted(rows[lo:hi], mid, "left")) + lo, int(np.searchsorted(rows[lo:hi], mid, "right")) + lo) if lo < c < hi]
            gains = [(float(binning._penalty(kind, hi - lo) - binning._penalty(kind, c - lo) - binning._penalty(kind, hi - c)), -c) for c in cuts]
            return max(gains) if gains else None

        while len(out) < borders:
            can = [(best(lo, hi), -a, lo, hi) for lo, hi, a in bins if best(lo, hi)]
            if not can:
                break
            (_, c), a, lo, hi = max(can, key=lambda g: (g[0][0], g[1]))
            bins.remove((lo, hi, -a))
            bins += [(lo, -c, age + 1), (-c, hi, age + 2)]
            age += 2
            out.append((rows[-c - 1] + rows[-c]) / 2)
        return sorted(out)

    rng = np.random.default_rng(3)
    for _ in range(60):
        rows = rng.integers(0, rng.integers(2, 20), rng.integers(1, 60)).astype(float)
        v, n = np.unique(rows, return_counts=True)
        for kind in ("log", "entropy"):
            assert binning.greedy_splits(v, n, 5, kind) == by_rows(rows, 5, kind)


def test_shapley_values_equal_all_subsets(spark, data):
    """Values by the definition: the expectation with every subset of features known."""
    from itertools import combinations

    m = GBT(iterations=2, depth=3, learning_rate=0.5, border_count=8, grow_policy="Depthwise").fit(data)
    rows = data.df.limit(12).collect()

    def expected(known, r):
        def at(t, i):
            n = t.nodes[i]
            if n.feature < 0:
                return n.value
            a, b = at(t, n.left), at(t, n.right)
            if n.feature in known:
                v = r[m.features[n.feature]]
                return (b if n.missing_right else a) if v is None or math.isnan(v) else b if np.float32(v) > np.float32(n.border) else a
            wa, wb = t.nodes[n.left].weight, t.nodes[n.right].weight
            return (a * wa + b * wb) / (wa + wb)

        return sum(at(t, 0) for t in m.trees)

    got = {x["row_id"]: x["shap"] for x in m.shap(data.df, "row_id").collect()}
    both = {x["row_id"]: np.array(x["shap"]).reshape(4, 4) for x in m.shap_interactions(data.df, "row_id").collect()}
    for r in rows:
        for f in range(3):
            rest = [g for g in range(3) if g != f]
            want = sum(math.factorial(len(s)) * math.factorial(2 - len(s)) / 6 * (expected({*s, f}, r) - expected(set(s), r)) for k in range(3) for s in combinations(rest, k))
            assert abs(got[r["row_id"]][f] - want) < 1e-9
            assert abs(both[r["row_id"]][f, :3].sum() - want) < 1e-9
        for f, g in combinations(range(3), 2):
            (h,) = [x for x in range(3) if x not in (f, g)]
            pair = sum(0.5 * (expected({f, g, *s}, r) - expected({f, *s}, r) - expected({g, *s}, r) + expected(set(s), r)) for s in ((), (h,)))
            assert abs(both[r["row_id"]][f, g] - pair / 2) < 1e-9


def test_files_of_other_tools(spark, data, tmp_path):
    from sylva.plans import export

    ort = pytest.importorskip("onnxruntime")
    pdf = data.df.toPandas()
    x = pdf[["a", "b", "c"]].to_numpy(dtype=np.float32)
    for policy in ("SymmetricTree", "Depthwise"):
        m = GBT(iterations=3, depth=3, learning_rate=0.5, border_count=8, grow_policy=policy).fit(data)
        want = m.predict(data.df).toPandas()["prediction"].to_numpy()
        export.save(m, spark, str(tmp_path / "m.onnx"), "onnx")
        got = ort.InferenceSession((tmp_path / "m.onnx").read_bytes()).run(None, {"features": x})[0][:, 0]
        assert np.abs(got - want).max() < 1e-5
        export.save(m, spark, str(tmp_path / "m.json"), "json")
        again = export.load_json(spark, str(tmp_path / "m.json"))
        assert np.abs(again.predict(data.df).toPandas()["prediction"].to_numpy() - want).max() < 1e-9
    assert export.to_core_ml(GBT(iterations=1, depth=2, border_count=8).fit(data))[:2] == b"\x08\x01"
    with pytest.raises(ValueError):
        export.to_core_ml(m)
    with pytest.raises(ValueError):
        export.from_exchange_json('{"features_info": {"float_features": []}, "oblivious_trees": [{"splits": [], "leaf_values": [1, 2]}]}')


def test_estimators(spark, data):
    from sylva.estimators import Classifier, DataError, NotFittedError, ParameterError, Ranker, Regressor, merged

    base = {"iterations": 4, "depth": 3, "learning_rate": 0.5, "border_count": 16}
    r = Regressor(**base)
    with pytest.raises(NotFittedError):
        r.predict(data.df)
    assert not r.is_fitted and r.fit(data).is_fitted and r.score(data.df, "y") > 0.7 and r.get_params() == base
    with pytest.raises(ParameterError):
        r.set_params(depth=99)
    c = Classifier(**base).fit(data.df, row_id="row_id", features=["a", "b"], label="z")
    assert c.score(data.df, "z") > 0.85 and c.classes_ == [0.0, 1.0]
    assert all(abs(sum(x["probabilities"]) - 1) < 1e-9 for x in c.predict_proba(data.df).limit(5).collect())
    with pytest.raises(DataError):
        Ranker(**base).fit(data)
    both = merged([r, r], [0.5, 0.5])
    assert both.predict(data.df).join(r.predict(data.df).select("row_id", F.col("prediction").alias("p")), "row_id").where("abs(prediction - p) > 1e-9").count() == 0


def test_selection_folds_and_importance(spark, data):
    from sylva.plans.gbt import auto_learning_rate, select_features

    kept, dropped = select_features(data, 1, 2, iterations=3, depth=2, border_count=8, learning_rate=0.5)
    assert kept == ["a"] and set(dropped) == {"b", "c"}
    folds = data.df.select("row_id", F.pmod("row_id", F.lit(2)).cast("int").alias("fold"))
    assert cv(data, metrics=("RMSE",), explicit=folds, iterations=2, depth=1, border_count=8).count() == 2
    m = GBT(iterations=2, depth=2, border_count=8, learning_rate=0.5).fit(data)
    a, b = m.importance(), m.importance(data.df)
    assert all(abs(a[k] - b[k]) < 1e-6 for k in a)
    assert auto_learning_rate("RMSE", False, True, 10_000, 1000) == round(math.exp(0.158 * math.log(10_000) - 4.287), 6)
    x = sampling.kfold(spark.range(12).select((F.col("id") * F.col("id")).alias("id")), "id", 4)
    assert sorted(r["count"] for r in x.groupBy("fold").count().collect()) == [3, 3, 3, 3]
