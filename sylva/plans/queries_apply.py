"""Registered queries over fixed small models, grouped derivatives and the other operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from sylva.functions import losses, metrics
from sylva.operators import binning, encoding, histogram, leaves, querywise, ranking, sampling, text, vectors
from sylva.operators.binning import F32_MAX, F32_MIN
from sylva.plans.model import Ctr, Model, Node, Tree, sum_models
from sylva.plans.queries import _DICT, _EV, _H, _ORD, _events, _hist, _lines, _orders, _pairs, _words, table

NAMES = ["l_quantity", "l_discount", "l_tax"]


def _two(f: int, x: float, g: int, y: float, values: list, weights: list) -> Tree:
    """Symmetric: bit 0 of a leaf is feature f over x, bit 1 feature g over y."""
    leaf = lambda i: Node(value=values[i], weight=weights[i])
    return Tree([Node(f, x, 1, 2, weight=sum(weights)), Node(g, y, 3, 4, weight=weights[0] + weights[2]), Node(g, y, 5, 6, weight=weights[1] + weights[3]), leaf(0), leaf(2), leaf(1), leaf(3)])


A = _two(0, 24.5, 1, 0.045, [-1.0, 2.0, 0.5, 3.0], [10.0, 20.0, 30.0, 40.0])
B = Tree([Node(2, 0.035, 1, 2, weight=100.0), Node(value=0.25, weight=50.0), Node(0, 10.5, 3, 4, weight=50.0), Node(value=-0.75, weight=20.0), Node(value=1.5, weight=30.0)])
C = Tree([Node(0, 40.5, 1, 2, weight=100.0), Node(value=-0.5, weight=60.0), Node(value=0.5, weight=40.0)])
D = _two(0, 15.5, 2, 0.055, [0.3, -0.2, 0.7, 1.1], [25.0, 25.0, 30.0, 20.0])
BORDERS = {"l_quantity": [10.5, 24.5, 40.5], "l_discount": [0.045], "l_tax": [0.035]}


def _model(*trees, bias=0.1, **more) -> Model:
    return Model(NAMES, list(trees), bias, borders=BORDERS, **more)


def raw_predict(spark, d):
    return _model(A, B, C).predict(_lines(spark, d)).select("row_id", F.round("prediction", 6).alias("prediction"))


def large_predict(spark, d):
    """The same over Arrow batches: so many trees that the model isn't one expression."""
    return _model(*[A, B, C] * 150).predict(_lines(spark, d)).select("row_id", F.round("prediction", 4).alias("prediction"))


def leaf_index(spark, d):
    return _model(A, B, C).leaf_indexes(_lines(spark, d), "row_id").select("row_id", *[F.col("leaves")[i].alias(f"leaf_{i}") for i in range(3)])


def leaf_weights(spark, d):
    return _model(A, B, C).leaf_weights(_lines(spark, d), "l_quantity")


def staged_predict(spark, d):
    return _model(A, B, C).staged_predict(_lines(spark, d), "row_id", 2).select("row_id", "trees", F.round("prediction", 6).alias("prediction"))


def sliced_predict(spark, d):
    return _model(A, B, C).predict(_lines(spark, d), start=1, end=3).select("row_id", F.round("prediction", 6).alias("prediction"))


def prediction_types(spark, d):
    m = _model(A, B, C)
    out = _lines(spark, d).select("row_id", *NAMES)
    for kind in ("Probability", "LogProbability", "Class", "Exponent"):
        out = m.predict(out, kind, kind.lower())
    return m.predict_proba(out).select("row_id", *[F.round(k, 6).alias(k) for k in ("probability", "logprobability", "exponent")], "class", F.round(F.col("probabilities")[0], 6).alias("other"))


def virtual_ensembles(spark, d):
    got = _model(A, B, C, A, C).virtual_ensembles(_lines(spark, d), 2)
    return got.select("row_id", *[F.round(F.col("ensembles")[i], 6).alias(f"e{i}") for i in range(2)])


def _uncertain() -> Model:
    both = lambda t, k: Tree([Node(n.feature, n.border, n.left, n.right, [n.value, k * n.value] if n.feature < 0 else 0.0, n.weight) for n in t.nodes])
    return Model(NAMES, [both(A, 0.1), both(B, 0.2), both(C, -0.3)], [0.1, -0.2], "Uncertainty")


def uncertainty_predict(spark, d):
    return _uncertain().predict(_lines(spark, d), "RMSEWithUncertainty").select("row_id", F.round(F.col("prediction")[0], 6).alias("mean"), F.round(F.col("prediction")[1], 6).alias("variance"))


def total_uncertainty(spark, d):
    m = _uncertain()
    m.trees = [m.trees[i] for i in (0, 1, 2, 0, 2)]
    got = m.virtual_ensembles(_lines(spark, d), 2, kind="TotalUncertainty")
    return got.select("row_id", *[F.round(F.col("ensembles")[i], 6).alias(n) for i, n in enumerate(("mean", "knowledge", "data"))])


def multiclass_predict(spark, d):
    three = Tree([Node(n.feature, n.border, n.left, n.right, [n.value, -n.value, n.value * n.value] if n.feature < 0 else 0.0, n.weight) for n in B.nodes])
    m = Model(NAMES, [three], [0.1, 0.2, -0.3], "Softmax", classes=[3.0, 5.0, 8.0])
    x = m.predict(m.predict(_lines(spark, d).select("row_id", *NAMES), "Probability", "p"), "Class", "c")
    return x.select("row_id", *[F.round(F.col("p")[i], 6).alias(f"p{i}") for i in range(3)], F.col("c").alias("class"))


def merged_predict(spark, d):
    return sum_models([_model(A, bias=0.1), _model(B, C, bias=0.2)], [0.5, 2.0]).predict(_lines(spark, d)).select("row_id", F.round("prediction", 6).alias("prediction"))


def partial_dependence(spark, d):
    return _model(A, B, C).partial_dependence(_lines(spark, d), "l_quantity").select("value", F.round("prediction", 6).alias("prediction"))


def partial_dependence_2(spark, d):
    return _model(A, B, C).partial_dependence(_lines(spark, d), "l_quantity", "l_discount").select(F.round("value_0", 6).alias("value_0"), F.round("value_1", 6).alias("value_1"), F.round("prediction", 6).alias("prediction"))


def shap(spark, d):
    got = _model(A, C).shap(_lines(spark, d), "row_id")
    return got.select("row_id", *[F.round(F.col("shap")[i] + 1e-12, 6).alias(n) for i, n in enumerate(("quantity", "discount", "tax", "expected"))])


def shap_interactions(spark, d):
    got = _model(A, C).shap_interactions(_lines(spark, d), "row_id")
    return got.select("row_id", *[F.round(F.col("shap")[i] + 1e-12, 6).alias(n) for i, n in ((0, "quantity"), (1, "both"), (5, "discount"))])


def sage(spark, d):
    return _model(A, C).sage(_lines(spark, d), "row_id").select("feature", F.round("value", 6).alias("value"))


def loss_function_change(spark, d):
    x = _lines(spark, d).withColumn("y", F.col("l_extendedprice") / 20000)
    return _model(A, C).loss_function_change(x, "row_id", "y").select("feature", F.round("value", 6).alias("value"))


def importance(spark, d):
    rows = _model(A, C).importance(_lines(spark, d)).items()
    return spark.createDataFrame([(k, round(v, 6)) for k, v in rows], "feature string, value double")


def interactions(spark, d):
    return spark.createDataFrame([(a, b, round(v, 6)) for a, b, v in _model(A, D, C).interactions()], "a string, b string, value double")


def ctr_predict(spark, d):
    """A tree that splits at a target statistic, one at a category."""
    x = _orders(spark, d)
    t = x.groupBy(F.col("o_orderpriority").alias("__c0")).agg(F.count(F.lit(1)).alias("total"), F.sum("t").cast("double").alias("good"), F.sum("t").cast("double").alias("target_sum"))
    ctr = Ctr("ctr", ["o_orderpriority"], "Borders", 0.5, 200, 5, 0.0, t)
    trees = [Tree([Node(0, 97.5, 1, 2), Node(value=-1.0), Node(value=1.0)]), Tree([Node(1, 0.0, 1, 2, category="P"), Node(value=0.25), Node(value=2.0)])]
    m = Model(["ctr", "o_orderstatus"], trees, 0.0, ctrs=[ctr], cats=["o_orderpriority", "o_orderstatus"])
    return m.predict(x).select("o_orderkey", "prediction")


def online_ctr_bins(spark, d):
    """Bins of statistics of earlier orders, in the order of their keys, for two priors."""
    x, made = encoding.online_ctr(_orders(spark, d), ["o_orderpriority", "o_orderstatus"], "t", 0.5, "Borders", [0.0, 2.0], 15, "o_orderkey", None)
    return x.select("o_orderkey", *[F.col(f"`{c.name}`").alias(f"bin_{i}") for i, c in enumerate(made)])


def counter_ctr_bins(spark, d):
    x, made = encoding.online_ctr(_orders(spark, d), ["o_custkey"], "t", 0.5, "Counter", [0.0], 15, "o_orderkey", None)
    return x.select("o_orderkey", F.col(f"`{made[0].name}`").alias("bin"))


def buckets_ctr(spark, d):
    x = table(spark, d, "orders").withColumn("cls", F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2))
    return encoding.ordered_ctr(x, ["o_orderpriority"], "cls", "o_orderkey", border=1, kind="Buckets").select("o_orderkey", F.round("ctr", 9).alias("ctr"))


def combined_ctr(spark, d):
    x, keys = _orders(spark, d), ["o_orderpriority", "o_custkey"]
    return encoding.apply_ctr(x, encoding.ctr_table(x, keys, "t"), keys, shift=0.5, scale=2.0).select("o_orderkey", F.round("ctr", 9).alias("ctr"))


def class_remap(spark, d):
    return encoding.class_remap(table(spark, d, "lineitem"), "l_linenumber")


def encoded_labels(spark, d):
    x = encoding.encode_labels(table(spark, d, "orders"), "o_orderstatus", ["P", "O", "F"])
    return x.select("o_orderkey", "label_code", encoding.decode_labels(F.col("label_code"), ["P", "O", "F"]).alias("label"))


# losses and grouped derivatives ---------------------------------------------------


def loss_derivatives_more(spark, d):
    e = _events(spark, d).select("event_id", (F.col("approx") / 100).alias("a"), "target", (F.col("target") > 1).cast("double").alias("y"))
    out = ["event_id"]
    for key, loss, t in (("quantile", losses.quantile(0.7), "target"), ("mae", losses.make_loss("MAE"), "target"), ("lq15", losses.lq(1.5), "target"), ("lq3", losses.make_loss("Lq:q=3"), "target"), ("expectile", losses.expectile(0.3), "target"), ("tweedie", losses.tweedie(1.3), "target"), ("focal", losses.focal(0.3, 1.5), "y"), ("huber", losses.huber(2.0), "target")):
        d1, d2 = loss.ders(F.col("a"), F.col(t))
        out += [(F.round(d1, 6) + 0.0).alias(f"{key}_1"), (F.round(d2.cast("double"), 6) + 0.0).alias(f"{key}_2")]
    return e.select(*out)


def multiclass_derivatives(spark, d):
    e = _events(spark, d).select("event_id", (F.col("approx") / 100).alias("a"), F.col("target").cast("int").alias("t"))
    e = e.withColumn("v", F.array(F.col("a"), F.col("a") / 2, -F.col("a")))
    soft, each = losses.multiclass_der1(F.col("v"), F.col("t")), losses.one_vs_all_der1(F.col("v"), F.col("t"))
    mean, scale = losses.uncertainty_ders(F.col("a"), F.col("a") / 4, F.col("t"))
    return e.select("event_id", *[F.round(soft[i], 6).alias(f"soft_{i}") for i in range(3)], *[F.round(each[i], 6).alias(f"each_{i}") for i in range(3)], F.round(mean, 6).alias("mean"), F.round(scale, 6).alias("scale"))


def _ranked_events(spark, d, by=100):
    return _events(spark, d).select(F.col("event_id").alias("row_id"), F.col("user_id").alias("group"), F.col("target").alias("label"), (1.0 + F.pmod("event_id", F.lit(2))).alias("weight"), (F.col("approx") / by).alias("approx"))


def weighted_query_rmse(spark, d):
    return querywise.query_rmse(_ranked_events(spark, d, 1)).select("row_id", F.round(F.col("der") + 1e-7, 3).alias("der"), "der2")


def weighted_query_softmax(spark, d):
    return querywise.query_softmax(_ranked_events(spark, d), 1.5, 0.1).select("row_id", F.round("der", 6).alias("der"), F.round("der2", 6).alias("der2"))


def weighted_pair_logit(spark, d):
    pairs = _pairs(_events(spark, d)).withColumn("weight", F.lit(2.0))
    return querywise.pair_logit(_ranked_events(spark, d), pairs).select("row_id", F.round("der", 6).alias("der"), F.round("der2", 6).alias("der2"))


def pair_weights(spark, d):
    e = _events(spark, d)
    return querywise.pair_weights(e, _pairs(e), "event_id")


def lambda_mart(spark, d):
    got = querywise.by_group(_ranked_events(spark, d).withColumn("weight", F.lit(1.0)), "LambdaMart", 0, norm=False, top=10)
    return got.select("row_id", F.round(F.col("der") + 1e-12, 6).alias("der"), F.round("der2", 6).alias("der2"))


def group_weight(spark, d):
    return _events(spark, d).groupBy("user_id").agg(F.round(F.avg(F.abs("approx")), 6).alias("weight"))


def group_numbers(spark, d):
    return _events(spark, d).select("event_id", ranking.group_ids(_events(spark, d), "target").alias("group_id"))


def _metric(name, top=False):
    def run(spark, d):
        e = _events(spark, d).withColumn("target", F.col("target") / 2 if top else F.col("target") / 3)
        return ranking.group_values(e, name, "user_id", "approx", "target", "event_id").select("user_id", F.round("value", 6).alias("value"))

    return run


def mean_ndcg(spark, d):
    e = _events(spark, d).withColumn("w", 1.0 + F.pmod("event_id", F.lit(3)))
    return ranking.eval_grouped(e, "NDCG:top=10", "user_id", "approx", "target", "event_id", "w").select(F.round(F.col("`NDCG:top=10`"), 6).alias("value"))


def weighted_metrics(spark, d):
    e = _events(spark, d).select((F.abs("approx") / 50).alias("approx"), "target", (1.0 + F.pmod("event_id", F.lit(3))).alias("w"))
    m = metrics.eval_flat(e, ["RMSE", "MAE", "MSLE"], "approx", "target", "w")
    return m.select(*[F.round(F.col(f"`{c}`"), 6).alias(c.lower()) for c in m.columns])


def estimator_scores(spark, d):
    e = _events(spark, d).withColumn("p", F.pmod(F.round("approx").cast("long"), F.lit(3)).cast("double"))
    return metrics.accuracy(e, "target", "p").crossJoin(metrics.r2(e, "target", "p")).select(F.round("accuracy", 6).alias("accuracy"), F.round("r2", 6).alias("r2"))  # one row each


# histograms, leaves, bins, rows ------------------------------------------------------


def _score(kind):
    def run(spark, d):
        s = histogram.score_splits(histogram.scan(_hist(spark, d)), score=kind)
        return s.select("feature", "border", F.round(F.col("score") / 1e6, 1).alias("score"))

    return run


def one_hot_scan(spark, d):
    return histogram.scan_one_hot(_hist(spark, d)).select("leaf", "feature", "border", F.round("left_der", 1).alias("left_der"), "left_weight", F.round("right_der", 1).alias("right_der"), "right_weight")


def _halves(spark, d):
    x = _lines(spark, d).select(F.floor("l_quantity").cast("int").alias("b0"), F.floor(F.col("l_tax") * 100 + 0.5).cast("int").alias("b1"), F.col("l_extendedprice").alias("g"), (F.col("l_discount") > 0.05).alias("right"))
    whole = histogram.bucket_histogram(x, ["b0", "b1"], F.lit(0), F.col("g"), F.lit(1.0))
    part = lambda on: histogram.bucket_histogram(x.where(F.col("right") == on), ["b0", "b1"], F.lit(0), F.col("g"), F.lit(1.0))
    return whole, part


def sibling_histogram(spark, d):
    whole, part = _halves(spark, d)
    return histogram.subtract(whole, part(True)).select("feature", "bin", F.round("der", 2).alias("der"), "weight")


def added_histogram(spark, d):
    _, part = _halves(spark, d)
    return histogram.add(part(True), part(False)).select("feature", "bin", F.round("der", 2).alias("der"), "weight")


def pair_weight_statistics(spark, d):
    e = _events(spark, d)
    rows = e.select("event_id", F.pmod("event_id", F.lit(2)).cast("int").alias("leaf"), F.col("target").cast("int").alias("b0"), F.pmod("event_id", F.lit(5)).cast("int").alias("b1"))
    return histogram.pair_weight_statistics(_pairs(e), rows, "event_id", ["b0", "b1"], "leaf")


def exact_leaves(spark, d):
    x = table(spark, d, "orders").select(F.col("o_orderstatus").alias("node"), F.col("o_totalprice").alias("label"), F.lit(0.0).alias("approx"), F.lit(1.0).alias("weight"))
    return leaves.exact_leaf_values(x, 0.3).select("node", F.round("value", 2).alias("value"))


def leaf_newton(spark, d):
    e = _events(spark, d).select(F.pmod("user_id", F.lit(7)).cast("int").alias("leaf"), (F.col("approx") / 100).alias("a"), (F.col("target") > 1).cast("double").alias("t"))
    d1, d2 = losses.make_loss("Logloss").ders(F.col("a"), F.col("t"))
    s = histogram.leaf_stats(e, F.col("leaf"), d1, F.lit(1.0), d2)
    return s.select("leaf", F.round("der2", 5).alias("der2"), F.round(F.col("der") / (-F.col("der2") + 3), 6).alias("value"))


def quantized_missing(spark, d):
    x = _lines(spark, d).select("row_id", F.when(F.col("l_linenumber") != 3, F.col("l_tax")).alias("x"), F.when(F.col("l_linenumber") != 2, F.col("l_tax")).otherwise(float("nan")).alias("y"))
    b = [0.02, 0.05]
    return x.select("row_id", binning.bin_of(F.col("x"), [F32_MIN, *b]).alias("low"), binning.bin_of(F.col("y"), [*b, F32_MAX]).alias("high"), binning.bin_of(F.col("x"), b).alias("none"))


def mixed_borders(spark, d):
    return binning.uniform_and_quantile_borders(table(spark, d, "lineitem"), ["l_quantity", "l_tax"], 7).select("feature", F.round(F.col("border").cast("double"), 4).alias("border")).distinct()


def row_take(spark, d):
    """Rows by a list of ids, one of them twice."""
    from sylva.sources.dataset import Dataset

    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    ids = o.where("o_totalprice > 300000").select("o_orderkey").unionByName(o.where("o_totalprice > 400000").select("o_orderkey"))
    return Dataset(o, "o_orderkey", ("o_totalprice",)).take(ids).df


def sparse_folds(spark, d):
    x = table(spark, d, "customer").select((F.col("c_custkey") * F.col("c_custkey")).alias("id"))
    return sampling.kfold(x, "id", 7)


def stratified_folds(spark, d):
    return sampling.kfold(table(spark, d, "customer"), "c_custkey", 3, stratify="c_nationkey").select("c_custkey", "fold")


def grouped_folds(spark, d):
    return sampling.kfold(table(spark, d, "orders"), "o_orderkey", 4, group="o_custkey").select("o_orderkey", "fold")


def ordered_segments(spark, d):
    return sampling.ordered_segments(table(spark, d, "customer").select("c_custkey"), "c_custkey", None)


def curves(spark, d):
    """Mean and deviation of per-fold values."""
    from sylva.plans.gbt import aggregate_curves

    e = _events(spark, d).select(F.pmod("event_id", F.lit(5)).cast("int").alias("fold"), F.pmod("user_id", F.lit(20)).cast("int").alias("iteration"), "approx")
    each = e.groupBy("fold", "iteration").agg(F.avg("approx").alias("value")).withColumn("metric", F.lit("RMSE"))
    return aggregate_curves(each).select("iteration", "metric", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


def applied_dictionary(spark, d):
    docs, words = _words(spark, d)
    got = text.apply_dictionary(docs, "doc_id", F.col("tokens"), words, unknown=50_000)
    return got.select("doc_id", F.size("ids").cast("long").alias("n"), F.aggregate("ids", F.lit(0).cast("long"), lambda s, x: F.pmod(s * 31 + x, F.lit(1_000_003))).alias("digest"))


def bag_of_words(spark, d):
    docs, words = _words(spark, d)
    return text.bag_of_words(text.digitize(docs, "doc_id", F.col("tokens"), words), "doc_id", [0, 1, 7])


def _near(spark, d):
    e = table(spark, d, "embeddings")
    return e, vectors.nearest(e, e.where(F.col("vec_id") % 100 == 0), "vec_id", "embedding", 5)


def knn_votes(spark, d):
    e, found = _near(spark, d)
    return vectors.knn_votes(found, e, "vec_id", "label")


def knn_mean(spark, d):
    e, found = _near(spark, d)
    return vectors.knn_mean(found, e.withColumn("y", F.col("vec_id") / 10.0), "vec_id", "y").select("query", F.round("mean", 6).alias("mean"))


def online_knn(spark, d):
    """Neighbours among the vectors that come earlier."""
    e = table(spark, d, "embeddings")
    found = vectors.nearest(e, e.where(F.col("vec_id") % 100 == 0), "vec_id", "embedding", 5, before="vec_id")
    return found.select("query", "neighbour", F.round("distance", 4).alias("distance"), "rank")


QUERIES = {f.__name__: f for f in (
    raw_predict, large_predict, leaf_index, leaf_weights, staged_predict, sliced_predict, prediction_types, virtual_ensembles, uncertainty_predict, total_uncertainty, multiclass_predict,
    merged_predict, partial_dependence, partial_dependence_2, shap, shap_interactions, sage, loss_function_change, importance, interactions, ctr_predict, online_ctr_bins, counter_ctr_bins,
    buckets_ctr, combined_ctr, class_remap, encoded_labels, loss_derivatives_more, multiclass_derivatives, weighted_query_rmse, weighted_query_softmax, weighted_pair_logit, pair_weights,
    lambda_mart, group_weight, group_numbers, mean_ndcg, weighted_metrics, estimator_scores, one_hot_scan, sibling_histogram, added_histogram, pair_weight_statistics, exact_leaves, leaf_newton,
    quantized_missing, mixed_borders, row_take, sparse_folds, stratified_folds, grouped_folds, ordered_segments, curves, applied_dictionary, bag_of_words, knn_votes, knn_mean, online_knn,
)}
QUERIES |= {"pfound": _metric("PFound:top=8:decay=0.9"), "err": _metric("ERR:top=6"), "soft_auc": _metric("QueryAUC:type=Classic", True), "ranking_auc": _metric("QueryAUC:type=Ranking")}
QUERIES |= {f"split_scores_{k.lower()}": _score(k) for k in ("Cosine", "SolarL2", "LOOL2", "SatL2")}

_L = "x as (select *, l_orderkey * 10 + l_linenumber as row_id, l_quantity::float > 24.5::float as qa, l_discount::float > 0.045::float as da, l_tax::float > 0.035::float as tb, l_quantity::float > 10.5::float as qb, l_quantity::float > 40.5::float as qc from lineitem)"
_T = _L + """, p as (select *, case when qa then case when da then 3.0::double else 2.0 end when da then 0.5 else -1.0 end as a,
    case when tb then case when qb then 1.5::double else -0.75 end else 0.25 end as b, case when qc then 0.5::double else -0.5 end as c from x)"""
#: Shapley values of A and C: the value with a set of features known; an unknown split is passed by its training weights.
_S = _T + """, v as (select *, a as vqd, case when qa then (2.0 * 20 + 3.0 * 40) / 60.0 else (-1.0 * 10 + 0.5 * 30) / 40.0 end::double as vq, case when da then 0.4 * 0.5 + 0.6 * 3.0 else -0.4 * 1.0 + 0.6 * 2.0 end::double as vd,
    1.65::double as v0 from p), s as (select *, ((vq - v0) + (vqd - vd)) / 2 + c + 0.1 as quantity, ((vd - v0) + (vqd - vq)) / 2 as discount from v)"""
_PD = """g as (select unnest([9.5, 17.5, 32.5, 41.5])::double as v), gd as (select unnest([-0.955, 1.045])::double as u)"""
_RK = """e as (select event_id as row_id, user_id as grp, cast(event_id % 3 as double) as label, 1.0::double + event_id % 2 as weight, round(value, 2) / 100 as approx from events)"""
_PAIRS = """l as (select *, lag(event_id) over w as other, lag(target) over w as t from e window w as (partition by user_id order by event_id)),
    pr as (select case when target > t then event_id else other end as winner, case when target > t then other else event_id end as loser from l where target <> t)"""


def _scores(term: str) -> str:
    return f"with {_H} select feature, border, round(({term.format(s='left')} + {term.format(s='right')}) / 1e6, 1) as score from z"


def _ranks(target: str) -> str:
    return f"e as (select event_id, user_id, round(value, 2) as approx, cast(event_id % 3 as double) / {target} as target from events), r as (select *, row_number() over (partition by user_id order by approx desc, target, event_id) as pos, count(*) over (partition by user_id) as size from e)"


ORACLE_SQL = {
    "raw_predict": f"with {_T} select row_id, round(0.1 + a + b + c, 6) as prediction from p",
    "large_predict": f"with {_T} select row_id, round(0.1 + 150 * (a + b + c), 4) as prediction from p",
    "leaf_index": f"with {_L} select row_id, qa::int + 2 * da::int as leaf_0, case when tb then case when qb then 4 else 3 end else 1 end as leaf_1, qc::int as leaf_2 from x",
    "leaf_weights": f"with {_L}, i as (select 0 as tree, qa::int + 2 * da::int as leaf, l_quantity as w from x union all select 1, case when tb then case when qb then 4 else 3 end else 1 end, l_quantity from x union all select 2, qc::int, l_quantity from x) select tree, leaf, sum(w) as weight from i group by 1, 2",
    "staged_predict": f"with {_T} select row_id, 2 as trees, round(0.1 + a + b, 6) as prediction from p union all select row_id, 3, round(0.1 + a + b + c, 6) from p",
    "sliced_predict": f"with {_T} select row_id, round(b + c, 6) as prediction from p",
    "prediction_types": f"with {_T}, r as (select row_id, 0.1 + a + b + c as v from p) select row_id, round(1 / (1 + exp(-v)), 6) as probability, round(ln(1 / (1 + exp(-v))), 6) as logprobability, (v > 0)::int as class, round(exp(v), 6) as exponent, round(1 - 1 / (1 + exp(-v)), 6) as other from r",
    "virtual_ensembles": f"with {_T} select row_id, round(0.1 + 2 * a + b + c, 6) as e0, round(0.1 + 2 * a + b + 2 * c, 6) as e1 from p",
    "uncertainty_predict": f"with {_T} select row_id, round(0.1 + a + b + c, 6) as mean, round(exp(2 * (-0.2 + 0.1 * a + 0.2 * b - 0.3 * c)), 6) as variance from p",
    "total_uncertainty": f"""with {_T}, e as (select row_id, 0.1 + 2 * a + b + c as m0, 0.1 + 2 * a + b + 2 * c as m1, exp(2 * (-0.2 + 0.2 * a + 0.2 * b - 0.3 * c)) as s0, exp(2 * (-0.2 + 0.2 * a + 0.2 * b - 0.6 * c)) as s1 from p)
        select row_id, round((m0 + m1) / 2, 6) as mean, round((m0 - m1) * (m0 - m1) / 4, 6) as knowledge, round((s0 + s1) / 2, 6) as data from e""",
    "multiclass_predict": f"""with {_T}, r as (select row_id, 0.1 + b as r0, 0.2 - b as r1, -0.3 + b * b as r2 from p), z as (select *, exp(r0) + exp(r1) + exp(r2) as z from r)
        select row_id, round(exp(r0) / z, 6) as p0, round(exp(r1) / z, 6) as p1, round(exp(r2) / z, 6) as p2, case when r0 >= r1 and r0 >= r2 then 3.0::double when r1 >= r2 then 5.0 else 8.0 end as class from z""",
    "merged_predict": f"with {_T} select row_id, round(0.5 * (0.1 + a) + 2 * (0.2 + b + c), 6) as prediction from p",
    "partial_dependence": f"""with {_L}, {_PD} select v as value, round(avg(0.1 + case when v > 24.5 then case when da then 3.0::double else 2.0 end when da then 0.5 else -1.0 end + case when tb then case when v > 10.5 then 1.5::double else -0.75 end else 0.25 end + case when v > 40.5 then 0.5::double else -0.5 end), 6) as prediction from x, g group by 1""",
    "partial_dependence_2": f"""with {_L}, {_PD} select v as value_0, u as value_1, round(avg(0.1 + case when v > 24.5 then case when u > 0.045 then 3.0::double else 2.0 end when u > 0.045 then 0.5 else -1.0 end + case when tb then case when v > 10.5 then 1.5::double else -0.75 end else 0.25 end + case when v > 40.5 then 0.5::double else -0.5 end), 6) as prediction from x, g, gd group by 1, 2""",
    "shap": f"with {_S} select row_id, round(quantity + 1e-12, 6) as quantity, round(discount + 1e-12, 6) as discount, 0.0::double as tax, 1.65::double as expected from s",
    "shap_interactions": f"with {_S}, i as (select *, (vqd - vq - vd + v0) / 2 as h from s) select row_id, round(quantity - h + 1e-12, 6) as quantity, round(h + 1e-12, 6) as both, round(discount - h + 1e-12, 6) as discount from i",
    "sage": f"with {_S}, m as (select avg(abs(quantity)) as q, avg(abs(discount)) as d from s) select 'l_quantity' as feature, round(q, 6) as value from m union all select 'l_discount', round(d, 6) from m union all select 'l_tax', 0.0 from m",
    "loss_function_change": f"""with {_S}, r as (select l_extendedprice / 20000 - (quantity + discount + 1.65) as r, quantity as q, discount as d from s), m as (select sqrt(avg(r * r)) as b, sqrt(avg((r + q) * (r + q))) as mq, sqrt(avg((r + d) * (r + d))) as md from r)
        select 'l_quantity' as feature, round(mq - b, 6) as value from m union all select 'l_discount', round(md - b, 6) from m union all select 'l_tax', 0.0 from m""",
    "importance": f"""with {_L}, w as (select count(*) filter (not qa and not da)::double as w0, count(*) filter (qa and not da)::double as w1, count(*) filter (not qa and da)::double as w2, count(*) filter (qa and da)::double as w3, count(*) filter (not qc)::double as c0, count(*) filter (qc)::double as c1 from x),
        m as (select *, (-1.0 * w0 + 0.5 * w2) / (w0 + w2) as l, (2.0 * w1 + 3.0 * w3) / (w1 + w3) as r from w), e as (select (w0 + w2) * (w1 + w3) / (w0 + w1 + w2 + w3) * (l - r) * (l - r) + c0 * c1 / (c0 + c1) as q, w0 * w2 / (w0 + w2) * 2.25 + w1 * w3 / (w1 + w3) as d from m)
        select 'l_quantity' as feature, round(100 * q / (q + d), 6) as value from e union all select 'l_discount', round(100 * d / (q + d), 6) from e union all select 'l_tax', 0.0 from e""",
    "interactions": """with s as (select abs(-(-1.0) + 2.0 + 0.5 - 3.0) as qd, abs(-0.3 - 0.2 + 0.7 - 1.1) as qt) select 'l_quantity' as a, 'l_discount' as b, round(100 * qd / (qd + qt), 6)::double as value from s union all select 'l_quantity', 'l_tax', round(100 * qt / (qd + qt), 6)::double from s""",
    "ctr_predict": f"""with {_ORD}, t as (select o_orderpriority, count(*) as n, sum(t) as g from o group by 1) select o_orderkey, case when floor((g + 0.5::double) / (n + 1) * 200) > 97.5 then 1.0::double else -1.0 end + case when o_orderstatus = 'P' then 2.0::double else 0.25 end as prediction from o join t using (o_orderpriority)""",
    "online_ctr_bins": f"""with {_ORD}, s as (select o_orderkey, coalesce(sum(t) over w, 0)::double as g, count(*) over w as n from o window w as (partition by o_orderpriority, o_orderstatus order by o_orderkey rows between unbounded preceding and 1 preceding))
        select o_orderkey, least(14, floor(g / (n + 1) * 15))::int as bin_0, least(14, floor((g + 2) / (n + 1) / 2 * 15))::int as bin_1 from s""",
    "counter_ctr_bins": "with c as (select o_custkey, count(*) as n from orders group by 1), m as (select max(n) as top from c) select o_orderkey, least(14, floor(n::double / (top + 1) * 15))::int as bin from orders join c using (o_custkey), m",
    "buckets_ctr": "with o as (select *, (o_orderstatus = 'O')::int as t from orders) select o_orderkey, round((coalesce(sum(t) over w, 0) + 0.5::double) / (count(*) over w + 1), 9) as ctr from o window w as (partition by o_orderpriority order by o_orderkey rows between unbounded preceding and 1 preceding)",
    "combined_ctr": f"with {_ORD} select o_orderkey, round(((sum(t) over w + 0.5::double) / (count(*) over w + 1) + 0.5) * 2, 9) as ctr from o window w as (partition by o_orderpriority, o_custkey)",
    "class_remap": "select l_linenumber, row_number() over (order by l_linenumber) - 1 as class from (select distinct l_linenumber from lineitem)",
    "encoded_labels": "select o_orderkey, case o_orderstatus when 'P' then 0 when 'O' then 1 else 2 end as label_code, o_orderstatus as label from orders",
    "loss_derivatives_more": f"""with {_EV}, f as (select event_id, approx / 100 as a, target as t, (target > 1)::int::double as y from e), g as (select *, t - a as r, abs(t - a) as m, greatest(1e-13, least(1 - 1e-13, 1 - 1 / (1 + exp(a)))) as p from f),
        k as (select *, case when y = 1 then 0.3::double else 0.7 end as w, case when y = 1 then p else 1 - p end as q, 2 * y - 1 as s from g), u as (select *, w * s * power(1 - q, 1.5) as u1, 1 - q - 1.5 * q * ln(q) as u2, -1.5 * w * s * power(1 - q, 0.5) as v1, -1 - 1.5 * (ln(q) + 1) as v2 from k)
        select event_id, case when m < 1e-6 then 0 when r > 0 then 0.7::double else -0.3 end as quantile_1, 0.0::double as quantile_2, case when m < 1e-6 then 0 when r > 0 then 0.5::double else -0.5 end as mae_1, 0.0::double as mae_2,
        round(sign(r) * 1.5 * power(m, 0.5), 6) + 0.0 as lq15_1, round(case when m > 0 then -0.75 * power(m, -0.5) else 0 end, 6) + 0.0 as lq15_2, round(sign(r) * 3 * m * m, 6) + 0.0 as lq3_1, round(-6 * m, 6) + 0.0 as lq3_2,
        round(2 * case when r > 0 then 0.3::double else 0.7 end * r, 6) + 0.0 as expectile_1, round(case when r > 0 then -0.6::double else -1.4 end, 6) as expectile_2,
        round(t * exp(-0.3 * a) - exp(0.7 * a), 6) + 0.0 as tweedie_1, round(-0.3 * t * exp(-0.3 * a) - 0.7 * exp(0.7 * a), 6) + 0.0 as tweedie_2, round(u1 * u2, 6) + 0.0 as focal_1, round((v1 * u2 + u1 * v2) * s * q * (1 - q), 6) + 0.0 as focal_2,
        round(case when m < 2 then r else sign(r) * 2 end, 6) + 0.0 as huber_1, case when m < 2 then -1.0::double else 0.0 end as huber_2 from u""",
    "multiclass_derivatives": f"""with {_EV}, f as (select event_id, approx / 100 as a, target as t from e), g as (select *, exp(a) + exp(a / 2) + exp(-a) as z from f) select event_id, round((t = 0)::int - exp(a) / z, 6) as soft_0, round((t = 1)::int - exp(a / 2) / z, 6) as soft_1, round((t = 2)::int - exp(-a) / z, 6) as soft_2,
        round((t = 0)::int - (1 - 1 / (1 + exp(a))), 6) as each_0, round((t = 1)::int - (1 - 1 / (1 + exp(a / 2))), 6) as each_1, round((t = 2)::int - (1 - 1 / (1 + exp(-a))), 6) as each_2, round(t - a, 6) as mean, round((t - a) * (t - a) * exp(-2 * (a / 4)) - 1, 6) as scale from g""",
    "weighted_query_rmse": f"with {_RK} select row_id, round((label - approx * 100) - sum(weight * (label - approx * 100)) over w / sum(weight) over w + 1e-7, 3) as der, -1.0::double as der2 from e window w as (partition by grp)",
    "weighted_query_softmax": f"""with {_RK}, m as (select *, weight * exp(1.5 * (approx - max(approx) over (partition by grp))) as x from e), s as (select *, x / sum(x) over w as p, sum(weight * label) over w as mass from m window w as (partition by grp))
        select row_id, round(case when mass > 0 then 1.5 * (weight * label - mass * p) / weight else 0 end, 6) as der, round(case when mass > 0 then 1.5 * mass * (1.5 * p * (p - 1) - 0.1) / weight else 0 end, 6) as der2 from s""",
    "weighted_pair_logit": f"""with {_EV}, {_PAIRS}, g as (select winner, loser, 1 / (1 + exp(a.approx / 100 - b.approx / 100)) as q from pr join e a on a.event_id = winner join e b on b.event_id = loser),
        s as (select id, sum(d) as d, sum(h) as h from (select winner as id, 2 * q as d, 2 * q * (q - 1) as h from g union all select loser, -2 * q, 2 * q * (q - 1) from g) group by 1)
        select event_id as row_id, round(coalesce(d, 0) / (1 + event_id % 2), 6) as der, round(coalesce(h, 0) / (1 + event_id % 2), 6) as der2 from e left join s on id = event_id""",
    "pair_weights": f"with {_EV}, {_PAIRS}, s as (select id, count(*)::double as w from (select winner as id from pr union all select loser from pr) group by 1) select event_id, coalesce(w, 0) as pair_weight from e left join s on id = event_id",
    "lambda_mart": f"""with {_RK}, r as (select *, row_number() over (partition by grp order by approx desc, row_id) as pos, row_number() over (partition by grp order by label desc, row_id) as ipos from e), i as (select grp, sum(case when ipos <= 10 then label / log2(ipos + 1) else 0 end) as ideal from r group by 1),
        j as (select a.row_id as w, b.row_id as l, 1 / (1 + exp(a.approx - b.approx)) as q, case when ideal > 0 then (a.label - b.label) * abs(1 / log2(a.pos + 1) - 1 / log2(b.pos + 1)) / ideal else 0 end as z from r a join r b on a.grp = b.grp and a.label > b.label and (a.pos <= 10 or b.pos <= 10) join i on i.grp = a.grp),
        s as (select id, sum(d) as d, sum(h) as h from (select w as id, z * q as d, -z * q * (1 - q) as h from j union all select l, -z * q, -z * q * (1 - q) from j) group by 1) select row_id, round(coalesce(d, 0) + 1e-12, 6) as der, round(coalesce(h, 0), 6) as der2 from e left join s on id = row_id""",
    "group_weight": f"with {_EV} select user_id, round(avg(abs(approx)), 6) as weight from e group by 1",
    "group_numbers": f"with {_EV} select event_id, target::bigint as group_id from e",
    "pfound": f"with {_ranks('3')}, s as (select *, coalesce(product(1 - target) over (partition by user_id order by pos rows between unbounded preceding and 1 preceding), 1) as reach from r) select user_id, round(sum(case when pos <= 8 then target * reach * power(0.9, pos - 1) else 0 end), 6) as value from s group by 1",
    "err": f"with {_ranks('3')}, s as (select *, coalesce(product(1 - target) over (partition by user_id order by pos rows between unbounded preceding and 1 preceding), 1) as reach from r) select user_id, round(sum(case when pos <= 6 then target * reach / pos else 0 end), 6) as value from s group by 1",
    "soft_auc": f"""with {_ranks('2')}, p as (select a.user_id, sum(a.target * (1 - b.target) * case when a.approx > b.approx then 1.0 when a.approx = b.approx then 0.5 else 0 end) as up, sum(a.target * (1 - b.target)) as down from e a join e b on a.user_id = b.user_id and a.target > 0 and b.target < 1 group by 1)
        select u.user_id, round(coalesce(up / down, 0), 6) as value from (select distinct user_id from e) u left join p using (user_id)""",
    "ranking_auc": f"""with {_ranks('3')}, p as (select a.user_id, avg(case when a.approx > b.approx then 1.0::double when a.approx = b.approx then 0.5 else 0 end) as v from e a join e b on a.user_id = b.user_id and a.target > b.target group by 1)
        select u.user_id, round(coalesce(v, 0), 6) as value from (select distinct user_id from e) u left join p using (user_id)""",
    "mean_ndcg": f"""with {_EV}, r as (select *, 1 + event_id % 3 as w, row_number() over (partition by user_id order by approx desc, target, event_id) as pos, row_number() over (partition by user_id order by target desc, event_id) as ipos from e),
        g as (select user_id, avg(w) as w, sum(case when pos <= 10 then target / log2(pos + 1) else 0 end) as d, sum(case when ipos <= 10 then target / log2(ipos + 1) else 0 end) as i from r group by 1) select round(sum(w * case when i > 0 then d / i else 1 end) / sum(w), 6) as value from g""",
    "weighted_metrics": f"with {_EV}, f as (select abs(approx) / 50 as a, target as t, 1 + event_id % 3 as w from e) select round(sqrt(sum(w * (a - t) * (a - t)) / sum(w)), 6) as rmse, round(sum(w * abs(a - t)) / sum(w), 6) as mae, round(sum(w * power(ln(1 + a) - ln(1 + t), 2)) / sum(w), 6) as msle from f",
    "estimator_scores": f"with {_EV}, f as (select target as t, (((round(approx)::bigint % 3) + 3) % 3)::double as p from e) select round(avg((t = p)::int), 6) as accuracy, round(1 - sum((t - p) * (t - p)) / (var_pop(t) * count(*)), 6) as r2 from f",
    "split_scores_cosine": f"with {_H} select feature, border, round((left_der*left_der/(left_weight+3) + right_der*right_der/(right_weight+3)) / sqrt(1e-100 + power(left_der/(left_weight+3),2)*left_weight + power(right_der/(right_weight+3),2)*right_weight) / 1e6, 1) as score from z",
    "split_scores_solarl2": _scores("{s}_der*{s}_der*(1 + 2*ln({s}_weight + 1))/{s}_weight"),
    "split_scores_lool2": _scores("case when {s}_weight > 1 then {s}_der*{s}_der*{s}_weight/(({s}_weight-1)*({s}_weight-1)) else 0 end"),
    "split_scores_satl2": _scores("case when {s}_weight > 2 then {s}_der*{s}_der*({s}_weight-2)/({s}_weight*{s}_weight-3*{s}_weight+1) else 0 end"),
    "one_hot_scan": f"with {_H} select leaf, feature, bin as border, round(sum(der) over w - der, 1) as left_der, sum(weight) over w - weight as left_weight, round(der, 1) as right_der, weight as right_weight from h window w as (partition by feature)",
    "sibling_histogram": """with c as (select 0 as feature, floor(l_quantity)::int as bin, l_extendedprice as g, l_discount > 0.05 as r from lineitem union all select 1, floor(l_tax * 100 + 0.5)::int, l_extendedprice, l_discount > 0.05 from lineitem)
        select feature, bin, round(coalesce(sum(g) filter (not r), 0), 2) as der, count(*) filter (not r)::double as weight from c group by 1, 2""",
    "added_histogram": """with c as (select 0 as feature, floor(l_quantity)::int as bin, l_extendedprice as g from lineitem union all select 1, floor(l_tax * 100 + 0.5)::int, l_extendedprice from lineitem) select feature, bin, round(sum(g), 2) as der, count(*)::double as weight from c group by 1, 2""",
    "pair_weight_statistics": f"""with {_EV}, {_PAIRS}, c as (select event_id, (event_id % 2)::int as leaf, target::int as b0, (event_id % 5)::int as b1 from e), j as (select a.leaf as wl, b.leaf as ll, a.b0 as w0, b.b0 as l0, a.b1 as w1, b.b1 as l1 from pr join c a on a.event_id = winner join c b on b.event_id = loser),
        u as (select 0 as feature, wl, w0 as w, ll, l0 as l from j union all select 1, wl, w1, ll, l1 from j) select feature, wl as winner_leaf, w as winner_bin, ll as loser_leaf, l as loser_bin, count(*)::double as weight from u group by 1, 2, 3, 4, 5""",
    "exact_leaves": "with r as (select o_orderstatus as node, o_totalprice::float as r, row_number() over (partition by o_orderstatus order by o_totalprice::float) as n, count(*) over (partition by o_orderstatus) as size from orders) select node, round(min(r)::double, 2) as value from r where n >= 0.3 * size - 1e-9 group by 1",
    "leaf_newton": f"with {_EV}, f as (select (user_id % 7)::int as leaf, 1 - 1 / (1 + exp(approx / 100)) as p, (target > 1)::int as t from e) select leaf, round(sum(-p * (1 - p)), 5) as der2, round(sum(t - p) / (sum(p * (1 - p)) + 3), 6) as value from f group by 1",
    "quantized_missing": """with x as (select l_orderkey * 10 + l_linenumber as row_id, l_linenumber as n, (l_tax::float > 0.02::float)::int + (l_tax::float > 0.05::float)::int as b from lineitem) select row_id, case when n = 3 then 0 else b + 1 end as low, case when n = 2 then 3 else b end as high, case when n = 3 then 0 else b end as none from x""",
    "mixed_borders": """with v as (select 'l_quantity' as feature, l_quantity::float as v from lineitem union all select 'l_tax', l_tax::float from lineitem), r as (select feature, v, row_number() over (partition by feature order by v) - 1 as rank, count(*) over (partition by feature) as n, min(v) over (partition by feature) as lo, max(v) over (partition by feature) as hi from v),
        p as (select distinct feature, v from r join (select unnest(range(1, 5)) as i) q on r.rank = least(q.i * r.n // 5, r.n - 1) where v > lo), m as (select distinct feature, lo, hi from r)
        select distinct feature, round(b::double, 4) as border from (select feature, ((select max(b.v) from r b where b.feature = p.feature and b.v < p.v) + p.v) / 2::float as b from p union all select feature, lo + i::float * (hi - lo) / 4::float from m, (select unnest(range(1, 4)) as i))""",
    "row_take": "select o_orderkey, o_totalprice from orders where o_totalprice > 300000 union all select o_orderkey, o_totalprice from orders where o_totalprice > 400000",
    "sparse_folds": """with f as (select c_custkey * c_custkey as id, row_number() over (order by c_custkey) - 1 as p, count(*) over () // 7 as s, count(*) over () % 7 as x from customer) select id, (case when p < x * (s + 1) then p // (s + 1) else x + (p - x * (s + 1)) // s end)::int as fold from f""",
    "stratified_folds": "select c_custkey, ((row_number() over (partition by c_nationkey order by c_custkey) - 1) % 3)::int as fold from customer",
    "grouped_folds": """with g as (select o_custkey, min(o_orderkey) as first from orders group by 1), f as (select o_custkey, row_number() over (order by first) - 1 as p, count(*) over () // 4 as s, count(*) over () % 4 as x from g)
        select o_orderkey, (case when p < x * (s + 1) then p // (s + 1) else x + (p - x * (s + 1)) // s end)::int as fold from orders join f using (o_custkey)""",
    "ordered_segments": """with recursive n as (select count(*) as n from customer), e(b) as (select case when n > 500 then least(100, n // 50) else 1 end from n union all select least(b * 2, n) from e, n where b < n), p as (select c_custkey, row_number() over (order by c_custkey) - 1 as position from customer)
        select c_custkey, position, (select count(*) from e where b <= position)::int as segment from p""",
    "curves": f"with {_EV}, f as (select (event_id % 5)::int as fold, (user_id % 20)::int as iteration, avg(approx) as value from e group by 1, 2) select iteration, 'RMSE' as metric, round(avg(value), 6) as mean, round(stddev_samp(value), 6) as std from f group by 1",
    "applied_dictionary": f"""with {_DICT}, i as (select doc_id, list(coalesce(w.id, 50000) order by pos) as ids from k left join w using (token) group by 1) select doc_id, len(ids) as n, list_reduce(list_prepend(0::bigint, ids), lambda s, x: (s * 31 + x) % 1000003) as digest from i""",
    "bag_of_words": f"with {_DICT} select doc_id, max((id = 0)::int) as w0, max((id = 1)::int) as w1, max((id = 7)::int) as w7 from bag group by 1",
}
_KNN = """d as (select q.vec_id as query, b.vec_id as neighbour, b.label, list_sum(list_transform(range(1, len(b.embedding) + 1), lambda i: power(b.embedding[i]::double - q.embedding[i]::double, 2))) as distance from embeddings q, embeddings b where q.vec_id % 100 = 0{0}),
    k as (select *, row_number() over (partition by query order by d.distance, neighbour) as rank from d qualify rank <= 5)"""
ORACLE_SQL |= {
    "knn_votes": f"with {_KNN.format('')} select query, label, count(*) as votes from k group by 1, 2",
    "knn_mean": f"with {_KNN.format('')} select query, round(avg(neighbour / 10.0), 6) as mean from k group by 1",
    "online_knn": f"with {_KNN.format(' and b.vec_id < q.vec_id')} select query, neighbour, round(distance, 4) as distance, rank from k",
}
