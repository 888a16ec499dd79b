"""Registered queries of the library and the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from sylva.functions import losses, metrics
from sylva.operators import binning, encoding, histogram, ranking, sampling, text, vectors
from sylva.plans.gbt import GBT
from sylva.sources.dataset import Dataset
from sylva.sources.store import materialise


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


FEATURES = ["l_quantity", "l_discount", "l_tax"]


def _lines(spark, d):
    return table(spark, d, "lineitem").withColumn("row_id", F.col("l_orderkey") * 10 + F.col("l_linenumber"))


def _events(spark, d):
    """Groups are users; approx and target are made from columns."""
    e = table(spark, d, "events")
    return e.select("event_id", "user_id", F.round("value", 2).alias("approx"), F.pmod("event_id", F.lit(3)).cast("double").alias("target"))


def _hist(spark, d):
    x = _lines(spark, d).select(*[F.floor(c).cast("int").alias(f"b{i}") for i, c in enumerate(("l_quantity", F.col("l_discount") * 100 + 0.5, F.col("l_tax") * 100 + 0.5))], F.col("l_extendedprice").alias("p"))
    mean = x.agg(F.avg("p").alias("m"))
    return histogram.bucket_histogram(x.join(F.broadcast(mean)), ["b0", "b1", "b2"], F.lit(0), F.col("p") - F.col("m"), F.lit(1.0))


def first_split(spark, d):
    return histogram.best_split(histogram.score_splits(histogram.scan(_hist(spark, d)))).select("feature", "border", F.round("score", 2).alias("score"))


def bucket_histogram(spark, d):
    return _hist(spark, d).select("leaf", "feature", "bin", F.round("der", 1).alias("der"), "weight")


def border_scan(spark, d):
    return histogram.scan(_hist(spark, d)).select("leaf", "feature", "border", F.round("left_der", 1).alias("left_der"), "left_weight", "right_weight")


def split_scores_l2(spark, d):
    s = histogram.score_splits(histogram.scan(_hist(spark, d)), score="L2")
    return s.select("feature", "border", F.round(F.col("score") / 1e6, 1).alias("score"))


def leaf_values(spark, d):
    x = table(spark, d, "orders")
    s = histogram.leaf_stats(x, F.col("o_orderstatus"), F.col("o_totalprice"), F.lit(1.0), F.lit(-1.0))
    return s.select("leaf", F.round(F.col("der") / (F.col("weight") + 3), 4).alias("gradient"), F.round(F.col("der") / (-F.col("der2") + 3), 4).alias("newton"))


def uniform_borders(spark, d):
    return binning.uniform_borders(table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice"], 7).select("feature", F.round(F.col("border").cast("double"), 2).alias("border"))


def median_borders(spark, d):
    return binning.median_borders(table(spark, d, "lineitem"), ["l_quantity", "l_tax"], 8).select("feature", F.round(F.col("border").cast("double"), 4).alias("border"))


def quantized(spark, d):
    x = binning.quantize(_lines(spark, d), {"l_quantity": [10.0, 20.0, 30.0], "l_tax": [0.02, 0.05]})
    return x.select("row_id", "l_quantity_bin", "l_tax_bin")


def greedy_borders(spark, d):
    return binning.penalty_borders(table(spark, d, "lineitem"), ["l_quantity", "l_discount"], 8)


def exact_borders(spark, d):
    return binning.penalty_borders(table(spark, d, "lineitem"), ["l_quantity", "l_discount"], 8, "MinEntropy")


def class_weights(spark, d):
    return encoding.class_weights(table(spark, d, "orders"), "o_orderstatus").select("o_orderstatus", F.round("class_weight", 9).alias("class_weight"))


def sqrt_class_weights(spark, d):
    return encoding.class_weights(table(spark, d, "orders"), "o_orderstatus", kind="SqrtBalanced").select("o_orderstatus", F.round("class_weight", 9).alias("class_weight"))


def _orders(spark, d):
    return table(spark, d, "orders").withColumn("t", (F.col("o_orderstatus") == "F").cast("int"))


def ordered_ctr(spark, d):
    return encoding.ordered_ctr(_orders(spark, d), ["o_orderpriority"], "t", "o_orderkey").select("o_orderkey", F.round("ctr", 9).alias("ctr"))


def ordered_mean_ctr(spark, d):
    return encoding.ordered_ctr(_orders(spark, d), ["o_orderpriority", "o_orderstatus"], "t", "o_orderkey", prior=0.0, kind="Mean").select("o_orderkey", F.round("ctr", 9).alias("ctr"))


def counter_ctr(spark, d):
    return encoding.counter_ctr(table(spark, d, "orders"), "o_orderpriority").select("o_orderpriority", F.round("ctr", 9).alias("ctr"))


def final_ctr_apply(spark, d):
    x = _orders(spark, d)
    t = encoding.ctr_table(x, ["o_custkey"], "t")
    return encoding.apply_ctr(x, t, ["o_custkey"]).select("o_orderkey", F.round("ctr", 9).alias("ctr"))


def dense_ids(spark, d):
    return encoding.dense_ids(table(spark, d, "orders"), "o_orderpriority", "o_orderkey")


def cardinality(spark, d):
    return table(spark, d, "orders").agg(F.count_distinct("o_orderpriority").alias("priorities"), F.count_distinct("o_orderstatus").alias("states"))


def one_hot(spark, d):
    return encoding.one_hot(table(spark, d, "orders"), "o_orderstatus", ["F", "O"]).select("o_orderkey", F.col("`o_orderstatus=F`").alias("is_f"), F.col("`o_orderstatus=O`").alias("is_o"))


def _words(spark, d):
    docs = table(spark, d, "documents").select("doc_id", text.tokenize(F.col("text")).alias("tokens"))
    return docs, text.dictionary(docs, F.col("tokens"))


def token_dictionary(spark, d):
    return _words(spark, d)[1]


def bigram_dictionary(spark, d):
    docs = table(spark, d, "documents").select("doc_id", text.tokenize(F.col("text")).alias("tokens"))
    return text.dictionary(docs, text.bigrams(F.col("tokens")))


def digitized(spark, d):
    docs, words = _words(spark, d)
    return text.digitize(docs, "doc_id", F.col("tokens"), words)


def _classes(spark, d):
    docs, words = _words(spark, d)
    bags = materialise(text.digitize(docs, "doc_id", F.col("tokens"), words), "bags")  # read several times below
    labels = table(spark, d, "labels")
    return bags, materialise(text.class_counts(bags, labels, "doc_id", "quality"), "class-counts"), labels.groupBy("quality").agg(F.count(F.lit(1)).alias("docs"))


def naive_bayes(spark, d):
    bags, counts, priors = _classes(spark, d)
    return text.naive_bayes(bags, counts, priors, "doc_id", "quality").select("doc_id", "quality", F.round("probability", 6).alias("probability"))


def bm25(spark, d):
    bags, counts, _ = _classes(spark, d)
    return text.bm25(bags, counts, "doc_id", "quality").select("doc_id", "quality", F.round("score", 6).alias("score"))


def knn(spark, d):
    e = table(spark, d, "embeddings")
    return vectors.nearest(e, e.where(F.col("vec_id") % 100 == 0), "vec_id", "embedding", 5).select("query", "neighbour", F.round("distance", 4).alias("distance"), "rank")


def class_moments(spark, d):
    m = vectors.class_moments(table(spark, d, "embeddings"), "embedding", "label")
    return m.select("label", "i", "j", "n", (F.round("sxy", 3) + 0.0).alias("sxy"))


def flat_metrics(spark, d):
    e = _events(spark, d).select((F.abs("approx") + 0.5).alias("approx"), "target")
    m = metrics.eval_flat(e, ["RMSE", "MAE", "MAPE", "MSLE", "Quantile:alpha=0.7", "Logloss"], "approx", "target")
    return m.select(*[F.round(F.col(f"`{c}`"), 6).alias(c.split(":")[0].lower()) for c in m.columns])


def loss_derivatives(spark, d):
    e = _events(spark, d).select("event_id", (F.col("approx") / 100).alias("a"), "target")
    out = ["event_id"]
    for name, key in (("RMSE", "rmse"), ("Poisson", "poisson"), ("LogCosh", "logcosh"), ("MAPE", "mape"), ("Huber", "huber"), ("Expectile", "expectile"), ("CrossEntropy", "logloss")):
        d1, d2 = losses.make_loss(name).ders(F.col("a"), F.col("target"))
        out += [(F.round(d1, 8) + 0.0).alias(f"{key}_1"), (F.round(d2.cast("double"), 8) + 0.0).alias(f"{key}_2")]
    return e.select(*out)


def _metric(name):
    def run(spark, d):
        v = ranking.group_values(_events(spark, d), name, "user_id", "approx", "target", "event_id")
        return v.select("user_id", F.round("value", 6).alias("value"))

    return run


def query_auc(spark, d):
    e = _events(spark, d).withColumn("target", (F.col("target") > 1).cast("double"))
    return ranking.group_values(e, "QueryAUC", "user_id", "approx", "target", "event_id").select("user_id", F.round("value", 6).alias("value"))


def query_rmse(spark, d):
    return _events(spark, d).select("event_id", F.round(ranking.query_rmse_der("user_id", "approx", "target") + 1e-7, 3).alias("der"))


def query_softmax(spark, d):
    e = _events(spark, d).withColumn("approx", F.col("approx") / 100)
    return e.select("event_id", F.round(ranking.query_softmax_der("user_id", "approx", "target"), 6).alias("der"))


def _pairs(e):
    """Of two rows of a group that follow each other, the one with the higher target wins."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    both = e.select("event_id", "target", F.lag("event_id").over(w).alias("other"), F.lag("target").over(w).alias("t")).where("target <> t")
    up = F.col("target") > F.col("t")
    return both.select(F.when(up, F.col("event_id")).otherwise(F.col("other")).alias("winner"), F.when(up, F.col("other")).otherwise(F.col("event_id")).alias("loser"), F.lit(1.0).alias("weight"))


def pair_logit(spark, d):
    e = _events(spark, d).withColumn("approx", F.col("approx") / 100)
    return ranking.pair_logit_ders(e, _pairs(e), "event_id", "approx").select("event_id", F.round("der", 6).alias("der"))


def broken_groups(spark, d):
    return ranking.broken_groups(table(spark, d, "events"), "user_id", "event_id")


def contiguous_groups(spark, d):
    """Groups of neighbours in the order of sparse ids: none is broken but those of every tenth user, who comes twice."""
    e = table(spark, d, "events").select((F.col("event_id") * F.col("event_id")).alias("id"), F.when(F.pmod(F.floor(F.col("event_id") / 7), F.lit(10)) == 0, F.lit(-1)).otherwise(F.floor(F.col("event_id") / 7)).alias("g"))
    return ranking.broken_groups(e, "g", "id")


def folds(spark, d):
    return sampling.kfold(table(spark, d, "customer"), "c_custkey", 4).groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.min("c_custkey").alias("lo"), F.max("c_custkey").alias("hi"))


def _dataset(spark, d):
    x = _lines(spark, d).select("row_id", *FEATURES, (F.col("l_extendedprice") / 1000).alias("y"))
    return Dataset(x, "row_id", tuple(FEATURES), label="y")


def gbt_stump(spark, d):
    """One tree of depth 1 with uniform borders: its two leaf values and weights."""
    m = GBT(iterations=1, depth=1, border_count=15, feature_border_type="Uniform", learning_rate=1.0).fit(_dataset(spark, d))
    return spark.createDataFrame([(n.weight, round(n.value, 5)) for n in m.trees[0].nodes if n.feature < 0], "weight double, value double")


def _train(policy):
    def run(spark, d):
        data = _dataset(spark, d)
        m = GBT(iterations=3, depth=3, border_count=32, learning_rate=0.3, grow_policy=policy, max_leaves=6).fit(data)
        return m.predict(data.df).select("row_id", F.round("prediction", 6).alias("prediction"))

    return run


QUERIES = {f.__name__: f for f in (
    first_split, bucket_histogram, border_scan, split_scores_l2, leaf_values, uniform_borders, median_borders, quantized, greedy_borders, exact_borders,
    class_weights, sqrt_class_weights, ordered_ctr, ordered_mean_ctr, counter_ctr, final_ctr_apply, dense_ids, cardinality, one_hot, token_dictionary,
    bigram_dictionary, digitized, naive_bayes, bm25, knn, class_moments, flat_metrics, loss_derivatives, query_auc, query_rmse, query_softmax, pair_logit,
    broken_groups, contiguous_groups, folds, gbt_stump,
)}
QUERIES |= {"ndcg": _metric("NDCG:top=10"), "dcg_exp": _metric("DCG:type=Exp"), "mrr": _metric("MRR:top=5"), "map": _metric("MAP:top=10"), "precision": _metric("PrecisionAt:top=5"), "recall": _metric("RecallAt:top=5")}
QUERIES |= {f"train_{p.lower()}": _train(p) for p in ("SymmetricTree", "Depthwise", "Lossguide", "Region")}

_EV = "e as (select event_id, user_id, round(value, 2) as approx, cast(event_id % 3 as double) as target from events)"
_RANK = _EV + """, r as (select *, row_number() over (partition by user_id order by approx desc, target, event_id) as pos,
    row_number() over (partition by user_id order by target desc, event_id) as ipos, count(*) over (partition by user_id) as size from e)"""
_H = """x as (select floor(l_quantity)::int as b0, floor(l_discount * 100 + 0.5)::int as b1, floor(l_tax * 100 + 0.5)::int as b2, l_extendedprice - avg(l_extendedprice) over () as d from lineitem),
    c as (select 0 as feature, b0 as bin, d from x union all select 1, b1, d from x union all select 2, b2, d from x),
    h as (select 0 as leaf, feature, bin, sum(d) as der, count(*)::double as weight from c group by 2, 3),
    s as (select leaf, feature, bin as border, sum(der) over w as left_der, sum(weight) over w as left_weight, sum(der) over (partition by feature) as d, sum(weight) over (partition by feature) as n,
          max(bin) over (partition by feature) as top from h window w as (partition by feature order by bin)),
    z as (select *, d - left_der as right_der, n - left_weight as right_weight from s where border < top)"""
_TOK = r"""t as (select doc_id, unnest(list_filter(string_split(coalesce(text, ''), ' '), lambda x: x <> '')) as raw, generate_subscripts(list_filter(string_split(coalesce(text, ''), ' '), lambda x: x <> ''), 1) as pos from documents),
    k as (select doc_id, pos, lower(raw) as token from t)"""
_DICT = _TOK + """, w as (select token, n, row_number() over (order by n desc, token) - 1 as id from (select token, count(*) as n from k group by 1 having count(*) >= 5 order by 2 desc, 1 limit 50000)),
    bag as (select doc_id, id, count(*) as count from k join w using (token) group by 1, 2)"""
_NB = _DICT + """, cc as (select quality, id, sum(count) as n from bag join labels using (doc_id) group by 1, 2)"""
_ORD = "o as (select *, (o_orderstatus = 'F')::int as t from orders)"

ORACLE_SQL = {
    "first_split": f"with {_H} select feature, border, round((left_der*left_der/(left_weight+3) + right_der*right_der/(right_weight+3)) / sqrt(1e-100 + power(left_der/(left_weight+3),2)*left_weight + power(right_der/(right_weight+3),2)*right_weight), 2) as score from z order by 3 desc, 1, 2 limit 1",
    "bucket_histogram": f"with {_H} select leaf, feature, bin, round(der, 1) as der, weight from h",
    "border_scan": f"with {_H} select leaf, feature, border, round(left_der, 1) as left_der, left_weight, right_weight from z",
    "split_scores_l2": f"with {_H} select feature, border, round((left_der*left_der/(left_weight+3) + right_der*right_der/(right_weight+3)) / 1e6, 1) as score from z",
    "leaf_values": "select o_orderstatus as leaf, round(sum(o_totalprice) / (count(*) + 3), 4) as gradient, round(sum(o_totalprice) / (count(*) + 3), 4) as newton from orders group by 1",
    "uniform_borders": """with v as (select 'l_quantity' as feature, l_quantity::float as v from lineitem union all select 'l_extendedprice', l_extendedprice::float from lineitem),
        m as (select feature, min(v) as lo, max(v) as hi from v group by 1) select feature, round((lo + i::float * (hi - lo) / 8::float)::float::double, 2) as border from m, (select unnest(range(1, 8)) as i)""",
    "median_borders": """with v as (select 'l_quantity' as feature, l_quantity::float as v from lineitem union all select 'l_tax', l_tax::float from lineitem),
        r as (select feature, v, row_number() over (partition by feature order by v) - 1 as rank, count(*) over (partition by feature) as n, min(v) over (partition by feature) as lo from v),
        p as (select feature, v from r join (select unnest(range(1, 9)) as i) q on r.rank = least(q.i * r.n // 9, r.n - 1) where v > lo)
        select distinct feature, round((((select max(b.v) from r b where b.feature = p.feature and b.v < p.v) + p.v) / 2::float)::float::double, 4) as border from (select distinct * from p) p""",
    "quantized": """select l_orderkey * 10 + l_linenumber as row_id, (l_quantity::float > 10)::int + (l_quantity::float > 20)::int + (l_quantity::float > 30)::int as l_quantity_bin,
        (l_tax::float > 0.02::float)::int + (l_tax::float > 0.05::float)::int as l_tax_bin from lineitem""",
    "class_weights": "select o_orderstatus, round(max(count(*)) over () / count(*), 9) as class_weight from orders group by 1",
    "sqrt_class_weights": "select o_orderstatus, round(sqrt(max(count(*)) over () / count(*)), 9) as class_weight from orders group by 1",
    "ordered_ctr": f"with {_ORD} select o_orderkey, round((coalesce(sum(t) over w, 0) + 0.5::double) / (count(*) over w + 1), 9) as ctr from o window w as (partition by o_orderpriority order by o_orderkey rows between unbounded preceding and 1 preceding)",
    "ordered_mean_ctr": f"with {_ORD} select o_orderkey, round(coalesce(sum(t) over w, 0)::double / (count(*) over w + 1), 9) as ctr from o window w as (partition by o_orderpriority, o_orderstatus order by o_orderkey rows between unbounded preceding and 1 preceding)",
    "counter_ctr": "select o_orderpriority, round(count(*) / (max(count(*)) over () + 1), 9) as ctr from orders group by 1",
    "final_ctr_apply": f"with {_ORD}, c as (select o_custkey, count(*) as n, sum(t) as g from o group by 1) select o_orderkey, round((coalesce(g, 0) + 0.5::double) / (coalesce(n, 0) + 1), 9) as ctr from o left join c using (o_custkey)",
    "dense_ids": "select value, row_number() over (order by first_key, value) - 1 as id from (select o_orderpriority as value, min(o_orderkey) as first_key from orders group by 1)",
    "cardinality": "select count(distinct o_orderpriority) as priorities, count(distinct o_orderstatus) as states from orders",
    "one_hot": "select o_orderkey, (o_orderstatus = 'F')::int as is_f, (o_orderstatus = 'O')::int as is_o from orders",
    "token_dictionary": f"with {_DICT} select token, n, id from w",
    "bigram_dictionary": f"""with {_TOK}, b as (select a.token || ' ' || c.token as token from k a join k c on a.doc_id = c.doc_id and c.pos = a.pos + 1)
        select token, n, row_number() over (order by n desc, token) - 1 as id from (select token, count(*) as n from b group by 1 having count(*) >= 5 order by 2 desc, 1 limit 50000)""",
    "digitized": f"with {_DICT} select doc_id, id, count from bag",
    "naive_bayes": f"""with {_NB}, a as (select quality, sum(n) as total, (select count(distinct id) from cc) as words from cc group by 1),
        p as (select quality, ln(count(*) / sum(count(*)) over ()) as base from labels group by 1), len as (select doc_id, sum(count) as len from bag group by 1),
        g as (select doc_id, quality, sum(count * ln((n + 0.5::double) / 0.5)) as gain from bag join cc using (id) group by 1, 2),
        s as (select l.doc_id, a.quality, base + len * ln(0.5::double / (total + 0.5 * words)) + coalesce(gain, 0) as s from len l cross join a join p using (quality) left join g on g.doc_id = l.doc_id and g.quality = a.quality)
        select doc_id, quality, round(exp(s - max(s) over w) / sum(exp(s - m)) over w, 6) as probability from (select *, max(s) over (partition by doc_id) as m from s) window w as (partition by doc_id)""",
    "bm25": f"""with {_NB}, l as (select quality, sum(n) + 1 as len from cc group by 1), m as (select avg(len) as mean, count(*) as classes from l),
        f as (select id, greatest(ln((classes - df + 0.5::double) / (df + 0.5::double)), 0.001) as idf from (select id, count(*) as df from cc group by 1), m),
        v as (select quality, id, idf * n * 2.5::double / (n + 1.5::double * (0.25 + 0.75::double * len / mean)) as value from cc join f using (id) join l using (quality), m)
        select doc_id, quality, round(sum(value), 6) as score from bag join v using (id) group by 1, 2""",
    "knn": """with d as (select q.vec_id as query, b.vec_id as neighbour, list_sum(list_transform(range(1, len(b.embedding) + 1), lambda i: power(b.embedding[i]::double - q.embedding[i]::double, 2))) as distance from embeddings q, embeddings b where q.vec_id % 100 = 0)
        select query, neighbour, round(distance, 4) as distance, row_number() over (partition by query order by d.distance, neighbour) as rank from d qualify rank <= 5""",
    "class_moments": """with v as (select label, embedding as v, unnest(range(0, len(embedding))) as i from embeddings), p as (select label, i, v[i + 1]::double as x, unnest(range(0, len(v))) as j, unnest(v)::double as y from v)
        select label, i::int as i, j::int as j, count(*) as n, round(sum(x * y), 3) + 0.0 as sxy from p group by 1, 2, 3""",
    "flat_metrics": f"""with {_EV}, f as (select abs(approx) + 0.5 as a, target as t from e) select round(sqrt(avg((a - t) * (a - t))), 6) as rmse, round(avg(abs(a - t)), 6) as mae, round(avg(abs(a - t) / greatest(1, abs(t))), 6) as mape,
        round(avg(power(ln(1 + a) - ln(1 + t), 2)), 6) as msle, round(avg(case when t > a then 0.7 * (t - a) else -0.3 * (t - a) end), 6) as quantile,
        round(avg(-(t * ln(p) + (1 - t) * ln(1 - p))), 6) as logloss from (select *, greatest(1e-15, least(1 - 1e-15, 1 / (1 + exp(-a)))) as p from f)""",
    "loss_derivatives": f"""with {_EV}, f as (select event_id, approx / 100 as a, target as t from e), g as (select *, t - a as r, 1 - 1 / (1 + exp(a)) as p from f)
        select event_id, round(r, 8) + 0.0 as rmse_1, -1.0::double as rmse_2, round(t - exp(a), 8) + 0.0 as poisson_1, round(-exp(a), 8) + 0.0 as poisson_2, round(-tanh(a - t), 8) + 0.0 as logcosh_1, round(-1 / (cosh(a - t) * cosh(a - t)), 8) + 0.0 as logcosh_2,
        round(case when t > a then 1 else -1 end / greatest(1, abs(t)), 8) + 0.0 as mape_1, 0.0::double as mape_2, round(case when abs(r) < 1 then r else sign(r) end, 8) + 0.0 as huber_1, case when abs(r) < 1 then -1.0::double else 0.0 end as huber_2,
        round(r, 8) + 0.0 as expectile_1, -1.0::double as expectile_2, round(t - p, 8) + 0.0 as logloss_1, round(-p * (1 - p), 8) + 0.0 as logloss_2 from g""",
    "query_auc": f"""with {_EV}, f as (select user_id, approx, (target > 1)::int as t from e), p as (select a.user_id, sum(case when a.approx > b.approx then 1.0 when a.approx = b.approx then 0.5 else 0 end) / count(*) as v
        from f a join f b on a.user_id = b.user_id and a.t = 1 and b.t = 0 group by 1) select u.user_id, round(coalesce(v, 0), 6) as value from (select distinct user_id from f) u left join p using (user_id)""",
    "query_rmse": f"with {_EV} select event_id, round((target - approx) - avg(target - approx) over (partition by user_id) + 1e-7, 3) as der from e",
    "query_softmax": f"""with {_EV}, x as (select event_id, user_id, target, exp(approx / 100 - max(approx / 100) over (partition by user_id)) as z from e)
        select event_id, round(case when sum(target) over w > 0 then target - sum(target) over w * z / sum(z) over w else 0 end, 6) as der from x window w as (partition by user_id)""",
    "pair_logit": f"""with {_EV}, l as (select *, lag(event_id) over w as other, lag(target) over w as t from e window w as (partition by user_id order by event_id)),
        p as (select case when target > t then event_id else other end as winner, case when target > t then other else event_id end as loser from l where target <> t),
        g as (select winner, loser, 1 / (1 + exp(a.approx / 100 - b.approx / 100)) as g from p join e a on a.event_id = winner join e b on b.event_id = loser)
        select event_id, round(sum(g), 6) as der from (select winner as event_id, g from g union all select loser, -g from g) group by 1""",
    "broken_groups": "with r as (select user_id, row_number() over (order by event_id) as n from events) select user_id from r group by 1 having max(n) - min(n) + 1 <> count(*)",
    "contiguous_groups": """with e as (select event_id * event_id as id, case when (event_id // 7) % 10 = 0 then -1 else event_id // 7 end as g from events), r as (select g, row_number() over (order by id) as n from e)
        select g from r group by 1 having max(n) - min(n) + 1 <> count(*)""",
    "folds": """with f as (select c_custkey, row_number() over (order by c_custkey) - 1 as p, count(*) over () // 4 as s, count(*) over () % 4 as x from customer)
        select (case when p < x * (s + 1) then p // (s + 1) else x + (p - x * (s + 1)) // s end)::int as fold, count(*) as n, min(c_custkey) as lo, max(c_custkey) as hi from f group by 1""",
    "gbt_stump": """with v as (select 'l_discount' as f, 1 as k, l_discount::float as v, l_extendedprice / 1000 as y from lineitem union all select 'l_quantity', 0, l_quantity::float, l_extendedprice / 1000 from lineitem union all select 'l_tax', 2, l_tax::float, l_extendedprice / 1000 from lineitem),
        m as (select f, k, min(v) as lo, max(v) as hi, avg(y) as mean from v group by 1, 2), b as (select f, k, mean, (lo + i::float * (hi - lo) / 16::float)::float as b from m, (select unnest(range(1, 16)) as i)),
        s as (select k, b, sum(case when v <= b then y - mean else 0 end) as ld, count(*) filter (v <= b)::double as lw, sum(case when v > b then y - mean else 0 end) as rd, count(*) filter (v > b)::double as rw from v join b using (f, k) group by 1, 2),
        t as (select *, (ld * ld / (lw + 3) + rd * rd / (rw + 3)) / sqrt(1e-100 + power(ld / (lw + 3), 2) * lw + power(rd / (rw + 3), 2) * rw) as score from s where lw > 0 and rw > 0 order by score desc, k, b limit 1)
        select lw as weight, round(ld / (lw + 3), 5) as value from t union all select rw, round(rd / (rw + 3), 5) from t""",
    "ndcg": f"with {_RANK} select user_id, round(case when i > 0 then d / i else 1 end, 6) as value from (select user_id, sum(case when pos <= 10 then target / log2(pos + 1) else 0 end) as d, sum(case when ipos <= 10 then target / log2(ipos + 1) else 0 end) as i from r group by 1)",
    "dcg_exp": f"with {_RANK} select user_id, round(sum((power(2, target) - 1) / log2(pos + 1)), 6) as value from r group by 1",
    "mrr": f"with {_RANK} select user_id, round(coalesce(max(case when pos <= 5 and target > 0.5 then 1.0::double / pos end), 0), 6) as value from r group by 1",
    "map": f"""with {_RANK}, q as (select *, sum((target > 0.5)::int) over (partition by user_id order by pos) as hits from r)
        select user_id, round(case when min(least(size, 10)) > 0 and sum((target > 0.5)::int) > 0 then sum(case when pos <= 10 and target > 0.5 then hits::double / pos else 0 end) / least(sum((target > 0.5)::int), min(least(size, 10))) else 0 end, 6) as value from q group by 1""",
    "precision": f"with {_RANK} select user_id, round(sum((pos <= 5 and target > 0.5)::int)::double / min(least(size, 5)), 6) as value from r group by 1",
    "recall": f"with {_RANK} select user_id, round(case when sum((target > 0.5)::int) > 0 then sum((pos <= 5 and target > 0.5)::int)::double / sum((target > 0.5)::int) else 1 end, 6) as value from r group by 1",
}
