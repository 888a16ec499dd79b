"""Grouped metrics and derivatives: ranks are windows within a group, never a sort of the table."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from sylva.functions.metrics import GROUPED, parse_metric
from sylva.operators.sampling import row_numbers


def broken_groups(df: DataFrame, group: str, order: str) -> DataFrame:
    """Groups whose rows are not contiguous in row order: their numbers among all rows span more rows than they have."""
    x = row_numbers(df.select(group, order), order, out="__n")
    return x.groupBy(group).agg((F.max("__n") - F.min("__n") + 1 - F.count(F.lit(1))).alias("gap")).where("gap <> 0").select(group)


def group_ids(df: DataFrame, column: str) -> Column:
    """A column as whole, non-negative group numbers; anything else is an error when it is read."""
    v = F.col(column)
    if dict(df.dtypes)[column] in ("float", "double", "decimal"):
        v = F.when((v >= 0) & (v == F.floor(v)), v.cast("long"))
    else:
        v = F.when(v.cast("long") >= 0, v.cast("long"))
    return F.coalesce(v, F.raise_error(F.concat(F.lit(f"{column} isn't a group number: "), F.coalesce(F.col(column).cast("string"), F.lit("null")))).cast("long"))


def ranked(df: DataFrame, group: str, approx: str, target: str, row_id: str, top: int = -1) -> DataFrame:
    """Position from 1: by approx descending, on ties the lower target first, then the row id."""
    w = Window.partitionBy(group).orderBy(F.desc(approx), F.asc(target), F.asc(row_id))
    ideal = Window.partitionBy(group).orderBy(F.desc(target), F.asc(row_id))
    size = F.count(F.lit(1)).over(Window.partitionBy(group))
    out = df.withColumn("pos", F.row_number().over(w)).withColumn("ideal_pos", F.row_number().over(ideal)).withColumn("size", size)
    return out.withColumn("cut", F.when(F.lit(top) < 0, F.col("size")).otherwise(F.least(F.lit(top), F.col("size"))))


def _gain(target: str, kind: str) -> Column:
    return F.col(target) if kind == "Base" else F.power(F.lit(2.0), F.col(target)) - 1


def _discount(pos: str, kind: str) -> Column:
    return 1 / F.log2(F.col(pos) + 1) if kind == "LogPosition" else 1 / F.col(pos)


def group_values(df: DataFrame, metric: str, group: str, approx: str, target: str, row_id: str) -> DataFrame:
    """(group, value) of a grouped metric."""
    m = parse_metric(metric)
    r = ranked(df.select(group, approx, target, row_id), group, approx, target, row_id, int(m.number("top", -1)))
    seen = F.col("pos") <= F.col("cut")
    rel = F.col(target) > m.number("border", 0.5)
    if m.name in ("DCG", "NDCG"):
        gain, disc = _gain(target, m.params.get("type", "Base")), m.params.get("denominator", "LogPosition")
        dcg = F.sum(F.when(seen, gain * _discount("pos", disc)).otherwise(0.0))
        ideal = F.sum(F.when(F.col("ideal_pos") <= F.col("cut"), gain * _discount("ideal_pos", disc)).otherwise(0.0))
        return r.groupBy(group).agg((dcg if m.name == "DCG" else F.when(ideal > 0, dcg / ideal).otherwise(1.0)).alias("value"))
    if m.name in ("PrecisionAt", "RecallAt"):
        hits, all_ = F.count_if(seen & rel), F.count_if(rel)
        if m.name == "PrecisionAt":
            value = F.when(F.max("cut") > 0, hits / F.max("cut")).otherwise(0.0)
        else:
            value = F.when(F.max("cut") <= 0, 0.0).when(all_ > 0, hits / all_).otherwise(1.0)
        return r.groupBy(group).agg(value.alias("value"))
    if m.name == "MRR":
        return r.groupBy(group).agg(F.coalesce(F.max(F.when(seen & rel, 1 / F.col("pos"))), F.lit(0.0)).alias("value"))
    if m.name == "MAP":
        w = Window.partitionBy(group).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
        r = r.withColumn("hits", F.sum(rel.cast("int")).over(w))
        total, possible = F.sum(F.when(seen & rel, F.col("hits") / F.col("pos")).otherwise(0.0)), F.least(F.count_if(rel), F.max("cut"))
        return r.groupBy(group).agg(F.when(possible > 0, total / possible).otherwise(0.0).alias("value"))
    if m.name in ("PFound", "ERR"):
        # chance that the reader gets this far: a running product, as the exponential of a running sum of logarithms
        before = Window.partitionBy(group).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
        stay = F.greatest(F.lit(1e-300), 1 - F.col(target))
        reach = F.exp(F.coalesce(F.sum(F.ln(stay)).over(before), F.lit(0.0)))
        weight = F.power(F.lit(m.number("decay", 0.85)), F.col("pos") - 1) if m.name == "PFound" else 1 / F.col("pos")
        return r.withColumn("part", F.when(seen, F.col(target) * reach * weight).otherwise(0.0)).groupBy(group).agg(F.sum("part").alias("value"))
    if m.params.get("type", "Classic") == "Ranking":
        kind = df.schema[group].dataType.simpleString()
        return df.select(group, approx, target).groupBy(group).applyInPandas(lambda pdf: _ranking_auc(pdf, group, approx, target), f"{group} {kind}, value double")
    # classic, with targets between 0 and 1 as shares of a positive and a negative: by running sums, no pairs are formed
    neg, pos = F.greatest(F.lit(0.0), 1.0 - F.col(target)), F.greatest(F.lit(0.0), F.col(target).cast("double"))
    upto, same = Window.partitionBy(group).orderBy(approx), Window.partitionBy(group, approx)
    x = r.withColumn("__neg", neg).withColumn("__pos", pos)
    x = x.withColumn("__lower", F.sum("__neg").over(upto) - F.sum("__neg").over(same) / 2)
    p, n = F.sum("__pos"), F.sum("__neg")
    return x.groupBy(group).agg(F.when((p > 0) & (n > 0), F.sum(F.col("__pos") * F.col("__lower")) / F.when((p > 0) & (n > 0), p * n)).otherwise(0.0).alias("value"))


def _ranking_auc(pdf, group: str, approx: str, target: str):
    """Of the pairs with different targets, the share in the right order; equal approx counts half."""
    a, t = pdf[approx].to_numpy(dtype=float), pdf[target].to_numpy(dtype=float)
    below, right, pairs = np.zeros(0), 0.0, 0.0
    for level in np.unique(t):
        own = a[t == level]
        right += (np.searchsorted(below, own, "left") + np.searchsorted(below, own, "right")).sum() / 2
        pairs += len(own) * len(below)
        below = np.sort(np.concatenate([below, own]))
    return pd.DataFrame({group: [pdf[group].iloc[0]], "value": [right / pairs if pairs else 0.0]})


def eval_grouped(df: DataFrame, metric: str, group: str, approx: str, target: str, row_id: str, weight: str | None = None) -> DataFrame:
    """One row: the mean over groups, by mean member weight where the metric is weighted."""
    values = group_values(df, metric, group, approx, target, row_id)
    if weight is None or parse_metric(metric).name in ("MAP", "PrecisionAt", "RecallAt"):
        return values.agg(F.avg("value").alias(metric))
    w = df.groupBy(group).agg(F.avg(weight).alias("w"))
    return values.join(w, group).agg((F.sum(F.col("value") * F.col("w")) / F.sum("w")).alias(metric))


def query_rmse_der(group: str, approx: str, target: str, weight: Column | None = None) -> Column:
    """Residual less the group's weighted mean residual."""
    w, r, over = (weight if weight is not None else F.lit(1.0)), F.col(target) - F.col(approx), Window.partitionBy(group)
    return r - F.sum(w * r).over(over) / F.sum(w).over(over)


def query_softmax_der(group: str, approx: str, target: str, weight: Column | None = None, beta: float = 1.0) -> Column:
    w, over = (weight if weight is not None else F.lit(1.0)), Window.partitionBy(group)
    e = F.exp(beta * (F.col(approx) - F.max(approx).over(over)))
    mass = F.sum(w * F.col(target)).over(over)
    share = F.when(F.sum(w * e).over(over) > 0, w * e / F.sum(w * e).over(over)).otherwise(0.0)
    return F.when(mass > 0, beta * (w * F.col(target) - mass * share)).otherwise(0.0)


def pair_logit_ders(rows: DataFrame, pairs: DataFrame, row_id: str, approx: str) -> DataFrame:
    """(row_id, der): each pair (winner, loser, weight) pushes its members apart."""
    a = rows.select(F.col(row_id).alias("winner"), F.col(approx).alias("aw"))
    b = rows.select(F.col(row_id).alias("loser"), F.col(approx).alias("al"))
    p = pairs.join(a, "winner").join(b, "loser").withColumn("g", F.col("weight") / (1 + F.exp(F.col("aw") - F.col("al"))))
    both = p.select(F.explode(F.array(F.struct(F.col("winner").alias("id"), F.col("g").alias("g")), F.struct(F.col("loser").alias("id"), (-F.col("g")).alias("g")))).alias("x"))
    return both.groupBy(F.col("x.id").alias(row_id)).agg(F.sum("x.g").alias("der"))
