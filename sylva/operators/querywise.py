"""Derivatives of grouped losses: (row, der, der2) for every row of every group.

QueryRMSE, QuerySoftMax and pair losses are aggregations and joins, so a group may
hold any share of the rows. LambdaMart, YetiRank and StochasticRank sort a group;
there a group is one task's work, as a query's result list is.

Object weights are divided out again (``der * weight`` is the step's numerator
everywhere), so all losses look alike to the trainer.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

#: Fixed values of the method.
YETI_SCALE = 0.15
STOCHASTIC_NU, STOCHASTIC_LAMBDA = 0.01, 1.0


def query_rmse(rows: DataFrame) -> DataFrame:
    """``rows`` has row_id, group, label, weight, approx."""
    r = F.col("label") - F.col("approx")
    mean = rows.groupBy("group").agg(F.sum(F.col("weight") * r).alias("s"), F.sum("weight").alias("w")).select("group", F.when(F.col("w") > 0, F.col("s") / F.col("w")).otherwise(0.0).alias("mean"))
    return rows.join(mean, "group").select("row_id", (r - F.col("mean")).alias("der"), F.lit(-1.0).alias("der2"))


def query_softmax(rows: DataFrame, beta: float = 1.0, lambda_: float = 0.01) -> DataFrame:
    """The sums need the group's maximum, so there are two aggregations; a group without positive weighted target has no step."""
    top = rows.groupBy("group").agg(F.max("approx").alias("top"))
    x = rows.join(top, "group").withColumn("e", F.col("weight") * F.exp(beta * (F.col("approx") - F.col("top"))))
    sums = x.groupBy("group").agg(F.sum("e").alias("all"), F.sum(F.col("weight") * F.col("label")).alias("mass"))
    x = x.join(sums, "group").withColumn("p", F.when(F.col("all") > 0, F.col("e") / F.col("all")).otherwise(0.0))
    on = (F.col("mass") > 0) & (F.col("weight") > 0)
    der = beta * (F.col("label") * F.col("weight") - F.col("mass") * F.col("p")) / F.col("weight")
    der2 = beta * F.col("mass") * (beta * F.col("p") * (F.col("p") - 1) - lambda_) / F.col("weight")
    return x.select("row_id", F.when(on, der).otherwise(0.0).alias("der"), F.when(on, der2).otherwise(0.0).alias("der2"))


def pair_logit(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """``pairs`` has winner, loser (row ids) and weight."""
    own = rows.select("row_id", "approx")
    p = pairs.join(own.select(F.col("row_id").alias("winner"), F.col("approx").alias("aw")), "winner").join(own.select(F.col("row_id").alias("loser"), F.col("approx").alias("al")), "loser")
    p = p.withColumn("q", 1 / (1 + F.exp(F.col("aw") - F.col("al"))))
    both = p.select(F.explode(F.array(F.struct(F.col("winner").alias("row_id"), (F.col("weight") * F.col("q")).alias("der")), F.struct(F.col("loser").alias("row_id"), (-F.col("weight") * F.col("q")).alias("der")))).alias("x"), (F.col("weight") * F.col("q") * (F.col("q") - 1)).alias("der2"))
    sums = both.groupBy("x.row_id").agg(F.sum("x.der").alias("der"), F.sum("der2").alias("der2"))
    w = F.when(F.col("weight") > 0, F.col("weight")).otherwise(1.0)
    return rows.select("row_id", "weight").join(sums, "row_id", "left").select("row_id", (F.coalesce("der", F.lit(0.0)) / w).alias("der"), (F.coalesce("der2", F.lit(0.0)) / w).alias("der2"))


def pair_weights(rows: DataFrame, pairs: DataFrame, row_id: str = "row_id") -> DataFrame:
    """(row, pair_weight): the summed weights of the pairs a row takes part in, 0 without any."""
    ends = pairs.select(F.col("winner").alias(row_id), "weight").unionByName(pairs.select(F.col("loser").alias(row_id), "weight"))
    return rows.select(row_id).join(ends.groupBy(row_id).agg(F.sum("weight").alias("pair_weight")), row_id, "left").select(row_id, F.coalesce("pair_weight", F.lit(0.0)).alias("pair_weight"))


def _order(key: np.ndarray) -> np.ndarray:
    return np.argsort(-key, kind="stable")


def _discounts(n: int) -> np.ndarray:
    return 1.0 / np.log2(np.arange(n) + 2.0)


def lambda_mart(approx: np.ndarray, target: np.ndarray, sigma: float = 1.0, top: int = -1, norm: bool = True, metric: str = "NDCG") -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a better and a worse document push each other by what their swap changes in NDCG."""
    n = len(approx)
    der, der2 = np.zeros(n), np.zeros(n)
    if n <= 1 or metric not in ("DCG", "NDCG"):
        return der, der2
    cut = n if top < 0 or top > n else int(top)
    order = _order(approx)
    a, t, d = approx[order], target[order], _discounts(n)
    ideal = float((np.sort(target)[::-1][:cut] * d[:cut]).sum())
    total = 0.0
    out, out2 = np.zeros(n), np.zeros(n)
    for i in range(n):
        j = np.arange(n if i < cut else cut)
        j = j[t[j] < t[i]]
        if not len(j):
            continue
        gap = a[i] - a[j]
        size = (t[i] - t[j]) * np.abs(d[i] - d[j]) / ideal if ideal else np.zeros(len(j))
        if norm and a[0] != a[-1]:
            size = size / (0.01 + np.abs(gap))
        p = 1.0 / (1.0 + np.exp(sigma * gap))
        step, curve = sigma * size * p, -sigma * sigma * size * p * (1 - p)
        out[i] += step.sum()
        out2[i] += curve.sum()
        np.subtract.at(out, j, step)
        np.add.at(out2, j, curve)
        total += 2 * step.sum()
    der[order], der2[order] = out, out2
    if norm and total > 0:
        k = math.log2(1 + total) / total
        der, der2 = der * k, der2 * k
    return der, der2


def yeti_pairs(order: np.ndarray, target: np.ndarray, decay: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(winner, loser, weight) of neighbours in an order: the k-th pair counts decay to the k."""
    a, b = order[:-1], order[1:]
    diff = target[a] - target[b]
    w = YETI_SCALE * decay ** np.arange(len(a)) * np.abs(diff)
    some = diff != 0
    return np.where(diff > 0, a, b)[some], np.where(diff > 0, b, a)[some], w[some]


def yeti_rank(approx: np.ndarray, target: np.ndarray, weight: float, rng: np.random.Generator, permutations: int = 10, decay: float = 0.85) -> tuple[np.ndarray, np.ndarray]:
    """PairLogit over neighbours in orders perturbed by a logistic noise, averaged."""
    n = len(approx)
    der, der2 = np.zeros(n), np.zeros(n)
    for _ in range(int(permutations) if n > 1 else 0):
        u = rng.random(n)
        w, l, size = yeti_pairs(_order(approx + np.log(np.maximum(u, 1e-300)) - np.log(1.000001 - u)), target, decay)
        size = size * weight / permutations
        q = 1.0 / (1.0 + np.exp(approx[w] - approx[l]))
        np.add.at(der, w, size * q)
        np.subtract.at(der, l, size * q)
        for side in (w, l):
            np.add.at(der2, side, size * q * (q - 1))
    return der, der2


def stochastic_rank(approx: np.ndarray, target: np.ndarray, rng: np.random.Generator, sigma: float = 1.0, mu: float = 0.0, num_estimations: int = 1, metric: str = "NDCG") -> tuple[np.ndarray, np.ndarray]:
    """Gradient of the expected (N)DCG under normal noise: for every document, what each other place would change times the density of its borders."""
    n = len(approx)
    der = np.zeros(n)
    if n <= 1:
        return der, np.zeros(n)
    a = approx - approx.mean()
    shifted = a - sigma * mu * target
    shifted = shifted - shifted.mean()
    place = _discounts(n)
    if metric == "NDCG":
        ideal = float((np.sort(target)[::-1] * place).sum())
        place = place / ideal if ideal > np.finfo(float).eps else place
    spread = sigma * math.sqrt(n / (n - 1))
    for _ in range(max(1, int(num_estimations))):
        noise = rng.standard_normal(n)
        scores = shifted + sigma * noise
        order = _order(scores)
        g, s = target[order], scores[order]
        # moving the document at i to place j shifts those between by one place
        up = np.concatenate([[0.0], np.cumsum(g * np.concatenate([[0.0], place[:-1]]))])
        low = np.concatenate([[0.0], np.cumsum(g * np.concatenate([place[1:], [0.0]]))])
        now = np.concatenate([[0.0], np.cumsum(g * place)])
        for i in range(n):
            j = np.arange(n)
            later = j > i
            moved = np.where(later, (up[j + 1] - up[i + 1]) - (now[j + 1] - now[i + 1]), (low[i] - low[np.minimum(j, i)]) - (now[i] - now[np.minimum(j, i)]))
            diff = g[i] * (place[j] - place[i]) + moved
            mean = a[order[i]] + (noise.sum() - (s[i] - a[order[i]])) / (n - 1)
            density = np.exp(-(((s - mean) / spread) ** 2) / 2) / (spread * math.sqrt(2 * math.pi))
            # the place's upper border is the score before it, its lower border the one after (its own when it lies before i)
            above = np.where(later, density[j], np.where(j > 0, density[np.maximum(j - 1, 0)], 0.0))
            below = np.where(later, np.where(j + 1 < n, density[np.minimum(j + 1, n - 1)], 0.0), density[j])
            der[order[i]] += float(np.where(j == i, 0.0, diff * (below - above)).sum()) / max(1, int(num_estimations))
    der -= der.mean()
    if n > 2:
        z = a - a.mean()
        norm = (math.sqrt(float((z * z).sum())) + STOCHASTIC_NU) ** 2
        der = der - STOCHASTIC_LAMBDA * float((der * z).sum()) / norm * z
    return der, np.zeros(n)


def by_group(rows: DataFrame, name: str, seed: int, **params) -> DataFrame:
    """LambdaMart, YetiRank or StochasticRank over the rows of each group, in the order of their ids; seeded by group."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("row_id", kind="stable")
        a, t, w = (pdf[c].to_numpy(dtype=float) for c in ("approx", "label", "weight"))
        rng = np.random.default_rng([seed & 0xFFFFFFFF, int(pdf["hash"].iloc[0]) & 0xFFFFFFFFFFFFFFFF])
        mean = float(w.mean())
        if name == "LambdaMart":
            d, d2 = lambda_mart(a, t, **params)
        elif name == "YetiRank":
            d, d2 = yeti_rank(a, t, mean, rng, **params)
        else:
            d, d2 = stochastic_rank(a, t, rng, **params)
        k = np.where(w > 0, mean / np.where(w > 0, w, 1.0), 0.0) if name != "YetiRank" else np.where(w > 0, 1.0 / np.where(w > 0, w, 1.0), 0.0)
        return pd.DataFrame({"row_id": pdf["row_id"], "der": d * k, "der2": d2 * k})

    x = rows.select("row_id", "group", "label", "weight", "approx", F.xxhash64("group").alias("hash"))
    return x.groupBy("group").applyInPandas(run, "row_id long, der double, der2 double")


def group_derivatives(rows: DataFrame, loss, pairs: DataFrame | None, seed: int) -> DataFrame:
    """(row_id, der, der2) of a grouped loss; ``rows`` has row_id, group, label, weight, approx."""
    if loss.name == "QueryRMSE":
        return query_rmse(rows)
    if loss.name == "QuerySoftMax":
        return query_softmax(rows, **loss.params)
    if loss.name == "PairLogit":
        if pairs is None:
            raise ValueError("PairLogit needs pairs")
        return pair_logit(rows, pairs)
    if loss.name in ("LambdaMart", "YetiRank", "StochasticRank"):
        return by_group(rows, loss.name, seed, **loss.params)
    raise ValueError(f"{loss.name} needs pairwise scoring, which the trainer doesn't have")
