"""Vector features: exact nearest neighbours of a query set, and LDA projection."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F


def nearest(base: DataFrame, queries: DataFrame, row_id: str, vector: str, k: int = 5, max_bytes: int = 256 << 20, before: str | None = None) -> DataFrame:
    """(query, neighbour, distance): the k nearest by squared L2, ties by id. With ``before`` (a column of both) only rows
    whose value is less than the query's count: neighbours among what came earlier in a permutation.

    The stated query set goes to the executors in blocks of at most ``max_bytes``; every
    partition of the base keeps its own k best in numpy, and a window picks among those.
    """
    first = queries.agg(F.count(F.lit(1)).alias("n"), F.max(F.size(vector)).alias("d")).collect()[0]
    if not first["n"]:
        return base.sparkSession.createDataFrame([], "query long, neighbour long, distance double")
    blocks = max(1, -(-first["n"] * first["d"] * 8 // max_bytes))
    found = None
    for i in range(blocks):
        part = queries.where(F.pmod(F.xxhash64(row_id), F.lit(blocks)) == i).select(row_id, vector, *([F.col(before).alias("__before")] if before else [])).toPandas()
        if not len(part):
            continue
        shared = base.sparkSession.sparkContext.broadcast((part[row_id].to_numpy(), np.array(part[vector].tolist(), dtype=np.float64), part["__before"].to_numpy() if before else None))

        def run(frames, shared=shared):
            ids, q, place = shared.value
            for f in frames:
                if not len(f):
                    continue
                x, own = np.array(f.iloc[:, 1].tolist(), dtype=np.float64), f.iloc[:, 0].to_numpy()
                for j in range(len(ids)):
                    d = ((x - q[j]) ** 2).sum(axis=1)
                    if place is not None:
                        d = np.where(f.iloc[:, 2].to_numpy() < place[j], d, np.inf)
                    best = np.lexsort((own, d))[:k]
                    best = best[np.isfinite(d[best])]
                    yield pd.DataFrame({"query": ids[j], "neighbour": own[best], "distance": d[best]})

        got = base.select(row_id, vector, *([F.col(before).alias("__before")] if before else [])).mapInPandas(run, "query long, neighbour long, distance double")
        found = got if found is None else found.unionByName(got)
    w = Window.partitionBy("query").orderBy("distance", "neighbour")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def knn_votes(neighbours: DataFrame, labels: DataFrame, row_id: str, label: str) -> DataFrame:
    """(query, class, votes) for classification."""
    return neighbours.join(labels.select(F.col(row_id).alias("neighbour"), label), "neighbour").groupBy("query", label).agg(F.count(F.lit(1)).alias("votes"))


def knn_mean(neighbours: DataFrame, targets: DataFrame, row_id: str, target: str) -> DataFrame:
    """(query, mean) for regression: the mean target of the neighbours."""
    return neighbours.join(targets.select(F.col(row_id).alias("neighbour"), target), "neighbour").groupBy("query").agg(F.avg(target).alias("mean"))


def class_moments(df: DataFrame, vector: str, label: str) -> DataFrame:
    """(class, i, j, n, sums): first and second moments. A batch adds ``x.T @ x`` to its task's matrices; only those, classes x d x d numbers a task, are shuffled."""
    kind = df.schema[label].dataType.simpleString()

    def run(frames):
        sums: dict = {}
        for f in frames:
            for c, rows in f.groupby(f.columns[0], dropna=False).indices.items() if len(f) else ():
                x = np.array(f.iloc[rows, 1].tolist(), dtype=np.float64)
                n, s, q = sums.get(c, (0, 0.0, 0.0))
                sums[c] = (n + len(x), s + x.sum(axis=0), q + x.T @ x)
        for c, (n, s, q) in sums.items():
            d = len(s)
            i, j = (v.ravel() for v in np.indices((d, d)))
            yield pd.DataFrame({label: [c] * (d * d), "i": i, "j": j, "n": n, "sx": s[i], "sxy": q.ravel()})

    parts = df.where(F.col(vector).isNotNull()).select(label, vector).mapInPandas(run, f"{label} {kind}, i int, j int, n long, sx double, sxy double")
    return parts.groupBy(label, "i", "j").agg(F.sum("n").alias("n"), F.sum("sx").alias("sx"), F.sum("sxy").alias("sxy"))


def lda(df: DataFrame, vector: str, label: str, size: int = 1, reg: float = 5e-5) -> np.ndarray:
    """The directions that separate classes best; the moments (classes x d x d) come to the driver."""
    m = class_moments(df, vector, label).toPandas()
    d, within, total_n, total_x, total_xy = int(m["i"].max()) + 1, 0.0, 0, 0.0, 0.0
    for _, g in m.groupby(label):
        g = g.sort_values(["i", "j"])
        n, sx, sxy = g["n"].iloc[0], g["sx"].to_numpy().reshape(d, d)[:, 0], g["sxy"].to_numpy().reshape(d, d)
        within = within + sxy - np.outer(sx, sx) / n
        total_n, total_x, total_xy = total_n + n, total_x + sx, total_xy + sxy
    total = total_xy / total_n - np.outer(total_x, total_x) / total_n**2
    within = within / total_n + reg * np.eye(d)
    low = np.linalg.inv(np.linalg.cholesky(within))
    values, vectors = np.linalg.eigh(low @ total @ low.T)
    return (low.T @ vectors[:, ::-1][:, :size]).T
