"""Histograms of derivatives, split scores and the best split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def bucket_histogram(df: DataFrame, features: list[str], leaf: Column, der: Column, weight: Column) -> DataFrame:
    """(leaf, feature, bin, der, weight): one aggregation for all features, combined before the shuffle."""
    cells = F.explode(F.array(*[F.struct(F.lit(i).alias("feature"), F.col(f).alias("bin")) for i, f in enumerate(features)]))
    x = df.select(leaf.alias("leaf"), (der * weight).alias("d"), weight.alias("w"), cells.alias("c"))
    return x.groupBy("leaf", "c.feature", "c.bin").agg(F.sum("d").alias("der"), F.sum("w").alias("weight"))


def leaf_stats(df: DataFrame, leaf: Column, der: Column, weight: Column, der2: Column | None = None) -> DataFrame:
    x = df.select(leaf.alias("leaf"), (der * weight).alias("d"), weight.alias("w"), ((der2 if der2 is not None else F.lit(0.0)) * weight).alias("d2"))
    return x.groupBy("leaf").agg(F.sum("d").alias("der"), F.sum("w").alias("weight"), F.sum("d2").alias("der2"))


def subtract(parent: DataFrame, child: DataFrame) -> DataFrame:
    """The sibling's histogram: parent less child, cell by cell."""
    c = child.select("feature", "bin", F.col("der").alias("cd"), F.col("weight").alias("cw"))
    return parent.join(c, ["feature", "bin"], "left").select("feature", "bin", (F.col("der") - F.coalesce("cd", F.lit(0.0))).alias("der"), (F.col("weight") - F.coalesce("cw", F.lit(0.0))).alias("weight"))


def add(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).groupBy("leaf", "feature", "bin").agg(F.sum("der").alias("der"), F.sum("weight").alias("weight"))


def scan(hist: DataFrame, borders: DataFrame | None = None) -> DataFrame:
    """(leaf, feature, border, left and right sums) for every border: the left side holds the bins up to it.

    Cells missing from a leaf are taken as empty, so that all leaves see all borders of a feature.
    """
    all_bins = borders if borders is not None else hist.select("feature", "bin").distinct()
    each = all_bins.groupBy("feature").agg(F.collect_set("bin").alias("bins"))  # at most a few hundred bins a feature
    grid = hist.select("leaf", "feature").distinct().join(F.broadcast(each), "feature").select("leaf", "feature", F.explode("bins").alias("bin"))
    full = grid.join(hist, ["leaf", "feature", "bin"], "left").fillna(0.0, ["der", "weight"])
    run = Window.partitionBy("leaf", "feature").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("leaf", "feature")
    out = full.select("leaf", "feature", F.col("bin").alias("border"), F.sum("der").over(run).alias("left_der"), F.sum("weight").over(run).alias("left_weight"), F.sum("der").over(whole).alias("d"), F.sum("weight").over(whole).alias("w"), F.max("bin").over(whole).alias("top"))
    return out.where("border < top").select("leaf", "feature", "border", "left_der", "left_weight", (F.col("d") - F.col("left_der")).alias("right_der"), (F.col("w") - F.col("left_weight")).alias("right_weight"))


def scan_one_hot(hist: DataFrame) -> DataFrame:
    """As ``scan`` for categories: the right side is one bin, the left side all others of the leaf and feature."""
    whole = hist.groupBy("leaf", "feature").agg(F.sum("der").alias("d"), F.sum("weight").alias("w"))
    x = hist.join(whole, ["leaf", "feature"])
    return x.select("leaf", "feature", F.col("bin").alias("border"), (F.col("d") - F.col("der")).alias("left_der"), (F.col("w") - F.col("weight")).alias("left_weight"), F.col("der").alias("right_der"), F.col("weight").alias("right_weight"))


def pair_weight_statistics(pairs: DataFrame, rows: DataFrame, row_id: str, bins: list[str], leaf: str) -> DataFrame:
    """(feature, winner's leaf and bin, loser's leaf and bin, weight): summed weights of pairs by where their ends lie."""
    cells = lambda side: rows.select(F.col(row_id).alias(side), F.col(leaf).alias(f"{side}_leaf"), F.array(*[F.col(b) for b in bins]).alias(f"{side}_bins"))
    x = pairs.join(cells("winner"), "winner").join(cells("loser"), "loser").select("weight", "winner_leaf", "loser_leaf", F.posexplode(F.arrays_zip("winner_bins", "loser_bins")).alias("feature", "b"))
    return x.groupBy("feature", "winner_leaf", F.col("b.winner_bins").alias("winner_bin"), "loser_leaf", F.col("b.loser_bins").alias("loser_bin")).agg(F.sum("weight").alias("weight"))


def average(der: Column, weight: Column, l2: float) -> Column:
    return F.when(weight > 0, der / (weight + l2)).otherwise(0.0)


def score_splits(scanned: DataFrame, l2: float = 3.0, score: str = "Cosine", by_leaf: bool = False) -> DataFrame:
    """(feature, border, score), summed over leaves, or also by leaf. Scores are to be maximised."""
    terms = [(average(F.col(f"{s}_der"), F.col(f"{s}_weight"), l2), F.col(f"{s}_der"), F.col(f"{s}_weight")) for s in ("left", "right")]
    up = sum((F.sum(a * d) for a, d, _ in terms), F.lit(0.0))
    down = sum((F.sum(a * a * w) for a, _, w in terms), F.lit(0.0))
    if score == "L2":
        value = up
    elif score == "Cosine":
        value = up / F.sqrt(F.lit(1e-100) + down)
    elif score == "SolarL2":
        value = sum((F.sum(F.when(w > 1e-20, d * d * (1 + 2 * F.ln(w + 1)) / w).otherwise(0.0)) for _, d, w in terms), F.lit(0.0))
    elif score == "LOOL2":
        value = sum((F.sum(F.when(w > 1, d * d * w / ((w - 1) * (w - 1))).otherwise(0.0)) for _, d, w in terms), F.lit(0.0))
    elif score == "SatL2":
        value = sum((F.sum(F.when(w > 2, d * d * (w - 2) / (w * w - 3 * w + 1)).otherwise(0.0)) for _, d, w in terms), F.lit(0.0))
    else:
        raise ValueError(f"unknown score {score!r}")
    side = [F.sum(F.col(f"{s}_weight")).alias(f"{s}_weight") for s in ("left", "right")]
    return scanned.groupBy(*(["leaf"] if by_leaf else []), "feature", "border").agg(value.alias("score"), *side)


def best_split(scores: DataFrame) -> DataFrame:
    """The highest score; on ties the first feature, then the lowest border."""
    return scores.orderBy(F.desc("score"), "feature", "border").limit(1)
