"""Folds, permutations and bootstrap weights, all from hashes of the row id, so reruns agree."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F


def unit(row_id: str, seed: int) -> Column:
    """Uniform in (0, 1), a function of row and seed."""
    return (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(row_id)), 11).cast("double") + 0.5) / float(1 << 53)


def normal(row_id: str, seed: int) -> Column:
    return F.sqrt(-2 * F.ln(unit(row_id, seed))) * F.cos(2 * math.pi * unit(row_id, seed + 0x5BD1))


def permutation_key(row_id: str, seed: int) -> Column:
    """Order by this for a seeded permutation; no global sort is needed to have it."""
    return F.xxhash64(F.lit(seed), F.col(row_id))


def bootstrap_weight(row_id: str, kind: str = "Bayesian", seed: int = 0, subsample: float = 0.8, temperature: float = 1.0, der: Column | None = None, threshold: float | None = None) -> Column:
    u = unit(row_id, seed)
    if kind == "No":
        return F.lit(1.0)
    if kind == "Bayesian":
        return F.power(-F.ln(u), temperature)
    if kind == "Bernoulli":
        return (u < subsample).cast("double")
    if kind == "Poisson":  # inverse of the distribution function
        out, p, total = F.lit(0.0), math.exp(-1.0), 0.0
        for k in range(12):
            total += p / math.factorial(k)
            out = F.when(u > total, float(k + 1)).otherwise(out) if k else F.when(u > total, 1.0).otherwise(0.0)
        return out
    if kind == "MVS":
        chance = F.least(F.lit(1.0), F.abs(der) / threshold)
        return F.when(u < chance, 1 / chance).otherwise(0.0)
    raise ValueError(f"unknown bootstrap {kind!r}")


def row_numbers(df: DataFrame, order: str, blocks: int = 256, within: str | None = None, out: str = "number") -> DataFrame:
    """``df`` with the row's number from 0 in the order of a column (of each value of ``within``): rows are counted by
    blocks between quantiles, and put in order only inside a block, so no task holds all."""
    from sylva.operators.encoding import block_of, prefix_sums

    x = df.withColumn("__all", F.col(within) if within else F.lit(0))
    return prefix_sums(x, ["__all"], block_of(df, order, blocks), [order], {out: F.lit(1).cast("long")}).drop("__all")


def kfold(df: DataFrame, row_id: str, folds: int = 3, seed: int | None = None, group: str | None = None, stratify: str | None = None) -> DataFrame:
    """Adds ``fold``: contiguous near-equal blocks of the rows in the order of their ids, the first ones a row larger.

    With a seed the rows are ordered by a hash first; groups stay whole (blocks of groups); ``stratify`` deals the rows of each label out in turn.
    """
    if group is not None:
        keys = kfold(df.groupBy(F.col(group).alias("__group")).agg(F.min(row_id).alias("__first")), "__first", folds, seed)
        return df.join(keys.select("__group", "fold"), F.col(group).eqNullSafe(F.col("__group"))).drop("__group")
    x = df.withColumn("__order", F.col(row_id) if seed is None else F.xxhash64(F.lit(seed), F.col(row_id)))
    if stratify is not None:
        return row_numbers(x, "__order", within=stratify, out="__n").withColumn("fold", F.pmod("__n", F.lit(folds)).cast("int")).drop("__order", "__n")
    small, extra = divmod(df.count(), folds)
    head = extra * (small + 1)
    n = F.col("__n")
    fold = F.when(n < head, F.floor(n / F.lit(small + 1))).otherwise(F.lit(extra) + F.floor((n - head) / F.lit(max(small, 1))))
    return row_numbers(x, "__order", out="__n").withColumn("fold", fold.cast("int")).drop("__order", "__n")


def body_tail_boundaries(n: int, multiplier: float = 2.0) -> list[int]:
    """Ends of the growing bodies of an ordered fold: 1 (min(100, n / 50) beyond 500 rows), then ``multiplier`` times as many, up to n."""
    if n <= 0:
        return []
    out = [min(1 if n <= 500 else min(100, n // 50), n)]
    while out[-1] < n:
        nxt = min(math.ceil(out[-1] * multiplier), n)
        out.append(nxt if nxt > out[-1] else n)
    return out


def ordered_segments(df: DataFrame, row_id: str, seed: int | None, multiplier: float = 2.0) -> DataFrame:
    """``df`` with ``position`` in a seeded permutation (in the order of the ids without a seed) and ``segment``: the first body that holds the row."""
    ends = body_tail_boundaries(df.count(), multiplier)
    x = row_numbers(df.withColumn("__order", F.col(row_id) if seed is None else permutation_key(row_id, seed)), "__order", out="position").drop("__order")
    return x.withColumn("segment", F.size(F.filter(F.array(*[F.lit(e) for e in ends]), lambda e: e <= F.col("position"))) if ends else F.lit(0))


def structure_folds(permutations: int, iterations: int, seed: int) -> list[int]:
    """The learning permutation of each tree: drawn anew from all but the averaging one."""
    import random

    rng = random.Random(seed)
    return [rng.randrange(max(1, permutations - 1)) for _ in range(iterations)]


def posterior_sampling(n: int) -> tuple[float, float]:
    """(diffusion temperature, model shrink rate) for n rows."""
    return float(n), 1.0 / (2 * n)
