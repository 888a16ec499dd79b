"""Borders of numeric features and the bins between them."""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

#: 32-bit extremes that stand for missing values as a border.
F32_MIN, F32_MAX = float(np.finfo(np.float32).min), float(np.finfo(np.float32).max)


def long_form(df: DataFrame, features: list[str]) -> DataFrame:
    """(feature, value) rows, values as float, without null and NaN."""
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("float").alias("value")) for f in features]))
    out = df.select(pairs.alias("x")).select("x.feature", "x.value")
    return out.where(F.col("value").isNotNull() & ~F.isnan("value"))


def uniform_borders(df: DataFrame, features: list[str], count: int) -> DataFrame:
    """(feature, border): count borders evenly between minimum and maximum; none for a constant."""
    span = long_form(df, features).groupBy("feature").agg(F.min("value").alias("lo"), F.max("value").alias("hi")).where("lo < hi")
    return span.select("feature", F.explode(F.sequence(F.lit(1), F.lit(count))).alias("i"), "lo", "hi").select("feature", (F.col("lo") + (F.col("i").cast("float") * (F.col("hi") - F.col("lo")) / F.lit(count + 1).cast("float"))).cast("float").alias("border")).distinct()


def value_counts(df: DataFrame, features: list[str], blocks: int = 64) -> DataFrame:
    """(feature, value, n, upto, before, total): distinct values with counts, cumulated counts and the value before.

    Sums and largest values of blocks between quantiles come first, so only the distinct values of one block are in order in a task.
    """
    own = df.select(*[F.col(f).cast("float").cast("double").alias(f) for f in features])
    own = own.select(*[F.when(~F.isnan(f), F.col(f)).alias(f) for f in features])
    edges = own.approxQuantile(features, [i / blocks for i in range(1, blocks)], 0.2 / blocks)
    c = long_form(df, features).groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"))
    block = F.lit(0)
    for f, e in zip(features, edges, strict=True):
        if e:
            block = F.when(F.col("feature") == f, F.size(F.filter(F.array(*[F.lit(v) for v in sorted(set(e))]), lambda x: x < F.col("value").cast("double")))).otherwise(block)
    c = c.withColumn("block", block)
    whole = c.groupBy("feature", "block").agg(F.sum("n").alias("n"), F.max("value").alias("top"))  # at most ``blocks`` rows a feature
    earlier = Window.partitionBy("feature").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    whole = whole.select("feature", "block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("pre"), F.max("top").over(earlier).alias("last"), F.sum("n").over(Window.partitionBy("feature")).alias("total"))
    w = Window.partitionBy("feature", "block").orderBy("value")
    return c.join(whole, ["feature", "block"]).select("feature", "value", "n", (F.col("pre") + F.sum("n").over(w)).alias("upto"), F.coalesce(F.lag("value").over(w), F.col("last")).alias("before"), "total")


def median_borders(df: DataFrame, features: list[str], count: int) -> DataFrame:
    """Equal-frequency borders: halfway between the value at each wanted rank and the one before it."""
    v = value_counts(df, features)
    ranks = v.select("feature", "total").distinct().select("feature", F.explode(F.transform(F.sequence(F.lit(1), F.lit(count)), lambda i: F.least(F.floor(i * F.col("total") / F.lit(count + 1)), F.col("total") - 1))).alias("rank"))
    at = v.join(ranks, "feature").where((F.col("rank") < F.col("upto")) & (F.col("rank") >= F.col("upto") - F.col("n")) & F.col("before").isNotNull())
    return at.select("feature", ((F.col("before") + F.col("value")) / F.lit(2.0).cast("float")).cast("float").alias("border")).distinct()


def uniform_and_quantile_borders(df: DataFrame, features: list[str], count: int) -> DataFrame:
    return median_borders(df, features, count - count // 2).unionByName(uniform_borders(df, features, count // 2)).distinct()


def _penalty(kind: str, w: np.ndarray) -> np.ndarray:
    w = np.asarray(w, dtype=float)
    return -np.log(w + 1e-8) if kind == "log" else w * np.log(w + 1e-8)


def greedy_splits(values: np.ndarray, counts: np.ndarray, borders: int, kind: str) -> list[float]:
    """Split the bin whose cut lowers the total penalty most, until there are enough; equal gains: the older bin.

    A bin is cut before or after the value of its middle row, whichever gains more, before on a tie.
    """
    upto = np.concatenate([[0], np.cumsum(counts)])

    def best(lo: int, hi: int):
        if hi - lo < 2:
            return None
        i = int(np.searchsorted(upto, upto[lo] + (upto[hi] - upto[lo]) // 2, side="right")) - 1
        cuts = [c for c in (i, i + 1) if lo < c < hi]
        own = _penalty(kind, upto[hi] - upto[lo])
        gains = sorted((own - _penalty(kind, upto[c] - upto[lo]) - _penalty(kind, upto[hi] - upto[c]), -c) for c in cuts)
        return (-float(gains[-1][0]), -gains[-1][1]) if gains else None

    heap, age, out = [], 0, []
    if (b := best(0, len(values))) is not None:
        heapq.heappush(heap, (b[0], age, 0, len(values), b[1]))
    while heap and len(out) < borders:
        _, _, lo, hi, cut = heapq.heappop(heap)
        out.append((values[cut - 1] + values[cut]) / 2)
        for a, z in ((lo, cut), (cut, hi)):
            age += 1
            if (b := best(a, z)) is not None:
                heapq.heappush(heap, (b[0], age, a, z, b[1]))
    return sorted(out)


def exact_splits(values: np.ndarray, counts: np.ndarray, borders: int, kind: str) -> list[float]:
    """The cut set of least total penalty, by dynamic programming over distinct values.

    Both penalties are convex in a bin's weight, so the best last cut moves right with the end of the last bin; a layer
    halves its ends and looks only between the cuts of its neighbours.
    """
    n, bins = len(values), min(borders + 1, len(values))
    upto = np.concatenate([[0], np.cumsum(counts)])
    cost = np.full(n + 1, math.inf)
    cost[1:] = _penalty(kind, upto[1:])
    back = []
    for _ in range(bins - 1):
        new, via = np.full(n + 1, math.inf), np.zeros(n + 1, dtype=int)
        stack = [(1, n, 0, n - 1)]
        while stack:
            lo, hi, first, last = stack.pop()
            if lo > hi:
                continue
            j = (lo + hi) // 2
            stop = min(j - 1, last)
            c = cost[first : stop + 1] + _penalty(kind, upto[j] - upto[first : stop + 1])
            at = int(np.argmin(c)) if len(c) else 0
            via[j], new[j] = first + at, c[at] if len(c) else math.inf
            known = np.isfinite(new[j])  # ends that no cut reaches yet say nothing about their neighbours
            stack += [(lo, j - 1, first, via[j] if known else last), (j + 1, hi, via[j] if known else first, last)]
        back.append(via)
        cost = new
    cuts, j = [], n
    for via in reversed(back):
        j = via[j]
        cuts.append(j)
    return sorted({(values[c - 1] + values[c]) / 2 for c in cuts if 0 < c < n})


def penalty_borders(df: DataFrame, features: list[str], count: int, strategy: str = "GreedyLogSum") -> DataFrame:
    """GreedyLogSum, GreedyMinEntropy, MaxLogSum or MinEntropy borders.

    A heap or a table over one feature's distinct values is sequential, so a feature is one
    group; what reaches it are distinct values with counts, not rows.
    """
    kind, pick = ("log" if "LogSum" in strategy else "entropy"), greedy_splits if strategy.startswith("Greedy") else exact_splits

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("value")
        b = pick(pdf["value"].to_numpy(dtype=float), pdf["n"].to_numpy(), count, kind)
        return pd.DataFrame({"feature": [pdf["feature"].iloc[0]] * len(b), "border": np.array(b, dtype=np.float32)})

    counts = long_form(df, features).groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("feature").applyInPandas(run, "feature string, border float").distinct()


STRATEGIES = {"Uniform": uniform_borders, "Median": median_borders, "UniformAndQuantiles": uniform_and_quantile_borders}


def select_borders(df: DataFrame, features: list[str], count: int = 254, strategy: str = "GreedyLogSum", nan_mode: str = "Min", sample_rows: int = 200_000, row_id: str | None = None) -> dict[str, list[float]]:
    """Borders of every feature, sorted; a feature with missing values spends one on them (not in mode Forbidden).

    Tables of more than ``sample_rows`` rows are sampled by a hash of the row id (or of the values); missing values are looked for in all rows.
    """
    if nan_mode not in ("Min", "Max", "Forbidden"):
        raise ValueError(f"unknown NaN mode {nan_mode!r}")
    own = df.select(*([row_id] if row_id else []), *features)
    found = own.agg(F.count(F.lit(1)), *[F.max((F.col(f).isNull() | F.isnan(F.col(f).cast("double"))).cast("int")) for f in features]).collect()[0]
    n, missing = found[0], dict(zip(features, found[1:], strict=True))
    if n > sample_rows:
        own = own.where(F.pmod(F.xxhash64(*([row_id] if row_id else features)), F.lit(1 << 20)) < int((1 << 20) * sample_rows / n))
    if nan_mode == "Forbidden" and any(missing[f] for f in features):
        raise ValueError("missing values are forbidden: " + ", ".join(f for f in features if missing[f]))
    out: dict[str, list[float]] = {f: [] for f in features}
    for spend in (0, 1):
        group = [f for f in features if (missing[f] or 0) == spend]
        if group:
            found = STRATEGIES[strategy](own, group, count - spend) if strategy in STRATEGIES else penalty_borders(own, group, count - spend, strategy)
            for r in found.toLocalIterator():
                out[r["feature"]].append(r["border"] + 0.0)
    for f in features:
        out[f] = sorted(set(out[f]))
        if missing[f]:
            out[f] = [F32_MIN, *out[f]] if nan_mode == "Min" else [*out[f], F32_MAX]
    return out


def bin_of(x: Column, borders: list[float]) -> Column:
    """How many borders are strictly below the value, in 32-bit floats; missing: the bin of the sentinel, or 0."""
    v = x.cast("float")
    top = len(borders) if borders and borders[-1] == F32_MAX else 0
    values = F.array(*[F.lit(b).cast("float") for b in borders]) if borders else F.array().cast("array<float>")
    return F.when(v.isNull() | F.isnan(v), F.lit(top)).otherwise(F.size(F.filter(values, lambda b: b < v))).cast("int")


def quantize(df: DataFrame, borders: dict[str, list[float]], suffix: str = "_bin") -> DataFrame:
    return df.withColumns({f + suffix: bin_of(F.col(f), b) for f, b in borders.items()})
