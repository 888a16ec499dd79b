"""Categorical encodings: dense ids, class weights, ordered and whole-table target statistics."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window, functions as F

from sylva.plans.model import Ctr, category
from sylva.sources.store import materialise

#: Blocks of a history: what lies before a block is one row a category and block.
BLOCKS = 256


def dense_ids(df: DataFrame, col: str, order: str) -> DataFrame:
    """(value, id): ids by first appearance; distinct values are numbered by blocks, not in one task."""
    from sylva.operators.sampling import row_numbers

    first = df.groupBy(F.col(col).alias("value")).agg(F.min(order).alias("at"))
    return row_numbers(first, "at", out="id").select("value", "id")


def route(cardinality: int, one_hot_max_size: int = 2) -> str:
    return "Skip" if cardinality <= 1 else "OneHot" if cardinality <= one_hot_max_size else "Ctr"


def cardinalities(df: DataFrame, cols: list[str]) -> dict[str, int]:
    return df.agg(*[F.count_distinct(c).alias(c) for c in cols]).collect()[0].asDict()


def class_weights(df: DataFrame, label: str, weight: Column | None = None, kind: str = "Balanced") -> DataFrame:
    """(label, class_weight): largest class weight over own; SqrtBalanced is its root; an empty class gets 1."""
    s = df.groupBy(label).agg(F.sum(weight if weight is not None else F.lit(1.0)).alias("w"))
    top = s.agg(F.max("w").alias("top"))
    ratio = F.when(F.col("w") > 1e-8, F.col("top") / F.col("w")).otherwise(1.0)
    return s.join(F.broadcast(top)).select(label, (F.sqrt(ratio) if kind == "SqrtBalanced" else ratio).alias("class_weight"))


def ordered_class_ctr(df: DataFrame, cat: str | list[str], target: str, order: str | list[str], border: float = 0.5, prior: float = 0.5, kind: str = "Borders", history: str | None = None) -> Column:
    """The target statistic of the rows before each row: (good + prior) / (total + 1)."""
    cats, orders = ([cat] if isinstance(cat, str) else cat), ([order] if isinstance(order, str) else order)
    w = Window.partitionBy(*([history] if history else []), *cats).orderBy(*orders).rowsBetween(Window.unboundedPreceding, -1)
    t = F.col(target)
    hit = (t > border) if kind == "Borders" else (t == border) if kind == "Buckets" else None
    good = F.sum(hit.cast("double") if hit is not None else t.cast("double")).over(w)
    return (F.coalesce(good, F.lit(0.0)) + prior) / (F.count(F.lit(1)).over(w) + 1.0)


def block_of(df: DataFrame, order: str, blocks: int = BLOCKS) -> Column:
    """The block of an ordered column: between quantiles of it, so blocks are even and rise with the order."""
    edges = sorted(set(df.select(F.col(order).cast("double").alias("o")).approxQuantile("o", [i / blocks for i in range(1, blocks)], 0.2 / blocks)))
    if not edges:
        return F.lit(0)
    return F.size(F.filter(F.array(*[F.lit(e) for e in edges]), lambda e: e < F.col(order).cast("double")))


def prefix_sums(df: DataFrame, keys: list[str], block: Column, order: list[str], sums: dict[str, Column]) -> DataFrame:
    """``df`` with, for each name, the sum over the rows of the same keys that come before in the order, 0 for the first.

    Rows before a block are summed as one row a key and block; only within a block rows are in order. So a key that
    holds a third of all rows is spread over the blocks.
    """
    x = df.withColumn("__block", block).withColumns({f"__v_{n}": c for n, c in sums.items()})
    whole = x.groupBy(*keys, "__block").agg(*[F.sum(f"__v_{n}").alias(f"__b_{n}") for n in sums])
    before = Window.partitionBy(*keys).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    whole = whole.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col("__block").alias("__at"), *[F.coalesce(F.sum(f"__b_{n}").over(before), F.lit(0)).alias(f"__p_{n}") for n in sums])
    same = F.col("__block") == F.col("__at")
    for i, k in enumerate(keys):
        same = same & x[k].eqNullSafe(whole[f"__k{i}"])
    inside = Window.partitionBy(*keys, "__block").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = x.join(whole, same).withColumns({n: F.col(f"__p_{n}") + F.coalesce(F.sum(f"__v_{n}").over(inside), F.lit(0)) for n in sums})
    return out.select(*df.columns, *sums)


def ordered_ctr(df: DataFrame, cats: list[str], target: str, order: str, border: float = 0.5, prior: float = 0.5, kind: str = "Borders", out: str = "ctr", blocks: int = BLOCKS) -> DataFrame:
    """``df`` with the target statistic of the rows before each row: (good + prior) / (total + 1)."""
    t = F.col(target)
    hit = (t > border).cast("double") if kind == "Borders" else (t == border).cast("double") if kind == "Buckets" else t.cast("double")
    got = prefix_sums(df, cats, block_of(df, order, blocks), [order], {"__good": F.coalesce(hit, F.lit(0.0)), "__total": F.lit(1.0)})
    return got.withColumn(out, (F.col("__good") + prior) / (F.col("__total") + 1.0)).drop("__good", "__total")


def online_ctr(df: DataFrame, cats: list[str], label: str, bound: float, kind: str, priors: list[float], bins: int, row_id: str, seed: int | None) -> tuple[DataFrame, list[Ctr]]:
    """``df`` with a column of bins for each prior, and the statistics that give them to new rows.

    A row's statistic is that of the rows before it in a seeded permutation (in the order of their ids without a seed),
    so its own label has no part in it; new rows take the whole table's. Counter takes the whole table's in training too.
    """
    keys = [f"__c{i}" for i in range(len(cats))]
    x = df.withColumns({k: category(c) for k, c in zip(keys, cats, strict=True)})
    hit = F.coalesce((F.col(label).cast("double") > bound).cast("double"), F.lit(0.0))
    table = materialise(x.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"), F.sum(hit).alias("good"), F.sum(hit).alias("target_sum")), "ctr")
    size, top = table.agg(F.count(F.lit(1)), F.max("total")).collect()[0]
    name = "+".join(cats)
    made = [Ctr(f"ctr:{name}:{kind}:{prior:g}", list(cats), kind, prior, bins, size, float(top or 0), table) for prior in priors]
    if kind == "Counter":
        got = x.join(table.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], "total"), [F.col(k) == F.col(f"__k{i}") for i, k in enumerate(keys)], "left")
        got = got.withColumns({c.name: c.value(F.col("total").cast("double"), F.lit(c.top)) for c in made})
        return got.select(*df.columns, *[F.col(f"`{c.name}`") for c in made]), made
    if seed is None:
        block, order = block_of(df, row_id), [row_id]
    else:
        x = x.withColumn("__order", F.xxhash64(F.lit(seed), F.col(row_id)))
        block, order = F.shiftrightunsigned("__order", 56), ["__order", row_id]
    got = prefix_sums(x, keys, block, order, {"__good": hit, "__total": F.lit(1.0)})
    got = got.withColumns({c.name: c.value(F.col("__good"), F.col("__total")) for c in made})
    return got.select(*df.columns, *[F.col(f"`{c.name}`") for c in made]), made


def class_remap(df: DataFrame, label: str) -> DataFrame:
    """(label, class): distinct labels in their order, from 0."""
    from sylva.operators.sampling import row_numbers

    return row_numbers(df.select(label).where(F.col(label).isNotNull()).distinct(), label, out="class")


def encode_labels(df: DataFrame, label: str, names: list, out: str = "label_code") -> DataFrame:
    """The place of each label among the class names; an unknown or missing label is an error when it is read."""
    code = F.coalesce(*[F.when(F.col(label).cast("string") == str(n), i) for i, n in enumerate(names)])
    return df.withColumn(out, F.coalesce(code, F.raise_error(F.concat(F.lit("unknown class label "), F.coalesce(F.col(label).cast("string"), F.lit("null")))).cast("int")))


def decode_labels(code: Column, names: list) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in names]), code.cast("int") + 1)


def model_size_weight(count: int, largest: int, reg: float) -> float:
    """What a statistic's score is multiplied by: the more keys, the less."""
    return (1 + count / largest) ** -reg if largest else 1.0


def counter_ctr(df: DataFrame, cat: str, prior: float = 0.0) -> DataFrame:
    """(cat, ctr): occurrences over the largest number of occurrences. Aggregated first: no window over rows."""
    c = df.groupBy(cat).agg(F.count(F.lit(1)).alias("n"))
    return c.join(F.broadcast(c.agg(F.max("n").alias("top")))).select(cat, ((F.col("n") + prior) / (F.col("top") + 1.0)).alias("ctr"))


def ctr_table(df: DataFrame, cats: list[str], target: str, border: float = 0.5) -> DataFrame:
    """Whole-table statistics of a (combined) category: rows, rows above the border, target sum."""
    return df.groupBy(*cats).agg(F.count(F.lit(1)).alias("total"), F.sum((F.col(target) > border).cast("long")).alias("good"), F.sum(F.col(target).cast("double")).alias("target_sum"))


def apply_ctr(df: DataFrame, table: DataFrame, cats: list[str], prior: float = 0.5, shift: float = 0.0, scale: float = 1.0, kind: str = "Borders") -> DataFrame:
    """Left join with the table; unseen categories have counts of 0. The planner broadcasts the table if it is small."""
    up = F.coalesce(F.col("good") if kind == "Borders" else F.col("target_sum"), F.lit(0))
    value = ((up + prior) / (F.coalesce("total", F.lit(0)) + 1.0) + shift) * scale
    return df.join(table, cats, "left").withColumn("ctr", value).drop("total", "good", "target_sum")


def projections(cats: list[str], max_size: int = 4) -> list[tuple[str, ...]]:
    return [c for k in range(1, max_size + 1) for c in combinations(cats, k)]


def one_hot(df: DataFrame, col: str, values: list) -> DataFrame:
    return df.withColumns({f"{col}={v}": F.coalesce(F.col(col) == F.lit(v), F.lit(False)).cast("int") for v in values})
