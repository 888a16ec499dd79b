"""Application of large models over batches."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from sylva.plans import model
from sylva.plans.model import Model, Node, Tree


def _trees(rng, n, values=float):
    made = []
    for _ in range(n):
        f, g = rng.integers(0, 3, 2)
        a, b = (float(np.float32(v)) for v in rng.choice([-0.5, 0.1, 0.7], 2))
        leaf = lambda: Node(value=values(rng.standard_normal()))
        made.append(Tree([Node(int(f), a, 1, 2), leaf(), Node(int(g), b, 3, 4, missing_right=bool(rng.integers(2))), leaf(), leaf()]))
    return made


def test_rows_that_no_border_tells_apart_are_one(monkeypatch):
    rng = np.random.default_rng(3)
    trees = _trees(rng, 40)
    x = rng.choice(np.array([-0.5, 0.1, 0.7, 2.0, np.nan, np.inf, -np.inf, -0.0, 0.0], np.float32), (3000, 3))
    rows, which = model.alike(trees, x)
    assert len(rows) <= 5**3
    for t in trees:
        assert (t.leaf_of(rows)[which] == t.leaf_of(x)).all()
    for some in (x[:0], x[:1], rng.standard_normal((50, 3)).astype(np.float32)):
        rows, which = model.alike(trees, some)
        assert all((t.leaf_of(rows)[which] == t.leaf_of(some)).all() for t in trees)


def test_large_models_equal_a_walk(spark):
    rng = np.random.default_rng(4)
    x = [(i, *(None if rng.random() < 0.1 else float(v) for v in rng.choice([-0.5, 0.1, 0.3, 0.7, 0.9], 3))) for i in range(300)]
    df = spark.createDataFrame(x, "row_id long, a double, b double, c double")
    m = np.array([[np.nan if v is None else v for v in r[1:]] for r in x], np.float32)
    one = Model(["a", "b", "c"], _trees(rng, 450), 0.25)
    plain = 0.25 + sum(np.array([n.value for n in t.nodes])[t.leaf_of(m)] for t in one.trees)
    got = dict(one.predict(df).select("row_id", "prediction").collect())
    assert np.allclose([got[i] for i in range(300)], plain, rtol=0, atol=1e-9)
    two = Model(["a", "b", "c"], _trees(rng, 450, lambda v: [float(v), float(-2 * v)]), [0.5, -0.5], "Softmax")
    plain = np.array([0.5, -0.5]) + sum(np.array([n.value if n.feature < 0 else [0.0, 0.0] for n in t.nodes])[t.leaf_of(m)] for t in two.trees)
    got = dict(two.predict(df).select("row_id", F.col("prediction")).collect())
    assert np.allclose([got[i] for i in range(300)], plain, rtol=0, atol=1e-9)
