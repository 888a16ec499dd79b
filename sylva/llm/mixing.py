"""Mixing overlapping sources to target weights by a min-cost flow.

Documents are aggregated by membership pattern (the set of sources a document
belongs to) to one capacity each; the flow routes words from patterns to the
sources' quotas. Every arc from a pattern has one unit of its capacity per
repetition, at a convex cost (first use 0, second 1, third 2 ...), so a document
repeats only where the quota cannot be met otherwise. The flow runs on the
driver: its size is patterns times sources, bounded by ``max_arcs``, not the corpus.

Per pattern the flow gives a number of words; whole repetitions go to every
document, the rest to documents in the order of a seeded hash. The place where
the rest runs out is found in a histogram of hash buckets (a bounded number of
rows to the driver) and only the documents of one bucket per pattern are sorted, equal
rows as one with their number, so a source with a third of all rows costs no more than the others. The document
at the cut is taken in part, to the word.

Null and empty texts have size 0 and are never taken; null sources form their
own source, ordered last. Repeated rows are documents of their own. An empty table gives no rows.
Only doc_id, text, the columns of ``members`` and of ``keep`` are read, so other columns may have any name.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, Window, functions as F

from sylva.llm.common import written
from sylva.llm.quality import words_of

BUCKETS = 1024


def target_sizes(sizes: list[int], weights: list[float], cap: float = 3.0) -> list[float]:
    """Shares of all sizes by weight; what exceeds ``cap`` times a source's size goes to the others by weight until none is above."""
    out, left, total = [0.0] * len(sizes), set(range(len(sizes))), float(sum(sizes))
    while left:
        w = sum(weights[i] for i in left)
        over = [i for i in left if total * weights[i] / w > cap * sizes[i]]
        if not over:
            for i in left:
                out[i] = total * weights[i] / w
            break
        for i in over:
            out[i] = cap * sizes[i]
        total -= sum(out[i] for i in over)
        left -= set(over)
    return out


def min_cost_flow(supply: list[list[tuple[int, int]]], arcs: list[list[int]], quotas: list[int]) -> list[list[int]]:
    """Words from each pattern to each source by successive shortest paths.

    ``supply[p]`` lists (capacity, unit cost) steps with rising costs, ``arcs[p]``
    the sources of pattern p. Returns flow[p][k] for the k-th source of p.
    """
    n, m = len(supply), len(quotas)
    source, sink = n + m, n + m + 1
    graph: list[list[list[int]]] = [[] for _ in range(n + m + 2)]

    def add(a: int, b: int, cap: int, cost: int) -> None:
        graph[a].append([b, cap, cost, len(graph[b])])
        graph[b].append([a, 0, -cost, len(graph[a]) - 1])

    for p, steps in enumerate(supply):
        for cap, cost in steps:
            add(source, p, cap, cost)
    at = [[len(graph[p]) + k for k in range(len(arcs[p]))] for p in range(n)]
    for p, targets in enumerate(arcs):
        for s in targets:
            add(p, n + s, 1 << 62, 0)
    for s, q in enumerate(quotas):
        add(n + s, sink, q, 0)
    potential = [0] * len(graph)
    while True:
        dist, back = [None] * len(graph), [None] * len(graph)
        dist[source], heap = 0, [(0, source)]
        while heap:
            d, v = heapq.heappop(heap)
            if d > dist[v]:
                continue
            for k, (to, cap, cost, _) in enumerate(graph[v]):
                if cap and (dist[to] is None or d + cost + potential[v] - potential[to] < dist[to]):
                    dist[to], back[to] = d + cost + potential[v] - potential[to], (v, k)
                    heapq.heappush(heap, (dist[to], to))
        if dist[sink] is None:
            break
        for v, d in enumerate(dist):
            potential[v] += d if d is not None else 0
        push, v = 1 << 62, sink
        while v != source:
            u, k = back[v]
            push, v = min(push, graph[u][k][1]), u
        v = sink
        while v != source:
            u, k = back[v]
            graph[u][k][1] -= push
            graph[v][graph[u][k][3]][1] += push
            v = u
    return [[(1 << 62) - graph[p][k][1] for k in at[p]] for p in range(n)]


def mix(docs: DataFrame, members: Column, weights=lambda i: float(1 + i % 3), repeats: int = 3, seed: int = 11, max_arcs: int = 20_000, keep: tuple[str, ...] = ()) -> DataFrame:
    """Plan the mix of ``docs`` (doc_id, text); ``members`` is an array of source names per document (a null name is a source).

    Returns doc_id, size, members, taken (words, repeats counted), order (the
    hash) and the columns ``keep`` of every row. ``weights`` gives the weight of the i-th source by code point, null last.
    """
    key = F.xxhash64(F.lit(seed), "doc_id", F.col("text"))
    d = docs.select("doc_id", F.size(words_of(F.col("text"))).cast("long").alias("size"), F.array_sort(F.array_distinct(members)).alias("members"), key.alias("order"), *keep)
    d = written(d.withColumn("bucket", F.shiftrightunsigned("order", 54)), "mix-sizes")  # BUCKETS = 2 ** 10
    hist = d.groupBy("members", "bucket").agg(F.sum("size").alias("words"))
    pattern_words: dict[tuple, int] = {}
    for r in hist.groupBy("members").agg(F.sum("words").alias("words")).limit(max_arcs + 1).toLocalIterator():
        pattern_words[tuple(r["members"])] = r["words"]
    if len(pattern_words) > max_arcs:
        raise ValueError(f"more than max_arcs = {max_arcs} membership patterns")
    patterns = sorted(pattern_words, key=lambda p: [(x is None, (x or "").encode()) for x in p])
    names = sorted({x for p in patterns for x in p}, key=lambda x: (x is None, (x or "").encode()))
    number = {x: i for i, x in enumerate(names)}
    sizes = [0] * len(names)
    for p in patterns:
        for x in p:
            sizes[number[x]] += pattern_words[p]
    # a word in two sources counts in both sizes, so shares are of the distinct words
    whole, counted = sum(pattern_words.values()), sum(sizes)
    targets = [t * (whole / counted if counted else 0) for t in target_sizes(sizes, [weights(i) for i in range(len(names))], repeats)] if counted != whole else target_sizes(sizes, [weights(i) for i in range(len(names))], repeats)
    flow = min_cost_flow([[(pattern_words[p], c) for c in range(repeats)] for p in patterns], [[number[x] for x in p] for p in patterns], [round(t) for t in targets])
    quota = {p: sum(f) for p, f in zip(patterns, flow, strict=True)}
    plan = _cuts(d, hist, patterns, pattern_words, quota)
    out = _take(d, plan, keep)
    info = out.sparkSession.createDataFrame([(x, s, t) for x, s, t in zip(names, sizes, map(float, targets), strict=True)], "source string, source_size long, target double")
    return out, info


def _cuts(d: DataFrame, hist: DataFrame, patterns: list, words: dict, quota: dict) -> DataFrame:
    """Per pattern: whole repetitions, the bucket where the rest runs out, and the words left for that bucket.

    The histogram has at most BUCKETS rows a pattern and stays on the executors;
    one window per pattern runs over those rows.
    """
    rows = [(i, list(p), quota[p] // words[p] if words[p] else 0, quota[p] % words[p] if words[p] else 0) for i, p in enumerate(patterns)]
    plan = d.sparkSession.createDataFrame(rows, "pattern int, members array<string>, whole long, rest long")
    before = F.sum("words").over(Window.partitionBy("pattern").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    h = hist.join(F.broadcast(plan), "members").withColumn("before", F.coalesce(before, F.lit(0)))
    cut = h.where((F.col("before") <= F.col("rest")) & (F.col("rest") < F.col("before") + F.col("words")))
    return plan.join(cut.select("pattern", F.col("bucket").alias("cut"), (F.col("rest") - F.col("before")).alias("left")), "pattern", "left")


def _take(d: DataFrame, plan: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """Words taken of every document. Only the cut buckets are sorted, a thousandth of each pattern."""
    x = d.join(F.broadcast(plan), "members").withColumn("at_cut", F.coalesce(F.col("bucket") == F.col("cut"), F.lit(False)))
    base = F.col("size") * F.col("whole")
    sure = x.where(~F.col("at_cut")).withColumn("taken", base + F.when(F.coalesce(F.col("bucket") < F.col("cut"), F.lit(False)), F.col("size")).otherwise(F.lit(0).cast("long")))
    alike = ["pattern", "order", "doc_id", "size", "members", "whole", "left", *keep]
    edge = x.where("at_cut").groupBy(*alike).agg(F.count(F.lit(1)).alias("__rows"))
    run = F.coalesce(F.sum(F.col("size") * F.col("__rows")).over(Window.partitionBy("pattern").orderBy("order", "doc_id", "size", *keep).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    edge = edge.withColumn("__run", run).withColumn("__i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__rows") - 1)))
    edge = edge.withColumn("taken", base + F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), F.col("left") - F.col("__run") - F.col("size") * F.col("__i"))))
    out = ["doc_id", "size", "members", F.col("taken").cast("long").alias("taken"), "order", *keep]
    return sure.select(*out).unionByName(edge.select(*out))
