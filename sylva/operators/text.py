"""Text features: tokens, dictionaries, bags of words, naive Bayes and BM25 by class."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window, functions as F

from sylva.sources.store import materialise

#: Bytes up to which a table of words is sent to every executor.
BROADCAST_BYTES = 64 << 20
#: Bytes of an Arrow batch of tokens (one row may be larger).
BATCH_BYTES = 4 << 20


def tokenize(text: Column, delimiter: str = " ", lower: bool = True) -> Column:
    """Split at a literal delimiter, drop empty tokens."""
    if delimiter == " " and lower:  # a space ends the context of every case mapping, so the whole text may be lowered at once
        return F.array_remove(F.split(F.coalesce(F.lower(text), F.lit("")), " "), "")
    parts = F.split(text, re.escape(delimiter)) if delimiter else F.array(text)
    parts = F.filter(F.coalesce(parts, F.array().cast("array<string>")), lambda x: x != "")
    return F.transform(parts, lambda x: F.lower(x)) if lower else parts


def bigrams(tokens: Column) -> Column:
    n = F.size(tokens)
    return F.when(n > 1, F.zip_with(F.slice(tokens, 1, n - 1), F.slice(tokens, 2, n - 1), lambda a, b: F.concat_ws(" ", a, b))).otherwise(F.array().cast("array<string>"))


def dictionary(docs: DataFrame, tokens: Column, min_count: int = 5, limit: int = 50_000, start: int = 0) -> DataFrame:
    """(token, n, id): tokens of enough occurrences, most frequent first. The limit is the dictionary's size, a parameter."""
    counts = docs.select(F.explode(tokens).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count)
    top = counts.orderBy(F.desc("n"), "token").limit(limit)
    return top.select("token", "n", (F.row_number().over(Window.orderBy(F.desc("n"), "token")) - 1 + start).alias("id"))


def _sent_rows(rows: DataFrame) -> DataFrame:
    """Numbers of words and classes, computed once and sent to the executors if there are few: a frequent word is in every document, so a shuffle by word is uneven."""
    rows = materialise(rows, "word-values")
    return F.broadcast(rows) if rows.count() * 64 <= BROADCAST_BYTES else rows


def _vocabulary(words: DataFrame) -> tuple[DataFrame, Broadcast | None]:
    """(token, id), computed once; tokens and ids as arrays for the tasks, if they are small and no token comes twice."""
    spark = words.sparkSession
    words = materialise(words.select("token", "id"), "dictionary")
    size, n, different = words.agg(F.sum(F.octet_length("token") + 48), F.count("token"), F.count_distinct("token")).collect()[0]
    if (size or 0) > BROADCAST_BYTES or n != different:
        return words, None
    rows = words.collect()
    return words, spark.sparkContext.broadcast(([r["token"] for r in rows], [r["id"] for r in rows]))


def _once(docs: DataFrame, doc_id: str) -> bool:
    """Every id (null too) is that of one row."""
    return docs.groupBy(doc_id).agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count() == 0


def _looked_up(docs: DataFrame, doc_id: str, tokens: Column, sent: Broadcast, make: Callable, schema: str) -> DataFrame:
    """``make(ids of the rows, number of each token's row, position of each token in the vocabulary or -1, the vocabulary's ids)`` over Arrow batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told, ids = sent.value
        told, ids = pa.array(told, pa.string()), np.array(ids, dtype=np.int64)
        for b in batches:
            lists = b.column(1)
            row = np.repeat(np.arange(len(lists)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy())
            at = pc.fill_null(pc.index_in(lists.flatten(), value_set=told), -1).to_numpy()
            yield make(b.column(0), row, at, ids)

    own = docs.select(doc_id, tokens.alias("tokens"))
    own.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return own.mapInArrow(run, f"`{own.columns[0]}` {own.schema[0].dataType.simpleString()}, {schema}")


def digitize(docs: DataFrame, doc_id: str, tokens: Column, words: DataFrame) -> DataFrame:
    """(doc, id, count) for known tokens. Counted row by row where the text is, so tokens aren't shuffled; counts are, if an id has several rows."""
    words, sent = _vocabulary(words)
    if sent is None:
        x = docs.select(doc_id, F.explode(tokens).alias("token")).join(words, "token")
        return x.groupBy(doc_id, "id").agg(F.count(F.lit(1)).alias("count"))

    def make(docs: pa.Array, row: np.ndarray, at: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
        key, n = np.unique((row * max(1, len(ids)) + at)[at >= 0], return_counts=True)
        doc, word = np.divmod(key, max(1, len(ids)))
        return pa.RecordBatch.from_arrays([docs.take(pa.array(doc)), pa.array(ids[word], kind), pa.array(n, pa.int64())], [doc_id, "id", "count"])

    one = words.schema["id"].dataType.simpleString()
    kind = pa.int32() if one == "int" else pa.int64()
    rows = _looked_up(docs, doc_id, tokens, sent, make, f"id {one}, count bigint")
    return rows if _once(docs, doc_id) else rows.groupBy(doc_id, "id").agg(F.sum("count").alias("count"))


def apply_dictionary(docs: DataFrame, doc_id: str, tokens: Column, words: DataFrame, unknown: int | None = None) -> DataFrame:
    """(doc, ids in order); unknown tokens are skipped or get the given id. Looked up row by row where the text is, if every id has one row."""
    words, sent = _vocabulary(words)
    if sent is None or not _once(docs, doc_id):
        x = docs.select(doc_id, F.posexplode(tokens).alias("pos", "token")).join(words, "token", "left" if unknown is not None else "inner")
        ids = F.array_sort(F.collect_list(F.struct("pos", F.coalesce("id", F.lit(unknown)).alias("id"))))
        return x.groupBy(doc_id).agg(F.transform(ids, lambda s: s["id"]).alias("ids"))

    def make(docs: pa.Array, row: np.ndarray, at: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
        if unknown is None:
            row, at = row[at >= 0], at[at >= 0]
        doc, first = np.unique(row, return_index=True)
        got = pa.ListArray.from_arrays(pa.array(np.append(first, len(row)), pa.int32()), pa.array(np.append(ids, unknown or 0)[at], kind))
        return pa.RecordBatch.from_arrays([docs.take(pa.array(doc)), got], [doc_id, "ids"])

    one = words.schema["id"].dataType.simpleString()
    kind = pa.int32() if one == "int" else pa.int64()
    return _looked_up(docs, doc_id, tokens, sent, make, f"ids array<{one}>")


def bag_of_words(bags: DataFrame, doc_id: str, ids: list[int]) -> DataFrame:
    return bags.groupBy(doc_id).agg(*[F.max((F.col("id") == i).cast("int")).alias(f"w{i}") for i in ids])


def class_counts(bags: DataFrame, labels: DataFrame, doc_id: str, label: str) -> DataFrame:
    return bags.join(labels.select(doc_id, label), doc_id).groupBy(label, "id").agg(F.sum("count").alias("n"))


def naive_bayes(bags: DataFrame, counts: DataFrame, priors: DataFrame, doc_id: str, label: str, prior: float = 0.5) -> DataFrame:
    """(doc, class, probability): multinomial with additive prior; only words of the dictionary count.

    Every document takes the classes' base score and adds what its words change, so
    the join is on word ids and needs no row per missing word.
    """
    size = counts.agg(F.count_distinct("id").alias("words"))
    total = counts.groupBy(label).agg(F.sum("n").alias("all")).join(F.broadcast(size))
    unseen = total.select(label, F.ln(F.lit(prior) / (F.col("all") + prior * F.col("words"))).alias("unseen"))
    gain = counts.select(label, "id", F.ln((F.col("n") + prior) / F.lit(prior)).alias("gain"))
    words = bags.join(_sent_rows(gain), "id").groupBy(doc_id, label).agg(F.sum(F.col("count") * F.col("gain")).alias("gain"))
    length = bags.groupBy(doc_id).agg(F.sum("count").alias("len"))
    p = priors.agg(F.sum("docs").alias("docs_all"))
    base = priors.join(F.broadcast(p)).select(label, F.ln(F.col("docs") / F.col("docs_all")).alias("base")).join(unseen, label)
    per = length.select(doc_id, "len", F.lit(1).alias("k")).join(F.broadcast(base.withColumn("k", F.lit(1))), "k").join(words, [doc_id, label], "left")
    s = per.withColumn("s", F.col("base") + F.col("len") * F.col("unseen") + F.coalesce("gain", F.lit(0.0)))
    w = Window.partitionBy(doc_id)
    e = F.exp(F.col("s") - F.max("s").over(w))
    return s.withColumn("e", e).select(doc_id, label, (F.col("e") / F.sum("e").over(w)).alias("probability"))


def bm25(bags: DataFrame, counts: DataFrame, doc_id: str, label: str, k: float = 1.5, b: float = 0.75) -> DataFrame:
    """(doc, class, score): classes are the documents of BM25; idf is cut off at 0.001."""
    n = counts.select(label).distinct().agg(F.count(F.lit(1)).alias("classes"))
    length = counts.groupBy(label).agg((F.sum("n") + 1).alias("len"))
    mean = length.agg(F.avg("len").alias("mean"))
    df = counts.groupBy("id").agg(F.count(F.lit(1)).alias("df")).join(F.broadcast(n)).select("id", F.greatest(F.ln((F.col("classes") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-3)).alias("idf"))
    w = counts.join(df, "id").join(F.broadcast(length), label).join(F.broadcast(mean))
    w = w.select(label, "id", (F.col("idf") * F.col("n") * (k + 1) / (F.col("n") + k * (1 - b + b * F.col("len") / F.col("mean")))).alias("value"))
    return bags.join(_sent_rows(w), "id").groupBy(doc_id, label).agg(F.sum("value").alias("score"))
