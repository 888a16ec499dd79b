"""A corpus pipeline: quality rules, toxicity, near duplicates, mixing, tokens.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next one's docs. All read the columns of documents
only, so other columns may have any name and are dropped; all take nulls in any column, empty and
very long texts whole, and give no rows for an empty table.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from sylva.llm import bpe, mixing, ngram_join, quality, toxicity
from sylva.llm.common import shared_dir, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that no quality rule rejects. Null and empty texts are too short and go; repeated rows are judged alike and stay repeated."""
    return quality.apply_rules(docs.select(*COLUMNS))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The scorer learns from the whole table's labelled documents, so that a stricter first stage doesn't starve it.

    Equal texts are judged alike, repeated rows stay repeated; without labels of both classes all rows stay.
    """
    net = toxicity.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return toxicity.drop_toxic(docs.select(*COLUMNS), net)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group the document with the smallest id stays, once; a row with a null id stays only if its group has no other.

    A row is named by its id and text, so rows with null ids and several texts of one id are told apart.
    Documents without words are in no group and stay. Rows that agree in id and text are one row; a repeated id with another text is another row.
    """
    docs = docs.select(*COLUMNS).withColumn("text_hash", F.sha2("text", 256))
    classes, labels = ngram_join.NgramJoin().groups(docs, "text_hash")
    named = classes.where("cid is not null").join(labels, "cid", "left").groupBy(F.coalesce("label", "cid").alias("label"))
    first = named.agg(F.min(F.struct(F.isnull("doc_id").alias("unknown"), "doc_id", "cid", "text_hash")).alias("first"))
    keep = first.select("first.doc_id", "first.text_hash").unionByName(classes.where("cid is null").select("doc_id", "text_hash")).distinct()
    same = docs["doc_id"].eqNullSafe(keep["doc_id"]) & docs["text_hash"].eqNullSafe(keep["text_hash"])
    return docs.join(keep, same, "left_semi").dropDuplicates(["doc_id", "text_hash"]).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it; what is taken in part is cut after its last word taken.

    Rows without words are never taken. Null sources are a source; repeated rows and rows without an id are documents of their own.
    """
    taken, _ = mixing.mix(docs.select(*COLUMNS), F.array("source"), keep=("text", "lang", "source"))
    out = taken.where("taken > 0")
    copies = F.ceil(F.col("taken") / F.col("size")).cast("int")
    out = out.withColumn("copy", F.explode(F.sequence(F.lit(1), copies)))
    words = F.least(F.col("size"), F.col("taken") - F.col("size") * (F.col("copy") - 1))
    # the words as an array: a regex group repeated once a word would recurse as deep in the JVM
    lead, parts = F.regexp_extract("text", r"^[ \t-\r]*+", 0), F.regexp_extract_all("text", F.lit(r"[^ \t-\r]++[ \t-\r]*+"), F.lit(0))
    some = F.concat(lead, F.array_join(F.slice(parts, F.lit(1), F.col("words").cast("int")), ""))
    out = out.withColumn("words", words).withColumn("text", F.when(F.col("words") < F.col("size"), some).otherwise(F.col("text")))
    return out.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every row; null texts have no tokens, repeated rows stay repeated."""
    import public_tokenizers

    return bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("quality", quality_rules), ("toxicity", drop_toxic), ("near_duplicates", near_duplicates), ("mixing", mix_sources), ("tokens", tokens)]

#: The trained network has no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    base = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if i == len(STAGES) - 1:
            return out
        out.write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
