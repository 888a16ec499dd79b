"""Quality rules as a short-circuit cascade, in DataFrame functions only.

Each rule is a boolean Column over a document's text features; a document is
kept if no rule rejects it. ``plan_cascade`` measures every rule on a sample
(its rejections and the seconds its own features take) and orders the rules by
rejections per cost; ``cascade`` compiles that order to one ``CASE WHEN``, so a
document stops at its first failed rule and later features of it are not
computed. The order decides the cost and the ``failed`` column, never ``kept``.

Null and empty texts have no words and fail the minimum. Long texts are
evaluated whole. Rows are judged one by one: equal texts get equal verdicts, repeated rows stay
repeated; rules of equal value keep the order of their names. An empty table gives no
rows. Extra columns pass through; the features never take their names.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

SPACE = r"[ \t-\r]+"
SYMBOLS = "#*$%&|<>"


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once: a lambda variable keeps it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    """The runs of characters other than space and U+0009 to U+000D."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def symbols_in(text: Column) -> Column:
    return F.length(F.regexp_replace(F.coalesce(text, F.lit("")), rf"[^{SYMBOLS}]+", "")).cast("long")


def duplicate_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike(r"[^ \t-\r]"))
    return let(lines, lambda a: (F.size(a) - F.size(F.array_distinct(a))).cast("long"))


def repeated_words(words: Column) -> Column:
    """Words inside 3-word windows that occur at least twice in the text, each word once.

    The windows are sorted with their positions; equal neighbours are repeats.
    That is n log n in the text's own words, without leaving the row.
    """

    def covered(at: Column) -> Column:
        return F.size(F.array_union(F.array_union(at, F.transform(at, lambda i: i + 1)), F.transform(at, lambda i: i + 2))).cast("long")

    def repeats(s: Column) -> Column:
        same = lambda x, i: x["t"] == F.get(s, i)["t"]
        hits = F.filter(s, lambda x, i: F.coalesce(same(x, i + 1), F.lit(False)) | F.coalesce(F.when(i > 0, same(x, i - 1)), F.lit(False)))
        return let(F.transform(hits, lambda x: x["i"]), covered)

    def windows(w: Column) -> Column:
        each = F.transform(F.slice(w, 1, F.size(w) - 2), lambda x, i: F.struct(F.concat_ws(" ", x, F.get(w, i + 1), F.get(w, i + 2)).alias("t"), i.alias("i")))
        some = let(each, lambda a: F.when(F.size(F.array_distinct(F.transform(a, lambda x: x["t"]))) == F.size(a), F.lit(0).cast("long")).otherwise(let(F.array_sort(a), repeats)))
        return F.when(F.size(w) < 4, F.lit(0).cast("long")).otherwise(some)

    return let(words, windows)


#: Feature name -> Column over the text and its words.
FEATURES = {
    "n_words": lambda text, words: F.size(words).cast("long"),
    "word_chars": lambda text, words: F.length(F.concat_ws("", words)).cast("long"),
    "n_symbols": lambda text, words: symbols_in(text),
    "n_dup_lines": lambda text, words: duplicate_lines(text),
    "n_repeat_words": lambda text, words: repeated_words(words),
    "n_lines": lambda text, words: F.size(F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike(r"[^ \t-\r]"))).cast("long"),
    "n_upper": lambda text, words: F.length(F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\p{Lu}]+", "")).cast("long"),
}


@dataclass(frozen=True)
class QualityRule:
    """Rejects a document if ``reject(feature)`` is true; ``needs`` names the features it reads."""

    name: str
    needs: tuple[str, ...]
    reject: object  # callable: name -> Column, to Column


RULES = [
    QualityRule("too_short", ("n_words",), lambda f: f("n_words") < 50),
    QualityRule("repeats_itself", ("n_repeat_words", "n_words"), lambda f: 100 * f("n_repeat_words") > 50 * f("n_words")),
    QualityRule("symbols", ("n_symbols", "n_words"), lambda f: 100 * f("n_symbols") > 20 * f("n_words")),
    QualityRule("repeated_lines", ("n_dup_lines", "n_lines"), lambda f: 100 * f("n_dup_lines") > 40 * f("n_lines")),
    QualityRule("upper_case", ("n_upper", "word_chars"), lambda f: 100 * f("n_upper") > 40 * f("word_chars")),
    QualityRule("word_length", ("word_chars", "n_words"), lambda f: (f("word_chars") < 2 * f("n_words")) | (f("word_chars") > 20 * f("n_words"))),
]


@dataclass(frozen=True)
class Estimate:
    rule: QualityRule
    seconds: float
    rejected: float  # share of the sample

    @property
    def value(self) -> float:
        return self.rejected / max(self.seconds, 1e-6)


def plan_cascade(docs: DataFrame, rules: list[QualityRule] = RULES, sample_rows: int = 1000, seed: int = 7, repeats: int = 3) -> list[Estimate]:
    """Measure every rule on about ``sample_rows`` rows and order by rejections per second.

    The sample is a seeded Bernoulli one, written nowhere: its rate comes from
    the table's row count (Parquet metadata). A rule's seconds are the least of
    ``repeats`` runs (the first also compiles its code) less those of a job without
    features. The result only orders work.
    """
    n = docs.count()
    rate = min(1.0, sample_rows / n) if n else 1.0
    sample = docs.select("text").sample(fraction=rate, seed=seed).cache() if n else docs.select("text")
    total = max(sample.count(), 1)

    def measured(verdict: Column) -> tuple[float, int]:
        seconds, hits = [], 0
        for _ in range(repeats):
            began = time.perf_counter()
            hits = sample.agg(F.count_if(F.coalesce(verdict, F.lit(False)))).collect()[0][0]
            seconds.append(time.perf_counter() - began)
        return min(seconds), hits

    idle, _ = measured(F.col("text") == "")
    found = []
    for rule in rules:
        text, words = F.col("text"), words_of(F.col("text"))
        seconds, hits = measured(rule.reject(lambda name: FEATURES[name](text, words)))  # noqa: B023
        found.append(Estimate(rule, max(seconds - idle, 1e-3), hits / total))
    sample.unpersist()
    return sorted(found, key=lambda e: (-e.value, e.rule.name))


def cascade(order: list[QualityRule], feature) -> Column:
    """The first rule in order that rejects, or null. ``feature`` maps a feature's name to its Column."""
    out = None
    for rule in order:
        hit = F.coalesce(rule.reject(feature), F.lit(False))
        out = F.when(hit, F.lit(rule.name)) if out is None else out.when(hit, F.lit(rule.name))
    return F.lit(None).cast("string") if out is None else out


def apply_rules(docs: DataFrame, rules: list[QualityRule] = RULES) -> DataFrame:
    """The documents that no rule rejects, with their own columns, by the measured cascade."""
    order = [e.rule for e in plan_cascade(docs, rules)]
    text = docs["text"]
    failed = let(words_of(text), lambda w: cascade(order, lambda name: FEATURES[name](text, w)))
    return docs.where(failed.isNull())


def score_documents(docs: DataFrame, rules: list[QualityRule] = RULES) -> DataFrame:
    """Per document the base features, ``base_failed``, the verdict ``kept`` and the rule that ``failed`` it.

    The base features are results here, so they are computed for every row; the
    cascade reads those and adds the rest only for documents still in question.
    """
    order = [e.rule for e in plan_cascade(docs, rules)]
    base = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    text = F.col("text")
    out = docs.select("doc_id", "text", words_of(text).alias("words"))
    out = out.select("doc_id", "text", "words", *[FEATURES[n](text, F.col("words")).alias(n) for n in base])
    failed = cascade(order, lambda name: F.col(name) if name in base else FEATURES[name](text, F.col("words")))
    out = out.select("doc_id", *base, failed.alias("failed"))
    base_failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return out.select("doc_id", *base, base_failed.alias("base_failed"), (~base_failed & F.col("failed").isNull()).alias("kept"), "failed")
