"""Exact URL blocklists as a cascade of Bloom filters.

Level 1 encodes the list. All keys of the corpus go through it; only those that
pass are compared with the list itself. Level 2 encodes the unlisted ones among
them (what level 1 wrongly accepts), level 3 the listed keys that level 2 wrongly
accepts, and so on, until a level has no false positives. A key of the corpus is
listed if the number of levels it passes before the first refusal is odd. Because
the levels are built over the complete set of the corpus's keys, the answer is
exact for every one of them and no page is joined with a list.

The two 64-bit hashes of a key are computed in the JVM (``xxhash64``); the bits
of a level are aggregated there as well, so the driver receives 64-bit words of
a filter, never keys. A level's filter lives in slices of at most
``slice_bits`` bits, by a hash of the key; the driver and the workers hold the slices of
one pass, ``max_bytes`` at most, and a list beyond that is looked up in more
passes over the keys.

Nulls and texts without ``://`` have an empty host and path; an empty host is
never listed. Repeated urls get equal rows; an empty table gives an empty result, an empty list no hit.
Only page_id and url are read, so other columns may have any name.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from sylva.llm.common import arrow_map, discard, share, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """Between the first ``://`` and ``/``, ``?``, ``#`` or the end; A-Z lower-cased."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """After the host, up to ``?``, ``#`` or the end; empty if no ``/`` follows the host."""
    # the path is optional, so the match never moves on to a later ://
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*((?:/[^?#]*)?)", 1), F.lit(""))


def parent_domains(host: Column) -> Column:
    """The host and all its parents, as an array; empty for an empty host."""
    parts = F.split(host, r"\.")
    names = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    return F.when(F.length(host) > 0, names).otherwise(F.array().cast("array<string>"))


@dataclass(frozen=True)
class Rule:
    action: str  # allow or block
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def matched_rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The longest rule that fits, or null. A rule fits its host and all subdomains if the path starts with the rule's."""
    out = None
    for r in sorted(rules, key=lambda r: (-len(r.name), r.name)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.lit(r.name)) if out is None else out.when(fits, F.lit(r.name))
    return F.lit(None).cast("string") if out is None else out


def _positions(h1: np.ndarray, h2: np.ndarray, level: int, k: int, m: int) -> list[np.ndarray]:
    """k bit numbers below m; each level mixes the hashes anew."""
    with np.errstate(over="ignore"):
        x = (h1 ^ np.uint64((level * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(31)
        step = h2 | np.uint64(1)
        return [((x + np.uint64(i) * step) * np.uint64(0x94D049BB133111EB) >> np.uint64(24)) % np.uint64(m) for i in range(k)]


def _slice(h1: np.ndarray, parts: int) -> np.ndarray:
    return (h1 >> np.uint64(40)) % np.uint64(parts)


def contains(h1: np.ndarray, h2: np.ndarray, levels: list[Level], parts: int) -> np.ndarray:
    """For keys of the slices that ``levels`` hold: is the depth of acceptance odd?"""
    p = _slice(h1, parts)
    alive, depth = np.ones(len(h1), dtype=bool), np.zeros(len(h1), dtype=np.int64)
    for i, level in enumerate(levels):
        alive &= level.has(h1, h2, p, i)
        depth += alive
    return depth % 2 == 1


@dataclass
class Level:
    bits: dict[int, np.ndarray] = field(default_factory=dict)  # by slice
    m: int = 64  # bits of a slice
    k: int = 1

    def has(self, h1: np.ndarray, h2: np.ndarray, part: np.ndarray, level: int) -> np.ndarray:
        out = np.zeros(len(h1), dtype=bool)
        for p, bits in self.bits.items():
            at = np.flatnonzero(part == p)
            if len(at):
                ok = np.ones(len(at), dtype=bool)
                for pos in _positions(h1[at], h2[at], level, self.k, self.m):
                    ok &= (bits[(pos >> np.uint64(6)).astype(np.int64)] >> (pos & np.uint64(63))) & np.uint64(1) == 1
                out[at] = ok
        return out


class BloomCascade:
    """Exact membership of the corpus's keys in a list.

    ``fit(universe, listed)`` takes two DataFrames with a string column ``key``:
    all keys of the corpus (repeated rows are merged, nulls dropped) and the
    listed ones. ``listed_keys(universe)`` returns the distinct keys with a
    boolean ``listed``; ``mark`` looks up array columns of keys.
    """

    def __init__(self, bits_per_key: float = 6.0, slice_bits: int = 1 << 22, max_bytes: int = 64 << 20, max_levels: int = 60):
        self.bits_per_key, self.slice_bits, self.max_bytes, self.max_levels = bits_per_key, slice_bits, max_bytes, max_levels
        self.passes: list[list[Level]] = []
        self.parts = 1

    def _hashed(self, keys: DataFrame) -> DataFrame:
        d = keys.select("key").where(F.col("key").isNotNull()).distinct()
        return d.select("key", F.xxhash64(F.lit(1), "key").alias("h1"), F.xxhash64(F.lit(2), "key").alias("h2"))

    def fit(self, universe: DataFrame, listed: DataFrame) -> BloomCascade:
        names = written(self._hashed(listed), "url-listed")
        keys = written(self._hashed(universe), "url-universe")
        total = names.count()
        self.parts = max(1, math.ceil(total * self.bits_per_key / self.slice_bits))
        per_pass = max(1, int(self.max_bytes * 4 // self.slice_bits))  # half of max_bytes: later levels need less than the first
        self.passes = []
        for first in range(0, self.parts if total else 0, per_pass):
            self.passes.append(self._levels(names, keys, range(first, min(self.parts, first + per_pass))))
        discard(names, keys)
        return self

    def _levels(self, names: DataFrame, keys: DataFrame, parts: range) -> list[Level]:
        """All levels for some slices. Each level is one pass over the keys that all before it accept."""
        own = self._rest(names, [], parts)
        levels = [level for level in [self._encoded(own, 0, parts)] if level]
        if not levels:
            return levels
        passed = self._rest(keys, levels, parts)
        left = written(passed.join(names.select("key", F.lit(True).alias("listed")), "key", "left").withColumn("listed", F.coalesce("listed", F.lit(False))), "url-passed")
        while True:
            mine = len(levels) % 2 == 0
            level = self._encoded(left.where(F.col("listed") == F.lit(mine)), len(levels), parts)
            if level is None:
                discard(left)
                return levels
            if len(levels) >= self.max_levels:
                raise RuntimeError(f"{self.max_levels} levels don't tell the keys apart: two keys have equal hashes, or bits_per_key is too small")
            levels.append(level)
            # what the new level refuses is settled; the rest goes on
            rest = written(self._rest(left, levels[-1:], parts, len(levels) - 1, "listed"), "url-passed")
            discard(left)
            left = rest

    def _encoded(self, keys: DataFrame, at: int, parts: range) -> Level | None:
        """A level that accepts these keys, or None if there are none."""
        most = keys.groupBy("part").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).collect()[0][0]
        if not most:
            return None
        level = Level(m=max(64, 64 * math.ceil(most * self.bits_per_key / 64)), k=max(1, round(self.bits_per_key * math.log(2))))
        for p in parts:
            level.bits[p] = np.zeros(level.m // 64, dtype=np.uint64)
        for r in self._words(keys, at, level).toLocalIterator():
            level.bits[r["part"]][r["word"]] = np.uint64(r["bits"] & 0xFFFFFFFFFFFFFFFF)
        return level

    def _rest(self, keys: DataFrame, levels: list[Level], parts: range, at: int = 0, *keep: str) -> DataFrame:
        """Keys of some slices that the levels (from number ``at`` on) accept, with their slice."""
        shared = share(keys.sparkSession, levels)
        lo, hi, n = parts.start, parts.stop, self.parts
        cols = ["key", "h1", "h2", *keep]

        def run(batches):
            for b in batches:
                h1, h2 = (b.column(c).to_numpy().view(np.uint64) for c in ("h1", "h2"))
                p = _slice(h1, n)
                ok = (p >= lo) & (p < hi)
                for i, level in enumerate(shared()):
                    ok &= level.has(h1, h2, p, at + i)
                kept = pa.array(ok)
                yield pa.RecordBatch.from_arrays([*[b.column(c).filter(kept) for c in cols], pa.array(p[ok].astype(np.int32))], [*cols, "part"])

        kind = "".join(f", {c} {keys.schema[c].dataType.simpleString()}" for c in keep)
        return arrow_map(keys.select(*cols), run, f"key string, h1 long, h2 long{kind}, part int")

    @staticmethod
    def _words(keys: DataFrame, at: int, level: Level) -> DataFrame:
        """The level's bits as rows (part, word, bits), merged in the JVM."""

        def run(batches):
            for b in batches:
                h1, h2 = (b.column(c).to_numpy().view(np.uint64) for c in ("h1", "h2"))
                part = b.column("part").to_numpy()
                for pos in _positions(h1, h2, at, level.k, level.m):
                    bit = (np.uint64(1) << (pos & np.uint64(63))).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(part), pa.array((pos >> np.uint64(6)).astype(np.int32)), pa.array(bit)], ["part", "word", "bits"])

        return arrow_map(keys, run, "part int, word int, bits long").groupBy("part", "word").agg(F.bit_or("bits").alias("bits"))

    def mark(self, df: DataFrame, keys: str, out: str) -> DataFrame:
        """Add boolean ``out``: is any string of the array column ``keys`` listed? No join, no shuffle."""
        for i, levels in enumerate(self.passes):
            shared = share(df.sparkSession, (levels, self.parts))

            @F.pandas_udf("boolean")
            def hit(h1, h2, shared=shared):
                import pandas as pd

                levels, parts = shared()
                n = h1.map(len).to_numpy()
                if not n.sum():
                    return pd.Series(np.zeros(len(h1), dtype=bool))
                a, b = (np.concatenate([np.asarray(x, dtype=np.int64) for x in s]).view(np.uint64) for s in (h1, h2))
                got = contains(a, b, levels, parts)
                return pd.Series(np.bincount(np.repeat(np.arange(len(n)), n), weights=got, minlength=len(n)) > 0)

            h1, h2 = F.transform(keys, lambda k: F.xxhash64(F.lit(1), k)), F.transform(keys, lambda k: F.xxhash64(F.lit(2), k))
            was = F.col(out) if i else F.lit(False)
            df = df.withColumn(out, was | hit(h1, h2))
        return df if self.passes else df.withColumn(out, F.lit(False))


def filter_urls(pages: DataFrame, listed: DataFrame, rules: list[Rule], **params) -> DataFrame:
    """Every page with host, path, the rule that decides (or null), the list's hit and the verdict.

    ``listed`` has a string column ``key`` of blocked domains; a host is listed
    if it or a parent domain is. Rules come first, the longest wins.
    """
    own = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    hosts = own.select("host").distinct().withColumn("names", parent_domains(F.col("host")))
    cascade = BloomCascade(**params).fit(hosts.select(F.explode("names").alias("key")), listed)
    judged = cascade.mark(own.withColumn("names", parent_domains(F.col("host"))), "names", "listed")
    rule = matched_rule(F.col("host"), F.col("path"), rules)
    by_rule = F.create_map(*[F.lit(x) for r in rules for x in (r.name, r.action)]) if rules else F.lit(None).cast("map<string,string>")
    return judged.select(
        "page_id", "host", "path", rule.alias("rule"),
        F.coalesce(F.try_element_at(by_rule, rule), F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"), "listed",
    )
