"""Exact self-join of documents on the Jaccard similarity of their word shingles.

Universe partition and pigeonhole. The 64-bit hash of a shingle places it in one
of the segments of its universe, so a set falls into segment subsets. With a
threshold t, two linked sets of sizes a and b differ in at most
H = (1 - t) / (1 + t) * (a + b) shingles. A *subset* segment in which they differ
costs 1 of H, a *one-deletion* segment in which they are more than one deletion
apart costs 2. Sizes fall into bands by powers of two; each band has its own
layout (number of subset and of one-deletion segments), taken by cost from a
bounded sample; a set that could be linked with a smaller one in the band below
is also laid out as a guest there.

Signatures of a set X in a layout: all its one-deletion segments, as they are and
with each single shingle left out; of its subset segments the first
H + 1 - (what the one-deletion segments cover) in one global order: rare
signatures by hash, then those that a sample of the documents shows to be
frequent, then empty segments. Linked sets agree in at least one signature: the
first subset signature they share is preceded, in either set, only by unshared ones.
Any order serves, so the sample decides cost, never the result.

Sets are merged into classes first (equal shingle sets), so copies never meet in
the join. Signatures meet in one shuffle of two numbers a row, sorted, and are read
as a stream that puts out the list of classes of each signature (long lists in
chunks, frequent signatures salted); signatures with the same list are merged. Then

1. every class is tried against the class that comes first in most of its lists;
2. in rounds, classes of different components in one list, star-wise;
3. all that are still in different components, inside the join.

A pair is tried first by sizes and odd sketches (an exact lower bound of the
difference, as wide as the set), then on the words of both texts, which are
brought together for pairs that are left only. A pair inside one component needs no
check: its link cannot change the result.

Results per document: ``n_shingles``, ``component_id``. Null and empty texts have empty sets and
are linked with nothing (their component is their own id). Fewer words than a shingle make one
shingle. Null ids take part; a component's id is its smallest id that isn't null.
Texts are read whole; repeated rows are copies. An empty table gives no rows; only the columns doc_id and
text are read, so other columns may have any name. Words of up to 32 bytes are hashed by their
bytes in blocks of eight, longer ones by BLAKE2b; classes are told apart by two 64-bit hashes of their sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sylva.llm.common import arrow_map, discard, share, written

M1, M2, M3 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
EMPTY = np.zeros(0, dtype=np.uint64)
#: A signature: bit 63 frequent or not, then a hash, six bits for the band, four for the salt.
LATE, SALT_BITS, BAND_BITS = np.uint64(1 << 63), 4, 6
HASHED = np.uint64(((1 << 63) - 1) >> (SALT_BITS + BAND_BITS) << (SALT_BITS + BAND_BITS))
UNSALTED = np.uint64((1 << 64) - (1 << SALT_BITS))
CHUNK = 64  # classes in a list
FIRST = 8  # of a class's lists, carried along
MIN_SKETCH, MAX_SKETCH = 1 << 10, 1 << 16  # bits


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that scatters them."""
    x = (x ^ (x >> np.uint64(30))) * M1
    x = (x ^ (x >> np.uint64(27))) * M2
    return x ^ (x >> np.uint64(31))


# shingles --------------------------------------------------------------------


class Shingler:
    """Sorted distinct 64-bit hashes of texts' word shingles; A-Z lower-cased, words split at ASCII white space.

    Works on all texts of a batch at once, on the bytes of the Arrow column.
    """

    BLOCKS = 4  # of eight bytes; longer words go through BLAKE2b
    CHUNK_BYTES = 4 << 20

    def __init__(self, words: int = 5):
        self.words = words
        self.factors = [np.uint64(pow(int(M3), j + 1, 1 << 64)) for j in range(words)]
        self.space = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
        self.lower = np.arange(256, dtype=np.uint8)
        self.lower[65:91] += 32
        self.mask = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=np.uint64)

    def __call__(self, text: str | None) -> np.ndarray:
        return next(self.sets(pa.array([text], pa.string())))[0]

    def sets(self, column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(hashes, offsets) of consecutive texts of the column; null texts have empty sets."""
        if column.null_count:
            column = column.fill_null("")
        kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
        at = np.frombuffer(column.buffers()[1], dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, dtype=np.int64)
        data = np.frombuffer(column.buffers()[2], dtype=np.uint8) if len(column) and column.buffers()[2] is not None else np.zeros(0, dtype=np.uint8)
        first = 0
        while first < len(column):
            last = max(first + 1, int(np.searchsorted(at, at[first] + self.CHUNK_BYTES, side="right")) - 1)
            yield self._sets(data[at[first] : at[last]], at[first : last + 1] - at[first])
            first = last

    def _words(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all words, and how many each text has."""
        n = len(data)
        raw = np.zeros(n + 8 * self.BLOCKS, dtype=np.uint8)
        raw[:n] = self.lower[data]
        space = self.space[data]
        before, after = np.empty(n, dtype=bool), np.empty(n, dtype=bool)
        before[1:], after[:-1] = space[:-1], space[1:]
        edge = at[:-1][at[:-1] < n]
        before[edge] = True
        after[-1:] = True
        after[edge[edge > 0] - 1] = True
        start = np.flatnonzero(~space & before)
        length = np.flatnonzero(~space & after) + 1 - start
        eight = np.ndarray((n + 8 * self.BLOCKS - 7,), dtype="<u8", buffer=raw.data, strides=(1,))
        h = mix((eight[start] & self.mask[np.minimum(length, 8)]) ^ (length.astype(np.uint64) * M3))
        for j in range(8, 8 * self.BLOCKS, 8):
            more = np.flatnonzero(length > j)
            if not len(more):
                break
            h[more] = mix((h[more] * M2) ^ (eight[start[more] + j] & self.mask[np.minimum(length[more] - j, 8)]))
        for i in np.flatnonzero(length > 8 * self.BLOCKS):
            h[i] = int.from_bytes(blake2b(raw[start[i] : start[i] + length[i]].tobytes(), digest_size=8).digest(), "little")
        return h, np.diff(np.searchsorted(start, at))

    def _sets(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h, many = self._words(data, at)
        k = self.words
        count = np.where(many >= k, many - k + 1, np.minimum(many, 1))
        ends = np.cumsum(count)
        out = np.empty(int(ends[-1]) if len(ends) else 0, dtype=np.uint64)
        if len(h) >= k:
            total = np.full(len(h) - k + 1, k * 0x632BE59BD9B4E019 & 0xFFFFFFFFFFFFFFFF, dtype=np.uint64)
            for j in range(k):
                total += h[j : j + len(total)] * self.factors[j]
            doc = np.repeat(np.arange(len(many)), many)
            out[np.repeat(many >= k, count)] = mix(total[doc[: len(total)] == doc[k - 1 :]])
        first = np.cumsum(many) - many
        for i in np.flatnonzero((many > 0) & (many < k)):
            parts = h[first[i] : first[i] + many[i]] * np.array(self.factors[: many[i]])
            out[ends[i] - 1 : ends[i]] = mix(np.add.reduce(parts, keepdims=True) + np.uint64(int(many[i]) * 0x632BE59BD9B4E019 & 0xFFFFFFFFFFFFFFFF))
        start = ends - count
        for a, z in zip(start.tolist(), ends.tolist(), strict=True):
            out[a:z].sort()
        new = np.ones(len(out), dtype=bool)
        new[1:] = out[1:] != out[:-1]
        new[start[count > 0]] = True
        return out[new], np.concatenate([[0], np.cumsum(new)])[np.concatenate([[0], ends])]


def classes_of(s: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each set; 0 for empty ones."""
    full = np.flatnonzero(np.diff(at))
    out = []
    for m in (M1, M2):
        x = np.zeros(len(at) - 1, dtype=np.uint64)
        if len(full):
            x[full] = mix(np.add.reduceat(mix(s ^ m), at[full]) + np.diff(at)[full].astype(np.uint64) * m)
        out.append(x)
    return out[0], out[1]


def class_of(s: np.ndarray) -> tuple[int, int]:
    return tuple(int(x.view(np.int64)[0]) for x in classes_of(s, np.array([0, len(s)])))


# layouts ---------------------------------------------------------------------


@dataclass(frozen=True)
class Layout:
    band: int
    plain: int  # subset segments
    deletion: int  # one-deletion segments
    share: float  # of the universe, for the one-deletion segments


def band_of(size: int) -> int:
    return size.bit_length() - 1


def max_distance(size, largest: int, t: Fraction):
    """The largest symmetric difference of a set of this size (or of each of an array) and a linked one of up to ``largest``."""
    p, q = t.numerator, t.denominator
    return (size + np.minimum(largest, size * q // p)) * (q - p) // (q + p)


def layout(band: int, share: float, t: Fraction, load: float = 1.25, deletion_load: float = 8.0) -> Layout:
    """``load``: shingles a subset segment holds of the largest set."""
    top = int(((1 << band + 1) - 1) / t)  # natives and guests
    need = int(max_distance(top, top, t)) + 1
    deletion = round(top * share / deletion_load)
    share = share if deletion else 0.0
    return Layout(band, max(need, int(top * (1 - share) / load) + 2), deletion, share)


def batch_signatures(sets: list[np.ndarray], lay: Layout, native: bool, t: Fraction, hot: np.ndarray, every: bool = False) -> list[np.ndarray]:
    """The signatures of each (not empty) set in a layout; ``hot``: sorted frequent ones.

    ``every`` gives all signatures of subsets that aren't empty.
    """
    size = np.array([len(s) for s in sets])
    s, own = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
    largest = int(((1 << lay.band + 1) - 1) / t) if native else (1 << lay.band + 1) - 1
    room = max_distance(size, largest, t) + 1
    high, weights = s >> np.uint64(32), mix(s ^ M1)
    cut = np.uint64(int(lay.share * (1 << 32))) if lay.deletion else np.uint64(0)
    seed, tag = mix(np.array([lay.band * 2 + 1], dtype=np.uint64))[0], np.uint64(lay.band << SALT_BITS)
    name = lambda total, place: mix(mix(total ^ seed) + place) & HASHED | tag

    def segments(rows: np.ndarray, seg: np.ndarray):
        """First rows, owners, places, counts and summed weights of runs of one set and segment."""
        o = own[rows]
        first = np.flatnonzero(np.concatenate([[True], (seg[1:] != seg[:-1]) | (o[1:] != o[:-1])])) if len(rows) else np.zeros(0, dtype=np.int64)
        w = weights[rows]
        return o[first], seg[first], np.diff(np.append(first, len(rows))), np.add.reduceat(w, first) if len(first) else EMPTY, w

    parts: list[list[np.ndarray]] = [[] for _ in sets]
    if lay.deletion:
        rows = np.flatnonzero(high < cut)
        who, seg, count, total, w = segments(rows, high[rows] * np.uint64(lay.deletion) // cut)
        place, many = seg + np.uint64(1 << 40), count > 1  # a single shingle's deletion would be the empty subset
        room = room - np.bincount(who, weights=np.where(many, 2, 1), minlength=len(sets)).astype(np.int64)
        inside = np.repeat(many, count)
        sig = np.concatenate([name(total, place), name((np.repeat(total, count) - w)[inside], np.repeat(place, count)[inside])])
        who = np.concatenate([who, np.repeat(who, count)[inside]])
        order = np.argsort(who, kind="stable")
        for i, x in enumerate(np.split(sig[order], np.searchsorted(who[order], np.arange(1, len(sets))))):
            parts[i].append(x)
    if every:
        room = np.maximum(room, size)
    rows = np.flatnonzero(high >= cut)
    who, seg, _, total, _ = segments(rows, (high[rows] - cut) * np.uint64(lay.plain) // np.uint64((1 << 32) - int(cut)))
    sig = name(total, seg)
    if len(hot) and len(sig):
        found = np.minimum(np.searchsorted(hot, sig), len(hot) - 1)
        sig = np.where(hot[found] == sig, sig | LATE, sig)
    at = np.searchsorted(who, np.arange(len(sets) + 1)).tolist()
    for i, r in enumerate(room.tolist()):
        x = sig[at[i] : at[i + 1]]
        if r <= 0:
            continue
        if len(x) > r:
            x = np.partition(x, r - 1)[:r]
        parts[i].append(x)
        if len(x) < r and not every:
            free = np.setdiff1d(np.arange(lay.plain, dtype=np.uint64), seg[at[i] : at[i + 1]])[: r - len(x)]
            parts[i].append(name(np.full(len(free), seed), free + np.uint64(1 << 41)) | LATE)
    return [np.concatenate(p) if len(p) > 1 else p[0] if p else EMPTY for p in parts]


def signatures(s: np.ndarray, lay: Layout, native: bool, t: Fraction, hot: np.ndarray) -> np.ndarray:
    return batch_signatures([s], lay, native, t, hot)[0]


def laid_out(size: int, t: Fraction) -> list[tuple[int, bool]]:
    """(band, native) of the layouts a set of this size takes part in."""
    b = band_of(size)
    out = [(b, True)]
    if b and -(-size * t.numerator // t.denominator) < 1 << b:
        out.append((b - 1, False))
    return out


# sketches --------------------------------------------------------------------


def sketch_bits(band: int) -> int:
    return min(MAX_SKETCH, max(MIN_SKETCH, 2 << band))


def odd_sketch(s: np.ndarray) -> bytes:
    """For each of some buckets whether an odd number of the set's hashes falls into it.

    Two sets' sketches, folded to one width, differ in at most as many bits as the sets differ in hashes.
    """
    bits = sketch_bits(band_of(len(s)))
    return np.packbits((np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)).tobytes()


def folded(sketch: np.ndarray, width: int) -> np.ndarray:
    """A sketch (or rows of them) of fewer bytes."""
    while sketch.shape[-1] > width:
        half = sketch.shape[-1] // 2
        sketch = sketch[..., :half] ^ sketch[..., half:]
    return sketch


def _overlaps(a: np.ndarray, b: np.ndarray, t: Fraction) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both * t.denominator >= t.numerator * (len(a) + len(b) - both)


def word_shingles(text: str, words: int) -> set:
    """The shingles themselves."""
    w = text.encode().lower().split()  # bytes: only A-Z, only U+0009-000D and space
    return set(zip(*(w[j:] for j in range(words)), strict=False)) if len(w) >= words else {tuple(w)} if w else set()


class NgramJoin:
    """See the module. ``fit`` returns one row per document: doc_id, n_shingles, component_id.

    ``sample`` documents decide layouts, one in ``hot_rate`` documents which signatures come late (at most ``max_hot``,
    those of ``hot_count`` documents or more): both decide cost only. ``part``: classes of one signature kept in memory.
    """

    def __init__(self, words: int = 5, threshold: Fraction = Fraction(4, 5), sample: int = 400, hot_rate: int = 16, hot_count: int = 4, max_hot: int = 1_000_000, rounds: int = 1, part: int = 4096, loads: tuple[float, ...] = (1.25, 2.5)):
        self.words, self.t, self.sample, self.loads = words, threshold, sample, loads
        self.hot_rate, self.hot_count, self.max_hot, self.rounds, self.part = hot_rate, hot_count, max_hot, rounds, part

    # classes ------------------------------------------------------------

    def classes(self, docs: DataFrame, *keep: str) -> DataFrame:
        """doc_id, n, cid, check, sketch, own, h and the columns ``keep``: the class of each document; cid null for empty sets.

        (own, h) names a text: own is the id or, without one, the text's hash h.
        """
        words = self.words

        def run(batches):
            shingle = Shingler(words)
            for b in batches:
                row = 0
                for s, at in shingle.sets(b.column("text")):
                    n = np.diff(at)
                    cid, check = classes_of(s, at)
                    sketch = [odd_sketch(s[a:z]) if z > a else None for a, z in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                    own = b.slice(row, len(n))
                    row += len(n)
                    made = [pa.array(n), *[pa.array(x.view(np.int64), mask=n == 0) for x in (cid, check)], pa.array(sketch, pa.binary())]
                    yield pa.RecordBatch.from_arrays([own.column("doc_id"), *made, *[own.column(k) for k in ("own", "h", *keep)]], ["doc_id", "n", "cid", "check", "sketch", "own", "h", *keep])

        rows = _named(docs, *keep)
        kept = "".join(f", {k} {rows.schema[k].dataType.simpleString()}" for k in keep)
        out = written(arrow_map(rows, run, "doc_id long, n long, cid long, check long, sketch binary, own long, h long" + kept), "ngram-classes")
        clash = out.where("cid is not null").groupBy("cid").agg(F.min("check").alias("lo"), F.max("check").alias("hi")).where("lo <> hi").limit(1).count()
        if clash:
            raise RuntimeError("two shingle sets have one 64-bit hash; run again with other multipliers")
        return out

    # layouts ------------------------------------------------------------

    def layouts(self, docs: DataFrame, n_docs: int) -> dict[int, Layout]:
        """Per band the cheapest of some layouts: signatures emitted, plus pairs expected from collisions in a sample of ``sample`` documents."""
        top = docs.select("text").where(F.length("text") > 0).orderBy(F.xxhash64(F.lit(3), "text"), "text").limit(self.sample)
        shingle, by_band = Shingler(self.words), {}
        seen = set()
        for r in top.toLocalIterator():
            s = shingle(r["text"])
            if len(s) and s.tobytes() not in seen:
                seen.add(s.tobytes())
                by_band.setdefault(band_of(len(s)), []).append(s)
        out, scale = {}, (n_docs / max(1, len(seen)))
        for band in range(41):
            sets = by_band.get(band, [])
            best = None
            for part in (0.0, 0.05, 0.1) if len(sets) > 1 else (0.0,):
                for load in self.loads:
                    lay = layout(band, part, self.t, load)
                    found = batch_signatures(sets, lay, True, self.t, EMPTY) if sets else []
                    rows = sum(map(len, found)) * scale
                    count = np.unique(np.concatenate(found), return_counts=True)[1] if found else np.zeros(0)
                    pairs = float(((count - 1) * count / 2).sum()) * scale**2
                    if best is None or (rows + 20 * pairs, -load) < best[0]:  # of equal ones the more selective
                        best = ((rows + 20 * pairs, -load), lay)
            out[band] = best[1]
        return out

    def _emitted(self, docs: DataFrame, layouts: dict[int, Layout], hot: np.ndarray, every: bool = False) -> DataFrame:
        """(sig, cid): every signature of every document; frequent ones salted by the class."""
        words, t = self.words, self.t
        shared = share(docs.sparkSession, (layouts, hot))

        def run(batches):
            shingle = Shingler(words)
            lays, late = shared()
            for b in batches:
                for s, at in shingle.sets(b.column("text")):
                    cid, _ = classes_of(s, at)
                    roles: dict[tuple[int, bool], list[int]] = {}
                    for i, n in enumerate(np.diff(at).tolist()):
                        if n:
                            for role in laid_out(n, t):
                                roles.setdefault(role, []).append(i)
                    for (band, native), rows in roles.items():
                        found = batch_signatures([s[at[i] : at[i + 1]] for i in rows], lays[band], native, t, late, every)
                        sig, who = np.concatenate(found), np.repeat(cid[rows], [len(x) for x in found])
                        hit = np.flatnonzero(sig >= LATE)
                        sig[hit] |= np.uint64(1) + mix(who[hit]) % np.uint64((1 << SALT_BITS) - 1)
                        for a in range(0, len(sig), 500_000):
                            yield pa.RecordBatch.from_arrays([pa.array(sig[a : a + 500_000].view(np.int64)), pa.array(who[a : a + 500_000].view(np.int64))], ["sig", "cid"])

        return arrow_map(docs.select("text"), run, "sig long, cid long")

    def hot_signatures(self, docs: DataFrame, layouts: dict[int, Layout]) -> np.ndarray:
        """Signatures that ``hot_count`` or more documents have in a sample of one in ``hot_rate`` texts; at most ``max_hot``, the most frequent. Chosen or not in a first order: those that come up when others are put last are among them."""
        some = docs.where(F.pmod(F.xxhash64(F.lit(9), "doc_id", "text"), F.lit(self.hot_rate)) == 0)
        seen = self._emitted(some, layouts, EMPTY, every=True).groupBy("sig").agg(F.count(F.lit(1)).alias("n"), F.min("cid").alias("lo"), F.max("cid").alias("hi"))
        top = seen.where((F.col("n") >= self.hot_count) & (F.col("lo") != F.col("hi"))).orderBy(F.desc("n"), "sig").limit(self.max_hot)
        return np.sort(np.array([r["sig"] for r in top.select("sig").toLocalIterator()], dtype=np.int64).view(np.uint64))

    # candidates ---------------------------------------------------------

    def lists(self, emitted: DataFrame) -> DataFrame:
        """(gid, cids, weight): the classes of each signature that more than one has, by a stream over sorted rows.

        Signatures with one and the same list are one row, with their number as weight. A list of over CHUNK classes, or of a
        salted signature, comes as several rows of one gid.
        """

        def run(batches):
            held = np.zeros((2, 0), dtype=np.uint64)
            torn = np.uint64(0)  # the signature whose first rows are out already

            def lists(rows, open_):
                """Lists of complete signatures, and of the last one as far as it is read if ``open_``; rows to keep."""
                sig, cid = rows
                new = np.concatenate([[True], sig[1:] != sig[:-1]])
                first = np.flatnonzero(new)
                stop = int(first[-1]) if open_ else len(sig)
                kept = rows[:, stop:]
                keep = new | np.concatenate([[True], cid[1:] != cid[:-1]])
                keep[stop:] = False
                sig, cid = sig[keep], cid[keep]
                if not len(sig):
                    return None, kept
                first = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
                size = np.diff(np.append(first, len(sig)))
                gid, salted = sig[first] & UNSALTED, ((sig[first] & ~UNSALTED) > 0) | (sig[first] == torn)
                # lists in chunks; a salted signature's list may have one class
                chunks = -(-size // CHUNK)
                which = np.repeat(np.arange(len(first)), chunks)
                begin = first[which] + CHUNK * (np.arange(len(which)) - np.repeat(np.cumsum(chunks) - chunks, chunks))
                length = np.minimum(CHUNK, first[which] + size[which] - begin)
                short = (chunks == 1) & ~salted & (size > 1)
                total = np.add.reduceat(mix(cid ^ M3), first)
                gid = np.where(short, mix(total + size.astype(np.uint64)) & HASHED | gid & np.uint64(((1 << BAND_BITS) - 1) << SALT_BITS), gid)
                use = (salted | (size > 1))[which]
                which, begin, length = which[use], begin[use], length[use]
                at = np.repeat(begin - (np.cumsum(length) - length), length) + np.arange(int(length.sum()))
                arrays = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(length)]).astype(np.int32)), pa.array(cid[at].view(np.int64)))
                return (pa.RecordBatch.from_arrays([pa.array(gid[which].view(np.int64)), arrays], ["gid", "cids"]) if len(which) else None), kept

            for b in batches:
                if b.num_rows:
                    rows = np.stack([b.column(c).to_numpy().view(np.uint64) for c in ("sig", "cid")])
                    rows = np.concatenate([held, rows], axis=1)
                    out, held = lists(rows, True)
                    if out is not None:
                        yield out
                    if held.shape[1] >= 1 << 20:  # a very frequent signature, in pieces: its rows still share the gid, salted ones and others
                        yield pieces(held)
                        held, torn = held[:, -1:], held[0, -1]
            if held.shape[1]:
                out, _ = lists(held, False)
                if out is not None:
                    yield out

        def pieces(rows):
            sig, cid = rows
            keep = np.concatenate([[True], cid[1:] != cid[:-1]])
            cid = cid[keep]
            at = np.append(np.arange(0, len(cid), CHUNK), len(cid))
            arrays = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(cid.view(np.int64)))
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(at) - 1, sig[0] & UNSALTED).view(np.int64)), arrays], ["gid", "cids"])

        dealt = emitted.repartition("sig").sortWithinPartitions("sig", "cid")
        rows = arrow_map(dealt, run, "gid long, cids array<long>")
        return written(rows.groupBy("gid", "cids").agg(F.count(F.lit(1)).alias("weight")), "ngram-lists")

    # verification -------------------------------------------------------

    def sets(self, classes: DataFrame, cids: DataFrame) -> DataFrame:
        """(cid, n, sketch, own, h): a row for each class that has candidates, with the name of one of its texts."""
        rows = classes.where("cid is not null").select("cid", "n", "sketch", "own", "h").join(cids, "cid", "left_semi")
        return written(rows.dropDuplicates(["cid"]), "ngram-sets")

    def near(self, pairs: DataFrame, sets: DataFrame) -> DataFrame:
        """The pairs (a, b) of classes that sizes and sketches leave possible; never drops linked ones."""
        up, down = self.t.numerator, self.t.denominator
        ends = [sets.select(F.col("cid").alias(c), F.col("n").alias(f"n_{c}"), F.col("sketch").alias(f"s_{c}")) for c in ("a", "b")]
        sized = pairs.join(ends[0], "a").join(ends[1], "b").where((F.col("n_a") * up <= F.col("n_b") * down) & (F.col("n_b") * up <= F.col("n_a") * down))

        def run(batches):
            for b in batches:
                ok = []
                for n, x, m, y in zip(*(b.column(c).to_pylist() for c in ("n_a", "s_a", "n_b", "s_b")), strict=True):
                    x, y = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
                    width = min(len(x), len(y))
                    apart = int(np.bitwise_count(folded(x, width) ^ folded(y, width)).sum(dtype=np.int64))
                    ok.append(apart * (up + down) <= (n + m) * (down - up))
                yield b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

        return arrow_map(sized.select("a", "b", "n_a", "s_a", "n_b", "s_b"), run, "a long, b long")

    def verified(self, near: DataFrame, sets: DataFrame, docs: DataFrame) -> DataFrame:
        """The pairs (a, b) of classes that are linked, by their words.

        A text goes to where its pairs are: each b to its a, with a's text once for up to ``part`` of them.
        """
        words, t = self.words, self.t
        names = sets.select("cid", "own", "h")
        many = near.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / self.part).cast("int").alias("parts"))
        left = many.join(names, many["a"] == names["cid"]).select("own", "h", "a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("side"), "cid")
        right = near.join(many, "a").join(names, F.col("b") == F.col("cid")).select("own", "h", "a", F.pmod(F.xxhash64("b"), "parts").cast("int").alias("part"), F.lit(1).alias("side"), "cid")
        route = written(left.unionByName(right), "ngram-route")
        small = route.limit(100_001).count() <= 100_000  # 44 bytes a row; else a shuffle of the texts
        rows = _named(docs).select("own", "h", "text").join(F.broadcast(route) if small else route, ["own", "h"]).drop("own", "h")

        def run(batches):
            key, center = None, None
            for b in batches:
                a, c = [], []
                for x, part, side, cid, text in zip(*(b.column(k).to_pylist() for k in ("a", "part", "side", "cid", "text")), strict=True):
                    if key != (x, part):
                        key, center = (x, part), None
                    if side == 0:
                        center = center or word_shingles(text, words)
                    elif center is not None:
                        own = word_shingles(text, words)
                        both = len(own & center)
                        if both * t.denominator >= t.numerator * (len(own) + len(center) - both):
                            a.append(x)
                            c.append(cid)
                if a:
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(c, pa.int64())], ["a", "b"])

        dealt = rows.repartition("a", "part").sortWithinPartitions("a", "part", "side")
        out = written(arrow_map(dealt, run, "a long, b long").distinct(), "ngram-links")
        discard(route)
        return out

    # components ---------------------------------------------------------

    def groups(self, docs: DataFrame, *keep: str) -> tuple[DataFrame, DataFrame]:
        """``classes`` of the documents, and (cid, label) of linked ones: classes with one label are one group, a class without is its own."""
        docs = docs.select("doc_id", "text", *keep)
        classes, docs = self.classes(docs, *keep), docs.select("doc_id", "text")
        lays = self.layouts(docs, classes.count())
        hot = self.hot_signatures(docs, lays)
        lists = self.lists(self._emitted(docs, lays, hot))
        members = lists.select("gid", "weight", F.explode("cids").alias("cid"))
        sets = self.sets(classes, members.select("cid").distinct())
        # each class against the one that comes first in most of its lists
        centers = lists.groupBy("gid").agg(F.min(F.array_min("cids")).alias("center"))
        votes = lists.join(centers, "gid").select("weight", "center", F.explode("cids").alias("cid")).where("cid <> center").groupBy("cid", "center").agg(F.sum("weight").alias("n"))
        best = votes.groupBy("cid").agg(F.max(F.struct("n", "center")).alias("m")).select(F.col("m.center").alias("a"), F.col("cid").alias("b"))
        tried = written(self.near(best, sets), "ngram-near")
        links = self.verified(tried, sets, docs)
        labels = components(links)
        old = [tried, links]
        for k in range(self.rounds + 1):
            told = members.join(labels.withColumnRenamed("v", "cid"), "cid", "left").select("gid", "cid", F.coalesce("label", "cid").alias("label"))
            mixed = told.groupBy("gid").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count(F.lit(1)).alias("size")).where("lo <> hi").select("gid", "size")
            open_ = written(told.join(mixed, "gid"), "ngram-open")
            if k < self.rounds:  # one class of each component, chosen anew each round, against that of the first
                heads = open_.groupBy("gid", "label").agg(F.min_by("cid", F.xxhash64(F.lit(k), "cid")).alias("cid"))
                first = heads.groupBy("gid").agg(F.min(F.struct(F.xxhash64(F.lit(k), "label").alias("hash"), "label", "cid")).alias("f"))
                new = heads.join(first, "gid").where("label <> f.label").select(F.col("f.cid").alias("a"), F.col("cid").alias("b"))
                new = written(self.near(_ordered(new), sets), "ngram-near")
            else:
                firsts = open_.groupBy("cid").agg(F.slice(F.array_sort(F.collect_list("gid")), 1, FIRST).alias("firsts"))
                new = written(_ordered(self._remaining(open_.join(sets.select("cid", "n", "sketch").join(firsts, "cid"), "cid"))), "ngram-near")
            more = self.verified(new, sets, docs)
            old += [open_, new, more]
            if more.limit(1).count():
                links = links.unionByName(more)
                discard(labels)
                labels = components(links)
        discard(lists, sets, *old)
        return classes, labels.withColumnRenamed("v", "cid")

    def fit(self, docs: DataFrame) -> DataFrame:
        classes, labels = self.groups(docs)
        named = classes.where("cid is not null").groupBy("cid").agg(F.min("doc_id").alias("least"))
        named = named.join(labels, "cid", "left").withColumn("label", F.coalesce("label", "cid"))
        least = named.groupBy("label").agg(F.min("least").alias("component_id"))
        final = named.join(least, "label").select("cid", "component_id")
        empty = classes.where("cid is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
        return classes.where("cid is not null").join(final, "cid").select("doc_id", F.col("n").alias("n_shingles"), "component_id").unionByName(empty)

    def _remaining(self, open_: DataFrame) -> DataFrame:
        """Pairs of one list in different components that sizes and sketches leave possible.

        The classes of a list meet in a sorted stream; only pairs that pass are emitted. Of a list
        with over ``part`` classes, parts of about that many (side 0, kept in memory) each meet
        all its classes (side 1, streamed); of a smaller one every class meets those before it (side 2).
        Near copies share many lists, so a class carries its FIRST smallest lists: a pair that has one of them in
        common is put out by the smallest of these only (no smaller one can be common without being carried too).
        """
        parts = F.ceil(F.col("size") / self.part).cast("int")
        cols = ["cid", "label", "n", "firsts", "sketch"]
        few = open_.where(parts == 1).select("gid", F.lit(0).alias("part"), F.lit(2).alias("side"), *cols)
        many = open_.where(parts > 1)
        held = many.select("gid", F.pmod(F.xxhash64("cid"), parts).cast("int").alias("part"), F.lit(0).alias("side"), *cols)
        passing = many.select("gid", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), F.lit(1).alias("side"), *cols)
        up, down = self.t.numerator, self.t.denominator

        NONE = np.iinfo(np.int64).max

        def width(gid: np.ndarray) -> np.ndarray:
            """Words of the sketches of a list's band; guests' are folded."""
            band = gid.view(np.uint64) >> np.uint64(SALT_BITS) & np.uint64((1 << BAND_BITS) - 1)
            return np.array([sketch_bits(i) // 64 for i in range(1 << BAND_BITS)])[band.astype(np.int64)]

        def run(batches):
            carry: dict[int, list[np.ndarray]] = {}
            for b in batches:
                if not b.num_rows:
                    continue
                gid = b.column("gid").to_numpy()
                wide, column = width(gid), b.column("sketch")
                last = {int(wide[-1])}
                for w in np.unique(wide).tolist():
                    rows = np.flatnonzero(wide == w)
                    own = [b.column(c).to_numpy()[rows] for c in ("gid", "part", "side", "cid", "label", "n")]
                    own.append(np.array([(b.column("firsts")[i].as_py() + [NONE] * FIRST)[:FIRST] for i in rows.tolist()]))
                    own.append(np.stack([folded(np.frombuffer(column[i].as_buffer(), dtype=np.uint64), w) for i in rows.tolist()]))
                    kept = carry.pop(w, None)
                    if kept is not None and (kept[0][-1], kept[1][-1]) != (own[0][0], own[1][0]):
                        kept = None
                    old = 0 if kept is None else len(kept[0])
                    if old:
                        own = [np.concatenate(x) for x in zip(kept, own, strict=True)]
                    yield from pairs(own, old)
                    if w in last:
                        g, part, side = own[:3]
                        same = (g == g[-1]) & (part == part[-1]) & (side != 1)
                        carry[w] = [c[same] for c in own]

        def pairs(cols, old):
            gid, part, side, cid, label, n, firsts, sketch = cols
            at = np.arange(len(gid))
            new = np.concatenate([[True], (gid[1:] != gid[:-1]) | (part[1:] != part[:-1])])
            start = at[new][np.cumsum(new) - 1]
            kept = np.cumsum(side == 0)
            stop = np.where(side == 2, at, start + kept - (kept - (side == 0))[start])
            right = at[old:][side[old:] > 0]
            for rows in blocks(right, (stop - start)[right], max(1000, 800_000 // sketch.shape[1])):
                many = (stop - start)[rows]
                r = np.repeat(rows, many)
                x = np.arange(len(r)) - np.repeat(np.cumsum(many) - many - start[rows], many)
                ok = (label[x] != label[r]) & ((side[r] == 2) | (cid[x] < cid[r])) & (n[x] * up <= n[r] * down) & (n[r] * up <= n[x] * down)
                x, r = x[ok], r[ok]
                apart = np.bitwise_count(sketch[x] ^ sketch[r]).sum(axis=1, dtype=np.int64)
                ok = apart * (up + down) <= (n[x] + n[r]) * (down - up)
                x, r = x[ok], r[ok]
                common = firsts[x][:, :, None] == firsts[r][:, None, :]
                ok = gid[x] <= np.where(common.any(axis=2), firsts[x], NONE).min(axis=1, initial=NONE)
                if ok.any():
                    yield pa.RecordBatch.from_arrays([pa.array(cid[x[ok]]), pa.array(cid[r[ok]])], ["a", "b"])

        def blocks(rows, many, limit):
            """Consecutive rows whose numbers of pairs add up to about the limit."""
            total = np.cumsum(many) // limit
            return np.split(rows, np.flatnonzero(total[1:] != total[:-1]) + 1) if len(rows) else []

        dealt = few.unionByName(held).unionByName(passing).repartition("gid", "part").sortWithinPartitions("gid", "part", "side", "cid")
        return arrow_map(dealt, run, "a long, b long")


def _named(docs: DataFrame, *keep: str) -> DataFrame:
    """doc_id, text, own, h: (own, h) names a text, also where the id is null or has several texts."""
    h = F.xxhash64(F.lit(5), F.coalesce("text", F.lit("")))
    return docs.select("doc_id", "text", F.coalesce(F.col("doc_id").cast("long"), h).alias("own"), h.alias("h"), *keep)


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """(v, label) for all ends of links: label is the smallest v of the component.

    Every round takes the least label of the neighbours and then the label's own
    label (pointer jumping), so rounds grow with the logarithm of a path; each round is written, the one before deleted.
    """
    both = written(links.select(F.col("a").alias("v"), F.col("b").alias("u")).unionByName(links.select(F.col("b").alias("v"), F.col("a").alias("u"))), "ngram-edges")
    labels = written(both.groupBy("v").agg(F.min("u").alias("label")).withColumn("label", F.least("v", "label")).withColumn("was", F.col("v")), "ngram-labels")
    while True:
        now = labels.select("v", "label")
        told = both.join(now.withColumnRenamed("v", "u"), "u").groupBy("v").agg(F.min("label").alias("near"))
        new = now.join(told, "v").select("v", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        up = now.select(F.col("v").alias("label"), F.col("label").alias("up"))
        new = written(new.join(up, "label", "left").select("v", F.least("label", F.coalesce("up", "label")).alias("label"), "was"), "ngram-labels")
        discard(labels)
        labels = new
        if not new.where("was <> label").limit(1).count():
            discard(both)
            out = labels.select("v", "label")
            out.written_to = labels.written_to
            return out
