"""Toxicity by a bidirectional gated recurrent network with attention pooling, in numpy.

A word enters as the embedding of its hash beside the mean embedding of its
character n-grams; a GRU reads a window of words in either direction; attention
pools its states to one logit. A document is scored on all overlapping windows of
its whole text, its score is that of its strongest window, calibrated on the
training documents.

The network is fitted on the driver on a bounded sample of labelled documents
(``Settings.positives`` and ``Settings.negatives``, by a hash of the id). A toxic
document teaches through its strongest window, a clean one through all windows
drawn from it. The driver gets no whole texts: a document with more windows than
training draws from one comes as that many of its windows, drawn by a hash of its id; the calibration's
whole texts are scored by the tasks. Labels are given only for training; id, language and source are never inputs.

Null and empty texts have no words; their score is that of a window without
words, which is clean. Long texts give more windows, read and scored in parts of bounded size.
Equal texts get equal scores, repeated rows stay repeated. Without labels of both classes every score is 0.
An empty table gives no rows. Only doc_id, text and (of the labels) toxic are read, so other columns may have any name.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sylva.llm.common import arrow_map, discard, share, written


@dataclass(frozen=True)
class Settings:
    positives: int = 1500
    negatives: int = 3000
    window: int = 48
    stride: int = 36
    hidden: int = 8
    word_buckets: int = 1 << 13
    gram_buckets: int = 1 << 14
    size: int = 8  # of either embedding
    steps: int = 420  # of training, whatever the sample's size
    bags: int = 64
    drawn: int = 4  # windows of a document in a step
    rate: float = 0.01
    seed: int = 5


#: ASCII punctuation separates words, as white space does.
SEPARATE = bytes(32 if 9 <= c < 14 or 33 <= c < 48 or 58 <= c < 65 or 91 <= c < 97 or 123 <= c < 127 else c for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").lower().encode().translate(SEPARATE).split()


def word_parts(text: str | None, size: int = 1 << 16) -> Iterator[list[bytes]]:
    """The words in order, those of about ``size`` bytes at a time; at least one part."""
    data, at = (text or "").lower().encode().translate(SEPARATE), 0
    while len(data) - at > size and (cut := data.find(b" ", at + size)) >= 0:
        yield data[at:cut].split()
        at = cut
    yield data[at:].split()


def features(words: list[bytes], s: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per word the bucket of its hash; the buckets of its 3- to 5-grams of bytes with ends marked, all in one array; how many each has."""
    marked = [b"^" + w + b"$" for w in words]
    size = np.array([len(w) for w in marked], dtype=np.int64)
    data = np.frombuffer(b"".join(marked), dtype=np.uint8).astype(np.uint64)
    first = np.cumsum(size) - size
    word = np.repeat(np.arange(len(words)), size)
    left = np.repeat(first + size, size) - np.arange(len(data))  # bytes of the word from here on
    at = (size[word] - left).astype(np.uint64)
    mix = lambda h, n: ((h ^ h >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(33)).astype(np.int64) % n
    with np.errstate(over="ignore"):
        power = np.multiply.accumulate(np.full(max(1, int(size.max(initial=1))), 0x9E3779B97F4A7C15, dtype=np.uint64))
        whole = np.add.reduceat((data + np.uint64(1)) * power[at.astype(np.int64)], first)
        h, grams, owner = data + np.uint64(1), [], []
        for n in range(2, 6):
            h = h[:-1] * np.uint64(0x100000001B3) + data[n - 1 :] + np.uint64(n)
            if n > 2:
                ok = left[: len(h)] >= n
                grams.append(mix(h[ok], s.gram_buckets))
                owner.append(word[: len(h)][ok])
    owner = np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    return mix(whole, s.word_buckets), np.concatenate(grams)[order], np.bincount(owner, minlength=len(words))


def starts(n: int, s: Settings) -> list[int]:
    """First words of the windows: every ``stride`` words, until a window reaches the end."""
    return list(range(0, max(1, n - s.window + s.stride), s.stride)) if n > s.window else [0]


class Vocabulary:
    """Numbers words as they come."""

    def __init__(self, limit: int = 100_000):
        self.limit = limit
        self.clear()

    def clear(self) -> None:
        self.number: dict[bytes, int] = {b"": 0}
        self.words: list[bytes] = [b""]

    def ids(self, words: list[bytes]) -> np.ndarray:
        number = self.number
        found = list(map(number.get, words))
        if None in found:
            for i, n in enumerate(found):
                if n is None:
                    w = words[i]
                    n = number.setdefault(w, len(self.words))
                    if n == len(self.words):
                        self.words.append(w)
                    found[i] = n
        return np.array(found, dtype=np.int32)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


class Network:
    """Parameters and the two directions of differentiation."""

    def __init__(self, s: Settings):
        rng = np.random.default_rng(s.seed)
        h, d = s.hidden, 2 * s.size
        normal = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
        self.s = s
        self.p = {"word": normal(s.word_buckets, s.size, scale=0.05), "gram": normal(s.gram_buckets, s.size, scale=0.1), "attend": normal(2 * h, h, scale=0.3), "query": normal(h, scale=0.3), "out": normal(2 * h, scale=0.3), "bias": np.zeros(1, np.float32)}
        for way in "fb":
            self.p |= {f"x{way}": normal(d, 3 * h, scale=0.4), f"h{way}": normal(h, 3 * h, scale=0.3), f"b{way}": np.zeros(3 * h, np.float32)}
        self.calibration = (1.0, 0.0)

    def inputs(self, words: list[bytes]) -> tuple[np.ndarray, tuple]:
        """The vectors of some words, and the buckets they come from."""
        word, flat, n = features(words, self.s)
        x = np.zeros((len(words), 2 * self.s.size), np.float32)
        x[:, : self.s.size] = self.p["word"][word]
        some = np.flatnonzero(n)
        if len(some):
            sums = np.add.reduceat(self.p["gram"][flat], (np.cumsum(n) - n)[some], axis=0)
            x[some, self.s.size :] = sums / n[some, None].astype(np.float32)
        return x, (word, flat, n)

    def states(self, x: np.ndarray, mask: np.ndarray, way: str, keep: list | None = None) -> np.ndarray:
        """GRU states (time, batch, hidden) over projected inputs x (time, batch, 3 * hidden)."""
        t_max, b, h = x.shape[0], x.shape[1], self.s.hidden
        u, out, now = self.p[f"h{way}"], np.zeros((x.shape[0], x.shape[1], self.s.hidden), np.float32), np.zeros((b, h), np.float32)
        for t in range(t_max) if way == "f" else range(t_max - 1, -1, -1):
            a = now @ u
            zr = sigmoid(x[t, :, : 2 * h] + a[:, : 2 * h])
            z, r = zr[:, :h], zr[:, h:]
            n = np.tanh(x[t, :, 2 * h :] + r * a[:, 2 * h :])
            m = mask[t][:, None]
            new = n + z * (now - n)
            if keep is not None:
                keep.append((t, now, z, r, n, a[:, 2 * h :], m))
            now = now + m * (new - now)
            out[t] = now
        return out

    def forward(self, projected: dict, mask: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Logits of windows; mask is (time, batch)."""
        tapes = {w: [] for w in "fb"} if keep is not None else {"f": None, "b": None}
        s = np.concatenate([self.states(projected[w], mask, w, tapes[w]) for w in "fb"], axis=2)
        e = np.tanh(s @ self.p["attend"])
        score = np.where(mask > 0, e @ self.p["query"], np.float32(-1e9))
        a = np.exp(score - score.max(axis=0))
        a = a / a.sum(axis=0)
        c = (a[:, :, None] * s).sum(axis=0)
        if keep is not None:
            keep |= {"tapes": tapes, "s": s, "e": e, "a": a, "c": c}
        return c @ self.p["out"] + self.p["bias"]

    def backward(self, k: dict, d_logit: np.ndarray, x: np.ndarray, at: np.ndarray) -> tuple[dict, np.ndarray]:
        """Gradients of the parameters and of the word vectors x; ``at`` (time, batch) numbers the rows of x."""
        p, h = self.p, self.s.hidden
        g = {"out": k["c"].T @ d_logit, "bias": d_logit.sum(keepdims=True)}
        dc = d_logit[:, None] * p["out"]
        s, a, e = k["s"], k["a"], k["e"]
        ds = a[:, :, None] * dc
        da = (s * dc).sum(axis=2)
        d_score = a * (da - (a * da).sum(axis=0))
        g["query"] = np.einsum("tbh,tb->h", e, d_score)
        d_pre = d_score[:, :, None] * p["query"] * (1 - e * e)
        g["attend"] = np.einsum("tbi,tbj->ij", s, d_pre)
        ds = ds + d_pre @ p["attend"].T
        dx = np.zeros_like(x)
        for w, cut in (("f", slice(0, h)), ("b", slice(h, 2 * h))):
            u = p[f"h{w}"]
            du, grad, carry = np.zeros_like(u), np.zeros((*at.shape, 3 * h), np.float32), np.zeros((at.shape[1], h), np.float32)
            for t, was, z, r, n, an, m in reversed(k["tapes"][w]):
                d = carry + ds[t][:, cut]
                dm = m * d
                dn = dm * (1 - z) * (1 - n * n)
                dz = dm * (was - n) * z * (1 - z)
                dr = dn * an * r * (1 - r)
                inner = np.concatenate([dz, dr, dn * r], axis=1)
                carry = d - dm + dm * z + inner @ u.T
                du += was.T @ inner
                grad[t] = np.concatenate([dz, dr, dn], axis=1)
            g[f"h{w}"] = du
            flat = grad.reshape(-1, 3 * h)
            g[f"b{w}"] = flat.sum(axis=0)
            by_word = np.zeros((len(x), 3 * h), np.float32)
            np.add.at(by_word, at.reshape(-1), flat)
            g[f"x{w}"] = x.T @ by_word
            dx += by_word @ p[f"x{w}"].T
        return g, dx


def fit(texts: list[str], labels: list[int], s: Settings = Settings()) -> Network | None:
    """Train on whole documents in memory; None without both classes."""
    net = fit_parts(([words_of(t)] for t in texts), labels, s)
    if net is not None:
        net.calibration = _calibrate(Scorer(net).logits(texts), np.array(labels, dtype=np.float32))
    return net


def fit_parts(parts: Iterable[list[list[bytes]]], labels: list[int], s: Settings = Settings()) -> Network | None:
    """A network that isn't calibrated yet, trained on the windows of each document's parts; None without both classes."""
    y = np.array(labels, dtype=np.float32)
    if not len(y) or y.min() == y.max():
        return None
    net, voc, rng = Network(s), Vocabulary(), np.random.default_rng(s.seed + 1)
    docs = [[ids[j : j + s.window] for ids in map(voc.ids, p) for j in starts(len(ids), s)] for p in parts]
    first, second, step = ({k: np.zeros_like(v) for k, v in net.p.items()} for _ in range(2)), None, 0
    first, second = first
    weight = np.where(y > 0, min(4.0, (len(y) - y.sum()) / y.sum()) ** 0.5, 1.0).astype(np.float32)
    while step < s.steps:
        order = rng.permutation(len(docs))
        for i in range(0, len(order), s.bags):
            bag = order[i : i + s.bags]
            rate = s.rate * max(0.02, 1 - step / s.steps) ** 0.5
            windows, owner = [], []
            for d in bag:
                n = len(docs[d])
                for j in range(n) if n <= s.drawn else rng.choice(n, s.drawn, replace=False):
                    windows.append(docs[d][j])
                    owner.append(d)
            owner = np.array(owner)
            at, mask = _padded(windows, s.window)
            mask = mask * (rng.random(mask.shape) > 0.05)
            mask[0] = 1
            numbers, at = np.unique(at, return_inverse=True)
            at = at.reshape(mask.shape)
            x, (words, flat, n) = net.inputs([voc.words[i] for i in numbers])
            projected = {w: (x @ net.p[f"x{w}"] + net.p[f"b{w}"])[at] for w in "fb"}
            tape: dict = {}
            logit = net.forward(projected, mask, tape)
            d_logit = np.zeros_like(logit)
            for d in bag:
                mine = np.flatnonzero(owner == d)
                if y[d] > 0:
                    mine = mine[[logit[mine].argmax()]]
                d_logit[mine] = weight[d] * (sigmoid(logit[mine]) - y[d]) / len(mine) ** 0.5
            g, dx = net.backward(tape, (d_logit / len(bag)).astype(np.float32), x, at)
            g["word"], g["gram"] = np.zeros_like(net.p["word"]), np.zeros_like(net.p["gram"])
            np.add.at(g["word"], words, dx[:, : s.size])
            np.add.at(g["gram"], flat, np.repeat(dx[:, s.size :] / np.maximum(n, 1)[:, None].astype(np.float32), n, axis=0))
            step += 1
            norm = np.sqrt(sum(float((v * v).sum()) for v in g.values()))
            for k, v in g.items():
                v = v * min(1.0, 5.0 / (norm + 1e-9)) + (1e-5 * net.p[k] if k in ("word", "gram") else 0)
                first[k] += 0.1 * (v - first[k])
                second[k] += 0.01 * (v * v - second[k])
                net.p[k] -= (rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return net


def _calibrate(raw: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Shift the strongest window's logit so that 0 is the cut with the fewest weighted errors, in the middle of the gap."""
    order = np.argsort(raw, kind="stable")
    v, t = raw[order], y[order]
    wrong = np.concatenate([[0.0], np.cumsum(t)]) + np.concatenate([np.cumsum((1 - t)[::-1])[::-1], [0.0]])
    best = np.flatnonzero(wrong == wrong.min())
    cuts = [v[0] - 1 if i == 0 else v[-1] + 1 if i == len(v) else (v[i - 1] + v[i]) / 2 for i in best]
    return 1.0, -float(np.median(cuts))


def _padded(windows: list[np.ndarray], size: int) -> tuple[np.ndarray, np.ndarray]:
    at = np.zeros((len(windows), size), dtype=np.int32)
    mask = np.zeros((len(windows), size), dtype=np.float32)
    for i, w in enumerate(windows):
        at[i, : len(w)], mask[i, : max(1, len(w))] = w, 1
    return at.T, np.ascontiguousarray(mask.T)


class Scorer:
    """Scores whole texts with a trained network; words are projected once each."""

    def __init__(self, net: Network, block: int = 512):
        self.net, self.block = net, block
        self.voc = Vocabulary()
        self.table = {w: np.zeros((0, 3 * net.s.hidden), np.float32) for w in "fb"}
        self.done = 0

    def _grow(self) -> None:
        n = len(self.voc.words)
        if n == self.done:
            return
        x, _ = self.net.inputs(self.voc.words[self.done : n])
        for w in "fb":
            new = x @ self.net.p[f"x{w}"] + self.net.p[f"b{w}"]
            if n > len(self.table[w]):
                grown = np.zeros((max(len(self.table[w]) * 3 // 2, n, 4096), new.shape[1]), np.float32)
                grown[: self.done] = self.table[w][: self.done]
                self.table[w] = grown
            self.table[w][self.done : n] = new
        self.done = n

    def logits(self, texts: list[str | None]) -> np.ndarray:
        """The strongest window's logit of each text."""
        s, out = self.net.s, np.full(len(texts), -np.inf)
        windows, owner = [], []

        def flush() -> None:
            if not windows:
                return
            order = np.argsort([len(w) for w in windows], kind="stable")
            self._grow()
            for i in range(0, len(order), self.block):
                part = order[i : i + self.block]
                size = max(1, max(len(windows[j]) for j in part))
                at, mask = _padded([windows[j] for j in part], size)
                got = self.net.forward({w: self.table[w][at] for w in "fb"}, mask)
                np.maximum.at(out, [owner[j] for j in part], got)
            windows.clear()
            owner.clear()

        for d, text in enumerate(texts):
            ids, whole = np.zeros(0, np.int32), 0  # words from the next window's start on; windows so far
            for words in word_parts(text):
                if len(self.voc.words) > self.voc.limit:
                    flush()
                    held = [self.voc.words[i] for i in ids]
                    self.voc.clear()
                    self.done = 0
                    ids = self.voc.ids(held)
                new = self.voc.ids(words)
                ids = np.concatenate([ids, new]) if len(ids) else new
                full = range(0, len(ids) - s.window + 1, s.stride)
                for j in full:
                    windows.append(ids[j : j + s.window])
                    owner.append(d)
                ids, whole = ids[len(full) * s.stride :], whole + len(full)
                if len(windows) >= 4 * self.block:
                    flush()
            if not whole or len(ids) > s.window - s.stride:
                windows.append(ids)
                owner.append(d)
        flush()
        return out

    def scores(self, texts: list[str | None]) -> np.ndarray:
        a, b = self.net.calibration
        return sigmoid(a * self.logits(texts) + b)


def training_rows(docs: DataFrame, labels: DataFrame, s: Settings = Settings()) -> DataFrame:
    """doc_id, text, toxic of a bounded sample of labelled documents by a hash of the id, held-out ids (crc32 of the id's text mod 5 = 0) left out."""
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).withColumn("by", F.xxhash64(F.lit(s.seed), "doc_id"))
    chosen = known.where("toxic = 1").orderBy("by", "doc_id").limit(s.positives).unionByName(known.where("toxic = 0").orderBy("by", "doc_id").limit(s.negatives))
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))


def excerpt(text: str | None, most: int, seed: list[int], s: Settings) -> list[bytes]:
    """The words of a text of up to ``most`` windows, as one part; of a longer one that many of its windows, each a part."""
    at = starts(sum(map(len, word_parts(text))), s)
    if len(at) <= most:
        return [b" ".join(words_of(text))]
    at = np.sort(np.random.default_rng(seed).choice(at, most, replace=False))
    out, held, first = [], [], 0
    for words in word_parts(text):
        held += words
        for j in at[len(out) :].tolist():
            if j + s.window > first + len(held):
                break
            out.append(b" ".join(held[j - first : j - first + s.window]))
        past = min(len(held), int(at[len(out)]) - first) if len(out) < most else len(held)
        del held[:past]
        first += past
    return out + [b" ".join(held[j - first : j - first + s.window]) for j in at[len(out) :].tolist()]


def train(docs: DataFrame, labels: DataFrame, s: Settings = Settings()) -> Network | None:
    """Fitted on the driver on at most about as many windows as training draws; the calibration's logits come from the tasks."""
    rows = written(training_rows(docs, labels, s), "toxicity-sample")
    most = -(-s.steps * s.bags * s.drawn // max(1, rows.count()))

    def parts(batches):
        for b in batches:
            got = [excerpt(t, most, [s.seed, i % (1 << 64)], s) for i, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("toxic"), pa.array(got, pa.list_(pa.binary()))], ["doc_id", "toxic", "parts"])

    def by_id(df: DataFrame, column: str) -> tuple[list, list]:
        got = sorted(((r["doc_id"], r["toxic"], r[column]) for r in df.toLocalIterator()), key=lambda r: r[0])
        return [r[2] for r in got], [r[1] for r in got]

    one = dict(rows.dtypes)
    texts, y = by_id(arrow_map(rows, parts, f"doc_id {one['doc_id']}, toxic {one['toxic']}, parts array<binary>"), "parts")
    net = fit_parts(([p.split() for p in t] for t in texts), y, s)
    if net is not None:
        shared = share(rows.sparkSession, Scorer(net))

        def logits(batches):
            for b in batches:
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("toxic"), pa.array(shared().logits(b.column("text").to_pylist()))], ["doc_id", "toxic", "logit"])

        raw, y = by_id(arrow_map(rows, logits, f"doc_id {one['doc_id']}, toxic {one['toxic']}, logit double"), "logit")
        net.calibration = _calibrate(np.round(raw, 4), np.array(y, dtype=np.float32))  # rounded, since a logit's last bits vary with its batch
    discard(rows)
    return net


def _scoring(net: Network | None, spark):
    shared = share(spark, net and Scorer(net))

    def score(texts: list) -> np.ndarray:
        scorer = shared()
        return np.zeros(len(texts)) if scorer is None else scorer.scores(texts)

    return score


def score_documents(docs: DataFrame, net: Network | None) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    score = _scoring(net, docs.sparkSession)

    def run(batches):
        for b in batches:
            ids = b.column("doc_id").to_pylist()
            got = score(b.column("text").to_pylist())
            held = [i is not None and zlib.crc32(str(i).encode()) % 5 == 0 for i in ids]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(held, pa.bool_()), pa.array(got, pa.float64()), pa.array((got >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return arrow_map(docs.select("doc_id", "text"), run, "doc_id long, held_out boolean, score double, predicted int")


def drop_toxic(docs: DataFrame, net: Network | None) -> DataFrame:
    """The documents with a score below 0.5, with all their columns."""
    score = _scoring(net, docs.sparkSession)

    def run(batches):
        for b in batches:
            got = score(b.column("text").to_pylist())
            yield b.filter(pa.array(got < 0.5))

    return arrow_map(docs, run, docs.schema)
