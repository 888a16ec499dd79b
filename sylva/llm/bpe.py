"""Byte-level BPE as a lazily determinised finite-state transducer.

BPE encodings have two properties: a prefix of an encoding is the encoding of
its bytes, and a token sequence is an encoding if every adjacent pair encodes to
itself. So the encoding of a longer prefix is that of a shorter one plus one
token compatible with its last. The non-deterministic machine follows a trie of
the vocabulary from every prefix boundary; a state of the determinised machine
is the set of live branches: for each, the token before it and the trie
node reached since. A transition outputs the token that ends at the byte read, the
last one of that prefix's encoding; tokens are emitted when the encodings up to
all live branches agree, so the output lags the input by a bounded lookahead (a
branch dies when no token continues it, at most the longest token's bytes).
States and transitions are built when first needed and dropped when there are
``max_states``. What a branch is preceded by matters only for the tokens still below
its trie node: where these are few, branches that the same ones may continue share a
predecessor, and a branch that none may continue is dropped, so there are fewer states.

The pieces of a batch that aren't known are walked in order, so that those with a
common beginning walk it once. Pieces met lately keep their ids, packed: when half of
``max_pieces`` are new, they become the old half, and old ones not met again are dropped.

Pairs are checked on the merge trees of their two tokens. As in the
reference tokenizer, a piece that is itself a token is that token.

Decoding runs an incremental UTF-8 machine over tokens: its state is the number
of pending bytes; transitions over whole tokens are memoised. Ill-formed bytes
become U+FFFD as in ``bytes.decode(errors="replace")``.

Null texts count as empty (no tokens). Long texts, and long pieces inside them,
take linear time. Repeated rows get equal rows. An empty table gives no rows. Only
doc_id and text are read, so other columns may have any name.
"""

from __future__ import annotations

import base64
import codecs
import hashlib
from array import array
from collections.abc import Iterable, Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame

from sylva.llm.common import arrow_map, per_process


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


#: Branches with at most so many tokens below them are merged if they go on alike.
FEW = 8

#: Bits of a state's number and a byte; more than 2 ** 22 states aren't kept.
SHIFT = 30
STATE = (1 << SHIFT) - 1


class Transducer:
    """Encodes bytes to token ids. One instance per process; it holds caches."""

    def __init__(self, ranks: dict[bytes, int], max_states: int = 100_000, max_pieces: int = 400_000, max_pairs: int = 150_000):
        self.ranks, self.max_states, self.max_pieces, self.max_pairs = ranks, min(max_states, 1 << SHIFT - 8), max_pieces, max_pairs
        self.bytes_of = {i: t for t, i in ranks.items()}
        self.child: dict[int, int] = {}  # node << 8 | byte -> node
        self.token_at, self.depth = [-1], [0]  # by node
        self.order = array("i", (ranks[token] for token in sorted(ranks)))  # the tokens below a node stand together
        self.first, self.past = array("i", [0]), array("i", [0])  # by node, in ``order``: those below it
        for at, i in enumerate(self.order):
            node, token = 0, self.bytes_of[i]
            for b in token:
                self.past[node] = at + 1
                nxt = self.child.get(node << 8 | b)
                if nxt is None:
                    nxt = self.child[node << 8 | b] = len(self.token_at)
                    self.token_at.append(-1)
                    self.depth.append(self.depth[node] + 1)
                    self.first.append(at)
                    self.past.append(at)
                node = nxt
            self.token_at[node] = i
            self.first[node] = self.past[node] = at + 1
        self.length = {i: len(t) for t, i in ranks.items()}
        self.own: dict[int, bool] = {}
        self.pairs: dict[int, bool] = {}
        self.spines: dict[int, dict[int, list]] = {0: {}, -1: {}}
        self.pieces: dict[str, bytes] = {}  # ids as the bytes of an array("I")
        self.old_pieces: dict[str, bytes] = {}
        self._forget()

    def _forget(self) -> None:
        # a state: its live branches by their start, each (token before its start) + 1 << 24 | trie node, as the bytes of an array("q")
        self.keys = [array("q", [0]).tobytes()]
        self.states = {self.keys[0]: 0}
        self.alike: dict[int, int] = {}  # node << FEW | which tokens below it may follow -> token before + 1
        self.moves: dict[int, int] = {}  # state << 8 | byte -> token that ends here << SHIFT | next state << 8

    def merge(self, data: bytes, stop: int = 1) -> list[bytes]:
        """Plain BPE down to ``stop`` parts: merge the adjacent pair of the lowest rank, leftmost first. For single tokens."""
        parts, ranks = [data[i : i + 1] for i in range(len(data))], self.ranks
        while len(parts) > stop:
            best, at = None, 0
            for i in range(len(parts) - 1):
                r = ranks.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _spine(self, token: int, side: int) -> list[tuple[bytes, float]]:
        """What stands at the token's left (0) or right (-1) end while it is merged, each with the rank of the merge that consumes it."""
        got = self.spines[side].get(token)
        if got is None:
            data, until, got = self.bytes_of[token], float("inf"), []
            while True:
                got.append((data, until))
                if len(data) == 1:
                    break
                until, data = self.ranks[data], self.merge(data, 2)[side]
            self.spines[side][token] = got
        return got

    def compatible(self, a: int, b: int) -> bool:
        """Do the bytes of a and b encode to a, b? (a = -1: do those of b encode to b?)

        They do unless a merge across the border comes before the merges that
        consume its two sides; on equal ranks the leftmost merge comes first.
        """
        if a < 0:
            ok = self.own.get(b)
            if ok is None:
                ok = self.own[b] = len(self.merge(self.bytes_of[b])) == 1
            return ok
        ok = self.pairs.get(a << 24 | b)
        if ok is None:
            if len(self.pairs) >= self.max_pairs:
                self.pairs.clear()
            ok = self.pairs[a << 24 | b] = self.compatible(-1, b) and self.compatible(-1, a) and not self._merges(a, b)
        return ok

    def _merges(self, a: int, b: int) -> bool:
        rank, left, right = self.ranks.get, self.spines[0].get(b) or self._spine(b, 0), self.spines[-1].get(a) or self._spine(a, -1)
        for x, until_x in right:
            for y, until_y in left:
                r = rank(x + y)
                if r is not None and r < until_x and r <= until_y:
                    return True
        return False

    def _step(self, state: int, byte: int) -> int:
        """Determinise one transition: the branches that survive, and the token that ends at the new boundary."""
        if len(self.keys) >= self.max_states:
            state = self._restart(state >> 8) << 8
        alive, token, child, token_at, first, past = array("q"), -1, self.child, self.token_at, self.first, self.past
        for branch in array("q", self.keys[state >> 8]):
            to = child.get((branch & 0xFFFFFF) << 8 | byte)
            if to is None:
                continue
            before = branch >> 24
            if token < 0 and (t := token_at[to]) >= 0 and self.compatible(before - 1, t):
                token = t
            if 0 < past[to] - first[to] <= FEW and before:
                before = self._stand_in(before, to)
            if past[to] > first[to] and before >= 0:
                alive.append(before << 24 | to)
        if token < 0:
            raise ValueError("a byte has no token in the vocabulary")
        alive.append(token + 1 << 24)
        key = alive.tobytes()
        to = self.states.get(key)
        if to is None:
            to = self.states[key] = len(self.keys)
            self.keys.append(key)
        move = self.moves[state | byte] = token << SHIFT | to << 8
        return move

    def _stand_in(self, before: int, node: int) -> int:
        """For a branch's token before it (+ 1), one that the same tokens below the node may follow: 0 if all may, -1 if none."""
        every, fit, base, own, known = 0, 0, before - 1 << 24, self.own.get, self.pairs.get
        for t in self.order[self.first[node] : self.past[node]]:
            if own(t) or self.compatible(-1, t):
                every, ok = every << 1 | 1, known(base | t)
                fit = fit << 1 | (self.compatible(before - 1, t) if ok is None else ok)
        return -1 if not fit else 0 if fit == every else self.alike.setdefault(node << FEW | fit, before)

    def _restart(self, state: int) -> int:
        """Forget all states but this one; its new number."""
        key = self.keys[state]
        self._forget()
        number = self.states.setdefault(key, len(self.keys))
        if number == len(self.keys):
            self.keys.append(key)
        return number

    def stream(self, data: Iterable[int], block: int = 256) -> Iterator[int]:
        """Token ids of one piece, emitted once no later byte can change them.

        ``ends[i]`` is the last token of the encoding up to byte i, so an encoding
        is read backwards from its end. After every ``block`` bytes the tokens that
        the encodings up to all live branches share come out.
        """
        state, ends, done = 0, [-1], 0  # ends[0] stands at byte ``done``
        for n, byte in enumerate(data, 1):
            move = self.moves.get(state | byte)
            if move is None:
                move = self._step(state, byte)
            state = move & STATE
            ends.append(move >> SHIFT)
            if n % block == 0:
                chains = [self._back(ends, n - done - self.depth[branch & 0xFFFFFF]) for branch in self.keys[state >> 8]]
                size = 0
                for tokens in zip(*chains, strict=False):
                    if len(set(tokens)) > 1:
                        break
                    yield tokens[0]
                    size += self.length[tokens[0]]
                done += size
                del ends[:size]
        yield from self._back(ends, len(ends) - 1)

    def _back(self, ends: list[int], at: int) -> list[int]:
        out, length = [], self.length
        while at > 0:
            out.append(ends[at])
            at -= length[ends[at]]
        return out[::-1]

    def _walk(self, pieces: list[bytes]) -> Iterator[list[int]]:
        """What ``stream`` gives for each of some short pieces; sorted ones walk a beginning they share once."""
        last, moves, ends, length = b"", self.moves, [], self.length
        for data in pieces:
            shared = 0
            if moves is self.moves:
                for x, y in zip(data, last, strict=False):
                    if x != y:
                        break
                    shared += 1
            del ends[shared:]
            state, moves, last = ends[-1] & STATE if ends else 0, self.moves, data
            known = moves.get
            for byte in data[shared:]:
                move = known(state | byte)
                if move is None:
                    move = self._step(state, byte)
                    known = self.moves.get  # the old states are gone when it restarted, so the next piece shares nothing
                ends.append(move)
                state = move & STATE
            out, at = [], len(ends) - 1
            while at >= 0:
                token = ends[at] >> SHIFT
                out.append(token)
                at -= length[token]
            out.reverse()
            yield out

    def encode_pieces(self, texts: Iterable[str]) -> dict[str, bytes]:
        """The ids of pieces, each as the bytes of an ``array("I")``."""
        out, short, old, ranks = {}, [], self.old_pieces, self.ranks
        for text in set(texts):
            got = self.pieces.get(text) or old.get(text)
            if got is None:
                data = text.encode()
                if data in ranks:
                    got = array("I", (ranks[data],)).tobytes()
                elif len(data) <= 64:
                    short.append(data)
                    continue
                else:
                    got = array("I", self.stream(data)).tobytes()
            out[text] = got
        short.sort()
        for data, ids in zip(short, self._walk(short), strict=True):
            out[data.decode()] = array("I", ids).tobytes()
        for text, ids in out.items():
            if len(text) <= 16 or len(text.encode()) <= 64:
                if len(self.pieces) >= self.max_pieces // 2:
                    self.old_pieces, self.pieces = self.pieces, {}
                self.pieces[text] = ids
        return out

    def piece(self, text: str) -> tuple[int, ...]:
        return tuple(array("I", self.encode_pieces([text])[text]))


class Utf8Decoder:
    """Decodes token ids one at a time; text comes out as soon as its characters are whole."""

    def __init__(self, bytes_of: dict[int, bytes]):
        self.bytes_of = bytes_of
        self.memo: dict[bytes, dict[int, tuple[str, bytes]]] = {b"": {}}
        self.whole: dict[int, str] = {}  # transitions from no pending bytes to none
        for i in bytes_of:
            text, rest = self._step(b"", i)
            if not rest and "\ufffd" not in text:
                self.whole[i] = text

    def _step(self, pending: bytes, token: int) -> tuple[str, bytes]:
        machine = codecs.getincrementaldecoder("utf-8")("replace")
        text = machine.decode(pending + self.bytes_of[token])
        rest = machine.getstate()[0]
        self.memo.setdefault(rest, {})
        self.memo[pending][token] = (text, rest)
        return text, rest

    def stream(self, ids: Iterable[int]) -> Iterator[str]:
        pending = b""
        table = self.memo[pending]
        for i in ids:
            hit = table.get(i)
            text, rest = hit if hit is not None else self._step(pending, i)
            if rest != pending:
                pending, table = rest, self.memo[rest]
            yield text
        if pending:
            yield pending.decode(errors="replace")


class Codec:
    def __init__(self, path: str, pattern: str):
        import regex

        self.transducer = Transducer(read_ranks(path))
        self.split = regex.compile(pattern).findall
        self.decoder = Utf8Decoder(self.transducer.bytes_of)

    def encode(self, texts: Iterable[str]) -> Iterator[array]:
        """The ids of each text. Pieces not met lately are encoded together, so the texts should be some batch's."""
        known, found, new = self.transducer.pieces.get, [], []
        for text in texts:
            pieces = self.split(text)
            got = list(map(known, pieces))
            found.append(got)
            if None in got:
                new.append([p for p, ids in zip(pieces, got, strict=True) if ids is None])
            else:
                new.append([])
        made = self.transducer.encode_pieces(chain.from_iterable(new))
        for got, pieces in zip(found, new, strict=True):
            if pieces:
                own = map(made.__getitem__, pieces)
                got = [next(own) if ids is None else ids for ids in got]
            yield array("I", b"".join(got))

    def decode(self, ids: Iterable[int]) -> str:
        parts = list(map(self.decoder.whole.get, ids))
        return "".join(self.decoder.stream(ids) if None in parts else parts)


def codec(path: str, pattern: str) -> Codec:
    """One codec a process and vocabulary."""
    return per_process(("codec", path, pattern), lambda: Codec(path, pattern))


def encode_documents(docs: DataFrame, vocabulary: str, pattern: str, ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, digests of the ids and of the decoded bytes; with ``ids`` also the ids and the decoded text.

    ``vocabulary`` is the path of a rank file that every executor can read.
    """

    def run(batches):
        import sys

        own = codec(vocabulary, pattern)
        for b in batches:
            rows = []
            for got in own.encode(text or "" for text in b.column("text").to_pylist()):
                if sys.byteorder == "big":
                    got.byteswap()
                back = own.decode(got)
                rows.append((len(got), hashlib.sha256(got.tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest(), got if ids else None, back if ids else None))
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            out = [b.column("doc_id"), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if ids:
                out += [pa.array([list(x) for x in cols[3]], pa.list_(pa.int64())), pa.array(cols[4], pa.string())]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(out, names)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<long>, decoded string" * ids
    return arrow_map(docs.select("doc_id", "text"), run, schema)
