"""Token counts of a unigram tokenizer without its tokens.

Texts are split before every U+2581 (which replaces the space; one is put in
front), as the tokenizer's metaspace step does. In each part an Aho-Corasick
automaton lists all vocabulary matches by their end; the dynamic program keeps
per end position the best score and the piece count, no path. Ties follow the
tokenizer: matches are tried from the earliest start, only a strictly better
score replaces one. A character that is no piece costs the lowest score less 10
and comes out as its UTF-8 bytes. Scores are added in double precision, from left
to right, part by part.

Null and empty texts have no tokens and score 0. Parts of any length take linear
time; only short parts are cached. Repeated rows get equal rows. An empty table gives no
rows. Only doc_id and text are read, so other columns may have any name.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame

from sylva.llm.common import arrow_map, per_process

SPACE = "▁"
UNKNOWN_PENALTY = 10.0


def read_pieces(path: str) -> list[tuple[str, float]]:
    """The ordinary pieces of a sentencepiece file with unigram scores by rank.

    The file's own scores are merge ranks, no log probabilities, so piece r (from 0)
    gets Zipf's law instead: ``-ln((r + 2) * H)`` with H so that the sum is 1.
    """
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = [p.id_to_piece(i) for i in range(p.get_piece_size()) if not (p.is_byte(i) or p.is_control(i) or p.is_unknown(i) or p.is_unused(i))]
    h = sum(1 / (r + 2) for r in range(len(plain)))
    return [(x, -math.log((r + 2) * h)) for r, x in enumerate(plain)]


class Counter:
    def __init__(self, pieces: list[tuple[str, float]], max_parts: int = 600_000):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.single = {p for p, _ in pieces if len(p) == 1}
        self.unknown = min((s for _, s in pieces), default=0.0) - UNKNOWN_PENALTY
        self.parts: dict[str, tuple[int, float]] = {}
        self.max_parts = max_parts

    def part(self, text: str) -> tuple[int, float]:
        """(pieces, score) of the best segmentation of one part."""
        n, single, automaton = len(text), self.single, self.automaton
        if all(c in single for c in text):  # every position has a match
            best, count = [-math.inf] * (n + 1), [0] * (n + 1)
            best[0] = 0.0
            for last, (length, score) in automaton.iter(text):  # by end; the longest, so the earliest start, first
                s = best[last + 1 - length] + score
                if s > best[last + 1]:
                    best[last + 1], count[last + 1] = s, count[last + 1 - length] + 1
            return count[n], best[n]
        ends: list[list] = [[] for _ in range(n + 1)]
        for last, match in automaton.iter(text):
            ends[last + 1].append(match)
        best, count = [-math.inf] * (n + 1), [0] * (n + 1)
        best[0] = 0.0
        for end in range(1, n + 1):
            for length, score in ends[end]:
                s = best[end - length] + score
                if s > best[end]:
                    best[end], count[end] = s, count[end - length] + 1
            char = text[end - 1]
            if char not in single and best[end - 1] + self.unknown > best[end]:
                best[end], count[end] = best[end - 1] + self.unknown, count[end - 1] + len(char.encode())
        return count[n], best[n]

    def count(self, text: str) -> tuple[int, float]:
        if not text:
            return 0, 0.0
        text = text.replace(" ", SPACE)
        parts = text.split(SPACE)
        parts = parts[1:] if text[0] == SPACE else parts
        total, score, known = 0, 0.0, self.parts
        for p in parts:
            got = known.get(p)
            if got is None:
                got = self.part(SPACE + p)
                if len(p) <= 64:
                    if len(known) >= self.max_parts:
                        known.clear()
                    known[p] = got
            total += got[0]
            score += got[1]
        return total, score


def count_tokens(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_tokens and score of every document; ``vocabulary`` is a sentencepiece file that every executor can read."""

    def run(batches):
        own = per_process(("counter", vocabulary), lambda: Counter(read_pieces(vocabulary)))
        for b in batches:
            got = [own.count(t or "") for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([x for x, _ in got], pa.int64()), pa.array([s for _, s in got], pa.float64())], ["doc_id", "n_tokens", "score"])

    return arrow_map(docs.select("doc_id", "text"), run, "doc_id long, n_tokens long, score double")
