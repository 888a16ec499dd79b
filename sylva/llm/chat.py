"""Chat formatting with typed content parts.

A message's content is a list of typed parts. A visitor walks them in order and
flattens every part to text: text parts are escaped, attachments (image, audio,
document) become numbered placeholders such as ``<|image:1|>``; what they refer to, where, and
how many tokens a model spends on them is recorded beside the text.

The template is ``<|im_start|>role``, newline, content, ``<|im_end|>``, newline.
``<|`` never occurs inside escaped text: a backslash becomes two, and ``<|``
becomes ``<\\|``; in roles a newline becomes ``\\n``. So ``parse_chat`` reads the
turns back from the output alone, whatever the texts contain.

A conversation is formatted by streaming its turns in order through one task
with constant memory (a digest over the whole conversation is sequential by
definition); formatting of a turn looks at that turn only.

Null texts are empty, a null role too; null conv_ids form one conversation;
equal turn numbers are ordered by role and text, repeated rows are turns of their own. Texts of any
length are whole. An empty table gives no rows. Only conv_id, turn, role and text are read, so other columns may have any name.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sylva.llm.common import arrow_map

START, END = "<|im_start|>", "<|im_end|>"


def escape(text: str, role: bool = False) -> str:
    text = text.replace("\\", "\\\\").replace("<|", "<\\|")
    return text.replace("\n", "\\n") if role else text


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], text, flags=re.S)


@dataclass
class Attachment:
    kind: str
    ref: str
    number: int  # of this kind in the conversation, from 1
    offset: int  # of its placeholder in the formatted text
    tokens: int


@dataclass
class PartVisitor:
    """Flattens content parts in order; one instance a conversation, so placeholders are numbered through."""

    attachments: list[Attachment] = field(default_factory=list)
    counts: dict[str, int] = field(default_factory=dict)
    image_tile: int = 512
    tokens_per_tile: int = 170
    tokens_per_second: int = 25
    tokens_per_page: int = 800

    def visit(self, part: dict, offset: int) -> str:
        kind = part.get("type") or "text"
        if kind == "text":
            return escape(part.get("text") or "")
        size = getattr(self, f"size_{kind}", None)
        if size is None:
            raise ValueError(f"unknown part type {kind!r}")
        number = self.counts[kind] = self.counts.get(kind, 0) + 1
        self.attachments.append(Attachment(kind, part.get("ref") or "", number, offset, size(part)))
        return f"<|{kind}:{number}|>"

    def size_image(self, part: dict) -> int:
        across, down = (max(1, math.ceil((part.get(k) or self.image_tile) / self.image_tile)) for k in ("width", "height"))
        return across * down * self.tokens_per_tile

    def size_audio(self, part: dict) -> int:
        return max(1, math.ceil((part.get("seconds") or 1) * self.tokens_per_second))

    def size_document(self, part: dict) -> int:
        return max(1, part.get("pages") or 1) * self.tokens_per_page


def parts_of(content: str | None) -> list[dict]:
    """A JSON list of parts, or else plain text."""
    if content and content.lstrip().startswith("["):
        try:
            found = json.loads(content)
        except ValueError:
            found = None
        if isinstance(found, list) and found and all(isinstance(x, dict) and x.get("type") in ("text", "image", "audio", "document") for x in found):
            return found
    return [{"type": "text", "text": content or ""}]


@dataclass
class ChatFormatter:
    """Formats the turns of one conversation; ``spans`` are those of the loss mask: the contents of assistant turns."""

    visitor: PartVisitor = field(default_factory=PartVisitor)
    length: int = 0
    spans: list[tuple[int, int]] = field(default_factory=list)

    def turn(self, role: str, parts: list[dict]) -> str:
        out = f"{START}{escape(role, role=True)}\n"
        begin = len(out)
        for part in parts:
            out += self.visitor.visit(part, self.length + len(out))
        if role == "assistant":
            self.spans.append((self.length + begin, self.length + len(out)))
        out += f"{END}\n"
        self.length += len(out)
        return out


def parse_chat(text: str) -> Iterator[tuple[str, str, tuple[int, int]]]:
    """The turns of a formatted text: role, content with placeholders (text unescaped), span of the content."""
    at = 0
    while at < len(text):
        if not text.startswith(START, at):
            raise ValueError(f"no turn starts at {at}")
        line = text.index("\n", at)
        end = text.index(END, line + 1)
        yield unescape(text[at + len(START) : line]), unescape(text[line + 1 : end]), (line + 1, end)
        at = end + len(END) + 1


def _ordered(conversations: DataFrame) -> DataFrame:
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def format_conversations(conversations: DataFrame, typed_parts: bool = True) -> DataFrame:
    """The formatted turns in order: conv_id, turn, formatted, begin and end of the loss span in the conversation's text (or null), attachments.

    With ``typed_parts`` a text that is a JSON list of parts is read as such.
    """

    def run(batches):
        conv, chat, begun = None, None, False
        for b in batches:
            rows = []
            for c, t, role, text in zip(*(b.column(k).to_pylist() for k in ("conv_id", "turn", "role", "text")), strict=True):
                if not begun or c != conv:
                    conv, chat, begun = c, ChatFormatter(), True
                spans, known = len(chat.spans), len(chat.visitor.attachments)
                out = chat.turn(role, parts_of(text) if typed_parts else [{"type": "text", "text": text}])
                span = chat.spans[-1] if len(chat.spans) > spans else (None, None)
                rows.append((c, t, out, *span, [vars(a) for a in chat.visitor.attachments[known:]]))
            cols = list(zip(*rows, strict=True)) or [[]] * 6
            types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.list_(pa.struct([("kind", pa.string()), ("ref", pa.string()), ("number", pa.int32()), ("offset", pa.int64()), ("tokens", pa.int64())]))]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, types, strict=True)], ["conv_id", "turn", "formatted", "loss_begin", "loss_end", "attachments"])

    schema = "conv_id long, turn long, formatted string, loss_begin long, loss_end long, attachments array<struct<kind:string,ref:string,number:int,offset:long,tokens:long>>"
    return arrow_map(_ordered(conversations), run, schema)


class _Digest:
    def __init__(self, conv):
        self.conv, self.turns, self.loss_chars, self.chars, self.attachments, self.tokens = conv, 0, 0, 0, 0, 0
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, formatted: str, begin: int | None, end: int | None, attachments: list) -> None:
        for role, text, span in parse_chat(formatted):
            self.turns += 1
            self.all.update(f"{role}\n{text}\n".encode())
            if begin is not None:
                lost = unescape(formatted[begin - self.chars : end - self.chars])
                self.loss.update(lost.encode())
                self.loss_chars += len(lost)
        self.chars += len(formatted)
        self.attachments += len(attachments)
        self.tokens += sum(a["tokens"] for a in attachments)

    def row(self) -> tuple:
        return self.conv, self.turns, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars, self.attachments, self.tokens


def conversation_digests(conversations: DataFrame, typed_parts: bool = False) -> DataFrame:
    """What is read back from the formatted output, per conversation."""

    def run(batches):
        own = None
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_attachments", "attachment_tokens"]
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
        table = lambda rows: pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names)
        for b in batches:
            rows = []
            for c, *x in zip(*(b.column(k).to_pylist() for k in ("conv_id", "formatted", "loss_begin", "loss_end", "attachments")), strict=True):
                if own is None or own.conv != c:
                    if own is not None:
                        rows.append(own.row())
                    own = _Digest(c)
                own.add(*x)
            if rows:
                yield table(rows)
        if own is not None:
            yield table([own.row()])

    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_attachments long, attachment_tokens long"
    return arrow_map(format_conversations(conversations, typed_parts), run, schema)
