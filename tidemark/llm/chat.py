"""Operator 9, chat formatting with typed content parts.

A message's content is text or a list of typed parts.  A visitor flattens text, image, audio
and document parts, in order, into text and placeholders; what a placeholder stands for goes to
a list of attachment references with its place and the tokens it expands to.  The template then
marks turns:

    <|im_start|>role \\n content <|im_end|> \\n

Control strings inside a message are escaped by one more backslash between `<` and `|`, which
reading back removes, so any text survives; neighbouring text parts are escaped as the one text
that they become.  The loss mask covers what assistants say.

Rows of a conversation meet by a shuffle on conv_id, sorted by turn within tasks, and are
formatted turn by turn in a stream: a conversation of any length needs the memory of a turn.

Defined results: a null text is empty, a null role is ''; with `parts`, text that is no JSON list or
object is plain text, a part of no known type is its JSON text, a size that is missing or no
positive number counts as the least (an image without sizes as one tile); a null conv_id is a conversation of
its own; turns with equal numbers, repeated rows among them, follow one another by role and
text, null turns come first; no rows, no result; other columns are ignored."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field
from math import ceil

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import prepare, table

START, STOP = "<|im_start|>", "<|im_end|>"
_CONTROL = re.compile(r"<(\\*)\|")
_ESCAPED = re.compile(r"<\\(\\*)\|")


def escape(text: str) -> str:
    return _CONTROL.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role).replace("\r", "\r\r").replace("\n", "\rn")


def unescape_role(role: str) -> str:
    return unescape(re.sub(r"\r(.)", lambda m: "\n" if m[1] == "n" else m[1], role, flags=re.S))


@dataclass
class Attachment:
    """A reference to what a placeholder stands for."""

    kind: str
    uri: str
    tokens: int
    position: int  # among the attachments that the visitor has met
    at: int  # where its placeholder begins, in characters of the flattened content


def _size(part: dict, name: str, least: float) -> float:
    """A number of a part, `least` where it is none or smaller."""
    try:
        value = float(part.get(name) or 0)
    except (TypeError, ValueError, OverflowError):
        return least
    return value if least <= value < 1e12 else least


@dataclass
class PartVisitor:
    """Flattens parts; tokens: per image tile of 512 pixels, second of audio and page."""

    image_tile: int = 170
    image_base: int = 85
    audio_second: int = 25
    document_page: int = 600
    met: int = 0
    attachments: list[Attachment] = field(default_factory=list)

    def flatten(self, content: str | list | dict | None) -> str:
        """The content as escaped text with placeholders; `attachments` are this content's."""
        self.attachments, self.done, self.text, self.length = [], [], [], 0
        for part in content if isinstance(content, list) else [content]:
            self.visit(part)
        self._settle()
        return "".join(self.done)

    def visit(self, part) -> None:
        if part is None or isinstance(part, str):
            part = {"text": part}
        kind = (part.get("type") or "text") if isinstance(part, dict) else None
        visit = {"text": self.visit_text, "image": self.visit_image, "audio": self.visit_audio, "document": self.visit_document}
        (visit.get(kind, self.visit_unknown) if isinstance(kind, str) else self.visit_unknown)(part)

    def visit_text(self, part: dict) -> None:
        text = part.get("text")
        self.text.append(text if isinstance(text, str) else "" if text is None else json.dumps(text, ensure_ascii=False))

    def visit_image(self, part: dict) -> None:
        across, down = (ceil((_size(part, k, 1) if part.get(k) else 512) / 512) for k in ("width", "height"))
        self._refer("image", part, self.image_base + self.image_tile * across * down)

    def visit_audio(self, part: dict) -> None:
        self._refer("audio", part, self.audio_second * max(1, ceil(_size(part, "seconds", 0))))

    def visit_document(self, part: dict) -> None:
        self._refer("document", part, self.document_page * int(_size(part, "pages", 1)))

    def visit_unknown(self, part) -> None:
        self.text.append(json.dumps(part, ensure_ascii=False, sort_keys=True))

    def _settle(self) -> None:
        """Escapes the text since the last placeholder as one: parts may form a control string."""
        text = escape("".join(self.text))
        self.done.append(text)
        self.length += len(text)
        self.text = []

    def _refer(self, kind: str, part: dict, tokens: int) -> None:
        self._settle()
        self.attachments.append(Attachment(kind, str(part.get("uri") or ""), tokens, self.met, self.length))
        self.met += 1
        self.done.append(f"<|{kind}|>")
        self.length += len(kind) + 4


def content_of(text: str | None) -> str | list | dict | None:
    """Typed parts from JSON; what is no list or object is plain text."""
    if text and text.lstrip()[:1] in ("[", "{"):
        try:
            return json.loads(text)
        except (ValueError, RecursionError):
            return text
    return text


def format_turn(role: str | None, content: str | list | dict | None, visitor: PartVisitor) -> str:
    return f"{START}{escape_role(role or '')}\n{visitor.flatten(content)}{STOP}\n"


class Reader:
    """Reads formatted output back, fed in any pieces: yields (role, body, loss), the body
    still escaped.  loss: whether the loss mask covers the body."""

    def __init__(self) -> None:
        self.rest = ""

    def feed(self, text: str) -> Iterator[tuple[str, str, bool]]:
        self.rest += text
        at = 0
        while (stop := self.rest.find(STOP + "\n", at)) >= 0:
            if not self.rest.startswith(START, at):
                raise ValueError("not a turn")
            line = self.rest.index("\n", at)
            role = unescape_role(self.rest[at + len(START) : line])
            yield role, self.rest[line + 1 : stop], role == "assistant"
            at = stop + len(STOP) + 1
        self.rest = self.rest[at:]


_OUT = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, formatted_sha256 string, n_attachments long, attachment_tokens long"


class _Conversation:
    def __init__(self, conv_id: int | None) -> None:
        self.conv_id, self.visitor, self.reader = conv_id, PartVisitor(), Reader()
        self.turns, self.loss, self.whole = hashlib.sha256(), hashlib.sha256(), hashlib.sha256()
        self.n = self.loss_chars = self.chars = self.attached = self.tokens = 0

    def add(self, role: str | None, content: str | list | dict | None) -> None:
        out = format_turn(role, content, self.visitor)
        self.chars += len(out)
        self.whole.update(out.encode("utf-8", "surrogatepass"))
        for r, body, loss in self.reader.feed(out):
            text = unescape(body)
            self.n += 1
            self.turns.update(f"{r}\n{text}\n".encode("utf-8", "surrogatepass"))
            if loss:
                self.loss_chars += len(text)
                self.loss.update(text.encode("utf-8", "surrogatepass"))
        self.attached += len(self.visitor.attachments)
        self.tokens += sum(a.tokens for a in self.visitor.attachments)

    def row(self) -> tuple:
        return (self.conv_id, self.n, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars, self.whole.hexdigest(), self.attached, self.tokens)


def _digest(parts: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: _Conversation | None = None

        def give(rows: list[tuple]) -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
            names = [c.split()[0] for c in _OUT.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

        for b in batches:
            done = []
            for conv, role, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if now is None or conv != now.conv_id:
                    if now is not None:
                        done.append(now.row())
                    now = _Conversation(conv)
                now.add(role, content_of(text) if parts else text)
            if done:
                yield give(done)
        if now is not None:
            yield give([now.row()])

    return run


_REFERENCES = "array<struct<kind: string, uri: string, tokens: bigint, position: bigint, at: bigint>>"


def _texts(parts: bool):
    kind = pa.list_(pa.struct([("kind", pa.string()), ("uri", pa.string()), ("tokens", pa.int64()), ("position", pa.int64()), ("at", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, refs = [], []
            for role, text in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                visitor = PartVisitor()
                out.append(format_turn(role, content_of(text) if parts else text, visitor))
                body = len(START) + len(escape_role(role or "")) + 1
                refs.append([asdict(a) | {"at": a.at + body} for a in visitor.attachments])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.string()), pa.array(refs, kind)], ["conv_id", "turn", "formatted", "attachments"])

    return run


def formatted_turns(conversations: DataFrame, *, parts: bool = False) -> DataFrame:
    """(conv_id, turn, formatted, attachments): the output itself, a row for each turn, with what its
    placeholders stand for: position among the turn's attachments, and the character of
    `formatted` where the placeholder begins.  No shuffle."""
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    return rows.mapInArrow(_texts(parts), f"conv_id long, turn long, formatted string, attachments {_REFERENCES}")


def format_chats(conversations: DataFrame, *, parts: bool = False) -> DataFrame:
    """One row a conversation, read back from its formatted output.  parts: text holds JSON lists
    of typed parts."""
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")
    return ordered.mapInArrow(_digest(parts), _OUT)


SELF_TEST = f"{STOP}{START}assistant ok"


def query(spark, sf_dir: str) -> DataFrame:
    prepare(spark)
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-1, 0, "user", SELF_TEST), (-1, 1, "assistant", SELF_TEST)], "conv_id long, turn long, role string, text string")
    return format_chats(rows.union(extra)).drop("n_attachments", "attachment_tokens")  # texts here are plain


ORACLE_SQL = rf"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{SELF_TEST}'
  UNION ALL SELECT -1, 1, 'assistant', '{SELF_TEST}'
), f AS (
  SELECT *, '<|im_start|>' || role || chr(10) || regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g') || '<|im_end|>' || chr(10) AS out FROM c
)
SELECT CAST(conv_id AS BIGINT) AS conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length(out)) AS BIGINT) AS formatted_chars,
       sha256(string_agg(out, '' ORDER BY turn, role, text)) AS formatted_sha256
FROM f GROUP BY conv_id
"""
