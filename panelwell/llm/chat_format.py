"""Chat formatting by rendering a black-box template turn by turn.

A template is any function from messages to text. The text of a turn's prefix is compared with the
text of the prefix before it: what is added is the turn's span. Inside it, two probe messages that
share no character show which part belongs to the frame and which to the message. A template whose
output for a longer prefix does not begin with the output for the shorter one rewrites history;
such turns are marked and have no span.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Message = tuple[str, str]
Render = Callable[[Sequence[Message]], str]


@dataclass(frozen=True)
class Template:
    """``render`` and how many earlier turns the text of a turn may depend on (None: all of them)."""

    render: Render
    context: int | None = None


# --- a template with turn marks and reversible escapes -------------------------------------------

TURN, BODY, END = "<|turn|>", "<|text|>", "<|end|>\n"
#: Strings that never appear unescaped inside a text: our marks and those of common chat templates.
CONTROL = ("<|turn|>", "<|text|>", "<|end|>", "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_ESCAPE = re.compile(r"\\|" + "|".join(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in CONTROL))
_UNESCAPE = re.compile(r"\\([\\-])")


def escape(text: str) -> str:
    """Doubles backslashes and breaks each control string after its first character with ``\\-``."""
    return _ESCAPE.sub(lambda m: "\\\\" if m[0] == "\\" else m[0] + "\\-", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(lambda m: "\\" if m[1] == "\\" else "", text)


def render_marked(messages: Sequence[Message]) -> str:
    return "".join(f"{TURN}{escape(role)}{BODY}{escape(text)}{END}" for role, text in messages)


MARKED = Template(render_marked, context=1)


def read_marked(piece: str) -> Message:
    """The message of one turn's text."""
    if not (piece.startswith(TURN) and piece.endswith(END)):
        raise ValueError(f"not one formatted turn: {piece[:80]!r}")
    role, _, text = piece[len(TURN):-len(END)].partition(BODY)
    return unescape(role), unescape(text)


# --- spans by comparison -------------------------------------------------------------------------


@dataclass(frozen=True)
class Span:
    """A turn's text, and where the message begins and ends in it (-1 if the template rewrites history)."""

    piece: str
    begin: int
    end: int
    rewrites: bool


def common_prefix(a: str, b: str) -> int:
    return len(os.path.commonprefix((a, b)))


def turn_span(render: Render, before: Sequence[Message], message: Message) -> Span:
    old, new = (render(before) if before else ""), render([*before, message])
    if not new.startswith(old):
        return Span(new[common_prefix(old, new):], -1, -1, True)
    # probes without a common character: what they share is the frame
    first, second = (render([*before, (message[0], probe)]) for probe in ("0", "1"))
    begin = common_prefix(first, second)
    tail = common_prefix(first[::-1], second[::-1])
    framed = new.startswith(first[:begin]) and new.endswith(first[len(first) - tail:]) and len(new) >= begin + tail
    if begin < len(old) or not framed:
        return Span(new[len(old):], -1, -1, True)
    return Span(new[len(old):], begin - len(old), len(new) - tail - len(old), False)


def render_turns(conversations: DataFrame, template: Template, loss_roles: Sequence[str] = ("assistant",)) -> DataFrame:
    """One row per turn: conv_id, turn, role, piece, begin, end, content_begin, content_end, in_loss, rewrites.

    ``piece`` is the text the turn adds to its conversation; ``begin`` and ``end`` are code points in
    the conversation's whole text, which is the concatenation of the pieces; ``content_*`` bound the
    message inside it (-1 where the template rewrites history). Rows of a conversation come in order
    within one partition: turns by number, nulls first, equal numbers by role and text, repeated rows
    kept. Null roles and texts are empty; rows without a conversation id form one conversation with a
    null id. An empty table gives no rows.

    Conversations are streamed, never collected: memory holds ``template.context`` turns, or the
    earlier turns of one conversation if the template may depend on all of them.
    """
    columns = [
        F.col("conv_id"), F.col("turn"), F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text"),
    ]
    ordered = conversations.select(*columns).repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    loss = frozenset(loss_roles)
    names = ["conv_id", "turn", "role", "piece", "begin", "end", "content_begin", "content_end", "in_loss", "rewrites"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, before, position = object(), [], 0
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                rows = []
                for conv, turn, role, text in zip(*(c.to_pylist() for c in batch.slice(start, 500).columns)):
                    if conv != current:
                        current, before, position = conv, [], 0
                    context = before if template.context is None else before[len(before) - template.context:] if template.context else []
                    span = turn_span(template.render, context, (role, text))
                    end = position + len(span.piece)
                    inside = [-1, -1] if span.rewrites else [position + span.begin, position + span.end]
                    rows.append((conv, turn, role, span.piece, position, end, *inside, role in loss, span.rewrites))
                    position = end
                    before.append((role, text))
                    if template.context is not None:
                        del before[:max(0, len(before) - max(1, template.context))]
                arrays = [pa.array(column, t) for column, t in zip(zip(*rows), types)]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    kinds = [ordered.schema["conv_id"].dataType.simpleString(), ordered.schema["turn"].dataType.simpleString()]
    from pyspark.sql.pandas.types import to_arrow_type

    types = [to_arrow_type(ordered.schema["conv_id"].dataType), to_arrow_type(ordered.schema["turn"].dataType), pa.string(), pa.string(),
             pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_()]
    return ordered.mapInArrow(
        run, f"conv_id {kinds[0]}, turn {kinds[1]}, role string, piece string, begin long, end long, content_begin long, content_end long, "
             "in_loss boolean, rewrites boolean",
    )


def conversation_digests(turns: DataFrame) -> DataFrame:
    """Reads the formatted turns of ``MARKED`` back: one row per conversation with counts and SHA-256 digests.

    Takes the rows as ``render_turns`` leaves them (a conversation in order in one partition), so
    there is no further shuffle; digests are updated turn by turn and nothing is collected.
    """
    kind = turns.schema["conv_id"].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    id_type = to_arrow_type(kind)
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def emit(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows)) if rows else [()] * 6
        kinds = [id_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None  # id, turns, digest of all, characters under the mask, their digest, characters in all

        def closed(s: list) -> tuple:
            return s[0], s[1], s[2].hexdigest(), s[3], s[4].hexdigest(), s[5]

        for batch in batches:
            done = []
            for row in batch.to_pylist():
                if state is None or state[0] != row["conv_id"]:
                    if state is not None:
                        done.append(closed(state))
                    state = [row["conv_id"], 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                piece = row["piece"]
                role, text = read_marked(piece)
                state[1] += 1
                state[2].update(f"{role}\n{text}\n".encode())
                state[5] += len(piece)
                if row["in_loss"]:
                    shown = unescape(piece[row["content_begin"] - row["begin"]:row["content_end"] - row["begin"]])
                    state[3] += len(shown)
                    state[4].update(shown.encode())
            if done:
                yield emit(done)
        if state is not None:
            yield emit([closed(state)])

    columns = turns.select("conv_id", "piece", "begin", "content_begin", "content_end", "in_loss")
    return columns.mapInArrow(
        run, f"conv_id {kind.simpleString()}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    )
