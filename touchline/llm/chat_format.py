"""Chat formatting with a grammar round trip.

A turn is written as `### Role: text\\n</turn>\\n`. The parser reads from left to right; a
control string (`###` or `</turn>`) directly after a backslash is text, with that backslash
taken away, any other is structure. Rendering tries the text as it is, parses it back and
compares; only when the parse differs are control strings of the text escaped, and it is
compared again. Texts without conflicts stay byte for byte what they were.

Rows are dealt by conversation and sorted by turn inside each partition; tasks stream over
them turn by turn and keep one turn and a few running hashes, so a conversation of any
length is never gathered.

Defined results: null text and null role are empty; rows of equal turn go by role and text;
rows with a null conversation form one conversation; repeated rows are repeated turns; a
null turn comes first; roles other than the three known ones are quoted; other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

#: Fixed names of the template.
ROLES = {"system": "System", "user": "User", "assistant": "Assistant"}
OPEN, CLOSE = "###", "</turn>"
LOSS_ROLE = "assistant"

_NAMES = {name: role for role, name in ROLES.items()}
_CONTROL = re.compile(f"{OPEN}|{CLOSE}")
_HEADER = re.compile(OPEN + r" (?:(System|User|Assistant)|\"((?:[^\"%]|%[0-9a-f]{6})*)\"): ")

FORMATTED = "conv_id long, seq long, rendered string, loss_from long, loss_to long"
READ_BACK = (
    "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
)


class Malformed(ValueError):
    """The text does not follow the grammar."""


def _quoted(role: str) -> str:
    """Any role inside quotes: quotes, percent signs and control strings as six hex digits each."""
    return '"' + re.sub(r'["%#<\n]', lambda m: f"%{ord(m[0]):06x}", role) + '"'


def _unquoted(name: str) -> str:
    return re.sub(r"%([0-9a-f]{6})", lambda m: chr(int(m[1], 16)), name)


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: "\\" + m[0], text)


def parse(rendered: str) -> list[tuple[str, str, int, int]]:
    """The turns of a formatted text: role, text, and where the raw text starts and ends."""
    turns, at = [], 0
    while at < len(rendered):
        header = _HEADER.match(rendered, at)
        if not header:
            raise Malformed(f"no turn starts at {at}")
        role = _NAMES[header[1]] if header[1] else _unquoted(header[2])
        start = at = header.end()
        pieces = []
        while True:
            control = _CONTROL.search(rendered, at)
            if not control:
                raise Malformed("the last turn has no end")
            if control.start() > start and rendered[control.start() - 1] == "\\":
                pieces += [rendered[at:control.start() - 1], control[0]]
                at = control.end()
                continue
            end = control.start() - 1
            if control[0] != CLOSE or end < at or rendered[end] != "\n" or rendered[control.end():control.end() + 1] != "\n":
                raise Malformed(f"a bare control string at {control.start()}")
            pieces.append(rendered[at:end])
            turns.append((role, "".join(pieces), start, end))
            at = control.end() + 1
            break
    return turns


def render(role: str, text: str) -> tuple[str, int, int]:
    """A formatted turn that parses back to exactly (role, text), and the span of its text."""
    name = ROLES.get(role) or _quoted(role)
    for body in (text, escape(text)):
        rendered = f"{OPEN} {name}: {body}\n{CLOSE}\n"
        try:
            turns = parse(rendered)
        except Malformed:
            continue
        if [turn[:2] for turn in turns] == [(role, text)]:
            return rendered, turns[0][2], turns[0][3]
    raise Malformed("escaping does not make the turn readable")


def _text(value) -> str:
    return value if isinstance(value, str) else ""


def _render_stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    current, seq = object(), 0
    for batch in batches:
        rows = []
        for conv_id, role, text in zip(batch["conv_id"], batch["role"], batch["text"]):
            conv_id = None if pd.isna(conv_id) else int(conv_id)
            seq = seq + 1 if conv_id == current else 0
            current = conv_id
            rendered, start, end = render(_text(role), _text(text))
            loss = (start, end) if _text(role) == LOSS_ROLE else (None, None)
            rows.append((conv_id, seq, rendered, *loss))
        frame = pd.DataFrame(rows, columns=["conv_id", "seq", "rendered", "loss_from", "loss_to"])
        yield frame.astype({"conv_id": "Int64", "loss_from": "Int64", "loss_to": "Int64"})


def format_chats(conversations: DataFrame) -> DataFrame:
    """One row per turn, in order `seq` of its conversation; a conversation's formatted text is
    its rendered turns joined. loss_from and loss_to span the text under the loss mask."""
    return (
        conversations.selectExpr("cast(conv_id as long) conv_id", "cast(turn as long) turn", "role", "text")
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", "turn", "role", "text")
        .mapInPandas(_render_stream, FORMATTED)
    )


class _Reader:
    """Running digests of one conversation."""

    def __init__(self, conv_id):
        self.conv_id, self.n_turns, self.loss_chars, self.formatted_chars = conv_id, 0, 0, 0
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, rendered: str, loss_from, loss_to):
        self.formatted_chars += len(rendered)
        for role, text, start, end in parse(rendered):
            self.n_turns += 1
            self.turns.update(f"{role}\n{text}\n".encode())
            if not pd.isna(loss_from) and (start, end) == (int(loss_from), int(loss_to)):
                self.loss_chars += len(text)
                self.loss.update(text.encode())

    def row(self):
        return (self.conv_id, self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(),
                self.formatted_chars)


def _read_stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = [c.split()[0] for c in READ_BACK.split(", ")]

    def frame(rows):
        return pd.DataFrame(rows, columns=columns).astype({"conv_id": "Int64"})

    reader = None
    for batch in batches:
        done = []
        for conv_id, rendered, start, end in zip(
            batch["conv_id"], batch["rendered"], batch["loss_from"], batch["loss_to"]
        ):
            conv_id = None if pd.isna(conv_id) else int(conv_id)
            if reader is None or reader.conv_id != conv_id:
                done += [reader.row()] if reader else []
                reader = _Reader(conv_id)
            reader.add(rendered, start, end)
        yield frame(done)
    if reader:
        yield frame([reader.row()])


def read_back(formatted: DataFrame) -> DataFrame:
    """One row per conversation, parsed from the formatted text alone: number of turns, digest of
    all turns, length and digest of the text under the loss mask, length of the formatted text."""
    return (
        formatted.repartition("conv_id")
        .sortWithinPartitions("conv_id", "seq")
        .mapInPandas(_read_stream, READ_BACK)
    )
