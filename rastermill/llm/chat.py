"""Chat formatting: a finite-state machine over roles, driven by a declarative template.

The rows of a conversation are read in order of turn, one at a time, so that a conversation of
any length needs the memory of one turn. For each turn the machine checks that its role may
follow, and emits text segments with a loss flag. Control strings inside texts are escaped so
that the formatted text can be read back exactly.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rastermill.llm.common import text_of

ESCAPE = "\\"


@dataclass(frozen=True)
class Template:
    """open, close: what stands before and after a role's text. loss: roles whose texts are learned.

    follows: role -> roles that may come next; "" is the start. ends: roles a conversation may end with.
    other: the role whose marks an unknown role gets, its name standing first in the text.
    """

    open: dict[str, str]
    close: dict[str, str]
    loss: frozenset[str]
    follows: dict[str, frozenset[str]]
    ends: frozenset[str]
    begin: str = "<s>"
    name_open: str = "[ROLE]"
    name_close: str = "[/ROLE]"
    controls: tuple[str, ...] = field(init=False)

    def __post_init__(self):
        marks = {m.strip() for m in (self.begin, self.name_open, self.name_close, *self.open.values(), *self.close.values())}
        object.__setattr__(self, "controls", tuple(sorted(marks - {""}, key=len, reverse=True)))

    def escape(self, text: str) -> str:
        return self._pattern().sub(lambda m: m[0] + ESCAPE, text.replace(ESCAPE, ESCAPE * 2))

    def unescape(self, text: str) -> str:
        return re.sub(r"\\(.)", r"\1", text, flags=re.S)

    def _pattern(self) -> re.Pattern:
        # The first character of every control string, also of those that overlap another.
        return _compiled(self.controls)


_patterns: dict[tuple[str, ...], re.Pattern] = {}


def _compiled(controls: tuple[str, ...]) -> re.Pattern:
    if controls not in _patterns:
        _patterns[controls] = re.compile("|".join(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in controls))
    return _patterns[controls]


#: Bracketed instructions: system, then user and assistant in turn.
INSTRUCT = Template(
    open={"system": "<<SYS>>", "user": "[INST] ", "assistant": "<<ANS>>"},
    close={"system": "<</SYS>>", "user": " [/INST]", "assistant": "</s>"},
    loss=frozenset({"assistant"}),
    follows={
        "": frozenset({"system", "user"}),
        "system": frozenset({"user"}),
        "user": frozenset({"assistant"}),
        "assistant": frozenset({"user"}),
    },
    ends=frozenset({"assistant"}),
)


def segments_of(template: Template, role: str, text: str) -> list[tuple[str, bool]]:
    """The segments of one turn. An unknown role is written by name, with the marks of a user turn."""
    known = role in template.open
    marks = role if known else "user"
    name = "" if known else template.name_open + template.escape(role) + template.name_close
    return [
        (template.open[marks] + name, False),
        (template.escape(text), known and role in template.loss),
        (template.close[marks], False),
    ]


def read_turn(template: Template, formatted: str) -> tuple[str, str]:
    """Role and text of one formatted turn: the inverse of segments_of."""
    for role, mark in template.open.items():
        close = template.close[role]
        if formatted.startswith(mark) and formatted.endswith(close):
            body = formatted[len(mark) : len(formatted) - len(close)]
            if body.startswith(template.name_open):
                name, _, body = body[len(template.name_open) :].partition(template.name_close)
                role = template.unescape(name)
            return role, template.unescape(body)
    raise ValueError("not a turn of this template")


class Reader:
    """Cuts a formatted conversation into turns again while it streams by, and keeps the digests."""

    def __init__(self, template: Template):
        self.t, self.rest = template, ""
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.formatted_chars = 0
        self.ends = re.compile("|".join(re.escape(c) for c in sorted(set(template.close.values()), key=len, reverse=True)))

    def feed(self, piece: str) -> None:
        self.formatted_chars += len(piece)
        if self.formatted_chars == len(piece) and piece.startswith(self.t.begin):
            piece = piece[len(self.t.begin) :]
        start = max(0, len(self.rest) - 16)
        self.rest += piece
        while m := self.ends.search(self.rest, start):
            role, text = read_turn(self.t, self.rest[: m.end()])
            self.rest, start = self.rest[m.end() :], 0
            self.n_turns += 1
            self.turns.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))

    def learn(self, escaped: str) -> None:
        text = self.t.unescape(escaped)
        self.loss_chars += len(text)
        self.loss.update(text.encode("utf-8", "surrogatepass"))


def in_order(conversations: DataFrame) -> DataFrame:
    """The rows of each conversation in one partition, by turn (equal turns by role, then text)."""
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), text_of().alias("text"))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def format_turns(conversations: DataFrame, template: Template = INSTRUCT) -> DataFrame:
    """The formatted segments: conv_id, turn, turn_no, segment, text, loss, valid.

    Concatenated in order of turn_no and segment they are the formatted conversation. valid tells
    whether the turn's role may follow the one before. Null texts and roles count as empty, an
    unknown role is written by name and never valid. Repeated rows are turns of their own; turns of
    equal number stand in order of role, then text, a null number first. Ids are numbers (long); rows
    without one form a conversation of their own. Texts of any length are formatted whole. Other columns,
    also those named like results, are ignored; an empty table gives no segments.
    """
    schema = "conv_id long, turn long, turn_no long, segment int, text string, loss boolean, valid boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, last, no = object(), "", 0
        for batch in batches:
            out = []
            for cid, turn, role, text in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if cid != conv:
                    conv, last, no = cid, "", 0
                valid = role in template.follows.get(last, ())
                pieces = segments_of(template, role, text)
                if not no:
                    pieces[0] = (template.begin + pieces[0][0], False)
                out += [(cid, turn, no, i, s, loss, valid) for i, (s, loss) in enumerate(pieces)]
                last, no = role, no + 1
            yield _batch(out, _SEGMENTS)

    return in_order(conversations).mapInArrow(run, schema)


_SEGMENTS = pa.schema(
    [("conv_id", pa.int64()), ("turn", pa.int64()), ("turn_no", pa.int64()), ("segment", pa.int32()), ("text", pa.string()), ("loss", pa.bool_()), ("valid", pa.bool_())]
)
_DIGESTS = pa.schema(
    [("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("valid", pa.bool_())]
)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def read_back(segments: DataFrame, template: Template = INSTRUCT) -> DataFrame:
    """One row per conversation, read from the formatted segments alone (already grouped and in order).

    Texts stream by: of a conversation one turn is held at a time, however long it is. What has no
    segment has no row, so an empty table gives none; segments that end inside a turn fail.
    """
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, reader, valid, last = object(), None, True, ""

        def close():
            if reader.rest:
                raise ValueError("a formatted conversation ends inside a turn")
            return (conv, reader.n_turns, reader.turns.hexdigest(), reader.loss_chars, reader.loss.hexdigest(), reader.formatted_chars, valid and last in template.ends)

        for batch in batches:
            out = []
            names = ("conv_id", "segment", "text", "loss", "valid")
            for cid, seg, text, loss, ok in zip(*(batch.column(n).to_pylist() for n in names), strict=True):
                if cid != conv or reader is None:
                    if reader is not None:
                        out.append(close())
                    conv, reader, valid = cid, Reader(template), True
                valid = valid and ok
                if seg == 0:
                    mark = text.removeprefix(template.begin)
                    last = next((r for r, m in template.open.items() if mark == m), "")
                if loss:
                    reader.learn(text)
                reader.feed(text)
            if out:
                yield _batch(out, _DIGESTS)
        if reader is not None:
            yield _batch([close()], _DIGESTS)

    return segments.mapInArrow(run, schema)
