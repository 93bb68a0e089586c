"""Operator 11: conversations formatted for training by a finite-state machine over roles.

A template is data: the segments of a turn, which of them count for the loss by role,
and the moves of a machine whose states follow each other as roles come. The machine
reads a conversation's turns in order; each move gives out the turn's segments with
their loss flags, and a role that the state has no move for is noted, not dropped. The
same template reads the text back.

Control strings in a text or role are escaped by a backslash after their first
character, one more if there are some, so that no text can end a turn or begin one, and
unescaping gives back every text.

A conversation goes through one task, turn by turn, in an order that Spark sorts: the
state, a place and at most one turn are held, never a conversation. Long conversations
take time in proportion to their turns, and no memory.

Defined cases: a null text or role is an empty one; turns come in the order of their
number, then role, then text, with nulls last, and a number that comes twice is a
violation; repeated rows are turns of their own; rows without a conv_id are one
conversation without a number; a role may be any string, very long texts are escaped and
read whole; an empty table gives an empty result; only the four named columns are read,
so others may have any names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ROWS, on_workers


@dataclass(frozen=True)
class Template:
    """Segments of a turn (``{role}`` and ``{text}`` are filled in), those under the loss by role, and the machine's moves.

    Controls have two characters or more, of which the first comes once in each; a role ends at its line's end.
    """

    turn: tuple[str, ...]
    controls: tuple[str, ...]
    loss: Mapping[str, tuple[str, ...]]
    moves: Mapping[str, Mapping[str, str]]
    start: str = "start"
    ends: tuple[str, ...] = field(default=())


#: The markers of ChatML.
CHATML = Template(
    turn=("<|im_start|>", "{role}", "\n", "{text}", "<|im_end|>\n"),
    controls=("<|im_start|>", "<|im_end|>"),
    loss={"assistant": ("{text}",)},
    moves={
        "start": {"system": "system", "user": "user"},
        "system": {"user": "user"},
        "user": {"assistant": "assistant"},
        "assistant": {"user": "user", "tool": "tool"},
        "tool": {"assistant": "assistant"},
    },
    ends=("assistant",),
)


class Machine:
    """A template at work: escapes, moves, segments, and the way back."""

    def __init__(self, template: Template) -> None:
        self.template = template
        tails = "|".join(re.escape(c[1:]) for c in template.controls)
        heads = "|".join(sorted({re.escape(c[0]) for c in template.controls}))
        self._plain = re.compile(rf"({heads})(\\*)({tails})")
        self._escaped = re.compile(rf"({heads})\\(\\*)({tails})")
        parts = ["(?P<role>[^\n]*)" if s == "{role}" else "(?P<text>.*?)" if s == "{text}" else re.escape(s) for s in template.turn]
        self._turn = re.compile("".join(parts), re.DOTALL)

    def escape(self, text: str) -> str:
        return self._plain.sub(r"\1\\\2\3", text)

    def unescape(self, text: str) -> str:
        return self._escaped.sub(r"\1\2\3", text)

    def escape_role(self, role: str) -> str:
        r"""As a text, and on one line: \ and line ends become \\ and \n first."""
        return self.escape(role.replace("\\", "\\\\").replace("\n", "\\n"))

    def unescape_role(self, role: str) -> str:
        return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], self.unescape(role))

    def move(self, state: str, role: str) -> tuple[str, bool]:
        """The next state, and whether the template allows the move; after one that it doesn't, the state is the role's own, if there is one."""
        to = self.template.moves.get(state, {}).get(role)
        if to is not None:
            return to, True
        return (role if role in self.template.moves else state), False

    def segments(self, role: str, text: str) -> list[dict]:
        under = self.template.loss.get(role, ())
        filled = {"{role}": self.escape_role, "{text}": self.escape}
        return [{"text": filled[s](role if s == "{role}" else text) if s in filled else s, "loss": s in under} for s in self.template.turn]

    def parse(self, text: str, at: int = 0) -> tuple[str, str, int] | None:
        """Role and text of the turn that begins there, and where it ends; None if it isn't whole."""
        m = self._turn.match(text, at)
        return m and (self.unescape_role(m["role"]), self.unescape(m["text"]), m.end())


FORMATTED_DDL = "conv_id {key}, position long, role string, state string, allowed boolean, segments array<struct<text: string, loss: boolean>>"
_FORMATTED = [("position", pa.int64()), ("role", pa.string()), ("state", pa.string()), ("allowed", pa.bool_()), ("segments", pa.list_(pa.struct([("text", pa.string()), ("loss", pa.bool_())])))]
SUMMARY_DDL = "conv_id {key}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean, violation string"
_SUMMARY = [("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("valid", pa.bool_()), ("violation", pa.string())]


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, ROWS):
            yield whole.slice(at, ROWS)


def _batch(key: pa.DataType, rows: list[tuple], fields: list[tuple]) -> pa.RecordBatch:
    kinds = [("conv_id", key), *fields]
    columns = list(zip(*rows)) if rows else [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, kinds)], names=[n for n, _ in kinds])


def _formatter(template: Template) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, now = Machine(template), None
        position, state, before = 0, template.start, None
        for batch in _slices(batches):
            rows = []
            for conv, turn, role, text in zip(*(c.to_pylist() for c in batch.columns)):
                if now is None or now[0] != conv:
                    now, position, state, before = (conv,), 0, template.start, None
                role = role or ""
                state, allowed = machine.move(state, role)
                allowed = allowed and turn is not None and turn != before
                rows.append((conv, position, role, state, allowed, machine.segments(role, text or "")))
                position, before = position + 1, turn
            yield _batch(batch.schema.field(0).type, rows, _FORMATTED)

    return run


def format_turns(df: DataFrame, template: Template = CHATML, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """A row for each turn, in order: conv_id, position from 0, role, the machine's state after it, whether it was allowed, and segments of text with loss flags.

    A conversation's rows lie in one partition, one after another; the text of a
    conversation is that of all its segments.
    """
    own = on_workers(df).select(*[F.col(f"`{c}`").alias(n) for c, n in ((key, "conv_id"), (turn, "turn"), (role, "role"), (text, "text"))])
    order = [F.col(c).asc_nulls_last() for c in ("conv_id", "turn", "role", "text")]
    dealt = own.repartition("conv_id").sortWithinPartitions(*order)
    return dealt.mapInArrow(_formatter(template), FORMATTED_DDL.format(key=own.schema["conv_id"].dataType.simpleString()))


class Reader:
    """Reads a conversation's segments as they come, and sums up."""

    def __init__(self, machine: Machine) -> None:
        self.machine, self.rest = machine, ""
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.formatted_chars = 0
        self.state, self.violation = machine.template.start, None

    def take(self, position: int, role: str, state: str, allowed: bool, segments: list[dict]) -> None:
        if not allowed and self.violation is None:
            self.violation = f"turn {position}: {role[:40]} after {self.state}"
        self.state = state
        for s in segments:
            self.rest += s["text"]
            self.formatted_chars += len(s["text"])
            if s["loss"]:
                plain = self.machine.unescape(s["text"])
                self.loss_chars += len(plain)
                self.loss.update(plain.encode())
        at = 0
        while found := self.machine.parse(self.rest, at):
            said_by, said, at = found
            self.n_turns += 1
            self.turns.update(f"{said_by}\n{said}\n".encode())
        self.rest = self.rest[at:]

    def row(self, conv) -> tuple:
        violation = self.violation
        if violation is None and self.rest:
            violation = "text after the last turn"
        if violation is None and self.state not in self.machine.template.ends:
            violation = f"ends after {self.state}"
        return (conv, self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.formatted_chars, violation is None, violation)


def _summer(template: Template) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, now, reader, kind = Machine(template), None, None, None
        for batch in _slices(batches):
            rows, kind = [], batch.schema.field(0).type
            for conv, *turn in zip(*(c.to_pylist() for c in batch.columns)):
                if now is None or now[0] != conv:
                    if reader is not None:
                        rows.append(reader.row(now[0]))
                    now, reader = (conv,), Reader(machine)
                reader.take(*turn)
            yield _batch(kind, rows, _SUMMARY)
        if reader is not None:
            yield _batch(kind, [reader.row(now[0])], _SUMMARY)

    return run


def read_back(formatted: DataFrame, template: Template = CHATML, in_order: bool = False) -> DataFrame:
    """What the formatted text of each conversation says: digests of its turns and of the text under the loss, its length, and whether the turns came in a valid order (else the first violation).

    ``in_order`` says that the rows come straight from :func:`format_turns`, not from a table.
    """
    rows = formatted.select("conv_id", "position", "role", "state", "allowed", "segments")
    if not in_order:
        rows = on_workers(rows).repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_last(), "position")
    return rows.mapInArrow(_summer(template), SUMMARY_DDL.format(key=rows.schema["conv_id"].dataType.simpleString()))
