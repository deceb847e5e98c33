"""Chat formatting: a declarative template and a finite-state machine over roles.

The machine's table says which role may follow which; the formatter walks a
conversation's turns in order, emits each turn as three text segments (header, text,
end) with a loss flag per segment, and notes the first turn out of order. Control
strings inside texts are escaped, reversibly, so that they can never be read as marks.

Turns reach a task sorted and are handled as a stream: what a task holds is one
machine state, never a conversation, so one conversation may have any number of turns.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import batched

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from govlens.llm.common import ship

START, BROKEN = "start", "broken"


@dataclass(frozen=True)
class Template:
    """Marks of a turn, the roles whose text is under the loss mask, and the machine:
    state -> role -> next state. A role without an arrow breaks the conversation."""
    open: str = "<|im_start|>"
    after_role: str = "\n"
    close: str = "<|im_end|>"
    after_turn: str = "\n"
    loss_roles: tuple[str, ...] = ("assistant",)
    arrows: dict[str, dict[str, str]] = field(default_factory=lambda: {
        START: {"system": "system", "user": "user"},
        "system": {"user": "user"},
        "user": {"assistant": "assistant"},
        "assistant": {"user": "user", "tool": "tool"},
        "tool": {"assistant": "assistant"},
    })

    def step(self, state: str, role: str) -> str:
        return self.arrows.get(state, {}).get(role, BROKEN)


CHATML = Template()

# All control strings begin with "<|". In a text, "<", any backslashes and "|" get one
# backslash more; reading takes one away. So no text holds "<|" once escaped.
_MARK, _ESCAPED = re.compile(r"<(\\*)\|"), re.compile(r"<(\\+)\|")


def escape(text: str) -> str:
    return _MARK.sub(r"<\1\\|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: "<" + m[1][1:] + "|", text)


def escape_role(role: str) -> str:
    """A role stands on the header's line: line ends in it are escaped too."""
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role), flags=re.S)


def segments(template: Template, role: str, text: str) -> tuple[tuple[str, bool], ...]:
    """A turn's segments: (text, under the loss mask)."""
    return ((f"{template.open}{escape_role(role)}{template.after_role}", False),
            (escape(text), role in template.loss_roles),
            (f"{template.close}{template.after_turn}", False))


def read_turn(template: Template, turn: str) -> tuple[str, str]:
    """Role and text of a formatted turn. Raises ValueError if it isn't one."""
    end = template.close + template.after_turn
    if not turn.startswith(template.open) or not turn.endswith(end) or turn.count(template.close) != 1:
        raise ValueError("not a formatted turn")
    role, mark, text = turn[len(template.open):-len(end)].partition(template.after_role)
    if not mark:
        raise ValueError("a turn without the end of its header")
    return unescape_role(role), unescape(text)


def _sorted_turns(conversations: DataFrame) -> DataFrame:
    """Turns of a conversation in order, all in one task; ties by role, then text."""
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


SEGMENTS = "conv_id long, turn long, place long, formatted string, loss array<boolean>, ends array<int>, in_order boolean"


def format_turns(conversations: DataFrame, template: Template = CHATML) -> DataFrame:
    """One row per turn: conv_id, turn, place (from 0), formatted text, and per segment its
    loss flag and end (code points); in_order: the machine has not broken so far.

    Columns conv_id, turn, role and text are read, others ignored. Null role or text:
    empty. Turns with the same number are ordered by role, then text; a null conv_id is a
    conversation of its own, a null turn comes first. A conversation out of order is
    formatted all the same. An empty table gives an empty result.
    """
    ship(conversations.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: object = object()
        state, place = START, 0
        for batch in batches:
            out: dict[str, list] = {n: [] for n in ("place", "formatted", "loss", "ends", "in_order")}
            for conv, role, text in zip(batch["conv_id"].to_pylist(), batch["role"].to_pylist(),
                                        batch["text"].to_pylist(), strict=True):
                if conv != last:
                    last, state, place = conv, START, 0
                state = template.step(state, role)
                parts = segments(template, role, text)
                ends, at = [], 0
                for piece, _ in parts:
                    at += len(piece)
                    ends.append(at)
                for n, v in zip(out, (place, "".join(p for p, _ in parts), [f for _, f in parts], ends,
                                      state != BROKEN), strict=True):
                    out[n].append(v)
                place += 1
            kinds = {"place": pa.int64(), "formatted": pa.string(), "loss": pa.list_(pa.bool_()),
                     "ends": pa.list_(pa.int32()), "in_order": pa.bool_()}
            yield pa.RecordBatch.from_arrays(
                [batch["conv_id"], batch["turn"], *(pa.array(v, kinds[n]) for n, v in out.items())],
                ["conv_id", "turn", *out])

    return _sorted_turns(conversations).mapInArrow(run, SEGMENTS)


def _digests(template: Template, rows: Iterable[tuple]) -> Iterator[tuple]:
    """From formatted turns in order: one tuple per conversation."""
    last: object = object()
    now = None

    def done():
        conv, turns, every, loss, loss_chars, chars, in_order = now
        return conv, turns, every.hexdigest(), loss_chars, loss.hexdigest(), chars, in_order

    for conv, formatted, flags, ends, in_order in rows:
        if now is None or conv != last:
            if now is not None:
                yield done()
            last, now = conv, [conv, 0, hashlib.sha256(), hashlib.sha256(), 0, 0, True]
        role, text = read_turn(template, formatted)
        now[1] += 1
        now[2].update(f"{role}\n{text}\n".encode())
        for start, end, flag in zip([0, *ends], ends, flags, strict=False):
            if flag:
                under = unescape(formatted[start:end])
                now[3].update(under.encode())
                now[4] += len(under)
        now[5] += len(formatted)
        now[6] = now[6] and in_order
    if now is not None:
        yield done()


def conversation_digests(formatted: DataFrame, template: Template = CHATML) -> DataFrame:
    """One row per conversation, read back from :func:`format_turns`' output (or a stored
    copy of it): n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, in_order.

    A digest runs over a conversation's bytes in order, so a conversation's turns pass one
    task, as a sorted stream: the task holds the digests' states, not the turns. A row that
    is not a formatted turn raises ValueError."""
    schema = ("conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
              "formatted_chars long, in_order boolean")
    names = ["conv_id", "formatted", "loss", "ends", "in_order"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for b in batches for row in zip(*(b[n].to_pylist() for n in names), strict=True))
        for some in batched(_digests(template, rows), 10_000):
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(zip(*some, strict=True), kinds, strict=True)],
                [x.split()[0] for x in schema.split(", ")])

    ship(formatted.sparkSession)
    return (formatted.repartition("conv_id").sortWithinPartitions("conv_id", "place")
            .select(*names).mapInArrow(run, schema))
