"""Chat formatting: a finite-state machine over roles and a declarative template.

A template names, per role, the control strings before and after a turn, and
which roles carry loss.  The formatter walks the turns of a conversation in
order, checks the role order with the machine's transition table and emits
segments (text, loss flag): control strings never carry loss, a turn's text
does when its role is a loss role.  Inside texts every character that could
start a control string is escaped, so the output can be read back exactly
whatever a text holds.

Rows are dealt by conversation and sorted inside the tasks; the walk is a
stream with the state of one open conversation, so a conversation of any
length passes without being collected.

Null text is empty; a null or unknown role is a turn of role ``unknown``
(formatted with its own name, never loss, and the conversation is marked
invalid).  Rows of a null conversation id form one conversation.  Turns with
equal (or null) numbers are ordered by role and text; null numbers come first.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shotsmith.llm.common import spread

ESCAPE = "\\"


@dataclass(frozen=True)
class Template:
    """``open``/``close``: control strings around a turn, by role."""

    open: dict[str, str] = field(default_factory=lambda: {
        "system": "<s>[SYS] ", "user": "<s>[INST] ", "assistant": "<s>[ANS] ", "unknown": "<s>[ROLE] "})
    close: dict[str, str] = field(default_factory=lambda: {
        "system": " [/SYS]</s>", "user": " [/INST]</s>", "assistant": " [/ANS]</s>",
        "unknown": " [/ROLE]</s>"})
    loss: tuple[str, ...] = ("assistant",)
    escaped: str = "<[\\"          # every control string holds one of these at a known place

    # state -> role -> next state; a missing entry is an invalid order
    moves: dict[str, dict[str, str]] = field(default_factory=lambda: {
        "start": {"system": "system", "user": "user"},
        "system": {"user": "user"},
        "user": {"assistant": "assistant"},
        "assistant": {"user": "user"}})
    final: tuple[str, ...] = ("assistant",)

    def escape(self, text: str) -> str:
        for c in self._order():
            text = text.replace(c, ESCAPE + c)
        return text

    def _order(self) -> str:
        return ESCAPE + self.escaped.replace(ESCAPE, "")

    def segments(self, role: str | None, text: str | None) -> list[tuple[str, bool]]:
        """One turn: (piece of output, loss flag)."""
        text = text or ""
        if role in self.open and role != "unknown":
            return [(self.open[role], False), (self.escape(text), role in self.loss),
                    (self.close[role], False)]
        name = "" if role is None else ":" + self.escape(role)
        return [(self.open["unknown"], False), (name, False), ("[=]", False), (self.escape(text), False),
                (self.close["unknown"], False)]


class Reader:
    """Reads formatted output back, piece by piece as it arrives."""

    def __init__(self, template: Template):
        self.t = template

    def _plain(self, out: str, at: int) -> tuple[str, int]:
        """Unescaped text from ``at`` to the next unescaped '<' or '['."""
        parts = []
        start = at
        while at < len(out):
            nxt = min((p for p in (out.find(ESCAPE, at), out.find("<", at), out.find("[", at)) if p >= 0),
                      default=len(out))
            if nxt < len(out) and out[nxt] == ESCAPE:
                parts.append(out[start:nxt])
                parts.append(out[nxt + 1])
                at = start = nxt + 2
                continue
            parts.append(out[start:nxt])
            return "".join(parts), nxt
        parts.append(out[start:])
        return "".join(parts), len(out)

    def turn(self, out: str, at: int) -> tuple[str | None, str, str, int]:
        """(role, loss role, text, next position) of the turn that starts at ``at``."""
        for role, mark in self.t.open.items():
            if not out.startswith(mark, at):
                continue
            at += len(mark)
            name: str | None = role
            if role == "unknown":
                got, at = self._plain(out, at)
                name = got[1:] if got else None
                if not out.startswith("[=]", at):
                    raise ValueError("broken role")
                at += 3
            text, at = self._plain(out, at)
            close = self.t.close[role].lstrip(" ")
            lead = len(self.t.close[role]) - len(close)
            if not out.startswith(close, at):
                raise ValueError("broken turn end")
            return name, role, text[: len(text) - lead], at + len(close)
        raise ValueError("no turn starts here")


def _walk(rows: DataFrame, names: list[str], schema: str, start, step, finish) -> DataFrame:
    """Stream the sorted turns of each conversation through ``step``."""
    def run(batches):
        open_id, state, out = None, None, []
        for pdf in batches:
            for conv, role, text in zip(pdf["conv_id"], pdf["role"], pdf["text"]):
                conv = None if pd.isna(conv) else conv
                if state is None or conv != open_id:
                    if state is not None:
                        out.extend(finish(open_id, state))
                    open_id, state = conv, start()
                out.extend(step(open_id, state, role, text))
            if out:
                yield pd.DataFrame(out, columns=names)
                out = []
        if state is not None:
            out.extend(finish(open_id, state))
        if out:
            yield pd.DataFrame(out, columns=names)

    n = spread(rows.sparkSession)
    dealt = (rows.select(F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), "role", "text")
             .repartition(n, "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text"))
    # ids travel as text: pandas turns a bigint column that holds a null into doubles
    out = dealt.select(F.col("conv_id").cast("string"), "role", "text").mapInPandas(
        run, schema.replace("conv_id bigint", "conv_id string"))
    return out.withColumn("conv_id", F.col("conv_id").cast("bigint"))


class _Machine:
    def __init__(self):
        self.state, self.valid, self.n = "start", True, 0

    def move(self, template: Template, role) -> None:
        self.n += 1
        nxt = template.moves.get(self.state, {}).get(role)
        if nxt is None:
            self.valid = False
            nxt = role if role in template.moves else "start"
        self.state = nxt


def format_segments(rows: DataFrame, template: Template = Template()) -> DataFrame:
    """(conv_id, turn_no, seg_no, text, loss, in_order): the emitted segments.
    ``in_order``: the role was allowed where it came."""
    def step(conv, m, role, text):
        before = m.state
        m.move(template, role)
        ok = role in template.moves.get(before, {})
        return [(conv, m.n - 1, k, s, loss, ok)
                for k, (s, loss) in enumerate(template.segments(role, text))]

    names = ["conv_id", "turn_no", "seg_no", "text", "loss", "in_order"]
    return _walk(rows, names, "conv_id bigint, turn_no bigint, seg_no int, text string, loss boolean, "
                 "in_order boolean", _Machine, step, lambda *_: ())


def format_digests(rows: DataFrame, template: Template = Template()) -> DataFrame:
    """One row per conversation, read back from the formatted output:
    turns, loss text and length, plus ``valid`` (role order and end)."""
    reader = Reader(template)

    class State(_Machine):
        def __init__(self):
            super().__init__()
            self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
            self.back = self.loss_chars = self.chars = 0

    def step(conv, s, role, text):
        s.move(template, role)
        pieces = template.segments(role, text)
        out = "".join(p for p, _ in pieces)
        s.chars += len(out)
        at = 0
        while at < len(out):
            name, kind, back, at = reader.turn(out, at)
            s.back += 1
            s.turns.update(f"{name or ''}\n{back}\n".encode())
        at = 0
        for p, loss in pieces:
            if loss:                              # the mask's text, read from the output
                got, _ = reader._plain(out[at: at + len(p)], 0)
                s.loss_chars += len(got)
                s.loss.update(got.encode())
            at += len(p)
        return ()

    def finish(conv, s):
        return [(conv, s.back, s.turns.hexdigest(), s.loss_chars, s.loss.hexdigest(), s.chars,
                 s.valid and s.state in template.final)]

    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "valid"]
    return _walk(rows, names, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, "
                 "loss_sha256 string, formatted_chars bigint, valid boolean", State, step, finish)
