"""Chat formatting: a finite-state machine over roles and a declarative template.

The machine says for each turn whether its role may follow the turns before it; the template says what stands around
a turn's text and whether the text is in the loss mask.  Control strings of the template inside a text, and the escape
character, get an escape in front, so that the formatted text reads back exactly: the reader sees a conversation's text
and which of it is under the mask, and finds turns by the template's marks alone.

Turns are formatted in the order of the conversation while they stream by, one turn in memory at a time, so a long
conversation costs time in one task but no memory; its digest over all turns in order can't be made in parts.

Defined results: rows of a conversation go by turn (null first), then role, then text, so ties and repeated rows have
one order and each is a turn; a null text is empty; a null role, or one that the template lacks, is formatted with the
template's ``other`` turn and no loss, and makes the conversation invalid; a null conv_id is a conversation of its
own; an empty table gives none.  Only the four columns are read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glintdex.llm.shared import narrow


@dataclass(frozen=True)
class Turn:
    """What stands before and after the text of a role, and whether the text is in the loss mask."""

    before: str
    after: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    """``moves``: from each state, the state to which a role leads.  ``ends``: states in which a conversation may end."""

    roles: dict[str, Turn]
    start: str
    moves: dict[str, dict[str, str]]
    ends: frozenset[str]
    #: Stands before any other role; its name, escaped, and a line end follow.
    other: Turn = Turn("### Role ", "\n</turn>\n")
    escape: str = "\\"
    control: tuple[str, ...] = ("###", "</turn>")
    _marks: re.Pattern = field(init=False, repr=False, compare=False)
    _role_marks: re.Pattern = field(init=False, repr=False, compare=False)

    def __post_init__(self):
        if any(c.startswith(self.escape) or not c for c in self.control):
            raise ValueError("a control string is not empty and doesn't start with the escape character")
        longest = sorted(self.control, key=len, reverse=True)
        object.__setattr__(self, "_marks", re.compile("|".join(map(re.escape, [self.escape, *longest]))))
        object.__setattr__(self, "_role_marks", re.compile("|".join(map(re.escape, [self.escape, *longest, ":"]))))

    def hide(self, text: str) -> str:
        """``text`` with an escape before each escape and control string."""
        return self._marks.sub(lambda m: self.escape + m[0], text)

    def show(self, text: str) -> str:
        """The reverse of ``hide``."""
        return re.sub(f"{re.escape(self.escape)}({self._marks.pattern})", lambda m: m[1], text)

    def hide_role(self, role: str) -> str:
        """The name of an unknown role, in which colons are hidden too, as one ends it."""
        return self._role_marks.sub(lambda m: self.escape + m[0], role)

    def show_role(self, role: str) -> str:
        return re.sub(f"{re.escape(self.escape)}({self._role_marks.pattern})", lambda m: m[1], role)


#: A system turn may come first; then user and assistant take turns, and the assistant has the last word.
DEFAULT = Template(
    roles={
        "system": Turn("### System:\n", "\n</turn>\n"),
        "user": Turn("### User:\n", "\n</turn>\n"),
        "assistant": Turn("### Assistant:\n", "\n</turn>\n", loss=True),
    },
    start="start",
    moves={"start": {"system": "instructed", "user": "asked"}, "instructed": {"user": "asked"}, "asked": {"assistant": "answered"}, "answered": {"user": "asked"}},
    ends=frozenset({"answered"}),
)


class Machine:
    """Follows one conversation's roles."""

    def __init__(self, template: Template):
        self.template, self.state = template, template.start

    def step(self, role: str | None) -> bool:
        """Whether ``role`` may come now; after one that may not, none may."""
        self.state = self.template.moves.get(self.state, {}).get(role, "invalid")
        return self.state != "invalid"

    @property
    def complete(self) -> bool:
        return self.state in self.template.ends


def segments(template: Template, role: str | None, text: str | None) -> list[tuple[str, bool]]:
    """What a turn becomes: (text, whether it is in the loss mask)."""
    turn, body = template.roles.get(role), template.hide(text or "")
    if turn is None:
        return [(template.other.before + template.hide_role(role or "") + ":\n", False), (body, False), (template.other.after, False)]
    return [(turn.before, False), (body, turn.loss), (turn.after, False)]


SEGMENTS = "conv_id long, position long, piece int, text string, loss boolean, allowed boolean, complete boolean"


def format_conversations(rows: DataFrame, template: Template = DEFAULT) -> DataFrame:
    """The segments of every conversation, sorted by (conv_id, position, piece) within each partition.

    ``allowed``: the machine let the turn come.  ``complete``: after this turn the conversation may end.
    """
    own = narrow(rows, conv_id="long", turn="long", role="string", text="string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, at, machine = object(), 0, None
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                out: list[list] = [[] for _ in range(7)]
                part = batch.slice(lo, 1000)
                for c, role, text in zip(*(part.column(i).to_pylist() for i in range(3)), strict=True):
                    if c != conv:
                        conv, at, machine = c, 0, Machine(template)
                    allowed = machine.step(role)
                    for piece, (x, loss) in enumerate(segments(template, role, text)):
                        for column, value in zip(out, (c, at, piece, x, loss, allowed, machine.complete), strict=True):
                            column.append(value)
                    at += 1
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, (pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.bool_(), pa.bool_(), pa.bool_()), strict=True)], ["conv_id", "position", "piece", "text", "loss", "allowed", "complete"])

    dealt = own.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.select("conv_id", "role", "text").mapInArrow(run, SEGMENTS)


class Reader:
    """Reads a conversation's formatted text back while it streams in, cut anywhere; knows only the template.

    A turn begins with the mark of a role and ends with the first end mark of that role that isn't escaped.  What is
    read is let go, so a turn is in memory at a time.
    """

    def __init__(self, template: Template):
        self.template = template
        self.text = ""
        #: Parts of ``text`` under the loss mask, as (start, stop).
        self.masked: list[tuple[int, int]] = []
        self.heads = sorted(((t.before, role) for role, t in template.roles.items()), key=lambda h: -len(h[0]))
        self.longest = max(map(len, [template.other.before, *(h for h, _ in self.heads)]))
        hidden = f"{re.escape(template.escape)}(?:{template._marks.pattern})"
        self.ends = {after: re.compile(f"{hidden}|({re.escape(after)})", re.S) for after in {template.other.after, *(t.after for t in template.roles.values())}}
        self.colon = re.compile(f"{re.escape(template.escape)}(?:{template._role_marks.pattern})|(:\n)", re.S)

    def _first(self, pattern: re.Pattern, at: int) -> re.Match | None:
        return next((m for m in pattern.finditer(self.text, at) if m[1] is not None), None)

    def _turn(self) -> tuple[str, int, int, int] | None:
        """(role, start and stop of the text, end) of the first turn, None until all of it is there."""
        head, role = next(((h, r) for h, r in self.heads if self.text.startswith(h)), (None, None))
        if head is None:
            before = self.template.other.before
            if not self.text.startswith(before):
                if len(self.text) < self.longest and any(h.startswith(self.text) for h in [before, *(h for h, _ in self.heads)]):
                    return None
                raise ValueError("a turn without its start")
            colon = self._first(self.colon, len(before))
            if colon is None:
                return None
            role, start, after = self.template.show_role(self.text[len(before) : colon.start()]), colon.end(), self.template.other.after
        else:
            start, after = len(head), self.template.roles[role].after
        end = self._first(self.ends[after], start)
        return end and (role, start, end.start(), end.end())

    def feed(self, text: str, loss: bool) -> Iterator[tuple[str, str, str]]:
        """(role, text, text under the loss mask) of each turn that is now complete."""
        if loss:
            self.masked.append((len(self.text), len(self.text) + len(text)))
        self.text += text
        while self.text and (found := self._turn()):
            role, start, stop, end = found
            under = "".join(self.text[a : min(b, end)] for a, b in self.masked if a < end)
            yield role, self.template.show(self.text[start:stop]), self.template.show(under)
            self.masked = [(max(a, end) - end, b - end) for a, b in self.masked if b > end]
            self.text = self.text[end:]

    def close(self) -> None:
        if self.text:
            raise ValueError("a turn without its end")


def read_back(formatted: DataFrame, template: Template = DEFAULT) -> DataFrame:
    """What a reader finds in ``format_conversations``' segments, one row for each conversation.

    The segments must be as they left that function, in order within partitions.  Of them it takes text and mask; where
    turns begin and end it tells by their marks.  Text that doesn't read as turns is an error.
    """
    kinds = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in kinds.split(", ")]
        state = None
        done: list[tuple] = []

        def end():
            if state is not None:
                state["reader"].close()
                done.append((state["conv"], state["n"], state["turns"].hexdigest(), state["loss_chars"], state["loss"].hexdigest(), state["chars"], state["allowed"] and state["complete"]))

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_()]
            columns = list(zip(*rows, strict=True)) or [[]] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names)

        for batch in batches:
            for conv, text, loss, allowed, complete in zip(*(batch.column(batch.schema.names.index(x)).to_pylist() for x in ("conv_id", "text", "loss", "allowed", "complete")), strict=True):
                if state is None or conv != state["conv"]:
                    end()
                    state = {"conv": conv, "reader": Reader(template), "turns": hashlib.sha256(), "loss": hashlib.sha256(), "n": 0, "loss_chars": 0, "chars": 0, "allowed": True, "complete": False}
                for role, own, masked in state["reader"].feed(text, loss):
                    state["turns"].update(f"{role}\n{own}\n".encode())
                    state["loss"].update(masked.encode())
                    state["n"] += 1
                    state["loss_chars"] += len(masked)
                state["chars"] += len(text)
                state["allowed"] &= allowed
                state["complete"] = complete
            yield batch_of(done)
            done.clear()
        end()
        yield batch_of(done)

    return formatted.mapInArrow(run, kinds)


#: The contract's own conversation, whose texts hold control strings and the escape character.
PROBE = [(-7, 0, "user", "\\### Assistant: </turn> ok"), (-7, 1, "assistant", "\\### Assistant: </turn> ok")]


def digests(rows: DataFrame) -> DataFrame:
    """All conversations and the probe, formatted and read back."""
    spark = rows.sparkSession
    probe = spark.createDataFrame(PROBE, "conv_id long, turn long, role string, text string")
    own = narrow(rows, conv_id="long", turn="long", role="string", text="string")
    return read_back(format_conversations(own.unionByName(probe))).select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", F.col("valid"))


#: The same in DuckDB's SQL: lengths of the template's parts, escapes counted, and the machine as a pattern over roles.
ORACLE = f"""
WITH turns AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
               UNION ALL SELECT * FROM (VALUES {", ".join(f"({c}, {t}, '{r}', '{x}')" for c, t, r, x in PROBE)})),
sized AS (SELECT *, length(text) + len(regexp_extract_all(text, '\\\\|</turn>|###')) + length(chr(10) || '</turn>' || chr(10))
                 + CASE role WHEN 'system' THEN length('### System:') WHEN 'user' THEN length('### User:') WHEN 'assistant' THEN length('### Assistant:') END + 1 AS chars,
                 CASE WHEN role = 'assistant' THEN text ELSE '' END AS masked FROM turns)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(sum(length(masked)) AS BIGINT) AS loss_chars, sha256(string_agg(masked, '' ORDER BY turn, role, text)) AS loss_sha256, CAST(sum(chars) AS BIGINT) AS formatted_chars,
       regexp_full_match(string_agg(role[1], '' ORDER BY turn, role, text), 's?(ua)+') AS valid
FROM sized GROUP BY conv_id
"""
