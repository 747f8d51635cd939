"""Chat formatting by a finite-state machine over roles and a declarative template.

A template gives each role the strings around its text, whether its text bears loss,
and which roles may follow which.  Each turn gives three segments: opening, text,
closing.  Control strings inside a text are broken by a backslash after their first
character, and backslashes are doubled, so no text can pose as a mark and every
text can be read back: a parser gets turns, roles and what bears loss from the joined text alone.

Rows are partitioned by conversation and sorted by turn; tasks stream through
them with one turn in memory, so a long conversation needs no more room than a
short one.

Defined cases: null text or role counts as empty; rows with a null conv_id take no part;
null turns come first; rows of one turn are ordered by role and text, and repeated rows are
turns of their own; a conversation whose order breaks the rules is formatted all the same and
carries valid = false; an unknown role gets the template's general marks; an empty
table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """Marks and rules. next_roles maps the state, the role before ("" at the start), to the roles allowed."""

    open: dict[str, str] = field(default_factory=lambda: {"system": "<<SYS>>", "user": "[INST] ", "assistant": "<s>"})
    close: dict[str, str] = field(default_factory=lambda: {"system": "<</SYS>>", "user": " [/INST]", "assistant": "</s>"})
    other_open: tuple[str, str] = ("<|role:", "|>")
    other_close: str = "<|end|>"
    loss: frozenset[str] = frozenset({"assistant"})
    next_roles: dict[str, frozenset[str]] = field(
        default_factory=lambda: {
            "": frozenset({"system", "user"}),
            "system": frozenset({"user"}),
            "user": frozenset({"assistant"}),
            "assistant": frozenset({"user"}),
        }
    )

    @property
    def controls(self) -> list[str]:
        """Everything that must not occur in a text, without the spaces around it."""
        marks = [*self.open.values(), *self.close.values(), *self.other_open, self.other_close]
        return sorted({m.strip() for m in marks}, key=lambda m: (-len(m), m))


class Formatter:
    def __init__(self, template: Template):
        self.template = template
        self.control = re.compile("|".join(map(re.escape, template.controls)))
        #: the first character of each mark, also where marks overlap
        self.begins = re.compile(f"(?={self.control.pattern})(.)", re.S)
        self.role_of = {mark: role for role, mark in template.open.items()}

    def escape(self, text: str) -> str:
        return self.begins.sub(r"\1\\", text.replace("\\", "\\\\"))

    @staticmethod
    def unescape(text: str) -> str:
        return re.sub(r"\\(\\?)", r"\1", text)

    def turn(self, role: str, text: str) -> list[tuple[str, bool]]:
        """(segment, loss flag) of a turn."""
        t = self.template
        if role in t.open:
            opening, closing = t.open[role], t.close[role]
        else:
            opening, closing = f"{t.other_open[0]}{self.escape(role)}{t.other_open[1]}", t.other_close
        return [(opening, False), (self.escape(text), role in t.loss), (closing, False)]

    def allowed(self, before: str, role: str) -> bool:
        return role in self.template.next_roles.get(before, frozenset())


class Parser:
    """Turns of a formatted conversation from its text alone, which comes in pieces of any length; one turn is in memory."""

    def __init__(self, formatter: Formatter):
        self.formatter, self.marks = formatter, sorted(formatter.role_of, key=len, reverse=True)
        #: what isn't parsed yet; the role whose text it begins with, if its opening was read; where its closing may begin
        self.rest, self.role, self.at = "", None, 0

    def _opening(self) -> bool:
        """Read an opening mark, if it is there as a whole."""
        before, after = self.formatter.template.other_open
        for mark in self.marks:
            if self.rest.startswith(mark):
                self.role, self.rest = self.formatter.role_of[mark], self.rest[len(mark) :]
                return True
            if mark.startswith(self.rest):
                return False
        if self.rest.startswith(before):
            end = self.rest.find(after, len(before))
            if end < 0:
                return False
            self.role, self.rest = self.formatter.unescape(self.rest[len(before) : end]), self.rest[end + len(after) :]
            return True
        if not before.startswith(self.rest):
            raise ValueError(f"no opening mark at {self.rest[:20]!r}")
        return False

    def feed(self, piece: str) -> Iterator[tuple[str, str]]:
        """(role, text) of the turns that this piece ends."""
        self.rest += piece
        template = self.formatter.template
        while self.role is not None or (self.rest and self._opening()):
            close = template.close[self.role] if self.role in template.open else template.other_close
            end = self.rest.find(close, self.at)
            if end < 0:
                self.at = max(0, len(self.rest) - len(close) + 1)
                return
            yield self.role, self.formatter.unescape(self.rest[:end])
            self.rest, self.role, self.at = self.rest[end + len(close) :], None, 0

    def end(self) -> None:
        if self.rest or self.role is not None:
            raise ValueError("the text ends within a turn")


SEGMENTS = "conv_id long, turn_no long, part int, segment string, loss boolean, valid boolean"


def _segments(template: Template):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        formatter, current, before, number = Formatter(template), None, "", 0
        for batch in batches:
            rows = []
            for conv, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if conv != current:
                    current, before, number = conv, "", 0
                role, text = role or "", text or ""
                valid = formatter.allowed(before, role)
                rows += [(conv, number, part, segment, loss, valid) for part, (segment, loss) in enumerate(formatter.turn(role, text))]
                before, number = role, number + 1
            if rows:
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.bool_(), pa.bool_())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["conv_id", "turn_no", "part", "segment", "loss", "valid"])

    return run


def chat_segments(conversations: DataFrame, template: Template | None = None) -> DataFrame:
    """conv_id, turn_no, part (0 opening, 1 text, 2 closing), segment, loss, valid; within a partition in order."""
    rows = conversations.selectExpr("cast(conv_id as long) conv_id", "turn", "role", "text").filter("conv_id is not null")
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")
    return rows.mapInArrow(_segments(template or Template()), SEGMENTS)


def read_back(segments: DataFrame, template: Template | None = None) -> DataFrame:
    """Per conversation, digests of its turns, parsed from the formatted text, and of the text under the loss mask; whether its order is valid.

    What bears loss is cut out of the segments by their flags.  The parsed turns are a check: where their roles give another
    loss text than the flags, the job fails.  Segments must come as chat_segments gives them: a conversation's in order, in one partition.
    """
    template = template or Template()
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "valid"]
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_())

    class Digest:
        def __init__(self, conv, formatter):
            self.conv, self.formatter, self.parser = conv, formatter, Parser(formatter)
            self.turns = self.loss_chars = self.chars = 0
            self.all, self.loss, self.parsed, self.valid, self.before = hashlib.sha256(), hashlib.sha256(), hashlib.sha256(), True, ""

        def add(self, piece, masked):
            self.chars += len(piece)
            if masked:
                text = self.formatter.unescape(piece)
                self.loss.update(text.encode("utf-8", "surrogatepass"))
                self.loss_chars += len(text)
            for role, text in self.parser.feed(piece):
                self.turns += 1
                self.valid &= self.formatter.allowed(self.before, role)
                self.before = role
                self.all.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                if role in template.loss:
                    self.parsed.update(text.encode("utf-8", "surrogatepass"))

        def row(self):
            self.parser.end()
            if self.loss.digest() != self.parsed.digest():
                raise ValueError(f"the loss mask of conversation {self.conv} doesn't fit its text")
            return (self.conv, self.turns, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars, self.valid)

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    def run(batches):
        formatter, now = Formatter(template), None
        for batch in batches:
            rows = []
            for conv, piece, masked in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "segment", "loss")), strict=True):
                if now is None or conv != now.conv:
                    if now is not None:
                        rows.append(now.row())
                    now = Digest(conv, formatter)
                now.add(piece, masked)
            if rows:
                yield batch_of(rows)
        if now is not None:
            yield batch_of([now.row()])

    return segments.select("conv_id", "segment", "loss").mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean")


def chat_texts(conversations: DataFrame, template: Template | None = None) -> DataFrame:
    """conv_id, text (formatted), and spans (start, length) of what bears loss; one row per conversation."""
    s = chat_segments(conversations, template).select("conv_id", F.struct("turn_no", "part", "segment", "loss").alias("s"))
    one = s.groupBy("conv_id").agg(F.sort_array(F.collect_list("s")).alias("s"))
    starts = F.expr("aggregate(s, cast(array() as array<struct<start:int,length:int,loss:boolean>>), (a, x) -> concat(a, array(struct(coalesce(try_element_at(a, -1).start + try_element_at(a, -1).length, 0) as start, length(x.segment) as length, x.loss as loss))))")
    return one.select("conv_id", F.array_join("s.segment", "").alias("text"), F.transform(F.filter(starts, lambda x: x["loss"]), lambda x: F.struct(x["start"].alias("start"), x["length"].alias("length"))).alias("spans"))
