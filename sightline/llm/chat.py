"""Chat formatting by a finite-state machine over roles (operator 4).

A declarative template says how each role's turn is marked, which roles may follow which, and which roles' text is
under the loss mask. The machine walks a conversation's turns, checks their order, and emits text segments with a loss
flag each. Control strings inside texts are broken by a backslash after their first character (backslashes are
doubled), so a control string in the output is always the template's own, and reading back restores the texts.

The output of a conversation is one text, with the loss mask as character offsets in it; it is stored in pieces of at
most ``PIECE`` characters, cut wherever that falls. Reading back parses the whole text by the template alone: it knows
neither turns nor segments, and finds every mark in the text.

Turns are dealt by conversation and sorted by turn within a partition; formatting and reading stream over them with the
state of one conversation, so a conversation of any length needs no more memory than one turn.

Defined cases: null text and null role count as empty; turns with equal numbers go in the order of role, then text;
null turns come first; repeated rows are turns of their own; roles the template doesn't name are marked by name, and
such conversations, or those whose order is not allowed, are formatted all the same but flagged invalid; rows with a
null conv_id form one conversation; an empty table gives no rows; further columns are ignored. A template whose marks
are empty, hold a backslash, open two roles alike, or could arise across the seam of a text and a mark raises ValueError,
and so does text that isn't the template's.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.llm.common import as_batch, bounded_batches


@dataclass(frozen=True)
class Template:
    """Marks before and after each role's text, roles under loss, and the machine's transitions.

    ``start`` is the state before the first turn; a role may come in a state if ``follows`` lists it there; the
    state after it is the role. ``ends`` are the states a conversation may end in.
    """

    marks: dict[str, tuple[str, str]] = field(default_factory=lambda: {
        "system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>")})
    other: tuple[str, str, str] = ("<<ROLE>>", "<</ROLE>>", "<</TURN>>")
    loss: frozenset[str] = frozenset({"assistant"})
    start: str = ""
    follows: dict[str, frozenset[str]] = field(default_factory=lambda: {
        "": frozenset({"system", "user"}), "system": frozenset({"user"}), "user": frozenset({"assistant"}), "assistant": frozenset({"user"})})
    ends: frozenset[str] = frozenset({"user", "assistant"})

    def __post_init__(self) -> None:
        marks = self.controls()
        opening = [before for before, _ in self.marks.values()] + [self.other[0]]
        if any(not c or "\\" in c for c in marks) or len(set(opening)) < len(opening):
            raise ValueError("marks must not be empty, hold a backslash, or open two roles alike")
        ends = [after for _, after in self.marks.values()] + [*self.other[1:]]
        for c in marks:
            for rest in (c[k:] for k in range(1, len(c))):
                if any(e.startswith(rest) or rest.startswith(e) for e in ends):
                    raise ValueError(f"the mark {c!r} could arise where a text meets the mark after it")

    def controls(self) -> list[str]:
        return sorted({c for pair in self.marks.values() for c in pair} | set(self.other), key=lambda c: (-len(c), c))

    def breaker(self) -> re.Pattern:
        return re.compile("|".join(map(re.escape, ["\\", *self.controls()])))

    def escape(self, text: str, breaker: re.Pattern) -> str:
        return breaker.sub(lambda m: m[0][0] + "\\" + m[0][1:], text)

    def segments(self, role: str, text: str, breaker: re.Pattern) -> list[tuple[str, bool]]:
        """(formatted text, under loss) of one turn."""
        body = self.escape(text, breaker)
        if role in self.marks:
            before, after = self.marks[role]
            return [(before, False), (body, role in self.loss), (after, False)]
        head = self.other[0] + self.escape(role, breaker) + self.other[1]
        return [(head, False), (body, False), (self.other[2], False)]


def unescape(text: str) -> str:
    """The text that ``escape`` was given: a doubled backslash is one, any other backslash goes."""
    if "\\" not in text:
        return text
    return re.sub(r"\\\\|\\", lambda m: "\\" if len(m[0]) == 2 else "", text)


SEGMENT = pa.schema([("conv_id", pa.int64()), ("turn_no", pa.int64()), ("segment", pa.int32()), ("text", pa.string()), ("loss", pa.bool_()), ("valid", pa.bool_())])
SEGMENTS = "conv_id long, turn_no long, segment int, text string, loss boolean, valid boolean"


def ordered(turns: DataFrame) -> DataFrame:
    """A conversation's turns together and in order within a partition."""
    bounded_batches(turns.sparkSession)
    return (turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                         F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
            .repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text"))


def format_turns(turns: DataFrame, template: Template | None = None) -> DataFrame:
    """Segments of all conversations, in order within each partition. ``valid``: the order was allowed so far."""
    t = template or Template()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        breaker = t.breaker()
        conv, state, valid, n = object(), t.start, True, 0
        for b in batches:
            rows = []
            for c, role, text in zip(*(b.column(x).to_pylist() for x in ("conv_id", "role", "text")), strict=True):
                if c != conv:
                    conv, state, valid, n = c, t.start, True, 0
                valid = valid and role in t.follows.get(state, ())
                state = role
                rows += [(c, n, k, s, loss, valid) for k, (s, loss) in enumerate(t.segments(role, text, breaker))]
                n += 1
            if rows:
                yield as_batch(dict(zip(SEGMENT.names, zip(*rows, strict=True), strict=True)), SEGMENT)

    return ordered(turns).mapInArrow(run, SEGMENTS)


#: Characters of a stored piece of a conversation's output.
PIECE = 1 << 16
PIECES = pa.schema([("conv_id", pa.int64()), ("piece", pa.int64()), ("start", pa.int64()), ("text", pa.string()),
                    ("loss", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("valid", pa.bool_())])
PIECES_DDL = "conv_id long, piece long, start long, text string, loss array<struct<start:long,end:long>>, valid boolean"


class Joiner:
    """One conversation's segments as pieces of its whole text, with the loss mask as offsets in that text."""

    def __init__(self, conv, size: int):
        self.conv, self.size = conv, size
        self.piece = self.start = self.end = 0
        self.text: list[str] = []
        self.loss: list[dict[str, int]] = []

    def add(self, text: str, loss: bool, valid: bool) -> Iterator[tuple]:
        while text:
            part, text = text[: self.size - (self.end - self.start)], text[self.size - (self.end - self.start) :]
            if loss:
                if self.loss and self.loss[-1]["end"] == self.end:
                    self.loss[-1]["end"] += len(part)
                else:
                    self.loss.append({"start": self.end, "end": self.end + len(part)})
            self.text.append(part)
            self.end += len(part)
            if self.end - self.start == self.size:
                yield self.out(valid)

    def out(self, valid: bool) -> tuple:
        row = self.conv, self.piece, self.start, "".join(self.text), self.loss, valid
        self.piece, self.start, self.text, self.loss = self.piece + 1, self.end, [], []
        return row


def formatted(turns: DataFrame, template: Template | None = None, piece: int = PIECE) -> DataFrame:
    """The output of each conversation: ``conv_id``, ``piece`` (number), ``start`` (its offset), ``text``, ``loss`` (spans
    in the conversation's whole text) and ``valid`` (the order was allowed so far), in order within each partition."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        joiner, last = None, True
        for b in batches:
            rows, size = [], 0
            for c, text, loss, valid in zip(*(b.column(x).to_pylist() for x in ("conv_id", "text", "loss", "valid")), strict=True):
                if joiner is None or c != joiner.conv:
                    if joiner is not None:
                        rows.append(joiner.out(last))
                    joiner = Joiner(c, piece)
                for row in joiner.add(text, loss, valid):
                    rows.append(row)
                    size += len(row[3])
                    if size > 8 << 20:
                        yield as_batch(dict(zip(PIECES.names, zip(*rows, strict=True), strict=True)), PIECES)
                        rows, size = [], 0
                last = valid
            if rows:
                yield as_batch(dict(zip(PIECES.names, zip(*rows, strict=True), strict=True)), PIECES)
        if joiner is not None:
            yield as_batch(dict(zip(PIECES.names, zip(joiner.out(last), strict=True), strict=True)), PIECES)

    return format_turns(turns, template).mapInArrow(run, PIECES_DDL)


class Plain:
    """Undoes escaping in a text that comes in parts."""

    def __init__(self):
        self.open = False  # the parts so far end within an escape

    def feed(self, part: str) -> str:
        if self.open:
            part, self.open = "\\" + part, False
        if "\\" not in part:
            return part
        if (len(part) - len(part.rstrip("\\"))) % 2:
            part, self.open = part[:-1], True
        return unescape(part)


class Reader:
    """Parses one conversation's output, given in parts cut anywhere, by the template alone."""

    def __init__(self, template: Template):
        self.t = template
        self.opening = {before: role for role, (before, _) in template.marks.items()}
        marks = template.controls()
        self.mark, self.longest = re.compile("|".join(map(re.escape, marks))), len(marks[0])
        self.n_turns = self.formatted = self.loss_chars = 0
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.masked = Plain()
        self.rest = ""
        self.role: str | None = None  # of the turn that is open
        self.name: list[str] | None = None  # of a role that the template doesn't mark, while it is read
        self.plain = Plain()
        self.closing = ""
        self.last = template.start

    def feed(self, text: str, loss: list[dict[str, int]]) -> None:
        at = self.formatted
        self.formatted += len(text)
        for span in loss:
            plain = self.masked.feed(text[span["start"] - at : span["end"] - at])
            self.loss_chars += len(plain)
            self.loss.update(plain.encode())
        self.parse(self.rest + text, False)

    def parse(self, text: str, final: bool) -> None:
        at = 0
        while (m := self.mark.search(text, at)) and (final or m.start() + self.longest <= len(text)):
            self.inside(text[at : m.start()])
            self.meet(m[0])
            at = m.end()
        keep = len(text) if final else max(at, len(text) - self.longest + 1)
        self.inside(text[at:keep])
        self.rest = text[keep:]

    def inside(self, text: str) -> None:
        if not text:
            return
        if self.name is not None:
            self.name.append(text)
        elif self.role is None:
            raise ValueError("text outside of a turn")
        else:
            self.turns.update(self.plain.feed(text).encode())

    def meet(self, mark: str) -> None:
        head, tail, end = self.t.other
        if self.name is not None:
            if mark != tail:
                raise ValueError("a role's name without its end")
            self.begin(unescape("".join(self.name)), end)
        elif self.role is not None:
            if mark != self.closing:
                raise ValueError("a turn that another mark breaks")
            self.turns.update(b"\n")
            self.n_turns, self.last, self.role = self.n_turns + 1, self.role, None
        elif mark == head:
            self.name = []
        elif mark in self.opening:
            self.begin(self.opening[mark], self.t.marks[self.opening[mark]][1])
        else:
            raise ValueError("a turn without its beginning")

    def begin(self, role: str, closing: str) -> None:
        self.role, self.closing, self.name, self.plain = role, closing, None, Plain()
        self.turns.update(f"{role}\n".encode())

    def row(self, conv, valid: bool) -> tuple:
        self.parse(self.rest, True)
        if self.role is not None or self.name is not None:
            raise ValueError("a conversation that ends within a turn")
        return conv, self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.formatted, valid and self.last in self.t.ends


READ = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()),
                  ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("valid", pa.bool_())])


def read_back(output: DataFrame, template: Template | None = None) -> DataFrame:
    """One row of counts and digests for each conversation, from ``formatted``'s output alone. Pieces must be in order
    within a partition, as ``formatted`` gives them; stored ones are to be sorted by conv_id and piece first."""
    t = template or Template()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, reader, good = None, None, True
        for b in batches:
            done = []
            for c, text, loss, valid in zip(*(b.column(x).to_pylist() for x in ("conv_id", "text", "loss", "valid")), strict=True):
                if reader is None or c != conv:
                    if reader is not None:
                        done.append(reader.row(conv, good))
                    conv, reader = c, Reader(t)
                reader.feed(text, loss)
                good = valid
            if done:
                yield as_batch(dict(zip(READ.names, zip(*done, strict=True), strict=True)), READ)
        if reader is not None:
            yield as_batch(dict(zip(READ.names, ([v] for v in reader.row(conv, good)), strict=True)), READ)

    return output.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean")
