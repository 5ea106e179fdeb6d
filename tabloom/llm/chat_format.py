r"""Chat formatting with a grammar that is read back.

A turn is rendered as

    <turn>### Assistant:
    its text
    </turn>

and a text may hold any of these strings itself. A rendered turn is read again by
the grammar's parser, and while the turn it recovers is not the one that was
given, the kind of control string that stood in the way is escaped: a backslash
goes in after its first character, ``<\/turn>``, ``#\## Assistant:``. A text that
already looks escaped is such a conflict too, and gets one backslash more; the
parser takes one away. So no text holds a control string as it is, most texts
are rendered as they are, and all come back identical. A role that the template
has no name for is written as a JSON string.

The parser reads from mark to mark and never beyond the end of a turn. Turns that
come back one by one therefore come back in a row, and rendering needs no more
than a turn at a time: rows are dealt by ranges of (conversation, turn), so a
conversation of very many turns spreads over tasks, and is written in segments of
about ``SEGMENT`` characters, in order of ``part``. Each holds the spans, in code
points, of the texts that training is to predict.

Digests over a conversation are chains: those of a conversation in one segment
are made where it is read; longer ones stream through one task, segment by
segment, in bounded memory, and only they are exchanged.

Defined results: a null text or role is empty; null conversation ids are one
conversation, null turns come first; rows of one turn are ordered by role and MD5 of
the text, and equal rows are turns of their own; an empty table gives no rows.
Other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.llm.common import Store, bound_batches, take_worker, tasks

#: Characters of a segment, about (a longer turn is one of its own), and of segments in one batch.
SEGMENT, BATCH = 32_768, 4_000_000


class Conflict(ValueError):
    """What stands at ``at`` does not follow the grammar; ``kind`` is the control string met there, if one was."""

    def __init__(self, at: int, kind: str | None = None):
        super().__init__(f"not in the grammar at {at}" + (f": {kind}" if kind else ""))
        self.at, self.kind = at, kind


@dataclass(frozen=True)
class Turn:
    role: str
    text: str
    #: where the text, as rendered, begins and ends
    start: int
    end: int


@dataclass(frozen=True)
class Template:
    begin: str = "<turn>"
    end: str = "</turn>"
    heading: str = "### "
    names: tuple[tuple[str, str], ...] = (("system", "System"), ("user", "User"), ("assistant", "Assistant"))
    #: roles whose texts training predicts
    trained: tuple[str, ...] = ("assistant",)

    def __post_init__(self):
        if any(len(c) < 2 or re.search(r'[\\\n"]', c) for c in self.controls) or len(set(self.controls)) != len(self.controls):
            raise ValueError("control strings are unlike, of two characters at least, without backslash, quote and line end")
        if any(a != b and a in b for a in self.controls for b in self.controls):
            raise ValueError("no control string may hold another")

    @cached_property
    def controls(self) -> list[str]:
        return [self.begin, self.end, *(f"{self.heading}{name}:" for _, name in self.names)]

    @cached_property
    def pattern(self) -> re.Pattern:
        r"""Each control string, with any number of backslashes after its first character."""
        return re.compile("|".join(rf"{re.escape(c[0])}(?:\\*){re.escape(c[1:])}" for c in self.controls))

    def header(self, role: str) -> str:
        name = dict(self.names).get(role)
        if name is None:
            name = json.dumps(role, ensure_ascii=False)
            for first in sorted({c[0] for c in self.controls}):
                name = name.replace(first, f"\\u{ord(first):04x}")
        return f"{self.begin}{self.heading}{name}:\n"

    def escape(self, text: str, kinds: set[str]) -> str:
        """One backslash more in the control strings of these kinds."""
        if not kinds:
            return text
        return self.pattern.sub(lambda m: f"{m[0][0]}\\{m[0][1:]}" if _plain(m[0]) in kinds else m[0], text)

    def unescape(self, text: str) -> str:
        """One backslash less in every control string that has any."""
        return self.pattern.sub(lambda m: m[0].replace("\\", "", 1), text)

    def render(self, role: str, text: str) -> str:
        """The turn, escaped as far as it takes to read it back."""
        header, kinds = self.header(role), set()
        while True:
            out = f"{header}{self.escape(text, kinds)}\n{self.end}\n"
            kind = self.conflict(out, role, text, kinds)
            if kind is None:
                return out
            if kind in kinds:
                raise ValueError(f"turn can't be escaped: {kind}")
            kinds.add(kind)

    def conflict(self, out: str, role: str, text: str, kinds: set[str]) -> str | None:
        """The kind of control string for which the rendered turn does not come back as given; None if it does."""
        try:
            turns = list(self.parse(out))
            if len(turns) == 1 and (turns[0].role, turns[0].text) == (role, text):
                return None
        except Conflict as e:
            if e.kind is not None:
                return e.kind
        # the text ended its turn, or lost a backslash of its own
        return next(k for m in self.pattern.finditer(text) if (k := _plain(m[0])) not in kinds)

    def parse(self, formatted: str) -> Iterator[Turn]:
        """The turns of rendered text; ``Conflict`` where it is none."""
        at, names = 0, {name: role for role, name in self.names}
        while at < len(formatted):
            head = f"{self.begin}{self.heading}"
            if not formatted.startswith(head, at):
                raise Conflict(at)
            at += len(head)
            if formatted.startswith('"', at):
                try:
                    role, after = json.JSONDecoder().raw_decode(formatted, at)
                except ValueError as e:
                    raise Conflict(at) from e
            else:
                after = formatted.find(":", at)
                role = names.get(formatted[at:after]) if after > 0 else None
            if role is None or not formatted.startswith(":\n", after):
                raise Conflict(at)
            start = after + 2
            stop = self._stop(formatted, start)
            yield Turn(role, self.unescape(formatted[start:stop]), start, stop)
            at = stop + len(self.end) + 2

    def _stop(self, formatted: str, start: int) -> int:
        for m in self.pattern.finditer(formatted, start):
            if m[0] == self.end and m.start() > start and formatted[m.start() - 1] == "\n" and formatted.startswith("\n", m.end()):
                return m.start() - 1
            if "\\" not in m[0]:
                raise Conflict(m.start(), m[0])
        raise Conflict(len(formatted))


def _plain(found: str) -> str:
    return found.replace("\\", "")


PLAIN = Template()


def ordered(df: DataFrame) -> DataFrame:
    """conv_id, role, text in order of conversation and turn, over all tasks."""
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    rows = df.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.md5(text).alias("digest"))
    keys = ["conv_id", "turn", "role", "digest", "place"]  # places part rows that are equal
    rows = rows.withColumn("place", F.monotonically_increasing_id())
    return rows.repartitionByRange(tasks(df.sparkSession), *keys).sortWithinPartitions(*keys).select("conv_id", F.spark_partition_id().alias("part"), "role", "text")


def render(df: DataFrame, template: Template = PLAIN, segment: int = SEGMENT) -> DataFrame:
    """conv_id, part, whole, n_turns, formatted, loss for frame (conv_id, turn, role, text): a row for each segment.

    ``part`` orders the segments of a conversation, ``whole`` says that it has no
    other (never of one that meets its task's first or last row), ``loss`` has
    the spans under the loss mask.
    """
    kind = df.schema["conv_id"].dataType.simpleString()
    bound_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_worker("chat-format")
        ids, out, held = [], [], 0
        conv, text, spans, turns = None, [], [], 0
        n_chars, count, opened = 0, 0, False  # opened: the conversation began within this task, after another
        base, began, kind_ = 0, False, None

        def close(whole: bool) -> None:
            nonlocal text, spans, turns, n_chars, count, held
            ids.append(conv)
            out.append((base + count, whole, turns, "".join(text), spans))
            held += n_chars
            text, spans, turns, n_chars, count = [], [], 0, 0, count + 1

        def batch_of() -> pa.RecordBatch:
            nonlocal held
            columns = [pa.array(ids, kind_), *(pa.array([o[i] for o in out], t) for i, t in enumerate((pa.int64(), pa.bool_(), pa.int64(), pa.string())))]
            columns.append(pa.array([o[4] for o in out], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))))
            ids.clear()
            out.clear()
            held = 0
            return pa.RecordBatch.from_arrays(columns, names=["conv_id", "part", "whole", "n_turns", "formatted", "loss"])

        parted = False  # an earlier segment of this conversation was closed
        for batch in batches:
            kind_ = batch.schema.field("conv_id").type
            for c, p, role, said in zip(*(batch.column(x).to_pylist() for x in ("conv_id", "part", "role", "text")), strict=True):
                if not began:
                    base, began, conv = p << 33, True, c
                elif c != conv:
                    close(opened and not parted)
                    conv, opened, parted = c, True, False
                elif n_chars >= segment:
                    close(False)
                    parted = True
                if held > BATCH:
                    yield batch_of()
                turn = template.render(role, said)
                if role in template.trained:
                    start = n_chars + len(template.header(role))
                    spans.append({"start": start, "end": n_chars + len(turn) - len(template.end) - 2})
                text.append(turn)
                n_chars += len(turn)
                turns += 1
        if began:
            close(False)
            yield batch_of()

    return ordered(df).mapInArrow(run, f"conv_id {kind}, part long, whole boolean, n_turns long, formatted string, loss array<struct<start:long,end:long>>")


class _Digest:
    """Of a conversation's segments, in order, what is read back from them."""

    def __init__(self, template: Template):
        self.template, self.turns, self.loss = template, hashlib.sha256(), hashlib.sha256()
        self.n = self.loss_chars = self.chars = 0

    def add(self, formatted: str, loss: list[dict]) -> None:
        for t in self.template.parse(formatted):
            self.turns.update(f"{t.role}\n{t.text}\n".encode())
            self.n += 1
        for span in loss:
            text = self.template.unescape(formatted[span["start"] : span["end"]])
            self.loss.update(text.encode())
            self.loss_chars += len(text)
        self.chars += len(formatted)

    def row(self) -> tuple:
        return self.n, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def read_back(segments: DataFrame, template: Template = PLAIN) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars of each conversation, parsed from its segments."""
    kind = segments.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    types = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())

    def made(ids: pa.Array, rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([ids, *(pa.array([r[i] for r in rows], t) for i, t in enumerate(types))], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_worker("chat-format")
        for batch in batches:
            rows = []
            for formatted, loss in zip(batch.column("formatted").to_pylist(), batch.column("loss").to_pylist(), strict=True):
                digest = _Digest(template)
                digest.add(formatted, loss)
                rows.append(digest.row())
            yield made(batch.column("conv_id"), rows)

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_worker("chat-format")
        conv, digest, kind_ = None, None, None
        for batch in batches:
            kind_ = batch.schema.field("conv_id").type
            for c, formatted, loss in zip(*(batch.column(x).to_pylist() for x in ("conv_id", "formatted", "loss")), strict=True):
                if digest is None or c != conv:
                    if digest is not None:
                        yield made(pa.array([conv], kind_), [digest.row()])
                    conv, digest = c, _Digest(template)
                digest.add(formatted, loss)
        if digest is not None:
            yield made(pa.array([conv], kind_), [digest.row()])

    rest = segments.where("not whole").select("conv_id", "part", "formatted", "loss")
    rest = rest.repartition(tasks(segments.sparkSession), "conv_id").sortWithinPartitions("conv_id", "part")
    return segments.where("whole").select("conv_id", "formatted", "loss").mapInArrow(one, schema).unionByName(rest.mapInArrow(chain, schema))


def turns_of(segments: DataFrame, template: Template = PLAIN) -> DataFrame:
    """conv_id, part, at, role, text: the turns as the parser recovers them."""
    kind = segments.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, formatted in enumerate(batch.column("formatted").to_pylist()):
                found = list(template.parse(formatted))
                of = [batch.column(c).take(pa.array([i] * len(found), pa.int64())) for c in ("conv_id", "part")]
                columns = [*of, pa.array(range(len(found)), pa.int64()), pa.array([t.role for t in found], pa.string()), pa.array([t.text for t in found], pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=["conv_id", "part", "at", "role", "text"])

    return segments.select("conv_id", "part", "formatted").mapInArrow(run, f"conv_id {kind}, part long, at long, role string, text string")


def format_chats(df: DataFrame, template: Template = PLAIN, segment: int = SEGMENT) -> DataFrame:
    """The segments, written and read again."""
    return Store(df.sparkSession, "chat-format").keep(render(df, template, segment), "segments")
