"""Chat formatting by a finite-state machine over roles, from a declarative template.

A template is a table: (state, role) gives the next state, the marks before and behind
the turn's text, and whether the text is under the loss mask. The machine walks the turns
of a conversation in order and emits three segments a turn - mark, text, mark - each
with its loss flag. A role that the state has no step for gets a stray turn: its name is
written inside marks, the conversation counts as invalid, and what follows is stray too.

Control strings inside texts are broken up: a backslash comes behind their first
character, and backslashes are doubled, so taking the backslashes away restores the text.
A template is refused where a mark could be found at another place than it was put.

Conversations may be of any length. Rows go to tasks by (conversation, chunk of turn
numbers), so one that holds a third of all rows is spread. Chunks that are not a
conversation's first need the state before them: of conversations with several chunks
only, each chunk's roles become a map from state to state, and the maps are applied in
order. The maps are a row for each chunk, and no task gathers a conversation: rows stream
by in order.

Defined cases: a null text is empty, a null role is the role ''; rows are ordered by turn
(null first), then role, then text, so that ties and repeated rows have one order; null
ids are one conversation; an empty table has no conversations; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from atticsweep.llm.common import rows_of, spread_parts
from atticsweep.session import written

STRAY = "stray"
ROWS_A_TASK = 50_000
ORDERED = "conv_id bigint, chunk bigint, kind int, turn bigint, role string, text string, long boolean"
FORMATTED = "conv_id bigint, chunk bigint, long boolean, turn bigint, place bigint, valid boolean, segments array<struct<text: string, loss: boolean>>"
SEGMENTS = pa.list_(pa.struct([("text", pa.string()), ("loss", pa.bool_())]))


@dataclass(frozen=True)
class Step:
    """What a role does in a state."""

    then: str
    before: str
    after: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    """Steps by (state, role), the control strings, and the marks of stray turns."""

    start: str
    steps: dict[tuple[str, str], Step]
    controls: tuple[str, ...]
    name_marks: tuple[str, str] = ("[ROLE]", "[/ROLE]")  # around the name of a stray role
    end_mark: str = "[END]"  # behind the text of a stray turn
    stray_loss: tuple[str, ...] = ("assistant",)

    def __post_init__(self):
        for mark in {s.after for s in self.steps.values()} | {self.end_mark, self.name_marks[1]}:
            ends = [mark.find(c) + len(c) for c in self.all_controls if c in mark]
            if not ends:
                raise ValueError(f"the mark {mark!r} holds no control string, so texts could hold it")
            # Found k characters too early, the mark would begin in the text; with k from ends on, its control string would be there.
            if any(mark.startswith(mark[k:]) for k in range(1, min(ends))):
                raise ValueError(f"the mark {mark!r} begins as it ends, so it could be found too early")
        if any(len(c) < 2 or "\\" in c for c in self.all_controls):
            raise ValueError("a control string has two characters or more, and no backslash")
        for state in self.states:
            marks = [s.before for (at, _), s in self.steps.items() if at == state]
            if len(set(marks)) < len(marks):
                raise ValueError(f"two roles have one mark in the state {state!r}")
            for shorter in marks:
                for longer in marks:
                    rest = longer[len(shorter) :] if longer.startswith(shorter) else ""
                    if rest and not any(c in rest for c in self.all_controls):
                        raise ValueError(f"the mark {longer!r} could be {shorter!r} and a text")

    @cached_property
    def all_controls(self) -> tuple[str, ...]:
        return (*self.controls, *self.name_marks, self.end_mark)

    @cached_property
    def states(self) -> list[str]:
        return sorted({self.start, STRAY, *(at for at, _ in self.steps), *(s.then for s in self.steps.values())})

    @cached_property
    def _breaks(self) -> re.Pattern:
        return re.compile("|".join(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in self.all_controls))

    def escape(self, text: str) -> str:
        return self._breaks.sub(lambda m: m[0] + "\\", text.replace("\\", "\\\\"))

    def unescape(self, text: str) -> str:
        return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL) if "\\" in text else text

    def step(self, state: str, role: str) -> Step:
        found = self.steps.get((state, role))
        if found is None or state == STRAY:
            before = f"{self.name_marks[0]}{self.escape(role)}{self.name_marks[1]}"
            return Step(STRAY, before, self.end_mark, role in self.stray_loss)
        return found

    def segments(self, step: Step, text: str) -> list[dict]:
        body = {"text": self.escape(text), "loss": step.loss}
        return [{"text": step.before, "loss": False}, body, {"text": step.after, "loss": False}]

    def read(self, state: str, formatted: str, at: int = 0) -> tuple[str, str, Step, int]:
        """The turn that begins at ``at``: its role, its text unescaped, its step, and where it ends."""
        opening, closing = self.name_marks
        if formatted.startswith(opening, at):
            end = formatted.index(closing, at + len(opening))
            role = self.unescape(formatted[at + len(opening) : end])
            step, begin = self.step(STRAY, role), end + len(closing)
        else:
            fits = [(len(s.before), role) for (of, role), s in self.steps.items() if of == state and formatted.startswith(s.before, at)]
            length, role = max(fits)
            step, begin = self.steps[state, role], at + length
        end = formatted.index(step.after, begin)
        return role, self.unescape(formatted[begin:end]), step, end + len(step.after)


INSTRUCTIONS = Template(
    start="new",
    steps={
        ("new", "system"): Step("told", "<s>[INST] <<SYS>>\n", "\n<</SYS>>\n\n"),
        ("new", "user"): Step("asked", "<s>[INST] ", " [/INST]"),
        ("told", "user"): Step("asked", "", " [/INST]"),
        ("asked", "assistant"): Step("answered", " ", " </s>", loss=True),
        ("answered", "user"): Step("asked", "<s>[INST] ", " [/INST]"),
    },
    controls=("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"),
)


def _in_order(conversations: DataFrame, chunk_turns: int) -> DataFrame:
    turn = F.col("turn").cast("bigint")
    return conversations.select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        F.coalesce(F.floor(turn / F.lit(chunk_turns)), F.lit(-(1 << 62))).cast("bigint").alias("chunk"),
        F.lit(1).alias("kind"),
        turn.alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        F.lit(None).cast("boolean").alias("long"),
    )


def _record(rows: list[tuple], schema: str, **kinds: pa.DataType) -> pa.RecordBatch:
    known = {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}
    fields = [(f.split()[0], f.split()[1]) for f in re.sub(r"<.*>", "", schema).split(", ")]
    columns = [pa.array(c, kinds.get(name) or known[k]) for c, (name, k) in zip(zip(*rows, strict=True), fields, strict=True)]
    return pa.RecordBatch.from_arrays(columns, names=[name for name, _ in fields])


def _entry_states(rows: DataFrame, template: Template, tasks: int) -> DataFrame:
    """Of conversations with several chunks: each chunk with the state that the chunks before it end in, as a row of kind 0."""
    chunks = rows.groupBy("conv_id").agg(F.min("chunk").alias("first"), F.max("chunk").alias("last"))
    several = written(chunks.filter("first < last").select(F.col("conv_id").alias("of")))
    states = template.states

    def maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each chunk's map: where its turns lead from every state."""
        current, at = None, states
        for batch in batches:
            out = []
            for conv_id, chunk, role in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if (conv_id, chunk) != current:
                    out += [(*current, ",".join(at))] if current else []
                    current, at = (conv_id, chunk), states
                at = [template.step(s, role).then for s in at]
            if out:
                yield _record(out, "conv_id bigint, chunk bigint, map string")
        if current:
            yield _record([(*current, ",".join(at))], "conv_id bigint, chunk bigint, map string")

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted by chunk: the state before each."""
        current, state = None, template.start
        for batch in batches:
            out = []
            for conv_id, chunk, leads in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if current != (conv_id,):
                    current, state = (conv_id,), template.start
                out.append((conv_id, chunk, 0, None, state, None, True))
                state = leads.split(",")[states.index(state)]
            yield _record(out, ORDERED)

    light = rows.select("conv_id", "chunk", "role", "turn", "text").join(several.hint("merge"), F.col("conv_id").eqNullSafe(F.col("of")), "left_semi")
    # Rows that tie in turn and role lead to the same state in any order.
    dealt = light.select("conv_id", "chunk", "role", "turn").repartition(tasks, "conv_id", "chunk").sortWithinPartitions("conv_id", "chunk", "turn", "role")
    mapped = dealt.select("conv_id", "chunk", "role").mapInArrow(maps, "conv_id bigint, chunk bigint, map string")
    return mapped.repartition(tasks, "conv_id").sortWithinPartitions("conv_id", "chunk").mapInArrow(entries, ORDERED)


def format_turns(conversations: DataFrame, template: Template = INSTRUCTIONS, chunk_turns: int = 4096) -> DataFrame:
    """A row for each turn: its conversation, its place in the chunk, its segments, and whether all turns up to it are in order.

    Rows of a chunk are in one partition, in order; ``long`` marks conversations of several chunks.
    """
    spark = conversations.sparkSession
    rows = _in_order(conversations, chunk_turns)
    tasks = spread_parts(spark, rows.count(), ROWS_A_TASK)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state, long, place = None, template.start, False, 0
        for batch in rows_of(batches):
            out = []
            for conv_id, chunk, kind, turn, role, text in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                if (conv_id, chunk) != current:
                    current, state, long, place = (conv_id, chunk), template.start, False, 0
                if kind == 0:
                    state, long = role, True
                    continue
                step = template.step(state, role)
                out.append((conv_id, chunk, long, turn, place, step.then != STRAY, template.segments(step, text)))
                state, place = step.then, place + 1
            if out:
                yield _record(out, FORMATTED, segments=SEGMENTS)

    met = rows.unionByName(_entry_states(rows, template, tasks))
    dealt = met.repartition(tasks, "conv_id", "chunk").sortWithinPartitions("conv_id", "chunk", "kind", "turn", "role", "text")
    return dealt.mapInArrow(walk, FORMATTED)


READ = (
    "conv_id bigint, chunk bigint, place bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, "
    "formatted_chars bigint, valid boolean, formatted string"
)


@dataclass
class _Reading:
    """What is read back of one conversation so far."""

    template: Template
    conv_id: int | None
    state: str
    turns: int = 0
    loss_chars: int = 0
    chars: int = 0
    valid: bool = True
    all_turns: object = field(default_factory=hashlib.sha256)
    loss: object = field(default_factory=hashlib.sha256)

    def add(self, formatted: str) -> None:
        """All turns of a piece of the output."""
        at = 0
        while at < len(formatted):
            role, text, step, at = self.template.read(self.state, formatted, at)
            self.state = step.then
            self.valid &= step.then != STRAY
            self.turns += 1
            self.all_turns.update(f"{role}\n{text}\n".encode())
            if step.loss:
                self.loss_chars += len(text)
                self.loss.update(text.encode())
        self.chars += len(formatted)

    def row(self) -> tuple:
        digests = self.all_turns.hexdigest(), self.loss_chars, self.loss.hexdigest()
        return (self.conv_id, None, None, self.turns, *digests, self.chars, self.valid, None)


def read_back(formatted: DataFrame, template: Template = INSTRUCTIONS) -> DataFrame:
    """Per conversation of ``format_turns``: what its formatted text says, parsed by the template, and digests of it.

    A digest needs a conversation's turns in order. Conversations of one chunk are read where
    they were formatted; of longer ones the formatted turns go to one task each, which reads
    them as they stream by and holds one turn at a time.
    """

    def read(keep_long: bool):
        def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now: _Reading | None = None
            for batch in rows_of(batches):
                out = []
                for conv_id, chunk, place, long, text in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                    if long and keep_long:
                        out.append((conv_id, chunk, place, None, None, None, None, None, None, text))
                        continue
                    if now is None or now.conv_id != conv_id:
                        out += [now.row()] if now else []
                        now = _Reading(template, conv_id, template.start)
                    now.add(text)
                if out:
                    yield _record(out, READ)
            if now:
                yield _record([now.row()], READ)

        return pieces

    text = F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted")
    there = formatted.select("conv_id", "chunk", "place", "long", text).mapInArrow(read(True), READ)
    first = written(there)
    long = first.filter("formatted IS NOT NULL").select("conv_id", "chunk", "place", F.lit(True).alias("long"), "formatted")
    tasks = int(formatted.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = long.repartition(tasks, "conv_id").sortWithinPartitions("conv_id", "chunk", "place")
    both = first.filter("formatted IS NULL").unionByName(dealt.mapInArrow(read(False), READ))
    return both.select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "valid")


def format_digests(conversations: DataFrame, **settings) -> DataFrame:
    """All conversations and number -7, whose texts are made of control strings, formatted and read back."""
    mine = conversations.select(*(F.col(c).cast(k).alias(c) for c, k in (("conv_id", "bigint"), ("turn", "bigint"), ("role", "string"), ("text", "string"))))
    rows = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]
    planted = conversations.sparkSession.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    return read_back(format_turns(mine.unionByName(planted), **settings))
