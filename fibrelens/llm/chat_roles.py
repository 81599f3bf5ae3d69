"""Transcript parsing: a hidden Markov model recovers the speaker of every line, then turns are
rendered in one canonical form.

A transcript is the sequence of text lines of a conversation. A state is a role together with
whether the line opens a turn or continues it. What is seen of a line is its speaker marker, if
it has one (the row's role column on its first line, or a marker written at the start of a
line), and a category of line features: length, closing mark, list or code form, and whether the
line is the first of its row. Transition and feature probabilities are counted over all rows
whose marker is known, with add-one smoothing; a known marker leaves only its role possible.
Viterbi gives the most likely roles, and lines of one role and turn become one rendered turn.

All rows are sorted by conversation and turn over ranges of any number, and cut into blocks of at most
``BLOCK`` rows of one conversation. A conversation of several blocks is still decoded exactly, as
one sequence: per block a 6 x 6 matrix holds the best score from each state of its first line to each
state of its last one; the matrices are combined per conversation and range, then per conversation,
and from both ends the best state at every block's border follows. Then every block is decoded by
itself between its border states. So neither a long conversation nor one with many null or equal
turns is ever in one task as a whole; of it a task sees one matrix per range.
Rows that repeat conv_id, turn, role and text count once.

Defined cases: a null text has one empty line; a null or unknown role has no marker and is
recovered from context. Null conv_ids form one conversation; null turns come first. Rows with
equal turn are ordered by role and text.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import ship, stored

ROLES = ("system", "user", "assistant")
#: Rows of a block, and bytes of text after which it is closed.
BLOCK, BLOCK_BYTES = 64, 1 << 20
#: Stands for what comes before a conversation's first row: no state and no role.
NOTHING = -2
# Names of speakers as they occur in transcripts.
ALIASES = {
    "system": "system instruction instructions context".split(),
    "user": "user human customer question prompter q me you client".split(),
    "assistant": "assistant ai bot gpt chatbot model answer agent a".split(),
}
_ROLE_OF = {alias: i for i, role in enumerate(ROLES) for alias in ALIASES[role]}
_NAMES = "|".join(sorted(_ROLE_OF, key=len, reverse=True))
_MARKER = re.compile(
    rf"^\s*(?:<\|(?:im_start\|>)?\s*(?P<a>{_NAMES})(?:\|>)?\s*|\#{{1,4}}\s*(?P<b>{_NAMES})\s*:?\s*$|"
    rf"[\[(*_]{{0,3}}(?P<c>{_NAMES})[\])*_]{{0,3}}\s*:[*_]{{0,2}}\s+)",
    re.I,
)
_FORMED = re.compile(r"^\s*(?:[-*+•]\s|\d+[.)]\s|```|>|\|| {4}|\t)")
#: Feature categories of a line: length (5), closing mark (3), form (2), first line of its row (2).
CATEGORIES = 5 * 3 * 2 * 2
STATES = 2 * len(ROLES)  # role * 2 + (0 opens a turn, 1 continues it)


def role_number(name: str | None) -> int:
    return _ROLE_OF.get((name or "").strip().lower(), -1)


def marker(line: str) -> tuple[int, str]:
    """Role that a line's own marker names (-1 without one), and the line without it."""
    found = _MARKER.match(line)
    if not found:
        return -1, line
    return _ROLE_OF[(found["a"] or found["b"] or found["c"]).lower()], line[found.end() :]


def category(line: str, first: bool) -> int:
    length = 0 if not line else min(4, 1 + len(line) // 120)
    close = 1 if line.endswith("?") else 2 if line.endswith((":", "…", ",")) else 0
    return ((length * 3 + close) * 2 + bool(_FORMED.match(line))) * 2 + first


def row_lines(role: str | None, text: str | None) -> list[tuple[int, int, str]]:
    """(marked role, category, content) of the lines of a row."""
    out = []
    for i, line in enumerate((text or "").split("\n")):
        own, content = marker(line)
        out.append((own if own >= 0 or i else role_number(role), category(content, i == 0), content))
    return out


class Model:
    """Log probabilities from the counts ``start``, ``step`` (role to role) and ``seen`` (role, category)."""

    def __init__(self, counts: dict[tuple[str, int, int], int]):
        n = len(ROLES)
        start, step, seen = np.ones(n), np.ones((n, n)), np.ones((n, CATEGORIES))
        more, turns = np.ones(n), np.ones(n)
        for (kind, a, b), k in counts.items():
            if kind == "start":
                start[a] += k
            elif kind == "step":
                step[a, b] += k
            elif kind == "seen":
                seen[a, b] += k
            elif kind == "lines":
                (turns if b == 0 else more)[a] += k
        going = more / (more + turns)
        self.start = np.full(STATES, -1e9)
        self.start[::2] = np.log(start / start.sum())
        self.step = np.full((STATES, STATES), -1e9)
        change = np.log(step / step.sum(1, keepdims=True))
        for a in range(n):
            for inside in range(2):
                self.step[2 * a + inside, 2 * a + 1] = np.log(going[a])
                self.step[2 * a + inside, ::2] = np.log1p(-going[a]) + change[a]
        self.seen = np.repeat(np.log(seen / seen.sum(1, keepdims=True)), 2, axis=0)

    def scores(self, marks: list[int], categories: list[int], firsts: list[bool]) -> np.ndarray:
        """Log probability of each line in each state. A marked line and the first line of a row open a
        turn; other lines of a row continue it."""
        out = self.seen[:, categories].T.copy()
        for line, (mark, first) in enumerate(zip(marks, firsts, strict=True)):
            if mark >= 0:
                own = out[line, 2 * mark]
                out[line] = -1e9
                out[line, 2 * mark] = own
            elif first:
                out[line, 1::2] = -1e9
            else:
                out[line, ::2] = -1e9
        return out

    def entering(self, before: int) -> np.ndarray:
        """Log probability of the first line's states after state ``before`` (or NOTHING)."""
        return self.start if before == NOTHING else self.step[before]

    def viterbi(self, scores: np.ndarray, before: int = NOTHING, last: int | None = None) -> list[int]:
        """Most likely states of lines, after state ``before`` and with state ``last`` at the end if given."""
        if not len(scores):
            return []
        best, back = self.entering(before) + scores[0], []
        for score in scores[1:]:
            paths = best[:, None] + self.step
            back.append(paths.argmax(0))
            best = paths.max(0) + score
        state = int(best.argmax()) if last is None else last
        found = [state]
        for pointers in reversed(back):
            state = int(pointers[state])
            found.append(state)
        return found[::-1]

    def transfer(self, scores: np.ndarray) -> np.ndarray:
        """Best score from each state of the first line to each state of the last one, both counted."""
        best = np.where(np.eye(STATES, dtype=bool), scores[0], -np.inf)
        for score in scores[1:]:
            best = (best[:, :, None] + self.step).max(1) + score
        return best

    def combined(self, parts: list[np.ndarray]) -> np.ndarray:
        """The transfer matrix of consecutive parts."""
        best = parts[0]
        for part in parts[1:]:
            best = ((best[:, :, None] + self.step).max(1)[:, :, None] + part).max(1)
        return best

    def borders(self, parts: list[np.ndarray], before: int = NOTHING, last: int | None = None) -> list[tuple[int, int]]:
        """Per part, the states before it and at its end, on the best path through all parts."""
        reached = [(self.entering(before)[:, None] + parts[0]).max(0)]
        for part in parts[1:]:
            reached.append(((reached[-1][:, None] + self.step).max(0)[:, None] + part).max(0))
        state = int(reached[-1].argmax()) if last is None else last
        found = []
        for part, earlier in zip(reversed(parts[1:]), reversed(reached[:-1])):
            onward = (self.step + part[:, state]).max(1)
            previous = int((earlier + onward).argmax())
            found.append((previous, state))
            state = previous
        return [*found, (before, state)][::-1]


def first_role(role: str | None, text: str | None) -> int:
    """The marked role of a row's first line, -1 without one."""
    own, _ = marker((text or "").split("\n", 1)[0])
    return own if own >= 0 else role_number(role)


_ROW = pa.struct([("role", pa.string()), ("text", pa.string())])


def _cut(batches) -> Iterator[pa.RecordBatch]:
    """Sorted rows of a range to blocks: one row each, with the rows' turns, roles and texts.

    ``before`` is the first row's predecessor's role, NOTHING at the start of a conversation, and null at
    the start of the range, where it is not known here. ``alone`` marks blocks that are known to be a
    whole conversation.
    """
    held, block, before, size, made, schema = [], 0, None, 0, [], None

    def close(ended: bool) -> None:
        made.append((held[0]["conv_id"], held[0]["range"], block, before, ended and before == NOTHING, [r["turn"] for r in held], [{"role": r["role"], "text": r["text"]} for r in held], first_role(held[-1]["role"], held[-1]["text"])))

    def flush() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made), schema)], schema=schema)
        made.clear()
        return out

    for batch in batches:
        if schema is None:
            own = [("range", pa.int32()), ("block", pa.int32()), ("before", pa.int32()), ("alone", pa.bool_())]
            schema = pa.schema([batch.schema.field("conv_id"), *(pa.field(n, k) for n, k in own), pa.field("turns", pa.list_(batch.schema.field("turn").type)), pa.field("rows", pa.list_(_ROW)), pa.field("last_role", pa.int32())])
        for row in batch.to_pylist():
            ended = bool(held) and row["conv_id"] != held[-1]["conv_id"]
            if held and (ended or len(held) >= BLOCK or size >= BLOCK_BYTES):
                close(ended)
                before = NOTHING if ended else made[-1][-1]
                held, block, size = [], block + 1, 0
                if len(made) >= 64:
                    yield flush()
            held.append(row)
            size += len(row["text"] or "")
    if held:
        close(False)
    if made:
        yield flush()


def _blocks(conversations: DataFrame) -> DataFrame:
    """All rows in order, as blocks (conv_id, range, block, before, alone, turns, rows, last_role)."""
    kinds = {n: conversations.schema[n].dataType.simpleString() for n in ("conv_id", "turn")}
    rows = conversations.select("conv_id", "turn", F.col("role").cast("string"), F.col("text").cast("string")).dropDuplicates()
    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role", "text")]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("range", F.spark_partition_id())
    schema = f"conv_id {kinds['conv_id']}, range int, block int, before int, alone boolean, turns array<{kinds['turn']}>, rows array<struct<role:string,text:string>>, last_role int"
    return stored(ranged.mapInArrow(_cut, schema), "turns")


def _range_starts(blocks: DataFrame) -> dict[int, int]:
    """What comes before the first row of each range. One row per range reaches the driver."""
    at = F.struct("block")
    edges = blocks.groupBy("range").agg(
        F.min_by("conv_id", at).alias("first"), F.max_by("conv_id", at).alias("last"), F.max_by("last_role", at).alias("role")
    )
    out, earlier = {}, None
    for edge in sorted(edges.collect(), key=lambda e: e["range"]):
        goes_on = earlier is not None and earlier["last"] == edge["first"]
        out[edge["range"]] = earlier["role"] if goes_on else NOTHING
        earlier = edge
    return out


def _count(starts: dict[int, int]):
    def count(batches):
        counts: Counter = Counter()
        for batch in batches:
            for block in batch.to_pylist():
                before = starts[block["range"]] if block["before"] is None else block["before"]
                for row in block["rows"]:
                    lines = row_lines(row["role"], row["text"])
                    role = lines[0][0]
                    if role >= 0:
                        if before == NOTHING:
                            counts["start", role, 0] += 1
                        elif before >= 0:
                            counts["step", before, role] += 1
                        now = role
                        for i, (mark, what, _) in enumerate(lines):
                            now = mark if mark >= 0 else now
                            counts["seen", now, what] += 1
                            counts["lines", now, int(i > 0 and mark < 0)] += 1
                    before = role
        items = list(counts.items())
        yield pa.RecordBatch.from_pydict(
            {
                "kind": pa.array([k[0] for k, _ in items], pa.string()),
                "a": pa.array([k[1] for k, _ in items], pa.int32()),
                "b": pa.array([k[2] for k, _ in items], pa.int32()),
                "n": pa.array([n for _, n in items], pa.int64()),
            }
        )

    return count


def _learned(blocks: DataFrame) -> Model:
    counted = blocks.select("range", "before", "rows").mapInArrow(_count(_range_starts(blocks)), "kind string, a int, b int, n long")
    return Model({(r["kind"], r["a"], r["b"]): r["n"] for r in counted.groupBy("kind", "a", "b").agg(F.sum("n").alias("n")).collect()})


def learn(conversations: DataFrame) -> Model:
    """Probabilities counted over all rows; a few hundred sums reach the driver."""
    ship(conversations.sparkSession)
    return _learned(_blocks(conversations))


class _Lines:
    """The lines of a block's rows: marks, categories, whether first of a row, contents, and their rows."""

    def __init__(self, rows: list[dict]):
        found = [(r, i, *line) for r, row in enumerate(rows) for i, line in enumerate(row_lines(row["role"], row["text"]))]
        self.owners, places, self.marks, self.what, self.texts = (list(x) for x in zip(*found))
        self.firsts = [i == 0 for i in places]

    def scores(self, model: Model) -> tuple[np.ndarray, np.ndarray]:
        """With markers, and as if there were none."""
        return model.scores(self.marks, self.what, self.firsts), model.scores([-1] * len(self.marks), self.what, self.firsts)


def _transfers(model: Model):
    """Blocks to their transfer matrices, with markers and without."""

    def run(batches):
        for batch in batches:
            both = [[model.transfer(s).ravel().tolist() for s in _Lines(rows).scores(model)] for rows in batch.column("rows").to_pylist()]
            kept = [batch.column(n) for n in ("conv_id", "range", "block")]
            yield pa.RecordBatch.from_arrays([*kept, *(pa.array([b[k] for b in both], pa.list_(pa.float64())) for k in range(2))], ["conv_id", "range", "block", "seen", "blind"])

    return run


def _matrices(parts: list[dict], kind: str) -> list[np.ndarray]:
    return [np.array(part[kind]).reshape(STATES, STATES) for part in parts]


def _combine(model: Model):
    """Blocks of a conversation in a range to one matrix of each kind."""

    def run(batches):
        for batch in batches:
            groups = [sorted(parts, key=lambda p: p["block"]) for parts in batch.column("parts").to_pylist()]
            columns = [pa.array([model.combined(_matrices(g, kind)).ravel().tolist() for g in groups], pa.list_(pa.float64())) for kind in ("seen", "blind")]
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("range"), *columns], ["conv_id", "range", "seen", "blind"])

    return run


def _border_states(model: Model, place: str, given: bool):
    """Groups of parts in the order of ``place`` to the states before and at the end of each part."""

    def run(batches):
        for batch in batches:
            out = []
            for group in batch.to_pylist():
                parts = sorted(group["parts"], key=lambda p: p[place])
                ends = group["ends"] if given else {"seen": (NOTHING, None), "blind": (NOTHING, None)}
                found = [model.borders(_matrices(parts, kind), *(ends[kind] if not given else (ends[f"{kind}_from"], ends[f"{kind}_to"]))) for kind in ("seen", "blind")]
                out += [(group["conv_id"], group["range"] if given else part["range"], part[place], *a, *b) for part, a, b in zip(parts, *found)]
            names = ["conv_id", "range", "block", "seen_from", "seen_to", "blind_from", "blind_to"]
            columns = list(zip(*out)) or [()] * 7
            types = [batch.schema.field("conv_id").type, *[pa.int32()] * 6]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, types)], names)

    return run


def _states(blocks: DataFrame, model: Model) -> DataFrame:
    """(range, block, seen_from, seen_to, blind_from, blind_to) of blocks that are not a whole conversation."""
    kind = blocks.schema["conv_id"].dataType.simpleString()
    matrix, ends = "seen array<double>, blind array<double>", "seen_from int, seen_to int, blind_from int, blind_to int"
    parted = blocks.filter(~F.col("alone")).select("conv_id", "range", "block", "rows")
    parts = stored(parted.mapInArrow(_transfers(model), f"conv_id {kind}, range int, block int, {matrix}"), "transfers")
    ranges = parts.groupBy("conv_id", "range").agg(F.collect_list(F.struct("block", "seen", "blind")).alias("parts"))
    whole = stored(ranges.mapInArrow(_combine(model), f"conv_id {kind}, range int, {matrix}"), "ranges")
    chains = whole.groupBy("conv_id").agg(F.collect_list(F.struct("range", "seen", "blind")).alias("parts"))
    outer = chains.mapInArrow(_border_states(model, "range", False), f"conv_id {kind}, range int, block int, {ends}")
    outer = outer.select(F.col("conv_id").alias("of"), F.col("range").alias("at"), F.struct("seen_from", "seen_to", "blind_from", "blind_to").alias("ends"))
    known = ranges.join(outer, F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("range") == F.col("at"))).select("conv_id", "range", "parts", "ends")
    return known.mapInArrow(_border_states(model, "block", True), f"conv_id {kind}, range int, block int, {ends}").drop("conv_id")


def render(role: str, text: str) -> str:
    """Canonical form of a turn."""
    return f"<|{role}|>\n{text.strip()}\n<|end|>"


def _decode(model: Model):
    def run(batches):
        for batch in batches:
            out: list[tuple] = []
            for block in batch.to_pylist():
                lines = _Lines(block["rows"])
                seen, blind = lines.scores(model)
                if block["alone"]:
                    states, unmarked = model.viterbi(seen), model.viterbi(blind)
                else:
                    states = model.viterbi(seen, block["seen_from"], block["seen_to"])
                    unmarked = model.viterbi(blind, block["blind_from"], block["blind_to"])
                at = part = 0
                while at < len(states):
                    end = at + 1
                    while end < len(states) and lines.owners[end] == lines.owners[at] and states[end] % 2:
                        end += 1
                    part = part + 1 if at and lines.owners[at] == lines.owners[at - 1] else 0
                    role, text = ROLES[states[at] // 2], "\n".join(lines.texts[at:end])
                    out.append((block["conv_id"], block["turns"][lines.owners[at]], part, role, ROLES[unmarked[at] // 2], lines.marks[at] >= 0, render(role, text)))
                    at = end
            types = [batch.schema.field("conv_id").type, batch.schema.field("turns").type.value_type, pa.int32(), pa.string(), pa.string(), pa.bool_(), pa.string()]
            columns = [pa.array(c, k) for c, k in zip(list(zip(*out)) or [()] * 7, types)]
            yield pa.RecordBatch.from_arrays(columns, ["conv_id", "turn", "part", "role", "recovered_role", "marked", "rendered"])

    return run


def canonical_turns(conversations: DataFrame) -> DataFrame:
    """One row per recovered turn: conv_id, turn, part (within its row), role, recovered_role
    (decoded without any marker), marked, rendered."""
    ship(conversations.sparkSession)
    blocks = _blocks(conversations)
    model = _learned(blocks)
    kinds = {n: conversations.schema[n].dataType.simpleString() for n in ("conv_id", "turn")}
    schema = f"conv_id {kinds['conv_id']}, turn {kinds['turn']}, part int, role string, recovered_role string, marked boolean, rendered string"
    states = stored(_states(blocks, model), "states")
    shown = blocks.join(states, ["range", "block"], "left").select("conv_id", "alone", "turns", "rows", "seen_from", "seen_to", "blind_from", "blind_to")
    return shown.mapInArrow(_decode(model), schema)
