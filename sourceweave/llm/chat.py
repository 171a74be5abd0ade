"""Transcript parsing: a hidden Markov model recovers the roles, then turns are rendered canonically.

A transcript is a sequence of units: the stretches of text between speaker markers, or whole rows where a text has
none. The observation of a unit is made of its marker and of features of its lines; the states are the roles. All
log-probabilities are integers, with a pseudo-random tie-breaker in the low bits that depends on the unit alone, so the best
path is unique and does not depend on how rows are dealt out.

Units are ordered over all transcripts and dealt to range parts. Only the transcripts that reach over a border of parts
need more than their own part: for these each part reports one small max-plus matrix, the driver chains at most two
of them a part, and every part then follows its own best paths. A transcript may hold any share of all rows.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sourceweave.llm.common import materialise, shuffle_partitions, small_batches

ROLES = ("system", "user", "assistant")
FOLDS = 5
#: Scale of the integer log-probabilities, and bits of it that break ties.
SCALE, TIE_BITS = 1 << 24, 8
#: Weight of a marker that names a role, as a probability that it is right.
MARKER_TRUST = 0.98

#: Speaker markers by role: fixed values.
MARKERS = {
    "system": ("system", "sys", "instructions"),
    "user": ("user", "human", "customer", "client", "question", "q", "prompter", "me"),
    "assistant": ("assistant", "ai", "bot", "agent", "gpt", "model", "answer", "a", "response"),
}
_NAMES = {name: role for role, names in MARKERS.items() for name in names}
_NAME = "|".join(sorted(_NAMES, key=len, reverse=True))
_MARKER = re.compile(
    rf"^[ \t]*(?:<\|im_start\|>[ \t]*(?P<a>{_NAME})[ \t]*$|<\|(?P<b>{_NAME})\|>|\#\#\#[ \t]*(?P<c>{_NAME})[ \t]*:?|\[(?P<d>{_NAME})\][ \t]*:?|\*\*(?P<e>{_NAME})[ \t]*:?\*\*:?|(?P<f>{_NAME})[ \t]*:)[ \t]*",
    re.IGNORECASE | re.MULTILINE,
)
_END = re.compile(r"<\|(?:im_end|end|eot_id)\|>")
LENGTHS = (20, 60, 120, 200, 300, 500, 900)


def split_units(text: str | None) -> list[tuple[str, str]]:
    """(marked role or "", content) of the stretches of a text, markers and end tokens removed."""
    text = text or ""
    found = list(_MARKER.finditer(text))
    out = []
    if not found or text[: found[0].start()].strip():
        out.append(("", _END.sub("", text[: found[0].start()] if found else text).strip()))
    for here, after in zip(found, [*found[1:], None]):
        name = next(g for g in here.groups() if g).lower()
        out.append((_NAMES[name], _END.sub("", text[here.end() : after.start() if after else len(text)]).strip()))
    return out


def observation(content: str, first: bool) -> int:
    """Class of a unit by its lines: length, number of lines, a question at the end, and whether it begins a transcript."""
    length = sum(len(content) >= n for n in LENGTHS)
    lines = min(content.count("\n"), 2)
    return ((length * 3 + lines) * 2 + content.endswith("?")) * 2 + first


N_OBSERVATIONS = (len(LENGTHS) + 1) * 12


def _tie(conv: object, turn: object, unit: int, role: int) -> int:
    return zlib.crc32(f"{conv},{turn},{unit},{role}".encode()) & ((1 << TIE_BITS) - 1)


def _scaled(p: np.ndarray) -> np.ndarray:
    return (np.round(np.log(p) * SCALE / (1 << TIE_BITS)).astype(np.int64)) << TIE_BITS


class Model:
    """Start, transition and emission scores as integers."""

    def __init__(self, start: np.ndarray, change: np.ndarray, emit: np.ndarray) -> None:
        """From counts: start (roles), change (role, next role), emit (role, observation); each smoothed by one."""
        smooth = lambda c: (c + 1.0) / (c + 1.0).sum(axis=-1, keepdims=True)
        self.start, self.change, self.emit = _scaled(smooth(start)), _scaled(smooth(change)), _scaled(smooth(emit))
        n = len(ROLES)
        self.marked = _scaled(np.where(np.eye(n, dtype=bool), MARKER_TRUST, (1 - MARKER_TRUST) / (n - 1)))

    def emissions(self, conv: object, turn: object, unit: int, marker: str, seen: int) -> list[int]:
        said = self.marked[:, ROLES.index(marker)] if marker else np.zeros(len(ROLES), dtype=np.int64)
        return [int(self.emit[k, seen] + said[k]) + _tie(conv, turn, unit, k) for k in range(len(ROLES))]


def viterbi(model: Model, emissions: list[list[int]], entry: list[int] | None = None, last: int | None = None) -> list[int]:
    """Best states of a stretch of units. entry: best scores of the states before it; last: the state it must end in."""
    states = range(len(ROLES))
    change, back, now = model.change.tolist(), [], entry
    for emission in emissions:
        if now is None:
            now = [int(model.start[k]) + emission[k] for k in states]
            back.append(None)
            continue
        from_ = [max(states, key=lambda j, k=k: now[j] + change[j][k]) for k in states]
        now = [now[from_[k]] + change[from_[k]][k] + emission[k] for k in states]
        most = max(now)
        now = [x - most for x in now]
        back.append(from_)
    state = last if last is not None else max(states, key=lambda k: now[k])
    out = [state]
    for from_ in reversed(back[1:]):
        out.append(from_[out[-1]])
    return out[::-1]


def transfer(model: Model, emissions: list[list[int]]) -> np.ndarray:
    """Max-plus matrix of a stretch: best score from a state before it to a state at its end, up to a constant."""
    whole = None
    for emission in emissions:
        step = model.change + np.array(emission, dtype=np.int64)[None, :]
        whole = step if whole is None else (whole[:, :, None] + step[None, :, :]).max(axis=1)
        whole = whole - whole.max()
    return whole


def units(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The units of all rows: with their content (row, unit, conv_id, turn, content), and in order, without it.

    The second table has conv_id, turn, row, unit, role, marker and seen, in range parts (column part). Contents are
    written once and stay where they are until the roles are known.
    """

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, unit, marker, content, seen = [], [], [], [], []
            for row, text in enumerate(batch.column("text").to_pylist()):
                for k, (role, body) in enumerate(split_units(text)):
                    at.append(row)
                    unit.append(k)
                    marker.append(role)
                    content.append(body)
                    seen.append(observation(body, False))
            take = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(c).take(take) for c in ("conv_id", "turn", "row", "role")] + [pa.array(unit, pa.int32()), pa.array(marker, pa.string()), pa.array(content, pa.string()), pa.array(seen, pa.int32())],
                names=["conv_id", "turn", "row", "role", "unit", "marker", "content", "seen"],
            )

    small_batches(turns.sparkSession)
    rows = turns.select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), F.monotonically_increasing_id().alias("row"),
        F.lower(F.trim(F.col("role").cast("string"))).alias("role"), F.col("text").cast("string").alias("text"),
    )
    split_rows = materialise(rows.mapInArrow(split, "conv_id bigint, turn bigint, row bigint, role string, unit int, marker string, content string, seen int"), "units", "zstd")
    order = ["conv_id", "turn", "row", "unit"]
    dealt = split_rows.drop("content").repartitionByRange(shuffle_partitions(turns.sparkSession), *order).withColumn("part", F.spark_partition_id())
    return split_rows.select("row", "unit", "conv_id", "turn", "content"), materialise(dealt.sortWithinPartitions(*order), "transcripts")


def learn(dealt: DataFrame) -> Model:
    """Counts over the units of training transcripts (crc32(conv_id as text) mod FOLDS is not 0) with a known role.

    Transitions over a border of parts are not counted: one a part at most.
    """
    state = F.array_position(F.array(*map(F.lit, ROLES)), F.col("role")).cast("int") - 1
    within = Window.partitionBy("part", "conv_id").orderBy("turn", "row", "unit")
    conv = F.coalesce(F.col("conv_id").cast("string"), F.lit("")).cast("binary")
    known = dealt.where(F.col("role").isin(*ROLES)).where(F.crc32(conv) % FOLDS != 0)
    rows = known.select(state.alias("state"), "seen", F.lag(state).over(within).alias("before")).groupBy("state", "seen", "before").count().collect()  # roles x roles x observations at most
    n = len(ROLES)
    start, change, emit = np.zeros(n), np.zeros((n, n)), np.zeros((n, N_OBSERVATIONS))
    for r in rows:
        emit[r.state, r.seen] += r["count"]
        if r.before is None:
            start[r.state] += r["count"]
        else:
            change[r.before, r.state] += r["count"]
    return Model(start, change, emit)


_UNIT_FIELDS = ("part", "conv_id", "turn", "row", "unit", "marker", "seen")


def _emissions(model: Model, run: list[tuple]) -> list[list[int]]:
    return [model.emissions(row[1], row[2], *row[4:7]) for row in run]


def _stretches(batches: Iterator[pa.RecordBatch], columns: tuple[str, ...]) -> Iterator[tuple[tuple, list[tuple]]]:
    """Runs of rows of the same (part, conv_id), in order."""
    key, run = None, []
    for batch in batches:
        for row in zip(*[batch.column(c).to_pylist() for c in columns]):
            if row[:2] != key:
                if run:
                    yield key, run
                key, run = row[:2], []
            run.append(row)
    if run:
        yield key, run


def parse(turns: DataFrame) -> DataFrame:
    """conv_id, turn, unit, held_out, role_pred, content, rendered for each unit of ``turns`` (conv_id, turn, role, text).

    Roles are only read of training transcripts, to learn the model; unknown and null ones are not learnt from.
    Null and empty texts are units without content. Rows of a conversation are ordered by turn, null turns first,
    rows that repeat a turn by their place in the scan; null conv_ids make one transcript. A very long text is cut into
    units like any other, and a transcript of any length is read part by part. An empty table gives an empty result;
    other columns are not read.
    """
    spark = turns.sparkSession
    contents, dealt = units(turns)
    model = spark.sparkContext.broadcast(learn(dealt))
    in_order = dealt.select(*_UNIT_FIELDS).repartition(shuffle_partitions(spark), "part").sortWithinPartitions("part", "conv_id", "turn", "row", "unit")
    ends = dealt.groupBy("part").agg(F.min(F.struct("conv_id", "turn", "row", "unit")).alias("low"), F.max(F.struct("conv_id", "turn", "row", "unit")).alias("high")).collect()  # a row a part
    ends = sorted(((r.part, r.low.conv_id, r.high.conv_id) for r in ends), key=lambda r: r[0])
    shared = {(part, conv) for a, b in zip(ends, ends[1:]) if a[2] == b[1] for part, conv in ((a[0], a[2]), (b[0], b[1]))}
    border = spark.sparkContext.broadcast(shared)

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, run in _stretches(batches, _UNIT_FIELDS):
            if key in border.value:
                emissions = _emissions(model.value, run)
                matrix = transfer(model.value, emissions).ravel().tolist()
                first = emissions[0]
                rest = transfer(model.value, emissions[1:]) if len(run) > 1 else np.where(np.eye(len(ROLES), dtype=bool), 0, -(1 << 60))
                yield pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int64()), pa.array([matrix]), pa.array([first]), pa.array([rest.ravel().tolist()])], names=["part", "conv_id", "matrix", "first", "rest"])

    plans: dict[tuple, tuple[list[int] | None, int | None]] = {}
    if shared:
        told = in_order.mapInArrow(summarise, "part int, conv_id bigint, matrix array<bigint>, first array<bigint>, rest array<bigint>").collect()  # two rows a part at most
        plans = _chain(model.value, sorted(((r.part, r.conv_id, r.matrix, r.first, r.rest) for r in told), key=lambda r: r[0]))
    fixed = spark.sparkContext.broadcast(plans)

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, run in _stretches(batches, _UNIT_FIELDS):
            entry, last = fixed.value.get(key, (None, None))
            roles = [ROLES[k] for k in viterbi(model.value, _emissions(model.value, run), entry, last)]
            yield pa.RecordBatch.from_arrays([pa.array([r[3] for r in run], pa.int64()), pa.array([r[4] for r in run], pa.int32()), pa.array(roles)], names=["row", "unit", "role_pred"])

    found = contents.join(in_order.mapInArrow(follow, "row bigint, unit int, role_pred string"), ["row", "unit"])
    conv = F.coalesce(F.col("conv_id").cast("string"), F.lit("")).cast("binary")
    return found.select("conv_id", "turn", "unit", (F.crc32(conv) % FOLDS == 0).alias("held_out"), "role_pred", "content", rendered().alias("rendered"))


def _chain(model: Model, told: list[tuple]) -> dict[tuple, tuple[list[int] | None, int | None]]:
    """For each stretch of a transcript that reaches over parts: the scores before it and the state it ends in."""
    n, plans, at = len(ROLES), {}, 0
    while at < len(told):
        stop = at
        while stop < len(told) and told[stop][1] == told[at][1]:
            stop += 1
        chain, entries = told[at:stop], []
        now = None
        for _, _, matrix, first, rest in chain:
            entries.append(now)
            whole = np.array(matrix, dtype=np.int64).reshape(n, n)
            if now is None:
                now = ((model.start + np.array(first))[:, None] + np.array(rest, dtype=np.int64).reshape(n, n)).max(axis=0)
            else:
                now = (np.array(now)[:, None] + whole).max(axis=0)
            now = (now - now.max()).tolist()
        state = int(np.argmax(now))
        for (part, conv, matrix, _, _), entry in zip(reversed(chain), reversed(entries)):
            plans[(part, conv)] = (entry, state)
            if entry is not None:
                state = int(np.argmax(np.array(entry) + np.array(matrix, dtype=np.int64).reshape(n, n)[:, state]))
        at = stop
    return plans


def rendered() -> Column:
    """The canonical form of a turn from its role_pred and content."""
    return F.concat(F.lit("<|im_start|>"), "role_pred", F.lit("\n"), "content", F.lit("<|im_end|>\n"))
