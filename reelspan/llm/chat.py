"""Chat formatting: a hidden Markov model over lines recovers who speaks before turns are rendered."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ngramjoin import _lists
from .scratch import Scratch, make_importable

#: The last one stands for any further role.
ROLES = ("system", "user", "assistant", "other")
#: State 2r begins a turn of role r, state 2r + 1 goes on with it.
STATES = 2 * len(ROLES)
# Names that stand for a role at the start of a line, before a colon.
NAMES = {"system": ("system", "instructions"), "user": ("user", "human", "customer", "q"), "assistant": ("assistant", "ai", "bot", "agent", "a")}
#: Lines of a chunk; a longer transcript is decoded chunk by chunk.
CHUNK = 2048
LINES_PER_TASK = 1 << 14
#: Values of the line features: marker (none, one per named role, another name), line before, length, question, first line.
MARKERS, BEFORE, LENGTHS = 2 + len(NAMES), 3, 6
OBSERVATIONS = MARKERS * BEFORE * LENGTHS * 2 * 2
_ANY = r"^\s*(?:\*\*|\[|<\||#+ ?)?([A-Za-z]{1,12})(?:\*\*|\]|\|>)?\s*:"


def _marker(line: Column) -> Column:
    name = F.lower(F.regexp_extract(line, _ANY, 1))
    out = F.when(name == "", 0)
    for k, known in enumerate(NAMES.values()):
        out = out.when(name.isin(*known), k + 1)
    return out.otherwise(MARKERS - 1)


def observe(lines: DataFrame) -> DataFrame:
    """Add ``obs``, one number for a line's features, to (conv, chunk, at, line), if it isn't there; the line before is taken across chunks.

    The window runs inside a chunk; each chunk's last line is carried to the next by a join.
    """
    if "obs" in lines.columns:
        return lines
    size = F.char_length("line")
    length = F.when(size == 0, 0).when(size < 20, 1).when(size < 60, 2).when(size < 150, 3).when(size < 400, 4).otherwise(5)
    last = lines.groupBy("conv", "chunk").agg(F.max_by("line", "at").alias("carried")).withColumn("chunk", F.col("chunk") + 1)
    own = Window.partitionBy("conv", "chunk").orderBy("at")
    joined = lines.join(last.hint("merge"), ["conv", "chunk"], "left").withColumn("previous", F.coalesce(F.lag("line").over(own), "carried"))
    before = F.when(F.col("previous").isNull(), 2).when(F.trim("previous") == "", 1).otherwise(0)
    number = _marker(F.col("line"))
    for part, n in ((before, BEFORE), (length, LENGTHS), (F.rtrim("line").endswith("?").cast("int"), 2), ((F.col("at") == 0).cast("int"), 2)):
        number = number * n + part
    return joined.select(*lines.columns, number.cast("int").alias("obs"))


@dataclass
class ChatModel:
    """Log probabilities: start of a transcript, step from state to state, line features given the state."""

    start: np.ndarray
    step: np.ndarray
    emit: np.ndarray


def to_lines(transcripts: DataFrame, conv: str = "conv_id", text: str = "text") -> DataFrame:
    """(conv, chunk, at, line) of transcripts, one row each; a null text has no lines."""
    cut = transcripts.where(F.col(text).isNotNull()).select(F.col(conv).alias("conv"), F.posexplode(F.split(text, "\n", -1)).alias("at", "line"))
    return cut.select("conv", F.floor(F.col("at") / CHUNK).cast("long").alias("chunk"), F.col("at").cast("long").alias("at"), "line")


def learn(lines: DataFrame) -> ChatModel:
    """Count starts, steps and features over labelled lines (conv, chunk, at, line, state), all of them, with a count added to each.

    Features are counted one by one and multiplied for lines that the labelled ones lack.
    """
    seen = observe(lines)
    own = Window.partitionBy("conv", "chunk").orderBy("at")
    steps = seen.withColumn("old", F.lag("state").over(own)).groupBy("old", "state").agg(F.count(F.lit(1)).alias("n")).where("state is not null").collect()
    emitted = seen.groupBy("state", "obs").agg(F.count(F.lit(1)).alias("n")).where("state is not null").collect()
    first = seen.where("at = 0").groupBy("state").agg(F.count(F.lit(1)).alias("n")).where("state is not null").collect()
    start, step, emit = np.full(STATES, 0.1), np.full((STATES, STATES), 0.1), np.zeros((STATES, OBSERVATIONS))
    start[1::2] = 1e-6
    for a in range(STATES):
        for r in range(len(ROLES)):
            if a // 2 != r:
                step[a, 2 * r + 1] = 1e-9
    for r in first:
        start[r["state"]] += r["n"]
    for r in steps:
        if r["old"] is not None:
            step[r["old"], r["state"]] += r["n"]
    for r in emitted:
        emit[r["state"], r["obs"]] += r["n"]
    for r in np.flatnonzero(emit.sum(axis=1).reshape(len(ROLES), 2).sum(axis=1) == 0) if emit.any() else ():
        start[2 * r], step[:, 2 * r] = 1e-12, 1e-12  # a role without any line is never entered
    shape = (STATES, MARKERS, BEFORE, LENGTHS, 2, 2)
    backed = np.ones(shape)
    counts = emit.reshape(shape)
    for axis in range(1, len(shape)):
        rest = tuple(k for k in range(1, len(shape)) if k != axis)
        m = counts.sum(axis=rest, keepdims=True) + (0.01 if axis == 1 else 0.5)
        backed = backed * (m / m.sum(axis=axis, keepdims=True))
    emit = emit + 20 * backed.reshape(STATES, OBSERVATIONS)
    norm = lambda x: np.log(x / x.sum(axis=-1, keepdims=True))
    return ChatModel(norm(start), norm(step), norm(emit))


def viterbi(obs: np.ndarray, model: ChatModel, first: np.ndarray, last: int | None = None) -> np.ndarray:
    """Most likely states; ``first`` has the log probability of each state at the first line, ``last`` fixes the last state."""
    score = first + model.emit[:, obs[0]]
    back = np.zeros((len(obs), STATES), dtype=np.int8)
    for t in range(1, len(obs)):
        through = score[:, None] + model.step
        back[t] = through.argmax(axis=0)
        score = through.max(axis=0) + model.emit[:, obs[t]]
    out = np.empty(len(obs), dtype=np.int64)
    out[-1] = score.argmax() if last is None else last
    for t in range(len(obs) - 1, 0, -1):
        out[t - 1] = back[t, out[t]]
    return out


def _span(obs: np.ndarray, model: ChatModel, first: np.ndarray) -> np.ndarray:
    """Best log probability of a chunk from each state before it to each state at its end."""
    score = first + model.emit[:, obs[0]]
    for o in obs[1:]:
        score = (score[:, :, None] + model.step).max(axis=1) + model.emit[:, o]
    return score


def _spans(model: ChatModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start = np.tile(model.start, (STATES, 1))
        for batch in batches:
            rows = zip(_lists(pa.Table.from_batches([batch]), "obs"), batch.column("chunk").to_pylist(), strict=True)
            spans = [_span(o, model, model.step if chunk else start).ravel().tolist() for o, chunk in rows]
            yield pa.RecordBatch.from_arrays([batch.column("conv"), batch.column("chunk"), pa.array(spans, pa.list_(pa.float64()))], names=["conv", "chunk", "span"])

    return run


def _ends(_key: tuple, table: pa.Table) -> pa.Table:
    """States before and at the end of each chunk of one transcript, from the chunks' spans."""
    table = table.sort_by("chunk")
    score, backs = np.zeros(STATES), []
    for x in table.column("span").to_pylist():
        through = score[:, None] + np.array(x).reshape(STATES, STATES)
        backs.append(through.argmax(axis=0))
        score = through.max(axis=0)
    state, before, after = int(score.argmax()), [], []
    for back in reversed(backs):
        after.append(state)
        state = int(back[state])
        before.append(state)
    return pa.table({"conv": table.column("conv"), "chunk": table.column("chunk"), "before": pa.array(before[::-1], pa.int32()), "after": pa.array(after[::-1], pa.int32())})


def _decode(model: ChatModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            states = []
            for o, chunk, before, after in zip(_lists(pa.Table.from_batches([batch]), "obs"), batch.column("chunk").to_pylist(), batch.column("before").to_pylist(), batch.column("after").to_pylist(), strict=True):
                states.append(viterbi(o, model, model.start if chunk == 0 else model.step[before], after).tolist())
            yield pa.RecordBatch.from_arrays([batch.column("conv"), batch.column("chunk"), pa.array(states, pa.list_(pa.int32()))], names=["conv", "chunk", "states"])

    return run


def decode(lines: DataFrame, model: ChatModel) -> DataFrame:
    """Add ``state``, the line's place in the most likely sequence of its transcript.

    A transcript of one chunk is decoded at once. For a longer one, the best way through each chunk is found
    for every pair of states at its ends; one pass over these per transcript (36 numbers for ``CHUNK``
    lines) fixes the states between chunks; then the chunks are decoded apart. The result is that of the
    algorithm over the whole transcript.
    """
    scratch = Scratch(lines.sparkSession, "chat")
    conv = lines.schema["conv"].dataType.simpleString()
    obs = observe(lines)
    chunks = obs.groupBy("conv", "chunk").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "obs"))), lambda x: x["obs"]).alias("obs"))
    chunks = scratch.write(chunks, "chunks")
    # the work is in the lines, not in the bytes of their numbers
    tasks = -(-(chunks.agg(F.sum(F.size("obs"))).first()[0] or 1) // LINES_PER_TASK)
    chunks = chunks.repartition(tasks, "conv", "chunk")
    long = chunks.where("chunk = 1").select("conv").distinct()
    spans = chunks.join(long.hint("merge"), "conv", "left_semi").select("conv", "chunk", "obs").mapInArrow(_spans(model), f"conv {conv}, chunk long, span array<double>")
    ends = scratch.write(spans.groupBy("conv").applyInArrow(_ends, f"conv {conv}, chunk long, before int, after int"), "ends")
    filled = chunks.join(ends.hint("merge"), ["conv", "chunk"], "left")
    found = scratch.write(filled.mapInArrow(_decode(model), f"conv {conv}, chunk long, states array<int>"), "states")
    each = found.select("conv", "chunk", F.posexplode("states").alias("k", "state")).select("conv", (F.col("chunk") * CHUNK + F.col("k")).alias("at"), "state")
    return lines.join(each.hint("merge"), ["conv", "at"])


def render(lines: DataFrame) -> DataFrame:
    """Turns of decoded lines: conv, turn (from 0), role, content and rendered.

    A turn begins where a state begins one, and at the first line. Numbers are summed chunk by chunk, then
    inside a chunk. Markers that name a speaker are taken off a turn's first line; blank ends are cut.
    """
    begins = ((F.col("state") % 2 == 0) | (F.col("at") == 0)).cast("int")
    marked = lines.withColumn("begins", begins)
    per_chunk = marked.groupBy("conv", "chunk").agg(F.sum("begins").alias("m"))
    earlier = Window.partitionBy("conv").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    base = per_chunk.select("conv", "chunk", F.coalesce(F.sum("m").over(earlier), F.lit(0)).alias("base"))
    inside = Window.partitionBy("conv", "chunk").orderBy("at")
    numbered = marked.join(base.hint("merge"), ["conv", "chunk"]).withColumn("turn", F.col("base") + F.sum("begins").over(inside) - 1)
    turns = numbered.groupBy("conv", "turn").agg(F.min_by("state", "at").alias("state"), F.array_sort(F.collect_list(F.struct("at", "line"))).alias("rows"))
    role = F.element_at(F.array(*[F.lit(r) for r in ROLES]), (F.floor(F.col("state") / 2) + 1).cast("int"))
    known = "|".join(n for names in NAMES.values() for n in names)
    marker = r"(?i)^\s*(?:\*\*|\[|<\||#+ ?)?(?:" + known + r")(?:\*\*|\]|\|>)?\s*:\s*"
    text = F.array_join(F.transform("rows", lambda r: r["line"]), "\n")
    bare = F.when(role == ROLES[-1], F.regexp_replace(text, _ANY, "")).otherwise(F.regexp_replace(text, marker, ""))
    content = F.regexp_replace(F.regexp_replace(bare, r"^\s+", ""), r"\s+\z", "")
    shown = turns.select(F.col("conv").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), content.alias("content"))
    return shown.withColumn("rendered", F.concat(F.lit("<|"), "role", F.lit("|>\n"), "content", F.lit("\n<|end|>")))


def format_transcripts(transcripts: DataFrame, model: ChatModel) -> DataFrame:
    """Raw transcripts (conv_id, text) as canonical turns: conv_id, turn, role, content, rendered.

    A null text has no turns, an empty one a single empty turn. Texts that share a conv_id are kept apart
    only if their conv_id differs, so give each its own; a null conv_id is left out. Other columns are not
    read. An empty table gives no rows.
    """
    make_importable(transcripts.sparkSession)
    return render(decode(to_lines(transcripts.where(F.col("conv_id").isNotNull())), model))


def raw_transcripts(conversations: DataFrame) -> DataFrame:
    """(conv, chunk, at, line, state): the turns of ``conversations`` as the lines of raw transcripts, with the true states.

    Speakers are marked in the way of one of four dumps, by conv_id: role names, other names, role names with
    every third turn bare, no names but blank lines between turns. Turns of a role without a state of its own,
    null included, are marked by that role's name and have the state of "other". A null text is an empty line;
    turns without a number come last; turns without a conv_id belong to no transcript and are left out. Turns that repeat a number stay apart.
    """
    style = F.pmod(F.xxhash64(F.lit("style"), "conv_id"), F.lit(4))
    names = {"system": ("System", "Instructions"), "user": ("User", "Human"), "assistant": ("Assistant", "AI")}
    further = F.regexp_replace(F.initcap(F.coalesce("role", F.lit("nobody"))), "[^A-Za-z]", "")
    pick = lambda k: F.coalesce(F.create_map(*[x for r, n in names.items() for x in (F.lit(r), F.lit(n[k]))])[F.col("role")], further)
    bare = (style == 3) | ((style == 2) & (F.pmod(F.col("turn"), F.lit(3)) == 2))
    head = F.when(bare, F.lit("")).otherwise(F.concat(F.when(style == 1, pick(1)).otherwise(pick(0)), F.lit(": ")))
    tail = F.when(style == 3, F.lit("\n")).otherwise(F.lit(""))
    role = F.when(F.col("role").isin(*ROLES), F.col("role")).otherwise(ROLES[-1])
    turns = conversations.where(F.col("conv_id").isNotNull()).select("conv_id", "turn", role.alias("role"), F.split(F.concat(head, F.coalesce("text", F.lit("")), tail), "\n", -1).alias("lines"))
    return number_lines(turns)


def number_lines(turns: DataFrame) -> DataFrame:
    """Number the lines of (conv_id, turn, role, lines) through each transcript by two-level sums over blocks of turns, so a very long one is no single group."""
    block = F.coalesce(F.floor(F.col("turn") / 256), F.lit(1 << 62))
    dealt = turns.withColumn("block", block).withColumn("m", F.size("lines"))
    sums = dealt.groupBy("conv_id", "block").agg(F.sum("m").alias("all"))
    base = sums.select("conv_id", "block", F.coalesce(F.sum("all").over(Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    order = Window.partitionBy("conv_id", "block").orderBy("turn", "role", "lines").rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.join(base.hint("merge"), ["conv_id", "block"]).withColumn("begin", F.col("base") + F.coalesce(F.sum("m").over(order), F.lit(0)))
    role = F.array_position(F.array(*[F.lit(r) for r in ROLES]), F.col("role")) - 1
    each = placed.select("conv_id", "begin", role.alias("r"), F.posexplode("lines").alias("k", "line"))
    at = F.col("begin") + F.col("k")
    return each.select(F.col("conv_id").alias("conv"), F.floor(at / CHUNK).cast("long").alias("chunk"), at.cast("long").alias("at"), "line", (2 * F.col("r") + (F.col("k") > 0).cast("int")).cast("int").alias("state"))
