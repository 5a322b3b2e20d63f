"""Chat formatting: roles of raw transcripts by a hidden Markov model.

A transcript is lines without roles. A line's state is (role, first or later line
of a turn); it emits a speaker marker class, a length class, and whether it asks.
Viterbi finds the most likely states, from which turns are cut, markers removed
and the canonical form rendered.

A conversation may hold any share of the rows, so its rows are numbered and it is
decoded in chunks of ``CHUNK_TURNS`` rows: each chunk gives its best score from
every state before it to every state at its end (a max-plus matrix). ``FAN``
matrices are multiplied to one, level by level up to one for a conversation; then
back down, each block fixes the states between its parts, and each chunk is
decoded between the two states fixed for it. That is
the same path as one pass over the whole conversation.
"""

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from flowloom.sources import scratch

# Roles, the speaker markers known for them, and marker classes.
ROLES = ("user", "assistant", "system", "tool")
MARKERS = {
    "user": ("user", "human", "q", "question", "me"),
    "assistant": ("assistant", "ai", "a", "answer", "bot"),
    "system": ("system", "instruction"),
    "tool": ("tool", "function", "result"),
}
STYLES = (("User: ", "Assistant: ", "System: ", "Tool: "), ("Q: ", "A: ", "Instruction: ", "Result: "), ("### Human: ", "### AI: ", "### System: ", "### Function: "))
CLASS = {word: i + 1 for i, role in enumerate(ROLES) for word in MARKERS[role]}
MARKER = re.compile(r"^\s*(?:#{1,4}\s*|\*\*|\[|<\|?)?([A-Za-z]{1,12})(?:\*\*|\]|\|?>)?\s*:\s*")
LENGTHS = (1, 20, 60, 140, 300)
N_MARKS, N_LENGTHS = len(ROLES) + 1, len(LENGTHS) + 1
SYMBOLS = N_MARKS * N_LENGTHS * 2
STATES = 2 * len(ROLES)
CHUNK_TURNS = 256
FAN = 256
NO_CONV = -(2**63)
#: Bits of a row's place in its partition, as ``monotonically_increasing_id`` has them.
PLACE_BITS = 33
MAX_TRAIN = 5_000


def mark_of(line):
    """(class, length) of the speaker marker at the start of a line; class 0 is none."""
    found = MARKER.match(line)
    kind = CLASS.get(found[1].lower(), 0) if found else 0
    return kind, found.end() if kind else 0


def symbol(line):
    """The observation of a line: marker class, length class, ends with a question."""
    kind, _ = mark_of(line)
    return (kind * N_LENGTHS + sum(len(line) >= n for n in LENGTHS)) * 2 + line.rstrip().endswith("?")


def transcripts(turns, keep=75):
    """Raw transcripts from turns with roles: markers in one of three styles, some left out.

    Null text is an empty line; a turn of an unknown role gets no marker. Hashes
    of conversation and turn decide, so reruns agree.
    """
    style = F.pmod(F.xxhash64(F.lit(3), "conv_id"), F.lit(len(STYLES)))
    shown = F.pmod(F.xxhash64(F.lit(5), "conv_id", "turn"), F.lit(100)) < keep
    marker = F.lit("")
    for i, role in enumerate(ROLES):
        for s, names in enumerate(STYLES):
            marker = F.when((F.col("role") == role) & (style == s) & shown, F.lit(names[i])).otherwise(marker)
    text = F.concat(marker, F.coalesce("text", F.lit("")))
    return turns.select("conv_id", "turn", "role", text.alias("text"))


def numbered(rows):
    """``rows`` with ``row``, from 0 in the order of their conversation.

    The order is turn (null first), the start of the text, its hash; equal rows
    take any. Rows are range partitions that are written once; each counts its
    own conversations, so no task holds a conversation.
    """
    order = ["conv_id", F.asc_nulls_first("turn"), F.substring("text", 1, 64), F.xxhash64("text"), "_tie"]
    placed = rows.withColumn("_tie", F.monotonically_increasing_id())
    placed = placed.repartitionByRange(scratch.partitions_for(rows), *order).sortWithinPartitions(*order)
    placed = scratch.materialise(placed.drop("_tie").withColumn("_at", F.monotonically_increasing_id()), "placed")
    placed = placed.withColumn("_part", F.shiftright("_at", PLACE_BITS))
    before = Window.partitionBy("conv_id").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("conv_id", "_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    offsets = offsets.withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    row = F.col("_at") - F.col("_first") + F.col("_offset")
    return placed.join(offsets, ["conv_id", "_part"]).withColumn("row", row)


def observed(parts):
    """(conv_id, chunk, row, turn, text, symbols) of transcript parts, with symbols per line.

    A chunk is ``CHUNK_TURNS`` rows of a conversation. Rows of a null conversation
    are one conversation, ``NO_CONV``.
    """

    def run(batches):
        for batch in batches:
            found = [[symbol(x) for x in (t or "").split("\n")] for t in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.record_batch([*batch.columns, pa.array(found, pa.list_(pa.int32()))], names=[*names, "symbols"])

    kept = [c for c in ("role",) if c in parts.columns]
    conv = F.coalesce(F.col("conv_id").cast("long"), F.lit(NO_CONV))
    rows = numbered(parts.select(conv.alias("conv_id"), F.col("turn").cast("long"), *kept, "text"))
    chunk = F.floor(F.col("row") / CHUNK_TURNS).cast("long")
    rows = rows.select("conv_id", chunk.alias("chunk"), "row", "turn", *kept, "text")
    names = rows.columns
    schema = ", ".join(f"{n} {t}" for n, t in rows.dtypes) + ", symbols array<int>"
    return rows.mapInArrow(run, schema)


def train(labelled, max_train=MAX_TRAIN, seed=9):
    """(start, move, emit) log probabilities from turns with roles.

    ``labelled`` is a written table from ``observed`` with role. About
    ``max_train`` chunks of conversations are read, chosen by a hash. Counts are
    summed by Spark; every cell starts at one.
    """
    n = labelled.select("conv_id", "chunk").distinct().count()
    place = F.pmod(F.xxhash64(F.lit(seed), "conv_id", "chunk"), F.lit(1_000_000))
    number = F.lit(None).cast("int")
    for i, role in enumerate(ROLES):
        number = F.when(F.col("role") == role, F.lit(i)).otherwise(number)
    own = labelled.filter(place < int(min(1.0, max_train / max(n, 1)) * 1_000_000)).withColumn("_role", number)
    before = Window.partitionBy("conv_id", "chunk").orderBy("row")
    own = own.withColumn("_before", F.lag("_role").over(before)).filter("_role is not null")
    lines = own.select("_role", "_before", "chunk", F.posexplode("symbols").alias("_i", "_s"))
    state = F.col("_role") * 2 + (F.col("_i") > 0).cast("int")
    emitted = lines.groupBy(state.alias("a"), F.col("_s").alias("b")).count().collect()
    length = F.size("symbols")
    turned = own.groupBy("_before", "_role").agg(
        F.count("*").alias("n"), F.sum(length - 1).alias("later"), F.sum((length > 1).cast("int")).alias("long")
    ).collect()
    starts = own.filter("_before is null and chunk = 0").groupBy("_role").count().collect()
    emit, move, start = np.ones((STATES, SYMBOLS)), np.ones((STATES, STATES)), np.ones(STATES)
    for a, b, c in emitted:
        emit[a, b] += c
    for before, role, n, later, long in turned:
        first, more = 2 * role, 2 * role + 1
        move[first, more] += long
        move[more, more] += later - long
        if before is not None:
            move[2 * before, first] += n / 2
            move[2 * before + 1, first] += n / 2
    # A later line follows a line of the same role only.
    for a in range(STATES):
        for b in range(1, STATES, 2):
            if a // 2 != b // 2:
                move[a, b] = 1e-9
    for role, c in starts:
        start[2 * role] += c
    start[1::2] = 1e-9
    with np.errstate(divide="ignore"):
        return (
            np.log(start / start.sum()),
            np.log(move / move.sum(1, keepdims=True)),
            np.log(emit / emit.sum(1, keepdims=True)),
        )


def transfer(symbols, move, emit, start=None):
    """Best score from each state before the lines to each state at the last line.

    With ``start`` the state before is the start of the conversation.
    """
    score = np.zeros((STATES, STATES)) if start is None else None
    for i, s in enumerate(symbols):
        if i == 0:
            score = (move if start is None else np.tile(start, (STATES, 1))) + emit[:, s]
        else:
            score = (score[:, :, None] + move[None]).max(1) + emit[:, s]
    return score


def decode(symbols, move, emit, entry, last):
    """The best states of the lines between two fixed states; ``entry`` is a score per state."""
    score, back = entry + emit[:, symbols[0]], []
    for s in symbols[1:]:
        step = score[:, None] + move
        back.append(step.argmax(0))
        score = step.max(0) + emit[:, s]
    state = last
    path = [state]
    for choice in reversed(back):
        state = int(choice[state])
        path.append(state)
    return path[::-1]


def _groups(batches, key):
    """Rows of consecutive equal keys as lists of dicts."""
    held, rows = None, []
    for batch in batches:
        for row in batch.to_pylist():
            now = tuple(row[k] for k in key)
            if now != held and rows:
                yield held, rows
                rows = []
            held = now
            rows.append(row)
    if rows:
        yield held, rows


def _matrices(model):
    start, move, emit = model

    def run(batches):
        for (conv, chunk), rows in _groups(batches, ("conv_id", "chunk")):
            symbols = [s for r in rows for s in r["symbols"]]
            score = transfer(symbols, move, emit, start if rows[0]["first"] else None)
            yield pa.RecordBatch.from_pylist(
                [{"conv_id": conv, "chunk": chunk, "score": score.tobytes()}],
                pa.schema([("conv_id", pa.int64()), ("chunk", pa.int64()), ("score", pa.binary())]),
            )

    return run


def _blocks(scored):
    """The matrices of each ``FAN`` chunks of a conversation, in order."""
    block = F.floor(F.col("chunk") / FAN).cast("long").alias("block")
    return scored.groupBy("conv_id", block).agg(F.sort_array(F.collect_list(F.struct("chunk", "score"))).alias("parts"))


def _matrix(part):
    return np.frombuffer(part["score"]).reshape(STATES, STATES)


def _product(batches):
    """One matrix for each block."""
    schema = pa.schema([("conv_id", pa.int64()), ("chunk", pa.int64()), ("score", pa.binary())])
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            score = _matrix(row["parts"][0])
            for part in row["parts"][1:]:
                score = (score[:, :, None] + _matrix(part)[None]).max(1)
            out.append({"conv_id": row["conv_id"], "chunk": row["block"], "score": score.tobytes()})
        yield pa.RecordBatch.from_pylist(out, schema)


def _chain(batches):
    """The state before and at the end of each part of a block, between those of the block if they are fixed."""
    schema = pa.schema([("conv_id", pa.int64()), ("chunk", pa.int64()), ("entry", pa.int32()), ("last", pa.int32())])
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            score, back = np.zeros(STATES), []
            if row["entry"] is not None:
                score = np.where(np.arange(STATES) == row["entry"], 0.0, -np.inf)
            for part in row["parts"]:
                step = score[:, None] + _matrix(part)
                back.append(step.argmax(0))
                score = step.max(0)
            state = int(score.argmax()) if row["last"] is None else row["last"]
            for part, choice in zip(reversed(row["parts"]), reversed(back)):
                before = int(choice[state])
                out.append({"conv_id": row["conv_id"], "chunk": part["chunk"], "entry": before, "last": state})
                state = before
        yield pa.RecordBatch.from_pylist(out, schema)


def _fixed(scored):
    """(conv_id, chunk, entry, last) of every chunk: its states on the best path of its conversation."""
    levels = [_blocks(scratch.materialise(scored, "matrices"))]
    while (levels[-1].agg(F.max("block")).head()[0] or 0) > 0:
        product = levels[-1].mapInArrow(_product, "conv_id long, chunk long, score binary")
        levels.append(_blocks(scratch.materialise(product, "matrices")))
    none = F.lit(None).cast("int")
    ready = levels[-1].withColumns({"entry": none, "last": none})
    for below in [*reversed(levels[:-1]), None]:
        fixed = scratch.materialise(ready.mapInArrow(_chain, "conv_id long, chunk long, entry int, last int"), "chained")
        if below is not None:
            ready = below.join(fixed.withColumnRenamed("chunk", "block"), ["conv_id", "block"])
    return fixed


def _render(model):
    start, move, emit = model
    fields = [
        ("conv_id", pa.int64()), ("chunk", pa.int64()), ("part", pa.int64()), ("turn", pa.int64()), ("role", pa.string()),
        ("continues", pa.bool_()), ("n_lines", pa.int64()), ("text", pa.string()),
    ]

    def run(batches):
        for (conv, chunk), rows in _groups(batches, ("conv_id", "chunk")):
            symbols = [s for r in rows for s in r["symbols"]]
            entry = start if rows[0]["first"] else move[rows[0]["entry"]]
            path = decode(symbols, move, emit, entry, rows[0]["last"])
            lines = [(r["turn"], line) for r in rows for line in (r["text"] or "").split("\n")]
            out = []
            for state, (turn, line) in zip(path, lines):
                role, later = ROLES[state // 2], state % 2 == 1
                if not later or not out:
                    out.append({"conv_id": conv, "chunk": chunk, "part": len(out), "turn": turn, "role": role, "continues": later, "lines": []})
                out[-1]["lines"].append(line if later else line[mark_of(line)[1] :])
            for row in out:
                body = row.pop("lines")
                row["n_lines"], row["text"] = len(body), "\n".join(body)
            yield pa.RecordBatch.from_pylist(out, pa.schema(fields))

    return run


def parse(parts, model):
    """Recovered turns of transcripts: conv_id, chunk, part, turn, role, continues, n_lines, text.

    ``parts`` is a written table from ``observed``; ``turn`` is the transcript
    part a recovered turn starts in. ``continues`` marks a turn that began in the
    chunk before. Rows are ordered as in ``numbered``; rows of a null conversation
    are one conversation. Null text is an empty line.
    """
    rows = parts.withColumn("first", F.col("chunk") == 0)
    lined = rows.repartition("conv_id", "chunk").sortWithinPartitions("conv_id", "chunk", "row")
    scored = lined.select("conv_id", "chunk", "symbols", "first").mapInArrow(
        _matrices(model), "conv_id long, chunk long, score binary"
    )
    ready = rows.join(_fixed(scored), ["conv_id", "chunk"]).repartition("conv_id", "chunk")
    ready = ready.sortWithinPartitions("conv_id", "chunk", "row")
    schema = "conv_id long, chunk long, part long, turn long, role string, continues boolean, n_lines long, text string"
    found = ready.select("conv_id", "chunk", "turn", "text", "symbols", "first", "entry", "last").mapInArrow(
        _render(model), schema
    )
    return found.withColumn("conv_id", F.when(F.col("conv_id") != NO_CONV, F.col("conv_id")))


def rendered(turns):
    """``turns`` of ``parse`` with a column ``canonical``: role header, text, end mark."""
    head = F.when(F.col("continues"), F.lit("")).otherwise(F.concat(F.lit("<|"), "role", F.lit("|>\n")))
    return turns.withColumn("canonical", F.concat(head, "text", F.lit("\n")))


def recover(conversations, max_train=MAX_TRAIN):
    """Canonical turns recovered from transcripts of ``conversations``.

    Transcripts are made without roles; roles of a bounded share of chunks train
    the model. Returns the columns of ``rendered``. An empty table gives an empty
    result; other columns are ignored.
    """
    parts = scratch.materialise(observed(transcripts(conversations)), "transcripts")
    return rendered(parse(parts.drop("role"), train(parts, max_train)))
