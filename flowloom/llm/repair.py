"""Conversation structure repair by depth-first branch and bound.

A conversation is sound when the initials of its roles are ``(s?(ua)+)?``. Edits of a
row are Keep, Rerole, Delete and, before a row or at the end, Insert; the cheapest
script of edits is wanted and, of several, the one whose initials come first in ASCII.

The search of a chunk of ``CHUNK`` rows keeps an explicit stack of nodes (row, what the
next role may be). Branches are taken in ASCII order. A node is left when its cost plus
the least that each later row must cost is not below the incumbent (cost, audit), or when
the node's table has a prefix of its own that is not worse. The stack running empty
proves the incumbent best. A prefix is only taken up again when it is cheaper by a whole
number, so a chunk has at most (rows x states x spread of costs) nodes.

Most conversations are one chunk. Longer ones are cut after every ``CHUNK`` rows: each
chunk gives its least cost from every state before it to every state after it, these small
matrices give every chunk the cost of all that follows, and with that as the price of its
last state each chunk finds its own part of the best script: scripts of equal cost are
never prefixes of one another, so the first script as a whole is the first in every part.
"""

import hashlib

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from flowloom.llm.text import WHITE
from flowloom.operators import ordering
from flowloom.sources import scratch

CHUNK = 64
#: Chunks that a task turns into Python objects at a time.
SLICE = 128
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)
#: What a kept row's initial leads to from a state, and what a new or changed row leads to.
KEPT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT}
NEXT = (USER, USER, ASSISTANT, USER)
ROLE = {USER: "user", ASSISTANT: "assistant"}
RIGHT_PAIRS = ("su", "ua", "au")
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: Price and script of ending a conversation in a state.
END_COST, END_AUDIT = (0, 2 * INSERT, INSERT, 0), ("", "II", "I", "")
NO_AUDIT = ("",) * 4
NEVER = 1 << 40
SOUND, BLANK, DUPLICATE, CUT = "", "blank", "duplicate", "truncated"
ROWS = "array<struct<at: bigint, turn: bigint, role: string, text: string, fault: string>>"
LINES = "array<struct<edit: string, turn: bigint, role: string, text: string>>"


def moves(initial, fault, state):
    """(letter, cost, next state) of the edits that deal with a row, in ASCII order."""
    found = [("D", DELETE, state)]
    if fault not in (BLANK, DUPLICATE):
        more = TRUNCATED if fault == CUT else 0
        if (state, initial) in KEPT:
            found.append(("K", more, KEPT[state, initial]))
        found.append(("R", REROLE + more, NEXT[state]))
    return found


def _first_guess(rows, state, goal):
    """The cost of a quick repair, an upper bound of the best."""
    cost = 0
    for initial, fault in rows:
        letter, price, state = min(moves(initial, fault, state), key=lambda m: m[1])
        cost += price
    ends = [goal[state], INSERT + goal[NEXT[state]], 2 * INSERT + goal[NEXT[NEXT[state]]]]
    return cost + min(ends)


def search(rows, entry=START, goal=END_COST, tail=END_AUDIT):
    """(cost, audit, last state) of the best edits of ``rows``, (initial, fault) each.

    ``goal`` is what each last state costs and ``tail`` what it adds to the audit; cost
    includes the goal's, audit the tail. None when no edits reach a goal.
    """
    least = [0] * len(rows) + [min(goal)]
    for i in range(len(rows) - 1, -1, -1):
        initial, fault = rows[i]
        cheapest = min(price for state in STATES for _, price, _ in moves(initial, fault, state))
        least[i] = least[i + 1] + cheapest
    # The quick repair may end in inserts, which stand before a row here; if nothing is within two of them, nothing bounds the search.
    bound = _first_guess(rows, entry, goal) + 2 * INSERT
    return _dive(rows, entry, goal, tail, least, min((bound, "~"), (NEVER, ""))) or _dive(rows, entry, goal, tail, least, (NEVER, ""))


def _dive(rows, entry, goal, tail, least, incumbent):
    """The search itself, below a first incumbent that no script stands for."""
    last = None
    best = [[None] * 4 for _ in range(len(rows) + 1)]
    stack = [(0, entry, 0, "")]
    while stack:
        i, state, cost, audit = stack.pop()
        if (cost + least[i], audit) >= incumbent:
            continue
        if best[i][state] is not None and best[i][state] <= (cost, audit):
            continue
        best[i][state] = cost, audit
        if i == len(rows):
            found = (cost + goal[state], audit + tail[state])
            if found < incumbent:
                incumbent, last = found, state
            continue
        branches = [(i + 1, after, cost + price, audit + letter) for letter, price, after in moves(*rows[i], state)]
        branches.append((i, NEXT[state], cost + INSERT, audit + "I"))
        stack += sorted(branches, key=lambda b: b[3], reverse=True)
    return None if last is None else (*incumbent, last)


def apply(rows, audit, state=START):
    """The (edit, turn, role, text) that the edits of ``audit`` leave; ``rows`` are (turn, role, text)."""
    found, rows = [], iter(rows)
    for letter in audit:
        if letter == "I":
            state = NEXT[state]
            found.append((letter, None, ROLE[state], ""))
            continue
        turn, role, text = next(rows)
        if letter == "R":
            state = NEXT[state]
            role = ROLE[state]
        elif letter == "K":
            state = KEPT[state, role[:1]]
        if letter != "D":
            found.append((letter, turn, role, text))
    return found


def damage(conversations):
    """Rows with the faults that a hash of conversation and turn picks; nulls become one space.

    crc32(``conv_id:turn``) modulo 20: 0 drops the row, 1 empties its text, 2 takes
    ``[.!?]`` out of it, 3 repeats it, 4 makes it the user's.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    hit = F.pmod(F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")), F.lit(20))
    copies = F.when(hit == 0, 0).when(hit == 3, 2).otherwise(1)
    changed = F.when(hit == 1, "").when(hit == 2, F.translate(text("text"), ".!?", "")).otherwise(text("text"))
    rows = conversations.select(
        "conv_id", "turn", F.when(hit == 4, "user").otherwise(text("role")).alias("role"), changed.alias("text"), copies.alias("_copies")
    )
    return rows.withColumn("_copies", F.explode(F.expr("array_repeat(0, _copies)"))).drop("_copies")


def faults(rows):
    """A written table of ``rows`` with _conv, at (place in the conversation) and fault.

    _conv is the decimal conv_id, empty for the missing one. Rows go by turn, null first;
    those of one turn by role and text. Null role and text count as one space. A row's
    first fault counts: blank (white space only), duplicate (role and text were there
    before), truncated (ends in none of ``.!?``).
    """
    kept = rows.select(
        F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("_conv"), F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"),
        F.monotonically_increasing_id().alias("_tie"),
    )
    order = ["turn", F.substring("role", 1, 64), F.xxhash64("role"), F.substring("text", 1, 64), F.xxhash64("text"), "_tie"]
    placed = ordering.sorted_ordinal(kept, order, ["_conv"], name="at").drop("_tie")
    same = ["_h1", "_h2"]
    placed = placed.withColumns({"_h1": F.xxhash64("_conv", "role", "text"), "_h2": F.xxhash64(F.lit(7), "text", "role", "_conv")})
    placed = scratch.materialise(placed, "repair-rows")
    again = placed.groupBy(*same).agg(F.min("at").alias("_first"), F.count(F.lit(1)).alias("_c")).filter("_c > 1")
    joined = placed.join(again.drop("_c"), same, "left")
    bare = F.btrim("text", F.lit(WHITE))
    fault = (
        F.when(bare == "", BLANK).when(F.col("at") > F.col("_first"), DUPLICATE).when(~F.right(bare, F.lit(1)).isin(".", "!", "?"), CUT)
    ).otherwise(SOUND)
    return joined.withColumn("fault", fault).drop(*same, "_first")


def _arrow(df, run, schema):
    """``df`` through ``run``: a list of rows (tuples) to a list of tuples, batch by batch."""
    target = to_arrow_schema(df.sparkSession.createDataFrame([], schema).schema)

    def batches(parts):
        for part in (whole.slice(k, SLICE) for whole in parts for k in range(0, whole.num_rows, SLICE)):
            found = run(list(zip(*(c.to_pylist() for c in part.columns))))
            made = [pa.array([r[k] for r in found], f.type) for k, f in enumerate(target)]
            yield pa.record_batch(made, schema=target)

    return df.mapInArrow(batches, schema)


def _plain(rows):
    return [(r["role"][:1], r["fault"]) for r in rows]


def _edited(rows, entry, audit):
    return [dict(zip(("edit", "turn", "role", "text"), line)) for line in apply([(r["turn"], r["role"], r["text"]) for r in rows], audit, entry)]


def _whole(found):
    """Chunks that are a whole conversation, repaired."""
    done = []
    for conv, chunk, rows in found:
        cost, audit, _ = search(_plain(rows))
        done.append((conv, chunk, cost, audit, _edited(rows, START, audit)))
    return done


def _reachable(entry, exit):
    """Whether any rows can lead from one state to the other."""
    return exit in (USER, ASSISTANT) or entry == START or (entry == exit == SYSTEM)


def _prices(found):
    """The least cost from each state before a chunk to each state after it."""
    done = []
    for conv, chunk, rows in found:
        plain, matrix = _plain(rows), []
        for entry in STATES:
            for exit in STATES:
                goal = [0 if s == exit else NEVER for s in STATES]
                best = search(plain, entry, goal, NO_AUDIT) if _reachable(entry, exit) else None
                matrix.append(NEVER if best is None else best[0])
        done.append((conv, chunk, matrix))
    return done


def _goals(found):
    """What follows each chunk costs, by the state after it."""
    done = []
    for conv, chunks in found:
        goal, last = list(END_COST), True
        for part in sorted(chunks, key=lambda c: -c["_chunk"]):
            done.append((conv, part["_chunk"], goal, last))
            cost, last = part["matrix"], False
            goal = [min(min(cost[4 * a + b] + goal[b] for b in STATES), NEVER) for a in STATES]
    return done


def _choices(found):
    """The best edits of a chunk from each state before it: audits and states after it."""
    done = []
    for conv, chunk, rows, goal, last in found:
        best = [search(_plain(rows), entry, goal, END_AUDIT if last else NO_AUDIT) for entry in (STATES if chunk else [START])]
        done.append((conv, chunk, [b and b[1] for b in best], [b[2] if b else -1 for b in best]))
    return done


def _chosen(found):
    """The state before each chunk and its audit, from the first chunk on."""
    done = []
    for conv, chunks in found:
        state = START
        for part in sorted(chunks, key=lambda c: c["_chunk"]):
            done.append((conv, part["_chunk"], state, part["audits"][state]))
            state = part["exits"][state]
    return done


def _cost(rows, audit):
    """What the edits of ``audit`` cost."""
    total, rows = 0, iter(rows)
    for letter in audit:
        if letter == "I":
            total += INSERT
            continue
        fault = next(rows)["fault"]
        total += DELETE if letter == "D" else (REROLE if letter == "R" else 0) + (TRUNCATED if fault == CUT else 0)
    return total


def _rewritten(found):
    return [(conv, chunk, _cost(rows, audit), audit, _edited(rows, state, audit)) for conv, chunk, rows, state, audit in found]


def repair_chunks(faulty, chunk=CHUNK):
    """_conv, _chunk, cost, audit, lines (edit, turn, role, text) of every chunk of rows.

    ``faulty`` is a table from ``faults``. What one task gathers of a conversation is a
    matrix and four audits per chunk, no more than a few times the audit it returns.
    """
    row = F.struct("at", "turn", "role", "text", "fault")
    parts = faulty.groupBy("_conv", F.floor(F.col("at") / chunk).cast("long").alias("_chunk")).agg(F.array_sort(F.collect_list(row)).alias("rows"))
    parts = scratch.materialise(parts, "repair-chunks")
    alone = (F.col("_chunk") == 0) & (F.size("rows") < chunk)
    done = f"_conv string, _chunk long, cost long, audit string, lines {LINES}"
    whole = _arrow(parts.filter(alone), _whole, done)
    rest = parts.filter(~alone)
    per_conv = lambda df, *c: df.groupBy("_conv").agg(F.collect_list(F.struct("_chunk", *c)).alias("chunks"))
    prices = _arrow(rest, _prices, "_conv string, _chunk long, matrix array<long>")
    goals = _arrow(per_conv(prices, "matrix"), _goals, "_conv string, _chunk long, goal array<long>, _last boolean")
    choices = _arrow(rest.join(goals, ["_conv", "_chunk"]), _choices, "_conv string, _chunk long, audits array<string>, exits array<int>")
    chosen = _arrow(per_conv(choices, "audits", "exits"), _chosen, "_conv string, _chunk long, state int, audit string")
    long = _arrow(rest.join(chosen, ["_conv", "_chunk"]), _rewritten, done)
    return whole.unionByName(long)


def repair(conversations, chunk=CHUNK):
    """conv_id, place, edit, turn, role, text: the repaired rows of ``conversations``.

    ``place`` counts chunk by chunk and rises along a conversation. Kept rows have edit
    ``K``, those of another role ``R``, new ones ``I`` and no turn. A role is known by
    its initial; a null one is a space, which no sound conversation has, so such a row is
    changed or goes. An empty role has no initial and is treated alike. Rows of a missing
    conv_id are one conversation. Equal rows after the first are duplicates and go.
    """
    lines = repair_chunks(faults(conversations), chunk).select("_conv", "_chunk", F.posexplode("lines").alias("_i", "_l"))
    return lines.select(_conv_id().alias("conv_id"), (F.col("_chunk") * (3 * chunk + 2) + F.col("_i")).alias("place"), "_l.*")


def _conv_id():
    return F.when(F.col("_conv") != "", F.col("_conv")).cast("long")


def _hashed(parts):
    """One row a conversation from its chunks in order: cost, audit, hash of its lines."""
    schema = pa.schema([("_conv", pa.string()), ("cost", pa.int64()), ("audit", pa.string()), ("repaired_sha256", pa.string())])
    conv, sha, cost, audits, lines = None, None, 0, [], False
    for part in parts:
        rows = []
        for key, price, audit, text in zip(*(c.to_pylist() for c in part.columns)):
            if key != conv:
                if conv is not None:
                    rows.append((conv, cost, "".join(audits), sha.hexdigest()))
                conv, sha, cost, audits, lines = key, hashlib.sha256(), 0, [], False
            cost += price
            audits.append(audit)
            if text is not None:
                sha.update(b"\n" + text if lines else text)
                lines = True
        yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)] if rows else [pa.array([], f.type) for f in schema], schema=schema)
    if conv is not None:
        yield pa.record_batch([pa.array([x], f.type) for x, f in zip((conv, cost, "".join(audits), sha.hexdigest()), schema)], schema=schema)


def digest(conversations, chunk=CHUNK):
    """What ``damage`` broke and ``repair_chunks`` mends, one row per original conv_id.

    Returns conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and
    repaired_sha256. A conversation without rows after damage has zeros, an empty audit
    and the hash of nothing. The hash of a conversation runs over its lines one after the
    other, so one task reads them all, but never holds more than a chunk.
    """
    faulty = scratch.materialise(faults(damage(conversations)), "repair-faults")
    count = lambda c: F.sum(c.cast("long"))
    stats = faulty.groupBy("_conv").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn"), F.lit(0)).alias("gaps"),
        *[count(F.col("fault") == f).alias(f) for f in (BLANK, DUPLICATE, CUT)],
    )
    initial = F.substring("role", 1, 1)
    after = faulty.select("_conv", (F.col("at") - 1).alias("at"), initial.alias("_next"))
    pairs = faulty.select("_conv", "at", initial.alias("_own")).join(after, ["_conv", "at"])
    illegal = pairs.groupBy("_conv").agg(count(~F.concat("_own", "_next").isin(*RIGHT_PAIRS)).alias("illegal"))
    text = F.array_join(F.transform("lines", lambda line: F.concat(line["role"], F.lit(":"), line["text"])), "\n")
    done = repair_chunks(faulty, chunk).select("_conv", "_chunk", "cost", "audit", F.when(F.size("lines") > 0, text).cast("binary").alias("_text"))
    done = done.repartition(F.col("_conv")).sortWithinPartitions("_conv", "_chunk").drop("_chunk")
    hashed = done.mapInArrow(_hashed, "_conv string, cost long, audit string, repaired_sha256 string")
    convs = conversations.select(F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("_conv")).distinct()
    found = convs.join(stats, "_conv", "left").join(illegal, "_conv", "left").join(hashed, "_conv", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return found.select(
        _conv_id().alias("conv_id"), *[zero(c) for c in ("gaps", BLANK, DUPLICATE, CUT, "illegal", "cost")],
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(b""), 256)).alias("repaired_sha256"),
    )


SQL = r"""
WITH RECURSIVE c AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(list_reduce(list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda x: CAST(ascii(x) AS BIGINT)),
      lambda s, x: list_reduce([0, 1, 2, 3, 4, 5, 6, 7], lambda r, i: xor(r >> 1, (r & 1) * 3988292384), xor(s, x)), CAST(4294967295 AS BIGINT)), 4294967295) % 20 AS hit
  FROM conversations),
m AS (
  SELECT conv_id, turn, CASE WHEN hit = 4 THEN 'user' ELSE role END AS role,
    CASE hit WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
    unnest(range(CASE hit WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM c),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM m),
f AS (
  SELECT conv_id, turn, role, text, i, left(role, 1) AS ini, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS pre,
    CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank'
         WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
         WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE '' END AS fault
  FROM o),
r AS (SELECT *, fault IN ('blank', 'duplicate') AS out, CASE fault WHEN 'truncated' THEN 5 ELSE 0 END AS more FROM f),
dp AS (
  SELECT conv_id, 0 AS i, {'c': 0, 'a': '', 't': ''} AS s0, CAST(NULL AS STRUCT(c INTEGER, a VARCHAR, t VARCHAR)) AS s1,
    CAST(NULL AS STRUCT(c INTEGER, a VARCHAR, t VARCHAR)) AS s2, CAST(NULL AS STRUCT(c INTEGER, a VARCHAR, t VARCHAR)) AS s3
  FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL
  SELECT conv_id, i,
    {'c': s0.c + 2, 'a': s0.a || 'D', 't': s0.t},
    list_min([CASE WHEN s1 IS NOT NULL THEN {'c': s1.c + 2, 'a': s1.a || 'D', 't': s1.t} END,
              CASE WHEN NOT out AND ini = 's' THEN {'c': s0.c + more, 'a': s0.a || 'K', 't': s0.t || own} END]),
    list_min([CASE WHEN u IS NOT NULL THEN {'c': u.c + 2, 'a': u.a || 'D', 't': u.t} END,
              CASE WHEN NOT out AND ini = 'u' AND p IS NOT NULL THEN {'c': p.c + more, 'a': p.a || 'K', 't': p.t || own} END,
              CASE WHEN NOT out AND p IS NOT NULL THEN {'c': p.c + 1 + more, 'a': p.a || 'R', 't': p.t || chr(10) || 'user:' || text} END]),
    list_min([CASE WHEN v IS NOT NULL THEN {'c': v.c + 2, 'a': v.a || 'D', 't': v.t} END,
              CASE WHEN NOT out AND ini = 'a' AND u IS NOT NULL THEN {'c': u.c + more, 'a': u.a || 'K', 't': u.t || own} END,
              CASE WHEN NOT out AND u IS NOT NULL THEN {'c': u.c + 1 + more, 'a': u.a || 'R', 't': u.t || chr(10) || 'assistant:' || text} END])
  FROM (
    SELECT *, list_min([s0, s1, v]) AS p, chr(10) || role || ':' || text AS own
    FROM (
      SELECT *, list_min([s3, CASE WHEN u IS NOT NULL THEN {'c': u.c + 5, 'a': u.a || 'I', 't': u.t || chr(10) || 'assistant:'} END]) AS v
      FROM (
        SELECT r.conv_id, r.i, r.role, r.text, r.ini, r.out, r.more, dp.s0, dp.s1, dp.s3,
          list_min([dp.s2, {'c': dp.s0.c + 5, 'a': dp.s0.a || 'I', 't': dp.s0.t || chr(10) || 'user:'},
            CASE WHEN dp.s1 IS NOT NULL THEN {'c': dp.s1.c + 5, 'a': dp.s1.a || 'I', 't': dp.s1.t || chr(10) || 'user:'} END,
            CASE WHEN dp.s3 IS NOT NULL THEN {'c': dp.s3.c + 5, 'a': dp.s3.a || 'I', 't': dp.s3.t || chr(10) || 'user:'} END]) AS u
        FROM dp JOIN r ON r.conv_id IS NOT DISTINCT FROM dp.conv_id AND r.i = dp.i + 1)))),
n AS (
  SELECT conv_id, count(i) AS rows, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
    count(*) FILTER (WHERE fault = 'truncated') AS truncated, count(*) FILTER (WHERE pre IS NOT NULL AND pre || ini NOT IN ('su', 'ua', 'au')) AS illegal
  FROM r GROUP BY conv_id),
e AS (
  SELECT dp.conv_id, list_min([s0, s3, CASE WHEN s2 IS NOT NULL THEN {'c': s2.c + 5, 'a': s2.a || 'I', 't': s2.t || chr(10) || 'assistant:'} END,
    CASE WHEN s1 IS NOT NULL THEN {'c': s1.c + 10, 'a': s1.a || 'II', 't': s1.t || chr(10) || 'user:' || chr(10) || 'assistant:'} END]) AS best
  FROM dp LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM dp.conv_id WHERE dp.i = coalesce(n.rows, 0))
SELECT e.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate,
  CAST(coalesce(truncated, 0) AS BIGINT) AS truncated, CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(best.c AS BIGINT) AS cost, best.a AS audit,
  sha256(substr(best.t, 2)) AS repaired_sha256
FROM e LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM e.conv_id
"""
