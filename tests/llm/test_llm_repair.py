"""Conversation repair against every script of edits, and chunk by chunk."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from flowloom.llm import repair

SCHEMA = "conv_id long, turn long, role string, text string, _conv string, at string, fault string"
SOUND = re.compile(r"(s?(ua)+)?")


def damaged(rows):
    found = []
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        hit = zlib.crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if hit == 1:
            text = ""
        if hit == 2:
            text = re.sub("[.!?]", "", text)
        if hit == 4:
            role = "user"
        found += [(turn, role, text)] * (0 if hit == 0 else 2 if hit == 3 else 1)
    return found


def faulty(rows):
    seen, found = set(), []
    for _, role, text in rows:
        bare = text.strip(" \t\n\x0b\f\r")
        if not bare:
            fault = "blank"
        elif (role, text) in seen:
            fault = "duplicate"
        else:
            fault = "" if bare[-1] in ".!?" else "truncated"
        seen.add((role, text))
        found.append(fault)
    return found


def cheapest(rows):
    """(cost, audit, lines) by all states after every row, whatever led there."""
    now = {"": (0, "", ())}
    step = {"": "user", "s": "user", "u": "assistant", "a": "user"}

    def better(table, state, value):
        if state not in table or value < table[state]:
            table[state] = value

    for (_, role, text), fault in [*zip(rows, faulty(rows)), ((None, None, None), None)]:
        for _ in range(2):
            for s, (c, a, lines) in list(now.items()):
                better(now, step[s][0], (c + 5, a + "I", (*lines, step[s] + ":")))
        if fault is None:
            break
        after, extra = {}, 5 * (fault == "truncated")
        for s, (c, a, lines) in now.items():
            better(after, s, (c + 2, a + "D", lines))
            if fault in ("blank", "duplicate"):
                continue
            better(after, step[s][0], (c + 1 + extra, a + "R", (*lines, f"{step[s]}:{text}")))
            if role[:1] and (s + role[:1] in ("s", "u", "su", "ua", "au")):
                better(after, role[:1], (c + extra, a + "K", (*lines, f"{role}:{text}")))
        now = after
    return min(v for s, v in now.items() if s in ("", "a"))


def cheapest_by_scripts(rows):
    """(cost, audit) by trying every script with at most two inserts in a gap."""
    faults, best = faulty(rows), None
    for letters in itertools.product("DKR", repeat=len(rows)):
        for inserts in itertools.product(range(3), repeat=len(rows) + 1):
            audit, roles, cost = "", "", 5 * sum(inserts)
            for k in range(len(rows) + 1):
                for _ in range(inserts[k]):
                    roles += "a" if roles.endswith("u") else "u"
                audit += "I" * inserts[k]
                if k == len(rows):
                    break
                audit += letters[k]
                if letters[k] == "D":
                    cost += 2
                    continue
                if faults[k] in ("blank", "duplicate"):
                    break
                cost += (letters[k] == "R") + 5 * (faults[k] == "truncated")
                roles += rows[k][1][:1] or "?" if letters[k] == "K" else "a" if roles.endswith("u") else "u"
            else:
                k = len(rows)
            if k == len(rows) and SOUND.fullmatch(roles) and (best is None or (cost, audit) < best):
                best = cost, audit
    return best


def test_search_equals_every_script():
    rng = random.Random(4)
    for _ in range(60):
        rows = [(i, rng.choice(["user", "assistant", "system", "tool", " ", ""]), rng.choice(["a.", "b!", "c", " ", "d?"])) for i in range(rng.randint(0, 3))]
        want = cheapest_by_scripts(rows)
        assert cheapest(rows)[:2] == want
        assert repair.search([(r[1][:1], f) for r, f in zip(rows, faulty(rows))])[:2] == want


def conversations():
    rng = random.Random(8)
    rows = []
    for conv in range(150):
        size = 300 if conv == 0 else 64 if conv == 1 else 9 if conv == 2 else rng.randint(1, 12)
        for turn in range(size):
            role = rng.choice(["user", "assistant"]) if rng.random() < 0.3 else ("user", "assistant")[turn % 2]
            role = rng.choice(["system", "tool", "", None, "admin", "usher"]) if rng.random() < 0.06 else role
            text = rng.choice(["Why?", "So it is.", "no end", "", None, " \t", f"Turn {turn}!", "é…"]) if rng.random() < 0.5 else f"Said {conv} {turn}. "
            rows.append((conv, None if rng.random() < 0.02 else turn * (1 + turn % 2), role, text))
    rows += [(None, t, r, "Hm.") for t, r in ((None, "user"), (2, "assistant"), (5, None))]
    alone = next(k for k in range(1000, 2000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    return rows + [(alone, 0, "user", "Gone.")]


@pytest.mark.parametrize("chunk", [2, 7, 64])
def test_digest_equals_brute_force(spark, chunk):
    rows = conversations()
    want = []
    for conv in {r[0] for r in rows}:
        own = damaged([r for r in rows if r[0] == conv])
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        faults, turns = faulty(own), [r[0] for r in own if r[0] is not None]
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(own, own[1:])]
        cost, audit, lines = cheapest(own)
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(p not in ("su", "ua", "au") for p in pairs)
        sha = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        want.append((conv, gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, sha))
    table = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA).repartition(4)
    got = [tuple(r) for r in repair.digest(table, chunk).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_repaired_rows_are_sound(spark):
    table = spark.createDataFrame([(*r, "x", "y", "z") for r in conversations()], SCHEMA)
    found = {}
    for r in repair.repair(table, 16).collect():
        found.setdefault(r.conv_id, []).append(r)
    for lines in found.values():
        lines.sort(key=lambda r: r.place)
        assert len({r.place for r in lines}) == len(lines)
        assert SOUND.fullmatch("".join(r.role[:1] for r in lines))
        assert all((r.turn, r.text) == (None, "") for r in lines if r.edit == "I")


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert repair.digest(empty).collect() == [] and repair.repair(empty).collect() == []
