"""Transcript parsing: exact Viterbi over chunks, and recovered roles."""

import itertools
import random

import numpy as np
import pytest

from flowloom.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, chunk string, symbols string"


@pytest.fixture(scope="module")
def conversations(spark):
    rng = random.Random(1)
    rows = []
    for conv in range(120):
        for turn in range(700 if conv == 0 else rng.randint(1, 9)):
            if turn % 2 == 0:
                text = " ".join("ask" for _ in range(rng.randint(3, 8))) + "?"
            else:
                text = "\n".join(" ".join("reply" for _ in range(rng.randint(15, 40))) for _ in range(rng.randint(1, 4)))
            rows.append((conv, turn, "user" if turn % 2 == 0 else "assistant", text, "x", "y"))
    rows += [(500, 0, None, None, "x", "y"), (500, 0, "user", "", "x", "y"), (500, 1, "other", "hello", "x", "y"), (500, 1, "other", "hello", "x", "y")]
    rows += [(None, 0, "user", "what?", "x", "y"), (501, None, "user", "what?", "x", "y"), (502, 0, "assistant", "a\n" * 3000, "x", "y")]
    return spark.createDataFrame(rows, SCHEMA).repartition(6).cache()


def test_roles_are_recovered(conversations):
    found = chat.recover(conversations).collect()
    truth = {(r.conv_id, r.turn): r for r in conversations.collect() if r.conv_id is not None and r.conv_id < 200}
    turns = {(r.conv_id, r.turn): r for r in found if not r.continues}
    right = sum(k in turns and turns[k].role == r.role for k, r in truth.items())
    assert right >= 0.97 * len(truth)
    exact = sum(k in turns and turns[k].text == r.text for k, r in truth.items())
    assert exact >= 0.9 * len(truth)
    assert all(r.canonical.startswith(f"<|{r.role}|>\n") != r.continues for r in found)


def test_no_line_is_lost(conversations):
    found = chat.recover(conversations).collect()
    lines = sum((r.text or "").count("\n") + 1 for r in conversations.collect())
    assert sum(r.n_lines for r in found) == lines
    assert {r.conv_id for r in found} == {r.conv_id for r in conversations.collect()}


def test_chunked_path_is_the_best_path():
    rng = np.random.default_rng(0)
    start, move, emit = (np.log(rng.dirichlet(np.ones(n), size)) for n, size in ((chat.STATES, None), (chat.STATES, chat.STATES), (chat.SYMBOLS, chat.STATES)))
    symbols = [int(s) for s in rng.integers(0, chat.SYMBOLS, 5)]

    def value(path):
        total = start[path[0]] + emit[path[0], symbols[0]]
        return total + sum(move[a, b] + emit[b, s] for a, b, s in zip(path, path[1:], symbols[1:]))

    best = max(itertools.product(range(chat.STATES), repeat=5), key=value)
    one, two = chat.transfer(symbols[:2], move, emit, start), chat.transfer(symbols[2:], move, emit)
    total = one[0][:, None] + two
    mid, last = np.unravel_index(total.argmax(), total.shape)
    path = chat.decode(symbols[:2], move, emit, start, int(mid)) + chat.decode(symbols[2:], move, emit, move[mid], int(last))
    assert value(path) == pytest.approx(value(best)) and tuple(path) == best


def test_rows_without_conversation_or_turn_are_cut_into_chunks(spark, monkeypatch):
    rng = random.Random(4)
    texts = [rng.choice(("ask?", "a much longer reply " * 4, "User: hm", "AI: yes\nand more")) for _ in range(900)]
    rows = [(None, rng.choice((None, 0, k)), t) for k, t in enumerate(texts[:600])] + [(5, 1, t) for t in texts[600:]]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, text string").repartition(5)
    start, move, emit = [np.log(np.random.default_rng(1).dirichlet(np.ones(n), k)) for n, k in ((chat.STATES, None), (chat.STATES, chat.STATES), (chat.SYMBOLS, chat.STATES))]
    start[1::2] = -50
    for a, b in itertools.product(range(chat.STATES), range(1, chat.STATES, 2)):
        if a // 2 != b // 2:
            move[a, b] = -50
    for size, fan in ((4, 3), (10_000, 256)):
        monkeypatch.setattr(chat, "CHUNK_TURNS", size)
        monkeypatch.setattr(chat, "FAN", fan)
        parts = chat.scratch.materialise(chat.observed(frame))
        assert parts.groupBy("conv_id", "chunk").count().filter(f"count > {size}").count() == 0
        turns = chat.parse(parts, (start, move, emit)).orderBy("conv_id", "chunk", "part").collect()
        for conv, own in ((None, chat.NO_CONV), (5, 5)):
            symbols = [s for r in parts.filter(f"conv_id = {own}").orderBy("row").collect() for s in r.symbols]
            path = [2 * chat.ROLES.index(r.role) + (k > 0 or r.continues) for r in turns if r.conv_id == conv for k in range(r.n_lines)]
            assert len(path) == len(symbols)
            value = start[path[0]] + emit[path[0], symbols[0]] + sum(move[x, y] + emit[y, z] for x, y, z in zip(path, path[1:], symbols[1:]))
            assert value == pytest.approx(chat.transfer(symbols, move, emit, start)[0].max())


def test_markers():
    assert chat.mark_of("### Human: hi") == (1, 11)
    assert chat.mark_of("A: yes") == (2, 3)
    assert chat.mark_of("Note: yes") == (0, 0)


def test_no_conversations(spark):
    assert chat.recover(spark.createDataFrame([], SCHEMA)).count() == 0
