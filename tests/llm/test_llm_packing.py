"""Packing: ids as the tokenizer gives them, sequences gapless, and few of them."""

import random
import zlib

import numpy as np
import pytest

from flowloom.llm import packing

SCHEMA = "doc_id long, text string, ids string, sequence_id string, _part string, length string"


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(packing.tokenizer_path())


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)

    def words(n):
        return " ".join("".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7))) + rng.choice(["", "", ".", "'s", "?!"]) for _ in range(n))

    texts = [words(rng.choice([1, 5, 40, 150, 400])) for _ in range(120)] + [words(6000), None, "", " \n\t", "x"] + [words(30)] * 40
    found = [(i, t) for i, t in enumerate(texts)] + [(3, texts[3])] * 3 + [(None, texts[5]), (None, None), (7, "other")]
    return [(i, t, "a", "b", "c", "d") for i, t in found]


def ids(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]


def test_words_give_the_ids_of_the_text(tokenizer):
    encode = packing.Encoder()
    texts = [
        "á ́b don't I'LL <|endoftext|> x<|startoftext|>y \x00 a\x00b  z q Å İ ΑΣ  Σ 12345 ½",
        "", "   ", "\x00", " \x00 ", "日本語 👩‍👩‍👧 __a_b-c ... a...b?! é. 9. <|endoftext|>.", "‍̀ x", "\x1c a\x1fb \x85 c", "İstanbul ǅ ﬁ H̱ T̈ <|STARTOFTEXT|>", "DON'T Stop. STOP! stop",
        "word " * 1_000_000, "y" * 3_000_000,
    ]
    assert encode.plain and encode.part and encode.mark is not None
    for _ in range(2):
        for part in packing._segments((t, t.encode()) for t in texts):
            for (text, data, last), got in zip(part, encode.encode([data for _, data, _ in part])):
                if last and data == text.encode():
                    assert np.frombuffer(got, "<u4").tolist() == ids(tokenizer, text)[:-1], text[:80]
    long = [d for part in packing._segments([(0, texts[-2].encode())]) for _, d, _ in part]
    assert len(long) > 1 and b"".join(long) == texts[-2].encode()
    assert np.frombuffer(b"".join(encode.encode(long)), "<u4").tolist() == ids(tokenizer, texts[-2])[:-1]


@pytest.mark.parametrize("capacity", [64, 2048])
def test_pack_equals_its_contract(spark, rows, tokenizer, capacity):
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    packed = packing.pack(docs, capacity).collect()
    want = sorted(repr((r[0], ids(tokenizer, r[1]))) for r in rows)
    # Equal ids may stand for several rows; their pieces are taken apart by their starts.
    cut = sorted(repr((r[0], k, tuple(whole[k : k + capacity]))) for r in rows for whole in [ids(tokenizer, r[1])] for k in range(0, len(whole), capacity))
    assert sorted(repr((p.doc_id, p.start, tuple(np.frombuffer(p.ids, "<u4").tolist()))) for p in packed) == cut
    assert all(p.start == p.piece * capacity and p.length == len(p.ids) // 4 and p.ids_crc32 == zlib.crc32(p.ids) for p in packed)
    bins = {}
    for p in packed:
        bins.setdefault(p.sequence_id, []).append(p)
    for parts in bins.values():
        end = 0
        for p in sorted(parts, key=lambda p: p.offset):
            assert p.offset == end
            end += p.length
        assert end <= capacity
    lengths = sorted((p.length for p in packed), reverse=True)
    rooms = []
    for length in lengths:
        fits = [i for i, room in enumerate(rooms) if room >= length]
        if fits:
            rooms[min(fits, key=lambda i: rooms[i])] -= length
        else:
            rooms.append(capacity - length)
    assert -(-sum(lengths) // capacity) <= len(bins) <= len(rooms)
    assert len(want) == len(rows)


def test_sequences_hold_the_ids_in_order(spark, rows):
    packed = packing.pack(spark.createDataFrame(rows, SCHEMA), 256).cache()
    built = {r.sequence_id: r for r in packing.sequences(packed).collect()}
    for p in packed.collect():
        whole = built[p.sequence_id]
        assert whole.length == len(whole.ids) // 4 <= 256
        assert whole.ids[4 * p.offset : 4 * (p.offset + p.length)] == p.ids


def test_plan_is_small_and_best_for_large_items():
    rng = random.Random(2)
    for capacity in (9, 30, 100):
        for _ in range(200):
            items = [rng.randint(capacity // 3 + 1, capacity) for _ in range(rng.randint(0, 40))]
            steps = packing.plan({n: items.count(n) for n in set(items)}, capacity)
            opened = max((s[3] + s[2] for s in steps), default=0)
            # Most pairs: the smallest with the largest that still takes it.
            order, pairs = sorted(items), 0
            while len(order) > 1:
                big = order.pop()
                if order[0] + big <= capacity:
                    order.pop(0)
                    pairs += 1
            assert opened == len(items) - pairs
    counts = {n: rng.randint(1, 10**9) for n in range(1, 2049)}
    steps = packing.plan(counts)
    assert len(steps) < 40 * 2048
    placed = dict.fromkeys(counts, 0)
    for length, start, n, _, _, _ in steps:
        assert start == placed[length]
        placed[length] += n
    assert placed == counts


def test_empty_table(spark):
    assert packing.digest(spark.createDataFrame([], SCHEMA)).collect() == []
