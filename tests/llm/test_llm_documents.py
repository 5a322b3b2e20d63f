"""Document operators against plain Python on a small table with every odd row."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from flowloom.llm import decontaminate, jaccard, lines, lm, mixing, secrets, substrings, text, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _id string, key string, score string, _row string"
WORDS = [f"w{i}" for i in range(400)] + ["Straße", "élan", "naïve", "日本語"]


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    """Copies, near copies, shared passages, nulls, empty and long texts, ties, repeated rows."""
    rng = random.Random(3)
    passage, line = sentence(rng, 60), "A shared   line of Text"
    texts = [sentence(rng, rng.randint(1, 120)) for _ in range(40)]
    texts += [texts[3]] * 5 + [texts[4] + " " + sentence(rng, 2) for _ in range(6)]
    texts += [sentence(rng, 30) + " " + passage + " " + sentence(rng, 30) for _ in range(8)]
    texts += [f"{sentence(rng, 12)}\n  {line.upper()}\t\n{line}\n{sentence(rng, 8)}\n\nshort" for _ in range(6)]
    texts += ["", None, " \t\n", "one", "one two", "one two", "ab" * 300, "a" * 250, sentence(rng, 20_000)]
    found = [(i, t) for i, t in enumerate(texts)]
    found += [(3, texts[3]), (3, texts[3]), (None, texts[7]), (None, None)]
    return [(i, t, "en", None if k % 7 == 0 else f"s{k % 5}", 0, "x", "y", "z", "r") for k, (i, t) in enumerate(found)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(rows):
    """One text per id where rows repeat it; the missing id comes last."""
    found = defaultdict(list)
    for r in rows:
        found[text.LAST_ID if r[0] is None else r[0]].append(r[1] or "")
    return found


def test_substrings_equal_brute_force(docs, rows):
    plain = [r for r in rows if r[0] is not None]
    seen, want = set(), {}
    for i, texts in sorted(by_id(plain).items()):
        data = texts[0].encode()
        cover = bytearray(len(data))
        for p in range(len(data) - 99):
            piece = data[p : p + 100]
            if piece in seen:
                cover[p : p + 100] = b"\x01" * 100
            seen.add(piece)
        kept = bytes(x for x, c in zip(data, cover) if not c)
        spans = sum(c and (k == 0 or not cover[k - 1]) for k, c in enumerate(cover))
        want[i] = (len(data), sum(cover), spans, hashlib.sha256(kept).hexdigest())
    got = substrings.digest(docs.filter("doc_id is not null")).collect()
    assert len(got) == len(plain)
    assert {r[0]: tuple(r)[1:] for r in got} == want
    assert sum(v[1] for v in want.values()) > 5000


def test_substrings_of_missing_ids_come_last(docs, rows):
    got = [r for r in substrings.digest(docs).collect() if r.doc_id is None]
    assert sorted(r.n_bytes for r in got) == [0, len(rows[7][1].encode())]
    assert all(r.n_removed == r.n_bytes for r in got if r.n_bytes >= 100)


def test_substrings_tell_rows_of_one_id_apart(spark):
    rng = random.Random(12)
    shared, head = sentence(rng, 60), sentence(rng, 30)
    texts = [f"{sentence(rng, k)} {shared} {sentence(rng, 9 * k)}" for k in range(1, 9)]
    texts += [head + " " + sentence(rng, n) for n in (5, 40)] + ["short", "", "ab" * 300]
    found = [(i, t) for t in texts for i in (None, 7)][::-1] + [(3, texts[2]), (9, texts[5] + " x"), (None, texts[4])]
    frame = spark.createDataFrame(found, "doc_id long, text string").repartition(4)
    order = {r.text: r.h for r in frame.selectExpr("text", "xxhash64(cast(text as binary)) h").collect()}
    seen, want = set(), {}
    for i, t in sorted(set(found), key=lambda r: (text.LAST_ID if r[0] is None else r[0], order[r[1]])):
        data = t.encode()
        cover = bytearray(len(data))
        for p in range(len(data) - 99):
            piece = data[p : p + 100]
            if piece in seen:
                cover[p : p + 100] = b"\x01" * 100
            seen.add(piece)
        want[i, t] = (len(data), sum(cover), hashlib.sha256(bytes(x for x, c in zip(data, cover) if not c)).hexdigest())
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.kept_sha256) for r in substrings.digest(frame).collect())
    assert got == Counter((r[0], *want[r]) for r in found)


def shingles(value):
    found = (value or "").encode().translate(text.LOWER_BYTES).split()
    if not found:
        return frozenset()
    n = min(5, len(found))
    return frozenset(tuple(found[i : i + n]) for i in range(len(found) - n + 1))


def test_jaccard_equals_brute_force(docs, rows):
    sets = [(text.LAST_ID if r[0] is None else r[0], shingles(r[1])) for r in rows]
    parent = list(range(len(sets)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, (_, x) in enumerate(sets):
        for j, (_, y) in enumerate(sets[:i]):
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                parent[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(sets):
        least[find(i)] = min(least.get(find(i), doc), doc)
    none = lambda i: None if i == text.LAST_ID else i
    want = Counter((none(d), len(s), none(least[find(i)])) for i, (d, s) in enumerate(sets))
    assert Counter(tuple(r) for r in jaccard.digest(docs).collect()) == want


def test_jaccard_product_gives_out_only_pairs_that_may_be_similar():
    # Of 100 shingles each, a pair must share 10 of the prefix; "all" tells how many columns lie in other blocks.
    def unit(shared, extra):
        rows = [(s, key, 100, key, False, shared + extra, left) for s in range(shared) for key in (1, 2) for left in (True, False)]
        return pa.table(dict(zip(["shingle", "key", "n", "component", "main", "all", "left"], zip(*rows))))

    made = lambda *x: jaccard._multiplied(unit(*x)).to_pylist()
    assert made(9, 0) == [] and made(5, 4) == []
    assert made(10, 0) == [{"a": 1, "b": 2, "na": 100, "nb": 100, "common": 10}]
    assert [r["common"] for r in made(5, 5)] == [5]

    # A row that is linked elsewhere counts on one side only: nothing it shares is lost.
    mixed = [(s, key, 100, key, main, 10, left) for s in range(10) for key, main in ((2, False), (1, s < 6)) for left in (True, False) if not (left and main)]
    names = ["shingle", "key", "n", "component", "main", "all", "left"]
    found = jaccard._multiplied(pa.table(dict(zip(names, zip(*mixed))))).to_pylist()
    assert sum(r["common"] for r in found) == 10


@pytest.mark.parametrize("unit", [1000, 16])
def test_jaccard_links_a_large_group_of_near_copies(spark, unit, monkeypatch):
    monkeypatch.setattr(jaccard, "UNIT", unit)
    rng = random.Random(5)
    base = sentence(rng, 200).split()
    table = []
    for i in range(300):
        own = list(base)
        for _ in range(rng.randint(0, 3)):
            own[rng.randrange(200)] = f"x{rng.randrange(10**6)}"
        table.append((i, " ".join(own)))
    table += [(1000 + i, sentence(rng, 50) + " " + " ".join(base[:60])) for i in range(200)]
    frame = spark.createDataFrame(table, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in jaccard.digest(frame).collect()}
    sets = {i: shingles(t) for i, t in table}
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in sets:
        for j in sets:
            if j < i and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    assert got == {i: find(i) for i in sets}


def test_keep_first_keeps_one_of_each_group(docs, rows):
    kept = jaccard.keep_first(docs)
    assert kept.columns == docs.columns
    groups = {(r.doc_id, r.component_id) for r in jaccard.digest(docs).collect() if r.n_shingles}
    ids = [r.doc_id for r in kept.collect() if shingles(r.text)]
    assert sorted(i for i in ids if i is not None) == sorted(i for i, c in groups if i == c and i is not None)
    assert sum(1 for r in kept.collect() if not shingles(r.text)) == sum(1 for r in rows if not shingles(r[1]))


def test_keep_first_tells_rows_of_one_id_apart(spark):
    rng = random.Random(8)
    texts = [sentence(rng, 40) for _ in range(30)]
    rows = [(None, t) for t in texts[:12]] + [(7, t) for t in texts[12:24]] + [(i, texts[24 + i]) for i in range(6)]
    copies = [(None, texts[0]), (None, texts[3] + " more"), (7, texts[14]), (9, texts[15]), (None, texts[25]), (None, " "), (7, None)]
    frame = spark.createDataFrame(rows + copies, "doc_id long, text string").repartition(4)
    kept = [tuple(r) for r in jaccard.keep_first(frame).collect()]
    near = {(None, texts[3]), (None, texts[3] + " more")}
    assert sum(r in near for r in kept) == 1
    sort = lambda found: sorted(((-1 if i is None else i), t or "") for i, t in found)
    assert sort(r for r in kept if r not in near) == sort([r for r in rows if r not in near] + copies[-2:])


ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def base_spans(value):
    found = [(m.start(), 0, f"assign:{m.start()}:{m.end()}") for m in ASSIGN.finditer(value) if len(m[2]) >= 6]
    found += [(m.start(), 1, f"access:{m.start()}:{m.end()}") for m in re.finditer("AKIA[A-Z0-9]+", value) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, f"hex:{m.start()}:{m.end()}") for m in re.finditer("[0-9a-f]+", value) if m.end() - m.start() >= 24]
    return [f[2] for f in sorted(found)]


def test_secrets_equal_plain_patterns(spark, docs):
    rng = random.Random(9)
    bits = ["password = ", "Token:'", "API_KEY=", "apikey  :  ", "secret", "passwd\"=\"", "AKIA", "akia", " ", "é", "\n", "=", ":"]
    values = [None, "", "日本 AKIA" + "A1" * 10 + " " + "ab01" * 7 + " secret: tokentoken=abcdefgh"]
    for _ in range(300):
        parts = []
        for _ in range(rng.randint(1, 30)):
            parts.append(rng.choice(bits))
            kind = rng.choice(["0123456789abcdef", "ABCDEFGHIJ0123456789", "abcXYZ+/_.=-", "ß "])
            parts.append("".join(rng.choice(kind) for _ in range(rng.choice([0, 3, 5, 6, 16, 20, 23, 24, 50]))))
        values.append("".join(parts))
    frame = spark.createDataFrame([(i, v, "x") for i, v in enumerate(values)], "doc_id long, text string, spans string")
    for r in secrets.scan(frame).collect():
        want = base_spans(values[r.doc_id] or "")
        assert [s for s in r.spans.split(",") if s and not s.startswith("token")] == want
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(s.startswith(k) for s in want) for k in secrets.BASE)
    assert secrets.scan(docs).count() == docs.count()


def test_tokens_need_their_checksum(spark):
    body = b"Ab3" * 10
    good = "x ghp_" + (body + secrets.checksum(body)).decode() + " y"
    frame = spark.createDataFrame([(0, good), (1, good[:-3] + "0 y"), (2, None)], "doc_id long, text string")
    assert [r.spans for r in secrets.scan(frame).orderBy("doc_id").collect()] == [f"token:2:{len(good) - 2}", "", ""]
    assert [r.text for r in secrets.redact(frame).orderBy("doc_id").collect()][::2] == ["x [secret] y", None]


def test_line_dedup_equals_plain_python(docs, rows):
    white = "".join(text.WHITE)
    lower = str.maketrans(text.UPPER, text.LOWER)
    key = lambda x: x.strip(white).translate(lower)
    holders = defaultdict(set)
    for i, texts in by_id(rows).items():
        for value in texts:
            for line in value.split("\n"):
                if len(key(line)) >= 10:
                    holders[key(line)].add(i)
    want = Counter()
    for r in rows:
        i = text.LAST_ID if r[0] is None else r[0]
        split = (r[1] or "").split("\n")
        kept = [x for x in split if len(key(x)) < 10 or i == min(holders[key(x)])]
        want[(r[0], len(split), len(split) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest())] += 1
    for batches, fanout in ((1, 2), (4, 2), (5, 3)):
        assert Counter(tuple(r) for r in lines.digest(docs, batches, fanout).collect()) == want
    assert lines.dedup(docs).columns == docs.columns


def test_mix_meets_targets_and_caps(docs, rows):
    got = mixing.mix(docs, block_tokens=4).collect()
    assert len(got) == len(rows)
    sizes = [len((r[1] or "").encode().split()) for r in rows]
    assert sorted(r["size"] for r in got) == sorted(sizes)
    total = defaultdict(int)
    for r, n in zip(rows, sizes):
        total[r[3]] += n
    weight = {s: float(1 + k % 3) for k, s in enumerate(sorted(total, key=lambda s: (s is None, s or "")))}
    level = math.inf
    open_ = set(total)
    goal = {}
    while True:
        rest = sum(total.values()) - sum(goal.values())
        level = rest / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * level > 3 * total[s]}
        if not over:
            break
        goal |= {s: 3.0 * total[s] for s in over}
        open_ -= over
    goal |= {s: weight[s] * level for s in open_}
    taken = defaultdict(int)
    for r in got:
        assert r["source_size"] == total[r["source"]] and r["target"] == pytest.approx(goal[r["source"]])
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    for s in goal:
        assert abs(taken[s] - goal[s]) <= 0.5
    again = mixing.mix(docs.repartition(3), block_tokens=4).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))


def test_schedule_prefixes_have_the_shares(spark):
    goal = spark.createDataFrame([("a", 100, 100.0), (None, 100, 50.0), ("b", 100, 250.0)], "source string, source_size long, target double")
    plan = sorted(mixing.schedule(goal, 1).collect())
    assert [r.slot for r in plan] == list(range(400))
    for n in (40, 100, 400):
        counts = Counter(r.source for r in plan[:n])
        for source, share in (("a", 0.25), (None, 0.125), ("b", 0.625)):
            assert abs(counts[source] - share * n) <= 3
    for source in ("a", None, "b"):
        assert sorted(r.block for r in plan if r.source == source) == list(range(sum(r.source == source for r in plan)))


def test_mix_fills_sources_of_any_size(spark):
    """Sources of 1 to 100 words, next to one with most rows, none with an id."""
    sizes = [1, 2, 10, 63, 64, 65, 100]
    made = [(None, " ".join(WORDS[k % 400] + str(k) for k in range(n)), f"s{n:03}") for n in sizes]
    big = spark.range(100_000).select(
        F.lit(None).cast("long").alias("doc_id"), F.concat_ws(" ", F.lit("a b"), "id").alias("text"), F.lit("hot").alias("source")
    )
    copies = spark.range(9000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("same text").alias("text"), F.lit("copies").alias("source"))
    docs = spark.createDataFrame(made, "doc_id long, text string, source string").unionByName(big).unionByName(copies)
    got = mixing.mix(docs).groupBy("source").agg(
        F.max("target").alias("target"), F.sum("taken").alias("taken"), F.count("*").alias("n"),
        F.max(F.col("taken") - 3 * F.col("size")).alias("over"),
    ).collect()
    assert {r.source: r.n for r in got} == {"hot": 100_000, "copies": 9000} | {f"s{n:03}": 1 for n in sizes}
    for r in got:
        assert abs(r.taken - r.target) <= 0.5 and r.over <= 0
    rows = docs.withColumn("size", F.lit(3)).groupBy("doc_id", "source", "size", F.xxhash64("text").alias("_hash")).agg(F.count("*").alias("_copies"))
    ends = mixing.streams(rows).filter("source = 'copies'").agg(F.countDistinct("_start"), F.max("_end")).first()
    assert tuple(ends) == (9000, 27_000)


def test_multipliers_meet_every_slot():
    for n in (1, 2, 3, 12, 400, 30_030, 9_699_690):
        g = mixing.multiplier(n)
        assert math.gcd(g, n) == 1 and (n < 5 or mixing._largest_quotient(g, n) < 12)


def words_of(value):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (value or "").translate(str.maketrans(text.UPPER, text.LOWER)))


def test_decontamination_equals_brute_force(spark, docs, rows):
    rng = random.Random(8)
    long_text = next(r[1] for r in rows if r[1] and len(r[1]) > 3000).split()
    items = [(0, rows[0][1]), (1, " ".join(long_text[100:130])), (2, "one"), (3, None), (4, ""), (5, sentence(rng, 40))]
    items += [(6, " ".join(long_text[110:122])), (1, " ".join(long_text[100:130])), (None, "one two"), (7, rows[10][1])]
    bench = spark.createDataFrame([(i, t, "z") for i, t in items], "item_id long, text string, term string")
    want = Counter()
    for r in rows:
        own = words_of(r[1])
        hit, names = set(), set()
        for i, t in items:
            item = words_of(t)
            n = min(13, len(item))
            windows = {tuple(item[k : k + n]) for k in range(len(item) - n + 1)} if n else set()
            for p in range(len(own) - n + 1 if n else 0):
                if tuple(own[p : p + n]) in windows:
                    hit |= set(range(p, p + n))
                    names.add("" if i is None else str(i))
        sha = hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
        want[(r[0], len(own), len(hit), len(names), sha, bool(hit) and 20 * len(hit) >= len(own))] += 1
    assert Counter(tuple(r) for r in decontaminate.judge(docs, bench).drop("_text").collect()) == want
    kept = decontaminate.clean(docs, bench)
    assert kept.columns == docs.columns
    assert kept.count() == sum(c for k, c in want.items() if not k[-1])


def test_proximity_finds_terms_that_are_near(spark):
    frame = spark.createDataFrame([(0, "alpha x x beta"), (1, "alpha" + " x" * 9 + " beta"), (2, "alpha")], "doc_id long, text string")
    bench = spark.createDataFrame([(0, "alpha beta")], "item_id long, text string")
    (own, vocabulary), = decontaminate.blocks(decontaminate.item_terms(bench))
    postings = decontaminate.index(decontaminate.tagged(frame), vocabulary).cache()
    assert [(r._id, r.gap) for r in decontaminate.proximity(postings, own, slop=5).collect()] == [(0, 3)]


def test_backoff_scores_equal_plain_counts(docs, rows):
    texts = [(r[1] or "").encode().translate(text.LOWER_BYTES).split() for r in rows]
    counts = Counter(tuple(t[i : i + n]) for t in texts for n in (1, 2, 3) for i in range(len(t) - n + 1))
    total = sum(map(len, texts))

    def score(gram):
        if len(gram) == 1:
            return counts[gram] / total
        if counts[gram] >= lm.CUTOFF:
            return counts[gram] / counts[gram[:-1]]
        return lm.BACKOFF * score(gram[1:])

    want = sorted((-1 if r[0] is None else r[0], len(t), sum(math.log(score(tuple(t[max(0, i - 2) : i + 1]))) for i in range(len(t)))) for r, t in zip(rows, texts))
    for options in ({}, {"block_words": 500, "table_keys": 300}):
        got = sorted((-1 if r[0] is None else r[0], r[1], r[2]) for r in lm.score(docs, **options).collect())
        assert [g[:2] for g in got] == [w[:2] for w in want]
        assert [g[2] for g in got] == pytest.approx([w[2] for w in want])


def test_backoff_counts_unknown_words_as_one(spark):
    frame = spark.createDataFrame([(0, "a a a b"), (1, "c")], "doc_id long, text string")
    got = {r.doc_id: r.log_score for r in lm.score(frame, order=1, size=1).collect()}
    assert got[1] == pytest.approx(math.log(2 / 5))


def test_backoff_counts_every_word_of_a_large_vocabulary(spark):
    frame = spark.createDataFrame([(i, " ".join(f"w{i}_{j}" for j in range(1000))) for i in range(70)], "doc_id long, text string")
    got = [r.log_score for r in lm.score(frame.union(frame.filter("doc_id = 0"))).collect()]
    once = 1000 * math.log(1 / 71000) + (1 + 2 * 998) * math.log(lm.BACKOFF)
    assert sorted(got) == pytest.approx([once] * 69 + [math.log(2 / 71000)] * 2)


@pytest.fixture(scope="module")
def toxic(spark):
    rng = random.Random(2)
    bad = ["vilex", "scumm", "hateful"]
    table = []
    for i in range(600):
        body = [sentence(rng, rng.randint(3, 9)) for _ in range(rng.randint(1, 8))]
        y = int(i % 5 == 0)
        if y:
            k = rng.randrange(len(body))
            body[k] += f" {rng.choice(bad)} thing"
        table.append((i, ". ".join(body), y, "s"))
    table += [(9000, None, 0, "s"), (9001, "", 1, "s"), (None, "you vilex", 1, "s"), (9002, "you vilex thing", None, "s"), (9002, "you vilex thing", None, "s")]
    return spark.createDataFrame(table, "doc_id long, text string, toxic int, score string").cache()


def test_toxicity_learns_from_documents_and_finds_sentences(toxic):
    marks = toxic.select("doc_id", "toxic")
    got = toxicity.classify(toxic.select("doc_id", "text", "score"), marks).collect()
    truth = {r.doc_id: r.toxic for r in toxic.collect()}
    assert len(got) == toxic.count()
    held = [r for r in got if r.held_out and r.doc_id < 9000]
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.97 * len(held) > 0
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    assert {r.score for r in got if r.doc_id in (9000, 9001)} == {0.0}
    assert [r.predicted for r in got if r.doc_id == 9002] == [1, 1]
    assert [r.held_out for r in got if r.doc_id is None] == [False]
    model = toxicity.train(toxic, marks)
    found = toxicity.locate(toxic, model).collect()
    assert found and all(any(w in r.text for w in ("vilex", "scumm", "hateful")) for r in found)
    clean = toxicity.clean(toxic, marks)
    assert clean.columns == toxic.columns and 0 < clean.count() < toxic.count()


def test_held_out_labels_are_never_read(toxic):
    marks = toxic.select("doc_id", "toxic").filter(~toxicity.held_out(toxic.doc_id))
    one = toxicity.classify(toxic, marks).select("doc_id", "score").collect()
    two = toxicity.classify(toxic, toxic.select("doc_id", "toxic")).select("doc_id", "score").collect()
    assert sorted(map(str, one)) == sorted(map(str, two))


def test_without_labels_all_is_harmless(spark, toxic):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.classify(toxic, none).filter("predicted = 1").count() == 0


def test_empty_tables(spark, empty):
    bench = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([Row(doc_id=1, text="some words")])
    marks = spark.createDataFrame([], "doc_id long, toxic int")
    assert substrings.digest(empty).count() == 0
    assert jaccard.digest(empty).count() == 0
    assert jaccard.keep_first(empty).count() == 0
    assert secrets.scan(empty).count() == 0
    assert lines.digest(empty).count() == 0
    assert mixing.mix(empty).count() == 0
    assert lm.score(empty).count() == 0
    assert decontaminate.judge(empty, bench).count() == 0
    assert [r.contaminated for r in decontaminate.judge(some, bench).collect()] == [False]
    assert toxicity.classify(empty, marks).count() == 0
