"""Hard negatives, suffix dedup and collocations against brute force, with their defined cases."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import collocations, hard_negatives, suffix_dedup

# ---- hard negatives


def brute_negatives(rows, is_query, scale=256, positives=5, negatives=3, low=50, high=95):
    sound = [(i, y, [math.floor(scale * x) for x in v]) for i, y, v in rows if i is not None and y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    score = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = Counter()
    for i, y, v in {(i, y, tuple(v)) for i, y, v in sound if is_query(i)}:
        others = sorted((-score(v, w), j) for j, z, w in sound if z == y and j != i)[:positives]
        wrong = sorted((-score(v, w), j) for j, z, w in sound if z != y)
        for p, pid in others:
            fits = [(s, j) for s, j in wrong if low * -p <= 100 * -s <= high * -p][:negatives]
            for rank, (s, j) in enumerate(fits, 1):
                out[i, pid, rank, j, -p, -s] += 1
    return out


VECTORS = "vec_id long, label int, embedding array<float>, score string, slot int, rank int, anchor_id int"


def mined(spark, rows, **how):
    df = spark.createDataFrame([(i, y, v, "x", 1, 2, 3) for i, y, v in rows], VECTORS).repartition(3)
    out = hard_negatives.hard_negatives(df, F.col("vec_id") % 5 == 0, **how)
    return Counter(tuple(r) for r in out.collect())


@pytest.mark.parametrize("size,spread,seed", [(150, 1.0, 1), (150, 0.02, 2), (90, 300.0, 3)])
def test_negatives_against_brute_force(spark, size, spread, seed):
    rng = np.random.default_rng(seed)
    rows = [(int(k), int(rng.integers(3)), [float(x) for x in (rng.normal(size=6) * spread).astype(np.float32)]) for k in range(size)]
    rows += [(k + 1000, 1, rows[7][2]) for k in range(20)]  # ties
    want = brute_negatives(rows, lambda i: i % 5 == 0)
    assert mined(spark, rows, query_block=16, row_block=32) == want
    assert want


def test_negatives_of_unsound_repeated_and_short_rows(spark):
    rng = np.random.default_rng(4)
    rows = [(k, k % 2, [float(x) for x in rng.normal(size=4).astype(np.float32)]) for k in range(40)]
    rows += [(None, 1, [1.0] * 4), (50, None, [1.0] * 4), (55, 1, None), (60, 1, [1.0, None, 1.0, 1.0]), (65, 1, [math.nan] * 4), (70, 1, [math.inf, 1.0, 1.0, 1.0])]
    rows += [(5, 1, rows[5][2])] * 2 + [(10, 1, rows[11][2])]  # equal query rows; one id with two labels
    sums = brute_negatives(rows, lambda i: i % 5 == 0)
    assert mined(spark, rows) == sums
    short = [(i, y, v[:2] if v and i is not None and i % 3 == 0 else v) for i, y, v in rows[:40]]
    padded = [(i, y, (v + [0.0] * 4)[:4]) for i, y, v in short]
    assert mined(spark, short) == brute_negatives(padded, lambda i: i % 5 == 0)


def test_negatives_of_empty_tables_and_of_none(spark):
    assert not mined(spark, [])
    assert not mined(spark, [(1, 0, [1.0]), (2, 1, [1.0])])  # no query
    assert not mined(spark, [(5, 0, [1.0]), (6, 1, [1.0])])  # no positive
    assert not mined(spark, [(5, 0, []), (6, 0, []), (7, 1, [])]) - Counter({(5, 6, 1, 7, 0, 0): 1})


def test_scores_beyond_doubles_are_exact_and_beyond_56_bits_refused(spark):
    rows = [(k, k % 2, [float(x)]) for k, x in [(0, 700_000), (2, 700_001), (1, 650_000), (3, 660_001)]]
    assert mined(spark, rows, scale=128) == brute_negatives(rows, lambda i: i % 5 == 0, scale=128)
    with pytest.raises(Exception, match="56 bits"):
        mined(spark, [(0, 0, [1e9]), (1, 0, [1e9]), (2, 1, [1e9])])


def test_intervals_drop_most_pairs_before_the_last_plane():
    rng = np.random.default_rng(5)
    q, x = (np.floor(256 * rng.normal(size=(n, 32)) / 6).astype(np.int64) for n in (8, 2000))
    seen = []

    def dense(total, low, high, alive):
        nth = np.partition(total, -3, axis=1)[:, -3]
        return alive & (total >= (nth + low - high)[:, None])

    def few(i, low, high):
        seen.append(len(i))
        return high >= hard_negatives._nth_largest(i, low, 3, 8)[i]

    i, j, s = hard_negatives.sliced(q, x, np.ones((8, 2000), bool), dense, few)
    assert (s == (q[i] * x[j]).sum(1)).all() and seen and seen[-1] < 8 * 2000 / 50
    exact = q @ x.T
    assert all(set(np.argsort(-exact[k], kind="stable")[:3]) <= set(j[i == k]) for k in range(8))


# ---- suffix dedup


def brute_suffix(rows, window):
    """{row: (kept bytes, removed, spans)}; rows are (id, text) in the order that counts."""
    seen, out = set(), []
    for _, text in rows:
        raw = (text or "").encode()
        gone = np.zeros(len(raw) + 1, int)
        for i in range(len(raw) - window + 1):
            if raw[i : i + window] in seen:
                gone[i] += 1
                gone[i + window] -= 1
            seen.add(raw[i : i + window])
        mask = np.cumsum(gone[:-1]) > 0
        out.append((bytes(b for b, m in zip(raw, mask) if not m), int(mask.sum()), int((np.diff(np.append(0, mask.astype(int))) == 1).sum())))
    return out


DOCS = "doc_id long, text string, lang string, s string, block string, side string, n_bytes string"


def cut(spark, rows, parts=3, **how):
    df = spark.createDataFrame([(i, t, "en", "a", "b", "c", "d") for i, t in rows], DOCS).repartition(parts)
    return suffix_dedup.suffix_dedup(df, **how).collect()


def agrees(spark, rows, window=100, **how):
    got = {r.doc_id: (bytes(r.kept), r.n_removed, len(r.removed)) for r in cut(spark, rows, window=window, **how)}
    rows = sorted(rows)
    want = {i: x for (i, _), x in zip(rows, brute_suffix(rows, window), strict=True)}
    assert got == want
    return sum(x[1] for x in want.values())


def test_suffix_dedup_against_brute_force(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randrange(2, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    passages = [text(60) for _ in range(6)]
    rows = []
    for k in range(120):
        body = [text(rng.randrange(1, 60)) for _ in range(3)]
        for at in range(3):
            if rng.random() < 0.5:
                p = rng.choice(passages)
                body[at] += p[rng.randrange(80) : len(p) - rng.randrange(80)]
        rows.append((rng.randrange(10**12) - 10**11, "".join(body)))
    rows += [(k, rows[0][1]) for k in range(5)] + [(10, "ab" * 400), (11, "ab" * 90 + "x"), (12, "a" * 1000), (13, "a" * 99), (14, ""), (15, None), (16, "\0" * 150)]
    assert agrees(spark, rows) > 5000


@pytest.mark.parametrize("window,gram", [(16, 8), (40, 16), (100, 64)])
def test_suffix_dedup_with_other_windows(spark, window, gram):
    rng = random.Random(7)
    rows = [(k, "".join(rng.choice("ab") if rng.random() < 0.9 else "c" for _ in range(rng.randrange(300)))) for k in range(60)]
    agrees(spark, rows, window=window, gram=gram)


def test_anchors_shared_by_crowds_are_compared_by_windows(spark, monkeypatch):
    rng = random.Random(8)
    noise = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    core = noise(140)
    rows = [(k, noise(rng.randrange(50, 90)) + core[rng.randrange(30) : 140 - rng.randrange(10)] + noise(60)) for k in range(300)]
    rows += [(1000 + k, rows[k][1]) for k in range(40)]
    assert agrees(spark, rows) > 1000  # crowds: over 64 stretches share an anchor in a task
    monkeypatch.setattr(suffix_dedup, "_MOST", 8)  # and on the way through the shards, with few in each task
    assert agrees(spark, rows, parts=40) > 1000


def test_order_of_suffixes_is_lexicographic():
    rng = random.Random(9)
    strings = ["".join(rng.choice("ab\0") for _ in range(rng.randrange(0, 120))).encode() for _ in range(50)] + [b"ab" * 60] * 2 + [b""]
    buf, ends = np.frombuffer(b"".join(strings), np.uint8), np.append(0, np.cumsum([len(s) for s in strings]))
    at, run = suffix_dedup.ordered(buf, ends, 16, period=4)
    suffix = {int(ends[k] + i): s[i:] for k, s in enumerate(strings) for i in range(len(s) - 15)}
    assert sorted(at.tolist()) == sorted(suffix) and [suffix[i] for i in at.tolist()] == sorted(suffix.values())
    for a, b, x, y in zip(at[:-1].tolist(), at[1:].tolist(), run[:-1], run[1:]):
        assert (x == y) == (suffix[a][:16] == suffix[b][:16])


def test_repeated_and_null_ids(spark):
    base = "".join(random.Random(3).choices("abcdefgh", k=300))
    out = cut(spark, [(1, base), (1, base), (None, base), (None, "x" + base), (2, base + "tail")])
    assert sorted(r.n_removed for r in out) == [0, 300, 300, 300, 300]
    assert next(r for r in out if r.n_removed == 0).doc_id is None  # null is the least
    assert cut(spark, []) == []


# ---- collocations


def brute_phrases(rows, min_count, most=5, absorb=100):
    count, total = defaultdict(Counter), Counter()
    for text, lang in rows:
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", lower):
            words = re.findall("[^ \t]+", piece)
            total[lang or "und"] += len(words)
            for m in range(1, most + 1):
                count[lang or "und"].update(tuple(words[i : i + m]) for i in range(len(words) - m + 1))
    out = set()
    for lang, c in count.items():
        often = {p: a for p, a in c.items() if len(p) > 1 and a >= min_count}
        longer = defaultdict(int)
        for p, a in often.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    longer[p[i : i + m]] = max(longer[p[i : i + m]], a)
        for p, a in often.items():
            if p in longer and 100 * longer[p] >= absorb * a:
                continue
            score, k = min((1000 * a * total[lang] // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
            out.add((lang, " ".join(p), a, c[p[:k]], c[p[k:]], total[lang], score))
    return out


PHRASES = "doc_id long, text string, lang string, word string, ids string, n string, id string, w1 string"


def phrases(spark, rows, **how):
    df = spark.createDataFrame([(k, t, g, "w", "x", "n", "i", "j") for k, (t, g) in enumerate(rows)], PHRASES).repartition(3)
    return collocations.collocations(df, **how)


def some_texts(seed, n):
    rng = random.Random(seed)
    stock = ["The", "of", "and", "Été", "x-y", "a"] + [f"w{i}" for i in range(12)]
    return [(" ".join(rng.choice(stock) + rng.choice(["", "", "", ",", "\n", "\t", ".\r"]) for _ in range(rng.randrange(120))), rng.choice(["en", "fr", None])) for _ in range(n)]


@pytest.mark.parametrize("min_count,most,absorb", [(8, 5, 100), (3, 3, 60), (5, 6, 90)])
def test_collocations_against_brute_force(spark, min_count, most, absorb):
    rows = some_texts(10, 60) + [("w1 w2 w3 w4 w5 w6 w7", "en")] * 20 + [("a a a a a a a a", "fr")] * 5
    got = phrases(spark, rows, min_count=min_count, max_words=most, absorb_percent=absorb)
    got = {tuple(r) for r in got.collect()}
    assert got == brute_phrases(rows, min_count, most, absorb) and len(got) > 10


def test_small_chunks_and_slices_change_nothing(spark, monkeypatch):
    rows = some_texts(11, 40) + [("w1 w2 w3 w4", "en")] * 30
    want = brute_phrases(rows, 5)
    monkeypatch.setattr(collocations, "_CHUNK", 3)
    monkeypatch.setattr(collocations, "_SLICE", 200)
    monkeypatch.setattr(collocations, "_BITS", 10)
    assert {tuple(r) for r in phrases(spark, rows, min_count=5).collect()} == want


def test_growth_is_depth_first_and_complete():
    rng = random.Random(12)
    rows = sorted([rng.choice([1, 2]), rng.choice([1, 2, 3]), *([rng.choice([1, 2]), rng.choice([0, 4])] if rng.random() < 0.7 else [0, 0])] for _ in range(200))
    w = [np.array(c) for c in zip(*rows)]
    found = list(collocations._grow(w, np.ones(200, int), 10))
    want = Counter(tuple(r[:m]) for r in rows for m in (2, 3, 4) if 0 not in r[:m])
    assert {p: c for p, c in found if c >= 10} == {p: c for p, c in want.items() if c >= 10}
    assert [p for p, _ in found] == sorted(p for p, _ in found)  # a prefix before what it grows into


def test_counts_beyond_64_bits_of_product(spark):
    words = spark.createDataFrame([(1, "en", "a"), (2, "en", "b")], "id long, lang string, word string")
    found = spark.createDataFrame([([1], 3 * 10**14), ([2], 2 * 10**14), ([1, 2], 10**14 + 1)], "ids array<long>, n long")
    r = collocations._scored(found, words, spark.createDataFrame([("en", 10**16)], "lang string, n long"), 100).first()
    assert r.score == 1000 * (10**14 + 1) * 10**16 // (3 * 10**14 * 2 * 10**14)


def test_top_ties_and_empty(spark):
    rows = [("a b. c d. e f", "en")] * 4 + [("g h", "fr")] * 4
    got = collocations.top(phrases(spark, rows, min_count=4), 2).orderBy("lang", "rank").collect()
    assert [(r.lang, r.rank, r.phrase) for r in got] == [("en", 1, "a b"), ("en", 2, "c d"), ("fr", 1, "g h")]
    assert phrases(spark, [], min_count=1).count() == 0
    assert phrases(spark, [(None, "en"), ("", None), (" .,\n", "en")], min_count=1).count() == 0
    long = "q r " * 50_000
    assert phrases(spark, [(long, None)], min_count=60_000, max_words=2).count() == 0
    assert {(r.phrase, r.a) for r in phrases(spark, [(long, None)], min_count=100, max_words=2).collect()} == {("q r", 50_000), ("r q", 49_999)}
