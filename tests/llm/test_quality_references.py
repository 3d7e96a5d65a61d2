import math
import random
import re
from collections import Counter

from tessera.llm import quality

WORD = re.compile("[^\x20\x09-\x0D]+")
STOCK = {
    "en": "The the, of and to a in is that it for was on with be by as at house tree river".split(),
    "fi": "ja on ei se että hän oli mutta kun niin kuin talo Joki puu sanoi tuli vain nyt".split(),
}


def plain(word):
    return word.lower().strip(quality.MARKS)


def classes(text):
    words, patterns = WORD.findall(text), [p for k, p in quality.CLASSES.items() if k != "blank"]
    counts, ink = [len(re.findall(p, text)) for p in patterns], sum(map(len, words))
    counts.append(len(text) - ink)
    return [*counts, len(text) - sum(counts)]


def distance(x, y):
    term = lambda p, q: p * math.log2(2 * p / (p + q)) if p else 0.0
    pairs = [(p / sum(x), q / sum(y)) for p, q in zip(x, y, strict=True)]
    return math.sqrt(max(0.0, sum(term(p, q) + term(q, p) for p, q in pairs) / 2))


def expected(rows):
    """{doc_id: distance} of the documents that are judged, word by word."""
    words, kinds = {}, {}
    for _, text, lang in rows:
        if text and lang is not None:
            words.setdefault(lang, Counter()).update(map(plain, WORD.findall(text)))
            kinds[lang] = [a + b for a, b in zip(kinds.get(lang, [0] * 6), classes(text), strict=True)]
    total = sum(c.total() for c in words.values())
    known = {lang: c for lang, c in words.items() if c.total() * 256 >= total > 0}
    top = {lang: sorted((w for w in c if w), key=lambda w: (-c[w], w.encode()))[: quality.N_COMMON] for lang, c in known.items()}
    out = {}
    for i, text, lang in rows:
        own = Counter(map(plain, WORD.findall(text or "")))
        if own.total() < 100 or (lang is not None and lang not in known) or not known:
            continue
        bins = lambda c, ws: [*(c[w] for w in ws), c.total() - sum(c[w] for w in ws)]
        out[i] = min(max(distance(classes(text), kinds[k]), distance(bins(own, top[k]), bins(known[k], top[k]))) for k in known)
    return out


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, lang string, common string, n_words int").repartition(3)


def test_distances_against_brute_force(spark):
    rng = random.Random(5)
    text = lambda lang, n: " ".join(rng.choices(STOCK[lang], weights=range(len(STOCK[lang]), 0, -1), k=n))
    rows = [(i, text("en", rng.randrange(90, 400)) + rng.choice(["", ".", "\n"]), "en") for i in range(40)]
    rows += [(i, text("fi", rng.randrange(90, 400)), "fi") for i in range(40, 70)]
    rows += [(70, None, "en"), (71, "", "fi"), (72, " \n\t", None), (73, text("en", 200), None), (74, " ".join(f"%{k}#" for k in range(300)), "fi"), (75, "!! " * 150, None), (76, text("fi", 120).upper(), "fi")]
    rows += [(80, text("en", 5000), "en")] * 2 + [(81, "joki " * 3, "rare"), (82, text("fi", 50), "rare")]
    got = {r.doc_id: r.distance for r in quality.quality(table(spark, rows)).collect()}
    want = expected(rows)
    assert {i for i, d in got.items() if d is not None} == set(want) and {73, 74, 75, 76, 80} <= set(want)
    assert all(abs(got[i] - d) < 1e-9 for i, d in want.items())
    assert all(want[i] < 0.3 for i in want if i < 70) and min(want[74], want[75]) > 0.3


def test_a_language_too_rare_for_a_reference(spark):
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choices(STOCK["en"], k=1000)), "en") for i in range(40)] + [(90, " ".join(rng.choices(STOCK["fi"], k=120)), "fi"), (91, " ".join(rng.choices(STOCK["fi"], k=120)), None)]
    got = {r.doc_id: (r.distance, r.kept, r.base_failed) for r in quality.quality(table(spark, rows)).collect()}
    assert got[90][0] is None and got[90][1] is not got[90][2]
    assert got[91][0] > 0.3 and not got[91][1]


def test_no_language_is_named(spark):
    rows = [(1, " ".join(f"w{k}" for k in range(200)), None), (2, None, None), (3, None, "en")]
    assert {r.doc_id: (r.distance, r.kept) for r in quality.quality(table(spark, rows)).collect()} == {1: (None, True), 2: (None, False), 3: (None, False)}


def test_common_words_and_ties(spark):
    rows = [(1, "b a, (c) B! a é -- É d " * 2, "x"), (2, "b", None)]
    assert quality.common_words(table(spark, rows)) == [("x", 18, [("a", 4), ("b", 4), ("é", 4), ("c", 2), ("d", 2)])]
