import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import chat, common, exact_dedup, kernels, language_id, line_dedup, near_dedup, packing, quality, sentencepiece_nbest, substring_dedup, url_filter
from tessera.llm.queries import vocabulary

WORD = re.compile("[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, n long, block int, place string, body string, digest string, tree int"


def corpus():
    """Texts with copies, near copies, shared passages, nulls, blanks, one long text, and a hot group."""
    rng = random.Random(4)
    vocabulary = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 7))) for _ in range(400)]
    words = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    passage, base = words(60), words(200)
    out = [None, "", " \n\t ", "one", "One", "two words", "a b c", "A b C", "a b c d", " x y"]
    out += [" ".join(words(rng.randint(1, 120))) for _ in range(30)]
    out += [" ".join(words(20) + passage[: rng.randint(30, 60)] + words(20)) for _ in range(12)]
    for k in range(15):
        copy = list(base)
        for _ in range(k // 2):
            copy[rng.randrange(200)] = rng.choice(vocabulary)
        out.append(" ".join(copy))
    out += ["the same copy  of a text " * 12] * 25 + ["the same copy of\na text " * 12] * 3
    out += [" ".join(["again"] * 90), " ".join(words(6000)), "line one\nline two\n\nline one\nline two\n" * 9]
    return [(i, t) for i, t in enumerate(out)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, ["en", None, "xx"][i % 3], i, 1, "p", "b", "d", 0) for i, t in corpus()]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df, *columns):
    return {r[0]: tuple(r[1:]) for r in df.select("doc_id", *columns).collect()}


def test_kernels():
    x = np.random.default_rng(1).integers(0, 99, 60).astype(np.uint64)
    for w in (1, 2, 5, 28):
        assert kernels.sliding_min(x, w).tolist() == [x[i : i + w].min() for i in range(60 - w + 1)]


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000, i) for i in range(1001, 1200)] + [(i, i + 1) for i in range(2000, 2100)]
    parent = {}
    find = lambda x: x if parent.setdefault(x, x) == x else find(parent[x])
    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent if any(x in e and e[0] != e[1] for e in edges)}
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


# Packing


def test_packing_round_trip(spark, docs, empty):
    from tokenizers import Tokenizer

    path = vocabulary("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    hard = [(i, x) for i, x in enumerate([None, "", "Hello, WORLD's <|endoftext|> x<|startoftext|>y", "don't 'the (abc) a..b ..,. “q”. é. Éa Á. İstanbul ß. x 12ab3", "<|ENDOFTEXT|> A", "á.\n\n\t b", "x" * 3000, "same", "same"], 500)]
    all_docs = corpus() + hard
    frame = spark.createDataFrame(all_docs, "doc_id long, text string").repartition(3)
    rows = packing.pack(frame, path, capacity=512, quantum=16).collect()
    want = {i: [*t.encode(x or "", add_special_tokens=False).ids, 2] for i, x in all_docs}
    got, filled = {}, {}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.start)):
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert r.start == len(got.setdefault(r.doc_id, [])) and r.length == len(ids) and r.ids_crc32 == zlib.crc32(r.ids) and r.doc_tokens == len(want[r.doc_id])
        got[r.doc_id] += ids
        filled.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert got == want and sorted(filled) == list(range(len(filled)))
    for parts in filled.values():
        parts.sort()
        assert [o for o, _ in parts] == list(itertools.accumulate([0, *[n for _, n in parts]]))[:-1] and sum(n for _, n in parts) <= 512
    total = sum(map(len, want.values()))
    assert len(filled) <= math.ceil(total / 512) * 1.1 + 2
    assert packing.pack(empty, path).count() == 0


def test_cutting_stock_is_near_the_bound():
    rng = np.random.default_rng(0)
    for demand in (rng.integers(0, 50, 64), np.bincount(rng.geometric(0.05, 3000).clip(0, 63), minlength=64), np.zeros(64, int), np.eye(64, dtype=int)[40] * 1000):
        table = packing.slots(demand.copy())
        placed, load = Counter(), Counter()
        for r in table.itertuples():
            for k in range(r.first, r.last):
                placed[r.cls] += 1
                load[r.sequence + (k - r.first) // r.per] += r.cls + 1
        assert placed == Counter({i: int(n) for i, n in enumerate(demand) if n}) and max(load.values(), default=0) <= 64
        big = sum(int(n) for i, n in enumerate(demand) if 2 * (i + 1) > 64)
        bound = max(big, math.ceil(sum((i + 1) * int(n) for i, n in enumerate(demand)) / 64))
        assert len(load) <= bound * 1.02 + 12


# Language identification


def test_language_id(spark):
    rng = random.Random(0)
    parts = {"aa": ["bla", "kru", "the", "ing"], "bb": ["ção", "que", "são", "el"], "cc": ["ich", "und", "ß", "zu"]}
    rows = [(i, " ".join("".join(rng.choices(parts[k], k=3)) for _ in range(rng.randint(2, 80))), k) for i in range(240) for k in [list(parts)[i % 3]]]
    rows += [(900, None, "aa"), (901, " 12 . ", "bb"), (902, "", None), (903, rows[0][1] * 400, None), (904, "x", "aa"), (904, "x", "aa")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    network = language_id.fit(frame.where(~language_id.held_out()), steps=120)
    out = language_id.predict(frame.withColumn("held", language_id.held_out()), network, keep=["held", "lang"]).collect()
    assert len(out) == len(rows)
    tested = [r.lang == r.lang_pred for r in out if r.held and r.doc_id < 900]
    assert len(tested) > 30 and np.mean(tested) > 0.95
    last = {r.doc_id: (r.lang_pred, r.score) for r in out if r.doc_id >= 900}
    assert last[900] == last[901] == last[902] == ("und", 0.0) and last[903][0] == "aa" and 0 < last[904][1] <= 1
    assert {r.held for r in out if r.doc_id == 5} == {zlib.crc32(b"5") % 4 == 2}
    nothing = frame.where("lang = 'zz'")
    assert language_id.fit(nothing) is None
    assert {r.lang_pred for r in language_id.predict(frame, None).collect()} == {"und"}
    assert language_id.predict(nothing, network).count() == 0


def test_gradients():
    net = language_id.Network(["a", "b", "c"])
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    rng = np.random.default_rng(0)
    seq, target, mask = rng.integers(97, 105, (language_id.STRETCH, 5)), np.array([0, 1, 2, 0, 1]), np.ones((language_id.STRETCH, 5))
    _, g = net.gradients(seq, target, mask)
    for k, at in (("Xf", (99, 5)), ("Xb", (100, 20)), ("Uf", (2, 3)), ("Ub", (1, 17)), ("V", (3, 1)), ("c", (2,))):
        both = []
        for step in (1e-3, -2e-3):
            net.w[k][at] += step
            both.append(net.gradients(seq, target, mask)[0])
        net.w[k][at] += 1e-3
        assert (both[0] - both[1]) / 2e-3 == pytest.approx(g[k][at], rel=0.03, abs=2e-6)


# Exact deduplication


def test_cuckoo_index():
    index, keys = exact_dedup.CuckooIndex(buckets=2), [hashlib.sha256(bytes([i % 256, i // 256])).digest() for i in range(3000)]
    for i, k in enumerate(keys):
        index.set(k, i)
    assert index.buckets > 512 and index.live == 3000 and all(index.get(k) == i for i, k in enumerate(keys))
    for k in keys[::2]:
        assert index.delete(k) and not index.delete(k)
    assert [index.get(k) for k in keys] == [None if i % 2 == 0 else i for i in range(3000)]
    assert index.live == 1500 and sum(not index.maybe(hashlib.md5(k).digest()) for k in keys) > 2900


def test_exact_dedup(spark, docs, empty):
    groups = {}
    for i, t in corpus():
        groups.setdefault(re.sub("[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), i))
    want = {i: (min(g)[1], len(g), i == min(g)[1], hashlib.sha256(k.encode()).hexdigest()) for k, g in groups.items() for _, i in g}
    assert by_id(exact_dedup.exact_dedup(docs), "keep_id", "group_size", "kept", "text_sha256") == want
    assert exact_dedup.exact_dedup(empty).count() == 0
    gone = docs.where("doc_id = 0").select("doc_id")
    assert {r.keep_id for r in exact_dedup.exact_dedup(docs, gone).where("doc_id in (1, 2)").collect()} == {2}


# Substring deduplication


def removed(texts, window):
    words = [WORD.findall(t or "") for t in texts]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        out.append((len(w), sum(gone), " ".join(a for a, g in zip(w, gone, strict=True) if not g)))
    return out


@pytest.mark.parametrize(("window", "gram", "here"), [(35, 8, 16), (35, 8, 2), (12, 5, 1), (4, 4, 16)])
def test_substring_dedup(spark, docs, window, gram, here, monkeypatch):
    job = substring_dedup.substring_dedup(docs, window=window, gram=gram, block_bytes=2000, keep=["lang", "n"])
    want = dict(zip([i for i, _ in corpus()], removed([t for _, t in corpus()], window), strict=True))
    assert by_id(job, "n_words", "n_removed", "kept_text") == want
    spans = job.select("doc_id", "n_removed", F.aggregate("removed", F.lit(0).cast("long"), lambda a, x: a + x["length"]).alias("m"), "lang", "n").collect()
    assert all(r.n_removed == r.m and r.n == r.doc_id for r in spans)


def test_settled_hot_anchors():
    """What a task decides alone and what the shard decides give all matches, however frequent."""
    rng = np.random.default_rng(3)
    for _ in range(30):
        rec = np.zeros(200, substring_dedup._OPEN)
        rec["a"] = rng.choice([1, 2, 3, *range(10, 60)], 200)
        rec["s"] = rec["a"] * 100 + np.where(rng.random(200) < 0.5, 0, rng.integers(0, 6, 200))
        rec["block"] = rng.integers(0, 9, 200)
        rows = []
        for part in np.array_split(rec, 4):
            substring_dedup._settle(rows, part, 3)
        per_block = {(side, t): set(np.frombuffer(d, "<u8").tolist()) for side, t, d in rows if side in (1, 2)}
        sent = np.concatenate([np.frombuffer(d, substring_dedup._OPEN) for side, _, d in rows if side == 0])
        assert Counter(sent["a"].tolist()).most_common(1)[0][1] <= 4 * max(16, 4)
        assert all(s in set(sent["s"].tolist()) or any(s in v for v in per_block.values()) for s in rec["s"].tolist())


def test_substring_edges(spark, empty):
    assert substring_dedup.substring_dedup(empty).count() == 0
    twice = spark.createDataFrame([(1, " ".join(map(str, range(40)))), (1, " ".join(map(str, range(40))))], "doc_id long, text string")
    assert [r.n_removed for r in substring_dedup.substring_dedup(twice).collect()] == [40, 40]


# Near deduplication


def test_near_dedup(spark, docs, empty):
    sets = {}
    for i, t in corpus():
        w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in WORD.findall(t or "")]
        sets[i] = {tuple(w[k : k + 4]) for k in range(len(w) - 3)} or ({tuple(w)} if w else set())
    label = {i: i for i in sets}
    for _ in range(20):
        for a, b in itertools.combinations(sets, 2):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                label[a] = label[b] = min(label[a], label[b])
    got = by_id(near_dedup.near_dedup(docs), "n_shingles", "component_id", "kept")
    assert got == {i: (len(s), label[i], label[i] == i) for i, s in sets.items()}
    assert near_dedup.near_dedup(empty).count() == 0


# URL filters


def test_near_dedup_in_a_dense_family(spark, monkeypatch):
    """Over 1,000 texts of one template, just under 0.8 to each other, and some pairs over it."""
    template, texts = [f"t{i}" for i in range(203)], []
    for k in range(1000):
        texts.append(template + [f"a{k}.{i}" for i in range(33)])
    for k in range(60):
        for side in "xy":
            texts.append(template + [f"p{k}.{i}" for i in range(8)] + [f"{side}{k}.{i}" for i in range(25)])
    random.Random(1).shuffle(texts)
    sets = [{tuple(w[i : i + 4]) for i in range(len(w) - 3)} for w in texts]
    column = {g: i for i, g in enumerate(set().union(*sets))}
    held = np.zeros((len(texts), len(column)), np.float32)
    for i, x in enumerate(sets):
        held[i, [column[g] for g in x]] = 1
    both, n = held @ held.T, held.sum(axis=1)
    linked = 100 * both >= 80 * (n[:, None] + n[None, :] - both)
    assert linked.sum() == len(texts) + 120 and (100 * both >= 74 * (n[:, None] + n[None, :] - both)).all()
    monkeypatch.setattr(near_dedup, "_TILE", 100, raising=False)
    rows = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string").repartition(5)
    got = {r.doc_id: r.component_id for r in near_dedup.near_dedup(rows).collect()}
    assert got == {i: int(np.flatnonzero(linked[i]).min()) for i in range(len(texts))}


def test_near_dedup_of_crowded_clusters(spark, monkeypatch):
    """Texts of one template whose rarest shingles are shared within clusters: parts of a region that are compared by tiles."""
    rng, texts = random.Random(3), []
    for c in range(25):
        for _ in range(12):
            chosen = sorted(rng.sample(range(12), 8))
            texts.append([f"t{i}" for i in range(100)] + [f"c{c}.{k}.{i}" for k in chosen for i in range(9)])
    sets = [{tuple(w[i : i + 4]) for i in range(len(w) - 3)} for w in texts]
    label = list(range(len(texts)))
    for _ in range(12):
        for a, b in itertools.combinations(range(len(texts)), 2):
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                label[a] = label[b] = min(label[a], label[b])
    assert 100 < len(set(label)) < len(texts)
    tiles = []
    whole = near_dedup.tiled
    monkeypatch.setattr(near_dedup, "tiled", lambda rows, *more: tiles.append(rows.select("tree").distinct().count()) or whole(rows, *more))
    monkeypatch.setattr(near_dedup, "_TILE", 50)
    monkeypatch.setattr(near_dedup, "_FAR", 4)
    rows = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string").repartition(5)
    got = {r.doc_id: r.component_id for r in near_dedup.near_dedup(rows).collect()}
    assert got == dict(enumerate(label))
    assert len(tiles) == 2 and tiles[1]


def test_url_filter(spark):
    link = '<link rel="canonical" href="{}">'
    pages = [
        (1, "http://A.Example.NET/en/x?q#f", None), (2, "https://x.net/de/", None), (3, "https://net", None), (4, "nonsense", None), (5, None, "<p>"), (6, "https://m.example.com/de/1", None),
        (7, "https://www.example.com/fr/2", link.format("https://m.example.com/de/1")), (8, "https://ok.org/x", link.format("/y")), (9, "https://ok.org/y", '<META http-equiv="Refresh" content="0; url=http://bad.net/z">'),
        (10, "https://ok.org/fr/a", link.format("https://bad.net/z")), (11, "https://ok.org/c", link.format("https://ok.org/c#top")), (12, "https://notnet/x", None), (13, "https://m.example.com/de/1", None),
    ]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(frame).collect()}
    assert got == {
        1: ("a.example.net", "/en/x", "example.net/en/", "allow"), 2: ("x.net", "/de/", "net/", "block"), 3: ("net", "", None, "allow"), 4: ("", "", None, "allow"), 5: ("", "", None, "allow"),
        6: ("m.example.com", "/de/1", "example.com/de/", "block"), 7: ("www.example.com", "/fr/2", None, "block"), 8: ("ok.org", "/x", None, "block"), 9: ("ok.org", "/y", None, "block"),
        10: ("ok.org", "/fr/a", "org/fr/", "allow"), 11: ("ok.org", "/c", None, "allow"), 12: ("notnet", "/x", None, "allow"), 13: ("m.example.com", "/de/1", "example.com/de/", "block"),
    }
    assert url_filter.filter_urls(frame.limit(0)).count() == 0


# Chat formatting


def test_reply_trees(spark):
    rng = random.Random(5)
    rows = [("t", i, rng.randrange(max(0, i - 3), i) if i else None, rng.choice(["user", "assistant", None]), rng.choice([None, "", "hi", "<|im_end|>\\", "a\\n[INST]", "</s>[INST] ok [/INST]", "<<s>>"]), rng.random()) for i in range(60)]
    rows += [("u", 1, 99, "user", "root", None), ("c", 1, 2, "user", "x", 1.0), ("c", 2, 1, "user", "y", 1.0)]
    frame = spark.createDataFrame(rows, "tree string, id long, parent long, role string, text string, score double")
    parent, score = {r[1]: r[2] for r in rows[:60]}, {r[1]: r[5] for r in rows[:60]}
    path = lambda x: [] if x is None else [*path(parent[x]), x]
    leaves = sorted(set(parent) - set(parent.values()), key=lambda x: (-sum(score[k] for k in path(x)), x))
    out = chat.format_branches(frame, keep=3)
    got = out.select("tree", "branch", "n_turns", chat.read_back(F.col("formatted")).alias("turns"), chat.masked(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()
    by_branch = {(r.tree, r.branch): r for r in got}
    assert set(by_branch) == {("t", x) for x in leaves[:3]} | {("u", 1)}
    for leaf in leaves[:3]:
        r, want = by_branch["t", leaf], [(rows[k][3] or "", rows[k][4] or "") for k in path(leaf)]
        assert [tuple(t) for t in r.turns] == want and r.n_turns == len(want) and r.loss == "".join(t for a, t in want if a == "assistant")
    assert chat.format_branches(frame.limit(0)).count() == 0


def test_null_conversation(spark):
    rows = [(None, 1, "assistant", "yes"), (None, 0, "user", "hm"), (0, 0, "user", "other"), (None, 2, "user", "so")]
    out = chat.format_branches(chat.from_turns(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")))
    got = {r.tree: [tuple(t) for t in r.t] for r in out.select("tree", chat.read_back(F.col("formatted")).alias("t")).collect()}
    assert got == {None: [("user", "hm"), ("assistant", "yes"), ("user", "so")], 0: [("user", "other")]}


# Line deduplication


def test_line_dedup(spark, docs, empty):
    texts = dict(corpus()) | {200: "a\nb\nc\nd\ne\nf\ng\nh", 201: "new\na\nb\nc\nd\ne\nf\ng\nh", 202: None, 203: "\n\n\n", 204: "\n\n\n"}

    def cut(t):
        lines = t.split("\n")
        h = [int(hashlib.md5(x.encode()).hexdigest()[:7], 16) for x in lines]
        out, now = [], []
        for i, x in enumerate(lines):
            now.append(x)
            if i == len(lines) - 1 or (h[i] + 31 * (h[i - 1] if i else 0) + 961 * (h[i - 2] if i > 1 else 0)) % 1000003 % 4 == 0:
                out.append(now)
                now = []
        return out

    first, want = {}, {}
    for i in sorted(texts):
        if texts[i] is None:
            want[i] = (None, 0, 0)
            continue
        kept, gone = [], 0
        for k, c in enumerate(cut(texts[i])):
            body = "\n".join(c)
            if len(c) > 1 and WORD.search(body) and first.setdefault(body, (i, k)) != (i, k):
                gone += len(c)
            else:
                kept += c
        want[i] = ("\n".join(kept), len(texts[i].split("\n")), gone)
    frame = spark.createDataFrame([(i, t, "x") for i, t in texts.items()], "doc_id long, text string, n_lines string").drop("n_lines").repartition(4)
    assert by_id(line_dedup.line_dedup(frame), "text", "n_lines", "n_removed") == want
    assert sum(w[2] for w in want.values()) > 0
    assert line_dedup.line_dedup(empty.select("doc_id", "text")).count() == 0


# Quality rules


def test_quality(spark, docs, empty):
    got = by_id(quality.quality(docs), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    for i, t in corpus():
        w = WORD.findall(t or "")
        seen = Counter(zip(w, w[1:], w[2:], strict=False))
        again = {k + j for k in range(len(w) - 2) if seen[tuple(w[k : k + 3])] > 1 for j in range(3)}
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        failed = len(w) < 50 or 100 * len(again) > 50 * len(w)
        assert got[i][:6] == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(again), failed)
        assert not (failed and got[i][6])
    assert quality.quality(empty).count() == 0


def test_divergence(spark):
    rng = random.Random(1)
    good = [(i, " ".join(rng.choices(["the", "of", "and", "house", "tree", "river"], k=150)), "en") for i in range(40)]
    bad = [(100, " ".join("%%$" + "#" * (k % 9) + str(k) for k in range(150)) + " the", "en"), (101, "!!! ### " * 20, "en")]
    got = {r.doc_id: (r.kept, r.distance) for r in quality.quality(spark.createDataFrame(good + bad, "doc_id long, text string, lang string")).collect()}
    assert got[100][0] is False and got[100][1] > 0.3 and got[101][1] is None
    assert all(got[i][1] < 0.3 for i in range(40))


# SentencePiece


def brute(model, s):
    """All segmentations with their scores."""
    if not s:
        return [(0.0, ())]
    return [(score + rest, (*ids, *more)) for n in range(1, min(len(s), model.longest) + 1) for a, ids, score in model.lattice(s[:n])[0][n] if a == 0 for rest, more in brute(model, s[n:])]


def test_nbest(spark, empty):
    path = vocabulary("piece_bpe_32k.model")
    model = sentencepiece_nbest.load(path)
    for text in ("the cat", "a", "aa  b", "x\ny", "é☃", "inthe", "the.cat", "a.,b", "é!"):
        want = sorted((-s, i) for s, i in brute(model, "▁" + text.replace(" ", "▁")))[:6]
        got = model.nbest(text, 6)
        assert [s for s, _ in got] == pytest.approx([-s for s, _ in want])
        assert len({i for _, i in got}) == len(got) and all(model.decode(np.frombuffer(i, "<u4").tolist()) == text for _, i in got)
    rows = corpus() + [(300, " lead and  gaps \n\n"), (301, "snow ☃ 中文 \U0001f600"), (302, "w" * 5000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    out = sentencepiece_nbest.decode(sentencepiece_nbest.encode(frame, path, n=3), path).collect()
    texts = dict(rows)
    assert all(r.text == (texts[r.doc_id] or "") for r in out) and {r.doc_id for r in out} == set(texts)
    assert sentencepiece_nbest.encode(empty, path).count() == 0


def test_words_with_structure_are_told_apart(spark):
    """Thue-Morse words and their complements, on which hashes by sums of powers agree."""
    from tokenizers import Tokenizer

    path = vocabulary("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    words = [w for n in (1024, 2048, 4096) for a in ["".join("ab"[bin(i).count("1") & 1] for i in range(n))] for w in (a, a.translate(str.maketrans("ab", "ba")))]
    rows = spark.createDataFrame(list(enumerate(words)) + [(50, " ".join(words))], "doc_id long, text string").coalesce(1)
    got: dict[int, list[int]] = {}
    for r in sorted(packing.pack(rows, path).collect(), key=lambda r: (r.doc_id, r.start)):
        got.setdefault(r.doc_id, []).extend(np.frombuffer(r.ids, "<u4").tolist())
    assert all(got[i] == [*t.encode(w, add_special_tokens=False).ids, 2] for i, w in enumerate([*words]))
    assert {r.component_id for r in near_dedup.near_dedup(rows).where("doc_id < 50").collect()} == set(range(6))
    alone = substring_dedup.substring_dedup(spark.createDataFrame([(k, " ".join([w] * 2 + [f"w{i}" for i in range(32)])) for k, w in enumerate(words[:2])], "doc_id long, text string"), window=34)
    assert {r.n_removed for r in alone.collect()} == {0}


def test_short_pieces_fill_sequences(spark):
    rows = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("the cat").alias("text"))
    out = packing.pack(rows, vocabulary("word_bpe_49k.json"), with_ids=False)
    r = out.agg(F.sum("length").alias("n"), F.countDistinct("sequence_id").alias("s")).first()
    assert r.n == 60_000 and r.s == math.ceil(60_000 / 4096 / 0.999)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    r = packing.pack(docs, vocabulary("word_bpe_49k.json"), with_ids=False).agg(F.sum("length").alias("n"), F.countDistinct("sequence_id").alias("s")).first()
    assert r.n >= 0.98 * 4096 * r.s


def test_a_large_family_and_outliers_with_one_link(spark):
    """Near copies of one text, and texts that are near one or two of them only: no link is lost."""
    rng, base = random.Random(9), [f"b{i}" for i in range(200)]
    family = [base[: 4 * (k % 4)] + [f"n{k}.{j}" for j in range(4)] + base[4 * (k % 4) + 4 :] for k in range(5000)]
    outliers = []
    for k in range(5):
        near = family[rng.randrange(5000)]
        outliers.append([*near[:180], *[f"o{k}.{j}" for j in range(len(near) - 180)]])
    texts = [" ".join(w) for w in family + outliers]
    sets = [{tuple(w[i : i + 4]) for i in range(len(w) - 3)} for w in family + outliers]
    want = {}
    for k in range(5000, 5005):
        near = [i for i in range(5000) if 100 * len(sets[i] & sets[k]) >= 80 * len(sets[i] | sets[k])]
        assert len(near) < 2500
        want[k] = 0 if near else k
    got = {r.doc_id: r.component_id for r in near_dedup.near_dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(7)).collect()}
    assert {i for i, c in got.items() if c != 0} == {k for k, c in want.items() if c}
    assert 0 in want.values()


def test_rows_that_share_an_id_are_judged_alone(spark):
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    rows = spark.createDataFrame([(1, a), (1, b), (0, b + " end"), (5, a), (5, a), (7, None), (7, "")], "doc_id long, text string")
    got = sorted(tuple(r) for r in near_dedup.near_dedup(rows).collect())
    assert got == [(0, 58, 0, True), (1, 57, 0, False), (1, 57, 1, True), (5, 57, 1, False), (5, 57, 1, False), (7, 0, 7, True), (7, 0, 7, True)]


def test_network_against_a_plain_forward_pass():
    net = language_id.Network(["a", "b", "c"])
    texts = ["The quick brown fox.", "ßüß çã", "x" * 100, "12 a"]

    def squash(x):
        return x / (1 + abs(x))

    def positions(data):
        n, states = language_id._HIDDEN, []
        for d in "fb":
            h, out = np.zeros(n), []
            for c in data if d == "f" else data[::-1]:
                x, u = net.w["X" + d][c].astype(float), net.w["U" + d].astype(float)
                r = np.array([sum(h[i] * u[i, j] for i in range(n)) for j in range(3 * n)])
                z, g = ((squash(x[k * n : k * n + n] + r[k * n : k * n + n]) + 1) / 2 for k in (0, 1))
                new = squash(x[2 * n :] + g * r[2 * n :])
                h = (1 - z) * new + z * h
                out.append(h)
            states.append(out if d == "f" else out[::-1])
        logits = np.concatenate(states, axis=1) @ net.w["V"] + net.w["c"]
        e = np.exp(logits)
        return e / e.sum(axis=1, keepdims=True)

    got = net.documents(texts)
    rows, lengths, owner = language_id.stretches(texts)
    assert net._fast(rows) == pytest.approx(net.positions(np.ascontiguousarray(rows.T)), abs=1e-5)
    for k in range(len(texts)):
        each = [positions(r)[:n] for r, n, o in zip(rows, lengths, owner, strict=True) if o == k]
        assert got[k] == pytest.approx(np.concatenate(each).mean(axis=0), abs=1e-5)


def test_every_language_is_learned(spark):
    rows = [(i, " ".join(random.Random(i).choices([f"{chr(97 + k % 26)}{chr(97 + k // 26)}q", f"{chr(97 + k % 26)}z{chr(97 + k // 26)}"], k=30)), f"l{k:02}") for i in range(210) for k in [i % 70]]
    network = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), steps=2)
    assert len(network.languages) == 70


def test_withdrawn_documents_leave_the_index(spark):
    rows = [(1, "a b"), (2, "a  b"), (3, "ab"), (4, "x"), (None, "x y"), (5, "xy")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    gone = spark.createDataFrame([(2,), (4,), (9,)], "doc_id long")
    got = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(frame, gone).collect()}
    assert got == {(1, 1, 2, True), (3, 1, 2, False), (None, None, 2, True), (5, None, 2, False)}
    merged = pa.Table.from_batches(exact_dedup._merge([pa.RecordBatch.from_pylist([{"digest": b"k" * 32, "n": n, "best_len": None, "best_id": None} for n in (1, -1)])]) or [], pa.schema([("digest", pa.binary()), ("n", pa.int64()), ("best_len", pa.int64()), ("best_id", pa.int64())]))
    assert merged.num_rows == 0


def test_line_dedup_replaces_columns_named_like_results(spark):
    rows = spark.createDataFrame([(1, "a\nb", "old", 7, [9])], "doc_id long, text string, n_lines string, n_removed int, removed_chunks array<int>")
    assert [tuple(r) for r in line_dedup.line_dedup(rows).collect()] == [(1, "a\nb", 2, 0, [])]


def test_repeated_windows_without_a_hash(spark):
    rng = random.Random(3)
    rows = [(i, [rng.choice("abcd") for _ in range(rng.randint(4, 60))]) for i in range(60)]
    out = spark.createDataFrame(rows, "i int, w array<string>").select("i", quality.by_words(F.col("w")).alias("at"), quality.repeated_words(F.col("w")).alias("n")).collect()
    for r in out:
        w = rows[r.i][1]
        seen = Counter(zip(w, w[1:], w[2:], strict=False))
        at = [k for k in range(len(w) - 2) if seen[tuple(w[k : k + 3])] > 1]
        assert r["at"] == at and r.n == len({k + j for k in at for j in range(3)})


def test_junk_without_common_words_is_judged(spark):
    rng = random.Random(1)
    good = [(i, " ".join(rng.choices(["the", "of", "and", "house", "tree", "river"], k=150)), "en") for i in range(40)]
    other = [(i, " ".join(rng.choices(["ja", "nein", "kahvi", "talo", "joki", "puu"], k=150)), "fi") for i in range(50, 90)]
    junk = [(100, " ".join("%%$" + "#" * (k % 9) + str(k) for k in range(5000)), "en")]
    got = {r.doc_id: (r.kept, r.base_failed) for r in quality.quality(spark.createDataFrame(good + other + junk, "doc_id long, text string, lang string")).collect()}
    assert got[100] == (False, False)


def test_long_texts_without_blanks(spark):
    rng = random.Random(2)
    path = vocabulary("piece_bpe_32k.model")
    texts = {1: "".join(chr(rng.randrange(0x4E00, 0x9FA5)) for _ in range(350_000)), 2: "".join(rng.choices("ABCDEFabcdef0123456789+/", k=1_000_000)), 3: "a" * 200_000}
    out = sentencepiece_nbest.decode(sentencepiece_nbest.encode(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), path, n=2), path)
    rows = out.select("doc_id", "place", F.sha2("text", 256).alias("h")).collect()
    assert {(r.doc_id, r.h) for r in rows} == {(i, hashlib.sha256(t.encode()).hexdigest()) for i, t in texts.items()} and len(rows) >= 5


def test_turns_in_any_order(spark):
    rows = [(1, 2, "user", "b"), (1, 2, "user", "a"), (1, 2, "user", "a"), (1, None, None, None), (2, 1, "assistant", "")]
    out = chat.format_branches(chat.from_turns(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")))
    got = {r.tree: [tuple(t) for t in r.t] for r in out.select("tree", chat.read_back(F.col("formatted")).alias("t")).collect()}
    assert got == {1: [("", ""), ("user", "a"), ("user", "a"), ("user", "b")], 2: [("assistant", "")]}


def test_releasing_keeps_every_batch():
    made = common.releasing(lambda batches: (2 * x for x in batches))
    assert list(made(iter([1, 2, 3]))) == [2, 4, 6]
    assert list(made(iter([]))) == []


def test_chat_plans_stay_small(spark):
    """Plans take the driver's memory: the last one reads written messages and doesn't number them again."""
    rows = spark.createDataFrame([(1, k, "user", f"t{k}") for k in range(5)], "conv_id long, turn long, role string, text string")
    out = chat.format_branches(chat.from_turns(rows))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and plan.count("Join") == 1
    assert [t.text for t in out.select(chat.read_back(F.col("formatted")).alias("t")).first().t] == [f"t{k}" for k in range(5)]
