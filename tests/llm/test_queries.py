import itertools
import random
import re
from collections import Counter

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from tests.compare import difference

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", [k for k in entry.oracle_sql() if k.startswith("op")])
def test_query(spark, name):
    assert difference(spark, entry.queries()[name], entry.oracle_sql()[name], SF) == ""


def test_all_are_registered():
    assert {k.split("_")[0] for k in entry.queries() if k.startswith("op")} == {f"op{i}" for i in range(1, 14)}


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    out = entry.queries()["op2_language_id"](spark, SF).join(docs, "doc_id").where("held_out and lang_pred <> 'und'").collect()
    assert sum(r.lang == r.lang_pred for r in out) >= 0.95 * len(out) > 20


def test_pipeline(spark, tmp_path):
    docs, n = spark.read.parquet(f"{SF}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        n.append(docs.count())
        if k < 4:
            assert docs.columns == corpus_pipeline.COLUMNS and docs.select("doc_id").distinct().count() == n[-1]
    assert n[0] >= n[1] >= n[2] == n[3] <= n[4] and n[0] > 150
    pieces = docs.groupBy("sequence_id").agg({"length": "sum"}).collect()
    assert max(r[1] for r in pieces) <= 4096


def _stage(name):
    return dict(corpus_pipeline.STAGES)[name]


@pytest.fixture(scope="module")
def table(spark):
    """Documents with exact, near and line copies, passages, nulls, a shared id, and columns with clashing names."""
    rng = random.Random(8)
    stock = "the of and to in a house tree river stone light water under green field walk".split()
    text = lambda n: " ".join(rng.choice(stock) + str(rng.randrange(300)) for _ in range(n))
    base, passage, block = text(150), text(60), "one line here\nand another one\nthird line now\nfourth line then"
    texts = [None, "", " \n ", "12 34 !!"] + [text(rng.randrange(30, 120)) for _ in range(20)] + [base] * 3 + [base + " end", "start " + base]
    texts += [text(40) + "\n" + passage + "\n" + text(40) for _ in range(5)] + [text(20) + "\n" + block + "\n" + block for _ in range(3)]
    rows = [(i, t, "en", None if i % 5 == 0 else "s", 1, "c", "m", 3, 4) for i, t in enumerate(texts)] + [(30, text(50), "en", "s", 1, "c", "m", 3, 4), (24, base, "en", "s", 1, "c", "m", 3, 4)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n_lines string, `digest` string, n_words int, component_id int").repartition(4)


def _rows(df):
    return Counter((r.doc_id, r.text) for r in df.collect())


def test_stages_against_brute_force(spark, table):
    WORD = re.compile("[^\x20\x09-\x0D]+")
    named = _stage("language ID")(spark, table, "")
    with_letters = Counter({k: n for k, n in _rows(table).items() if k[1] and any(c.isalpha() for c in k[1])})
    assert named.columns == corpus_pipeline.COLUMNS and _rows(named) == with_letters

    lined = _stage("line dedup")(spark, table, "")
    assert lined.columns == corpus_pipeline.COLUMNS and lined.count() == table.count()
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in lined.collect())

    shingles = lambda t: {tuple(w[i : i + 5]) for w in [re.sub("[A-Z]", lambda m: m[0].lower(), t or "")] for w in [WORD.findall(w)] for i in range(max(1, len(w) - 4)) if w}
    rows = sorted(((r.doc_id, r.text) for r in table.collect()), key=lambda r: (r[0], r[1] or ""))
    sets, group = [shingles(t) for _, t in rows], list(range(len(rows)))
    for _ in range(len(rows)):
        for i, j in itertools.combinations(range(len(rows)), 2):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                group[i] = group[j] = min(group[i], group[j])
    near = _stage("MinHash near-dedup")(spark, table, "")
    assert near.columns == corpus_pipeline.COLUMNS and _rows(near) == Counter(rows[i] for i in range(len(rows)) if group[i] == i) and near.count() < table.count()

    words = [WORD.findall(t or "") for _, t in rows]
    seen = Counter(tuple(w[i : i + 50]) for w in words for i in range(len(w) - 49))
    want = Counter()
    for (doc, t), w in zip(rows, words, strict=True):
        gone = [any(seen[tuple(w[i : i + 50])] > 1 for i in range(max(0, k - 49), min(k, len(w) - 50) + 1)) for k in range(len(w))]
        want[doc, tuple(x for x, g in zip(w, gone, strict=True) if not g)] += 1
    cut = _stage("substring dedup")(spark, table, "")
    assert cut.columns == corpus_pipeline.COLUMNS and Counter((r.doc_id, tuple(WORD.findall(r.text or ""))) for r in cut.collect()) == want
    assert any("\n" in (r.text or "") and r.doc_id == 29 for r in cut.collect())

    packed = _stage("packing")(spark, table, "")
    assert packed.groupBy("sequence_id").agg({"length": "sum"}).agg({"sum(length)": "max"}).first()[0] <= 4096
    assert packed.select("doc_id").distinct().count() == table.select("doc_id").distinct().count()


def test_stages_of_an_empty_table(spark, table):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, table.limit(0), "").count() == 0
