import random
import re
from collections import Counter

import numpy as np
import pytest

from folioflux.llm import jaccard_join as J

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def sets(text, words):
    w = WORD.findall(re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    if not w:
        return frozenset()
    return frozenset(tuple(w[k : k + words]) for k in range(len(w) - words + 1)) if len(w) >= words else frozenset([tuple(w)])


def brute(docs, words, percent):
    own = [sets(t, words) for _, t in docs]
    up = list(range(len(docs)))

    def top(k):
        while up[k] != k:
            k = up[k]
        return k

    index = {}
    for k, s in enumerate(own):
        for x in s:
            index.setdefault(x, []).append(k)
    for a, s in enumerate(own):
        for b, same in Counter(b for x in s for b in index[x] if b > a).items():
            if 100 * same >= percent * (len(s) + len(own[b]) - same):
                up[max(top(a), top(b))] = min(top(a), top(b))
    low = {}
    for k, (key, _) in enumerate(docs):
        low[top(k)] = min(low.get(top(k), key), key)
    return sorted((key, len(own[k]), low[top(k)]) for k, (key, _) in enumerate(docs))


def run(spark, docs, words, percent):
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    return sorted((r.doc_id, r.n_shingles, r.component_id) for r in J.jaccard_classes(df, words, percent).collect())


def corpus(seed):
    r = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(60)]
    docs = [None, "", "  \n", "one", "ONE", "one two", "two one", "one two three"]
    passage = " ".join(r.choice(vocabulary) for _ in range(30))
    for _ in range(40):
        base = [r.choice(vocabulary) for _ in range(r.choice([4, 12, 40, 150]))]
        docs.append(" ".join(base))
        for _ in range(r.randrange(6)):
            near = list(base)
            for _ in range(r.randrange(1 + len(base) // 25)):
                near[r.randrange(len(near))] = r.choice(vocabulary)
            docs.append(" ".join(near))
        if r.random() < 0.4:
            docs.append(" ".join(base[:20]) + " " + passage)
        if r.random() < 0.3:
            docs.append(docs[-1])
    order = list(range(len(docs)))
    r.shuffle(order)
    return [(k, docs[at]) for k, at in enumerate(order)]


@pytest.mark.parametrize(("seed", "words", "percent"), [(1, 3, 90), (2, 5, 80), (3, 2, 70)])
def test_against_brute_force(spark, seed, words, percent):
    docs = corpus(seed)
    assert run(spark, docs, words, percent) == brute(docs, words, percent)


def test_cut_families(spark, monkeypatch):
    monkeypatch.setattr(J, "CELL_SETS", 30)
    monkeypatch.setattr(J, "CELL_SHINGLES", 400)
    monkeypatch.setattr(J, "SENT_IDS", 5)
    monkeypatch.setattr(J, "CHAIN_FROM", 2)
    docs = corpus(4)
    assert run(spark, docs, 3, 80) == brute(docs, 3, 80)


def counted(docs, words, percent):
    own = {k: sets(t, words) for k, t in docs}
    different = {s for s in own.values() if s}
    return {k: sum(a != s and 100 * len(a & s) >= percent * len(a | s) for a in different) for k, s in own.items()}


@pytest.mark.parametrize("cell_sets", [3, 1500])
def test_every_link_is_counted(spark, monkeypatch, cell_sets):
    monkeypatch.setattr(J, "CELL_SETS", cell_sets)
    r, base = random.Random(7), [f"v{k}" for k in range(200)]
    near = [" ".join([*base[:k], f"x{k}", *base[k + 1 :]]) for k in range(2, 198, 2)]
    docs = list(enumerate([*near, near[0], *(t for _, t in corpus(5)), *(" ".join(r.sample(base, 40)) for _ in range(5))]))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.n_links for r in J.jaccard_classes(df, 3, 90).collect()}
    assert got == counted(docs, 3, 90) and got[0] == 97 == got[98]


def test_classes_without_counts(spark, monkeypatch):
    monkeypatch.setattr(J, "CELL_SETS", 3)
    monkeypatch.setattr(J, "CHAIN_FROM", 2)
    docs = corpus(6)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in J.jaccard_classes(df, 3, 80, count_links=False).collect())
    assert got == brute(docs, 3, 80)


def test_whole_table(spark):
    docs = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    assert run(spark, docs, 3, 90) == brute(docs, 3, 90)


def test_nulls_and_repeats(spark):
    docs = [(5, "a b c d"), (5, "a b c d"), (None, "a b c d"), (None, "x y z"), (3, "A B C D"), (9, None), (9, "")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = [(r.doc_id, r.component_id) for r in J.jaccard_classes(df).collect()]
    assert Counter(got) == Counter([(5, 3), (5, 3), (None, 3), (None, None), (3, 3), (9, 9), (9, 9)])
    assert J.jaccard_classes(df.limit(0)).count() == 0
    kept = J.keep_one_each(df.selectExpr("*", "1 as n", "2 as rep")).collect()
    assert Counter((r.doc_id, r.text) for r in kept) == Counter([(3, "A B C D"), (9, None), (9, ""), (None, "x y z")]) and kept[0].n == 1
    assert J.keep_one_each(df.limit(0)).count() == 0


def test_rows_of_one_id_with_different_texts(spark):
    a, b, c = (" ".join(f"{w}{k}" for k in range(40)) for w in "abc")
    docs = [(5, a), (5, b), (5, b), (5, c), (7, a + " x"), (8, b + " y"), (8, "other words here"), (2, c + " z"), (9, c)]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("doc_id", "text", "1 as __text", "2 as __n", "3 as rep").repartition(4)
    got = Counter((r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in J.jaccard_classes(df, 3, 80).collect())
    assert got == Counter([(5, 38, 5, 1), (5, 38, 5, 1), (5, 38, 5, 1), (7, 39, 5, 1), (8, 39, 5, 1), (8, 1, 8, 0), (5, 38, 2, 1), (9, 38, 2, 1), (2, 39, 2, 1)])
    kept = J.keep_one_each(df, 3, 80).collect()
    assert sorted((r.doc_id, r.text) for r in kept) == sorted([(5, a), (5, b), (8, "other words here"), (2, c + " z")])
    assert {(r["__text"], r["__n"], r.rep) for r in kept} == {(1, 2, 3)}


def test_t_occurrence():
    r = random.Random(0)
    for _ in range(300):
        lists = [sorted(r.sample(range(40), r.randrange(25))) for _ in range(r.randrange(1, 12))]
        t = r.randrange(1, 8)
        counts = Counter(x for one in lists for x in one)
        assert J.t_occurrence(lists, t) == sorted(x for x, n in counts.items() if n >= t)


def test_link_threshold_is_exact():
    a = np.arange(95, dtype=np.uint64)
    assert J.linked(a, np.arange(100, dtype=np.uint64), 95)
    assert not J.linked(a, np.arange(101, dtype=np.uint64), 95)


def test_many_ids_are_sent_as_a_bitmap(spark, monkeypatch):
    """Every wanted id passes, whatever its size, and hardly another one does."""
    monkeypatch.setattr(J, "ID_BITS", 1 << 18)
    wanted = [0, -1, 7, 1 << 40, -(1 << 50), *range(5000, 5400)]
    rows = spark.createDataFrame([(k, "x") for k in [*wanted, *range(100_000, 103_000)]], "doc_id long, text string")
    got = J._among(rows, spark.createDataFrame([(k,) for k in wanted], "doc_id long"))
    assert got.columns == ["doc_id", "text"]
    found = [r.doc_id for r in got.collect()]
    assert set(wanted) <= set(found) and len(found) < len(wanted) + 60
    assert J._among(rows, rows.select("doc_id").limit(0)).count() == 0
