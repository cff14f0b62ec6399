import hashlib
import random
import re

import pytest

from folioflux.llm.decontamination import cut_passages, find_items, op7_contamination, window_blocks

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))


def brute(docs, items, size=10):
    out = []
    for key, text in docs:
        own, hit, found = words(text), set(), set()
        for item, body in items:
            w = words(body)
            wide = min(size, len(w))
            wins = {tuple(w[k : k + wide]) for k in range(len(w) - wide + 1)} if wide else set()
            for k in range(len(own)):
                if tuple(own[k : k + wide]) in wins and wide:
                    hit.update(range(k, k + wide))
                    found.add(str(item))
        out.append((key, len(own), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


ITEMS = [(2, " ".join(f"w{k}" for k in range(14))), (10, "Short ITEM"), (3, ""), (4, None), (5, "a a a a a a a a a a a"), (6, "short item"), (7, "Äé ö-ü 一二 x1"), (None, "null id")]
DOCS = [
    (1, "pre " + " ".join(f"W{k}" for k in range(14)) + " post short, item"),
    (2, None),
    (3, ""),
    (4, "a " * 25),
    (5, " ".join(f"w{k}" for k in range(9)) + " other " + " ".join(f"w{k}" for k in range(4, 14))),
    (5, " ".join(f"w{k}" for k in range(9)) + " other " + " ".join(f"w{k}" for k in range(4, 14))),
    (6, "short"),
    (7, "item"),
    (8, "äé ö ü 一二 x1 Äé ö ü 一二 x1"),
    (None, "short item null id"),
    (9, "z " * 200_000 + "short item"),
]


@pytest.mark.parametrize("per_block", [200_000, 3])
def test_against_brute_force(spark, per_block):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    if per_block == 200_000:
        got = sorted((tuple(r)[:6] for r in op7_contamination(docs, items).collect()), key=repr)
        assert got == brute(DOCS, [i for i in ITEMS if i[0] is not None])
    else:
        got = find_items(docs, items, per_block=per_block).collect()
        want = {(r[0], r[1], r[2], r[3]) for r in brute(DOCS, [i for i in ITEMS if i[0] is not None])}
        assert {(r.doc_id, r.n_words, r.n_hit, len(r["items"])) for r in got} == want


def test_whole_table_against_brute_force(spark):
    base = "/root/testdata/sf0.001"
    docs, items = spark.read.parquet(f"{base}/documents.parquet"), spark.read.parquet(f"{base}/benchmark.parquet")
    got = sorted((tuple(r)[:6] for r in op7_contamination(docs, items).collect()), key=repr)
    want = brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert got == want and any(r[5] for r in got)


def test_empty_tables(spark):
    docs = spark.createDataFrame(DOCS[:3], "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert [r.n_hit for r in op7_contamination(docs, items.limit(0)).collect()] == [0, 0, 0]
    assert op7_contamination(docs.limit(0), items).count() == 0


def near_brute(docs, items, slack, size=10):
    out = []
    for key, text in docs:
        own, found, covered = words(text), set(), set()
        for item, body in items:
            w = words(body)
            wide = min(size, len(w))
            for win in {tuple(w[k : k + wide]) for k in range(len(w) - wide + 1)} if wide else ():
                for p in range(-slack, len(own) + slack):
                    if all(t in own[max(0, p + j - slack) : max(0, p + j + slack + 1)] for j, t in enumerate(win)):
                        found.add(str(item))
                        covered.update(range(max(0, p), min(len(own), p + wide)))
        out.append((key, sorted(found), len(covered)))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("slack", "per_block"), [(1, 200_000), (2, 4)])
def test_proximity_against_brute_force(spark, slack, per_block):
    r = random.Random(slack)
    passage = [f"p{k}" for k in range(16)]
    docs = []
    for key in range(60):
        own = list(passage)
        for _ in range(r.randrange(4)):
            at = r.randrange(len(own))
            own[at : at + r.randrange(2)] = ["odd"] * r.randrange(2) or own[at : at + 2][::-1]
        docs.append((key, " ".join(r.choices(["x", "y", "p3"], k=r.randrange(12)) + own[r.randrange(5) :] + r.choices("xy", k=3))))
    items = [(1, " ".join(passage)), (2, "x y x"), (3, " ".join(passage[2:13]))]
    found = find_items(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string"), slack=slack, per_block=per_block).collect()
    got = sorted(((x.doc_id, x.near_items, sum(b - a for a, b in zip(x.near[::2], x.near[1::2], strict=True))) for x in found), key=repr)
    assert got == near_brute(docs, items, slack)
    assert {(x.doc_id, x.n_words, x.n_hit, len(x["items"])) for x in found} == {k[:4] for k in brute(docs, items)}


def test_cuts_of_many_blocks(spark):
    docs = spark.createDataFrame([(k, t, 1, 2) for k, t in DOCS], "doc_id long, text string, __text int, __cuts int")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    one, many = (sorted(map(tuple, cut_passages(docs, items, per_block=n).collect()), key=repr) for n in (200_000, 3))
    assert one == many and any(t != dict(DOCS).get(k) for k, t, *_ in one)


def test_one_block_is_held_at_a_time(spark):
    windows = spark.createDataFrame([(str(k), f"{k:08d}".encode(), 1) for k in range(5000)], "item_id string, w binary, words int")
    blocks = list(window_blocks(windows, 400))
    assert len(blocks) == 13 and sum(len(b.words) for b in blocks) == 5000 and max(len(b.words) for b in blocks) < 600
