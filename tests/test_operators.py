"""Operators on small tables with answers from sequential Python."""

import os
import random
from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioflux.functions.similarity import token_set
from folioflux.operators import dedup, documents, graph, reports, retrieval, rules
from folioflux.plans import graph_queries, table_queries, text_queries
from folioflux.sources import feeds, parsing, sinks
from folioflux.streaming import events


def test_greedy_differs_from_components(spark):
    rows = spark.createDataFrame([(1,), (2,), (3,), (4,)], "seq long")
    pairs = spark.createDataFrame([(1, 2), (2, 3)], "lo long, hi long")
    got = {r.seq: r.kept for r in dedup.greedy_from_pairs(rows, pairs).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4}


@pytest.mark.parametrize("seed, settle", [(0, 0), (1, 0), (2, 30), (3, dedup.SETTLE)])
def test_greedy_rounds_equal_the_loop(spark, seed, settle):
    r = random.Random(seed)
    n = 25
    pairs = {tuple(sorted(r.sample(range(n), 2))) for _ in range(40)}
    kept = {}
    for k in range(n):
        owner = min((lo for lo, hi in pairs if hi == k and kept[lo] == lo), default=k)
        kept[k] = owner
    rows = spark.createDataFrame([(k,) for k in range(n)], "seq long")
    got = {r.seq: r.kept for r in dedup.greedy_from_pairs(rows, spark.createDataFrame(sorted(pairs), "lo long, hi long"), settle).collect()}
    assert got == kept


def test_greedy_settles_long_chains_of_large_ids(spark):
    n, base = 5000, 1 << 60
    rows = spark.range(base, base + n).withColumnRenamed("id", "seq")
    pairs = rows.where(F.col("seq") > base).select((F.col("seq") - 1).alias("lo"), F.col("seq").alias("hi"))
    got = {r.seq: r.kept for r in dedup.greedy_from_pairs(rows, pairs).collect()}
    assert got == {base + k: base + k - k % 2 for k in range(n)}


@pytest.mark.parametrize("settle", [0, dedup.SETTLE])
def test_greedy_exact_by_alternative_keys(spark, settle):
    r = random.Random(9)
    rows = [(k, r.choice([None, *"abcde"]), r.choice([None, *"vwxyz"])) for k in range(40)]
    kept = {}
    for k, a, b in rows:
        kept[k] = min((j for j, c, d in rows[:k] if kept[j] == j and ((a and a == c) or (b and b == d))), default=k)
    df = spark.createDataFrame(rows, "seq long, a string, b string")
    got = {r.seq: r.kept_seq for r in dedup.greedy_exact_dedup(df, "seq", [F.col("a"), F.col("b")], settle).collect()}
    assert got == kept


def test_keyed_dedup_joins_mentions(spark):
    df = spark.createDataFrame([(2, "k", ["b"]), (1, "k", ["a"]), (3, None, ["c"]), (4, None, ["d"])], "seq long, k string, via array<string>")
    got = {(r.seq, tuple(r.via)) for r in dedup.keyed_dedup(df, F.col("k"), "seq", "via").collect()}
    assert got == {(1, ("a", "b")), (3, ("c",)), (4, ("d",))}


def test_fuzzy_needs_title_and_author(spark):
    rows = [(1, "Ocean heat content rises", None, ["A Smith"]), (2, "Ocean heat content rises.", None, ["a smith"]), (3, "Ocean heat content rises", None, ["B Jones"]), (4, "Other", "10.1/x", []), (5, "Unlike", "doi:10.1/X", []), (6, None, None, None)]
    df = spark.createDataFrame(rows, "seq long, title string, doi string, authors array<string>")
    got = {r.seq: r.kept for r in dedup.greedy_fuzzy_dedup(df, "seq", F.col("title"), F.col("doi"), F.col("authors")).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4, 5: 4, 6: 6}
    assert dedup.greedy_fuzzy_dedup(df.limit(0), "seq", F.col("title"), F.col("doi"), F.col("authors")).count() == 0


@pytest.mark.parametrize("settle", [0, dedup.SETTLE])
def test_fuzzy_equals_the_loop(spark, settle):
    r = random.Random(11)
    stems = ["".join(r.choice("abcd ") for _ in range(r.randrange(1, 40))) for _ in range(5)]

    def title():
        t = list(r.choice(stems))
        for _ in range(r.randrange(0, 3)):
            t[r.randrange(len(t))] = r.choice(["", "x", "y "])
        return "".join(t)

    rows = [(k, title(), r.choice([None] * 6 + ["10.1/a", "10.1/b"]), r.sample(["Ann", "BEN", "ben", "Strauß"], r.randrange(0, 3))) for k in range(70)]
    key = lambda t: " ".join(t.lower().split())
    fold = lambda names: {n.casefold() for n in names}
    kept = {}
    for k, t, d, a in rows:
        alike = lambda o: (d and d == o[2]) or (fold(a) & fold(o[3]) and SequenceMatcher(None, key(t), key(o[1])).ratio() >= 0.92)  # noqa: E731, B023
        kept[k] = min((o[0] for o in rows[:k] if kept[o[0]] == o[0] and alike(o)), default=k)
    df = spark.createDataFrame(rows, "seq long, title string, doi string, authors array<string>")
    got = {r.seq: r.kept for r in dedup.greedy_fuzzy_dedup(df, "seq", F.col("title"), F.col("doi"), F.col("authors"), settle=settle).collect()}
    assert got == kept and len(set(kept.values())) < 60


def test_titles_of_an_author_meet_in_cells(spark, monkeypatch):
    r, met, places = random.Random(3), [], dedup.near_places
    monkeypatch.setattr(dedup, "CELL_TITLES", 6)
    monkeypatch.setattr(dedup, "CELL_CHARS", 1 << 15)
    monkeypatch.setattr(dedup, "near_places", lambda *given: met.append(given) or places(*given))
    stem = "".join(r.choice("abcdefgh ") for _ in range(60)).strip()
    titles = sorted({stem[:k] + r.choice("xyz") + stem[k + r.randrange(0, 4) :] for k in r.choices(range(1, 55), k=60)})
    rows = [("ann", t, k, k + r.randrange(0, 3)) for k, t in enumerate(titles)] + [("bob", titles[0], 0, 9)]
    want = {(a, t, u) for a, t, _, hi in rows for b, u, lo, _ in rows if a == b and t != u and lo < hi and SequenceMatcher(None, t, u).ratio() >= 0.92}
    got = dedup._near_titles(spark.createDataFrame(rows, "a string, t string, lo long, hi long"), 0.92).collect()
    assert {tuple(x) for x in got} == want and len(got) == len(want) > 100 and met


def test_artifacts_meet_all_articles(spark):
    r = random.Random(5)
    words = ["".join(r.choice("abcdef") for _ in range(r.randrange(1, 7))) for _ in range(12)]
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    articles = [(k, text(r.randrange(0, 9))) for k in range(150)] + [(200, "the ocean heat content of the north rises"), (201, "")]
    articles += [(300 + k, c[: len(c) // 2] + "f" + c[len(c) // 2 + 1 :]) for k, c in articles[:40]]
    artifacts = [(k, text(r.randrange(0, 9))) for k in range(90)] + [(100, "ocean heat content"), (101, "an ocean heat content of the north rise")]
    want = {}
    for key, a in artifacts:
        for doc_id, c in articles:
            score = SequenceMatcher(None, a, c).ratio()
            score = max(score, 0.95) if a in c or c in a else score
            if a and c and score >= 0.74 and score > want.get(key, (0, 0.0))[1]:
                want[key] = (doc_id, score)
    left, right = spark.createDataFrame(artifacts, "artifact long, a string"), spark.createDataFrame(articles, "doc_id long, c string")
    got = {x.artifact: (x.doc_id, x.score) for x in dedup.best_articles(left, right).collect()}
    assert got == want and got[100] == (200, 0.95)
    assert dedup.best_articles(left.limit(0), right).count() == 0


def test_prior_editions_by_doi_and_ratio(spark):
    rows = [(1, "Rapid loss of the ice sheets observed", None), (2, "A new title", "https://doi.org/10.1/X"), (3, "Warming of the northern oceans", None), (4, "Nothing like it", "10.1/none"), (5, "", None)]
    past = [("Rapid loss of the ice sheets observed.", None, "2026-02", 5.0), ("Rapid loss of all ice sheets observed", None, "2026-01", 9.0), ("Rapid loss of the ice sheets observed", None, "2026-04", 99.0), ("Old title", "doi:10.1/x", "2026-03", None), ("Warming of the southern oceans", None, "2026-03", 1.0), ("", None, "2026-03", 8.0)]
    df, history = spark.createDataFrame(rows, "seq long, title string, doi string"), spark.createDataFrame(past, "title string, doi string, target_month string, score double")
    got = {r.seq: (r.prior_title, r.prior_month, r.prior_confidence) for r in dedup.prior_editions(df, history, "2026-04").collect()}
    want = {}
    for seq, title, doi in rows:
        want[seq] = (None, None, None)
        for old, old_doi, month, score in sorted(past, key=lambda x: (x[3] is None, -(x[3] or 0), x[0])):
            ratio = SequenceMatcher(None, title.lower(), old.lower()).ratio() if title and old else 0.0
            same = bool(doi and old_doi) and doi.lower()[-6:] == old_doi.lower()[-6:]
            if month != "2026-04" and (same or ratio >= 0.88):
                want[seq] = (old, month, "high" if same or ratio >= 0.94 else "medium")
                break
    assert got == want
    assert (got[1][2], got[2], got[4]) == ("medium", ("Old title", "2026-03", "high"), (None, None, None))
    assert dedup.prior_editions(df, history.drop("doi"), "2026-04").where("prior_title is not null").count() == sum(v[0] is not None for v in want.values()) - 1


def test_anchors_meet_all_parts_but_themselves(spark, tmp_path):
    parts = [(50, "T", "blue steel bolt"), (100, "T", "blue steel bolts"), (7, "T", "blue steel rod"), (150, "U", "green nut")]
    spark.createDataFrame(parts, "p_partkey long, p_type string, p_name string").write.parquet(f"{tmp_path}/part.parquet")
    assert {r.new_id: r.node_id for r in graph_queries.anchor_best_match(spark, str(tmp_path)).collect()} == {50: 100, 100: 50}


def test_anchors_of_one_name_cost_no_pairs(spark):
    r = random.Random(7)
    words = ["steel", "blue", "bolt", "bolts", "rod"]
    rows = [(k, r.choice("TU"), [" ".join(r.choice(words) for _ in range(r.randrange(0, 4)))]) for k in range(160)]
    want = {}
    for k, t, (f,) in rows[::3]:
        scores = [(-token_set(f, g) / 100.0, o) for o, u, (g,) in rows if u == t and o != k]
        score, o = min(scores)
        if -score >= 0.78:
            want[k] = (o, -score)
    df = spark.createDataFrame(rows, "id long, b string, forms array<string>")
    got = dedup.best_match(df.where("id % 3 = 0").withColumnRenamed("id", "l"), df.withColumnRenamed("id", "r"), "b", 0.78, "l", "r")
    assert {x.l: (x.r, x.score) for x in got.collect()} == want


def test_keys_hold_whole_texts(spark, tmp_path):
    opening = "The same opening of more than forty characters, "
    docs = [(1, opening + "then one"), (2, opening + "then two"), (3, opening + " then\tone"), (4, opening.upper() + "THEN ONE")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.kept_seq for r in table_queries.greedy_exact_dedup(spark, str(tmp_path)).collect()}
    assert got == {1: 1, 2: 2, 3: 1, 4: 1}


def test_entities_grow_by_merges(spark):
    rows = [("t:gpt-4", "Tech", 1, "GPT-4", [], True), ("t:gpt4", "Tech", 2, "GPT 4", ["g four"], False), ("t:g", "Tech", 3, "G Four", [], False), ("o:gpt", "Org", 4, "GPT-4", [], False), ("t:gpt-4", "Tech", 5, "whatever", [], False)]
    df = spark.createDataFrame(rows, "id string, type string, seq long, name string, aliases array<string>, known boolean")
    got = {(r.id, r.outcome, r.target) for r in dedup.resolve_entities(df).collect()}
    assert got == {("t:gpt-4", "known", "t:gpt-4"), ("t:gpt4", "merge", "t:gpt-4"), ("t:g", "merge", "t:gpt-4"), ("o:gpt", "create", "o:gpt"), ("t:gpt-4", "merge", "t:gpt-4")}


def test_entities_without_a_common_word(spark):
    rows = [("a", "T", 1, "modeling", True, [1.0, 0.0]), ("b", "T", 2, "modelling", False, [0.0, 1.0]), ("c", "T", 3, "behaviour", False, None), ("d", "T", 4, "behavior", False, None), ("e", "T", 5, "reinforcement learning", False, [0.6, 0.8]), ("f", "T", 6, "RL", False, [0.61, 0.79]), ("g", "T", 7, "xyzzy", False, [-1.0, 0.0])]
    df = spark.createDataFrame(rows, "id string, type string, seq long, name string, known boolean, vector array<double>").withColumn("aliases", F.array().cast("array<string>"))
    got = {r.id: (r.outcome, r.target) for r in dedup.resolve_entities(df).collect()}
    assert got == {"a": ("known", "a"), "b": ("merge", "a"), "c": ("create", "c"), "d": ("merge", "c"), "e": ("create", "e"), "f": ("merge", "e"), "g": ("create", "g")}
    bare = {r.id: (r.outcome, r.target) for r in dedup.resolve_entities(df.drop("vector")).collect()}
    assert bare == got | {"f": ("create", "f")}


def test_entities_equal_the_scan_of_all_nodes(spark):
    r = random.Random(3)
    words = ["".join(r.choice("abcde") for _ in range(r.randrange(1, 7))) for _ in range(25)]
    rows = [(f"n{k}", "T", k, " ".join(r.choice(words) for _ in range(r.randrange(0, 4))), [r.choice(words)] if r.random() < 0.3 else [], k % 5 == 0) for k in range(120)]
    nodes, want = [], {}
    for key, _, _, name, aliases, known in sorted(rows, key=lambda x: (not x[5], x[2])):
        forms, best, top = [f for f in dict.fromkeys([name, *aliases]) if f], -1, 0.0
        for k, (_, others) in enumerate(nodes if not known else []):
            score = max((token_set(f, g) for f in forms for g in others), default=0.0) / 100.0
            if score > top:
                best, top = k, score
        if top >= 0.92:
            nodes[best][1].extend(forms)
            want[key] = ("merge", nodes[best][0], top)
        else:
            nodes.append((key, list(forms)))
            want[key] = ("known" if known else "review" if top >= 0.78 else "create", nodes[best][0] if top >= 0.78 else key, top)
    df = spark.createDataFrame(rows, "id string, type string, seq long, name string, aliases array<string>, known boolean")
    assert {r.id: (r.outcome, r.target, r.score) for r in dedup.resolve_entities(df).collect()} == want


def test_entities_score_a_name_once(spark, monkeypatch):
    """Rows whose names and nodes are known cost a look-up, not a score of each node."""
    rows = [(f"n{k}", "T", k, ["red bolt", "blue rod", "old gear"][k % 3], [], k % 10 == 0) for k in range(300)]
    df = spark.createDataFrame(rows, "id string, type string, seq long, name string, aliases array<string>, known boolean")
    got = {(r.outcome, r.target) for r in dedup.resolve_entities(df).collect() if r.outcome != "known"}
    assert got == {("merge", "n0"), ("merge", "n10"), ("merge", "n20")}
    scored, score = [], dedup._best_score
    monkeypatch.setattr(dedup, "_best_score", lambda f, g: scored.append(1) or score(f, g))
    one = dedup._Resolver(0, 0.92, 0.78)
    for r in df.collect():
        one.resolve(r, None)
    assert len(scored) <= 9


def test_bridge_needs_both_directions(spark):
    edges = spark.createDataFrame([("a", "supports", "idea", 0.9), ("b", "supports", "idea", 0.5), ("a", "x", "idea", 0.2)], "src string, rel string, dst string, confidence double")
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id string")
    (path,) = graph.simple_paths(edges, ids("a"), ids("b"), 2).collect()
    assert path.path == ["a", "idea", "b"] and path.confidences == [0.9, 0.5]
    assert graph.simple_paths(edges, ids("a"), ids("b"), 1).count() == 0
    with pytest.raises(ValueError):
        graph.simple_paths(edges, ids("a"), ids("b"), 0)
    nodes = spark.createDataFrame([("a", "Grant"), ("b", "Grant"), ("idea", "Idea")], "id string, type string")
    (best,) = graph.connect(nodes, edges, ids("a"), ids("b")).collect()
    assert best.kind == "shared-idea" and best.strength == pytest.approx(0.45 / 2 + 0.3 * 0.7 + 0.15)


def test_alias_chains_and_cycles(spark):
    rows = [(f"n{k}", f"n{k + 1}") for k in range(16)] + [("p", "q"), ("q", "p"), ("s", "s")]
    got = {r.alias: r.canonical for r in graph.alias_closure(spark.createDataFrame(rows, "alias string, target string")).collect()}
    assert got["n0"] == "n16" and got["n15"] == "n16" and {got["p"], got["q"]} <= {"p", "q"} and "s" not in got


def test_node_and_edge_merge(spark):
    rows = [("n", "T", "Name", ["x"], 1), ("n", "T", "Other", ["x", "y"], 2), ("n", "T", "", [], 3)]
    (node,) = graph.merge_nodes(spark.createDataFrame(rows, "id string, type string, name string, aliases array<string>, seq long")).collect()
    assert (node.name, node.aliases) == ("Name", ["x", "Other", "y"])
    rows = [("a", "r", "b", 0.4, "q1", 1), ("a", "r", "b", 0.9, None, 2), ("a", "r", "b", 0.6, "q2", 3)]
    (edge,) = graph.merge_edges(spark.createDataFrame(rows, "src string, rel string, dst string, confidence double, quote string, seq long")).collect()
    assert (edge.confidence, edge.quote) == (0.9, "q1")
    rows = [("a", "r", "b", 0.5, None, 1), ("a", "r", "b", 0.4, "q1", 2), ("a", "r", "b", 0.6, "q2", 3), ("a", "r", "b", 0.6, "q3", 4)]
    (edge,) = graph.merge_edges(spark.createDataFrame(rows, "src string, rel string, dst string, confidence double, quote string, seq long")).collect()
    assert (edge.confidence, edge.quote) == (0.6, "q2")


def test_orientation_and_validation(spark):
    e = spark.createDataFrame([("p:1", "funds", "o:1", "Project", "Org"), ("o:2", "funds", "p:2", "Org", "Project")], "src string, rel string, dst string, src_type string, dst_type string")
    got = {(r.src, r.dst) for r in graph.orient(e, [("funds", "Org", "Project")]).collect()}
    assert got == {("o:1", "p:1"), ("o:2", "p:2")}
    nodes = spark.createDataFrame([("o:1",), ("p:1",)], "id string")
    edges = spark.createDataFrame([("o:1", "odd", "p:1"), ("o:1", "funds", "zz"), ("o:1", "funds", "o:1")], "src string, rel string, dst string")
    assert [(r.src, r.rel, r.dst) for r in graph.valid_relations(edges, ["funds"], nodes).collect()] == [("o:1", "mentions", "p:1")]


def test_buckets_of_one_table_take_one_pass(spark, tmp_path):
    rows = spark.createDataFrame([(1, "b"), (2, "a"), (3, "z"), (4, None), (5, "b")], "id long, bucket string")
    got = reports.with_place(rows, ["a", "b"])
    assert {(r.id, r.bucket, r.bucket_ord) for r in got.collect()} == {(1, "b", 1), (2, "a", 0), (5, "b", 1)}
    spark.createDataFrame([(1, "x", "en", "s")], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    plan = text_queries.review_rows_union(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan parquet") == 1


def test_indexes_are_made_where_the_texts_are(spark):
    docs = spark.createDataFrame([(1, "To be, or not to BE"), (2, ""), (3, None), (1, "be")], "doc_id long, text string")
    got = documents.inverted_indexes(docs, "doc_id", "text")
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.doc_id, r.x) for r in got.where("doc_id < 3").select("doc_id", documents.rebuilt_text(F.col("index")).alias("x")).collect()) == [(1, "be"), (1, "to be or not to be"), (2, "")]
    assert got.where("doc_id = 3 and index is null").count() == 1


def test_references_alone_go_to_python(spark):
    import html

    from folioflux.functions import similarity

    texts = ["", "a", "&", "&&amp;&", "&lt;b&gt;&", "&#65;&#x41&#0;&#xD800; &notit; &ampx &nosuch; &eacute", "&amp;lt;", "x&copy y&#38", "&;&#;&#x;", "é&nbsp;\t&\n&quot", "&" + "a" * 50 + ";"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate([*texts, None])], "k long, t string")
    out = df.select("k", similarity.unescape_html(F.col("t")).alias("u"))
    assert {r.k: r.u for r in out.collect()} == dict(enumerate([*map(html.unescape, texts), None]))
    assert "_resolved(regexp_extract_all(" in out._jdf.queryExecution().optimizedPlan().toString()


def test_bm25_keeps_hits_with_low_scores(spark):
    docs = spark.createDataFrame([(1, "cat dog"), (2, "cat bird"), (3, "fish")], "doc_id long, text string")
    queries = spark.createDataFrame([(7, "Cat CAT"), (8, "nothing")], "query_id long, query string")
    got = retrieval.bm25(docs, queries).collect()
    assert sorted((r.query_id, r.doc_id) for r in got) == [(7, 1), (7, 2)]


def test_best_texts_equal_the_join(spark, monkeypatch):
    """Texts are scored in blocks of queries and texts: no row of a query and a text is moved."""
    monkeypatch.setattr(retrieval, "TEXT_QUERIES", 2)
    monkeypatch.setattr(retrieval, "TEXTS", 3)
    r = random.Random(2)
    words = [*"abcdefgh", "the"]
    docs = spark.createDataFrame([(k, " ".join(r.choice(words) for _ in range(r.randrange(0, 9)))) for k in range(40)] + [(40, None), (41, ""), (7, "the A b")], "doc_id long, text string").repartition(3)
    asked = spark.createDataFrame([(f"q{k}", " ".join(r.choice([*words, "zz"]) for _ in range(r.randrange(0, 5)))) for k in range(7)], "query_id string, query string")
    ranked = retrieval.top_k(retrieval.bm25(docs, asked), ["query_id"], 4, "doc_id")
    want = {(x.query_id, x.doc_id, x.score, x["rank"]) for x in ranked.collect()}
    got = retrieval.bm25(docs, asked, k=4)
    assert {(x.query_id, x.doc_id, x.score, x["rank"]) for x in got.collect()} == want and len(want) > 15
    assert retrieval.bm25(docs.limit(0), asked, k=4).count() == 0 == retrieval.bm25(docs, asked.limit(0), k=4).count()


def test_fusion_prefers_shared_items(spark):
    leg = lambda items: spark.createDataFrame([(0, i, n) for n, i in enumerate(items)], "query_id long, item long, rank long")
    out = retrieval.fuse([leg([1, 2, 3]), leg([3, 4])], ["query_id"], "item", k=2).orderBy(F.desc("rrf")).collect()
    assert [r.item for r in out] == [3, 1]


@pytest.mark.parametrize("seed", range(4))
def test_chunks_lose_nothing(spark, seed):
    r = random.Random(seed)
    text = "".join(r.choice("ab \n") for _ in range(500))
    spans = list(documents.windows(text, 40, 10))
    assert spans[0][0] == 0 and spans[-1][1] == len(text)
    assert all(b[0] <= a[1] for a, b in zip(spans[:-1], spans[1:], strict=True))
    df = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")
    for c in documents.chunks(df, "doc_id", "text", 40, 10).collect():
        assert text[c.lo : c.hi] == c.chunk == c.chunk.strip()


def test_sections_keep_their_spans(spark):
    text = "intro text\n\n# First *x*\nbody one\n\nUnderlined\n---\nmore\n\n2.1 Numbered part\nthe end\n\nLOUD TITLE\nlast  "
    df = spark.createDataFrame([(1, text), (2, "no heading"), (3, "  \n ")], "doc_id long, text string")
    rows = sorted(documents.sections(df, "doc_id", "text").collect(), key=lambda r: (r.doc_id, r.lo))
    assert [r.title for r in rows if r.doc_id == 1] == ["Front matter", "First *x*", "Underlined", "2.1 Numbered part", "LOUD TITLE"]
    assert all(text[r.lo : r.hi] == r.body for r in rows if r.doc_id == 1)
    assert [(r.title, r.body) for r in rows if r.doc_id == 2] == [("body", "no heading")] and not [r for r in rows if r.doc_id == 3]


def test_pages_to_text(spark):
    html = "<html><head><title>A &amp; B</title></head><body><h2>Top</h2><p>One<br>two</p><script>x<1</script><div>three</div></body></html>"
    row = spark.createDataFrame([(html,)], "h string").select(documents.page_title(F.col("h")).alias("t"), documents.page_text(F.col("h")).alias("x")).first()
    assert row.t == "A & B" and row.x == "## Top\nOne\ntwo\n\nthree"


LEX = rules.Lexicons(lists={"climate": ["climate", "ice"], "finding": ["shows"], "direct_lens": ["climate change"], "paleo": ["ancient"], "contemporary": ["today"], "tool_performance": ["benchmark"]}, domains=[("ice", ["ice"]), ("heat", ["warming"])], fallback_topics=[("any", ["climate"])])


@pytest.mark.parametrize(
    ("abstract", "venue_type", "bucket", "reason"),
    [
        ("Climate change shows ice loss", "journal", "evaluated", "evidence_fit_in_target_month"),
        ("Ancient climate change shows ice loss", "journal", "excluded", "hard_exclusion"),
        ("Climate shows ice", "journal", "manual_review", "indirect_or_incidental_climate_lens"),
        ("Climate change benchmark shows ice", "journal", "manual_review", "method_or_tool_performance_focus"),
        ("Climate change ice", "journal", "manual_review", "substantive_climate_finding_unclear"),
        ("rice prices", "journal", "excluded", "hard_exclusion"),
        ("anything", "preprint", "preprint", "preprint_separate_bucket"),
        ("Climate change shows ice loss", "blog", "excluded", "hard_exclusion"),
    ],
)
def test_rule_engine(spark, abstract, venue_type, bucket, reason):
    df = spark.createDataFrame([("A title", abstract, "Venue", venue_type)], "title string, abstract string, venue string, venue_type string")
    row = rules.assess(df, LEX, ["journal"]).first()
    assert (row.bucket, row.routing_reason) == (bucket, reason)


def test_scores_are_capped_and_absence_costs_nothing(spark):
    dims = [rules.Dimension("impact", list("abcdefg"), baseline=1, weight=2.0), rules.Dimension("audience", ["zz"], weight=3.0)]
    df = rules.fit_texts(spark.createDataFrame([("t", "a b c d e f g", None), ("t", "q", None)], "title string, abstract string, venue string")).withColumn("tags", F.array(F.lit("x")))
    got = [(r.score_impact, r.composite_score, r.theme) for r in rules.score(df, dims).collect()]
    assert got == [(5, 10.0, "x"), (1, 2.0, "x")]
    assert rules.focus_domains("about WARMING!", LEX) == ["heat"]


def test_verification_order(spark):
    base = {"title": "t", "doi": None, "venue": None, "url": None, "venue_type": "journal", "work_type": None, "record_type": None, "date": "2026-04-10", "date_field": "published-online", "abstract": "a"}
    cases = [({}, "survivor", None), ({"record_type": "dataset"}, "excluded", "non_primary_research_object"), ({"work_type": "journal_level_record"}, "excluded", "journal_level_record"), ({"venue_type": "popular_press", "date": None}, "manual_review", "popular_press_primary_unresolved"), ({"date_field": "indexed"}, "manual_review", "date_not_verified"), ({"date": "2026-03-31"}, "excluded", "outside_target_month"), ({"abstract": None}, "manual_review", "title_only_abstract_missing"), ({"title": "Code on zenodo"}, "excluded", "non_primary_research_object")]
    schema = ", ".join(f"{k} string" for k in base)
    for change, bucket, reason in cases:
        df = spark.createDataFrame([tuple((base | change).values())], schema)
        row = rules.verify(df, "2026-04", ["published-online"], ["dataset"], ["zenodo"]).first()
        assert (row.bucket, row.routing_reason) == (bucket, reason), change


def test_reports(spark):
    rows = spark.createDataFrame([(1, "s1", "candidate"), (1, "s1", "candidate"), (1, "s2", "candidate"), (2, None, "excluded")], "candidate_id long, source string, bucket string")
    got = {r.source: (r.candidate, r.excluded, r.total) for r in reports.source_pivot(rows, spark.createDataFrame([("s1",), ("quiet",)], "source string")).collect()}
    assert got == {"s1": (1, 0, 1), "s2": (1, 0, 1), "unattributed": (0, 1, 1), "quiet": (0, 0, 0)}
    assert reports.ordered_union(["b query", "A"], ["a", "B  Query", "c"]) == ["b query", "A", "c"]
    ranked = reports.ranked(spark.createDataFrame([(k, None if k == 3 else float(k % 2)) for k in range(6)], "seq long, s double"), "s", "seq")
    assert [r.seq for r in ranked.orderBy("rank").collect()] == [1, 5, 0, 2, 3, 4]


def _write(path, text):
    path.write_text(text)
    return str(path)


def test_feeds(spark, tmp_path):
    works = _write(tmp_path / "w.json", '{"results": [{"title": " A  study ", "doi": "https://doi.org/10.1/A", "publication_date": "2026-04-02", "authorships": [{"author": {"display_name": "N M"}}], "open_access": {"is_oa": true}, "abstract_inverted_index": {"ice": [1], "The": [0], "melts": [2]}}, {"title": ""}]}')
    (w,) = feeds.read_works(spark, works).collect()
    assert (w.title, w.doi, w.abstract, w.authors, w.open_access) == ("A study", "10.1/a", "The ice melts", ["N M"], True)
    registry = _write(tmp_path / "c.json", '{"message": {"items": [{"DOI": "10.2/B", "title": ["T"], "author": [{"given": "G", "family": "F"}], "published-print": {"date-parts": [[2026, 4]]}, "abstract": "<jats:p>x  y</jats:p>"}]}}')
    (c,) = feeds.read_registry(spark, registry).collect()
    assert (c.date, c.date_field, c.abstract, c.authors) == ("2026-04-01", "published-print", "x y", ["G F"])
    scholar = _write(tmp_path / "s.json", '{"data": [{"title": "In", "publicationDate": "2026-04-01"}, {"title": "Out", "publicationDate": "2020-01-01"}, {"title": "Undated"}]}')
    assert {r.title for r in feeds.read_scholar(spark, scholar, "2026-03-01", "2026-04-30").collect()} == {"In", "Undated"}
    rss = _write(tmp_path / "r.xml", "<rss><channel><item><title>News</title><link>http://x/1</link><pubDate>Tue, 3 Mar 2026 10:00:00 GMT</pubDate><description>d</description></item><item><title></title></item></channel></rss>")
    (n,) = feeds.read_feed(spark, rss).collect()
    assert (n.title, n.url, n.date) == ("News", "http://x/1", "2026-03-03")
    oai = _write(tmp_path / "o.xml", '<r xmlns:dc="d"><record><header><datestamp>2026-04-05</datestamp></header><metadata><dc><dc:title>H</dc:title><dc:date>2020-01-01</dc:date><dc:identifier>doi:10.12345/q</dc:identifier><dc:identifier>http://y/2</dc:identifier></dc></metadata></record><record><header/><metadata><dc><dc:title>No date</dc:title></dc></metadata></record></r>')
    (h,) = feeds.read_harvest(spark, oai, "2026-03-01", "2026-04-30").collect()
    assert (h.title, h.doi, h.url, h.date) == ("H", "10.12345/q", "http://y/2", "2026-04-05")
    both = feeds.union_legs([feeds.read_works(spark, works), feeds.read_registry(spark, registry)], 10)
    assert {r.doi for r in both.collect()} == {"10.1/a", "10.2/b"}


def test_stores(spark, tmp_path):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    new = spark.createDataFrame([(2, "B"), (3, "C")], "k long, v string")
    got = sinks.upsert(old, new, ["k"])
    assert sorted(map(tuple, got.collect())) == [(1, "a"), (2, "B"), (3, "C")]
    path = str(tmp_path / "t")
    sinks.swap_in(got, path)
    sinks.swap_in(sinks.read_table(spark, path).where("k < 3"), path)
    assert sinks.read_table(spark, path).count() == 2
    os.mkdir(f"{path}/v000000000002")  # a writer that died before it finished
    assert sinks.read_table(spark, path).count() == 2
    sinks.swap_in(new, path)
    assert sinks.read_table(spark, path).count() == 2 and len(sinks.versions(spark, path)) == 2
    assert sinks.read_table(spark, str(tmp_path / "none"), "k long").count() == 0
    nodes = spark.createDataFrame([("n", "T", "N", ["x"])], "id string, type string, name string, aliases array<string>")
    edges = spark.createDataFrame([("n", "r", "m", 0.5, None)], "src string, rel string, dst string, confidence double, quote string")
    graph_path = str(tmp_path / "g")
    sinks.save_graph(nodes, edges, graph_path)
    n, e = feeds.read_graph(spark, graph_path)
    assert n.count() == 1 and e.first().confidence == 0.5
    with pytest.raises(ValueError):
        sinks.save_graph(nodes.limit(0), edges, graph_path)


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    batch = events.tumbling(rows.withColumn("ts", F.col("ts").cast("timestamp")), "1 day", ["event_type"])
    live = events.run_available(events.tumbling(events.read_events(spark, "/root/testdata/sf0.001"), "1 day", ["event_type"]), "t1")
    assert sorted(map(tuple, batch.collect())) == sorted(map(tuple, live.collect()))
    target = str(tmp_path / "latest")
    events.upsert_stream(events.read_events(spark, "/root/testdata/sf0.001"), target, ["user_id"], str(tmp_path / "cp"))
    assert sinks.read_table(spark, target).count() == rows.select("user_id").distinct().count()


def test_bundles_expire(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", 2.0)], "ord int, line string, k double")
    folder = str(tmp_path / "runs")
    for run_id, made in (("r1", "2024-01-01T00:00:00"), ("r2", "2024-03-01T00:00:00")):
        out = sinks.write_bundle({"report.md": rows, "rows.json": rows.drop("line"), "rows.csv": rows}, folder, run_id, "2024-01", made)
        assert [a["name"] for a in out["artifacts"]] == ["report.md", "rows.csv", "rows.json"]
    os.mkdir(f"{folder}/r3")
    assert sinks.prune_expired(spark, folder, "2024-02-15") == ["r1"]
    assert sorted(os.listdir(folder)) == ["r2", "r3"]
    assert sinks.prune_expired(spark, str(tmp_path / "none"), "2024-02-15") == []
    with pytest.raises(ValueError):
        sinks.write_bundle({"a": rows}, folder, "../x", "2024-01", "2024-01-01T00:00:00")


def test_parsers_by_extension(spark, tmp_path):
    (tmp_path / "Sub").mkdir()
    for name, body in {"a.md": "Lead\n====\nx", "Sub/b.html": "<head><title>T</title></head><p>x &amp; y</p>", "c": "", "2024-05-06 d.txt": "long " * 60}.items():
        (tmp_path / name).write_text(body)
    got = {r.source_slug: r for r in parsing.parse(parsing.read_files(spark, str(tmp_path))).collect()}
    assert got["a"].title == "Lead" and got["b"].markdown == "x & y"
    assert set(got) == {"a", "b", "2024-05-06-d"} and str(got["2024-05-06-d"].date) == "2024-05-06"
    parsing.register("md", lambda rows: parsing.parse_text(rows).withColumn("title", F.lit("other")), "mine")
    rows = spark.createDataFrame([("/x.md", "# H"), ("/y.md", None)], "path string, content string")
    assert {r.title for r in parsing.parse(rows).collect()} == {"other"}
    assert {r.title for r in parsing.parse(rows, prefer="parse_markdown").collect()} == {"H", "y"}
    parsing._PARSERS["md"].pop("mine")


def test_longer_walks(spark):
    chain = spark.createDataFrame([(f"n{k}", "r", f"n{k + 1}", 0.5) for k in range(7)], "src string, rel string, dst string, confidence double")
    one = lambda x: spark.createDataFrame([(x,)], "id string")
    assert [r.hops for r in graph.simple_paths(chain, one("n0"), one("n6"), 6).collect()] == [6]
    assert {r.id: r.depth for r in graph.bfs(chain, one("n0"), 6).collect()} == {f"n{k}": k for k in range(7)}


def test_paths_of_a_pair_and_their_evidence(spark):
    edges = spark.createDataFrame([("a", "r", "b", "s1", "q" * 130 + "1"), ("c", "r", "b", "s1", "q" * 130 + "2"), ("b", "t", "c", "s2", None), ("a", "r", "c", None, "x")], "src string, rel string, dst string, source_slug string, quote string")
    paths = spark.createDataFrame([("a", "c", ["a", "b", "c"], 0.5, 2, 0), ("a", "c", ["a", "c"], 0.5, 1, 0), ("a", "c", ["a", "d", "c"], 0.9, 2, 0)], "start string, end string, path array<string>, strength double, hops int, hub_cost int")
    got = [r.path for r in graph.ranked_paths(paths, k=2).orderBy("rank").collect()]
    assert got == [["a", "d", "c"], ["a", "c"]]
    found = {(r.path_key, r.hop, r.source_slug) for r in graph.edge_evidence(paths, edges).collect()}
    assert found == {("a>b>c", 0, "s1"), ("a>b>c", 1, "s2")}


def test_nearest_vectors_in_blocks(spark, monkeypatch):
    from folioflux.operators import retrieval

    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 2)
    r = random.Random(3)
    rows = [(k, [r.gauss(0, 1) for _ in range(4)], k % 2) for k in range(40)] + [(40, None, 0), (41, [0.0] * 4, 1), (42, [1.0, 2.0], 0)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>, side int").repartition(3)
    asked = vectors.where("vec_id % 9 = 0").selectExpr("vec_id as query_id", "embedding as vector", "side")
    unit = lambda v: np.zeros(4) if v is None or len(v) != 4 else np.array(v) / (np.linalg.norm(v) or 1)
    for apart in (None, "side"):
        got = {}
        for x in retrieval.vector_search(vectors, asked, 3, apart=apart).orderBy("query_id", "rank").collect():
            got.setdefault(x.query_id, []).append((x.vec_id, x.score))
        for q in range(0, 43, 9):
            own = sorted(((-round(float(unit(rows[q][1]) @ unit(v)), 6), k) for k, v, side in rows if not apart or side != rows[q][2]))[:3]
            assert got[q] == [(k, -s + 0.0) for s, k in own]


def test_scores_of_vectors_are_bounded(spark, monkeypatch):
    """No more than VECTOR_BLOCK vectors meet the queries at a time, however long a batch."""
    monkeypatch.setattr(retrieval, "VECTOR_BLOCK", 7)
    sizes, units = [], retrieval._units
    monkeypatch.setattr(retrieval, "_units", lambda rows, dim: sizes.append(len(rows)) or units(rows, dim))
    r = random.Random(9)
    import pandas as pd

    frame = pd.DataFrame({"vec_id": range(40), "v": [np.array([r.gauss(0, 1) for _ in range(3)]) for _ in range(40)]})
    q = type("Q", (), {"query_id": 1, "v": [1.0, 0.0, 0.0]})
    (got,) = retrieval._nearest([q], 5, False)(iter([frame]))
    whole = sorted((-round(float(v[0] / np.linalg.norm(v)), 6), k) for k, v in enumerate(frame["v"]))[:5]
    assert list(got["vec_id"]) == [k for _, k in whole] and max(sizes) == 7
