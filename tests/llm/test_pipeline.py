import re

import corpus_pipeline as P
from folioflux.llm.decontamination import cut_passages

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
BASE = "/root/testdata/sf0.001"


def test_cut_passages(spark):
    passage = " ".join(f"w{k}" for k in range(12))
    docs = spark.createDataFrame([(1, f"Before {passage.upper()}, after.", 7), (2, None, 7), (3, "clean é text", 7), (4, passage, 7)], "doc_id long, text string, covered int")
    items = spark.createDataFrame([(1, passage)], "item_id long, text string")
    got = {r.doc_id: (r.text, r.covered) for r in cut_passages(docs, items).collect()}
    assert got == {1: ("Before , after.", 7), 2: (None, 7), 3: ("clean é text", 7), 4: ("", 7)}
    assert cut_passages(docs, items.limit(0)).count() == 4


def test_stages_on_the_table(spark):
    docs = spark.read.parquet(f"{BASE}/documents.parquet")
    columns, rows = docs.columns, [docs.count()]
    for name, stage in P.STAGES[:-1]:
        before = {(r.doc_id, r.text) for r in docs.collect()}
        docs = spark.createDataFrame(stage(spark, docs, BASE).collect(), docs.schema)
        assert docs.columns == columns
        after = {(r.doc_id, r.text) for r in docs.collect()}
        assert {k for k, _ in after} <= {k for k, _ in before}
        if name == "decontamination":
            assert len(after) == len(before) and after != before
        else:
            assert after <= before
        rows.append(len(after))
    assert rows[0] > rows[1] > rows[2] > rows[3] == rows[4] > 0
    pieces = P.STAGES[-1][1](spark, docs, BASE)
    assert {r.doc_id for r in pieces.collect()} == {r.doc_id for r in docs.collect()}


def test_empty_table_and_odd_columns(spark):
    docs = spark.createDataFrame([(1, "some clean words here", "x", 5, None), (None, None, None, None, 3.0)], "doc_id long, text string, score string, n_chars long, n double")
    for name, stage in P.STAGES[:-1]:
        for rows in (docs, docs.limit(0)):
            assert stage(spark, rows, BASE).columns == docs.columns, name
        assert stage(spark, docs.limit(0), BASE).count() == 0
    assert P.STAGES[-1][1](spark, docs, BASE).count() >= 2
