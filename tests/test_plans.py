from pyspark.sql import functions as F

from folioflux.cli import main
from folioflux.operators import rules
from folioflux.plans import knowledge, monthly

LEX = rules.Lexicons(lists={"climate": ["climate"], "finding": ["shows"], "direct_lens": ["climate change"], "solutions": ["battery"]}, domains=[("ice", ["ice sheet"]), ("heat", ["warming"])])
DIMS = [rules.Dimension("impact", ["global", "billion"], baseline=1, weight=2.0)]
SCHEMA = "seq long, title string, doi string, url string, authors array<string>, venue string, venue_type string, work_type string, record_type string, date string, date_field string, abstract string, source string"


def row(seq, title, abstract, **more):
    base = {"doi": None, "url": None, "authors": ["A B"], "venue": "V", "venue_type": "journal", "work_type": None, "record_type": None, "date": "2026-04-03", "date_field": "published-online", "source": "s1"} | more
    return (seq, title, base["doi"], base["url"], base["authors"], base["venue"], base["venue_type"], base["work_type"], base["record_type"], base["date"], base["date_field"], abstract, base["source"])


def test_monthly_run(spark):
    good = "Climate change shows ice sheet loss."
    rows = [
        row(1, "Ice sheet loss observed", good), row(2, "Ice sheet loss observed.", good), row(3, "Global warming of a billion things", "Climate change shows warming, global and billion scale."),
        row(4, "Battery", "Climate change shows battery warming."), row(5, "Old", good, date="2025-01-01"), row(6, "No abstract", None), row(7, "Press", good, venue_type="popular_press"),
        row(8, "Press with DOI", good, venue_type="popular_press", url="https://x/10.1234/abc"), row(9, "Preprint", good, venue_type="preprint"),
    ]
    history = spark.createDataFrame([("ice sheet  LOSS observed", "2026-03", 7.0), ("Ice sheet loss observed", "2026-04", 9.0)], "title string, target_month string, score double")
    config = monthly.RunConfig("2026-04", LEX, DIMS, ["journal"])
    got = monthly.monthly_run(spark.createDataFrame(rows, SCHEMA), config, history).checkpoint()
    by = {r.seq: r for r in got.collect()}
    assert {k: (r.bucket, r.routing_reason) for k, r in by.items()} == {
        1: ("evaluated", "evidence_fit_in_target_month"), 2: ("excluded", "duplicate"), 3: ("evaluated", "evidence_fit_in_target_month"), 4: ("excluded", "hard_exclusion"), 5: ("excluded", "outside_target_month"),
        6: ("manual_review", "title_only_abstract_missing"), 7: ("manual_review", "popular_press_primary_unresolved"), 8: ("evaluated", "evidence_fit_in_target_month"), 9: ("preprint", "preprint_separate_bucket"),
    }
    assert (by[3].rank, by[3].composite_score, by[1].prior_month, by[3].prior_month) == (1, 6.0, "2026-03", None)
    out = monthly.run_reports(got, spark.createDataFrame([("s1",), ("s2",)], "source string"))
    assert out["summary"].first().total == 9 and out["sources"].count() == 2 and out["review"].count() == 9
    assert {r.theme for r in out["clusters"].collect()} == {"ice", "heat"}


def test_knowledge_base(spark):
    text = "# Alpha Model\nThe Alpha Model beats Beta Tool in tests. " + "It works well. " * 120 + "\n\n# End\nGamma Thing closes."
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    sections, chunks = knowledge.parse(docs)
    assert sections.count() == 2 and all(text[c.lo : c.hi] == c.chunk for c in chunks.collect())
    queries = spark.createDataFrame([(1, "gamma closes")], "query_id long, query string")
    top = knowledge.hybrid_search(chunks, queries, None, None, 1).first()
    assert chunks.where(F.col("chunk_id") == top.doc_id).first().chunk.endswith("closes.")
    found = knowledge.rule_entities(docs)
    assert {r.name for r in found.collect()} >= {"Alpha Model", "Beta Tool", "Gamma Thing"}
    known = spark.createDataFrame([("concept:alpha", "Concept", "Alpha model", ["alpha"])], "id string, type string, name string, aliases array<string>")
    edges = spark.createDataFrame([("concept:alpha-model", "odd", "concept:beta-tool", 0.6, None, 1)], "src string, rel string, dst string, confidence double, quote string, seq long")
    nodes, kept, outcomes = knowledge.ingest(found, known, edges, ["uses"])
    assert [(r.src, r.rel, r.dst) for r in kept.collect()] == [("concept:alpha", "mentions", "concept:beta-tool")]
    assert outcomes.where("outcome = 'merge'").count() == 2 and "concept:alpha-model" not in {r.id for r in nodes.collect()}
    ids = lambda x: spark.createDataFrame([(x,)], "id string")
    (path,) = knowledge.apply_document(nodes, kept, ids("concept:alpha"), ids("concept:beta-tool")).collect()
    assert path.hops == 1 and not path.weak


def test_command_line(spark, capsys):
    assert main(["list"]) == 0
    assert "bm25_topk" in capsys.readouterr().out
    assert main(["run", "degrees", "/root/testdata/sf0.001"]) == 0
