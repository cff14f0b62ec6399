"""Queries over candidate records, claims, plans, parsed files and reports.

Records, verdicts and landed rows are derived from the star-schema tables by rules of
their keys, in the query and its SQL alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflux.operators import claims, graph, records, reports, retrieval
from folioflux.plans.registry import query, table
from folioflux.sources import parsing, planning, sinks

_VENUE = "CASE p_partkey % 7 WHEN 0 THEN 'peer_reviewed_journal' WHEN 1 THEN 'attribution_report' WHEN 2 THEN 'institutional_data_release' WHEN 3 THEN 'preprint' WHEN 4 THEN 'popular_press' WHEN 5 THEN 'blog' END"
_RECORD = "CASE p_partkey % 5 WHEN 0 THEN 'Journal' WHEN 1 THEN 'article' WHEN 2 THEN 'dataset' WHEN 3 THEN 'Article' END"
_PARTS = f"""parts AS (SELECT p_partkey AS candidate_id, p_name AS title, {_VENUE} AS venue_type, {_RECORD} AS record_type, CASE WHEN p_partkey % 11 = 0 THEN 'given' ELSE '' END AS given,
 CASE p_partkey % 6 WHEN 0 THEN 'preprint_separate_bucket' WHEN 1 THEN 'non_target_month_watchlist' WHEN 2 THEN 'other' WHEN 3 THEN '' END AS routing_reason,
 CASE WHEN p_partkey % 13 = 0 THEN 'later' END AS watchlist_reason, p_partkey % 17 = 0 AS flagged,
 CASE p_partkey % 3 WHEN 0 THEN 'https://doi.org/10.9/' || p_partkey WHEN 1 THEN '' END AS doi, p_brand AS brand FROM part)"""


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part")
    flags = F.when(F.expr("p_partkey % 17 = 0"), F.array(F.lit("preprint_bucket"))).otherwise(F.array().cast("array<string>"))
    named = rows.select(
        F.col("p_partkey").alias("candidate_id"), F.col("p_name").alias("title"), F.expr(_VENUE).alias("venue_type"), F.expr(_RECORD).alias("record_type"), F.expr("CASE WHEN p_partkey % 11 = 0 THEN 'given' ELSE '' END").alias("given"),
        F.expr("CASE p_partkey % 6 WHEN 0 THEN 'preprint_separate_bucket' WHEN 1 THEN 'non_target_month_watchlist' WHEN 2 THEN 'other' WHEN 3 THEN '' END").alias("routing_reason"),
        F.expr("CASE WHEN p_partkey % 13 = 0 THEN 'later' END").alias("watchlist_reason"), flags.alias("exclusions"),
        F.expr("CASE p_partkey % 3 WHEN 0 THEN 'https://doi.org/10.9/' || p_partkey WHEN 1 THEN '' END").alias("doi"), F.col("p_brand").alias("brand"),
    )
    return named.withColumn("work_type", F.lit(None).cast("string"))


@query(
    "work_types",
    f"""WITH {_PARTS} SELECT candidate_id, CASE WHEN given <> '' THEN given WHEN coalesce(lower(record_type) = 'dataset', false) THEN 'research_artifact' WHEN lower(record_type) = 'journal' THEN 'journal_level_record'
 WHEN venue_type = 'peer_reviewed_journal' THEN 'peer_reviewed_journal_article' WHEN venue_type IN ('attribution_report', 'institutional_data_release', 'preprint') THEN venue_type WHEN venue_type = 'popular_press' THEN 'press_lead'
 WHEN lower(record_type) = 'article' THEN 'peer_reviewed_journal_article' ELSE 'unknown' END AS work_type FROM parts""",
)
def work_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    artifact = F.coalesce(F.lower("record_type") == "dataset", F.lit(False))
    kind = records.work_type(F.col("given"), F.col("venue_type"), F.col("record_type"), artifact, ["journal"], ["article"])
    return _parts(spark, sf_dir).select("candidate_id", kind.alias("work_type"))


@query("preprint_split", f"WITH {_PARTS}, x AS (SELECT *, coalesce(venue_type = 'preprint', false) OR coalesce(routing_reason = 'preprint_separate_bucket', false) OR flagged AS pre FROM parts WHERE candidate_id % 4 <> 0) SELECT candidate_id, 'preprint' AS bucket, coalesce(nullif(routing_reason, ''), 'preprint_separate_bucket') AS reason FROM x WHERE pre AND candidate_id % 9 <> 0 UNION ALL SELECT candidate_id, 'preprint', 'explicit' FROM parts WHERE candidate_id % 9 = 0 UNION ALL SELECT candidate_id, 'excluded', routing_reason FROM x WHERE NOT pre")
def preprint_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _parts(spark, sf_dir)
    explicit = rows.where("candidate_id % 9 = 0").withColumn("routing_reason", F.lit("explicit"))
    found, rest = records.split_preprints(rows.where("candidate_id % 4 <> 0"), explicit)
    return found.withColumn("bucket", F.lit("preprint")).unionByName(rest.withColumn("bucket", F.lit("excluded"))).select("candidate_id", "bucket", F.col("routing_reason").alias("reason"))


@query("watchlist_split", f"WITH {_PARTS} SELECT candidate_id, watchlist_reason IS NOT NULL OR coalesce(routing_reason = 'non_target_month_watchlist', false) AS watched FROM parts")
def watchlist_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    watched, rest = records.split_watchlist(_parts(spark, sf_dir))
    return watched.select("candidate_id", F.lit(True).alias("watched")).unionByName(rest.select("candidate_id", F.lit(False).alias("watched")))


_MENTIONED = "CASE WHEN candidate_id % 2 = 0 THEN 'u' || (candidate_id % 5) END"


@query(
    "press_resolution",
    f"""WITH {_PARTS}, x AS (SELECT *, venue_type = 'popular_press' AS press, coalesce(nullif(regexp_replace(doi, '^https://doi.org/', ''), ''), CASE WHEN candidate_id % 8 = 0 THEN '10.7/x' END) AS found, {_MENTIONED} AS mu FROM parts)
 SELECT candidate_id, CASE WHEN coalesce(press AND found IS NOT NULL, false) THEN found ELSE doi END AS doi, CASE WHEN coalesce(press AND found IS NOT NULL, false) THEN 'peer_reviewed_journal' ELSE venue_type END AS venue_type,
 CASE WHEN press IS NULL THEN NULL ELSE NOT press OR found IS NOT NULL END AS resolved, 2::BIGINT + CASE WHEN coalesce(press AND found IS NOT NULL, false) THEN 1 ELSE 0 END AS n_mentions, CASE WHEN mu IS NULL THEN 1 WHEN mu = 'u0' THEN 1 ELSE 2 END::BIGINT AS n_coverage FROM x""",
)
def press_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two mentions each, one of which stands in the coverage already."""
    rows = _parts(spark, sf_dir).withColumn("url", F.lit("http://press"))
    mention = lambda url: F.struct(F.lit("Outlet").alias("source"), url.alias("url"), F.lit("2024-01-02").alias("date_seen"), F.lit("popular_press").alias("source_type"), F.lit(None).cast("string").alias("note"))
    rows = rows.withColumn("mentions", F.array(mention(F.lit("u0")), mention(F.expr(_MENTIONED))))
    held = F.array(F.struct(F.lit("Outlet").alias("outlet"), F.lit("u0").alias("url"), F.lit("h").alias("headline"), F.lit(None).cast("string").alias("date"), F.lit(True).alias("verified"), F.lit("").alias("verification_note")))
    rows = rows.withColumn("coverage", records.attach_press(held, F.col("mentions"), F.col("title"), ["popular_press"], False, "seen"))
    out = records.resolve_press(rows, ["popular_press"], F.expr("CASE WHEN candidate_id % 8 = 0 THEN '10.7/x' END"))
    return out.select("candidate_id", "doi", "venue_type", F.col("primary_resolved").alias("resolved"), F.size("mentions").cast("bigint").alias("n_mentions"), F.size("coverage").cast("bigint").alias("n_coverage"))


@query("open_access_lookup", f"WITH {_PARTS} SELECT candidate_id, CASE WHEN hit THEN candidate_id % 2 = 0 END AS open_access, CASE WHEN hit THEN candidate_id % 2 <> 0 END AS paywall, CASE WHEN hit THEN 'J' || (candidate_id % 4) END AS venue, CASE WHEN hit AND candidate_id % 4 = 0 THEN 'pdf' WHEN hit THEN 'page' END AS pdf FROM (SELECT candidate_id, candidate_id % 3 = 0 AND candidate_id % 5 <> 0 AS hit FROM parts)")
def open_access_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _parts(spark, sf_dir).select("candidate_id", "doi", *[F.lit(None).cast("boolean").alias(c) for c in ("open_access", "paywall")], F.lit("").alias("venue"), F.lit(None).cast("string").alias("full_text_pdf_url"))
    k = F.col("p_partkey")
    landed = table(spark, sf_dir, "part").where("p_partkey % 5 <> 0").select(F.concat(F.lit("10.9/"), k.cast("string")).alias("doi"), (k % 2 == 0).alias("is_oa"), F.concat(F.lit("J"), (k % 4).cast("string")).alias("journal_name"), F.when(k % 4 == 0, "pdf").alias("pdf_url"), F.lit("page").alias("page_url"))
    return records.open_access(rows, landed).select("candidate_id", "open_access", "paywall", F.nullif("venue", F.lit("")).alias("venue"), F.col("full_text_pdf_url").alias("pdf"))


@query("pdf_payloads", "SELECT doc_id, starts_with(CASE doc_id % 3 WHEN 0 THEN '%PDF-1.7 ' || text WHEN 1 THEN text ELSE '%PD' END, '%PDF') AS pdf FROM documents")
def pdf_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.expr("CASE doc_id % 3 WHEN 0 THEN '%PDF-1.7 ' || text WHEN 1 THEN text ELSE '%PD' END").cast("binary")
    return table(spark, sf_dir, "documents").select("doc_id", F.coalesce(records.is_pdf(body), F.lit(False)).alias("pdf"))


@query("record_notes", f"WITH {_PARTS} SELECT candidate_id, 2::BIGINT AS n_audit, CASE WHEN flagged THEN 1 ELSE 2 END::BIGINT AS n_codes, 'second' AS reason FROM parts")
def record_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    stamp = F.lit("2024-01-01T00:00:00")
    trail = records.with_audit(records.with_audit(F.lit(None), "a", "seen", F.lit("x"), stamp), "b", "kept", F.lit("y"), stamp)
    codes = records.with_exclusion(records.with_exclusion(F.col("exclusions"), F.lit("preprint_bucket")), F.when(F.size("exclusions") == 0, "other"))
    reasons = records.with_missing(records.with_missing(F.lit(None), "f", F.lit("first")), "f", F.lit("second"))
    return _parts(spark, sf_dir).select("candidate_id", F.size(trail).cast("bigint").alias("n_audit"), F.size(codes).cast("bigint").alias("n_codes"), reasons["f"].alias("reason"))


@query("rubric_version", f"WITH {_PARTS} SELECT min_by(brand, candidate_id) AS version FROM parts WHERE candidate_id % 10 = 7")
def rubric_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _parts(spark, sf_dir).withColumn("version", F.expr("CASE WHEN candidate_id % 10 = 7 THEN brand WHEN candidate_id % 2 = 0 THEN '' END"))
    return records.first_version(rows, "version", "candidate_id")


# --- claims ------------------------------------------------------------------------
_CLAIMS = "c AS (SELECT doc_id AS claim_id, CASE WHEN doc_id % 10 = 9 THEN 'vague' ELSE 'supported' END AS status, CASE WHEN doc_id % 4 = 0 THEN 'old' END AS rationale, CASE doc_id % 5 WHEN 0 THEN 'Unsupported ' WHEN 1 THEN 'overstated' WHEN 2 THEN 'supported' END AS verdict, CASE WHEN doc_id % 2 = 0 THEN ' why ' ELSE '' END AS reason, CASE WHEN doc_id % 3 = 0 THEN 'no number' END AS vague, CASE WHEN doc_id % 7 = 0 THEN 'near' END AS note FROM documents)"


@query(
    "claim_flags",
    f"""WITH {_CLAIMS}, v AS (SELECT *, trim(lower(verdict)) AS k FROM c),
 s AS (SELECT *, CASE k WHEN 'unsupported' THEN 'unsupported-by-source' WHEN 'overstated' THEN 'vague' ELSE status END AS s1, CASE k WHEN 'unsupported' THEN 'Source-check: ' || CASE WHEN trim(reason) = '' THEN 'not grounded in the cited source context.' ELSE trim(reason) END WHEN 'overstated' THEN 'Overstated vs. source: ' || CASE WHEN trim(reason) = '' THEN 'source is weaker/more hedged than the claim.' ELSE trim(reason) END END AS said FROM v),
 t AS (SELECT *, CASE WHEN s1 = 'supported' AND vague IS NOT NULL THEN 'vague' ELSE s1 END AS s2, CASE WHEN s1 = 'supported' AND vague IS NOT NULL THEN 'Vague: ' || vague END AS vs FROM s)
 SELECT claim_id, s2 AS status, concat_ws(' | ', rationale, said, vs, note) AS rationale, s2 <> 'supported' OR said IS NOT NULL OR note IS NOT NULL AS flagged FROM t""",
)
def claim_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    k = F.col("doc_id")
    own = docs.select(k.alias("claim_id"), F.when(k % 10 == 9, "vague").otherwise("supported").alias("status"), F.when(k % 4 == 0, "old").alias("rationale"))
    landed = docs.where("doc_id % 5 < 3").select(k.alias("claim_id"), F.when(k % 5 == 0, "Unsupported ").when(k % 5 == 1, "overstated").otherwise("supported").alias("verdict"), F.when(k % 2 == 0, " why ").otherwise("").alias("reason"))
    key = F.col("claim_id")
    return claims.flag_claims(own, landed, F.when(key % 3 == 0, "no number"), F.when(key % 7 == 0, "near")).select("claim_id", "status", "rationale", "flagged")


@query("safe_flags", "SELECT doc_id AS claim_id, CASE WHEN doc_id % 6 = 0 THEN 'vague' WHEN doc_id % 4 = 0 THEN 'unsupported-by-source' ELSE 'supported' END AS status FROM documents")
def safe_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("claim_id"), F.when(F.col("doc_id") % 4 == 0, "unsupported-by-source").otherwise("supported").alias("status"))
    return claims.safe_status(docs, docs.where("claim_id % 6 = 0").withColumn("status", F.lit("vague")))


@query("citation_dedup", "SELECT l_suppkey, l_returnflag, l_orderkey, l_linenumber FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_suppkey, l_returnflag, left(coalesce(CASE WHEN l_quantity > 10 THEN repeat('q', 79) || l_linestatus || l_partkey END, ''), 80) ORDER BY l_orderkey * 10 + l_linenumber) = 1")
def citation_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    quote = F.when(F.col("l_quantity") > 10, F.concat(F.lit("q" * 79), "l_linestatus", F.col("l_partkey").cast("string")))
    rows = table(spark, sf_dir, "lineitem").withColumn("quote", quote).withColumn("seq", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return claims.distinct_citations(rows, ["l_suppkey", "l_returnflag"], "seq").select("l_suppkey", "l_returnflag", "l_orderkey", "l_linenumber")


@query(
    "claim_assembly",
    """WITH w AS (SELECT doc_id, coalesce(text, '') AS body, string_split(coalesce(text, ''), ' ') AS w FROM documents), x AS (SELECT doc_id, body, unnest(w) AS claim, unnest(range(0, len(w))) AS n FROM w),
 k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n) AS k FROM x WHERE trim(claim, ' ') <> ''), f AS (SELECT * FROM k WHERE k <= 12 QUALIFY row_number() OVER (PARTITION BY doc_id, lower(claim) ORDER BY n) = 1)
 SELECT doc_id, n, md5(claim) AS claim, instr(lower(body), lower(claim)) - 1 AS lo FROM f""",
)
def claim_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words stand for a model's claims; the whole text is the only section."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    none = spark.createDataFrame([], "doc_id bigint, section int, lo bigint, body string")
    words = docs.select("doc_id", F.lit(0).alias("section"), F.posexplode(F.split("text", " ", -1)).alias("n", "claim"))
    out = claims.assemble_claims(words, claims.or_whole_text(none, docs, "doc_id", "text"))
    return out.select("doc_id", F.col("n").cast("bigint").alias("n"), F.md5("claim").alias("claim"), "lo")


# --- graph look-ups ----------------------------------------------------------------
@query("alias_upsert", "SELECT alias, target FROM (SELECT p_partkey::VARCHAR AS alias, coalesce(CASE WHEN p_partkey % 4 = 0 AND p_partkey % 12 <> 0 THEN p_brand END, 'old') AS target FROM part) UNION ALL SELECT 'new', max_by(p_brand, p_partkey) FROM part WHERE p_partkey % 5 = 0")
def alias_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    old = part.select(k.cast("string").alias("alias"), F.lit("old").alias("target"))
    fresh = part.where("p_partkey % 4 = 0").select(k.cast("string").alias("alias"), F.when(k % 12 == 0, " ").otherwise(F.col("p_brand")).alias("target"), k.alias("seq"))
    more = part.where("p_partkey % 5 = 0").select(F.lit("new").alias("alias"), F.col("p_brand").alias("target"), k.alias("seq"))
    return graph.set_aliases(old, fresh.unionByName(more).unionByName(part.select(F.lit("self").alias("alias"), F.lit("self").alias("target"), k.alias("seq"))))


@query("alias_lookup", "SELECT p.p_partkey AS wanted, CASE WHEN p.p_partkey % 6 = 0 THEN 1 ELSE p.p_partkey END AS id, t.p_name AS name FROM part p LEFT JOIN (SELECT * FROM part WHERE p_partkey % 7 <> 0) t ON t.p_partkey = CASE WHEN p.p_partkey % 6 = 0 THEN 1 ELSE p.p_partkey END")
def alias_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    # Every twelfth is known by the sixth before it, which is known by 1.
    target = F.when(F.col("p_partkey") % 12 == 0, F.greatest(F.col("p_partkey") - 6, F.lit(1))).otherwise(1).cast("bigint")
    aliases = part.where("p_partkey % 6 = 0").select(F.col("p_partkey").alias("alias"), target.alias("target"))
    nodes = part.where("p_partkey % 7 <> 0").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    return graph.look_up(part.select(F.col("p_partkey").alias("id")), nodes, aliases).select("wanted", "id", "name")


@query("ordered_fetch", "SELECT vec_id, (1000 - vec_id % 1000) * 1000000 + vec_id AS ord FROM embeddings WHERE vec_id % 3 = 0")
def ordered_fetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id")
    wanted = vectors.select("vec_id", ((1000 - F.col("vec_id") % 1000) * 1000000 + F.col("vec_id")).alias("ord"))
    return graph.in_order(wanted, vectors.where("vec_id % 3 = 0"), "vec_id").select("vec_id", "ord")


@query("node_types", "SELECT p_partkey, CASE p_partkey % 9 WHEN 0 THEN 'Organization' WHEN 1 THEN 'Organization' WHEN 2 THEN 'Technology' WHEN 3 THEN 'Method' WHEN 4 THEN 'Idea' WHEN 5 THEN 'Person' WHEN 6 THEN 'Concept' WHEN 7 THEN 'Concept' ELSE 'Organization' END AS type FROM part")
def node_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["organisation", " Research LAB", "software tool", "an algorithm", "Worldview", "co-author", "", "Glacier", "tech company"]
    return table(spark, sf_dir, "part").select("p_partkey", graph.node_type(F.element_at(F.array(*[F.lit(n) for n in names]), (F.col("p_partkey") % 9 + 1).cast("int"))).alias("type"))


@query(
    "extraction_assembly",
    """WITH e AS (SELECT n_nationkey AS seq, trim(n_name) AS name, 'Place:' || trim(regexp_replace(lower(n_name), '[^a-z0-9]+', '-', 'g'), '-') AS id FROM nation),
 r AS (SELECT a.id AS src, CASE WHEN b.seq % 3 = 0 THEN 'mentions' ELSE 'borders' END AS rel, b.id AS dst FROM e a JOIN e b ON b.seq = (a.seq * 3 + 1) % 25 WHERE a.seq % 4 <> 0 AND a.id <> b.id)
 SELECT src, rel, dst, 0.6 AS confidence FROM r GROUP BY ALL UNION ALL SELECT 'Source:doc', 'mentions', id, 0.4 FROM e WHERE id NOT IN (SELECT src FROM r UNION SELECT dst FROM r)""",
)
def extraction_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation")
    entities = nation.select(F.col("n_name").alias("name"), F.lit("Place").alias("type"), F.col("n_nationkey").alias("seq"))
    other = nation.select(F.col("n_nationkey").alias("k"), F.upper("n_name").alias("object"))
    told = nation.where("n_nationkey % 4 <> 0").withColumn("k", (F.col("n_nationkey") * 3 + 1) % 25).join(other, "k")
    relations = told.select(F.col("n_name").alias("subject"), F.when(F.col("k") % 3 == 0, "is said of").otherwise("borders").alias("rel"), "object", F.lit("").alias("quote"), F.col("n_nationkey").alias("seq"))
    return graph.assemble("doc", entities, relations, ["borders"])[1].select("src", "rel", "dst", "confidence")


@query("related_nodes", "SELECT query_id, id, score, rank FROM (SELECT q.vec_id AS query_id, v.vec_id AS id, round(list_cosine_similarity(CAST(v.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 6) AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY score DESC, v.vec_id) - 1 AS rank FROM embeddings v, embeddings q WHERE q.vec_id % 50 = 0 AND v.label % 2 = 0) WHERE rank < 5")
def related_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    nodes = vectors.select(F.col("vec_id").alias("id"), F.when(F.col("label") % 2 == 0, "Idea").otherwise("Grant").alias("type"), F.col("embedding").alias("vector"))
    asked = vectors.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return graph.related_nodes(nodes, asked, ["Idea", "Person"]).select("query_id", F.col("vec_id").alias("id"), "score", F.col("rank").cast("bigint").alias("rank"))


@query("retrieval_scores", "SELECT d.doc_id, round(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(list_transform(range(1, 65), lambda x: x) AS DOUBLE[])), 4) AS retrieval_score FROM documents d LEFT JOIN embeddings e ON d.doc_id = e.vec_id")
def retrieval_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "doc_id")
    return retrieval.attach_score(table(spark, sf_dir, "documents").select("doc_id"), vectors, [float(x) for x in range(1, 65)], "doc_id")


# --- plans and landed rows ---------------------------------------------------------
_KIND = "CASE s_suppkey % 4 WHEN 0 THEN 'scholarly_api' WHEN 1 THEN 'rss' WHEN 2 THEN 'press_api' ELSE 'journal' END"


def _sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    issns = F.when(k % 4 == 3, F.array(F.concat(F.lit("issn-"), k.cast("string")), F.lit("x"))).otherwise(F.array().cast("array<string>"))
    return table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), k.cast("string")).alias("id"), F.expr(_KIND).alias("kind"), (k % 10 != 0).alias("enabled"), issns.alias("issns"))


@query("query_plan", f"SELECT 's' || s_suppkey AS source, ord, q AS query FROM (SELECT s_suppkey, {_KIND} AS kind FROM supplier WHERE s_suppkey % 10 <> 0) JOIN (VALUES (0, 'ice loss'), (1, 'heat'), (2, 'Sea level')) v(ord, q) ON ord = 0 OR (kind <> 'rss' AND s_suppkey <> 4)")
def query_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planning.plan_queries(_sources(spark, sf_dir), ["heat", "ICE  loss", "Sea level"], "Focus on the poles.\nQuery:  ice loss ", keyed=["s4"])


@query("issn_rows", "SELECT 's' || s_suppkey AS source, count(*) AS n FROM supplier JOIN lineitem ON s_suppkey = l_suppkey WHERE s_suppkey % 4 = 3 GROUP BY s_suppkey")
def issn_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    landed = table(spark, sf_dir, "lineitem").select(F.concat(F.lit(" ISSN-"), F.col("l_suppkey").cast("string")).alias("issn"))
    return planning.by_issn(landed, _sources(spark, sf_dir)).groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query(
    "source_scan",
    """WITH p AS (SELECT 's' || s_suppkey AS source, s_suppkey AS k FROM supplier), l AS (SELECT 's' || l_suppkey AS source, l_linenumber % 4 AS ord, CASE WHEN l_partkey % 50 = 7 THEN 'failed' ELSE 'ok' END AS status, l_partkey AS key FROM lineitem WHERE l_linenumber % 4 < 3),
 s AS (SELECT source, min(ord) AS stop FROM l WHERE status <> 'ok' GROUP BY source), r AS (SELECT l.* FROM l LEFT JOIN s USING (source) WHERE status = 'ok' AND (stop IS NULL OR ord < stop))
 SELECT p.source, count(r.key) AS n, count(DISTINCT r.key) AS n_different, CASE WHEN max(s.stop) IS NULL THEN 0 ELSE 1 END AS n_errors FROM p LEFT JOIN r USING (source) LEFT JOIN s USING (source) GROUP BY p.source""",
)
def source_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("source"), F.explode(F.array(*[F.lit(n) for n in range(3)])).alias("ord"))
    rows = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("source"), (F.col("l_linenumber") % 4).alias("ord"), F.when(F.col("l_partkey") % 50 == 7, "failed").otherwise("ok").alias("status"), F.col("l_partkey").alias("key"))
    return planning.scan(rows, plan)[2]


@query("journal_remainder", "SELECT title FROM (SELECT title, min(leg) AS leg FROM (SELECT 0 AS leg, 't' || lpad((p_partkey % 30)::VARCHAR, 3, '0') AS title FROM part UNION ALL SELECT 1, 't' || lpad((p_partkey % 45)::VARCHAR, 3, '0') FROM part UNION ALL SELECT 2, 't' || lpad((p_partkey % 90)::VARCHAR, 3, '0') FROM part) GROUP BY title) ORDER BY leg, title LIMIT 50")
def journal_remainder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two ISSN legs, and a feed that fills what is left of the limit."""
    leg = lambda n: table(spark, sf_dir, "part").select(F.concat(F.lit("t"), F.lpad((F.col("p_partkey") % n).cast("string"), 3, "0")).alias("title"), F.lit(None).cast("string").alias("doi"), F.lit(None).cast("string").alias("url"))
    return planning.journal_rows([leg(30), leg(45)], leg(90), 50).select("title")


# --- parsed files ------------------------------------------------------------------
_FILE = "'/in/' || CASE doc_id % 4 WHEN 0 THEN 'My Note_' || doc_id || '.md' WHEN 1 THEN '2024-03-05 plain' || doc_id || '.txt' WHEN 2 THEN 'odd' || doc_id || '.xyz' ELSE 'p' || doc_id || '.HTML' END"
_BODY = "CASE doc_id % 4 WHEN 0 THEN 'intro\n## A Title ##\nbody' WHEN 3 THEN '<html><head><title> T &amp; U </title></head><body><p>x</p></body></html>' ELSE '\n  First line\nrest' END"


@query("parsed_files", f"SELECT doc_id, trim(regexp_replace(lower(regexp_replace(regexp_extract(p, '([^/]*)$', 1), '\\.[A-Za-z0-9]+$', '')), '[^a-z0-9]+', '-', 'g'), '-') AS slug, CASE doc_id % 4 WHEN 0 THEN 'A Title' WHEN 3 THEN 'T & U' ELSE 'First line' END AS title, CASE WHEN doc_id % 4 = 1 THEN '2024-03-05' END AS date FROM (SELECT doc_id, {_FILE} AS p FROM documents)")
def parsed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(F.expr(_FILE).alias("path"), F.expr(_BODY.replace("\n", "\\n")).alias("content"))
    out = parsing.parse(rows)
    number = F.regexp_extract("path", "([0-9]+)\\.[A-Za-z]+$", 1).cast("bigint")
    return out.select(number.alias("doc_id"), F.col("source_slug").alias("slug"), "title", F.col("date").cast("string").alias("date"))


@query("joined_pages", "WITH p AS (SELECT conv_id, turn, 'Page ' || turn || chr(10) || 'Body text ' || turn || ' contin-' || chr(10) || 'ued here' || chr(10) || '- ' || turn || ' -' AS t FROM conversations), c AS (SELECT conv_id, turn, 'Body text ' || turn || ' continued here' AS b FROM p) SELECT conv_id, string_agg(b, chr(10) || chr(10) ORDER BY turn) AS markdown, count(*) AS n FROM c GROUP BY conv_id")
def joined_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("turn").cast("string")
    pages = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(F.lit("Page "), n, F.lit("\nBody text "), n, F.lit(" contin-\nued here\n- "), n, F.lit(" -")).alias("text"))
    return parsing.join_pages(pages, "conv_id", "turn").select(F.col("doc_id").alias("conv_id"), "markdown", F.size("starts").cast("bigint").alias("n"))


@query("chunk_vectors", "SELECT vec_id::VARCHAR AS id, vec_id % 3 = 0 AND vec_id % 5 <> 0 AS has_vector FROM embeddings")
def chunk_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third has vectors, a fifth of a wrong size."""
    vectors = table(spark, sf_dir, "embeddings")
    key = F.col("vec_id").cast("string").alias("id")
    rows = vectors.select(key, F.lit("s").alias("source_slug"), F.lit("body").alias("section"), F.lit("t").alias("text"), *[F.lit(0).cast("bigint").alias(c) for c in ("char_start", "char_end")])
    landed = vectors.where("vec_id % 3 = 0").select(key, F.when(F.col("vec_id") % 5 == 0, F.slice("embedding", 1, 3)).otherwise(F.col("embedding")).alias("vector"))
    return parsing.with_vectors(rows, landed, 64).select("id", F.col("vector").isNotNull().alias("has_vector"))


# --- reports -----------------------------------------------------------------------
_BUCKETS = ["kept", "review", "none", "dropped"]
_BUCKET = "CASE o_orderstatus WHEN 'F' THEN 'kept' WHEN 'O' THEN 'review' ELSE 'dropped' END"


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("seq"), F.expr(_BUCKET).alias("bucket"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderpriority")).alias("title"), F.lit("").alias("doi"), F.col("o_orderpriority").alias("source"), F.lit(None).cast("string").alias("routing_reason"), (F.col("o_orderkey") % 4).cast("int").alias("score"))


@query(
    "markdown_report",
    f"""WITH o AS (SELECT o_orderkey AS k, {_BUCKET} AS bucket, o_orderpriority AS p FROM orders), b AS (SELECT * FROM (VALUES (1, 'kept'), (2, 'review'), (3, 'none'), (4, 'dropped')) v(ord, bucket))
 SELECT 0 AS ord, -1::BIGINT AS k, '# Run' AS line UNION ALL SELECT ord, -1, '## ' || b.bucket || ' (' || count(o.k) || ')' FROM b LEFT JOIN o ON b.bucket = o.bucket GROUP BY ord, b.bucket
 UNION ALL SELECT ord, k, '### ' || CASE WHEN k % 3 <> 0 THEN p ELSE 'Untitled' END || chr(10) || '- Source: ' || p || CASE WHEN k % 4 <> 0 THEN chr(10) || '- score: ' || (k % 4) ELSE '' END FROM o JOIN b USING (bucket)""",
)
def markdown_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.markdown_report("Run", _orders(spark, sf_dir), _BUCKETS, ["score"])


@query("json_report", f"SELECT ord, count(*) AS n FROM (SELECT 0 AS ord UNION ALL SELECT 1 FROM range(4) UNION ALL SELECT 2 FROM orders UNION ALL SELECT DISTINCT 3 FROM orders GROUP BY {_BUCKET}) GROUP BY ord")
def json_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _orders(spark, sf_dir)
    lines = sinks.json_report({"month": "1996-05"}, rows, reports.bucket_counts(rows, _BUCKETS), rows.limit(1).select(F.lit("one").alias("theme")))
    return lines.where(F.try_parse_json("line").isNotNull()).groupBy("ord").agg(F.count(F.lit(1)).alias("n"))


@query("source_breakdown", f"SELECT p AS source, count(*) FILTER (b = 'kept') AS kept, count(*) FILTER (b = 'review') AS review, row_number() OVER (ORDER BY CASE p WHEN '5-LOW' THEN 0 WHEN '1-URGENT' THEN 1 END NULLS LAST, p) AS place FROM (SELECT o_orderpriority AS p, {_BUCKET} AS b FROM orders) GROUP BY p")
def source_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    configured = spark.createDataFrame([("5-LOW", 0), ("1-URGENT", 1)], "source string, ord int")
    rows = _orders(spark, sf_dir).select(F.col("seq").alias("candidate_id"), "source", "bucket")
    pivot = reports.source_pivot(rows, table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("source")).distinct(), ["kept", "review"])
    placed = sinks.source_breakdown(pivot, configured).coalesce(1)
    return placed.select("source", "kept", "review", (F.monotonically_increasing_id() + 1).alias("place"))


@query("applicability_page", "SELECT 1 AS ord, p_partkey AS k, '## ' || p_brand || ' (' || CASE WHEN p_size / 50.0 >= 0.6 THEN 'high' WHEN p_size / 50.0 >= 0.3 THEN 'medium' ELSE 'low' END || ')' || chr(10) || CASE WHEN p_partkey % 4 = 0 THEN 'said' ELSE p_name END AS line FROM part")
def applicability_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    paths = part.select(F.col("p_partkey").alias("path_index"), F.col("p_brand").alias("end"), (F.col("p_size") / 50.0).alias("strength"), "p_name")
    prose = part.where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("path_index"), F.when(F.col("p_partkey") % 4 == 0, " said ").otherwise(" ").alias("prose"))
    return sinks.applicability_page("Page", "2024-01-01", sinks.narrated(paths, prose, F.col("p_name"))).where("ord = 1")


@query("artifact_lookup", "SELECT 'r' || o_custkey AS run_id, count(*) AS n FROM orders WHERE o_custkey % 5 = 1 AND o_orderpriority = '1-URGENT' GROUP BY o_custkey")
def artifact_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = F.array(F.struct(F.concat("o_orderpriority", F.lit(".md")).alias("name"), F.lit("/secret").alias("path")))
    rows = table(spark, sf_dir, "orders").where("o_custkey % 5 = 1").select(F.concat(F.lit("r"), F.col("o_custkey").cast("string")).alias("run_id"), F.lit("m").alias("target_month"), F.lit("c").alias("created_at"), F.lit("e").alias("expires_at"), own.alias("artifacts"))
    public = sinks.public_manifest(rows)
    named = public.select("run_id", F.explode("artifacts").alias("a")).where(F.col("a.url") == F.concat(F.lit("/runs/"), F.col("run_id"), F.lit("/artifacts/1-URGENT.md")))
    return named.groupBy("run_id").agg(F.count(F.lit(1)).alias("n"))


@query("ingest_counters", "SELECT (SELECT count(*) FROM part) AS nodes, (SELECT count(*) FROM part WHERE p_size > 25) AS merged, (SELECT count(*) FROM nation) AS edges, (SELECT count(*) FROM embeddings) AS chunks, (SELECT count(*) FROM documents) AS claims, (SELECT count(*) FROM documents WHERE doc_id % 9 = 0) AS flagged")
def ingest_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = table(spark, sf_dir, "part").select(F.when(F.col("p_size") > 25, "merge").otherwise("create").alias("outcome"))
    told = table(spark, sf_dir, "documents").select(F.when(F.col("doc_id") % 9 == 0, "vague").otherwise("supported").alias("status"))
    return sinks.ingest_counters(nodes, table(spark, sf_dir, "nation"), table(spark, sf_dir, "embeddings"), told)


@query("window_labels", "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') || ' to 1999-01-01' WHEN 1 THEN 'from ' || strftime(o_orderdate, '%Y-%m-%d') WHEN 2 THEN 'until 1999-01-01' ELSE 'any date' END AS label FROM orders")
def window_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey") % 4
    return table(spark, sf_dir, "orders").select("o_orderkey", sinks.window_label(F.when(k < 2, F.col("o_orderdate")), F.when((k == 0) | (k == 2), F.lit("1999-01-01").cast("date"))).alias("label"))
