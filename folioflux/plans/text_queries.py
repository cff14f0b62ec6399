"""Queries over documents: keys, rules, scores, reports and search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflux.functions import text as T
from folioflux.operators import dedup, documents, reports, retrieval, rules
from folioflux.plans.registry import query, table

# Lists made of words that occur in the test tables; production lists are data too.
LEX = rules.Lexicons(
    lists={
        "formation": ["hable"], "paleo": ["reing"], "contemporary": ["erth"], "historical": ["aning"], "pollutant": ["ining"], "mechanism": ["tion"], "methods": ["mente"],
        "climate": ["en", "the", "de", "ention"], "finding": ["ing", "ción"], "social": ["heble"], "natural": ["er", "la"], "solutions": ["license"], "lab": ["@"], "in_situ": ["ofth"],
        "direct_lens": ["the", "de"], "tool_performance": ["ndre"], "adaptation": ["reand"], "other_driver": ["esion"], "conceptual": ["otion"],
    },
    domains=[("heat", ["ation", "heat"]), ("ice", ["ice", "ier"]), ("sea", ["nd", "los"])],
    fallback_topics=[("general", ["en", "la"])],
)
PRIMARY = ["en", "fr", "de"]
DIMS = [
    rules.Dimension("novelty", ["aning", "reing", "heble", "ention"], baseline=1, weight=1.5),
    rules.Dimension("impact", ["nicht", "mente", "hable", "ining"], baseline=1, weight=2.0),
    rules.Dimension("audience", ["en", "the", "and", "of", "to", "de"], weight=0.5, selects=False),
]


def _short(term: str) -> bool:
    return term.isalpha() and len(term) <= 4


def _sql_any(col: str, terms: list[str]) -> str:
    # RE2 has no Unicode word boundary: a boundary is the text's end or a non-letter.
    words = [t for t in terms if _short(t)]
    parts = [f"contains({col}, '{t}')" for t in terms if not _short(t)]
    if words:
        parts.append(f"regexp_matches({col}, '(^|[^\\p{{L}}\\p{{N}}_])(" + "|".join(words) + ")($|[^\\p{L}\\p{N}_])')")
    return "(" + " OR ".join(parts) + ")"


_FOLD = "replace(lower(text), 'ß', 'ss')"
_S = lambda name, col="t": _sql_any(col, list(LEX[name]))
_FINDING = f"({_S('climate')} AND {_S('finding')})"


def _codes_sql() -> str:
    tag = lambda terms: _sql_any("t", terms)
    primary = ", ".join(f"'{p}'" for p in [*PRIMARY, "preprint"])
    codes = [
        ("ineligible_source_type", f"NOT coalesce(lang IN ({primary}), false)"),
        ("historical_or_formation_without_current_climate_implication", _S("formation")),
        ("paleoclimate_without_current_implication", f"{_S('paleo')} AND NOT {_S('contemporary')}"),
        ("historical_without_current_climate_implication", f"{_S('historical')} AND NOT {_S('contemporary')}"),
        ("ambiguous_keyword_without_climate_mechanism", f"{_S('pollutant')} AND NOT {_S('mechanism')}"),
        ("methods_only_without_substantive_climate_finding", f"{_S('methods')} AND NOT {_FINDING}"),
        ("social_science_without_natural_science_finding", f"{_S('social')} AND NOT {_S('natural')}"),
        ("no_evidence_of_scope_fit", f"NOT {_S('climate')}"),
        ("no_supported_climate_impact_domain", "NOT (" + " OR ".join(tag(list(x)) for _, x in [*LEX.domains, *LEX.fallback_topics]) + ")"),
        ("solutions_paper", _S("solutions")),
        ("ex_situ_lab", f"{_S('lab')} AND NOT {_S('in_situ')}"),
    ]
    return "concat_ws(';', " + ", ".join(f"CASE WHEN {rule} THEN '{code}' END" for code, rule in codes) + ")"


_GATE = f"""CASE WHEN NOT {_S('direct_lens')} THEN 'indirect_or_incidental_climate_lens' WHEN {_S('tool_performance')} THEN 'method_or_tool_performance_focus'
 WHEN {_S('adaptation')} THEN 'adaptation_or_intervention_evaluation_focus' WHEN {_S('other_driver')} THEN 'non_climate_primary_driver'
 WHEN {_S('conceptual')} THEN 'conceptual_or_perspective_without_primary_finding' WHEN NOT {_FINDING} THEN 'substantive_climate_finding_unclear' END"""
_ASSESSED = f"SELECT doc_id, source, lang, text, t, {_codes_sql()} AS exclusions, {_GATE} AS gate FROM (SELECT *, {_FOLD} AS t FROM documents)"
_ROUTED = f"SELECT *, CASE WHEN exclusions <> '' THEN 'excluded' WHEN gate IS NOT NULL THEN 'manual_review' ELSE 'evaluated' END AS bucket FROM ({_ASSESSED})"
_TAGS = "concat_ws(';', " + ", ".join(f"CASE WHEN {_sql_any('t', list(x))} THEN '{n}' END" for n, x in LEX.domains) + ")"
_TAGS = f"CASE WHEN {_TAGS} <> '' THEN {_TAGS} ELSE concat_ws(';', " + ", ".join(f"CASE WHEN {_sql_any('t', list(x))} THEN '{n}' END" for n, x in LEX.fallback_topics) + ") END"


def _hits(dim: rules.Dimension) -> str:
    return f"least(5, {dim.baseline} + " + " + ".join(f"CAST(contains(t, '{x}') AS INT)" for x in dim.terms) + ")"


_SCORES = ", ".join(f"{_hits(d)} AS score_{d.name}" for d in DIMS)
_COMPOSITE = "round(" + " + ".join(f"{_hits(d)} * {d.weight}::DOUBLE" for d in DIMS if d.selects) + ", 2)"


def assessed(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text", F.col("lang").alias("venue_type"), T.casefold(F.col("text")).alias("full_text"))
    return rules.assess(docs.withColumn("evidence", F.col("full_text")), LEX, PRIMARY)


@query("lexicon_hits", f"SELECT doc_id, {_TAGS} AS tags, concat_ws(';', " + ", ".join(f"CASE WHEN contains({_FOLD}, '{t}') THEN '{t}' END" for t in ("aning", "nicht", "license")) + f") AS seeds FROM (SELECT *, {_FOLD} AS t FROM documents)")
def lexicon_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = T.casefold(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(rules.domain_tags(t, LEX), ";").alias("tags"), F.array_join(T.matching_terms(t, ["aning", "nicht", "license"]), ";").alias("seeds"))


@query("rule_flags", f"SELECT doc_id, exclusions, gate FROM ({_ASSESSED})")
def rule_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assessed(spark, sf_dir).select("doc_id", F.array_join("exclusions", ";").alias("exclusions"), "gate")


@query("route_buckets", f"SELECT bucket, CASE bucket WHEN 'evaluated' THEN 'Include' WHEN 'manual_review' THEN 'Manual review' ELSE 'Exclude' END AS verdict, l.quality, count(*) AS n FROM ({_ROUTED}) d LEFT JOIN labels l USING (doc_id) GROUP BY ALL")
def route_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = assessed(spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return joined.groupBy("bucket", rules.verdict(F.col("bucket")).alias("verdict"), "quality").agg(F.count(F.lit(1)).alias("n"))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.score(assessed(spark, sf_dir).withColumn("abstract", F.col("text")), DIMS)


@query("capped_scores", f"SELECT doc_id, {_SCORES} FROM (SELECT *, {_FOLD} AS t FROM documents)")
def capped_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).select("doc_id", *[f"score_{d.name}" for d in DIMS])


@query("weighted_composite", f"SELECT doc_id, {_COMPOSITE} AS composite_score, {_hits(DIMS[2])} >= 3 AND {_hits(DIMS[1])} <= 2 AS honorable_mention FROM (SELECT *, {_FOLD} AS t FROM documents)")
def weighted_composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).select("doc_id", "composite_score", "honorable_mention")


_RANKED = f"SELECT doc_id, {_COMPOSITE} AS composite_score, coalesce(nullif(split_part({_TAGS}, ';', 1), ''), 'general_climate_research') AS theme FROM ({_ROUTED}) WHERE bucket = 'evaluated'"


def _ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scored(spark, sf_dir).where("bucket = 'evaluated'").select("doc_id", "composite_score", "theme")
    return reports.ranked(rows, "composite_score", "doc_id")


@query("ranked_documents", f"SELECT *, row_number() OVER (ORDER BY composite_score DESC, doc_id) AS rank FROM ({_RANKED})")
def ranked_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked(spark, sf_dir).select("doc_id", "composite_score", "theme", "rank")


@query("theme_clusters", f"SELECT theme, doc_id, rank, row_number() OVER (PARTITION BY theme ORDER BY rank) AS place, min(rank) OVER (PARTITION BY theme) AS first_rank, count(*) OVER (PARTITION BY theme) AS n FROM (SELECT *, row_number() OVER (ORDER BY composite_score DESC, doc_id) AS rank FROM ({_RANKED}))")
def theme_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.theme_clusters(_ranked(spark, sf_dir), "doc_id")


_BUCKETS = ["evaluated", "manual_review", "excluded", "watchlist"]
_COUNTS = ", ".join(f"count(*) FILTER (bucket = '{b}') AS {b}" for b in _BUCKETS)


@query("source_bucket_pivot", f"SELECT source, {_COUNTS}, count(*) AS total FROM ({_ROUTED}) GROUP BY source UNION ALL SELECT 'silent', 0, 0, 0, 0, 0")
def source_bucket_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = assessed(spark, sf_dir).select(F.col("doc_id").alias("candidate_id"), "source", "bucket")
    sources = table(spark, sf_dir, "documents").select("source").distinct().unionByName(spark.createDataFrame([("silent",)], "source string"))
    return reports.source_pivot(rows, sources, _BUCKETS)


@query("run_summary", f"SELECT count(*) AS total, {_COUNTS} FROM ({_ROUTED})")
def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.run_summary(assessed(spark, sf_dir), _BUCKETS)


@query("zero_buckets", "SELECT b.bucket, b.ord, coalesce(n, 0) AS n FROM (VALUES " + ", ".join(f"('{b}', {n})" for n, b in enumerate(_BUCKETS)) + f") b(bucket, ord) LEFT JOIN (SELECT bucket, count(*) AS n FROM ({_ROUTED}) GROUP BY bucket) USING (bucket)")
def zero_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.bucket_counts(assessed(spark, sf_dir), _BUCKETS)


@query("review_rows_union", f"SELECT CAST(doc_id AS VARCHAR) AS doc_id, bucket, {_TAGS} AS tags, exclusions, CASE bucket WHEN 'evaluated' THEN 0 WHEN 'manual_review' THEN 1 ELSE 2 END AS bucket_ord FROM ({_ROUTED})".replace("exclusions, CASE bucket", "replace(exclusions, ';', '; ') AS exclusions, CASE bucket").replace(f"{_TAGS} AS tags", f"replace({_TAGS}, ';', '; ') AS tags"))
def review_rows_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = assessed(spark, sf_dir).select("doc_id", "bucket", "tags", "exclusions")
    whole = reports.with_place(rows, ["evaluated", "manual_review", "excluded"])
    return reports.review_row(whole.withColumn("o", F.col("bucket_ord")), ["doc_id", "bucket", "o"], ["tags", "exclusions"]).withColumn("bucket_ord", F.col("o").cast("int")).drop("o")


@query("regression_expected_actual", f"SELECT doc_id, CASE quality WHEN 1 THEN 'evaluated' ELSE 'excluded' END AS expected, bucket AS actual, coalesce(CASE quality WHEN 1 THEN 'evaluated' WHEN 0 THEN 'excluded' END = bucket, false) AS passed FROM ({_ROUTED}) JOIN labels USING (doc_id)")
def regression_expected_actual(spark: SparkSession, sf_dir: str) -> DataFrame:
    expected = table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("quality") == 1, "evaluated").otherwise("excluded").alias("expected"))
    actual = assessed(spark, sf_dir).select("doc_id", F.col("bucket").alias("actual"))
    return reports.expected_actual(expected, actual, "doc_id").where("expected is not null and actual is not null")


@query("normalize_keys", f"SELECT doc_id, md5(trim(regexp_replace({_FOLD}, '[\\s\\x1c-\\x1f\\x{{85}}\\x{{a0}}]+', ' ', 'g'))) AS title_key, md5(trim(regexp_replace({_FOLD}, '[^a-z0-9]+', ' ', 'g'))) AS alnum_key FROM documents")
def normalize_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.title_key(F.col("text"))).alias("title_key"), F.md5(T.alnum_key(F.col("text"))).alias("alnum_key"))


@query("extract_identifiers", "SELECT page_id, nullif(rtrim(lower(regexp_extract(html, '(?i)\\b10\\.\\d{4,9}/[-._;()/:A-Z0-9]+\\b', 0)), '.,);'), '') AS doi, nullif(regexp_extract(html, '(?i)https?://[^\\s\"''<>)]+', 0), '') AS first_url, regexp_matches(url, '^(?i)https?://[^/\\s]+') AS http FROM pages")
def extract_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", T.find_doi(F.col("html")).alias("doi"), T.first_url(F.col("html")).alias("first_url"), T.is_http(F.col("url")).alias("http"))


@query("keyed_dedup", f"SELECT min(doc_id) AS doc_id, count(*) AS copies FROM (SELECT doc_id, trim(regexp_replace({_FOLD}, '[\\s\\x1c-\\x1f\\x{{85}}\\x{{a0}}]+', ' ', 'g')) AS k FROM documents) GROUP BY k")
def keyed_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.array("doc_id").alias("ids"), F.md5(T.title_key(F.col("text"))).alias("k"))
    return dedup.keyed_dedup(docs, F.col("k"), "doc_id", "ids").select("doc_id", F.size("ids").cast("bigint").alias("copies"))


@query("first_evidence_sentence", None)
def first_evidence_sentence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.first_sentence_with(F.col("text"), ["aning", "nicht", "mente"]).alias("sentence"))


_SUPER, _COMP, _HEDGE = ["best", "first"], ["than", "versus"], ["may", "the", "en"]


@query("claim_vagueness", "SELECT doc_id, CASE WHEN NOT (contains(l, 'than') OR contains(l, 'versus')) AND contains(l, 'best') THEN 'superlative: best' WHEN NOT (contains(l, 'than') OR contains(l, 'versus')) AND contains(l, 'first') THEN 'superlative: first' WHEN NOT regexp_matches(l, '[0-9]') AND regexp_matches(l, '(^|[^\\p{L}\\p{N}_])may($|[^\\p{L}\\p{N}_])') THEN 'hedge: may' WHEN NOT regexp_matches(l, '[0-9]') AND regexp_matches(l, '(^|[^\\p{L}\\p{N}_])the($|[^\\p{L}\\p{N}_])') THEN 'hedge: the' WHEN NOT regexp_matches(l, '[0-9]') AND regexp_matches(l, '(^|[^\\p{L}\\p{N}_])en($|[^\\p{L}\\p{N}_])') THEN 'hedge: en' END AS reason FROM (SELECT doc_id, lower(text) AS l FROM documents)")
def claim_vagueness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.vague_because(F.col("text"), _SUPER, _COMP, _HEDGE).alias("reason"))


@query("claim_groups", None)
def claim_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = documents.claims(table(spark, sf_dir, "documents"), "doc_id", "text")
    status = F.when(T.vague_because(F.col("claim"), _SUPER, _COMP, _HEDGE).isNotNull(), "vague").otherwise("supported")
    return found.groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("docs"))


@query("claim_clean", "SELECT turn, count(*) AS n, count(*) FILTER (char_length(c) >= 12 AND NOT regexp_matches(lower(c), '^(see |table |figure |fig\\.|section )')) AS kept FROM (SELECT turn, trim(regexp_replace(coalesce(text, ''), '[\\s\\x1c-\\x1f\\x{85}\\x{a0}]+', ' ', 'g')) AS c FROM conversations) GROUP BY turn")
def claim_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").groupBy("turn").agg(F.count(F.lit(1)).alias("n"), F.count(T.clean_claim(F.col("text"))).alias("kept"))


@query("flag_overlay", "SELECT d.source, count(*) AS n FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.quality = 0) OR d.lang = 'de' GROUP BY d.source")
def flag_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    flagged = table(spark, sf_dir, "labels").where("quality = 0").select("doc_id").distinct().withColumn("flag", F.lit(True))
    return docs.join(flagged, "doc_id", "left").where("flag or lang = 'de'").groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query("needle_search", "SELECT source, count(*) AS n FROM documents WHERE contains(lower(text), 'license') AND contains(lower(text), 'the') GROUP BY source")
def needle_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return reports.needle_search(docs.select("doc_id", "source", "text").withColumnRenamed("source", "s"), ["License", "THE"]).groupBy(F.col("s").alias("source")).agg(F.count(F.lit(1)).alias("n"))


@query("html_to_text", None)
def html_to_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", documents.page_title(F.col("html")).alias("title"), documents.page_text(F.col("html")).alias("text"))


@query("heading_lines", None)
def heading_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", documents.page_text(F.col("html")).alias("text"))
    return documents.headings(documents.lines(pages, "page_id", "text")).where("heading is not null").select("doc_id", "n", "lo", "heading")


@query("line_offsets", "SELECT doc_id, n - 1 AS n, md5(line) AS line, coalesce(sum(char_length(line) + 1) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS lo FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents)")
def line_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.lines(table(spark, sf_dir, "documents"), "doc_id", "text").select("doc_id", F.col("n").cast("bigint").alias("n"), F.md5("line").alias("line"), F.col("lo").cast("bigint").alias("lo"))


@query("section_spans", None)
def section_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", documents.page_text(F.col("html")).alias("text"))
    return documents.sections(pages, "page_id", "text").select("doc_id", "title", "lo", "hi", F.md5("body").alias("body"))


@query(
    "chunk_windows",
    """WITH RECURSIVE w(doc_id, text, len, lo, hi) AS (
 SELECT doc_id, text, len, 0, CASE WHEN len <= 1200 THEN len WHEN cut >= 600 THEN cut + 1 ELSE 1200 END FROM (SELECT doc_id, text, char_length(text) AS len, 1200 - least(nullif(strpos(reverse(substr(text, 1, 1200)), ' '), 0), nullif(strpos(reverse(substr(text, 1, 1200)), chr(10)), 0)) AS cut FROM documents WHERE char_length(text) > 0)
 UNION ALL
 SELECT doc_id, text, len, s, CASE WHEN len - s <= 1200 THEN len WHEN cut >= 600 THEN s + cut + 1 ELSE s + 1200 END FROM (SELECT doc_id, text, len, s, 1200 - least(nullif(strpos(reverse(substr(text, s + 1, 1200)), ' '), 0), nullif(strpos(reverse(substr(text, s + 1, 1200)), chr(10)), 0)) AS cut FROM (SELECT doc_id, text, len, greatest(hi - 150, lo + 1) AS s FROM w WHERE hi < len))
) SELECT doc_id, lo, hi FROM w""",
)
def chunk_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.window_spans(table(spark, sf_dir, "documents"), "doc_id", "text")


@query("chunks", None)
def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.chunks(table(spark, sf_dir, "documents"), "doc_id", "text").select("doc_id", "n", "lo", "hi", F.md5("chunk").alias("chunk"))


@query("inverted_index_rebuild", "SELECT doc_id, md5(array_to_string(regexp_extract_all(lower(text), '[a-z0-9]+'), ' ')) AS body FROM documents")
def inverted_index_rebuild(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = documents.inverted_indexes(table(spark, sf_dir, "documents"), "doc_id", "text")
    return index.select("doc_id", F.md5(documents.rebuilt_text(F.col("index"))).alias("body"))


_TOKENS = "WITH tok AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM documents), tf AS (SELECT doc_id, term, count(*) AS tf FROM tok GROUP BY ALL), dl AS (SELECT doc_id, len(regexp_extract_all(lower(text), '[a-z0-9]+')) AS dl FROM documents), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term), n AS (SELECT count(*) AS n, avg(dl) AS mean FROM dl), raw AS (SELECT term, df, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM df, n), idf AS (SELECT term, df, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw)"


@query("bm25_stats", f"{_TOKENS} SELECT term, df, round(idf, 5) AS idf FROM idf")
def bm25_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return retrieval.bm25_terms(retrieval.term_counts(docs), docs.count()).select("term", "df", F.round("idf", 5).alias("idf"))


_BM25 = f"{_TOKENS}, q AS (SELECT DISTINCT item_id AS query_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM benchmark), s AS (SELECT query_id, doc_id, round(sum(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / mean))), 6) AS score FROM q JOIN tf USING (term) JOIN idf USING (term) JOIN dl USING (doc_id), n GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) - 1 AS rank FROM s)"


def _bm25(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    queries = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return retrieval.bm25(table(spark, sf_dir, "documents"), queries, k=k)


@query("bm25_topk", f"{_BM25} SELECT query_id, doc_id, score, rank FROM r WHERE rank < 5")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bm25(spark, sf_dir, 5).select("query_id", "doc_id", "score", F.col("rank").cast("bigint").alias("rank"))


_COS = "list_cosine_similarity(CAST(v.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))"
_VEC = f"SELECT q.vec_id AS query_id, v.vec_id, round({_COS}, 6) AS score FROM embeddings v, embeddings q WHERE q.vec_id % 50 = 0"


@query("cosine_topk", f"SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) - 1 AS rank FROM ({_VEC}) QUALIFY rank < 5")
def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    asked = vectors.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return retrieval.vector_search(vectors, asked, 5).select("query_id", "vec_id", "score", F.col("rank").cast("bigint").alias("rank"))


@query("rrf_fusion", _BM25 + f", v AS (SELECT query_id, vec_id AS doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) - 1 AS rank FROM ({_VEC})), legs AS (SELECT query_id, doc_id, rank FROM v WHERE rank < 8 UNION ALL SELECT query_id, doc_id, rank FROM r WHERE rank < 8) SELECT query_id, doc_id, round(sum(1.0 / (60 + rank)), 9) AS rrf FROM legs GROUP BY ALL")
def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    asked = vectors.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    dense = retrieval.vector_search(vectors, asked, 8).withColumnRenamed("vec_id", "doc_id")
    return retrieval.fuse([dense, _bm25(spark, sf_dir, 8)], ["query_id"], "doc_id")
