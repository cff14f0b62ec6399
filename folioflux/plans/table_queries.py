"""Queries over orders, events and the other star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflux.functions import dates
from folioflux.functions.similarity import sequence_ratio
from folioflux.functions.text import casefold, identity_title, normal_doi
from folioflux.operators import dedup, reports
from folioflux.plans.registry import query, table
from folioflux.sources import feeds, sinks
from folioflux.streaming import events as stream


@query("source_filter_window", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS d FROM orders WHERE o_orderstatus IN ('F', 'O') AND o_orderdate::DATE BETWEEN DATE '1996-03-01' - 45 AND DATE '1996-03-31'")
def source_filter_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    month, d = F.lit("1996-03"), F.col("o_orderdate").cast("date")
    rows = table(spark, sf_dir, "orders").where(F.col("o_orderstatus").isin("F", "O") & d.between(dates.window_start(month), dates.window_end(month)))
    return rows.select("o_orderkey", d.cast("string").alias("d"))


_TEXT_DATE = "CASE event_id % 4 WHEN 0 THEN strftime(ts, '%Y-%m-%d') WHEN 1 THEN 'garbage' WHEN 2 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') END"


@query("null_policy_windows", f"WITH e AS (SELECT event_id, try_cast(left({_TEXT_DATE}, 10) AS DATE) AS d FROM events) SELECT event_id, coalesce(d BETWEEN DATE '2024-01-05' AND DATE '2024-01-20', true) AS lenient, coalesce(d BETWEEN DATE '2024-01-05' AND DATE '2024-01-20', false) AS strict, coalesce(d BETWEEN DATE '2024-01-01' AND DATE '2024-01-31', false) AS in_month FROM e")
def null_policy_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id") % 4
    text = F.when(n == 0, F.date_format("ts", "yyyy-MM-dd")).when(n == 1, "garbage").when(n == 2, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"))
    lo, hi, d = F.lit("2024-01-05").cast("date"), F.lit("2024-01-20").cast("date"), dates.parse_date(text)
    return table(spark, sf_dir, "events").select("event_id", dates.in_window(d, lo, hi, True).alias("lenient"), dates.in_window(d, lo, hi, False).alias("strict"), dates.in_month(d, F.lit("2024-01")).alias("in_month"))


@query("doi_normalization", "SELECT p_partkey, nullif(regexp_replace(lower(trim(d)), '^(https://doi\\.org/)?(http://doi\\.org/)?(doi:)?', ''), '') AS doi FROM (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'https://doi.org/10.1/' || p_brand WHEN 1 THEN ' DOI:10.2/' || p_brand WHEN 2 THEN '' ELSE '10.3/' || p_brand END AS d FROM part)")
def doi_normalization(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, brand = F.col("p_partkey") % 4, F.col("p_brand")
    d = F.when(n == 0, F.concat(F.lit("https://doi.org/10.1/"), brand)).when(n == 1, F.concat(F.lit(" DOI:10.2/"), brand)).when(n == 2, "").otherwise(F.concat(F.lit("10.3/"), brand))
    return table(spark, sf_dir, "part").select("p_partkey", normal_doi(d).alias("doi"))


@query("ranked_supporting", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE strftime(o_orderdate, '%Y-%m-%d') END DESC, o_orderpriority DESC, o_orderkey LIMIT 50")
def ranked_supporting(spark: SparkSession, sf_dir: str) -> DataFrame:
    date = F.when(F.col("o_orderkey") % 7 != 0, F.date_format("o_orderdate", "yyyy-MM-dd"))
    return table(spark, sf_dir, "orders").orderBy(*reports.supporting_order(date, F.col("o_orderpriority"), F.col("o_orderkey"))).limit(50).select("o_orderkey", "o_totalprice")


@query("store_listing", "SELECT o_orderkey, s FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 0 THEN o_totalprice END AS s, o_orderpriority FROM orders WHERE strftime(o_orderdate, '%Y-%m') = '1997-01') ORDER BY s DESC NULLS LAST, o_orderpriority, o_orderkey LIMIT 40")
def store_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 5 != 0, F.col("o_totalprice")).alias("score"), F.concat(F.col("o_orderpriority"), F.lpad(F.col("o_orderkey").cast("string"), 12, "0")).alias("title"), F.date_format("o_orderdate", "yyyy-MM").alias("target_month"))
    return sinks.candidates(rows, "1997-01").limit(40).select("o_orderkey", F.col("score").alias("s"))


@query("query_union_distinct", "SELECT k, min(ord) AS first_seen FROM (SELECT lower(p_type) AS k, p_partkey AS ord FROM part UNION ALL SELECT upper(p_brand), 1000000000 + p_partkey FROM part) GROUP BY k")
def query_union_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    legs = part.select(F.lower("p_type").alias("k"), F.col("p_partkey").alias("ord")).unionByName(part.select(F.upper("p_brand").alias("k"), (F.col("p_partkey") + 1_000_000_000).alias("ord")))
    return dedup.keyed_dedup(legs, F.col("k"), "ord").select("k", F.col("ord").alias("first_seen"))


@query("overlap_tests", "SELECT p_partkey, list_has_any(string_split(p_name, ' '), ['red', 'blue', 'green', 'small']) AS hit, len(list_intersect(string_split(p_name, ' '), string_split(lower(p_type), ' '))) AS shared FROM part")
def overlap_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.split("p_name", " ")
    return table(spark, sf_dir, "part").select("p_partkey", F.arrays_overlap(words, F.array(*[F.lit(x) for x in ("red", "blue", "green", "small")])).alias("hit"), F.size(F.array_intersect(words, F.split(F.lower("p_type"), " "))).cast("bigint").alias("shared"))


@query("except_ids", "SELECT p_partkey AS id FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 40)")
def except_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    used = table(spark, sf_dir, "lineitem").where("l_quantity > 40").select(F.col("l_partkey").alias("id"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id")).join(used, "id", "left_anti")


@query("greedy_exact_dedup", None)
def greedy_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.md5(casefold(F.col("text"))).alias("k1"), F.md5(F.regexp_replace("text", "\\s+", "")).alias("k2"))
    return dedup.greedy_exact_dedup(rows, "doc_id", [F.col("k1"), F.col("k2")]).select("doc_id", "kept_seq")


@query("greedy_fuzzy_dedup", None)
def greedy_fuzzy_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles are first lines; the words of a line's start stand in for authors."""
    line = F.try_element_at(F.split("text", "\n"), F.lit(1))
    rows = table(spark, sf_dir, "documents").select("doc_id", line.alias("title"), F.md5(casefold(F.col("text"))).alias("doi"), F.array(F.left(line, F.lit(12)), F.right(line, F.lit(12))).alias("authors"))
    return dedup.greedy_fuzzy_dedup(rows, "doc_id", F.col("title"), F.col("doi"), F.col("authors"))


@query("artifact_to_canonical", None)
def artifact_to_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items as artefacts: the best of all articles; titles are whole first lines."""
    phrases = ["code for", "dataset for", "data for"]
    key = lambda c: identity_title(F.try_element_at(F.split(c, "\n"), F.lit(1)), phrases)
    left = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("artifact"), key(F.col("text")).alias("a"))
    right = table(spark, sf_dir, "documents").select("doc_id", key(F.col("text")).alias("c"))
    return dedup.best_articles(left, right).select("artifact", "doc_id", F.round("score", 6).alias("score"))


@query("title_ratio", None)
def title_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", F.round(sequence_ratio(F.lower("p_name"), F.lower("p_type")), 6).alias("ratio"))


@query("prior_edition_first_match", "WITH h AS (SELECT o_custkey AS k, o_orderpriority AS title, strftime(o_orderdate, '%Y-%m') AS m, o_totalprice AS s, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC NULLS LAST, o_orderpriority, strftime(o_orderdate, '%Y-%m')) AS rn FROM orders WHERE strftime(o_orderdate, '%Y-%m') <> '1996-05') SELECT o.o_orderkey, h.title AS prior_title, h.m AS prior_month, h.s AS prior_score FROM orders o LEFT JOIN h ON o.o_custkey = h.k AND h.rn = 1 WHERE strftime(o.o_orderdate, '%Y-%m') = '1996-05'")
def prior_edition_first_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").withColumn("target_month", F.date_format("o_orderdate", "yyyy-MM"))
    history = orders.select("o_custkey", F.col("o_orderpriority").alias("title"), "target_month", F.col("o_totalprice").alias("score"))
    return dedup.prior_edition(orders.where("target_month = '1996-05'"), history, "1996-05", "o_custkey").select("o_orderkey", "prior_title", "prior_month", "prior_score")


@query("upsert_latest", "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "ts")
    newest = [F.desc("ts"), F.desc("event_id")]
    old, new = rows.where("event_id % 2 = 0"), rows.where("event_id % 2 = 1")
    both = sinks.latest(old, ["user_id"], newest).unionByName(sinks.latest(new, ["user_id"], newest))
    return sinks.latest(both, ["user_id"], newest).select("user_id", "event_id", "event_type")


@query("replace_by_source", "SELECT event_type, count(*) AS n FROM (SELECT event_type FROM events WHERE user_id % 3 <> 0 UNION ALL SELECT event_type FROM events WHERE user_id % 3 = 0 AND event_id % 2 = 0) GROUP BY event_type")
def replace_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    users = rows.where("user_id % 3 = 0 and event_id % 2 = 0")
    gone = rows.where("user_id % 3 = 0").select("user_id").distinct()
    kept = sinks.replace_by(rows.join(gone, "user_id", "left_anti"), users, "user_id")
    return kept.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("manifest_expiry", "SELECT event_id, ts + INTERVAL 30 DAY AS expires_at FROM events WHERE ts + INTERVAL 30 DAY > TIMESTAMP '2024-02-15'")
def manifest_expiry(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", sinks.expires_at(F.col("ts"), 30).alias("expires_at"))
    return sinks.unexpired(rows, F.lit("2024-02-15").cast("timestamp_ntz"))


@query("json_dynamic_props", "SELECT event_type, count(*) AS n, count(DISTINCT props) AS distinct_props, sum(char_length(props)) AS chars FROM events GROUP BY event_type")
def json_dynamic_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").withColumn("v", F.try_parse_json("props"))
    valid = rows.where("props is null or v is not null")
    return valid.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("props").alias("distinct_props"), F.sum(F.char_length("props")).alias("chars"))


@query("per_group_budget_limit", "SELECT l_suppkey, l_orderkey, l_linenumber FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber) <= 6")
def per_group_budget_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feeds.group_budget(table(spark, sf_dir, "lineitem"), ["l_suppkey"], ["l_orderkey", "l_linenumber"], 50, 9).select("l_suppkey", "l_orderkey", "l_linenumber")


@query("tumbling", "SELECT time_bucket(INTERVAL 6 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return stream.tumbling(rows, "6 hours", ["event_type"]).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("progress_counts_stream", "SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def progress_counts_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event file read as a stream, until all that is there is processed."""
    counts = stream.tumbling(stream.read_events(spark, sf_dir), "1 day", ["event_type"], late="45 days")
    return stream.run_available(counts, "progress_counts").withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("sliding", "SELECT s AS start, event_type, count(*) AS n FROM (SELECT event_type, unnest([time_bucket(INTERVAL 6 HOUR, ts), time_bucket(INTERVAL 6 HOUR, ts) - INTERVAL 6 HOUR]) AS s FROM events) GROUP BY ALL")
def sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return stream.sliding(rows, "12 hours", "6 hours", ["event_type"]).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("sessions", "WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events), s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k")
def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return stream.sessions(rows, "6 hours", "user_id").withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("late_side_output", "SELECT event_type, count(*) AS n FROM events WHERE ts < (SELECT max(ts) FROM events) - INTERVAL 10 DAY GROUP BY event_type")
def late_side_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return stream.split_late(rows, 10)[1].groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("event_gaps", "SELECT user_id, max(g) AS max_gap FROM (SELECT user_id, epoch(date_trunc('second', ts))::BIGINT - lag(epoch(date_trunc('second', ts))::BIGINT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM events) GROUP BY user_id")
def event_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stream.gaps(table(spark, sf_dir, "events"), "user_id").groupBy("user_id").agg(F.max("gap_s").alias("max_gap"))
