"""Revisit resolution for web archives.

A not-modified revisit record holds no body: it stands for the latest earlier full
response of its canonical URL.  The lookup is an as-of join on (url key, time).  It runs
in two levels, so that a URL with very many captures is split: the log is dealt by range
of (url key, time) into slices of like row counts, whatever the spread of the times; each
slice looks up within itself, and what it hands on to the next ones of a URL is one row.

A match must agree on its validators: an ETag on both sides has to be equal (weakly),
else a Last-Modified on both sides has to be, else the payload digest.  Headers of a
304 that may update a stored response (RFC 9110, 15.4.5) replace the stored ones.

All of it is DataFrame expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflux.llm.shared_store import stored

#: Header fields that a 304 may update on the stored response.
PERMITTED = ["cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary"]
#: Captures that a task orders at once, about.
SLICE_ROWS = 200_000


def canonical_url(url: Column) -> Column:
    """Scheme and ``www.`` off, host in lower case, no default port or fragment, query
    parameters in order and without tracking ones, no closing slash.  Null stays null."""
    bare = F.regexp_replace(F.trim(url), "#.*$", "")
    bare = F.regexp_replace(bare, "^(?i)[a-z][a-z0-9+.-]*://", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(bare, "^[^/?]*", 0)), "^www[0-9]*\\.", ""), ":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(bare, "^[^/?]*([^?]*)", 1), "/+$", "")
    query = F.regexp_extract(bare, "\\?(.*)$", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike("^(?i)(utm_[a-z]+|fbclid|gclid|sessionid|jsessionid)(=|$)")))
    return F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(F.lit("")))


def _weak(etag: Column) -> Column:
    return F.regexp_replace(etag, "^W/", "")


def lower_names(headers: Column) -> Column:
    """Headers by name in lower case; of names that differ in case alone the
    last in byte order counts."""
    entries = F.array_sort(F.map_entries(F.coalesce(headers, F.create_map().cast("map<string,string>"))))
    names = F.transform(entries, lambda e: F.lower(e["key"]))
    last = lambda e, i: ~F.array_contains(F.slice(names, i + 2, F.size(names)), F.lower(e["key"]))
    return F.map_from_entries(F.transform(F.filter(entries, last), lambda e: F.struct(F.lower(e["key"]), e["value"])))


def merge_headers(kept: Column, fresh: Column) -> Column:
    """Stored headers with the permitted ones of the revisit in place of their own; names
    of both are in lower case."""
    names = F.array(*[F.lit(n) for n in PERMITTED])
    update = F.map_filter(fresh, lambda k, v: F.array_contains(names, k) & v.isNotNull())
    return F.map_concat(F.map_filter(kept, lambda k, _: ~F.array_contains(F.map_keys(update), k)), update)


def resolve_revisits(records: DataFrame, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Every revisit with the response it stands for.

    ``records``: record_id string, url string, ts timestamp, type ('response' or
    'revisit'; others are left out), status int, etag, last_modified, digest strings,
    headers map.  Result, a row per revisit: record_id, url_key, ts, target_id (null:
    none, or one without an id), target_ts, verdict ('match', 'mismatch', 'unverified'
    where no validator is on both sides, 'missing'), headers (merged where the verdict
    isn't 'missing' or 'mismatch', else the revisit's own; names in lower case, no
    headers are an empty map).

    Full responses are those with status 200.  'Earlier' is strictly so; of responses
    of one instant the largest record_id counts, then the largest validators.  A null
    url or ts finds nothing.  Repeated records give repeated rows; an empty table gives
    an empty one.  Captures of one URL at one instant stay together in a slice.

    The log is written to the shared folder twice, without bodies: as it is, and dealt
    into slices; the slices of a repeated task are hence the same.
    """
    is_full = F.coalesce((F.col("type") == "response") & (F.col("status") == 200), F.lit(False))
    base = records.where(is_full | (F.col("type") == "revisit")).select(
        "record_id", canonical_url(F.col("url")).alias("url_key"), "ts", is_full.alias("full"), "etag", "last_modified", "digest", lower_names(F.col("headers")).alias("headers")
    )
    base = stored(base, "captures")
    able = F.col("url_key").isNotNull() & F.col("ts").isNotNull()
    parts = max(int(base.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-base.count() // slice_rows))
    found = stored(base.where(able).repartitionByRange(parts, "url_key", "ts").withColumn("__slice", F.spark_partition_id()), "captures")

    names = ["ts", "record_id", "etag", "last_modified", "digest"]
    body = F.struct(*names, "headers")
    order = F.when(F.col("full"), F.struct(*names, F.array_sort(F.map_entries("headers"))))
    carried = found.groupBy("url_key", "__slice").agg(F.max_by(body, order).alias("__last"))
    before = Window.partitionBy("url_key").orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    # Slices without a full response hand on what came before them.
    handed = carried.select("url_key", "__slice", F.last("__last", ignorenulls=True).over(before).alias("__handed"))
    within = Window.partitionBy("url_key", "__slice").orderBy(F.unix_micros("ts")).rangeBetween(Window.unboundedPreceding, -1)
    looked = found.withColumn("__own", F.max_by(body, order).over(within)).where("not full")
    joined = looked.join(handed, ["url_key", "__slice"]).withColumn("__body", F.coalesce("__own", "__handed"))

    t = lambda c: F.col(f"__body.{c}")
    both = lambda c: F.col(c).isNotNull() & t(c).isNotNull()
    said = lambda same: F.when(same, "match").otherwise("mismatch")
    verdict = (
        F.when(F.col("__body").isNull(), "missing")
        .when(both("etag"), said(_weak(F.col("etag")) == _weak(t("etag"))))
        .when(both("last_modified"), said(F.col("last_modified") == t("last_modified")))
        .when(both("digest"), said(F.col("digest") == t("digest")))
        .otherwise("unverified")
    )
    merged = F.when(F.col("verdict").isin("match", "unverified"), merge_headers(t("headers"), F.col("headers"))).otherwise(F.col("headers"))
    done = joined.withColumn("verdict", verdict).select("record_id", "url_key", "ts", t("record_id").alias("target_id"), t("ts").alias("target_ts"), "verdict", merged.alias("headers"))
    lost = base.where(~able & ~F.col("full"))
    none = lost.select("record_id", "url_key", "ts", F.lit(None).cast("string").alias("target_id"), F.lit(None).cast("timestamp").alias("target_ts"), F.lit("missing").alias("verdict"), "headers")
    return done.unionByName(none)


def records_of_pages(pages: DataFrame) -> DataFrame:
    """A crawl log over the whole ``pages`` table, read once.

    Page p is fetched at second p, as a full response but for every sixth, which comes
    as a revisit.  Each page is asked for again much later, as a revisit.  A page without
    an id isn't logged.  Of the full responses every fourth has no ETag.  Revisits'
    validators follow the id: every seventh has another ETag, every fifth none; one in
    three another Last-Modified, one in three none; every second no digest.
    """
    key, html = F.col("page_id"), F.coalesce("html", F.lit(""))
    no = F.lit(None).cast("string")
    site = F.substring(F.md5(canonical_url(F.col("url"))), 1, 8)
    tag, modified = F.concat(F.lit('"'), site, F.lit('"')), F.concat(F.lit("m"), site)
    sent = F.when(F.pmod(key, F.lit(7)) == 0, F.concat(F.lit('W/"x'), site, F.lit('"'))).when(F.pmod(key, F.lit(5)) != 0, F.concat(F.lit("W/"), tag))
    since = F.when(F.pmod(key, F.lit(3)) == 0, F.concat(F.lit("x"), modified)).when(F.pmod(key, F.lit(3)) == 1, modified)

    def record(name: str, at: Column, full: Column) -> Column:
        etag = F.when(full, F.when(F.pmod(key, F.lit(4)) != 1, tag)).otherwise(sent)
        headers = F.create_map(F.lit("Date"), at.cast("string"), F.lit("ETag"), F.coalesce(etag, F.lit("none")), F.lit("Content-Length"), F.length(html).cast("string"))
        return F.struct(
            F.concat(F.lit(name), key.cast("string")).alias("record_id"), "url", F.timestamp_seconds(at).alias("ts"), F.when(full, "response").otherwise("revisit").alias("type"), F.when(full, 200).otherwise(304).alias("status"),
            etag.alias("etag"), F.when(full, modified).otherwise(since).alias("last_modified"), F.when(full | (F.pmod(key, F.lit(2)) == 1), F.sha1(html)).otherwise(no).alias("digest"), headers.alias("headers"),
        )

    both = F.array(record("a", key, F.pmod(key, F.lit(6)) != 5), record("b", key + 100_000_000, F.lit(False)))
    return pages.where(key.isNotNull()).select(F.inline(both))


def op5_revisits(pages: DataFrame) -> DataFrame:
    """A row per revisit of the log of ``pages``, with two of its headers."""
    found = resolve_revisits(records_of_pages(pages))
    return found.select("record_id", "url_key", F.unix_seconds("ts").alias("fetched"), "target_id", F.unix_seconds("target_ts").alias("target_fetched"), "verdict", F.col("headers")["etag"].alias("etag"), F.col("headers")["content-length"].alias("content_length"))


_SITE = "substring(md5(url_key), 1, 8)"
ORACLE_SQL = f"""
WITH bare AS (
  SELECT page_id, html, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^(?i)[a-z][a-z0-9+.-]*://', '') AS u FROM pages WHERE page_id IS NOT NULL
), parts AS (
  SELECT page_id, html, u,
    regexp_replace(regexp_replace(lower(regexp_extract(u, '^[^/?]*', 0)), '^www[0-9]*\\.', ''), ':(80|443)$', '') AS host,
    regexp_replace(regexp_extract(u, '^[^/?]*([^?]*)', 1), '/+$', '') AS path,
    list_sort(list_filter(string_split(regexp_extract(u, '\\?(.*)$', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(p, '^(?i)(utm_[a-z]+|fbclid|gclid|sessionid|jsessionid)(=|$)'))) AS kept
  FROM bare
), keyed AS (
  SELECT page_id, coalesce(html, '') AS html, CASE WHEN u IS NULL THEN NULL ELSE host || path || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END END AS url_key FROM parts
), tagged AS (
  SELECT page_id, html, url_key, page_id % 6 <> 5 AS is_full, CASE WHEN page_id % 4 <> 1 THEN '"' || {_SITE} || '"' END AS tag, 'm' || {_SITE} AS modified,
    CASE WHEN page_id % 7 = 0 THEN 'W/"x' || {_SITE} || '"' WHEN page_id % 5 <> 0 THEN 'W/"' || {_SITE} || '"' END AS sent,
    CASE page_id % 3 WHEN 0 THEN 'xm' || {_SITE} WHEN 1 THEN 'm' || {_SITE} END AS since,
    CASE WHEN page_id % 2 = 1 THEN sha1(html) END AS digest
  FROM keyed
), revisits AS (
  SELECT 'a' || page_id AS record_id, url_key, page_id AS fetched, sent, since, digest, html FROM tagged WHERE NOT is_full
  UNION ALL SELECT 'b' || page_id, url_key, page_id + 100000000, sent, since, digest, html FROM tagged
), full_ones AS (
  SELECT 'a' || page_id AS target_id, url_key, page_id AS target_fetched, tag, modified, html AS body FROM tagged WHERE is_full
), found AS (
  SELECT r.*, f.target_id, f.target_fetched, f.tag, f.modified, f.body FROM revisits r ASOF LEFT JOIN full_ones f ON r.url_key = f.url_key AND r.fetched > f.target_fetched
), judged AS (
  SELECT *, CASE WHEN target_id IS NULL THEN 'missing'
    WHEN sent IS NOT NULL AND tag IS NOT NULL THEN CASE WHEN regexp_replace(sent, '^W/', '') = tag THEN 'match' ELSE 'mismatch' END
    WHEN since IS NOT NULL AND modified IS NOT NULL THEN CASE WHEN since = modified THEN 'match' ELSE 'mismatch' END
    WHEN digest IS NOT NULL THEN CASE WHEN digest = sha1(body) THEN 'match' ELSE 'mismatch' END
    ELSE 'unverified' END AS verdict FROM found
)
SELECT record_id, url_key, fetched, target_id, target_fetched, verdict, coalesce(sent, 'none') AS etag,
  CAST(length(CASE WHEN verdict IN ('match', 'unverified') THEN body ELSE html END) AS VARCHAR) AS content_length
FROM judged
"""
