"""Candidate records on their way through a run: work types, press, access and audit.

Each step is a projection or one equi-join; arrays hold a record's own mentions only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflux.functions.text import casefold, normal_doi

# Venue types that are a work type of their own, and what others become.
WORK_OF_VENUE = {
    "peer_reviewed_journal": "peer_reviewed_journal_article",
    "attribution_report": "attribution_report",
    "institutional_data_release": "institutional_data_release",
    "preprint": "preprint",
    "popular_press": "press_lead",
}
PDF_MAGIC = b"%PDF"
_MENTION = "array<struct<source:string,url:string,date_seen:string,source_type:string,note:string>>"
_COVERAGE = "array<struct<outlet:string,url:string,headline:string,date:string,verified:boolean,verification_note:string>>"


def work_type(given: Column, venue_type: Column, record_type: Column, artifact: Column, journal_types: Sequence[str], article_types: Sequence[str]) -> Column:
    """A given type stays; else artefact, journal-level record, the venue's, or article."""
    record = casefold(F.coalesce(record_type, F.lit("")))
    out = F.when(F.length(given) > 0, given).when(artifact, "research_artifact").when(record.isin(*journal_types), "journal_level_record")
    for venue, kind in WORK_OF_VENUE.items():
        out = out.when(venue_type == venue, kind)
    return out.when(record.isin(*article_types), "peer_reviewed_journal_article").otherwise("unknown")


def is_preprint() -> Column:
    flags = F.coalesce(F.array_contains("exclusions", "preprint_bucket"), F.lit(False))
    same = lambda c, v: F.coalesce(F.col(c) == v, F.lit(False))
    return same("venue_type", "preprint") | same("work_type", "preprint") | same("routing_reason", "preprint_separate_bucket") | flags


def split_preprints(excluded: DataFrame, explicit: DataFrame, key: str = "candidate_id") -> tuple[DataFrame, DataFrame]:
    """(preprints, rest): the explicit ones and those among the excluded, each id once."""
    found = excluded.where(is_preprint()).withColumn("routing_reason", F.coalesce(F.nullif(F.col("routing_reason"), F.lit("")), F.lit("preprint_separate_bucket")))
    new = found.join(explicit.select(key), key, "left_anti").dropDuplicates([key])
    return explicit.unionByName(new, allowMissingColumns=True), excluded.where(~is_preprint())


def split_watchlist(manual: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(watchlist, rest) of the rows for manual review."""
    watched = (F.length(F.coalesce("watchlist_reason", F.lit(""))) > 0) | (F.coalesce("routing_reason", F.lit("")) == "non_target_month_watchlist")
    return manual.where(watched), manual.where(~watched)


def first_version(rows: DataFrame, version: str, seq: str) -> DataFrame:
    """One row: the first version that is stated."""
    return rows.agg(F.min_by(version, F.when(F.length(version) > 0, F.col(seq))).alias(version))


# --- notes on a record -------------------------------------------------------------
def with_audit(trail: Column, agent: str, action: str, detail: Column, stamp: Column) -> Column:
    """The audit trail with one entry more."""
    entry = F.struct(F.lit(agent).alias("agent"), stamp.cast("string").alias("timestamp"), F.lit(action).alias("action"), detail.cast("string").alias("detail"))
    return F.concat(F.coalesce(trail, F.array().cast("array<struct<agent:string,timestamp:string,action:string,detail:string>>")), F.array(entry))


def with_missing(reasons: Column, name: str, reason: Column) -> Column:
    """The map of missing fields; a later reason replaces an earlier one."""
    own = F.map_filter(F.coalesce(reasons, F.create_map().cast("map<string,string>")), lambda k, _: k != name)
    return F.map_concat(own, F.create_map(F.lit(name), reason))


def with_exclusion(codes: Column, code: Column) -> Column:
    """The codes with ``code`` at the end, unless they hold it; null adds nothing."""
    own = F.coalesce(codes, F.array().cast("array<string>"))
    return F.when(code.isNull() | F.array_contains(own, code), own).otherwise(F.array_append(own, code))


# --- press -------------------------------------------------------------------------
def attach_press(coverage: Column, mentions: Column, title: Column, press_types: Sequence[str], verified: bool, note: str) -> Column:
    """Coverage with the press mentions whose url it lacks, the first of each url."""
    own = F.coalesce(coverage, F.array().cast(_COVERAGE))
    press = F.filter(F.coalesce(mentions, F.array().cast(_MENTION)), lambda m: m["source_type"].isin(*press_types) & (F.length(m["url"]) > 0))
    urls = F.array_except(F.transform(press, lambda m: m["url"]), F.transform(own, lambda c: c["url"]))

    def as_coverage(url: Column) -> Column:
        m = F.element_at(F.filter(press, lambda x: x["url"] == url), 1)
        return F.struct(m["source"].alias("outlet"), url.alias("url"), title.alias("headline"), m["date_seen"].alias("date"), F.lit(verified).alias("verified"), F.lit(note).alias("verification_note"))

    return F.concat(own, F.transform(urls, as_coverage))


def resolve_press(rows: DataFrame, press_types: Sequence[str], found_doi: Column) -> DataFrame:
    """Press records with a DOI become journal records that point to the work.

    ``primary_resolved`` is true for them and for records that weren't press.  Others stay
    press; they are also the list for manual review.
    """
    press = F.col("venue_type").isin(*press_types)
    doi = F.when(press, F.coalesce(normal_doi(F.col("doi")), found_doi))
    url = F.concat(F.lit("https://doi.org/"), doi)
    mention = F.array(F.struct(F.lit("Primary Source Resolver").alias("source"), url.alias("url"), F.lit(None).cast("string").alias("date_seen"), F.lit("peer_reviewed_journal").alias("source_type"), F.lit("Primary study inferred from DOI in press item.").alias("note")))
    solved = press & doi.isNotNull()
    own = F.coalesce(F.col("mentions"), F.array().cast(_MENTION))
    return rows.select(
        *[c for c in rows.columns if c not in ("doi", "url", "venue_type", "mentions")],
        F.when(solved, doi).otherwise(F.col("doi")).alias("doi"),
        F.when(solved, url).otherwise(F.col("url")).alias("url"),
        F.when(solved, "peer_reviewed_journal").otherwise(F.col("venue_type")).alias("venue_type"),
        F.when(solved, F.concat(own, mention)).otherwise(own).alias("mentions"),
        (solved | ~press).alias("primary_resolved"),
    )


# --- access ------------------------------------------------------------------------
def is_pdf(content: Column) -> Column:
    """Whether a payload starts as a PDF does; null and short ones don't."""
    return F.coalesce(F.substring(content, 1, len(PDF_MAGIC)) == F.lit(PDF_MAGIC), F.lit(False))


def open_access(rows: DataFrame, lookup: DataFrame) -> DataFrame:
    """``rows`` with what a landed look-up (doi, is_oa, journal_name, pdf_url, page_url)
    says; records that it doesn't hold stay as they are.  The look-up's first DOI counts."""
    found = lookup.select(normal_doi(F.col("doi")).alias("__doi"), "is_oa", "journal_name", "pdf_url", "page_url").where("__doi is not null").groupBy("__doi").agg(F.min(F.struct("is_oa", "journal_name", "pdf_url", "page_url")).alias("__oa"))
    joined = rows.withColumn("__doi", normal_doi(F.col("doi"))).join(found, "__doi", "left")
    hit = F.col("__oa").isNotNull()
    oa = F.coalesce(F.col("__oa.is_oa"), F.lit(False))
    return (
        joined.withColumn("open_access", F.when(hit, oa).otherwise(F.col("open_access")))
        .withColumn("paywall", F.when(hit, ~oa).otherwise(F.col("paywall")))
        .withColumn("venue", F.coalesce(F.nullif(F.col("venue"), F.lit("")), "__oa.journal_name"))
        .withColumn("full_text_pdf_url", F.coalesce("__oa.pdf_url", F.col("full_text_pdf_url"), "__oa.page_url"))
        .withColumn("access_checked", hit)
        .drop("__doi", "__oa")
    )
