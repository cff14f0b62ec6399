"""The monthly run: candidates in, ranked and routed records and their reports out."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflux.functions.dates import parse_date
from folioflux.functions.text import resolve_doi
from folioflux.operators import dedup, reports, rules


@dataclass
class RunConfig:
    """What a run needs besides its rows; lists are data."""

    month: str
    lexicons: rules.Lexicons
    dimensions: Sequence[rules.Dimension]
    primary_types: Sequence[str]
    canonical_dates: Sequence[str] = ("published-online", "published-print", "publication_date", "publicationDate")
    artifact_types: Sequence[str] = ()
    artifact_hints: Sequence[str] = ()
    criteria: str | None = None
    watchlist: bool = False
    press_types: Sequence[str] = field(default_factory=lambda: ["popular_press"])


def prepare(candidates: DataFrame) -> DataFrame:
    """Identifiers resolved, press items with a DOI retyped as journal records."""
    found = resolve_doi(F.col("doi"), F.col("url"), F.col("title"))
    rows = candidates.withColumn("doi", found)
    return rows.withColumn("venue_type", F.when((F.col("venue_type") == "popular_press") & F.col("doi").isNotNull(), "journal").otherwise(F.col("venue_type")))


def monthly_run(candidates: DataFrame, config: RunConfig, history: DataFrame | None = None) -> DataFrame:
    """One row per candidate with ``bucket``, ``routing_reason``, tags, scores and rank.

    Needs seq, title, doi, url, authors, venue, venue_type, work_type, record_type, date,
    date_field, abstract, source.  The order of rules is verification, duplicates,
    assessment, scores; a row keeps the first verdict.
    """
    rows = prepare(candidates)
    checked = rules.verify(rows, config.month, config.canonical_dates, config.artifact_types, config.artifact_hints, config.watchlist).checkpoint()
    alive = checked.where("bucket = 'survivor'")
    kept = dedup.greedy_fuzzy_dedup(alive, "seq", F.col("title"), F.col("doi"), F.col("authors"))
    alive = alive.join(kept, "seq")
    copies = alive.where("kept <> seq").withColumn("bucket", F.lit("excluded")).withColumn("routing_reason", F.lit("duplicate")).drop("kept")
    focus = rules.focus_domains(config.criteria, config.lexicons)
    judged = rules.assess(alive.where("kept = seq").drop("kept", "bucket", "routing_reason"), config.lexicons, config.primary_types, focus)
    scored = rules.score(judged.where("bucket = 'evaluated'"), config.dimensions)
    scored = reports.ranked(scored, "composite_score", "seq")
    if history is not None:
        scored = dedup.prior_editions(scored, history, config.month)
    out = scored
    for part in (judged.where("bucket <> 'evaluated'"), copies, checked.where("bucket <> 'survivor'")):
        out = out.unionByName(part, allowMissingColumns=True)
    return out.drop("full_text", "evidence", "gate")


def run_reports(result: DataFrame, sources: DataFrame) -> dict[str, DataFrame]:
    """Summary, source pivot, clusters and the review sheet of a run."""
    buckets = ["evaluated", "preprint", "manual_review", "excluded"]
    return {
        "summary": reports.run_summary(result, buckets),
        "sources": reports.source_pivot(result.select(F.col("seq").alias("candidate_id"), "source", "bucket"), sources, buckets),
        "clusters": reports.theme_clusters(result.where("bucket = 'evaluated'"), "seq"),
        "review": reports.review_row(result, ["seq", "title", "doi", "bucket", "routing_reason"], ["tags", "exclusions"], scores=["composite_score"]),
    }


def month_rows(store: DataFrame, month: str) -> DataFrame:
    return store.where(F.date_format(parse_date(F.col("date")), "yyyy-MM") == month)
