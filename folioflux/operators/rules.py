"""The rule engine: tags, exclusions, gates, routing and scores as one projection.

Word lists are data: a :class:`Lexicons` is read from a (name, term) table or given as
a mapping, and every rule refers to lists by name.  Each rule is a column, so a whole
run stays one stage without a shuffle.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflux.functions.dates import in_month, parse_date
from folioflux.functions.text import casefold, first_sentence_with, has_any, joined, raw_hits


@dataclass
class Lexicons:
    """Named word lists, and domains as (id, terms) in order of preference."""

    lists: Mapping[str, Sequence[str]]
    domains: Sequence[tuple[str, Sequence[str]]] = ()
    fallback_topics: Sequence[tuple[str, Sequence[str]]] = ()
    labels: Mapping[str, str] = field(default_factory=dict)

    def __getitem__(self, name: str) -> Sequence[str]:
        return self.lists.get(name, ())

    @classmethod
    def from_table(cls, rows: DataFrame) -> Lexicons:
        """From columns kind ('list', 'domain' or 'topic'), name, ord, term."""
        found: dict[str, dict[str, list[str]]] = {"list": {}, "domain": {}, "topic": {}}
        for r in rows.orderBy("kind", "ord", "term").toLocalIterator():
            found[r.kind].setdefault(r.name, []).append(r.term)
        return cls(found["list"], list(found["domain"].items()), list(found["topic"].items()))


@dataclass
class Dimension:
    """One score: how it counts and what it weighs."""

    name: str
    terms: Sequence[str]
    baseline: int = 0
    weight: float = 1.0
    selects: bool = True


def _tags(text: Column, domains: Sequence[tuple[str, Sequence[str]]]) -> Column:
    if not domains:
        return F.array().cast("array<string>")
    return F.array_compact(F.array(*[F.when(has_any(text, [t.casefold() for t in terms]), F.lit(name)) for name, terms in domains]))


def domain_tags(evidence: Column, lex: Lexicons) -> Column:
    """Domains in their order; the fallback topics where no domain matches."""
    found = _tags(evidence, lex.domains)
    return F.when(F.size(found) > 0, found).otherwise(_tags(evidence, lex.fallback_topics))


def focus_domains(criteria: str | None, lex: Lexicons) -> list[str]:
    """Domains that a run's criteria name, by id, label or term; plain driver text."""
    key = lambda t: " ".join("".join(c if c.isascii() and c.isalnum() else " " for c in t.casefold()).split())
    text = key(criteria or "")
    if not text:
        return []
    return [name for name, terms in lex.domains if any(k and k in text for k in map(key, [name, lex.labels.get(name, ""), *terms]))]


def fit_texts(df: DataFrame, title: str = "title", abstract: str = "abstract", venue: str = "venue") -> DataFrame:
    """Add ``full_text`` and ``evidence``: the abstract, or title and venue without one."""
    t, a, v = F.col(title), F.col(abstract), F.col(venue)
    return df.withColumn("full_text", casefold(joined(t, a, v))).withColumn("evidence", F.when(F.length(a) > 0, casefold(a)).otherwise(casefold(joined(t, v))))


def climate_finding(text: Column, lex: Lexicons) -> Column:
    return has_any(text, lex["climate"]) & has_any(text, lex["finding"])


def exclusion_codes(df: DataFrame, lex: Lexicons, primary_types: Sequence[str], focus: Sequence[str] = ()) -> Column:
    """All codes that apply, in rule order, each once."""
    text, ev, tags = F.col("full_text"), F.col("evidence"), F.col("tags")
    t = lambda name: has_any(text, lex[name])
    e = lambda name: has_any(ev, lex[name])
    rules = [
        ("ineligible_source_type", ~F.coalesce(F.col("venue_type").isin(*primary_types, "preprint"), F.lit(False))),
        ("historical_or_formation_without_current_climate_implication", t("formation")),
        ("paleoclimate_without_current_implication", t("paleo") & ~t("contemporary")),
        ("historical_without_current_climate_implication", t("historical") & ~t("contemporary")),
        ("ambiguous_keyword_without_climate_mechanism", e("pollutant") & ~e("mechanism")),
        ("methods_only_without_substantive_climate_finding", e("methods") & ~climate_finding(ev, lex)),
        ("social_science_without_natural_science_finding", e("social") & ~e("natural")),
        ("no_evidence_of_scope_fit", ~e("climate")),
        ("no_supported_climate_impact_domain", F.size(tags) == 0),
        ("run_focus_mismatch", ~F.arrays_overlap(tags, F.array(*[F.lit(f) for f in focus])) if focus else F.lit(False)),
        ("solutions_paper", t("solutions")),
        ("ex_situ_lab", t("lab") & ~t("in_situ")),
    ]
    return F.array_compact(F.array(*[F.when(rule, F.lit(code)) for code, rule in rules]))


def gate_reason(lex: Lexicons) -> Column:
    """First reason, in order, to ask a reviewer; null where the fit is precise."""
    text, ev = F.col("full_text"), F.col("evidence")
    return (
        F.when(~has_any(text, lex["direct_lens"]), "indirect_or_incidental_climate_lens")
        .when(has_any(text, lex["tool_performance"]), "method_or_tool_performance_focus")
        .when(has_any(text, lex["adaptation"]), "adaptation_or_intervention_evaluation_focus")
        .when(has_any(text, lex["other_driver"]), "non_climate_primary_driver")
        .when(has_any(text, lex["conceptual"]), "conceptual_or_perspective_without_primary_finding")
        .when(~climate_finding(ev, lex), "substantive_climate_finding_unclear")
    )


def assess(df: DataFrame, lex: Lexicons, primary_types: Sequence[str], focus: Sequence[str] = ()) -> DataFrame:
    """Tags, exclusion codes, gate and bucket of each record with ``venue_type``.

    Buckets: preprint first, then excluded, manual_review, evaluated.
    """
    df = fit_texts(df) if "evidence" not in df.columns else df
    df = df.withColumn("tags", domain_tags(F.col("evidence"), lex))
    df = df.withColumn("exclusions", exclusion_codes(df, lex, primary_types, focus)).withColumn("gate", gate_reason(lex))
    preprint = F.coalesce((F.col("venue_type") == "preprint") | ((F.col("work_type") == "preprint") if "work_type" in df.columns else F.lit(False)), F.lit(False))
    return df.withColumn(
        "bucket", F.when(preprint, "preprint").when(F.size("exclusions") > 0, "excluded").when(F.col("gate").isNotNull(), "manual_review").otherwise("evaluated")
    ).withColumn(
        "routing_reason",
        F.when(preprint, "preprint_separate_bucket").when(F.size("exclusions") > 0, "hard_exclusion").otherwise(F.coalesce("gate", F.lit("evidence_fit_in_target_month"))),
    )


def capped(text: Column, dim: Dimension) -> Column:
    """Term hits over the baseline, five at most."""
    return F.least(F.lit(5), raw_hits(text, dim.terms) + dim.baseline)


def composite(dims: Sequence[Dimension]) -> Column:
    """Weighted sum of selecting scores, two decimals; the plain sum without weights."""
    used = [d for d in dims if d.selects]
    total = F.lit(0.0)
    for d in used:
        total = total + F.col(f"score_{d.name}") * F.lit(d.weight)
    return F.round(total, 2)


def first_list(text: Column, lists: Sequence[tuple[str, Sequence[str]]], otherwise: str) -> Column:
    """Name of the first list that has a term in the text: graded subtypes."""
    out = None
    for name, terms in lists:
        out = F.when(has_any(text, terms), name) if out is None else out.when(has_any(text, terms), name)
    return out.otherwise(otherwise) if out is not None else F.lit(otherwise)


def score(df: DataFrame, dims: Sequence[Dimension], abstract: str = "abstract") -> DataFrame:
    """Scores, composite, confidence, theme and the honourable-mention mark."""
    for d in dims:
        df = df.withColumn(f"score_{d.name}", capped(F.col("full_text"), d))
    names = {d.name for d in dims}
    df = df.withColumn("composite_score", composite(dims))
    known = F.length(F.col(abstract)) > 0
    confidence = F.when(known, "high").otherwise("medium")
    if "abstract_accessible" in df.columns:
        confidence = F.when(F.col("abstract_accessible") == F.lit(False), "low").otherwise(confidence)
    df = df.withColumn("confidence", confidence).withColumn("theme", F.coalesce(F.try_element_at("tags", F.lit(1)), F.lit("general_climate_research")))
    if {"audience", "impact"} <= names:
        df = df.withColumn("honorable_mention", (F.col("score_audience") >= 3) & (F.col("score_impact") <= 2))
    return df


def evidence_sentence(abstract: Column, title: Column, terms: Sequence[str]) -> Column:
    return first_sentence_with(F.coalesce(F.nullif(abstract, F.lit("")), title), terms)


# --- verification ------------------------------------------------------------------
def looks_like_artifact(record_type: Column, parts: Sequence[Column], types: Sequence[str], hints: Sequence[str]) -> Column:
    text = casefold(joined(*parts))
    return F.coalesce(casefold(record_type).isin(*types), F.lit(False)) | F.exists(F.array(*[F.lit(h) for h in hints]), lambda h: F.contains(text, h))


def primary_object(work_type: Column, venue_type: Column, artifact: Column, exempt: Sequence[str]) -> Column:
    """'journal_level_record', 'non_primary_research_object', or null for an article."""
    return (
        F.when(work_type == "journal_level_record", "journal_level_record")
        .when(venue_type.isin(*exempt), F.lit(None).cast("string"))
        .when((work_type == "research_artifact") | artifact, "non_primary_research_object")
    )


def date_verified(date: Column, field_name: Column, work_type: Column, canonical: Sequence[str]) -> Column:
    """A parseable date from a canonical field; an unnamed field counts as canonical."""
    named = F.when(F.coalesce(field_name, F.lit("")) == "", True).when(work_type.isin("press_lead", "research_artifact"), False).otherwise(casefold(field_name).isin(*[c.casefold() for c in canonical]))
    return F.coalesce(named, F.lit(False)) & parse_date(date).isNotNull()


def verify(df: DataFrame, month: str, canonical: Sequence[str], artifact_types: Sequence[str], artifact_hints: Sequence[str], watchlist: bool = False, exempt: Sequence[str] = ("popular_press", "institutional_data_release", "attribution_report", "preprint")) -> DataFrame:
    """Route records before scoring; the first rule that holds decides.

    Needs title, doi, venue, url, venue_type, work_type, record_type, date, date_field,
    abstract.  Adds ``bucket`` ('survivor', 'excluded' or 'manual_review') and
    ``routing_reason``.
    """
    artifact = looks_like_artifact(F.col("record_type"), [F.col(c) for c in ("title", "doi", "venue", "url")], artifact_types, artifact_hints)
    kind = primary_object(F.col("work_type"), F.col("venue_type"), artifact, exempt)
    dated = date_verified(F.col("date"), F.col("date_field"), F.col("work_type"), canonical)
    inside = in_month(parse_date(F.col("date")), F.lit(month))
    reason = (
        F.when(kind == "non_primary_research_object", kind)
        .when(kind == "journal_level_record", kind)
        .when(F.col("venue_type") == "popular_press", "popular_press_primary_unresolved")
        .when(~dated, "date_not_verified")
        .when(~inside, "non_target_month_watchlist" if watchlist else "outside_target_month")
        .when(F.coalesce(F.length("abstract"), F.lit(0)) == 0, "title_only_abstract_missing")
    )
    out = df.withColumn("routing_reason", reason)
    return out.withColumn(
        "bucket",
        F.when(F.col("routing_reason").isNull(), "survivor").when(F.col("routing_reason").isin("non_primary_research_object", "journal_level_record", "outside_target_month"), "excluded").otherwise("manual_review"),
    )


def source_kind(venue_type: Column, mention_types: Column) -> Column:
    """Own type, else the first mention's that has one, else 'unknown'."""
    named = F.filter(mention_types, lambda t: t.isNotNull() & (t != ""))
    return F.coalesce(F.nullif(venue_type, F.lit("")), F.try_element_at(named, F.lit(1)), F.lit("unknown"))


def verdict(bucket: Column) -> Column:
    return F.when(bucket.isin("evaluated", "candidate"), "Include").when(bucket.isin("manual_review", "watchlist", "preprint"), "Manual review").when(bucket == "excluded", "Exclude").otherwise("Unknown")


def access_label(open_access: Column, paywall: Column) -> Column:
    """Three-valued: what isn't said stays unknown, and open access rules out a paywall."""
    wall = F.coalesce(paywall, ~open_access)
    return F.when(open_access, "open access").when(wall, "paywalled").otherwise("unknown")


def yes_no(flag: Column) -> Column:
    return F.when(flag, "yes").when(~flag, "no").otherwise("unknown")
