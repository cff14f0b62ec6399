"""Claims: their extraction limits, verdicts, flags and citations.

Verdicts of models are landed tables; what is decided here is which of a verdict,
vagueness and a neighbour's note counts, and how rationales and citations add up.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Verdicts that say a source doesn't support a claim.
UNSUPPORTED = ["unsupported-by-source", "unsupported"]


def compose_rationale(old: Column, note: Column) -> Column:
    """``old | note``; a note that is empty or stands in ``old`` already adds nothing."""
    a, b = F.trim(F.coalesce(old, F.lit(""))), F.trim(F.coalesce(note, F.lit("")))
    return F.when(a == "", b).when((b == "") | F.contains(a, b), a).otherwise(F.concat_ws(" | ", a, b))


def _first(*options: Column | str) -> Column:
    return F.coalesce(*[F.nullif(F.trim(o), F.lit("")) if isinstance(o, Column) else F.lit(o) for o in options])


def flag_claims(claims: DataFrame, verdicts: DataFrame, vague_reason: Column, note: Column) -> DataFrame:
    """``claims`` with ``status``, ``rationale`` and ``flagged``.

    Claims: claim_id, status, rationale; verdicts (landed): claim_id, verdict, reason.  A
    verdict goes before vagueness, which counts for claims that are still supported; a
    neighbour's ``note`` is written down and never changes the status.  Claims without a
    verdict, as after a failed check, keep what they had.
    """
    landed = verdicts.groupBy("claim_id").agg(F.min(F.struct("verdict", "reason")).alias("__v"))
    rows = claims.join(landed, "claim_id", "left").withColumn("__kind", F.lower(F.trim(F.col("__v.verdict"))))
    unsupported, overstated = F.col("__kind").isin(*UNSUPPORTED), F.col("__kind") == "overstated"
    said = F.when(unsupported, F.concat(F.lit("Source-check: "), _first(F.col("__v.reason"), "not grounded in the cited source context."))).when(
        overstated, F.concat(F.lit("Overstated vs. source: "), _first(F.col("__v.reason"), "source is weaker/more hedged than the claim."))
    )
    judged = F.when(unsupported, UNSUPPORTED[0]).when(overstated, "vague").otherwise(F.col("status"))
    vague = (judged == "supported") & vague_reason.isNotNull()
    after = compose_rationale(F.col("rationale"), said)
    after = F.when(vague, compose_rationale(after, F.concat(F.lit("Vague: "), vague_reason))).otherwise(after)
    status = F.when(vague, "vague").otherwise(judged)
    return (
        rows.withColumn("__status", status)
        .withColumn("__after", compose_rationale(after, note))
        .withColumn("flagged", (F.col("__status") != "supported") | said.isNotNull() | note.isNotNull())
        .drop("status", "rationale", "__v", "__kind")
        .withColumnsRenamed({"__status": "status", "__after": "rationale"})
    )


def safe_status(claims: DataFrame, flagged: DataFrame) -> DataFrame:
    """Claims with a flag's status where there is one, else their own."""
    own = flagged.select("claim_id", F.col("status").alias("__status"))
    return claims.join(own, "claim_id", "left").withColumn("status", F.coalesce("__status", "status")).drop("__status")


def verdict_citation(quote: Column, source: Column, lo: Column, hi: Column) -> Column:
    """The verdict's quote (400 characters at most) with the context's span."""
    return F.struct(source.alias("source_slug"), lo.alias("lo"), hi.alias("hi"), F.nullif(F.left(F.trim(quote), F.lit(400)), F.lit("")).alias("quote"))


def distinct_citations(rows: DataFrame, keys: Sequence[str], seq: str, quote_chars: int = 80) -> DataFrame:
    """Citations of equal ``keys`` and the first ``quote_chars`` of the quote once: the first."""
    order = Window.partitionBy(*keys, F.left(F.coalesce("quote", F.lit("")), F.lit(quote_chars))).orderBy(seq)
    return rows.withColumn("__rn", F.row_number().over(order)).where("__rn = 1").drop("__rn")


def assemble_claims(extracted: DataFrame, sections: DataFrame, per_section: int = 12) -> DataFrame:
    """Claims of a document from its sections' extractions.

    ``extracted``: doc_id, section, n, claim; ``sections``: doc_id, section, lo, body.  The
    first ``per_section`` of a section count, equal texts once over all sections whatever
    their case; ``lo`` and ``hi`` say where the text stands in its section, null if nowhere.
    """
    place = Window.partitionBy("doc_id", "section").orderBy("n")
    rows = extracted.where("trim(coalesce(claim, '')) <> ''").withColumn("__k", F.row_number().over(place)).where(F.col("__k") <= per_section)
    once = Window.partitionBy("doc_id", F.lower("claim")).orderBy("section", "n")
    rows = rows.withColumn("__rn", F.row_number().over(once)).where("__rn = 1").drop("__rn", "__k")
    at = F.expr("instr(lower(body), lower(claim))")
    spans = rows.join(sections, ["doc_id", "section"], "left").withColumn("__at", F.when(at > 0, at - 1 + F.col("lo")))
    return spans.select("doc_id", "section", "n", "claim", F.col("__at").cast("bigint").alias("lo"), (F.col("__at") + F.char_length("claim")).cast("bigint").alias("hi"))


def or_whole_text(sections: DataFrame, docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Sections, and the whole text of a document that has none as its only section."""
    alone = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("body")).where("trim(coalesce(body, '')) <> ''").join(sections.select("doc_id"), "doc_id", "left_anti")
    return sections.select("doc_id", "section", "lo", "body").unionByName(alone.select("doc_id", F.lit(0).alias("section"), F.lit(0).cast("bigint").alias("lo"), "body"))
