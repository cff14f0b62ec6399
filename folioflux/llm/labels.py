"""Labelled training rows: a bounded, repeatable sample fetched to the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(mod: int, key: str = "doc_id") -> Column:
    """crc32(key as text) mod ``mod``; a null key counts as an empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))), F.lit(mod))


def known_labels(labels: DataFrame, label: str) -> DataFrame:
    """(doc_id, label) of doc_ids with one known label; contradicting ones are left out."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy("doc_id").agg(F.min(label).alias("label"), F.max(label).alias("__other"))
    return known.where("label = __other").drop("__other")


def fetch_sample(docs: DataFrame, labels: DataFrame | None, total_bytes: int, per_label: int, fold: Column) -> tuple[list[str], list]:
    """Texts and labels of up to ``per_label`` ids a label, ``total_bytes`` in all.

    Ids are taken in the order of a hash of doc_id, from rows in ``fold`` with a text
    and a label: the one in ``labels``, or ``docs.label`` where that is None.  Only whole
    texts are taken.  An id with more than a hundredth of ``total_bytes``, in all its
    rows, or with two labels is left to scoring, so an id that is repeated without end
    brings nothing to the driver.  Ids and sizes alone are joined; the texts of the
    chosen ids, bounded as said, are then read through a broadcast of these ids.
    """
    text = F.col("text").cast("string")
    rows = docs.where(fold & F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    size = F.sum(F.octet_length(text).cast("long") + 1).alias("size")
    if labels is None:
        slim = rows.groupBy("doc_id").agg(size, F.min("label").alias("label"), F.max("label").alias("__other")).where("label = __other").drop("__other")
    else:
        slim = rows.groupBy("doc_id").agg(size).join(labels, "doc_id")
    slim = slim.where(F.col("size") <= total_bytes // 100 + 1)
    slim = slim.withColumn("h", F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(11)), 2))
    counts = {r.label: (r.n, r.mean) for r in slim.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.avg("size").alias("mean")).collect()}
    if not counts:
        return [], []
    span, keep = 1 << 62, F.lit(False)
    for label, (n, mean) in counts.items():
        part = min(1.0, min(per_label, int(total_bytes / len(counts) / max(1.0, mean))) / n)
        keep = keep | ((F.col("label") == F.lit(label)) & (F.col("h") < F.lit(int(part * (span - 1)))))
    chosen = {r.doc_id: r.label for r in slim.where(keep).select("doc_id", "label").collect()}
    ids = docs.sparkSession.createDataFrame([(k,) for k in chosen], "doc_id long")
    found = rows.select("doc_id", text.alias("text")).join(F.broadcast(ids), "doc_id").collect()
    found.sort(key=lambda r: (r.doc_id, r.text))
    return [r.text for r in found], [chosen[r.doc_id] for r in found]
