"""What a run reports: counts, pivots, clusters, rankings and flat review rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = ["candidate", "preprint", "watchlist", "manual_review", "excluded"]


def run_summary(rows: DataFrame, buckets: Sequence[str] = BUCKETS) -> DataFrame:
    """One row: total and a count for each bucket."""
    return rows.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("bucket") == b).alias(b) for b in buckets])


def bucket_counts(rows: DataFrame, buckets: Sequence[str] = BUCKETS) -> DataFrame:
    """A row per bucket, those without rows too."""
    names = rows.sparkSession.createDataFrame([(b, n) for n, b in enumerate(buckets)], "bucket string, ord int")
    counts = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    return names.join(counts, "bucket", "left").select("bucket", "ord", F.coalesce("n", F.lit(0)).alias("n"))


def source_pivot(mentions: DataFrame, sources: DataFrame, buckets: Sequence[str] = BUCKETS) -> DataFrame:
    """Sources by bucket from (candidate_id, source, bucket): a candidate counts once for
    each source; silent sources have a row of zeros."""
    once = mentions.select("candidate_id", F.coalesce("source", F.lit("unattributed")).alias("source"), "bucket").distinct()
    counts = once.groupBy("source").agg(*[F.count_if(F.col("bucket") == b).alias(b) for b in buckets], F.count_if(F.col("bucket") != "source_error").alias("total"))
    return sources.select("source").join(counts, "source", "full").na.fill(0, [*buckets, "total"])


def ranked(rows: DataFrame, score: str, seq: str) -> DataFrame:
    """Add ``rank`` by score, best first; a null score counts as 0, ties keep their order.

    Rows are placed by range, numbered within their range, and moved up by the rows of
    the ranges before, so no task sorts the whole table.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    can = rows.sparkSession.sparkContext.getCheckpointDir()
    rows = rows.checkpoint() if can else rows.persist()  # placing by range reads its rows twice
    placed = rows.withColumn("__s", F.coalesce(F.col(score).cast("double"), F.lit(0.0))).repartitionByRange(parts, F.desc("__s"), F.asc(seq)).withColumn("__part", F.spark_partition_id())
    placed = placed.checkpoint() if can else placed.persist()
    sizes = placed.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("__part", before.alias("__before"))
    within = F.row_number().over(Window.partitionBy("__part").orderBy(F.desc("__s"), seq))
    return placed.withColumn("__rn", within).join(F.broadcast(starts), "__part").withColumn("rank", (F.col("__rn") + F.col("__before")).cast("bigint")).drop("__s", "__part", "__rn", "__before")


def theme_clusters(rows: DataFrame, item: str, theme: str = "theme", rank: str = "rank") -> DataFrame:
    """A row for each member of a theme: its place in it, and the theme's first rank and
    size.  A theme of any size is many rows, never one array."""
    place = Window.partitionBy(theme).orderBy(rank)
    sizes = rows.groupBy(theme).agg(F.min(rank).alias("first_rank"), F.count(F.lit(1)).alias("n"))
    return rows.select(theme, item, rank, F.row_number().over(place).cast("bigint").alias("place")).join(sizes, theme)


def supporting_order(date: Column, title: Column, seq: Column) -> list[Column]:
    """Newest first, undated last, then titles backwards; equal rows keep their order."""
    return [F.desc(F.coalesce(date, F.lit(""))), F.desc(title), F.asc(seq)]


def union_buckets(frames: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    """Rows of several buckets under one schema, with ``bucket`` and its place."""
    out = None
    for n, (bucket, frame) in enumerate(frames):
        one = frame.withColumn("bucket", F.lit(bucket)).withColumn("bucket_ord", F.lit(n))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def with_place(rows: DataFrame, buckets: Sequence[str]) -> DataFrame:
    """Rows of some buckets with ``bucket_ord``, the bucket's place: ``union_buckets`` of
    one table's buckets, in one pass.  A generator keeps the rules from being evaluated
    once more, in a filter."""
    place = F.array_position(F.array(*[F.lit(b) for b in buckets]), F.coalesce("bucket", F.lit(""))).cast("int") - 1
    return rows.withColumn("bucket_ord", F.explode(F.when(place >= 0, F.array(place))))


def review_row(df: DataFrame, scalars: Sequence[str], arrays: Sequence[str], maps: Sequence[str] = (), scores: Sequence[str] = ()) -> DataFrame:
    """Flat text columns: arrays by '; ', maps as 'key: value', zero scores empty."""
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in scalars]
    cells += [F.coalesce(F.array_join(c, "; "), F.lit("")).alias(c) for c in arrays]
    cells += [F.coalesce(F.array_join(F.transform(F.map_entries(c), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "; "), F.lit("")).alias(c) for c in maps]
    cells += [F.when(F.coalesce(F.col(c), F.lit(0)) == 0, "").otherwise(F.col(c).cast("string")).alias(c) for c in scores]
    return df.select(*cells)


def needle_search(df: DataFrame, needles: Sequence[str]) -> DataFrame:
    """Rows whose JSON holds every needle, whatever the case."""
    body = F.lower(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])))
    keep = F.lit(True)
    for needle in needles:
        keep = keep & F.contains(body, F.lit(needle.lower()))
    return df.where(keep)


def expected_actual(expected: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """(key, expected, actual, passed), rows missing on either side included."""
    out = expected.join(actual, key, "full")
    return out.withColumn("passed", F.coalesce(F.col("expected") == F.col("actual"), F.lit(False)))


def ordered_union(*lists: Sequence[str]) -> list[str]:
    """Queries in order, each once whatever its case."""
    seen: dict[str, str] = {}
    for text in (t for one in lists for t in one):
        if key := " ".join(text.casefold().split()):
            seen.setdefault(key, text)
    return list(seen.values())
