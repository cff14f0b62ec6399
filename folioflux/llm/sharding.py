"""Sharding by jump consistent hashing.

The shard of a row depends on a stable key and on the number of shards alone, so no
ring table exists, and a shard added at the end takes rows from the others only into
itself: about 1/(n+1) of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

SHARDS = 8
#: Rows that one task numbers; a shard is numbered by as many tasks as it needs.
ROWS_PER_BUCKET = 20_000


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard in [0, shards) of each 64-bit key (Lamping and Veach, 2014)."""
    if shards < 1:
        raise ValueError("at least one shard is needed")
    state, at = keys.astype(np.uint64), np.zeros(len(keys), np.int64)
    live, candidate = np.arange(len(keys)), np.zeros(len(keys), np.int64)
    while len(live):
        at[live] = candidate[live]
        state[live] = state[live] * np.uint64(2862933555777941757) + np.uint64(1)
        step = float(1 << 31) / ((state[live] >> np.uint64(33)).astype(np.float64) + 1.0)
        candidate[live] = ((at[live] + 1) * step).astype(np.int64)
        live = live[candidate[live] < shards]
    return at.astype(np.int32)


def shard_of(key: Column, shards: int) -> Column:
    """Shard of a key, which counts as its text; a null key counts as an empty text."""

    @F.pandas_udf(IntegerType())
    def place(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for keys in batches:
            hashed = np.fromiter((xxhash.xxh64_intdigest((k or "").encode()) for k in keys), np.uint64, len(keys))
            yield pd.Series(jump_hash(hashed, shards))

    return place(key.cast("string"))


def assign_shards(rows: DataFrame, key: str, shards: int = SHARDS, rows_per_bucket: int = ROWS_PER_BUCKET, total: int | None = None) -> DataFrame:
    """Add ``shard``, ``slot`` (gapless from 0 within the shard) and ``grown_shard``.

    Slots come from two levels: rows are numbered within small hash buckets of each
    shard, and each bucket starts where the buckets before it end.  No task sees a
    whole shard.  Rows with equal keys share a shard and, as their order falls back on
    all other columns, only fully equal rows can swap their slots.  An empty table
    gives an empty one; a null key is the key "".
    """
    rows = rows.withColumn("shard", shard_of(F.col(key), shards)).withColumn("grown_shard", shard_of(F.col(key), shards + 1))
    total = rows.count() if total is None else total
    buckets = max(1, -(-total // (rows_per_bucket * shards)))
    order = [c for c, t in rows.dtypes if not t.startswith(("map", "variant"))]
    spread = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in order]), F.lit(buckets))
    rows = rows.withColumn("__bucket", spread)
    sizes = rows.groupBy("shard", "__bucket").agg(F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(Window.partitionBy("shard").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("shard", "__bucket", F.coalesce(before, F.lit(0)).alias("__from"))
    within = F.row_number().over(Window.partitionBy("shard", "__bucket").orderBy(*[F.col(f"`{c}`") for c in order if c not in ("shard", "grown_shard")]))
    placed = rows.withColumn("__at", within.cast("long") - 1)
    return placed.join(starts, ["shard", "__bucket"]).withColumn("slot", F.col("__at") + F.col("__from")).drop("__bucket", "__at", "__from")


def op6_shards(docs: DataFrame) -> DataFrame:
    """The whole table's digest: one row per document, also for repeated rows."""
    text = F.coalesce(F.col("text"), F.lit(""))
    slim = docs.select("doc_id", (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text).alias("text_crc32"))
    placed = assign_shards(slim, "doc_id", total=docs.count())
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
