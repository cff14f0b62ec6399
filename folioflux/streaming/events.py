"""Event streams: progress counts, windows, sessions and late rows.

The batch functions take any DataFrame with ``ts``; each works on a stream as well,
given a watermark.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_events(spark: SparkSession, folder: str, pattern: str = "events.parquet") -> DataFrame:
    """The event files of a folder as a stream; time zone free stamps count as UTC."""
    schema = spark.read.parquet(f"{folder}/{pattern}").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, width: str, keys: list[str], late: str | None = None) -> DataFrame:
    rows = events.withWatermark("ts", late) if late else events
    return rows.groupBy(F.window("ts", width), *keys).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("window.start").alias("start"), *keys, "n", "total")


def sliding(events: DataFrame, width: str, step: str, keys: list[str]) -> DataFrame:
    return events.groupBy(F.window("ts", width, step), *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), *keys, "n")


def sessions(events: DataFrame, gap: str, key: str) -> DataFrame:
    """Runs of a key's events no further apart than ``gap``."""
    return events.groupBy(F.session_window("ts", gap), key).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("session_window.start").alias("start"), "n")


def split_late(events: DataFrame, days: int) -> tuple[DataFrame, DataFrame]:
    """Rows within ``days`` of the newest event, and the rest as a side output."""
    newest = events.agg(F.max("ts").alias("__newest"))
    marked = events.crossJoin(F.broadcast(newest)).withColumn("__late", F.col("ts") < F.col("__newest") - F.make_dt_interval(F.lit(days)))
    return marked.where("not __late").drop("__late", "__newest"), marked.where("__late").drop("__late", "__newest")


def run_available(stream: DataFrame, name: str, folder: str | None = None, mode: str = "complete") -> DataFrame:
    """Process what is there and stop; the result as a table below ``folder``.

    Result and checkpoint lie in the folder that executors share: the one named, or one
    of its own below ``spark.checkpoint.dir``.
    """
    from folioflux.sources.sinks import read_table, swap_in

    spark = stream.sparkSession
    root = folder or f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    write = lambda batch, _: swap_in(batch, f"{root}/result")
    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{root}/progress").outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return read_table(spark, f"{root}/result", stream.schema)


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a local folder of its own where a local master has none."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return (found or "file:///tmp/folioflux-streams").rstrip("/")


def upsert_stream(stream: DataFrame, path: str, keys: list[str], checkpoint: str) -> None:
    """Keep the last row of each key in a table (``sinks.read_table``), batch by batch.

    A batch writes a new version, so a crash leaves the one before; a batch that is
    repeated gives the same rows, as an older row never replaces a newer one.
    """
    from folioflux.sources.sinks import latest, read_table, swap_in

    def apply(batch: DataFrame, _: int) -> None:
        fresh = latest(batch, keys, [F.desc("ts")])
        old = read_table(batch.sparkSession, path, batch.schema)
        swap_in(latest(old.unionByName(fresh), keys, [F.desc("ts")]), path)

    stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def gaps(events: DataFrame, key: str) -> DataFrame:
    """Seconds since a key's event before."""
    order = Window.partitionBy(key).orderBy("ts", "event_id")
    return events.withColumn("gap_s", F.unix_seconds(F.col("ts").cast("timestamp")) - F.lag(F.unix_seconds(F.col("ts").cast("timestamp"))).over(order))
