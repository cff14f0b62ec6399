"""Stores and outputs: upserts, replacements, flat files and retention."""

from __future__ import annotations

import json
from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def latest(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key by ``order`` (newest first)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New rows replace old ones of equal key; the other old rows stay."""
    return new.unionByName(old.join(new.select(*keys).distinct(), keys, "left_anti"))


def replace_by(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """All rows of a key are replaced when ``new`` has any of it."""
    return upsert(old, new, [key])


def _fs(spark: SparkSession, path: str) -> tuple:
    to_path = spark._jvm.org.apache.hadoop.fs.Path
    return to_path(path).getFileSystem(spark._jsc.hadoopConfiguration()), to_path


def versions(spark: SparkSession, path: str) -> list[str]:
    """Finished versions of a table, oldest first."""
    fs, to_path = _fs(spark, path)
    if not fs.exists(to_path(path)):
        return []
    names = sorted(f.getPath().getName() for f in fs.listStatus(to_path(path)))
    return [n for n in names if n.startswith("v") and fs.exists(to_path(f"{path}/{n}/_SUCCESS"))]


def current(spark: SparkSession, path: str) -> str | None:
    """Folder of the last finished version; None where there is no table yet."""
    found = versions(spark, path)
    return f"{path}/{found[-1]}" if found else None


def read_table(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """The table's last finished version; empty, if a schema is given, before the first."""
    folder = current(spark, path)
    if folder is None:
        if schema is None:
            raise FileNotFoundError(path)
        return spark.createDataFrame([], schema)
    return spark.read.parquet(folder) if schema is None else spark.read.schema(schema).parquet(folder)


def swap_in(df: DataFrame, path: str, keep: int = 2, form: str = "parquet") -> str:
    """Write a new version below ``path``; it counts once its _SUCCESS mark is there.

    Nothing that readers see is deleted before: a crash at any point leaves the version
    before as the last finished one.  The last ``keep`` versions stay.
    """
    spark = df.sparkSession
    done = versions(spark, path)
    folder = f"{path}/v{int(done[-1][1:]) + 1 if done else 0:012d}"
    df.write.mode("overwrite").format(form).save(folder)
    fs, to_path = _fs(spark, path)
    for old in versions(spark, path)[:-keep]:
        fs.delete(to_path(f"{path}/{old}"), True)
    return folder


def save_graph(nodes: DataFrame, edges: DataFrame, path: str, force: bool = False) -> None:
    """JSON lines of a graph as a new version; an empty graph never follows one that
    isn't, unless forced."""
    if not force and nodes.isEmpty():
        raise ValueError("refusing to overwrite a graph with an empty one")
    rows = nodes.withColumn("kind", F.lit("node")).unionByName(edges.withColumn("kind", F.lit("edge")), allowMissingColumns=True)
    swap_in(rows, path, form="json")


def write_review(rows: DataFrame, path: str, order: list[str]) -> None:
    """A review sheet as one CSV file with a header."""
    rows.orderBy(*order).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def create_stores(spark: SparkSession, database: str = "default") -> None:
    """Tables of candidates and runs; candidates by month."""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.candidates (candidate_id STRING, title STRING, doi STRING, score DOUBLE, bucket STRING, payload STRING, updated_at TIMESTAMP, target_month STRING) USING parquet PARTITIONED BY (target_month)")
    spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.runs (run_id STRING, target_month STRING, created_at TIMESTAMP, summary STRING) USING parquet")


def candidates(store: DataFrame, month: str | None = None) -> DataFrame:
    """Best score first, unscored last, then by title."""
    rows = store.where(F.col("target_month") == month) if month else store
    return rows.orderBy(F.desc_nulls_last("score"), F.asc("title"))


def expires_at(created: Column, days: int = 30) -> Column:
    return created + F.make_dt_interval(F.lit(days))


def unexpired(manifests: DataFrame, now: Column) -> DataFrame:
    return manifests.where(F.col("expires_at").isNull() | (F.col("expires_at") > now))


def markdown_queue(claims: DataFrame, statuses: list[str]) -> DataFrame:
    """(ord, line) of a review queue: a heading with a count per status, then its claims."""
    order = F.array_position(F.array(*[F.lit(s) for s in statuses]), F.col("status")).cast("int")
    heads = claims.groupBy("status").agg(F.count(F.lit(1)).alias("n")).select(order.alias("ord"), F.lit(0).cast("bigint").alias("k"), F.concat(F.lit("## "), F.col("status"), F.lit(" ("), F.col("n").cast("string"), F.lit(")")).alias("line"))
    items = claims.select(order.alias("ord"), F.col("seq").cast("bigint").alias("k"), F.concat(F.lit("- "), F.col("claim")).alias("line"))
    return heads.unionByName(items)


MIME = {"json": "application/json", "md": "text/markdown", "csv": "text/csv", "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document"}


def mime_type(name: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in MIME.items() for x in pair])
    return F.coalesce(F.try_element_at(table, F.lower(F.regexp_extract(name, "\\.([A-Za-z0-9]+)$", 1))), F.lit("application/octet-stream"))


def safe_segment(name: Column) -> Column:
    """Names that can be one path segment."""
    return name.rlike("^[A-Za-z0-9][A-Za-z0-9._-]*$") & ~F.contains(name, F.lit(".."))


# --- reports -----------------------------------------------------------------------
def json_report(run_config: dict, buckets: DataFrame, counts: DataFrame, clusters: DataFrame) -> DataFrame:
    """(ord, line): a run as JSON lines: its configuration, counts, each record, clusters.

    A record is a line of its own, so no bucket has to fit into one row.
    """
    spark = buckets.sparkSession
    head = spark.createDataFrame([(json.dumps({"run_config": run_config}, sort_keys=True),)], "line string")
    as_line = lambda df, kind: df.select(F.to_json(F.struct(F.lit(kind).alias("kind"), *[F.col(f"`{c}`") for c in df.columns])).alias("line"))
    parts = [head, as_line(counts, "count"), as_line(buckets, "record"), as_line(clusters, "cluster")]
    return reduce(DataFrame.unionByName, [p.select(F.lit(n).alias("ord"), "line") for n, p in enumerate(parts)])


def markdown_record(scores: list[str]) -> Column:
    """A record's lines: heading, identifiers, verdict, scores that aren't zero."""
    said = lambda name, c: F.when(F.length(F.col(c).cast("string")) > 0, F.concat(F.lit(f"- {name}: "), F.col(c).cast("string")))
    shown = [F.when(F.coalesce(F.col(c), F.lit(0)) != 0, F.concat(F.lit(f"- {c}: "), F.col(c).cast("string"))) for c in scores]
    lines = F.array(F.concat(F.lit("### "), F.coalesce(F.nullif(F.col("title"), F.lit("")), F.lit("Untitled"))), said("DOI", "doi"), said("Source", "source"), said("Reason", "routing_reason"), *shown)
    return F.array_join(F.array_compact(lines), "\n")


def markdown_report(title: str, rows: DataFrame, buckets: list[str], scores: list[str], seq: str = "seq") -> DataFrame:
    """(ord, k, line): a heading with a count per bucket, those without rows too, and its
    records in order."""
    place = F.array_position(F.array(*[F.lit(b) for b in buckets]), F.col("bucket")).cast("int")
    spark = rows.sparkSession
    top = spark.createDataFrame([(0, -1, f"# {title}")], "ord int, k bigint, line string")
    names = spark.createDataFrame([(n + 1, b) for n, b in enumerate(buckets)], "ord int, bucket string")
    counts = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    n = F.coalesce("n", F.lit(0))
    heads = names.join(counts, "bucket", "left").select("ord", F.lit(-1).cast("bigint").alias("k"), F.concat(F.lit("## "), F.col("bucket"), F.lit(" ("), n.cast("string"), F.lit(")")).alias("line"))
    body = rows.where(place > 0).select(place.alias("ord"), F.col(seq).cast("bigint").alias("k"), markdown_record(scores).alias("line"))
    return top.unionByName(heads).unionByName(body)


def source_breakdown(pivot: DataFrame, configured: DataFrame) -> DataFrame:
    """A pivot in the order of (source, ord), then sources that aren't configured by name."""
    placed = pivot.join(configured.groupBy("source").agg(F.min("ord").alias("__ord")), "source", "left")
    return placed.orderBy(F.asc_nulls_last("__ord"), "source").drop("__ord")


def write_lines(rows: DataFrame, path: str, order: list[str]) -> None:
    """Lines in order as text."""
    rows.orderBy(*order).select("line").coalesce(1).write.mode("overwrite").text(path)


def append_log(spark: SparkSession, path: str, line: str) -> None:
    spark.createDataFrame([(line,)], "line string").coalesce(1).write.mode("append").text(path)


def manifest(run_id: str, month: str, folder: str, names: list[str], created: str, days: int = 30) -> dict:
    """What a run left: artefacts with type and link, and when they expire."""
    made = datetime.fromisoformat(created)
    kinds = [MIME.get(n.rsplit(".", 1)[-1].lower(), "application/octet-stream") for n in names]
    artifacts = [{"name": n, "path": f"{folder}/{n}", "content_type": k, "url": f"/runs/{run_id}/artifacts/{n}"} for n, k in zip(names, kinds, strict=True)]
    return {"run_id": run_id, "target_month": month, "created_at": created, "expires_at": (made + timedelta(days=days)).isoformat(), "artifacts": artifacts}


def public_manifest(manifests: DataFrame) -> DataFrame:
    """Manifests without requesters and paths."""
    links = F.transform("artifacts", lambda a: F.struct(a["name"].alias("name"), F.concat(F.lit("/runs/"), F.col("run_id"), F.lit("/artifacts/"), a["name"]).alias("url")))
    return manifests.select("run_id", "target_month", "created_at", "expires_at", links.alias("artifacts"))


def artifact_named(manifests: DataFrame, run_id: str, name: str) -> DataFrame:
    """A run's artefacts of a file name, if the name can be one."""
    found = manifests.where(F.col("run_id") == run_id).select("run_id", F.explode("artifacts").alias("a")).select("run_id", "a.*")
    return found.where((F.col("name") == name) & safe_segment(F.col("name")))


def write_bundle(reports: dict[str, DataFrame], folder: str, run_id: str, month: str, created: str) -> dict:
    """Each report below ``folder``, then the manifest: a bundle without one isn't finished."""
    if not run_id or "/" in run_id or ".." in run_id:
        raise ValueError("a run's id must be one path segment")
    spark = next(iter(reports.values())).sparkSession
    for name, rows in reports.items():
        target = f"{folder}/{run_id}/{name}"
        if name.endswith(".csv"):
            rows.coalesce(1).write.mode("overwrite").option("header", True).csv(target)
        elif "line" in rows.columns:
            write_lines(rows, target, [c for c in ("ord", "k") if c in rows.columns])
        else:
            rows.coalesce(1).write.mode("overwrite").json(target)
    out = manifest(run_id, month, f"{folder}/{run_id}", sorted(reports), created)
    spark.createDataFrame([(json.dumps(out, sort_keys=True),)], "line string").coalesce(1).write.mode("overwrite").text(f"{folder}/{run_id}/manifest")
    return out


def prune_expired(spark: SparkSession, folder: str, now: str) -> list[str]:
    """Delete runs whose manifest has expired by ``now``; gives their ids.

    Runs without a readable manifest or expiry stay.
    """
    schema = "run_id string, expires_at timestamp"
    fs, to_path = _fs(spark, folder)
    if not fs.exists(to_path(folder)):
        return []
    rows = spark.read.schema(schema).json(f"{folder}/*/manifest").where(F.col("expires_at") <= F.lit(now).cast("timestamp"))
    gone = sorted(r.run_id for r in rows.where(safe_segment(F.col("run_id"))).select("run_id").distinct().toLocalIterator())
    for run_id in gone:
        fs.delete(to_path(f"{folder}/{run_id}"), True)
    return gone


#: From which strength on a connection is high or medium.
HIGH, MEDIUM = 0.6, 0.30


def confidence_band(strength: Column) -> Column:
    return F.when(strength >= HIGH, "high").when(strength >= MEDIUM, "medium").otherwise("low")


def narrated(paths: DataFrame, prose: DataFrame, line: Column) -> DataFrame:
    """Paths with landed prose by ``path_index``; ``line`` where there is none."""
    said = prose.groupBy("path_index").agg(F.min("prose").alias("__prose"))
    return paths.join(said, "path_index", "left").withColumn("narration", F.coalesce(F.nullif(F.trim("__prose"), F.lit("")), line)).drop("__prose")


def applicability_page(title: str, date: str, paths: DataFrame) -> DataFrame:
    """(ord, k, line): front matter, then a section for each path, strongest first."""
    spark = paths.sparkSession
    heads = [(0, n, x) for n, x in enumerate(["---", f"title: {json.dumps(title)}", f"date: {date}", "type: applicability", "---", "", f"# {title}"])]
    body = paths.select(F.lit(1).alias("ord"), F.col("path_index").cast("bigint").alias("k"), F.concat(F.lit("## "), F.col("end"), F.lit(" ("), confidence_band(F.col("strength")), F.lit(")\n"), F.col("narration")).alias("line"))
    return spark.createDataFrame(heads, "ord int, k bigint, line string").unionByName(body)


def window_label(start: Column, end: Column) -> Column:
    """'2024-01-05 to 2024-01-20', one end where the other is unknown."""
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    return F.coalesce(F.concat(day(start), F.lit(" to "), day(end)), F.concat(F.lit("from "), day(start)), F.concat(F.lit("until "), day(end)), F.lit("any date"))


def ingest_counters(rows: DataFrame, edges: DataFrame, chunk_table: DataFrame, claims: DataFrame) -> DataFrame:
    """One row: nodes, merged ones, edges, chunks, claims and flagged ones."""
    nodes = rows.agg(F.count(F.lit(1)).alias("nodes"), F.count_if(F.col("outcome") == "merge").alias("merged"))
    flagged = claims.agg(F.count(F.lit(1)).alias("claims"), F.count_if(F.col("status") != "supported").alias("flagged"))
    counted = [nodes, edges.agg(F.count(F.lit(1)).alias("edges")), chunk_table.agg(F.count(F.lit(1)).alias("chunks")), flagged]
    return reduce(lambda a, b: a.join(b, F.lit(True)), counted)
