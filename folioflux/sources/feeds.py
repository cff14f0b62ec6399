"""Landed source payloads as candidate rows.

Calls to services are outside the engine: their answers are landed as files and read
here.  Every reader gives the columns of ``CANDIDATE``; a row without a title is none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioflux.functions.dates import best_harvest_date, date_of_parts, in_window, parse_date
from folioflux.functions.text import collapse, normal_doi, strip_tags
from folioflux.operators.dedup import keyed_dedup, record_key
from folioflux.operators.documents import rebuilt_text
from folioflux.sources.sinks import current

CANDIDATE = ["title", "doi", "authors", "venue", "url", "abstract", "date", "date_field", "record_type", "open_access", "source"]


def _candidates(df: DataFrame, source: str, **columns: Column) -> DataFrame:
    columns.setdefault("open_access", F.lit(None).cast("boolean"))
    columns["source"] = F.lit(source)
    out = df.select(*[columns[c].alias(c) for c in CANDIDATE])
    return out.withColumn("title", F.nullif(collapse("title"), F.lit(""))).where("title is not null")


WORKS_SCHEMA = "results array<struct<id:string,title:string,doi:string,type:string,publication_date:string,authorships:array<struct<author:struct<display_name:string>>>,primary_location:struct<landing_page_url:string,source:struct<display_name:string>>,open_access:struct<is_oa:boolean>,abstract_inverted_index:map<string,array<int>>>>"


def read_works(spark: SparkSession, path: str, source: str = "works") -> DataFrame:
    """Pages of a works API with inverted abstracts."""
    r = spark.read.schema(WORKS_SCHEMA).option("multiLine", True).json(path).select(F.explode("results").alias("r"))
    return _candidates(
        r, source, title=F.col("r.title"), doi=normal_doi(F.col("r.doi")), authors=F.array_compact(F.transform("r.authorships", lambda a: a["author"]["display_name"])),
        venue=F.col("r.primary_location.source.display_name"), url=F.coalesce("r.primary_location.landing_page_url", "r.id"), abstract=rebuilt_text(F.col("r.abstract_inverted_index")),
        date=F.col("r.publication_date"), date_field=F.lit("publication_date"), record_type=F.col("r.type"), open_access=F.col("r.open_access.is_oa"),
    )


_PARTS = "struct<`date-parts`:array<array<int>>>"
REGISTRY_SCHEMA = f"message struct<items:array<struct<DOI:string,title:array<string>,author:array<struct<given:string,family:string>>,`published-online`:{_PARTS},`published-print`:{_PARTS},`container-title`:array<string>,URL:string,abstract:string,type:string>>>"


def read_registry(spark: SparkSession, path: str, source: str = "registry") -> DataFrame:
    """Pages of a DOI registry; the online date goes before the printed one."""
    r = spark.read.schema(REGISTRY_SCHEMA).option("multiLine", True).json(path).select(F.explode("message.items").alias("r"))

    def date(name: str) -> Column:
        parts = F.try_element_at(F.col(f"r.`{name}`.`date-parts`"), F.lit(1))
        at = lambda k: F.try_element_at(parts, F.lit(k))
        return date_of_parts(at(1), at(2), at(3)).cast("string")

    online, printed = date("published-online"), date("published-print")
    return _candidates(
        r, source, title=F.try_element_at("r.title", F.lit(1)), doi=normal_doi(F.col("r.DOI")), authors=F.filter(F.transform("r.author", lambda a: F.trim(F.concat_ws(" ", a["given"], a["family"]))), lambda a: a != ""),
        venue=F.try_element_at("r.`container-title`", F.lit(1)), url=F.col("r.URL"), abstract=F.nullif(strip_tags(F.col("r.abstract")), F.lit("")), date=F.coalesce(online, printed),
        date_field=F.when(online.isNotNull(), "published-online").when(printed.isNotNull(), "published-print"), record_type=F.col("r.type"),
    )


SCHOLAR_SCHEMA = "data array<struct<title:string,authors:array<struct<name:string>>,year:int,publicationDate:string,venue:string,externalIds:struct<DOI:string>,url:string,abstract:string,isOpenAccess:boolean>>"


def read_scholar(spark: SparkSession, path: str, start: str | None = None, end: str | None = None, source: str = "scholar") -> DataFrame:
    """Pages of a search API that can't filter dates: filtered here, undated rows pass."""
    r = spark.read.schema(SCHOLAR_SCHEMA).option("multiLine", True).json(path).select(F.explode("data").alias("r"))
    out = _candidates(
        r, source, title=F.col("r.title"), doi=normal_doi(F.col("r.externalIds.DOI")), authors=F.array_compact(F.transform("r.authors", lambda a: a["name"])), venue=F.col("r.venue"), url=F.col("r.url"),
        abstract=F.col("r.abstract"), date=F.col("r.publicationDate"), date_field=F.lit("publicationDate"), record_type=F.lit(None).cast("string"), open_access=F.col("r.isOpenAccess"),
    )
    return _windowed(out, start, end, null_passes=True)


def _windowed(df: DataFrame, start: str | None, end: str | None, null_passes: bool) -> DataFrame:
    if not (start and end):
        return df
    return df.where(in_window(parse_date(F.col("date")), F.lit(start).cast("date"), F.lit(end).cast("date"), null_passes))


HARVEST_SCHEMA = "header struct<datestamp:string>, metadata struct<dc:struct<title:array<string>,creator:array<string>,date:array<string>,description:array<string>,identifier:array<string>>>"


def read_harvest(spark: SparkSession, path: str, start: str, end: str, source: str = "harvest") -> DataFrame:
    """Harvested Dublin Core records (XML, namespaces dropped); undated rows go."""
    r = spark.read.format("xml").option("rowTag", "record").option("ignoreNamespace", True).schema(HARVEST_SCHEMA).load(path)
    dc, lo, hi = "metadata.dc.", F.lit(start).cast("date"), F.lit(end).cast("date")
    ids = F.coalesce(F.col(dc + "identifier"), F.array().cast("array<string>"))
    doi = F.try_element_at(F.filter(ids, lambda i: i.rlike("(?i)^(https?://doi\\.org/|doi:)?10\\.\\d{4,9}/")), F.lit(1))
    url = F.try_element_at(F.filter(ids, lambda i: i.rlike("(?i)^https?://")), F.lit(1))
    when = best_harvest_date(F.transform(dc + "date", lambda d: parse_date(d)), parse_date(F.col("header.datestamp")), lo, hi)
    out = _candidates(
        r, source, title=F.try_element_at(dc + "title", F.lit(1)), doi=normal_doi(doi), authors=F.coalesce(F.col(dc + "creator"), F.array().cast("array<string>")), venue=F.lit(source), url=url,
        abstract=F.try_element_at(dc + "description", F.lit(1)), date=when.cast("string"), date_field=F.lit("dc:date"), record_type=F.lit(None).cast("string"),
    )
    return _windowed(out, start, end, null_passes=False)


def read_feed(spark: SparkSession, path: str, tag: str = "item", start: str | None = None, end: str | None = None, source: str = "feed") -> DataFrame:
    """RSS items or Atom entries (tag 'entry'); undated rows pass."""
    schema = "title string, link string, pubDate string, published string, updated string, description string, summary string" if tag == "item" else "title string, link struct<_href:string>, pubDate string, published string, updated string, description string, summary string"
    r = spark.read.format("xml").option("rowTag", tag).option("ignoreNamespace", True).schema(schema).load(path)
    out = _candidates(
        r, source, title=F.col("title"), doi=F.lit(None).cast("string"), authors=F.array().cast("array<string>"), venue=F.lit(source), url=F.col("link") if tag == "item" else F.col("link._href"),
        abstract=F.nullif(strip_tags(F.coalesce("description", "summary")), F.lit("")), date=parse_date(F.coalesce("pubDate", "published", "updated")).cast("string"), date_field=F.lit("feed"), record_type=F.lit("feed"),
    )
    return _windowed(out, start, end, null_passes=True)


def union_legs(legs: list[DataFrame], limit: int) -> DataFrame:
    """Legs in order of preference, one row per DOI or title, the first ``limit`` rows."""
    rows = None
    for n, leg in enumerate(legs):
        one = leg.withColumn("__leg", F.lit(n))
        rows = one if rows is None else rows.unionByName(one)
    rows = rows.withColumn("__seq", F.struct("__leg", "title", F.coalesce("doi", F.lit("")), F.coalesce("url", F.lit(""))))
    kept = keyed_dedup(rows, record_key(F.col("doi"), F.col("title")), "__seq")
    return kept.orderBy("__seq").limit(limit).drop("__leg", "__seq")


def group_budget(rows: DataFrame, group: list[str], seq: list[str], total: int, groups: int) -> DataFrame:
    """The first ceil(total / groups) rows of each group."""
    share = -(-total // max(1, groups))
    return rows.withColumn("__rn", F.row_number().over(Window.partitionBy(*group).orderBy(*seq))).where(F.col("__rn") <= share).drop("__rn")


def error_row(spark: SparkSession, source: str, detail: str) -> DataFrame:
    """One row that stands for a source that failed."""
    return spark.createDataFrame([(source, "source_error", detail)], "source string, record_type string, detail string")


def read_manifests(spark: SparkSession, path: str, include_expired: bool = False) -> DataFrame:
    """Run manifests, newest first; broken files are skipped."""
    schema = "run_id string, created_at timestamp, expires_at timestamp, target_month string, requested_by string, artifacts array<struct<name:string,path:string>>"
    rows = spark.read.schema(schema).option("multiLine", True).option("mode", "DROPMALFORMED").json(path).where("run_id is not null")
    return (rows if include_expired else rows.where("expires_at is null or expires_at > current_timestamp()")).orderBy(F.desc("created_at"))


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of a JSON-lines graph, of its last version if it has several;
    broken lines are skipped."""
    path = current(spark, path) or path
    schema = "kind string, id string, type string, name string, aliases array<string>, src string, rel string, dst string, confidence double, quote string"
    rows = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    return rows.where("kind = 'node'").select("id", "type", "name", "aliases"), rows.where("kind = 'edge'").select("src", "rel", "dst", "confidence", "quote")
