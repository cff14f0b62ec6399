"""What a run asks of which source: configuration, criteria and queries.

Calls are out of scope: a plan says what to land, and landed rows are joined to it.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflux.operators.reports import ordered_union
from folioflux.sources.feeds import union_legs

SOURCE_SCHEMA = "id string, name string, kind string, source_type string, enabled boolean, url string, issns array<string>, notes string"
#: Kinds of sources that are searched, the query without any other, a limit.
SEARCHED, GENERAL_QUERY, QUERY_CHARS = ("scholarly_api", "press_api"), "climate change", 240


def config_sources(spark: SparkSession, config: Mapping) -> DataFrame:
    """Sources of a parsed configuration file, typed, in its order."""
    names = [f.split()[0] for f in SOURCE_SCHEMA.split(", ")]
    rows = []
    for n, one in enumerate(config.get("sources") or []):
        if not one.get("id"):
            raise ValueError(f"source {n} has no id")
        row = {"name": one["id"], "enabled": True, "issns": [], **one}
        rows.append(tuple(str(row[c]) if c not in ("enabled", "issns") and row.get(c) is not None else row.get(c) for c in names) + (n,))
    return spark.createDataFrame(rows, SOURCE_SCHEMA + ", ord int")


def criteria_query(text: str | None) -> str | None:
    """The line after 'query:', else the whole text, on one line and cut at a word."""
    line = re.search(r"^\s*query\s*:\s*(\S.*)$", text or "", re.IGNORECASE | re.MULTILINE)
    flat = " ".join((line[1] if line else text or "").split())
    if len(flat) > QUERY_CHARS:
        flat = flat[: QUERY_CHARS + 1].rsplit(" ", 1)[0][:QUERY_CHARS]
    return flat or None


def criteria_summary(text: str | None, chars: int = 160) -> str:
    """Criteria for a report's head: whole if short, else their beginning."""
    flat = " ".join((text or "").split())
    return flat if len(flat) <= chars else flat[:chars].rstrip() + "…"


def plan_queries(sources: DataFrame, queries: Sequence[str], criteria: str | None = None, with_key: Sequence[str] = (), keyed: Sequence[str] = ("semantic_scholar",)) -> DataFrame:
    """(source, ord, query): feeds are asked once, searched sources and journals with
    ISSNs for every query; ``keyed`` sources once without a key, three times with one.
    The criteria's query leads."""
    own = criteria_query(criteria)
    every = ordered_union([own] if own else [], list(queries) or [GENERAL_QUERY])
    few = ordered_union([own] if own else [], (list(queries) or [GENERAL_QUERY])[:3])
    lists = lambda q: F.array(*[F.lit(x) for x in q])
    journal = F.size(F.coalesce("issns", F.array().cast("array<string>"))) > 0
    asked = (
        F.when(F.col("id").isin(*keyed) & F.col("id").isin(*with_key), lists(few))
        .when(F.col("id").isin(*keyed), lists([own or GENERAL_QUERY]))
        .when(F.col("kind").isin(*SEARCHED) | journal, lists(every))
        .otherwise(lists([own or GENERAL_QUERY]))
    )
    return sources.where("enabled").select(F.col("id").alias("source"), F.posexplode(asked).alias("ord", "query"))


def by_issn(rows: DataFrame, sources: DataFrame, issn: str = "issn") -> DataFrame:
    """Landed rows of journals that a source names, with that source."""
    named = sources.select(F.col("id").alias("source"), F.explode("issns").alias("__issn")).withColumn("__issn", F.upper(F.trim("__issn"))).distinct()
    return rows.withColumn("__issn", F.upper(F.trim(F.col(issn)))).join(named, "__issn").drop("__issn")


def journal_rows(legs: Sequence[DataFrame], feed: DataFrame, limit: int) -> DataFrame:
    """Rows of the ISSN legs; the feed fills what is left of ``limit``."""
    return union_legs([*legs, feed], limit)


def scan(landed: DataFrame, plan: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, errors, counts) of a run.

    Landed: source, ord (of the query), status ('ok' or an error), candidate key.  A
    source stops at its first error: rows of later queries don't count.  ``counts`` has
    a row for every planned source: rows, different keys, and errors.
    """
    planned = landed.join(plan.select("source", "ord").distinct(), ["source", "ord"], "left_semi")
    stop = planned.where("status <> 'ok'").groupBy("source").agg(F.min("ord").alias("__stop"))
    known = planned.join(stop, "source", "left")
    rows = known.where("status = 'ok' and (__stop is null or ord < __stop)").drop("__stop")
    errors = known.where("status <> 'ok' and ord = __stop").drop("__stop").dropDuplicates(["source"])
    counts = rows.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("key").alias("n_different"))
    out = plan.select("source").distinct().join(counts, "source", "left").join(errors.groupBy("source").agg(F.count(F.lit(1)).alias("n_errors")), "source", "left")
    return rows, errors, out.na.fill(0, ["n", "n_different", "n_errors"])
