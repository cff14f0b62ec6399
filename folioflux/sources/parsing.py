"""Files to documents: a registry of parsers by extension, page clean-up, chunk stores.

Parsers work on DataFrames of (path, content): a whole file of each kind is one row, and
a kind's rows are parsed together.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioflux.functions.vectors import valid_vector
from folioflux.operators.documents import chunks, page_text, page_title

Parser = Callable[[DataFrame], DataFrame]
_PARSERS: dict[str, dict[str, Parser]] = {}
_DATE = "(?:^|[^0-9])((?:19|20)\\d{2}-\\d{2}-\\d{2})(?:[^0-9]|$)"


def register(extension: str, parser: Parser, name: str | None = None) -> None:
    """A parser of an extension; the last one registered is taken unless one is preferred."""
    own = _PARSERS.setdefault(extension.lower().lstrip("."), {})
    own.pop(name or parser.__name__, None)
    own[name or parser.__name__] = parser


def parser_of(extension: str, prefer: str | None = None) -> Parser:
    """The preferred or last parser of an extension; unknown ones are read as text."""
    own = _PARSERS.get(extension.lower().lstrip(".")) or _PARSERS["txt"]
    return own.get(prefer or "") or list(own.values())[-1]


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, "\\.([A-Za-z0-9]+)$", 1))


def slug(path: Column) -> Column:
    """The file name without extension, in lower case, runs of other characters as one '-'."""
    stem = F.regexp_replace(F.regexp_extract(path, "([^/]*)$", 1), "\\.[A-Za-z0-9]+$", "")
    return F.coalesce(F.nullif(F.trim(F.regexp_replace(F.lower(stem), "[^a-z0-9]+", "-"), F.lit("-")), F.lit("")), F.lit("untitled"))


def _document(rows: DataFrame, title: Column, text: Column) -> DataFrame:
    stem = F.regexp_replace(F.regexp_extract("path", "([^/]*)$", 1), "\\.[A-Za-z0-9]+$", "")
    named = F.coalesce(F.nullif(F.trim(title), F.lit("")), stem)
    stamped = F.nullif(F.regexp_extract(F.regexp_extract("path", "([^/]*)$", 1), _DATE, 1), F.lit(""))
    inside = F.nullif(F.regexp_extract(F.left("content", F.lit(2000)), _DATE, 1), F.lit(""))
    return rows.select("path", slug(F.col("path")).alias("source_slug"), named.alias("title"), F.try_to_date(F.coalesce(stamped, inside)).alias("date"), F.coalesce(text, F.lit("")).alias("markdown"))


def parse_markdown(rows: DataFrame) -> DataFrame:
    """The title is the first # heading, or one underlined by = signs."""
    marked = F.regexp_extract("content", "(?m)^#{1,6}[ \\t]+(.+?)[ \\t]*#*[ \\t]*$", 1)
    lined = F.regexp_extract("content", "(?m)^(\\S.*)\\n={3,}[ \\t]*$", 1)
    return _document(rows, F.when(marked != "", marked).otherwise(lined), F.col("content"))


def parse_text(rows: DataFrame) -> DataFrame:
    """The title is the first line that isn't blank, if it is short."""
    line = F.trim(F.regexp_extract("content", "^\\s*([^\\n]*)", 1))
    return _document(rows, F.when(F.char_length(line) <= 120, line), F.col("content"))


def parse_html(rows: DataFrame) -> DataFrame:
    return _document(rows, F.regexp_replace(page_title(F.col("content")), "\\s+", " "), page_text(F.col("content")))


for _ext, _parser in (("txt", parse_text), ("md", parse_markdown), ("markdown", parse_markdown), ("html", parse_html), ("htm", parse_html)):
    register(_ext, _parser)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of the files of a folder, each a row.

    Spark's readers leave out files of length 0, so these give no row.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", F.col("content").cast("string").alias("content"))


def parse(rows: DataFrame, prefer: str | None = None) -> DataFrame:
    """(path, source_slug, title, date, markdown) of every row, by its extension.

    Empty files give empty documents; null contents count as empty.
    """
    rows = rows.select("path", F.coalesce("content", F.lit("")).alias("content"))
    known = sorted(_PARSERS)
    ext = F.when(extension(F.col("path")).isin(*known), extension(F.col("path"))).otherwise("txt")
    out = None
    for kind in known:
        one = parser_of(kind, prefer)(rows.where(ext == kind))
        out = one if out is None else out.unionByName(one)
    return out


# --- pages -------------------------------------------------------------------------
def furniture(line: Column) -> Column:
    """Page numbers, running heads and lines that end in a comma or semicolon."""
    s = F.trim(line)
    number = s.rlike("^(?i)(page\\s+)?[0-9]+(\\s*(of|/)\\s*[0-9]+)?$") | s.rlike("^[-–—]\\s*[0-9]+\\s*[-–—]$")
    head = s.rlike("(?i)(^doi:|https?://doi\\.org/|©|all rights reserved|^downloaded from|^vol\\.?\\s+[0-9]+)")
    return number | head | s.rlike("[,;]$")


def clean_page(text: Column) -> Column:
    """A page without furniture at its ends, broken words joined, blank lines single."""
    joined = F.regexp_replace(text, "([\\p{L}])-\\n([\\p{Ll}])", "$1$2")
    lines = F.split(joined, "\n")
    kept = F.filter(lines, lambda x, i: ~((F.trim(x) != "") & furniture(x) & ((i < 2) | (i >= F.size(lines) - 2))))
    return F.trim(F.regexp_replace(F.array_join(kept, "\n"), "\\n{3,}", "\n\n"))


def join_pages(pages: DataFrame, doc_id: str = "doc_id", page: str = "page", text: str = "text") -> DataFrame:
    """(doc_id, markdown, starts): cleaned pages in order, and where each begins."""
    cleaned = pages.select(F.col(doc_id).alias("doc_id"), F.col(page).alias("page"), clean_page(F.coalesce(F.col(text), F.lit(""))).alias("body"))
    order = Window.partitionBy("doc_id").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    placed = cleaned.withColumn("lo", F.coalesce(F.sum(F.char_length("body") + 2).over(order), F.lit(0)))
    parts = F.array_sort(F.collect_list(F.struct("page", "lo", "body"))).alias("parts")
    return placed.groupBy("doc_id").agg(parts).select("doc_id", F.array_join(F.transform("parts", lambda p: p["body"]), "\n\n").alias("markdown"), F.transform("parts", lambda p: p["lo"]).alias("starts"))


# --- chunk stores ------------------------------------------------------------------
CHUNK_ROW = ["id", "source_slug", "section", "text", "char_start", "char_end", "vector"]


def chunk_rows(sections: DataFrame, size: int, overlap: int) -> DataFrame:
    """Chunk rows, without vectors, of (source_slug, section, lo, body)."""
    keyed = sections.select(F.struct("source_slug", "section", "lo").alias("key"), "body")
    cut = chunks(keyed, "key", "body", size, overlap).select("doc_id.*", "n", F.col("lo").alias("at"), "hi", "chunk").toDF("source_slug", "section", "start", "n", "at", "hi", "text")
    place = Window.partitionBy("source_slug").orderBy("start", "n")
    return cut.withColumn("k", F.row_number().over(place) - 1).select(
        F.concat_ws(":", "source_slug", F.col("k").cast("string")).alias("id"), "source_slug", "section", "text", (F.col("start") + F.col("at")).cast("bigint").alias("char_start"), (F.col("start") + F.col("hi")).cast("bigint").alias("char_end")
    )


def with_vectors(rows: DataFrame, vectors: DataFrame, dim: int) -> DataFrame:
    """Chunk rows with their landed vectors; a missing one or one of another size is null."""
    landed = vectors.groupBy("id").agg(F.min_by("vector", F.when(F.size("vector") == dim, 0).otherwise(1)).alias("vector"))
    return rows.join(landed, "id", "left").withColumn("vector", valid_vector(F.col("vector"), dim)).select(*CHUNK_ROW)


def open_chunks(spark: SparkSession, path: str) -> DataFrame:
    """The stored chunks, or none where nothing is stored yet."""
    schema = "id string, source_slug string, section string, text string, char_start bigint, char_end bigint, vector array<float>"
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)
    return spark.read.schema(schema).parquet(path) if there else spark.createDataFrame([], schema)
