"""The knowledge base: documents in, searched and connected.

A language model's part (entities and relations of a section) comes as tables; without
one, :func:`rule_entities` reads capitalised names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflux.functions.text import ascii_slug, noise_name
from folioflux.operators import dedup, documents, graph, retrieval


def parse(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Sections and chunks of documents, chunks in coordinates of the document."""
    sections = documents.sections(docs, doc_id, text)
    keyed = sections.select(F.concat_ws("#", F.col("doc_id").cast("string"), F.col("lo").cast("string")).alias("key"), "doc_id", "title", F.col("lo").alias("base"), "body")
    pieces = documents.chunks(keyed, "key", "body")
    chunks = pieces.join(keyed.select(F.col("key").alias("doc_key"), F.col("doc_id").alias("source"), "title", "base"), F.col("doc_id") == F.col("doc_key"))
    return sections, chunks.select("source", "title", (F.col("base") + F.col("lo")).alias("lo"), (F.col("base") + F.col("hi")).alias("hi"), "chunk", F.concat_ws(":", F.col("source").cast("string"), F.left(F.sha1(F.concat_ws("-", F.col("base") + F.col("lo"), F.col("base") + F.col("hi"))), F.lit(12))).alias("chunk_id"))


def rule_entities(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, type, name, aliases, seq) of runs of capitalised words."""
    names = F.regexp_extract_all(F.col(text), F.lit("\\b\\p{Lu}[\\p{L}\\d-]+(?: \\p{Lu}[\\p{L}\\d-]+)+"), F.lit(0))
    rows = docs.select(F.col(doc_id).alias("seq"), F.explode(F.array_distinct(names)).alias("name")).where(~noise_name(F.col("name")))
    return rows.select(F.concat(F.lit("concept:"), ascii_slug(F.col("name"))).alias("id"), F.lit("Concept").alias("type"), "name", F.array().cast("array<string>").alias("aliases"), "seq")


def ingest(nodes: DataFrame, known: DataFrame, edges: DataFrame, vocabulary: Sequence[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """New nodes resolved against known ones, edges moved to the survivors.

    Returns nodes, edges and the outcomes.  Nodes: id, type, name, aliases, seq, and where
    both tables have it the ``vector`` of the name.
    """
    vector = ["vector"] if "vector" in nodes.columns and "vector" in known.columns else []
    first = nodes.groupBy("id").agg(F.min("seq").alias("seq"), *[F.min_by(v, "seq").alias(v) for v in vector])
    new = graph.merge_nodes(nodes.drop("vector")).join(first, "id").withColumn("known", F.lit(False))
    old = known.select("id", "type", "name", "aliases", *vector).withColumn("seq", F.lit(-1).cast("bigint")).withColumn("known", F.lit(True))
    columns = ["id", "type", "seq", "name", "aliases", "known", *vector]
    outcomes = dedup.resolve_entities(new.select(*columns).unionByName(old.select(*columns))).checkpoint()
    mapping = outcomes.where("outcome = 'merge'").select("id", "target").where("id <> target").distinct()
    rows = new.select("id", "type", "name", "aliases", "seq").unionByName(old.select("id", "type", "name", "aliases", "seq"))
    moved = rows.join(mapping, "id", "left").withColumn("id", F.coalesce("target", "id")).drop("target")
    merged = graph.merge_nodes(moved)
    valid = graph.valid_relations(graph.remap(edges, mapping), vocabulary, merged)
    return merged, graph.merge_edges(valid), outcomes


def hybrid_search(chunks: DataFrame, queries: DataFrame, vectors: DataFrame | None, query_vectors: DataFrame | None, k: int = 8) -> DataFrame:
    """Chunks of each query by fused BM25 and vector ranks; by BM25 alone without vectors."""
    lexical = retrieval.bm25(chunks, queries, "chunk_id", "chunk", k=k)
    if vectors is None or query_vectors is None:
        return retrieval.fuse([lexical], ["query_id"], "doc_id", k)
    dense = retrieval.vector_search(vectors, query_vectors, k).withColumnRenamed("vec_id", "doc_id")
    return retrieval.fuse([dense, lexical], ["query_id"], "doc_id", k)


def apply_document(nodes: DataFrame, edges: DataFrame, anchors: DataFrame, targets: DataFrame, vectors: DataFrame | None = None, max_hops: int = 3, **kinds: Sequence[str]) -> DataFrame:
    """How anchors connect to targets; where all connections are weak, the anchors'
    neighbours are asked as well and the stronger answer stands."""
    first = graph.connect(nodes, edges, anchors, targets, vectors, max_hops, **kinds).checkpoint()
    best = first.agg(F.max("strength")).first()[0]
    if best is not None and best >= 0.30:
        return first
    near = graph.neighbours(edges).join(anchors.withColumnRenamed("id", "a"), "a", "left_semi").select(F.col("b").alias("id"))
    wider = graph.connect(nodes, edges, anchors.select("id").unionByName(near).distinct(), targets, vectors, max_hops, **kinds)
    return graph.best_per_target(first.unionByName(wider))
