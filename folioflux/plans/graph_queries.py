"""Queries over a property graph made of the star-schema tables.

Nations, regions, suppliers and customers are nodes; suppliers and customers are 'in'
their nation, nations 'part-of' their region, and nations trade as their keys say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflux.functions.text import alnum_key
from folioflux.functions.vectors import cosine, mean_vector
from folioflux.operators import dedup, graph, retrieval
from folioflux.plans.registry import query, table

_EDGES = """edges AS (
 SELECT 'nation:' || n_nationkey AS src, 'part-of' AS rel, 'region:' || n_regionkey AS dst, 0.5 + (n_nationkey % 5) / 10.0 AS confidence FROM nation
 UNION ALL SELECT 'nation:' || n_nationkey, CASE n_nationkey % 4 WHEN 0 THEN 'contradicts' WHEN 1 THEN 'uses-method' ELSE 'funds' END, 'nation:' || ((n_nationkey * 7 + 3) % 25), 0.3 + (n_nationkey % 7) / 10.0 FROM nation WHERE n_nationkey <> (n_nationkey * 7 + 3) % 25
)"""
_WALK = "walk AS (SELECT a, b, max(confidence)::DOUBLE AS confidence, max_by(rel, (confidence, rel)) AS rel FROM (SELECT src AS a, dst AS b, rel, confidence FROM edges UNION ALL SELECT dst, src, rel, confidence FROM edges) GROUP BY a, b)"
_PATHS = f"""WITH RECURSIVE {_EDGES}, {_WALK}, p(start, node, path, rels, confs, hops) AS (
 SELECT id, id, [id], []::VARCHAR[], []::DOUBLE[], 0 FROM (VALUES ('nation:1'), ('nation:8'), ('nation:20')) s(id)
 UNION ALL SELECT start, b, list_append(path, b), list_append(rels, rel), list_append(confs, confidence), hops + 1 FROM p JOIN walk ON p.node = walk.a WHERE NOT list_contains(path, b) AND hops < 3
), found AS (SELECT *, node AS "end" FROM p WHERE hops > 0 AND node IN (SELECT 'region:' || r_regionkey FROM region)),
deg AS (SELECT id, count(*) AS degree FROM (SELECT src AS id FROM edges UNION ALL SELECT dst FROM edges) GROUP BY id),
cost AS (SELECT f.start, f."end", f.path, coalesce(sum(greatest(degree - 4, 0)), 0) AS hub_cost, coalesce(product(CASE WHEN degree > 4 THEN 4.0 / degree ELSE 1.0 END), 1.0) AS hub_term FROM found f LEFT JOIN (SELECT DISTINCT path, unnest(path[2:len(path) - 1]) AS id FROM found) i ON i.path = f.path LEFT JOIN deg USING (id) GROUP BY ALL),
strong AS (SELECT f.*, hub_cost, hub_term, 0.45 / hops + 0.30 * list_avg(list_transform(confs, lambda c: least(greatest(c, 0), 1))) + 0.15 * hub_term AS strength FROM found f JOIN cost c ON f.path = c.path)"""


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    key, other = F.col("n_nationkey"), F.pmod(F.col("n_nationkey") * 7 + 3, F.lit(25))
    name = lambda kind, k: F.concat(F.lit(f"{kind}:"), k.cast("string"))
    part = n.select(name("nation", key).alias("src"), F.lit("part-of").alias("rel"), name("region", F.col("n_regionkey")).alias("dst"), (F.lit(0.5) + key % 5 / 10.0).alias("confidence"))
    trade = n.where(key != other).select(name("nation", key).alias("src"), F.when(key % 4 == 0, "contradicts").when(key % 4 == 1, "uses-method").otherwise("funds").alias("rel"), name("nation", other).alias("dst"), (F.lit(0.3) + key % 7 / 10.0).alias("confidence"))
    return part.unionByName(trade)


def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = edges(spark, sf_dir)
    starts = spark.createDataFrame([("nation:1",), ("nation:8",), ("nation:20",)], "id string")
    ends = table(spark, sf_dir, "region").select(F.concat(F.lit("region:"), F.col("r_regionkey").cast("string")).alias("id"))
    return graph.hub_cost(graph.simple_paths(e, starts, ends, 3), graph.degrees(e), 4)


@query("neighbors", f"WITH {_EDGES} SELECT a, rel, b FROM (SELECT src AS a, rel, dst AS b FROM edges UNION ALL SELECT dst, rel, src FROM edges) WHERE rel IN ('funds', 'contradicts')")
def neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.neighbours(edges(spark, sf_dir), ["funds", "contradicts"]).select("a", "rel", "b")


@query("degrees", f"WITH {_EDGES} SELECT id, count(*) AS degree FROM (SELECT src AS id FROM edges UNION ALL SELECT dst FROM edges) GROUP BY id")
def degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.degrees(edges(spark, sf_dir))


@query("simple_paths_3hop", _PATHS + ' SELECT start, "end", array_to_string(path, \'>\') AS path, array_to_string(rels, \'>\') AS rels, hops, hub_cost::BIGINT AS hub_cost FROM strong')
def simple_paths_3hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _paths(spark, sf_dir).select("start", "end", F.array_join("path", ">").alias("path"), F.array_join("rels", ">").alias("rels"), "hops", F.col("hub_cost").cast("bigint").alias("hub_cost"))


@query(
    "path_strength_best_per_target",
    _PATHS + """ SELECT start, "end", array_to_string(path, '>') AS path, round(strength, 6) AS strength,
 CASE WHEN list_has_any(rels, ['has-tradeoff-with', 'contradicts', 'challenges']) THEN 'tradeoff' WHEN list_has_any(rels, ['funds']) THEN 'same-org' WHEN list_has_any(rels, ['uses-method']) THEN 'capability-transfer' ELSE 'shared-entity' END AS kind, strength < 0.3 AS weak
 FROM strong QUALIFY row_number() OVER (PARTITION BY "end" ORDER BY round(strength, 9) DESC, start, hops, array_to_string(path, '>')) = 1""",
)
def path_strength_best_per_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = edges(spark, sf_dir)
    nodes = graph.placeholders(spark.createDataFrame([], "id string, type string"), e)
    starts = spark.createDataFrame([("nation:1",), ("nation:8",), ("nation:20",)], "id string")
    ends = table(spark, sf_dir, "region").select(F.concat(F.lit("region:"), F.col("r_regionkey").cast("string")).alias("id"))
    out = graph.connect(nodes, e, starts, ends, threshold=4, org_rels=["funds"], capability_rels=["uses-method"])
    return out.select("start", "end", F.array_join("path", ">").alias("path"), F.round("strength", 6).alias("strength"), "kind", "weak")


@query("bfs_expand", f"WITH RECURSIVE {_EDGES}, {_WALK}, r(id, depth) AS (SELECT 'region:0', 0 UNION SELECT b, depth + 1 FROM r JOIN walk ON r.id = walk.a WHERE depth < 2) SELECT id, min(depth) AS depth FROM r GROUP BY id")
def bfs_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.bfs(edges(spark, sf_dir), spark.createDataFrame([("region:0",)], "id string"), 2)


@query("path_rendering", _PATHS + """ SELECT path[1] || CASE hops WHEN 1 THEN ' —' || rels[1] || '→ ' || path[2] WHEN 2 THEN ' —' || rels[1] || '→ ' || path[2] || ' —' || rels[2] || '→ ' || path[3] ELSE ' —' || rels[1] || '→ ' || path[2] || ' —' || rels[2] || '→ ' || path[3] || ' —' || rels[3] || '→ ' || path[4] END AS line FROM strong""")
def path_rendering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _paths(spark, sf_dir).select(graph.rendered(F.col("path"), F.col("rels")).alias("line"))


@query("node_upsert", "SELECT o_custkey AS id, first(o_orderpriority ORDER BY o_orderkey) AS name, count(DISTINCT o_orderpriority) - 1 AS n_aliases FROM orders GROUP BY o_custkey")
def node_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), F.lit("Customer").alias("type"), F.col("o_orderpriority").alias("name"), F.lit(None).cast("array<string>").alias("aliases"), F.col("o_orderkey").alias("seq"))
    return graph.merge_nodes(rows).select("id", "name", F.size("aliases").cast("bigint").alias("n_aliases"))


@query(
    "node_edge_upsert",
    """WITH r AS (SELECT l_suppkey AS src, l_returnflag AS rel, l_partkey AS dst, l_quantity AS c, CASE WHEN l_linenumber % 3 <> 0 THEN l_linestatus || l_linenumber END AS q, l_orderkey * 10 + l_linenumber AS seq FROM lineitem),
 b AS (SELECT *, coalesce(c > max(c) OVER (PARTITION BY src, rel, dst ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS beats FROM r)
 SELECT src, rel, dst, max(c) AS confidence, coalesce(max_by(q, seq) FILTER (beats AND q IS NOT NULL), min_by(q, seq) FILTER (q IS NOT NULL)) AS quote FROM b GROUP BY ALL""",
)
def node_edge_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    quote = F.when(F.col("l_linenumber") % 3 != 0, F.concat("l_linestatus", F.col("l_linenumber").cast("string")))
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_returnflag").alias("rel"), F.col("l_partkey").alias("dst"), F.col("l_quantity").alias("confidence"), quote.alias("quote"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"))
    return graph.merge_edges(rows)


@query("edge_dedupe", "SELECT l_suppkey AS src, l_returnflag AS rel, l_linestatus AS dst, l_orderkey, l_linenumber FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_suppkey, l_returnflag, l_linestatus ORDER BY (CASE WHEN l_quantity > 25 THEN 1 END) IS NULL, l_orderkey * 10 + l_linenumber) = 1")
def edge_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_returnflag").alias("rel"), F.col("l_linestatus").alias("dst"), F.when(F.col("l_quantity") > 25, 1).alias("quote"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), "l_orderkey", "l_linenumber")
    return graph.dedupe_edges(rows).select("src", "rel", "dst", "l_orderkey", "l_linenumber")


_ALIASES = "a AS (SELECT p_partkey AS alias, p_partkey // 3 AS target FROM part WHERE p_partkey // 3 > 0)"


@query("alias_closure", f"WITH RECURSIVE {_ALIASES}, r(alias, canonical, depth) AS (SELECT alias, target, 1 FROM a UNION ALL SELECT r.alias, a.target, depth + 1 FROM r JOIN a ON r.canonical = a.alias WHERE depth < 17) SELECT alias, max_by(canonical, depth) AS canonical FROM r GROUP BY alias")
def alias_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = F.floor(F.col("p_partkey") / 3).cast("bigint")
    return graph.alias_closure(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("alias"), target.alias("target")).where("target > 0")).select("alias", "canonical")


@query("stance_override", "SELECT node, rel FROM (SELECT l_partkey AS node, CASE l_linenumber % 4 WHEN 0 THEN 'contradicts' WHEN 1 THEN 'funds' WHEN 2 THEN 'mentions' ELSE 'challenges' END AS rel, l_orderkey * 10 + l_linenumber AS seq FROM lineitem) QUALIFY row_number() OVER (PARTITION BY node ORDER BY CASE WHEN rel IN ('contradicts', 'challenges') THEN 0 ELSE 1 END, CASE WHEN rel IN ('contradicts', 'challenges') THEN -seq ELSE seq END) = 1")
def stance_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("l_linenumber") % 4
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("node"), F.when(n == 0, "contradicts").when(n == 1, "funds").when(n == 2, "mentions").otherwise("challenges").alias("rel"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"))
    return graph.stance(rows)


@query("orphan_nodes", f"WITH {_EDGES} SELECT 's' || s_suppkey AS id FROM supplier UNION SELECT 'nation:' || n_nationkey FROM nation WHERE 'nation:' || n_nationkey NOT IN (SELECT src FROM edges UNION SELECT dst FROM edges)")
def orphan_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("id"))
    nations = table(spark, sf_dir, "nation").select(F.concat(F.lit("nation:"), F.col("n_nationkey").cast("string")).alias("id"))
    return graph.orphans(nodes.unionByName(nations), edges(spark, sf_dir))


@query("edge_remap", f"WITH {_EDGES}, m AS (SELECT 'nation:' || n_nationkey AS id, 'nation:' || (n_nationkey % 5) AS target FROM nation) SELECT DISTINCT coalesce(s.target, src) AS src, rel, coalesce(d.target, dst) AS dst FROM edges e LEFT JOIN m s ON e.src = s.id LEFT JOIN m d ON e.dst = d.id WHERE coalesce(s.target, src) <> coalesce(d.target, dst)")
def edge_remap(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("n_nationkey")
    mapping = table(spark, sf_dir, "nation").select(F.concat(F.lit("nation:"), key.cast("string")).alias("id"), F.concat(F.lit("nation:"), (key % 5).cast("string")).alias("target"))
    return graph.remap(edges(spark, sf_dir), mapping).select("src", "rel", "dst")


@query("mean_vector_nearest", "WITH m AS (SELECT label, pos, avg(x) AS x FROM (SELECT label, unnest(CAST(embedding AS DOUBLE[])) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings) GROUP BY ALL), c AS (SELECT label, list(x ORDER BY pos) AS v FROM m GROUP BY label) SELECT e.vec_id, round(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), c.v), 5) AS score FROM embeddings e JOIN c USING (label)")
def mean_vector_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    means = mean_vector(vectors, ["label"], "embedding").withColumnRenamed("embedding", "__m")
    return vectors.join(means, "label").select("vec_id", F.round(cosine(F.col("embedding"), F.col("__m")), 5).alias("score"))


@query("kb_neighbor_note", "SELECT a.vec_id, round(max(round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6)), 5) AS best FROM embeddings a JOIN embeddings b ON a.label <> b.label WHERE a.vec_id % 50 = 0 GROUP BY a.vec_id")
def kb_neighbor_note(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors with an id divisible by 50 ask all vectors of other labels."""
    vectors = table(spark, sf_dir, "embeddings")
    asked = vectors.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"), "label")
    best = retrieval.best_apart(vectors, asked, "vec_id", "embedding", "label")
    return best.select(F.col("query_id").alias("vec_id"), F.round("score", 5).alias("best"))


@query("entity_resolution_outcomes", None)
def entity_resolution_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select(F.concat(F.lit("part:"), F.col("p_partkey").cast("string")).alias("id"), F.col("p_type").alias("type"), F.col("p_partkey").alias("seq"), F.col("p_name").alias("name"), F.array("p_brand").alias("aliases"), (F.col("p_partkey") % 10 == 0).alias("known"))
    return dedup.resolve_entities(rows)


@query("anchor_best_match", None)
def anchor_best_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_type", F.array(alnum_key(F.col("p_name"))).alias("forms"))
    left = parts.where("p_partkey % 50 = 0").withColumnRenamed("p_partkey", "new_id")
    return dedup.best_match(left, parts.withColumnRenamed("p_partkey", "node_id"), "p_type", 0.78, "new_id", "node_id")
