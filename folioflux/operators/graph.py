"""Property graphs as node and edge tables: upsert, traversal, paths and their ranking.

Edges are stored directed, (src, rel, dst), and walked both ways.  Bounded walks are
unrolled self-joins, so Catalyst plans each hop; longer ones are cut by checkpoints.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflux.functions.vectors import cosine

MAX_HOPS = 4
HUB_DEGREE = 8
ALIAS_HOPS = 17


# --- upsert ------------------------------------------------------------------------
def merge_nodes(rows: DataFrame) -> DataFrame:
    """One node per id from (id, type, name, aliases, seq): the first name stays, others
    become aliases in order of arrival; nameless rows are dropped."""
    rows = rows.where(F.length("name") > 0)
    first = rows.groupBy("id").agg(F.min_by("type", "seq").alias("type"), F.min_by("name", "seq").alias("name"))
    names = rows.select("id", "seq", F.posexplode(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("at", "alias"))
    once = names.groupBy("id", "alias").agg(F.min(F.struct("seq", "at")).alias("place"))
    listed = once.join(first.select("id", "name"), "id").where("alias <> name").groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "alias"))), lambda x: x["alias"]).alias("aliases"))
    return first.join(listed, "id", "left").withColumn("aliases", F.coalesce("aliases", F.array().cast("array<string>")))


def merge_edges(rows: DataFrame) -> DataFrame:
    """One edge per (src, rel, dst) from (…, confidence, quote, seq), rows in order of seq.

    The highest confidence stays.  A row that beats all before it brings its quote, if it
    has one; until there is a quote, any row's will do.
    """
    before = Window.partitionBy("src", "rel", "dst").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    beats = F.coalesce(F.col("confidence") > F.max("confidence").over(before), F.lit(True))
    quoted = F.col("quote").isNotNull()
    return (
        rows.withColumn("__beats", beats)
        .groupBy("src", "rel", "dst")
        .agg(F.max("confidence").alias("confidence"), F.coalesce(F.max_by("quote", F.when(quoted & F.col("__beats"), F.col("seq"))), F.min_by("quote", F.when(quoted, F.col("seq")))).alias("quote"))
    )


def dedupe_edges(rows: DataFrame) -> DataFrame:
    """First edge of each triple, a quoted one before an unquoted one."""
    order = Window.partitionBy("src", "rel", "dst").orderBy(F.col("quote").isNull(), "seq")
    return rows.withColumn("__rn", F.row_number().over(order)).where("__rn = 1").drop("__rn")


def placeholders(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes that edges name and no node row has: type and name come from the id."""
    ends = edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id"))).distinct()
    return ends.join(nodes.select("id"), "id", "left_anti").select("id", F.split_part("id", F.lit(":"), F.lit(1)).alias("type"), F.split_part("id", F.lit(":"), F.lit(2)).alias("name"))


def valid_relations(edges: DataFrame, vocabulary: Sequence[str], nodes: DataFrame) -> DataFrame:
    """Unknown relations become 'mentions'; self-loops and unknown ends are dropped."""
    known = F.when(F.col("rel").isin(*vocabulary), F.col("rel")).otherwise("mentions")
    ids = nodes.select("id")
    out = edges.withColumn("rel", known).where("src <> dst")
    return out.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")


def orient(edges: DataFrame, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """Turn edges round whose end types fit a relation (rel, src type, dst type) backwards."""
    swap = F.lit(False)
    for rel, a, b in rules:
        swap = swap | ((F.col("rel") == rel) & (F.col("src_type") == b) & (F.col("dst_type") == a) & F.lit(a != b))
    return edges.select(F.when(swap, F.col("dst")).otherwise(F.col("src")).alias("src"), "rel", F.when(swap, F.col("src")).otherwise(F.col("dst")).alias("dst"), *[c for c in edges.columns if c not in ("src", "rel", "dst", "src_type", "dst_type")])


def remap(edges: DataFrame, mapping: DataFrame) -> DataFrame:
    """Ends through (id, target); self-loops go and triples stay once."""
    m = lambda end: mapping.select(F.col("id").alias(end), F.col("target").alias(f"__{end}"))
    out = edges.join(m("src"), "src", "left").join(m("dst"), "dst", "left")
    out = out.withColumn("src", F.coalesce("__src", "src")).withColumn("dst", F.coalesce("__dst", "dst")).drop("__src", "__dst")
    return out.where("src <> dst").dropDuplicates(["src", "rel", "dst"])


def alias_closure(aliases: DataFrame, hops: int = ALIAS_HOPS) -> DataFrame:
    """(alias, canonical) at the end of chains (alias, target), ``hops`` steps at most: a
    cycle stops where these end.

    Steps are doubled and added up, which takes some 2 log2(hops) joins.
    """
    reach = aliases.where("alias is not null and target is not null and alias <> target").groupBy("alias").agg(F.max("target").alias("canonical"))

    def then(first: DataFrame, second: DataFrame) -> DataFrame:
        onward = second.select(F.col("alias").alias("canonical"), F.col("canonical").alias("further"))
        return first.join(onward, "canonical", "left").select("alias", F.coalesce("further", "canonical").alias("canonical"))

    out, doubled = None, reach
    while hops:
        if hops & 1:
            out = doubled if out is None else then(out, doubled)
        hops >>= 1
        if hops:
            doubled = then(doubled, doubled)
    return out


# --- traversal ---------------------------------------------------------------------
def undirected(edges: DataFrame) -> DataFrame:
    """(a, b, …) both ways, self-loops left out."""
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    out = edges.where("src <> dst").select(F.col("src").alias("a"), F.col("dst").alias("b"), *rest)
    return out.unionByName(edges.where("src <> dst").select(F.col("dst").alias("a"), F.col("src").alias("b"), *rest))


def neighbours(edges: DataFrame, rels: Sequence[str] | None = None) -> DataFrame:
    walk = undirected(edges)
    return walk.where(F.col("rel").isin(*rels)) if rels else walk


def degrees(edges: DataFrame) -> DataFrame:
    """(id, degree): edges at either end, parallel ones counted each."""
    return edges.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))


def best_hops(edges: DataFrame) -> DataFrame:
    """(a, b, confidence, rel): the strongest edge between two nodes in either direction."""
    return undirected(edges).groupBy("a", "b").agg(F.max("confidence").alias("confidence"), F.max_by("rel", F.struct("confidence", "rel")).alias("rel"))


def simple_paths(edges: DataFrame, starts: DataFrame, ends: DataFrame, max_hops: int = 3) -> DataFrame:
    """All simple paths of up to ``max_hops`` from ``starts(id)`` to ``ends(id)``.

    Gives start, end, path (node ids), rels, confidences and hops; node paths are distinct.
    """
    if max_hops < 1:
        raise ValueError("max_hops must be 1 or more")
    hop = best_hops(edges)
    goal = ends.select(F.col("id").alias("end")).distinct()
    front = starts.select(F.col("id").alias("start")).distinct().select("start", F.col("start").alias("at"), F.array("start").alias("path"), F.array().cast("array<string>").alias("rels"), F.array().cast("array<double>").alias("confidences"))
    found = None
    for n in range(max_hops):
        step = front.join(hop, front["at"] == hop["a"]).where(~F.array_contains("path", F.col("b")))
        front = step.select("start", F.col("b").alias("at"), F.array_append("path", F.col("b")).alias("path"), F.array_append("rels", F.col("rel")).alias("rels"), F.array_append("confidences", F.col("confidence").cast("double")).alias("confidences"))
        if (n + 1) % MAX_HOPS == 0 and n + 1 < max_hops:  # a plan holds so many joins at most
            front = front.checkpoint()
        hit = front.join(goal, front["at"] == goal["end"]).select("start", "end", "path", "rels", "confidences", F.lit(n + 1).alias("hops"))
        found = hit if found is None else found.unionByName(hit)
    return found


def hub_cost(paths: DataFrame, degree: DataFrame, threshold: int = HUB_DEGREE) -> DataFrame:
    """Add ``hub_cost`` (degrees of inner nodes above the threshold) and ``hub_term``
    (the product of threshold / degree over inner hubs)."""
    key = F.concat_ws("\x1f", "path")
    inner = paths.select(key.alias("__key"), F.explode(F.slice("path", 2, F.greatest(F.size("path") - 2, F.lit(0)))).alias("id")).distinct()
    cost = inner.join(degree, "id").groupBy("__key").agg(
        F.sum(F.greatest(F.col("degree") - threshold, F.lit(0))).alias("hub_cost"),
        F.exp(F.sum(F.when(F.col("degree") > threshold, F.log(F.lit(float(threshold)) / F.col("degree"))).otherwise(0.0))).alias("hub_term"),
    )
    return paths.withColumn("__key", key).join(cost, "__key", "left").drop("__key").withColumn("hub_cost", F.coalesce("hub_cost", F.lit(0))).withColumn("hub_term", F.coalesce("hub_term", F.lit(1.0)))


def bfs(edges: DataFrame, seeds: DataFrame, hops: int = 2) -> DataFrame:
    """(id, depth) of nodes within ``hops`` of ``seeds(id)``; depth 0 are the seeds."""
    walk = undirected(edges).select("a", "b").distinct()
    seen = seeds.select("id").distinct().withColumn("depth", F.lit(0))
    for n in range(hops):
        reached = seen.where(F.col("depth") == n).join(walk, F.col("id") == F.col("a")).select(F.col("b").alias("id"), F.lit(n + 1).alias("depth")).distinct()
        seen = seen.unionByName(reached.join(seen.select("id"), "id", "left_anti"))
        if (n + 1) % MAX_HOPS == 0 and n + 1 < hops:
            seen = seen.checkpoint()
    return seen


def expand(edges: DataFrame, seeds: DataFrame, hops: int = 2) -> tuple[DataFrame, DataFrame]:
    """Nodes within ``hops`` and the edges met on the way (none beyond the last ring)."""
    nodes = bfs(edges, seeds, hops)
    inner = nodes.where(F.col("depth") < hops).select("id")
    touched = edges.join(inner.withColumnRenamed("id", "src"), "src", "left_semi").unionByName(edges.join(inner.withColumnRenamed("id", "dst"), "dst", "left_semi").select(*edges.columns))
    return nodes, touched.distinct()


# --- look-ups ----------------------------------------------------------------------
def set_aliases(aliases: DataFrame, new: DataFrame) -> DataFrame:
    """(alias, target): the last of ``new`` (alias, target, seq) replaces an old target.

    Blank names and names of themselves are ignored.
    """
    named = new.where("trim(coalesce(alias, '')) <> '' and trim(coalesce(target, '')) <> '' and alias <> target")
    last = named.groupBy("alias").agg(F.max_by("target", "seq").alias("target"))
    return last.unionByName(aliases.select("alias", "target").join(last.select("alias"), "alias", "left_anti"))


def look_up(wanted: DataFrame, nodes: DataFrame, aliases: DataFrame) -> DataFrame:
    """Nodes of ``wanted(id)`` through closed aliases; (id, node columns of the target)."""
    closed = alias_closure(aliases)
    through = wanted.join(closed, wanted["id"] == closed["alias"], "left").select(wanted["id"].alias("wanted"), F.coalesce("canonical", "id").alias("id"))
    return through.join(nodes, "id", "left")


def in_order(wanted: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """``rows`` whose key is in ``wanted(key, ord)``, in its order; absent keys are left out."""
    return rows.join(wanted.groupBy(key).agg(F.min("ord").alias("ord")), key).orderBy("ord")


def edge_evidence(paths: DataFrame, edges: DataFrame, quote_chars: int = 120) -> DataFrame:
    """(start, end, path_key, hop, src, rel, dst, source_slug, quote) of each hop's edges.

    Edges between two nodes count in either direction.  A citation of a path is given
    once: equal source, span and first ``quote_chars`` of the quote are one, the first.
    """
    key = F.concat_ws(">", "path").alias("path_key")
    hops = paths.select("start", "end", key, F.posexplode(F.transform(F.sequence(F.lit(1), F.size("path") - 1), lambda i: F.struct(F.element_at("path", i).alias("a"), F.element_at("path", i + 1).alias("b")))).alias("hop", "pair"))
    cited = edges.where("source_slug is not null").select("src", "rel", "dst", "source_slug", "quote", *([c for c in ("lo", "hi") if c in edges.columns]))
    ends = cited.select(F.least("src", "dst").alias("x"), F.greatest("src", "dst").alias("y"), "*")
    found = hops.select("start", "end", "path_key", "hop", F.least("pair.a", "pair.b").alias("x"), F.greatest("pair.a", "pair.b").alias("y")).join(ends, ["x", "y"]).drop("x", "y")
    span = [F.col(c) for c in ("lo", "hi") if c in edges.columns]
    once = Window.partitionBy("start", "end", "path_key", "source_slug", *span, F.left(F.coalesce("quote", F.lit("")), F.lit(quote_chars))).orderBy("hop", "src", "rel", "dst")
    return found.withColumn("__rn", F.row_number().over(once)).where("__rn = 1").drop("__rn")


def assemble(source: str, entities: DataFrame, relations: DataFrame, vocabulary: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of what was extracted from one source.

    ``entities``: name, type, seq; ``relations``: subject, rel, object, quote, seq, whose
    ends are names.  Relations with an unknown end or of a node with itself go; entities
    that no edge touches are mentioned by the source with confidence 0.4, others have 0.6.
    """
    slug = lambda c: F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), F.lit("-"))
    named = entities.where("trim(coalesce(name, '')) <> ''").select(F.concat(F.col("type"), F.lit(":"), slug(F.trim("name"))).alias("id"), "type", F.trim("name").alias("name"), "seq")
    nodes = named.groupBy("id").agg(F.min_by("type", "seq").alias("type"), F.min_by("name", "seq").alias("name"))
    of_name = named.groupBy(F.lower("name").alias("key")).agg(F.min_by("id", "seq").alias("id"))
    end = lambda name, out: of_name.select(F.col("key").alias(f"__{out}"), F.col("id").alias(out))
    ends = relations.withColumn("__src", F.lower(F.trim("subject"))).withColumn("__dst", F.lower(F.trim("object"))).join(end("subject", "src"), "__src").join(end("object", "dst"), "__dst")
    known = F.when(F.col("rel").isin(*vocabulary), F.col("rel")).otherwise("mentions")
    edges = ends.where("src <> dst").select("src", known.alias("rel"), "dst", F.lit(0.6).alias("confidence"), F.nullif(F.left(F.col("quote"), F.lit(160)), F.lit("")).alias("quote"), "seq")
    own = F.lit(f"Source:{source}")
    alone = orphans(nodes, edges).select(own.alias("src"), F.lit("mentions").alias("rel"), F.col("id").alias("dst"), F.lit(0.4).alias("confidence"), F.lit(None).cast("string").alias("quote"), F.lit(0).cast("bigint").alias("seq"))
    first = dedupe_edges(edges.withColumn("seq", F.col("seq").cast("bigint")).unionByName(alone)).drop("seq")
    return nodes, first.withColumn("source_slug", F.lit(source))


#: Node types, and parts of a name that stand for one, in order.
NODE_TYPES = ["Organization", "Technology", "Method", "Idea", "Person", "Concept"]
TYPE_PARTS = [
    ("Organization", ["org", "lab", "company", "university"]),
    ("Technology", ["tech", "tool", "model", "system"]),
    ("Method", ["method", "approach", "algorithm"]),
    ("Idea", ["idea", "worldview", "framing", "stance"]),
    ("Person", ["person", "author"]),
]


def node_type(name: Column, types: Sequence[str] = NODE_TYPES) -> Column:
    """A type by its own name, else by the first part it holds, else 'Concept'."""
    title = F.replace(F.initcap(F.trim(F.coalesce(name, F.lit("")))), F.lit("Organisation"), F.lit("Organization"))
    out = F.when(title.isin(*types), title)
    for kind, pieces in TYPE_PARTS:
        out = out.when(F.lower(title).rlike("|".join(pieces)), kind)
    return out.otherwise("Concept")


# --- ranking -----------------------------------------------------------------------
# Relations of tension, and the weights of a path's strength.
TENSION = ["has-tradeoff-with", "contradicts", "challenges"]
W_HOPS, W_CONFIDENCE, W_HUBS, W_ENDS = 0.45, 0.30, 0.15, 0.10


def path_strength(similarity: Column) -> Column:
    """Weighted: 1 / hops, mean confidence, the hub term, the similarity of the ends."""
    clamped = F.transform("confidences", lambda c: F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0)))
    mean = F.aggregate(clamped, F.lit(0.0), lambda s, c: s + c) / F.size("confidences")
    return F.lit(W_HOPS) / F.col("hops") + F.lit(W_CONFIDENCE) * mean + F.lit(W_HUBS) * F.col("hub_term") + F.lit(W_ENDS) * F.greatest(similarity, F.lit(0.0))


def end_similarity(a: Column, b: Column) -> Column:
    return F.coalesce(cosine(a, b), F.lit(0.0))


def kind_of(rels: Column, inner_types: Column, org_rels: Sequence[str], capability_rels: Sequence[str]) -> Column:
    """Tension, then a shared idea, a shared organisation, a capability, else an entity."""
    any_of = lambda names: F.arrays_overlap(rels, F.array(*[F.lit(n) for n in names])) if names else F.lit(False)
    return (
        F.when(any_of(TENSION), "tradeoff")
        .when(F.array_contains(inner_types, "Idea"), "shared-idea")
        .when(F.array_contains(inner_types, "Organization") | any_of(org_rels), "same-org")
        .when(any_of(capability_rels), "capability-transfer")
        .otherwise("shared-entity")
    )


def stance(edges: DataFrame, node: str = "node") -> DataFrame:
    """One relation per node from (node, rel, seq): the last tension, else the first rel."""
    tense = F.col("rel").isin(*TENSION)
    rank = F.row_number().over(Window.partitionBy(node).orderBy(F.when(tense, 0).otherwise(1), F.when(tense, -F.col("seq")).otherwise(F.col("seq"))))
    return edges.withColumn("__rn", rank).where("__rn = 1").select(node, "rel")


def best_per_target(paths: DataFrame, keys: Sequence[str] = ("end",)) -> DataFrame:
    """Strongest path of each target; ties by start, hops and the path itself."""
    order = Window.partitionBy(*keys).orderBy(F.desc(F.round("strength", 9)), "start", "hops", F.concat_ws(">", "path"))
    return paths.withColumn("__rn", F.row_number().over(order)).where("__rn = 1").drop("__rn")


def ranked_paths(paths: DataFrame, keys: Sequence[str] = ("start", "end"), k: int | None = None) -> DataFrame:
    """Add ``rank`` (from 0) of each pair's paths: strongest first, then fewer hops, less
    hub cost and the path itself; with ``k`` the first ``k``."""
    order = Window.partitionBy(*keys).orderBy(F.desc(F.round("strength", 9)), "hops", "hub_cost", F.concat_ws(">", "path"))
    out = paths.withColumn("rank", F.row_number().over(order) - 1)
    return out.where(F.col("rank") < k) if k else out


def related_nodes(nodes: DataFrame, queries: DataFrame, types: Sequence[str], k: int = 5) -> DataFrame:
    """Nearest nodes of some types to each query vector: (query_id, id, score, rank).

    Nodes: id, type, vector; queries: query_id, vector.  It is what is shown where no
    path connects.
    """
    from folioflux.operators.retrieval import vector_search

    return vector_search(nodes.where(F.col("type").isin(*types)), queries, k, "id", "vector")


def rendered(path: Column, rels: Column) -> Column:
    """a —rel→ b —rel→ c."""
    steps = F.zip_with(rels, F.slice(path, 2, F.greatest(F.size(path) - 1, F.lit(0))), lambda r, n: F.concat(F.lit(" —"), r, F.lit("→ "), n))
    return F.concat(F.try_element_at(path, F.lit(1)), F.array_join(steps, ""))


def orphans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes that no edge touches."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id"))
    return nodes.join(ends, "id", "left_anti")


def connect(nodes: DataFrame, edges: DataFrame, starts: DataFrame, ends: DataFrame, vectors: DataFrame | None = None, max_hops: int = 3, threshold: int = HUB_DEGREE, org_rels: Sequence[str] = (), capability_rels: Sequence[str] = (), weak: float = 0.30) -> DataFrame:
    """How ``starts`` connect to ``ends``: the best path of each target, ranked by
    strength, with its kind; ``weak`` ones are marked."""
    paths = hub_cost(simple_paths(edges, starts, ends, max_hops), degrees(edges), threshold).where("start <> end")
    if vectors is not None:
        v = lambda end: vectors.select(F.col("id").alias(end), F.col("vector").alias(f"__{end}"))
        paths = paths.join(v("start"), "start", "left").join(v("end"), "end", "left").withColumn("similarity", end_similarity(F.col("__start"), F.col("__end"))).drop("__start", "__end")
    else:
        paths = paths.withColumn("similarity", F.lit(0.0))
    best = best_per_target(paths.withColumn("strength", path_strength(F.col("similarity"))))
    inner = best.select("start", "end", F.explode_outer(F.slice("path", 2, F.greatest(F.size("path") - 2, F.lit(0)))).alias("id"))
    types = inner.join(nodes.select("id", "type"), "id", "left").groupBy("start", "end").agg(F.array_sort(F.collect_set("type")).alias("inner_types"))
    out = best.join(types, ["start", "end"])
    return out.withColumn("kind", kind_of(F.col("rels"), F.col("inner_types"), org_rels, capability_rels)).withColumn("weak", F.col("strength") < weak)
