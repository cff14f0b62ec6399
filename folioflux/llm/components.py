"""Connected components of an edge table.

Tasks first contract their own edges to stars.  What is left is decided by one task
where it is few (a checked, fixed bound), else by alternating star contraction.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_ROUNDS = 60
#: Edges that one task contracts at a time, and at most decides alone: 8 MB.
TASK_EDGES = 500_000


def contract(edges: DataFrame) -> DataFrame:
    """Edges (u, v) of each task as stars (node, least node), ``TASK_EDGES`` at a time."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up: dict[int, int] = {}
        held = 0

        def top(k: int) -> int:
            while up[k] != k:
                up[k] = up[up[k]]
                k = up[k]
            return k

        def stars() -> pa.RecordBatch:
            nodes = [k for k in up if top(k) != k]
            out = pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([top(k) for k in nodes], pa.int64())], names=["u", "v"])
            up.clear()
            return out

        for batch in batches:
            pairs = np.stack([np.asarray(batch.column(0)), np.asarray(batch.column(1))], axis=1)
            for a, b in pairs.tolist():
                up.setdefault(a, a)
                up.setdefault(b, b)
                a, b = top(a), top(b)
                if a != b:
                    up[max(a, b)] = min(a, b)
            held += len(pairs)
            if held > TASK_EDGES:
                yield stars()
                held = 0
        yield stars()

    return edges.select("u", "v").mapInArrow(work, "u bigint, v bigint")


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Point a node's larger (or smaller) neighbours to its smallest neighbour.

    The smallest neighbour is a pre-aggregated minimum, so a hub costs one row per task;
    hubs' edges meet it in a join, which can split a hub's rows.
    """
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low"))
    joined = both.join(least, "u")
    if large:
        moved = joined.where("v > u").select(F.col("v").alias("u"), F.col("low").alias("v"))
    else:
        moved = joined.where("v <> low").select(F.col("v").alias("u"), F.col("low").alias("v")).unionByName(least.where("u <> low").select("u", F.col("low").alias("v")))
    return moved.where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of ``edges(u, v)``; the component is its least node.

    Self-loops and null ends are left out.  Each round ends in a checkpoint.
    """
    edges = contract(edges.where("u is not null and v is not null and u <> v")).distinct().checkpoint()
    if edges.count() <= TASK_EDGES:
        edges = contract(edges.coalesce(1)).checkpoint()
        return _named(edges)
    last = None
    for _ in range(MAX_ROUNDS):
        edges = _star(_star(edges, True), False).checkpoint()
        mark = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(mark) == last:
            break
        last = tuple(mark)
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    return _named(edges)


def _named(stars: DataFrame) -> DataFrame:
    ends = stars.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return stars.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(ends)
