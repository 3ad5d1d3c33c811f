"""Connected components by local contraction and alternating large-star and small-star rounds."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Edges that one task contracts at most, about.
LOCAL_EDGES = 200_000


def _contracted(edges: DataFrame, parts: int) -> DataFrame:
    """Edges (u, v), u > v, that join the same nodes as those of each task do, v being the least node of its local component."""

    def run(batches):
        root: dict[int, int] = {}

        def find(x):
            path = []
            while root.get(x, x) != x:
                path.append(x)
                x = root[x]
            for p in path:
                root[p] = x
            return x

        for batch in batches:
            for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                a, b = find(u), find(v)
                root.setdefault(u, u)
                root.setdefault(v, v)
                if a != b:
                    root[max(a, b)] = min(a, b)
        found = np.array([(x, r) for x in root if (r := find(x)) != x], np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["u", "v"])

    return edges.coalesce(parts).mapInArrow(run, "u long, v long")


def _least(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def _round(edges: DataFrame) -> DataFrame:
    """edges (u, v), u > v -> the edges after a large-star and a small-star step."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    near = _least(both).select("u", F.least("u", "m").alias("m"))
    large = (
        both.where("v > u").join(near, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        .union(both.where("v < u").join(near, "u").where("m < u").select("u", F.col("m").alias("v"))).distinct()
    )
    near = _least(large)
    return large.join(near, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").union(
        near.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, left: str, right: str, most_rounds: int = 60, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """(id, component): for every end of an edge the smallest id that it reaches.

    An edge without an end, or from a node to itself, counts for nothing. Tasks first contract the
    edges they hold, a bounded number each; where one task holds all of them that's the end. Else
    star rounds follow until nothing changes, each written to the shared folder; the driver sees only
    two sums a round.
    """
    a, b = F.col(left).cast("long"), F.col(right).cast("long")
    now = cut(edges.where(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")), "edges")
    parts = now.count() // local_edges + 1
    now = cut(_contracted(now, parts), "contracted")
    seen = None
    for _ in range(most_rounds if parts > 1 else 0):
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state[0] == 0 or tuple(state) == seen:
            break
        seen = tuple(state)
        now = cut(_round(now), "edges")
    else:
        if parts > 1:
            raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    stars = now.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return stars.union(now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
