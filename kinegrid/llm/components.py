"""Connected components of an edge table: a forest in each partition first, then alternating large-star and small-star rounds."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinegrid.llm.common import cut, in_tasks

#: Edges that a task joins into a forest at a time.
FOREST_EDGES = 1_000_000


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (node, smallest node joined to it) in place of as many or more edges."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.setdefault(x, x)) != x:
            root[x] = root[up]
            x = up
        return x

    def out() -> pa.RecordBatch:
        pairs = [(x, r) for x in list(root) if (r := find(x)) != x]
        root.clear()
        return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], ["u", "v"])

    seen = 0
    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = find(u), find(v)
            root[max(a, b)] = min(a, b)
        seen += batch.num_rows
        if seen >= FOREST_EDGES:
            yield out()
            seen = 0
    yield out()


def _round(edges: DataFrame) -> DataFrame:
    """A large-star, then a small-star round."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    down = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    return down.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u != v").distinct()


def _are_stars(edges: DataFrame) -> bool:
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return not ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up + down > 1").limit(1).count()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node and label (the smallest node of its component) of every node of edges (u, v: long) but the smallest ones. Each round is written to the shared folder."""
    edges = cut(in_tasks(edges, _forest, "u long, v long"), "forest")
    for _ in range(rounds):
        edges = cut(_round(edges), "stars")
        if _are_stars(edges):
            return edges.select(F.col("u").alias("node"), F.col("v").alias("label"))
    raise RuntimeError(f"components did not settle in {rounds} rounds")
