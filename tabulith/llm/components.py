"""Connected components of an edge list, by local unions and jumps to parents.

Edges point from their larger to their smaller end. Each task first replaces its own edges by stars, so
a node, however many edges it has, is the larger end of one edge a task at most. Then come rounds. Edges
meet by their larger end: unions of what a task holds give each of these nodes one parent, and edges
between nodes that had a common child. Then each edge's smaller end gives way to that end's parent, in
a join of two plain shuffles, which adaptive execution splits where one end is in many edges. The round
in which nothing moves leaves stars. Every round ends with a checkpoint, so lost executors cost one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .common import stage

#: Edges that a task takes together.
EDGES = 200_000


def local_roots(a: list[int], b: list[int]) -> dict[int, int]:
    """The smallest node that each node of some edges reaches by them."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for x, y in zip(a, b, strict=True):
        root.setdefault(x, x)
        root.setdefault(y, y)
        r, s = find(x), find(y)
        root[max(r, s)] = min(r, s)
    return {x: find(x) for x in root}


def _chunks(batches: Iterator[pa.RecordBatch], whole: bool) -> Iterator[tuple[list[int], list[int]]]:
    """Edges, EDGES or a few more at a time; with ``whole`` equal u, which are neighbours, stay together."""
    u, v = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    for batch in batches:
        u, v = (np.concatenate([x, batch.column(i).to_numpy(zero_copy_only=False)]) for i, x in enumerate((u, v)))
        if len(u) >= EDGES:
            at = int(np.searchsorted(u, u[-1])) if whole else len(u)
            if at:
                yield u[:at].tolist(), v[:at].tolist()
                u, v = u[at:], v[at:]
    if len(u):
        yield u.tolist(), v.tolist()


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for u, v in _chunks(batches, False):
        rows = [(x, r) for x, r in local_roots(u, v).items() if x != r]
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in rows], pa.int64()), pa.array([r for _, r in rows], pa.int64())], names=["u", "v"])


def _unions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by u -> stars; ``own`` marks the parent of a node whose edges are all here."""
    for u, v in _chunks(batches, True):
        own = set(u)
        rows = [(x, r) for x, r in local_roots(u, v).items() if x != r]
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in rows], pa.int64()), pa.array([r for _, r in rows], pa.int64()), pa.array([x in own for x, _ in rows], pa.bool_())], names=["u", "v", "own"])


def connected_components(edges: DataFrame, a: str, b: str, starred: bool = False) -> DataFrame:
    """(node, component) of every node that has an edge; the component is its smallest node.

    ``starred`` says that tasks have made stars to smallest nodes of their edges, so the first step is
    left out. Null ends and loops are left out; repeated edges count once; no edges give no rows.
    """
    # a fixed number, for both sides of the join must see the same partitions
    n = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    given = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u <> v")
    now = given.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    if not starred:
        now = now.mapInArrow(_stars, "u long, v long")
    while True:
        met = now.repartition(n, "u").sortWithinPartitions("u").mapInArrow(_unions, "u long, v long, own boolean")
        parents = met.where("own").select(F.col("u").alias("p"), F.col("v").alias("pp"))
        seen = Observation()
        moved = F.coalesce(F.max((F.col("pp").isNotNull() | ~F.col("own")).cast("int")), F.lit(0)).alias("moved")
        now = stage(met.join(parents, F.col("v") == F.col("p"), "left").observe(seen, moved).select("u", F.coalesce("pp", "v").alias("v")))
        if not seen.get["moved"]:
            break
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())
