"""Connected components of a large graph: distributed union-find.

Alternates large-star and small-star steps (Kiveris et al., "Connected
Components in MapReduce and Beyond", 2014): every step points neighbours at the
smallest node known to their group, so a component of any shape becomes a star
around its smallest node in O(log^2) rounds.  Once at most ``LAST_EDGES`` are
left, one task finishes them.  Edges never leave the executors; the driver sees
two numbers a round.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


#: Edges that one task finishes (some 30 MB of memory); more of them go through further rounds.
LAST_EDGES = 1 << 18


def _shrink(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find inside each batch: its edges become one star per local group (never more edges)."""
    for batch in batches:
        parent: dict = {}

        def find(x):
            root = x
            while (up := parent.setdefault(root, root)) != root:
                root = up
            while parent[x] != root:
                parent[x], x = root, parent[x]
            return root

        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = find(a), find(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
        pairs = [(x, find(x)) for x in list(parent)]
        pairs = [p for p in pairs if p[0] != p[1]]
        yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], batch.schema.field(k).type) for k in (0, 1)],
                                         names=["u", "v"])


def _finish(edges: DataFrame) -> DataFrame:
    """(node, component) of at most LAST_EDGES edges, in one task: roots are hooked onto smaller ones and paths halved, as arrays."""
    kind = edges.schema["u"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends = [(b.column(0), b.column(1)) for b in batches]
        if not ends:
            return
        sides = [np.concatenate([e[k].to_numpy(zero_copy_only=False) for e in ends]) for k in (0, 1)]
        nodes, at = np.unique(np.concatenate(sides), return_inverse=True)
        a, b = at[:len(sides[0])], at[len(sides[0]):]
        root = np.arange(len(nodes))
        while (root[a] != root[b]).any():
            x, y = root[a], root[b]
            np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
            while (root != root[root]).any():
                root = root[root]
        yield pa.RecordBatch.from_arrays([pa.array(nodes, ends[0][0].type), pa.array(nodes[root], ends[0][0].type)], names=["node", "component"])

    return edges.repartition(1).mapInArrow(run, f"node {kind}, component {kind}")


def components(edges: DataFrame, scratch: Scratch, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges`` (its first two columns, one orderable type).

    ``component`` is the smallest node reachable.  Self-loops and repeated
    edges are harmless; rows with a null end are ignored; an empty input gives
    an empty result.  Hub nodes: both inputs of each join are plain exchanges,
    so adaptive execution splits a hub's rows over several tasks.
    """
    a, b = edges.columns[:2]
    start = (edges.select(F.col(a).alias("u"), F.col(b).alias("v"))
             .where("u IS NOT NULL AND v IS NOT NULL AND u <> v")
             .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")))
    e = scratch.table(start.mapInArrow(_shrink, start.schema), "edges")
    if e.count() <= LAST_EDGES:
        return _finish(e)
    last = None
    for _ in range(max_rounds):
        # large-star: neighbours above u move to the smallest node around u
        both = e.union(e.select("v", "u"))
        low = scratch.table(both.groupBy("u").agg(F.min("v").alias("m"))
                            .select(F.col("u").alias("k"), F.least("u", "m").alias("m")), "low")
        large = both.join(low, F.col("u") == F.col("k")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e2 = scratch.table(large.distinct(), "edges")
        # small-star: neighbours below u, and u itself, move to the smallest of them
        low2 = scratch.table(e2.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "k"), "low")
        moved = e2.join(low2, F.col("u") == F.col("k")).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e3 = scratch.table(moved.union(low2.select("k", "m")).distinct(), "edges")
        n, s = e3.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long"))).first()
        for old in (e, low, e2, low2):
            scratch.drop(old)
        e = e3
        if n <= LAST_EDGES:
            return _finish(e)
        if (n, s) == last:
            break
        last = (n, s)
    else:
        raise RuntimeError(f"no fixed point after {max_rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
