"""Merkle dataset manifest: subtree exchange between cogrouped superblocks.

Every row is a leaf; the leaves of a group, in order, form a tree in which each
run of ``FANOUT`` consecutive nodes becomes the hash of its members, until one
node is left (the subroot); the groups' subroots, in order, form the root tree.

* Leaves get exact positions from one range partitioning and per-partition
  offsets, so a group of any size is spread over many tasks.
* Upwards, ``FANOUT ** HEIGHT`` consecutive nodes (a superblock) are reduced in
  one task to the node that stands for them; those are the next, 4096 times
  smaller table, until every tree is one node.
* Downwards, a superblock's nodes are cogrouped with the outer nodes that its
  proofs need beyond it (a row of at most 7 hashes a level).  One pass over the
  superblock finishes the local reduction, joins local and outer siblings into
  proofs, and folds the leaf under test up to the root.

A task holds one superblock; the driver sees one number a table.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

FANOUT = 8
#: Levels of a superblock: FANOUT ** HEIGHT = 4096 nodes.
HEIGHT = 4
_PATH = "slots array<int>, proof array<array<string>>"


def digest(*columns: str | Column) -> Column:
    """Lowercase hex SHA-256 of the columns: ``-`` for a null, else UTF-8 byte count, ``:``, value."""
    def part(c):
        text = (F.col(c) if isinstance(c, str) else c).cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))
    return F.sha2(F.concat(*(part(c) for c in columns)).cast("binary"), 256)


def node_hash(members: list[str]) -> str:
    return hashlib.sha256("".join(members).encode()).hexdigest()


def levels(nodes: list[str], total: int, fanout: int, height: int) -> list[list[str]]:
    """The nodes and their reductions: ``height`` more levels, fewer if the whole tree (``total`` nodes) needs fewer."""
    out = [nodes]
    while len(out) <= height and total > 1:
        low = out[-1]
        out.append([node_hash(low[i:i + fanout]) for i in range(0, len(low), fanout)])
        total = -(-total // fanout)
    return out


def fold(leaf: str, slots, proof) -> str:
    """The root that ``leaf`` leads to: at every level it is put at its slot among its siblings."""
    for slot, siblings in zip(slots, proof):
        siblings = list(siblings)
        leaf = node_hash(siblings[:slot] + [leaf] + siblings[slot:])
    return leaf


def place(leaves: DataFrame, scratch: Scratch) -> DataFrame:
    """Adds tree (number of the group in order), pos (in the group, from 0) and n (rows of the group).

    Rows (grp, key, leaf, ...) are ordered by grp, key, leaf with nulls first.
    Two small tables carry counts across partitions: a row per partition, and a
    row per partition and group in it.
    """
    order = [F.col(c).asc_nulls_first() for c in ("grp", "key", "leaf")]
    ranged = leaves.repartitionByRange(*order).withColumn("part", F.spark_partition_id())
    inside = Window.partitionBy("part")
    ranged = (scratch.table(ranged, "ranged").withColumn("rn", F.row_number().over(inside.orderBy(*order)))
              .withColumn("run", F.dense_rank().over(inside.orderBy(F.col("grp").asc_nulls_first()))))
    runs = scratch.table(ranged.groupBy("part", "run").agg(F.count("*").alias("held"), F.first("grp").alias("grp")), "runs")
    before = Window.partitionBy("grp").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = (runs.withColumn("carried", F.coalesce(F.sum("held").over(before), F.lit(0)))
            .withColumn("n", F.sum("held").over(Window.partitionBy("grp")))
            .withColumn("skipped", F.coalesce(F.sum("held").over(
                inside.orderBy("run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))))
    runs = scratch.table(runs, "carried")
    # groups that start in a partition, summed over the partitions before it
    starts = runs.groupBy("part").agg(F.count_if(F.col("carried") == 0).alias("new"), F.min_by("carried", "run").alias("open"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.select(F.col("part").alias("p"), (F.coalesce(F.sum("new").over(earlier), F.lit(0))
                                                      - (F.col("open") > 0).cast("long") - 1).alias("base"))
    runs = runs.join(starts, F.col("part") == F.col("p")).select(
        F.col("part").alias("p"), F.col("run").alias("r"), "n", (F.col("base") + F.col("run")).alias("tree"),
        (F.col("carried") - F.col("skipped") - 1).alias("shift"))
    return (ranged.join(runs, (F.col("part") == F.col("p")) & (F.col("run") == F.col("r")))
            .withColumn("pos", F.col("rn") + F.col("shift")).select(*leaves.columns, "tree", "pos", "n"))


def _reduce(nodes: DataFrame, fanout: int, height: int) -> DataFrame:
    """(tree, pos, n, node): the next table up, one row per superblock of ``nodes``."""
    size = fanout ** height

    def top(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("pos")
        n = int(group["n"].iloc[0])
        node = levels(group["node"].tolist(), n, fanout, height)[-1][0]
        return pd.DataFrame({"tree": group["tree"].iloc[:1], "pos": group["pos"].iloc[:1] // size, "n": -(-n // size), "node": node})

    keyed = nodes.select("tree", "pos", "n", "node", F.expr(f"pos DIV {size}").alias("block"))
    return keyed.groupBy("tree", "block").applyInPandas(top, "tree long, pos long, n long, node string")


def _exchange(nodes: DataFrame, outer: DataFrame, fanout: int, height: int, given: list[str]) -> DataFrame:
    """``nodes`` with slots, proof, folded (from column ``test``) and the ``given`` columns of their superblock's outer row."""
    size = fanout ** height
    own = nodes.columns

    def finish(group: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("pos").reset_index(drop=True)
        above = above.iloc[0]
        steps = levels(group["node"].tolist(), int(group["n"].iloc[0]), fanout, height)[:-1]
        outer_slots, outer_proof = list(above["slots"]), [list(x) for x in above["proof"]]
        slots, proof, folded = [], [], []
        for i, test in enumerate(group["test"]):
            at, mine, sides = i, [], []
            for low in steps:
                start = at - at % fanout
                mine.append(at - start)
                sides.append(low[start:at] + low[at + 1:start + fanout])
                at //= fanout
            slots.append(mine + outer_slots)
            proof.append(sides + outer_proof)
            folded.append(fold(test, slots[-1], proof[-1]))
        return group[own].assign(slots=slots, proof=proof, folded=folded, **{c: above[c] for c in given})

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in nodes.schema] + [_PATH, "folded string"]
                       + [f"{c} string" for c in given])
    left = nodes.withColumn("block", F.expr(f"pos DIV {size}"))
    return left.groupBy("tree", "block").cogroup(outer.groupBy("tree", "pos")).applyInPandas(finish, schema)


def _climb(nodes: DataFrame, scratch: Scratch, fanout: int, height: int) -> list[DataFrame]:
    """Tables from ``nodes`` up to the one in which every tree is a single node."""
    out = [nodes]
    while (out[-1].agg(F.max("n")).first()[0] or 0) > 1:
        out.append(scratch.table(_reduce(out[-1], fanout, height), "nodes"))
    return out


def _descend(tables: list[DataFrame], outer: DataFrame, scratch: Scratch, fanout: int, height: int, given: list[str]) -> DataFrame:
    """Outer rows (tree, pos, slots, proof, given) of every node of the lowest of ``tables``."""
    for nodes in reversed(tables):
        found = _exchange(nodes.withColumn("test", F.col("node")), outer, fanout, height, given)
        outer = scratch.table(found.select("tree", "pos", "slots", "proof", *given), "outer")
    return outer


def manifest(leaves: DataFrame, scratch: Scratch, fanout: int = FANOUT, height: int = HEIGHT) -> DataFrame:
    """Per row of ``leaves`` (grp, key, leaf, test): those, subroot, root, slots, proof, folded_root, verified.

    ``leaf`` and ``test`` are hex digests; ``test`` is folded with the leaf's
    proof and verified if it reaches the root.  ``proof`` lists the siblings of
    each level, left to right, from the leaf's run up to the root; ``slots`` the
    node's place among them.  Groups ascend by grp and leaves by key (nulls
    first), equal keys by leaf; repeated rows are leaves of their own.  A null
    grp is a group.  Other columns are ignored; an empty table gives no rows.
    """
    placed = scratch.table(place(leaves.select("grp", "key", "leaf", "test"), scratch)
                           .withColumnRenamed("leaf", "node"), "placed")
    trees = _climb(placed, scratch, fanout, height)
    subroots = trees[-1]  # one node a tree
    tops = scratch.table(subroots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").cast("long").alias("pos"),
                                         subroots.agg(F.count("*")).scalar().alias("n"), "node"), "tops")
    above = _climb(tops, scratch, fanout, height)
    root = above[-1].select("tree", "pos", F.array().cast("array<int>").alias("slots"),
                            F.array().cast("array<array<string>>").alias("proof"), F.col("node").alias("root"))
    outer = _descend(above[1:-1], root, scratch, fanout, height, ["root"])
    outer = scratch.table(_exchange(tops.withColumn("test", F.col("node")), outer, fanout, height, ["root"]), "paths")
    # a tree's own uppermost table has its subroot at position 0
    outer = outer.select(F.col("pos").alias("tree"), F.lit(0).cast("long").alias("pos"), "slots", "proof",
                         F.col("node").alias("subroot"), "root")
    given = ["subroot", "root"]
    outer = _descend(trees[1:-1], outer, scratch, fanout, height, given)
    # pandas has no null integers: keys pass through as text
    found = _exchange(placed.withColumn("key", F.col("key").cast("string")), outer, fanout, height, given)
    return found.select("grp", F.col("key").cast(placed.schema["key"].dataType), F.col("node").alias("leaf"), "test", "subroot",
                        "root", "slots", "proof", F.col("folded").alias("folded_root"),
                        (F.col("folded") == F.col("root")).alias("verified"))
