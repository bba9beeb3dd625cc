"""Embedding near-duplicates by NN-descent.

A neighbour graph (each vector's best candidates so far) starts from leaves of
random-projection orders and is refined round by round: at every vector its
neighbours, in both directions, meet, and whoever improves another's list
enters it.  Lists whose last entry is still above the threshold are saturated
and double.  A leaf or meeting also emits, whatever the lists have room for,
pairs that connect all its vectors which its pairs at or above the threshold
connect, so no link between components that is met gets lost.

The kept edges give components (distributed union-find).  Links only run inside
a component, so link counts are then completed exactly there: vectors within
half the threshold angle of the component's centre all link with each other (the
triangle inequality on angles), the others are compared with the whole component
in blocks.  A dense group costs its size, not its square, and no pairs of a group
are written out.

Recall is audited: a bounded set of vectors is compared with all of them, and
their recalls are averaged per vector and per group.  While either is below the
target another set of projections is added and refined; if none is left to try,
that is an error.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch
from .components import components

THRESHOLD = 0.95
#: Neighbours in a list at first.
K = 8
#: Random-projection orders at least (``orders_for`` adds some for more rows), the vectors compared in a leaf of one, and the projections in its code.
ORDERS, LEAF, BITS = 6, 256, 32
#: Vectors that meet at a vector at once; a hub's neighbours meet in groups of so many, dealt anew at each vector and round.
GROUP = 256
HUB = 4096
MAX_ROUNDS = 8
#: A round that joins no components and finds new links for less than this share of the vectors is the last one.
DELTA = 0.001
#: Vectors compared with all others to measure recall, and the recall to reach.
AUDIT, TARGET, ATTEMPTS = 1024, 0.98, 8
BLOCK = 2048
_EPS = 1e-6
_SEED = 42


def orders_for(n: int, threshold: float) -> int:
    """Orders that let an isolated pair at the threshold share a leaf of ``n`` vectors with probability TARGET.

    A pair shares a leaf if the bits that tell leaves apart agree, as each does
    with probability 1 - angle / pi.
    """
    share = (1 - math.acos(threshold) / math.pi) ** math.log2(max(n / LEAF, 1))
    return max(ORDERS, math.ceil(math.log(1 - TARGET) / math.log(1 - share)) if share < 1 else 1)


def valid(v: str) -> str:
    """SQL condition: a vector that can link (not null, empty or zero, no null or non-finite component)."""
    return (f"{v} IS NOT NULL AND NOT exists({v}, x -> x IS NULL OR isnan(x) OR abs(x) = double('Infinity')) "
            f"AND exists({v}, x -> x <> 0)")


def _matrix(column: pa.Array) -> np.ndarray:
    """Unit rows, in double precision, of a list column whose rows have one length."""
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # tiny and huge vectors keep their direction
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _forest(near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(i, j): pairs of ``near`` that connect all that its pairs connect, one fewer than the rows of each group."""
    left = near.any(axis=1)
    i, j = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    while left.any():
        todo = [int(np.argmax(left))]
        left[todo[0]] = False
        while todo and left.any():
            at = todo.pop()
            hit = np.flatnonzero(near[at] & left)
            left[hit] = False
            todo.extend(hit.tolist())
            i.append(np.full(len(hit), at))
            j.append(hit)
    return np.concatenate(i), np.concatenate(j)


def _best(ids: np.ndarray, x: np.ndarray, k: np.ndarray, worst: np.ndarray,
          threshold: float | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, sim): for each of the rows its best partners among them, at most k and only above worst.

    With a threshold, if any pair that reaches it is not among these, also a
    spanning forest of all pairs that do.
    """
    n = len(ids)
    if n < 2:
        return ids[:0], ids[:0], np.empty(0)
    s = x @ x.T
    s[ids[:, None] == ids[None, :]] = -2
    m = min(int(k.max()), n - 1)
    at = np.argpartition(-s, m - 1, axis=1)[:, :m]
    sim = np.take_along_axis(s, at, axis=1)
    order = np.argsort(-sim, axis=1, kind="stable")
    at, sim = np.take_along_axis(at, order, axis=1), np.take_along_axis(sim, order, axis=1)
    good = (sim > worst[:, None]) & (np.arange(m)[None, :] < k[:, None])
    row, col = np.nonzero(good)
    a, b, sim = row, at[row, col], sim[row, col]
    if threshold is not None:
        near = s >= threshold
        left = near.copy()
        left[a, b] = left[b, a] = False
        if left.any():
            i, j = _forest(near)
            a, b, sim = np.r_[a, i], np.r_[b, j], np.r_[sim, s[i, j]]
    return ids[a], ids[b], sim


def _edges(parts) -> pa.RecordBatch:
    a, b, sim = (np.concatenate([p[c] for p in parts]) if parts else np.empty(0) for c in range(3))
    return pa.RecordBatch.from_arrays([pa.array(a.astype(np.int64)), pa.array(b.astype(np.int64)), pa.array(sim.astype(np.float64))],
                                      names=["a", "b", "sim"])


EDGE = "a long, b long, sim double"


def projected_neighbours(nodes: DataFrame, orders: range, k: int, threshold: float = THRESHOLD) -> DataFrame:
    """Edges between vectors that stand close in one of the random-projection orders.

    Vectors of one code are in a seeded random order, so a hot code is split
    over tasks by the range partitioning like any other run of rows.
    """

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.diff(batch.column(1).offsets.to_numpy())
            for dim in np.unique(sizes):
                part = batch.filter(pa.array(sizes == dim))
                x = _matrix(part.column(1))
                for t in orders:
                    rng = np.random.default_rng([_SEED, t, int(dim)])
                    up = (x @ rng.standard_normal((int(dim), BITS))) > 0
                    code = (up @ (1 << np.arange(BITS, dtype=np.int64)[::-1])).astype(np.int64)
                    one = lambda value: pa.array(np.full(len(part), value, np.int32))
                    yield pa.RecordBatch.from_arrays([one(t), one(dim), pa.array(code), part.column(0), part.column(1)],
                                                     names=["t", "dim", "code", "node", "v"])

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def close(rows: pa.Table):
            ids = rows.column("node").to_numpy()
            x = _matrix(rows.column("v").combine_chunks())
            return _best(ids, x, np.full(len(ids), k), np.full(len(ids), -1.5), threshold)

        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch.select(["t", "dim", "node", "v"])])
            table = table if rest is None else pa.concat_tables([rest, table]).combine_chunks()
            key = table.column("t").to_numpy().astype(np.int64) << 32 | table.column("dim").to_numpy()
            cuts = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1), len(key)]
            found, done = [], 0
            for lo, hi in zip(cuts, cuts[1:]):
                while hi - lo >= 2 * LEAF or (hi < len(key) and hi > lo):
                    n = min(LEAF, hi - lo) if hi - lo >= 2 * LEAF else hi - lo
                    found.append(close(table.slice(lo, n)))
                    lo += n
                done = lo
            rest = table.slice(done)
            yield _edges(found)
        if rest is not None and rest.num_rows:
            yield _edges([close(rest)])

    kind = nodes.schema["v"].dataType.simpleString()
    codes = nodes.select("node", "v").mapInArrow(project, f"t int, dim int, code long, node long, v {kind}")
    order = ["t", "dim", "code", F.xxhash64("node", "t")]
    return codes.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(leaves, EDGE)


def _lists(edges: DataFrame, sizes: DataFrame | None) -> DataFrame:
    """Best entries of each list: (a, b, sim, k); a list has k entries at most."""
    best = edges.groupBy("a", "b").agg(F.max("sim").alias("sim"))
    if sizes is not None:
        best = best.join(sizes.select(F.col("node").alias("a"), "k"), "a")
    else:
        best = best.withColumn("k", F.lit(K))
    rank = F.row_number().over(Window.partitionBy("a").orderBy(F.col("sim").desc(), "b"))
    return best.withColumn("rank", rank).where("rank <= k").drop("rank")


def refine(nodes: DataFrame, lists: DataFrame, sizes: DataFrame, scratch: Scratch, threshold: float = THRESHOLD,
           turn: int = 0) -> DataFrame:
    """Edges that improve some list or connect vectors, found where neighbours of one vector meet."""
    around = lists.select(F.col("a").alias("centre"), F.col("b").alias("member"))
    around = around.union(around.select("member", "centre")).union(sizes.select("node", "node")).distinct()
    hubs = scratch.table(around.groupBy("centre").agg(F.count("*").alias("n")).where(F.col("n") > HUB)
                         .select(F.col("centre").alias("hub"), F.ceil(F.col("n") / HUB).alias("blocks")), "hubs")
    around = around.join(hubs, F.col("centre") == F.col("hub"), "left").withColumn(
        "block", F.coalesce(F.pmod(F.xxhash64("member", "centre", F.lit(turn)), F.col("blocks")), F.lit(0)))
    vectors = nodes.select("node", "v").join(sizes.select(F.col("node").alias("n2"), "k", "worst"), F.col("node") == F.col("n2"))
    vectors = scratch.table(vectors.select("node", "v", "k", "worst"), "vectors")
    meeting = around.join(vectors, F.col("member") == F.col("node")).select("centre", "block", "node", "v", "k", "worst")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if rest is None else pa.concat_tables([rest, table]).combine_chunks()
            centre, block = table.column("centre").to_numpy(), table.column("block").to_numpy()
            cuts = [0, *(np.flatnonzero((centre[1:] != centre[:-1]) | (block[1:] != block[:-1])) + 1), len(centre)]
            yield _edges([e for lo, hi in zip(cuts[:-2], cuts[1:-1]) for e in groups(table, lo, hi)])
            rest = table.slice(cuts[-2])
        if rest is not None and rest.num_rows:
            yield _edges(groups(rest, 0, rest.num_rows))

    def groups(table, lo, hi):
        ids, k, worst = (table.column(c).slice(lo, hi - lo).to_numpy() for c in ("node", "k", "worst"))
        x = _matrix(table.column("v").slice(lo, hi - lo).combine_chunks())
        return [_best(ids[i:i + GROUP], x[i:i + GROUP], k[i:i + GROUP], worst[i:i + GROUP], threshold) for i in range(0, hi - lo, GROUP)]

    dealt = meeting.repartition("centre", "block").sortWithinPartitions("centre", "block", F.xxhash64("node", "centre", F.lit(-1 - turn)))
    return dealt.mapInArrow(meet, EDGE)


def _sizes(nodes: DataFrame, lists: DataFrame, threshold: float) -> DataFrame:
    """(node, k, worst, saturated): the size each list may have next, and the similarity to beat.

    A full list above the threshold doubles; lists with room take anything.
    """
    state = lists.groupBy("a").agg(F.min("sim").alias("low"), F.count("*").alias("n"), F.max("k").alias("size"))
    full = F.col("n") >= F.col("size")
    saturated = F.coalesce(full & (F.col("low") >= threshold), F.lit(False))
    k = F.coalesce("size", F.lit(K)) * F.when(saturated, 2).otherwise(1)
    return (nodes.select("node").join(state, F.col("node") == F.col("a"), "left")
            .select("node", k.cast("int").alias("k"), F.when(full & ~saturated, F.col("low")).otherwise(-1.5).alias("worst"),
                    saturated.alias("saturated")))


def _across(fresh: DataFrame, joined: DataFrame) -> DataFrame:
    """(ca, cb): the components, a vector without links being its own, that the links ``fresh`` join."""
    of = lambda end: joined.select(F.col("node").alias(f"n{end}"), F.col("component").alias(f"c{end}"))
    ends = (fresh.join(of("a"), F.col("a") == F.col("na"), "left").join(of("b"), F.col("b") == F.col("nb"), "left")
            .select(F.coalesce("ca", "a").alias("ca"), F.coalesce("cb", "b").alias("cb")))
    return ends.where("ca <> cb").distinct()


def _merged(joined: DataFrame, across: DataFrame, scratch: Scratch) -> DataFrame:
    """``joined`` (node, component) after its components were joined by ``across``; only these are gone through."""
    up = components(across, scratch).select(F.col("node").alias("old"), F.col("component").alias("new"))
    moved = joined.join(up, F.col("component") == F.col("old"), "left").select("node", F.coalesce("new", "component").alias("component"))
    single = up.join(joined, F.col("old") == F.col("node"), "left_anti").select("old", "new")
    return scratch.table(moved.union(single), "joined")


def _descend(nodes: DataFrame, edges: DataFrame, scratch: Scratch, threshold: float, max_rounds: int, n: int) -> DataFrame:
    """(node, component) by the links met while the graph that starts from ``edges`` is refined until nothing new turns up."""
    pair = lambda e: e.where(F.col("sim") >= threshold).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    links = scratch.table(pair(edges), "links")
    joined = components(links, scratch)
    lists = scratch.table(_lists(edges, None), "lists")
    for turn in range(max_rounds):
        sizes = scratch.table(_sizes(nodes, lists, threshold), "sizes")
        found = scratch.table(refine(nodes, lists, sizes, scratch, threshold, turn), "found")
        fresh = scratch.table(pair(found).join(links, ["a", "b"], "left_anti"), "links")
        # links of saturated lists inside their component are completed there: only those that join two keep the rounds going
        across = scratch.table(_across(fresh, joined), "across")
        joins = across.count()
        open_ = sizes.where("NOT saturated").select(F.col("node").alias("a"))
        news = fresh.join(open_, "a", "left_semi").count()
        lists = scratch.table(_lists(lists.select("a", "b", "sim").union(found), sizes), "lists")
        links = links.union(fresh)
        if joins:
            joined = _merged(joined, across, scratch)
        elif news <= DELTA * n:
            break
    return joined


def link_counts(nodes: DataFrame, found: DataFrame, scratch: Scratch, threshold: float) -> DataFrame:
    """(node, component, n_links) for the nodes of ``found``; copies of a vector (w of them) count as vectors.

    Exact within each component.
    """
    own = found.join(nodes, found["node"] == nodes["node"]).select("component", nodes["node"], "w", "v")
    # by the largest component first: lengths of tiny and huge vectors would leave the range of a double
    own = own.withColumn("u", F.expr("transform(v, x -> cast(x AS double) / cast(array_max(transform(v, y -> abs(y))) AS double))"))
    norm = F.sqrt(F.aggregate("u", F.lit(0.0), lambda s, x: s + x * x))
    own = scratch.table(own.withColumn("norm", norm).withColumn("u", F.expr("transform(u, x -> x / norm)")), "own")
    spread = own.select("component", F.posexplode("u").alias("pos", "x"))
    centre = (spread.groupBy("component", "pos").agg(F.sum("x").alias("x")).groupBy("component")
              .agg(F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("c"))
              .select(F.col("component").alias("of"), F.transform("c", lambda e: e["x"]).alias("c")))
    centre = scratch.table(centre.withColumn("c_norm", F.sqrt(F.aggregate("c", F.lit(0.0), lambda s, x: s + x * x))), "centre")
    dot = F.aggregate(F.zip_with("u", "c", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    angle = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.try_divide(dot, "c_norm"))))
    inner = F.coalesce(angle <= math.acos(threshold) / 2 - _EPS, F.lit(False))  # false also for a centre at the origin
    placed = scratch.table(own.join(centre, F.col("component") == F.col("of")).select("component", "node", "w", "v", inner.alias("inner")), "placed")
    sums = scratch.table(placed.groupBy("component").agg(
        F.count("*").alias("size"), F.sum(F.when(F.col("inner"), F.col("w")).otherwise(0)).alias("w_inner"),
        F.count_if(~F.col("inner")).alias("outer")).withColumnRenamed("component", "of"), "sums")
    parts = placed.join(sums, F.col("component") == F.col("of"))
    rest = parts.where(F.col("outer") > 0).withColumns({
        "rows": F.ceil(F.col("outer") / BLOCK), "cols": F.ceil(F.col("size") / BLOCK), "h": F.xxhash64("node")})
    cell = lambda r, c: F.xxhash64("component", r, c).alias("cell")
    side_a = rest.where("NOT inner").withColumn("c", F.explode(F.expr("sequence(0L, cols - 1)"))).select(
        cell(F.pmod("h", "rows"), F.col("c")), F.lit(0).alias("side"), "node", "w", "v", "inner")
    side_b = rest.withColumn("r", F.explode(F.expr("sequence(0L, rows - 1)"))).select(
        cell(F.col("r"), F.pmod("h", "cols")), F.lit(1).alias("side"), "node", "w", "v", "inner")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None

        def count(table):
            side = table.column("side").to_numpy()
            ids, w, inner = (table.column(c).to_numpy() for c in ("node", "w", "inner"))
            x = _matrix(table.column("v").combine_chunks())
            a, b = side == 0, side == 1
            near = (x[a] @ x[b].T >= threshold) & (ids[a][:, None] != ids[b][None, :])
            into = inner[b]
            return pa.RecordBatch.from_arrays(
                [pa.array(np.r_[ids[a], ids[b][into]]), pa.array(np.r_[near @ w[b], (w[a] @ near)[into]].astype(np.int64))], names=["node", "links"])

        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if rest is None else pa.concat_tables([rest, table]).combine_chunks()
            key = table.column("cell").to_numpy()
            cuts = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1), len(key)]
            for lo, hi in zip(cuts[:-2], cuts[1:-1]):
                yield count(table.slice(lo, hi - lo))
            rest = table.slice(cuts[-2])
        if rest is not None and rest.num_rows:
            yield count(rest)

    scanned = side_a.union(side_b).repartition("cell").sortWithinPartitions("cell", "side").mapInArrow(scan, "node long, links long")
    scanned = scanned.groupBy(F.col("node").alias("scanned")).agg(F.sum("links").alias("links"))
    total = F.col("w") - 1 + F.when(F.col("inner"), F.col("w_inner") - F.col("w")).otherwise(0) + F.coalesce("links", F.lit(0))
    return scratch.table(parts.join(scanned, F.col("node") == F.col("scanned"), "left")
                         .select("node", "component", total.cast("long").alias("n_links")), "counts")


def audit(nodes: DataFrame, counts: DataFrame, threshold: float, size: int = AUDIT) -> tuple[float, float]:
    """(found, there) of a set of at most ``size`` vectors, compared with all vectors in blocks.

    Their ratio is the recall: each vector's share of its links found, averaged
    over the vectors with links or, if that is lower, with each weighted by one
    over its group's size, so that neither small groups nor a hot one are
    outweighed.  Links between copies of a vector aren't counted.
    """
    few = nodes.orderBy(F.xxhash64("node", F.lit("audit"))).limit(size).select("node", "v", "w").toArrow()
    sizes = np.diff(few.column("v").combine_chunks().offsets.to_numpy()) if few.num_rows else np.empty(0, int)
    asked = {int(d): (few.column("node").to_numpy()[sizes == d], _matrix(few.column("v").combine_chunks().filter(pa.array(sizes == d))))
             for d in np.unique(sizes)}

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = np.diff(batch.column(1).offsets.to_numpy())
            for d in np.unique(dims):
                if d not in asked:
                    continue
                part = batch.filter(pa.array(dims == d))
                own, x = part.column(0).to_numpy(), _matrix(part.column(1))
                ids, q = asked[d]
                near = (q @ x.T >= threshold) & (ids[:, None] != own[None, :])
                got = near @ part.column(2).to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array(ids[got > 0]), pa.array(got[got > 0].astype(np.int64))], names=["id", "there"])

    there = nodes.select("node", "v", "w").mapInArrow(compare, "id long, there long").groupBy("id").agg(F.sum("there").alias("there"))
    got = there.join(counts.join(nodes.select(F.col("node").alias("n2"), "w"), F.col("node") == F.col("n2")), F.col("id") == F.col("node"), "left")
    links = F.least(F.greatest(F.coalesce(F.col("n_links") - F.col("w") + 1, F.lit(0)), F.lit(0)), F.col("there"))
    rows = got.select(links.alias("links"), "there").collect()  # ``size`` at most
    if not rows:
        return 0, 0
    recall, there = np.array([r.links / r.there for r in rows]), np.array([r.there for r in rows], float)
    both = [(float((weight * recall).sum()), float(weight.sum())) for weight in (np.ones(len(rows)), 1 / (there + 1))]
    return min(both, key=lambda x: x[0] / x[1])


def near_duplicates(vectors: DataFrame, scratch: Scratch, threshold: float = THRESHOLD) -> tuple[DataFrame, list[tuple[float, float]]]:
    """((vec_id, n_links, component_id, kept) per row of ``vectors``, the audits: see ``audit``).

    Columns vec_id and embedding are read.  component_id is the smallest vec_id
    reachable over pairs of cosine ``threshold`` or more.  Null, empty and zero
    vectors, those with a null or non-finite component, and rows without vec_id
    link with nothing, nor do vectors of different lengths.  Equal vectors are
    one node (they link with each other).  An empty table gives no rows.
    Recall that stays below the target after ATTEMPTS sets of orders is an error.
    """
    src = vectors.select("vec_id", F.expr(f"CASE WHEN vec_id IS NOT NULL AND {valid('embedding')} THEN embedding END").alias("v"))
    nodes = scratch.table(src.where("v IS NOT NULL").groupBy("v").agg(F.min("vec_id").alias("node"), F.count("*").alias("w"))
                          .select("node", "v", "w"), "nodes")
    n = nodes.count()
    copies = scratch.table(nodes.where("w > 1").select(F.col("v").alias("cv"), F.col("node").alias("first"),
                                                       F.col("w").alias("copies")), "copies")
    audits: list[tuple[float, float]] = []
    found, orders = None, orders_for(n, threshold)
    for attempt in range(ATTEMPTS):
        edges = scratch.table(projected_neighbours(nodes, range(attempt * orders, (attempt + 1) * orders), K, threshold), "projected")
        met = _descend(nodes, edges, scratch, threshold, MAX_ROUNDS, n)
        found = met if found is None else components(found.union(met), scratch)
        counts = link_counts(nodes, found, scratch, threshold)
        audits.append(audit(nodes, counts, threshold))
        if audits[-1][0] >= TARGET * audits[-1][1]:
            break
    else:
        raise RuntimeError(f"recall below {TARGET} after {ATTEMPTS} sets of {orders} orders; audits (found, there): {audits}")
    rows = src.join(copies, F.col("v") == F.col("cv"), "left").select(
        "vec_id", F.when(F.col("v").isNotNull(), F.coalesce("first", "vec_id")).alias("of"), "first",
        F.coalesce(F.col("copies") - 1, F.lit(0)).alias("same"))
    out = rows.join(counts, F.col("of") == F.col("node"), "left").select(
        "vec_id", F.coalesce("n_links", "same").cast("long").alias("n_links"),
        F.coalesce("component", "first", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id")), audits
