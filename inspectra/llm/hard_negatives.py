"""Hard-negative mining over anchor clusters with shared candidate lists (in the manner of MAXIMUS).

Anchors are clustered by direction.  For a cluster with centre c whose members
lie within an angle B of c, every candidate v has the bound
``|u| |v| cos(max(0, angle(v, c) - B))`` on its inner product with any member u.
The candidates are sorted by that bound once for the cluster; its members walk
the one list block by block, each until the bound of what is left cannot reach
its answer any more.  So a walk ends certified, whatever the clustering is worth.

Two walks: an anchor's best rows of its own label (positives), then, for each
positive, its best rows of other labels inside a window of scores that the
positive fixes (negatives).

Anchors are a stated query set against all rows: groups of whole clusters meet
runs of candidates in cogrouped tasks.  A task holds one group and one run; what
it finds, a few rows an anchor, is merged by a ranking afterwards.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch
from .langid import cluster

#: Anchors that the centres are fitted on, about (those with the smallest hash part); all anchors are assigned.
SAMPLE_ANCHORS = 16_384
MAX_CLUSTERS = 256
#: Anchors of one task, at most; a larger cluster is dealt over several.
GROUP_ANCHORS = 65_536
#: Candidates of one task: at most, and at least where there are so many.
RUN_ROWS, MIN_RUN_ROWS = 65_536, 4096
#: Members and candidates whose scores are held at once.
BLOCK = 1024
#: Relative room for rounding in a bound.
_SLACK = 1e-9
_FOUND = "anchor long, slot int, other long, score long"


def scaled(vector: str | Column, factor: int = 256) -> Column:
    """Components as floor(factor * x); null for a vector that is null, holds null or non-finite components, or is too long.

    Too long: squared length of 2**62 or more, whose scores might not fit in a long.
    """
    v = F.col(vector) if isinstance(vector, str) else vector
    x = F.transform(v, lambda c: c.cast("double"))
    finite = F.forall(x, lambda c: F.coalesce(F.abs(c) < float("inf"), F.lit(False)) & ~F.isnan(c))
    y = F.transform(x, lambda c: F.floor(c * factor).cast("double"))
    short = F.aggregate(y, F.lit(0.0), lambda acc, c: acc + c * c) < float(2 ** 62)
    return F.when(finite, F.when(short, F.transform(y, lambda c: c.cast("int"))))


def _matrix(column: pa.ChunkedArray | pa.Array, width: int = 0) -> np.ndarray:
    """Rows of a list column, shorter ones filled with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    ends = column.offsets.to_numpy()
    sizes = np.diff(ends)
    out = np.zeros((len(sizes), max(width, int(sizes.max(initial=0)))), np.int64)
    out[np.arange(out.shape[1]) < sizes[:, None]] = column.values.to_numpy()[ends[0]:ends[-1]]
    return out


def _part(whole: np.ndarray, share: int, of: int, up: bool) -> np.ndarray:
    """whole * share / of rounded up or down, exact in 64 bits for 0 <= share <= of."""
    high, low = np.divmod(whole, of)
    return high * share + (-(-low * share // of) if up else low * share // of)


def _best(row: np.ndarray, score: np.ndarray, name: np.ndarray, k: int) -> np.ndarray:
    """Places of the k first entries of each row: higher scores, then smaller names."""
    order = np.lexsort((name, -score, row))
    rank = np.arange(len(order)) - np.searchsorted(row[order], row[order], "left")
    return order[rank < k]


def walk(x: np.ndarray, x_ok, low: np.ndarray, high: np.ndarray, centre: np.ndarray, c: np.ndarray, names: np.ndarray, k: int):
    """Members' first k candidates in each of their score windows, and the number of candidates each member saw.

    x: members x dim; c: candidates x dim; low, high: members x windows (inclusive; an
    empty window has low > high); x_ok(members, candidates) -> may they meet.
    Returns (member, window, candidate, score) arrays and the walked lengths.
    """
    length = lambda v: np.sqrt((v.astype(float) ** 2).sum(axis=1))
    x_len, c_len = length(x), length(c)
    angle = lambda v, n: np.where(n > 0, np.arccos(np.clip(v @ centre / np.where(n > 0, n, 1), -1, 1)), 0.0)
    wide = angle(x, x_len).max(initial=0.0)
    bound = c_len * np.cos(np.clip(angle(c, c_len) - wide - 1e-7, 0, np.pi))
    order = np.argsort(-bound, kind="stable")
    bound = bound[order]
    exact = x_len.max(initial=0) * c_len.max(initial=0) < 2 ** 52
    xs, cs = (x.astype(float), c.astype(float)) if exact else (x, c)
    need = low.copy()  # the score that an answer must reach, per window
    closed = low > high
    got = [np.empty(0, np.int64)] * 4
    active, walked, at = np.flatnonzero(~closed.all(axis=1)), np.zeros(len(x), np.int64), 0
    while at < len(order) and len(active):
        most = x_len[active] * bound[at]
        left = np.where(closed[active], np.iinfo(np.int64).max, need[active]).min(axis=1)
        active = active[most + _SLACK * x_len[active] * c_len.max() + 1e-6 >= left]
        if not len(active):
            break
        block = order[at:at + BLOCK]
        at += len(block)
        walked[active] = at
        score = (xs[active] @ cs[block].T).astype(np.int64)
        may = x_ok(active, block)
        for w in range(low.shape[1]):
            lo, hi = need[active, w], high[active, w]
            ok = may & (score >= lo[:, None]) & (score <= hi[:, None])
            many = ok.sum(axis=1) > k
            if many.any():  # only those that reach the block's own k-th score
                s = np.where(ok[many], score[many], np.iinfo(np.int64).min)
                ok[many] &= score[many] >= np.partition(s, len(block) - k, axis=1)[:, [len(block) - k]]
            m, n = np.nonzero(ok)
            if not len(m):
                continue
            here = got[1] == w
            cand = [np.concatenate([old[here], new]) for old, new in zip(
                (got[0], got[2], got[3]), (active[m], block[n], score[m, n]))]
            keep = _best(cand[0], cand[2], names[cand[1]], k)
            cand = [v[keep] for v in cand]
            got = [np.concatenate([old[~here], new]) for old, new in zip(got, (cand[0], np.full(len(keep), w), cand[1], cand[2]))]
            count = np.bincount(cand[0], minlength=len(x))
            worst = np.full(len(x), np.iinfo(np.int64).max)
            np.minimum.at(worst, cand[0], cand[2])
            full = count >= k
            need[full, w] = np.maximum(low[full, w], worst[full])
    return got, walked


def _meet(anchors: DataFrame, rows: DataFrame, centres: np.ndarray, same: bool, k: int, scratch: Scratch) -> DataFrame:
    """(anchor, slot, other, score): the k first rows of each anchor and window, same or other label.

    anchors: side, id, label, vec, cluster, low and high (arrays, one entry a window);
    rows: side, id, label, vec.  Anchors meet the rows of their side.
    """
    spark = rows.sparkSession
    held = spark.sparkContext.broadcast(centres)
    few = 2 * spark.sparkContext.defaultParallelism
    sizes = scratch.table(anchors.groupBy("side").agg(F.count("*").alias("na")).join(
        rows.groupBy("side").agg(F.count("*").alias("nr")), "side"), "sides")
    run_rows = F.least(F.lit(RUN_ROWS), F.greatest(F.lit(MIN_RUN_ROWS), F.ceil(F.col("nr") / few)))
    sizes = sizes.select("side", F.ceil(F.col("na") / GROUP_ANCHORS).alias("groups"), F.ceil(F.col("nr") / run_rows).alias("runs"))
    # whole clusters follow each other into groups of GROUP_ANCHORS
    clusters = anchors.groupBy("side", "cluster").agg(F.count("*").alias("members"))
    before = Window.partitionBy("side").orderBy("cluster").rowsBetween(Window.unboundedPreceding, -1)
    clusters = clusters.withColumn("before", F.coalesce(F.sum("members").over(before), F.lit(0)))
    left = (anchors.join(clusters, ["side", "cluster"]).join(sizes, "side")
            .withColumn("grp", F.floor((F.col("before") + F.expr("pmod(xxhash64(id), members)")) / GROUP_ANCHORS))
            .withColumn("run", F.explode(F.expr("sequence(0L, runs - 1)")))
            .select("side", "grp", "run", "id", "label", "vec", "cluster", "low", "high"))
    right = (rows.join(sizes, "side").withColumn("run", F.expr("pmod(xxhash64(id, 1), runs)"))
             .withColumn("grp", F.explode(F.expr("sequence(0L, groups - 1)"))).select("side", "grp", "run", "id", "label", "vec"))

    def cell(a: pa.Table, b: pa.Table) -> pa.Table:
        out = [[], [], [], []]
        if a.num_rows and b.num_rows:
            centre = held.value
            x = _matrix(a.column("vec"), centre.shape[1])
            c = _matrix(b.column("vec"), x.shape[1])
            x = np.pad(x, ((0, 0), (0, c.shape[1] - x.shape[1])))
            middle = np.pad(centre, ((0, 0), (0, c.shape[1] - centre.shape[1])))
            x_id, c_id = a.column("id").to_numpy(), b.column("id").to_numpy()
            x_label, c_label = a.column("label").to_numpy(), b.column("label").to_numpy()
            of, low, high = a.column("cluster").to_numpy(), _matrix(a.column("low")), _matrix(a.column("high"))
            # windows that an anchor lacks are empty
            lacking = np.arange(low.shape[1]) >= a.column("low").combine_chunks().value_lengths().to_numpy()[:, None]
            low[lacking], high[lacking] = 1, 0
            for number in np.unique(of):
                whole = np.flatnonzero(of == number)
                for members in (whole[i:i + BLOCK] for i in range(0, len(whole), BLOCK)):
                    def may(i, j, members=members):
                        alike = x_label[members[i]][:, None] == c_label[j][None, :]
                        return alike & (x_id[members[i]][:, None] != c_id[j][None, :]) if same else ~alike
                    got, _ = walk(x[members], may, low[members], high[members], middle[number], c, c_id, k)
                    for kept, new in zip(out, (x_id[members[got[0]]], got[1], c_id[got[2]], got[3])):
                        kept.append(new)
        kinds = (np.int64, np.int32, np.int64, np.int64)
        return pa.Table.from_arrays([pa.array(np.concatenate([np.empty(0, t), *v]).astype(t)) for v, t in zip(out, kinds)],
                                    names=["anchor", "slot", "other", "score"])

    keys = ["side", "grp", "run"]
    found = scratch.table(left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(cell, _FOUND), "found")
    order = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "other")
    return scratch.table(found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k), "best")


def _centres(anchors: DataFrame) -> np.ndarray:
    """Unit cluster centres, about the square root of the sampled anchors in number."""
    n = max(1, anchors.count())
    sample = anchors.where(F.expr(f"pmod(xxhash64(id, 2), {n}) < {SAMPLE_ANCHORS}")).select("id", "vec").toArrow()
    x = _matrix(sample.column("vec"))[np.argsort(sample.column("id").to_numpy())].astype(float) if sample.num_rows else np.zeros((0, 1))
    size = np.linalg.norm(x, axis=1, keepdims=True)
    x = (x / np.where(size > 0, size, 1))[size[:, 0] > 0]
    return cluster(x, min(MAX_CLUSTERS, int(np.sqrt(len(x))) + 1)) if len(x) else np.zeros((1, 1))


def mine(vectors: DataFrame, scratch: Scratch, is_anchor: Column, n_positives: int = 5, n_negatives: int = 3,
         low: tuple[int, int] = (50, 100), high: tuple[int, int] = (95, 100)) -> DataFrame:
    """Per anchor, positive and rank: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``vectors``: id (long), label (long), vec (array<int>, see ``scaled``); anchors
    are the rows for which ``is_anchor`` holds.  Scores are integer inner products;
    higher ones come first, ties by smaller id.  A negative's score lies between
    ``low`` and ``high`` (numerator, denominator; at most 1) times the positive's.

    Rows with a null id, label or vec take no part.  Of rows that share an id the
    one with the smallest (label, vec) does, once.  Shorter vectors count as filled with
    zeros.  Anchors without a positive, and positives without a negative, have
    no rows; so has an empty table.  Other columns are ignored.
    """
    rows = (vectors.where("id IS NOT NULL AND label IS NOT NULL AND vec IS NOT NULL")
            .groupBy("id").agg(F.min(F.struct("label", "vec")).alias("v")).select("id", F.col("v.label").cast("long").alias("label"), "v.vec"))
    rows = scratch.table(rows.withColumn("anchor", is_anchor), "rows")
    anchors = rows.where("anchor").drop("anchor")
    rows = rows.drop("anchor")
    centres = _centres(anchors)
    held = rows.sparkSession.sparkContext.broadcast(centres)  # MAX_CLUSTERS rows at most

    @F.pandas_udf("int")
    def nearest(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        c = held.value
        for vec in batches:
            x = _matrix(pa.array(vec, pa.list_(pa.int32())))
            both = min(x.shape[1], c.shape[1])
            yield pd.Series((x[:, :both] @ c[:, :both].T).argmax(axis=1).astype("int32"))

    anchors = scratch.table(anchors.withColumn("cluster", nearest("vec")), "anchors")
    every = [F.array(F.lit(-2 ** 62).cast("long")).alias("low"), F.array(F.lit(2 ** 62).cast("long")).alias("high")]
    positives = _meet(anchors.select(F.col("label").alias("side"), "*", *every), rows.select(F.col("label").alias("side"), "*"),
                      centres, True, n_positives, scratch)

    @F.pandas_udf("low array<long>, high array<long>")
    def windows(scores: pd.Series) -> pd.DataFrame:
        s = [np.asarray(v, np.int64) for v in scores]
        return pd.DataFrame({"low": [_part(v, *low, True) for v in s], "high": [_part(v, *high, False) for v in s]})

    # n_positives scores an anchor, in rank order
    scores = positives.groupBy("anchor").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "score"))), lambda p: p["score"]).alias("scores"))
    side = F.lit(0).cast("long").alias("side")
    sought = (anchors.join(scores, F.col("id") == F.col("anchor")).withColumn("w", windows("scores"))
              .select(side, "id", "label", "vec", "cluster", "w.low", "w.high"))
    negatives = _meet(scratch.table(sought, "sought"), rows.select(side, "*"), centres, False, n_negatives, scratch)
    p = positives.select(F.col("anchor").alias("anchor_id"), F.col("other").alias("positive_id"), F.col("score").alias("positive_score"), (F.col("rank") - 1).alias("s"))
    n = negatives.select("anchor", "slot", "rank", F.col("other").alias("negative_id"), F.col("score").alias("negative_score"))
    return (p.join(n, (F.col("anchor_id") == F.col("anchor")) & (F.col("s") == F.col("slot")))
            .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))
