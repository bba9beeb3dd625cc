"""Packing: length buckets that minimise padding, token-budget batches inside them.

Documents are cut into pieces of at most ``max_len`` tokens (nothing is
dropped), so the global length histogram has at most ``max_len`` rows.  Dynamic
programming over that histogram places ``n_buckets`` boundaries with the least
total padding.  Inside a bucket of boundary L a batch holds
``max(1, token_budget // L)`` rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, token_counter

MAX_LEN = 8192
N_BUCKETS = 16
TOKEN_BUDGET = 65536
#: Rows that one task orders; a bucket with more is dealt over several shards.
SHARD_ROWS = 4096


def optimal_boundaries(lengths: np.ndarray, counts: np.ndarray, n_buckets: int) -> tuple[list[int], int]:
    """Boundaries (ascending, the last one the longest length) with the least total padding, and that padding.

    Exact dynamic programme: best[k][j] = min over i < j of best[k-1][i] plus
    the padding of lengths i..j-1 raised to lengths[j-1].  That padding obeys
    the quadrangle inequality, so the best i grows with j, and each layer is
    solved level by level (divide and conquer) instead of trying all pairs.
    Ties take the smallest i.
    """
    order = np.argsort(lengths)
    x, c = np.asarray(lengths, np.int64)[order], np.asarray(counts, np.int64)[order]
    h = len(x)
    if not h:
        return [], 0
    n, t = np.concatenate([[0], np.cumsum(c)]), np.concatenate([[0], np.cumsum(c * x)])
    cost = lambda i, j: x[j - 1] * (n[j] - n[i]) - (t[j] - t[i])
    best = cost(np.zeros(h, np.int64), np.arange(1, h + 1))
    best = np.concatenate([[0], best])
    choice = []
    for k in range(2, min(n_buckets, h) + 1):
        new, pick = np.full(h + 1, np.iinfo(np.int64).max), np.zeros(h + 1, np.int64)
        spans = [(k, h, k - 1, h - 1)]  # j range, i range
        while spans:
            lo, hi, i0, i1 = spans.pop()
            if lo > hi:
                continue
            j = (lo + hi) // 2
            i = np.arange(i0, min(i1, j - 1) + 1)
            total = best[i] + cost(i, j)
            at = int(np.argmin(total))
            new[j], pick[j] = total[at], i[at]
            spans += [(lo, j - 1, i0, int(i[at])), (j + 1, hi, int(i[at]), i1)]
        best = new
        choice.append(pick)
    bounds, j = [], h
    for pick in reversed(choice):
        bounds.append(int(x[j - 1]))
        j = int(pick[j])
    bounds.append(int(x[j - 1]))
    return bounds[::-1], int(best[h])


def pack(docs: DataFrame, scratch: Scratch, max_len: int = MAX_LEN, n_buckets: int = N_BUCKETS,
         token_budget: int = TOKEN_BUDGET, vocabulary: str | None = None, seed: int = 42) -> DataFrame:
    """One row per piece: doc_id, piece, start_token, n_tokens, bucket_len, batch, slot, padding.

    ``batch`` counts from 0 inside its bucket and ``slot`` inside its batch; only
    the last batch of a bucket may be partly filled.  The order inside a bucket
    is a seeded hash, so neighbours in a batch are unrelated documents.

    Texts may be of any length.  A document without tokens (null or empty text) is one row with n_tokens 0
    and no bucket, batch or slot.  Repeated rows are packed as often as they
    occur.  Only doc_id and text are read; an empty table gives no rows.
    """
    lengths = scratch.table(docs.select("doc_id", token_counter(vocabulary)("text").alias("total")), "lengths")
    pieces = (lengths
              .select("doc_id", "total", F.explode(F.expr(f"sequence(0L, greatest(0L, (total - 1) DIV {max_len}))")).alias("piece"))
              .select("doc_id", "piece", (F.col("piece") * max_len).alias("start_token"),
                      F.least(F.lit(max_len).cast("long"), F.col("total") - F.col("piece") * max_len).alias("n_tokens")))
    # at most max_len rows, by construction of the pieces
    hist = pieces.where("n_tokens > 0").groupBy("n_tokens").agg(F.count("*").alias("n")).toPandas()
    bounds, _ = optimal_boundaries(hist["n_tokens"].to_numpy(), hist["n"].to_numpy(), n_buckets)
    bucket = F.lit(None).cast("long")
    shards = F.lit(1)
    for b, low in reversed(list(zip(bounds, [0, *bounds]))):
        held = int(hist["n"][(hist["n_tokens"] > low) & (hist["n_tokens"] <= b)].sum())
        bucket = F.when(F.col("n_tokens") <= b, F.lit(b).cast("long")).otherwise(bucket)
        shards = F.when(F.col("n_tokens") <= b, F.lit(-(-held // SHARD_ROWS))).otherwise(shards)
    filled = (pieces.where("n_tokens > 0").withColumn("bucket_len", bucket)
              .withColumn("h", F.xxhash64("doc_id", "piece", F.lit(seed)))
              .withColumn("shard", F.pmod(F.shiftright("h", 20), shards.cast("long"))))
    sizes = filled.groupBy("bucket_len", "shard").agg(F.count("*").alias("n"))
    before = Window.partitionBy("bucket_len").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("bucket_len", "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("bucket_len", "shard").orderBy("h", "doc_id", "piece")
    placed = (filled.withColumn("rn", F.row_number().over(inside)).join(offsets, ["bucket_len", "shard"])
              .withColumn("at", F.col("offset") + F.col("rn") - 1)
              .withColumn("rows", F.greatest(F.lit(1).cast("long"), F.expr(f"{token_budget} DIV bucket_len"))))
    out = placed.select("doc_id", "piece", "start_token", "n_tokens", "bucket_len",
                        F.expr("at DIV rows").alias("batch"), (F.col("at") % F.col("rows")).alias("slot"),
                        (F.col("bucket_len") - F.col("n_tokens")).alias("padding"))
    nothing = F.lit(None).cast("long")
    return out.unionByName(pieces.where("n_tokens <= 0").select(
        "doc_id", "piece", "start_token", "n_tokens", nothing.alias("bucket_len"), nothing.alias("batch"),
        nothing.alias("slot"), nothing.alias("padding")))
