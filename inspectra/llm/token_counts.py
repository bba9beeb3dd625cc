"""Token counts: exact length histogram and its suffix sums.

Every document is encoded once; all that is kept of it is its length.  The
histogram (length -> documents) is combined before its shuffle, and suffix sums
over it answer totals, quantiles and truncated totals for every context limit:
with D(L) documents and T(L) tokens in documents longer than L, a corpus cut at
L has ``total - T(L) + L * D(L)`` tokens.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import token_counter

#: Lengths per block of the two-level running sum: no task holds more than this many histogram rows.
BLOCK = 1024


def length_histogram(docs: DataFrame, text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """(n_tokens, n_docs): documents by encoded length.

    Whole texts are encoded, however long; a null or empty text has length 0.
    Repeated rows count as often as they occur.  Other columns are not read, whatever their names.  An empty table gives an empty histogram.
    """
    lengths = docs.select(token_counter(vocabulary)(F.col(text)).alias("n_tokens"))
    return lengths.groupBy("n_tokens").agg(F.count("*").alias("n_docs"))


def suffix_sums(hist: DataFrame) -> DataFrame:
    """One row per length L that occurs, with everything a context limit of L answers.

    docs_over, tokens_over: documents longer than L and their tokens;
    truncated_total: tokens left when every document is cut at L;
    quantile: share of documents of length L or less.

    The running sum has two levels: blocks of ``BLOCK`` lengths, then lengths
    inside a block, so that no window sees the whole histogram.
    """
    h = hist.withColumn("block", F.expr(f"n_tokens DIV {BLOCK}"))
    blocks = h.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum(F.col("n_docs") * F.col("n_tokens")).alias("t"))
    above = Window.orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = blocks.select("block", *(F.coalesce(F.sum(c).over(above), F.lit(0)).alias(f"{c}_above") for c in "dt"),
                            F.sum("d").over(whole).alias("total_docs"), F.sum("t").over(whole).alias("total_tokens"))
    inside = Window.partitionBy("block").orderBy(F.col("n_tokens").desc()).rowsBetween(Window.unboundedPreceding, -1)
    over = lambda c, base: F.coalesce(F.sum(c).over(inside), F.lit(0)) + F.col(base)
    out = (h.join(offsets, "block")
           .withColumn("tokens", F.col("n_docs") * F.col("n_tokens"))
           .withColumn("docs_over", over("n_docs", "d_above"))
           .withColumn("tokens_over", over("tokens", "t_above")))
    return out.select(
        "n_tokens", "n_docs", "docs_over", "tokens_over", "total_docs", "total_tokens",
        (F.col("total_tokens") - F.col("tokens_over") + F.col("n_tokens") * F.col("docs_over")).alias("truncated_total"),
        ((F.col("total_docs") - F.col("docs_over")) / F.col("total_docs")).alias("quantile"))


def truncated_totals(hist: DataFrame, limits: list[int]) -> DataFrame:
    """(context_limit, docs_over, truncated_total) for any limits, also lengths that never occur."""
    n, d = F.col("n_tokens"), F.col("n_docs")
    cut = hist.select(F.explode(F.array(*(F.lit(int(x)).cast("long") for x in limits))).alias("context_limit"), n, d)
    return cut.groupBy("context_limit").agg(
        F.sum(F.when(n > F.col("context_limit"), d).otherwise(0)).alias("docs_over"),
        F.sum(F.least(n, F.col("context_limit")) * d).alias("truncated_total"))


def quantiles(sums: DataFrame, shares: list[float]) -> DataFrame:
    """(share, n_tokens): smallest length that at least this share of the documents does not exceed."""
    s = sums.select("n_tokens", "docs_over", "total_docs",
                    F.explode(F.array(*(F.lit(float(x)) for x in shares))).alias("share"))
    reached = F.col("total_docs") - F.col("docs_over") >= F.col("share") * F.col("total_docs")
    return s.where(reached).groupBy("share").agg(F.min("n_tokens").alias("n_tokens"))
