"""Cleaning: P2, P3, P8-P14, A4, F9-F11, F16, J7, audits A12/A13.

Row removal (P2, P3) runs after the lag features were computed on the full
panel, as in the published pipeline.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions import expr as E


def filter_valid_region(df: DataFrame, regions, col: str = "boro") -> DataFrame:
    """Keep rows whose region is in the list (NULL dropped too)."""
    return df.filter(F.col(col).isin(list(regions)))


def no_result_predicate() -> F.Column:
    """No score, no grade and no violation."""
    return (F.col("score").isNull() & F.col("grade").isNull()
            & (F.coalesce(F.col("violation_count"), F.lit(0)) == 0))


def filter_no_result(df: DataFrame) -> DataFrame:
    return df.filter(~no_result_predicate())


def presence_flags(df: DataFrame) -> DataFrame:
    """grade_available, has_location, has_yelp."""
    return df.withColumns({"grade_available": E.present("grade"),
                           "has_location": E.present("latitude"),
                           "has_yelp": E.present("yelp_rating")})


def sentinel_nulls(df: DataFrame) -> DataFrame:
    """P10: price 0 means 'no price'."""
    return df.withColumn("yelp_price", F.nullif(F.col("yelp_price"), F.lit(0.0)))


def group_median_fill(df: DataFrame, key: str, cols, groups=None, approx: bool = False) -> DataFrame:
    """A4: fill NULLs with the exact median of the column within its group.

    One partial-aggregating pass computes every group's medians; the result
    has one row per group.  The exact median keeps a value -> count map per
    group; ``approx`` switches to the bounded-memory sketch for columns with
    very many distinct values (a different number, documented as such).
    With ``groups``, a stated list of keys (e.g. the valid regions; other keys
    are not filled), the medians are one row a key and broadcast; otherwise the
    planner chooses the join.
    """
    def median(c):
        return F.percentile_approx(c, 0.5, 10000) if approx else F.percentile(c, 0.5)
    med = df.groupBy(key).agg(*[median(c).alias(f"_med_{c}") for c in cols])
    if groups is not None:
        med = F.broadcast(med.filter(F.col(key).isin(list(groups))))
    j = df.join(med, key, "left")
    return j.select(*[F.coalesce(F.col(c), F.col(f"_med_{c}")).alias(c) if c in cols else F.col(c)
                      for c in df.columns])


def history_flags(df: DataFrame) -> DataFrame:
    """P9 + P8 (has_history, H2 kept) + P12 constant fills."""
    return df.withColumns({
        "is_first_inspection": (F.col("inspection_count") == 1).cast("int"),
        "has_history": E.present("prev_score"),
    }).withColumns({
        "prev_score": F.coalesce(F.col("prev_score"), F.lit(-1.0)),
        "score_trend": F.coalesce(F.col("score_trend"), F.lit(0.0)),
        "prev_failed": F.coalesce(F.col("prev_failed"), F.lit(-1)),
    })


def top_k_values(df: DataFrame, col: str, k: int) -> DataFrame:
    """O2: the k most frequent non-NULL values (ties by value ascending).

    The count is a partial-aggregating hash aggregate; ``orderBy.limit`` plans
    as TakeOrderedAndProject, so only k rows per partition move.
    """
    return (df.filter(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("n"))
              .orderBy(F.col("n").desc(), F.col(col).asc()).limit(k))


def top_k_of(df: DataFrame, col: str, form, k: int) -> DataFrame:
    """``top_k_values`` of ``form`` (a function that gives NULL for NULL only) of a column: the rows are
    counted by the column as it is, so the form is taken of its distinct values and not of every row."""
    counts = df.filter(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    return (counts.select(form(col).alias(col), "n").groupBy(col).agg(F.sum("n").alias("n"))
                  .orderBy(F.col("n").desc(), F.col(col).asc()).limit(k))


def group_top_k_other(df: DataFrame, col: str, out: str, k: int, other: str = "Other", top: DataFrame | None = None) -> DataFrame:
    """F16 + J7: keep a top-k value, else 'Other' (NULL -> 'Other').

    Membership is a left join against the k-row table (broadcast: its size is
    k by construction); nothing is collected to the driver.  ``top``: that table
    (column ``col``), if the caller has a cheaper way to it.
    """
    top = (top_k_values(df, col, k) if top is None else top).select(F.col(col).alias("_top"))
    j = df.join(F.broadcast(top), F.col(col) == F.col("_top"), "left")
    return j.withColumn(out, F.when(F.col("_top").isNotNull(), F.col(col)).otherwise(F.lit(other))) \
            .drop("_top")


def clean_panel(panel: DataFrame, regions, top_k: int = S.TOP_CUISINES) -> DataFrame:
    """Stage 2: the 52-column clean table."""
    df = panel.withColumn("zipcode", E.zip_normalize("zipcode"))          # F10
    df = filter_valid_region(df, regions)                                 # P2
    df = filter_no_result(df)                                             # P3
    df = presence_flags(df)                                               # P8
    df = sentinel_nulls(df)                                               # P10
    df = group_median_fill(df, "boro", S.CENSUS_COLUMNS, groups=regions)  # A4
    df = history_flags(df)                                                # P9, P12
    top = top_k_of(df, "cuisine", lambda c: E.title_case(F.trim(c)), top_k)
    df = df.withColumn("cuisine", E.title_case(F.trim("cuisine")))        # F9
    df = group_top_k_other(df, "cuisine", "cuisine_grouped", top_k, top=top)  # F16
    df = df.withColumns({
        "yelp_category_primary": E.primary_tag("yelp_category"),          # F11
        "white_pct": E.safe_div("white_population", "total_population"),  # P14
        "score_bucket": E.score_bucket("score"),                          # P13
    })
    return df.select(*S.CLEAN_COLUMNS)


def null_profile(df: DataFrame) -> DataFrame:
    """NULL count per column, only columns with at least one NULL.

    One aggregate pass computes every count; ``stack`` turns the single row into
    (column, n_missing) rows.
    """
    counts = df.agg(*[F.count_if(F.col(c).isNull()).cast("long").alias(c) for c in df.columns])
    pairs = ", ".join(f"'{c}', `{c}`" for c in df.columns)
    long = counts.selectExpr(f"stack({len(df.columns)}, {pairs}) AS (column_name, n_missing)")
    return long.filter(F.col("n_missing") > 0)


def cleaning_audit(panel: DataFrame, regions) -> DataFrame:
    """Rows removed per cleaning step, from one pass of conditional counts."""
    in_region = F.col("boro").isin(list(regions))
    return panel.agg(
        F.count(F.lit(1)).alias("rows_before"),
        F.count_if(~E.is_true(in_region)).cast("long").alias("removed_invalid_region"),
        F.count_if(E.is_true(in_region) & no_result_predicate()).cast("long").alias("removed_no_result"),
        F.count_if(E.is_true(in_region) & ~no_result_predicate()).cast("long").alias("rows_after"),
    )


def rated_subset(clean: DataFrame) -> DataFrame:
    """The rated subset (has_yelp = 1)."""
    return clean.filter(F.col("has_yelp") == 1)


def union_all(frames) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)
