"""Column expressions shared by the operators.

All are built-in Spark expressions (JVM side, inside whole-stage codegen);
none is a Python UDF.  Each mirrors one missing-value rule of the published
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import schemas as S


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_true(pred: Column) -> Column:
    """pandas comparison semantics: a comparison with a missing value is False."""
    return F.coalesce(pred, F.lit(False))


def flag(pred: Column) -> Column:
    """Boolean predicate -> 0/1 integer, NULL counted as 0."""
    return is_true(pred).cast("int")


def present(c) -> Column:
    """``notna().astype(int)``"""
    return col(c).isNotNull().cast("int")


def nan_to_null(c) -> Column:
    """Imported doubles may carry NaN, which Spark orders above every number."""
    c = col(c)
    return F.when(F.isnan(c), F.lit(None).cast("double")).otherwise(c)


def safe_div(a, b) -> Column:
    """Division where x/0 gives NULL (pandas gives inf, later swept to NaN)."""
    return F.try_divide(col(a), col(b))


def failed_label(grade="grade", score="score") -> Column:
    """failed = grade 'C' or score >= 28, a missing operand counts as False."""
    return (is_true(col(grade) == S.FAIL_GRADE) | is_true(col(score) >= S.FAIL_SCORE)).cast("int")


def high_rating_label(rating="yelp_rating") -> Column:
    """Rating >= 4.0 -> 1, missing rating -> 0 (on the enrichment table)."""
    return flag(col(rating) >= S.HIGH_RATING_MIN)


def score_bucket(score="score") -> Column:
    """NULL -> 'NA', <=13 'A', <=27 'B', else 'C'."""
    s = col(score)
    return (F.when(s.isNull(), "NA")
             .when(s <= S.BUCKET_A_MAX, "A")
             .when(s <= S.BUCKET_B_MAX, "B")
             .otherwise("C"))


def title_case(c) -> Column:
    """pandas ``str.title`` — upper-case the first letter after any non-letter.

    Spark's ``initcap`` only capitalises after white space, so the text is split
    at every position that follows a non-letter and each piece is capitalised.
    """
    pieces = F.split(F.lower(col(c)), r"(?<=[^\p{L}])")
    return F.array_join(F.transform(pieces, lambda w: F.concat(F.upper(F.substring(w, 1, 1)),
                                                                 F.substring(w, 2, 1 << 30))), "")


def zip_normalize(c) -> Column:
    """strip a trailing '.0', left-pad to 5 digits; missing stays NULL (H1)."""
    z = F.regexp_replace(col(c), r"\.0$", "")
    return F.when(F.length(z) < 5, F.lpad(z, 5, "0")).otherwise(z)


def primary_tag(c, default="unknown") -> Column:
    """first comma-separated tag, trimmed; missing -> 'unknown'."""
    return F.trim(F.split(F.coalesce(col(c), F.lit(default)), ",").getItem(0))


def right_closed_bins(c, bins) -> Column:
    """``pd.cut`` with right-closed edges; outside every bin -> NULL.

    ``bins`` is a list of (low, high, label) meaning low < x <= high; ``high``
    None means unbounded above.
    """
    x = col(c)
    out = None
    for lo, hi, label in bins:
        cond = x > lo if hi is None else (x > lo) & (x <= hi)
        out = F.when(cond, label) if out is None else out.when(cond, label)
    return out


def weekday_mon0(d) -> Column:
    """day of week with Monday = 0."""
    return F.weekday(col(d))


def cyclic(c, period) -> tuple[Column, Column]:
    """sin/cos encoding 2*pi*x/period."""
    angle = F.lit(2 * math.pi) * col(c) / F.lit(float(period))
    return F.sin(angle), F.cos(angle)


def season(month="inspection_month") -> Column:
    """P20: season label from month number."""
    m = col(month)
    return (F.when(m.isin(12, 1, 2), "Winter").when(m.isin(3, 4, 5), "Spring")
             .when(m.isin(6, 7, 8), "Summer").when(m.isin(9, 10, 11), "Fall")
             .otherwise("Unknown"))


def rgba(mapping: dict, key, default) -> list[Column]:
    """colour lookup as four integer columns (r, g, b, a); grey fallback."""
    k = col(key)
    out = []
    for i in range(4):
        e = None
        for value, colour in mapping.items():
            e = (F.when(k == F.lit(value), colour[i]) if e is None
                 else e.when(k == F.lit(value), colour[i]))
        out.append((e.otherwise(default[i]) if e is not None else F.lit(default[i])).cast("int"))
    return out


def round6(c) -> Column:
    return F.round(col(c), 6)
