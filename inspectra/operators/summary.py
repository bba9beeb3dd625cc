"""Summaries behind the published figures and dashboard: A5-A23, O1-O8, W5, P21, P22, J11.

Every summary is a partial-aggregating ``groupBy`` (a hot group is combined
map-side), a one-row aggregate attached as a scalar subquery, or a small
per-group table joined back.  The global orderings (W5 rank, running sums)
are bucketed along sampled boundaries, and the exact-n sample (O8) filters
by hash prefix before its top-n, so no data table is sorted in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions import expr as E
from ..session import written


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """A5: counts per non-NULL value, descending (ties by value)."""
    return (df.filter(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("n"))
              .orderBy(F.col("n").desc(), F.col(col).asc()))


def rate_by(df: DataFrame, keys, target: str = "failed", min_n: int | None = None) -> DataFrame:
    """A6 (+A9 when ``min_n``): size and mean target per group."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    out = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(target).alias("failure_rate"))
    return out.filter(F.col("n") >= min_n) if min_n else out


def top_rates(df: DataFrame, key: str, min_n: int, k: int, target: str = "failed") -> DataFrame:
    """A9 + O3: groups with at least ``min_n`` rows, top-k by rate (ties by key)."""
    return (rate_by(df, key, target, min_n)
            .orderBy(F.col("failure_rate").desc(), F.col(key).asc()).limit(k))


def region_summary(df: DataFrame, key: str = "boro") -> DataFrame:
    """N, failure rate and exact median income per region."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.avg("failed").alias("failure_rate"),
                               F.percentile("median_household_income", 0.5).alias("median_income"))


def quantile(col, p, approx: bool = False, accuracy: int = 10000) -> F.Column:
    """Exact, linearly interpolated quantile (pandas / ``quantile_cont``), or with
    ``approx`` the bounded-memory sketch ``percentile_approx`` (a different
    number: it returns an observed value) for groups with very many distinct
    values."""
    return F.percentile_approx(col, p, accuracy) if approx else F.percentile(col, p)


def global_quantiles(df: DataFrame, col: str, ps=(0.25, 0.5, 0.75), approx: bool = False) -> DataFrame:
    """Quantiles in one aggregate row (exact by default)."""
    return df.agg(*[quantile(col, p, approx).alias(f"p{int(round(p * 100))}") for p in ps])


def pivot_mean(df: DataFrame, row: str, col: str, values, target: str = "failed") -> DataFrame:
    """A10: mean of ``target`` by row x column with the column values stated
    (no extra job to discover them)."""
    return df.groupBy(row).pivot(col, list(values)).agg(F.avg(target))


def crosstab_share(df: DataFrame, row: str, col: str, values) -> DataFrame:
    """Row-normalised crosstab; an absent cell is 0."""
    counts = df.groupBy(row, col).agg(F.count(F.lit(1)).alias("n"))
    tot = counts.groupBy(row).agg(F.sum("n").alias("_tot"))
    share = counts.join(tot, row).withColumn("share", F.col("n") / F.col("_tot"))
    wide = share.groupBy(row).pivot(col, list(values)).agg(F.first("share"))
    return wide.fillna(0.0)


def outcome_share(df: DataFrame, col: str = "failed") -> DataFrame:
    """Count and share of each outcome (share over the aggregated rows)."""
    c = df.groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    return c.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


def histogram_equal_width(df: DataFrame, col: str, bins: int, group: str | None = None,
                          density: bool = False) -> DataFrame:
    """Equal-width histogram over [min, max]; the maximum falls in the last bin.

    min / max are one aggregate (a scalar subquery, evaluated once); the bin
    index is a column expression, so the counting is one partial-aggregating pass.
    """
    x = F.col(col)
    base = df.filter(x.isNotNull())
    mm = base.agg(F.struct(F.min(x).alias("lo"), F.max(x).alias("hi"))).scalar()
    lo = mm["lo"]
    w = (mm["hi"] - lo) / F.lit(float(bins))
    idx = F.when(w == 0, F.lit(0)).otherwise(
        F.least(F.floor((x - lo) / w), F.lit(bins - 1))).cast("int")
    keys = ([group] if group else [])
    h = base.withColumn("bin", idx).groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("n"))
    h = h.withColumns({"bin_lo": lo + F.col("bin") * w, "bin_hi": lo + (F.col("bin") + 1) * w})
    if density:
        tot = Window.partitionBy(*keys) if keys else Window.partitionBy()
        h = h.withColumn("density", F.col("n") / (F.sum("n").over(tot) * w))
    return h


def histogram_fixed(df: DataFrame, col: str, lo: float, width: float, n_bins: int) -> DataFrame:
    """Fixed edges lo + i*width (last bin closed on the right)."""
    x = F.col(col)
    idx = F.least(F.floor((x - F.lit(lo)) / F.lit(width)), F.lit(n_bins - 1)).cast("int")
    inside = x.isNotNull() & (x >= lo) & (x <= lo + width * n_bins)
    return (df.filter(inside).withColumn("bin", idx).groupBy("bin")
              .agg(F.count(F.lit(1)).alias("n"))
              .withColumns({"bin_lo": F.lit(lo) + F.col("bin") * F.lit(width),
                            "bin_hi": F.lit(lo) + (F.col("bin") + 1) * F.lit(width)}))


def box_stats(df: DataFrame, value: str, group: str, approx: bool = False) -> DataFrame:
    """Quartiles, whiskers at 1.5 IQR (furthest values inside the fences)
    and the outlier count, per group.  Quartiles are one aggregate per group
    joined back (one row per group)."""
    v = F.col(value)
    base = df.filter(v.isNotNull())
    qs = F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))
    q = base.groupBy(group).agg((F.percentile_approx(v, qs, 10000) if approx else F.percentile(v, qs)).alias("_q"))
    q = q.select(group, F.col("_q")[0].alias("q1"), F.col("_q")[1].alias("median"),
                 F.col("_q")[2].alias("q3"))
    q = q.withColumns({"lo_fence": F.col("q1") - 1.5 * (F.col("q3") - F.col("q1")),
                       "hi_fence": F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))})
    inside = (v >= F.col("lo_fence")) & (v <= F.col("hi_fence"))
    # one row per group: the planner (AQE at run time) broadcasts it when small
    j = base.join(q, group)
    return j.groupBy(group, "q1", "median", "q3").agg(
        F.count(F.lit(1)).alias("n"),
        F.min(F.when(inside, v)).alias("whisker_lo"),
        F.max(F.when(inside, v)).alias("whisker_hi"),
        F.count_if(~inside).cast("long").alias("n_outliers"))


def box_stats_many(df: DataFrame, values, group: str, approx: bool = False) -> DataFrame:
    """A21 for several value columns in one pass each way: one quartile aggregate
    per group for all columns, one join back, one aggregate for whiskers and
    outliers; the result is unpivoted to one row per (variable, group)."""
    qs = F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))

    def pct(x):
        return F.percentile_approx(x, qs, 10000) if approx else F.percentile(x, qs)
    q = df.groupBy(group).agg(*[pct(F.col(v)).alias(f"_q_{v}") for v in values])
    j = df.join(q, group)
    aggs = []
    for v in values:
        x, qa = F.col(v), F.col(f"_q_{v}")
        lo = qa[0] - 1.5 * (qa[2] - qa[0])
        hi = qa[2] + 1.5 * (qa[2] - qa[0])
        inside = (x >= lo) & (x <= hi)
        aggs += [F.count(x).alias(f"_n_{v}"), F.min(F.when(inside, x)).alias(f"_lo_{v}"),
                 F.max(F.when(inside, x)).alias(f"_hi_{v}"),
                 F.count_if(x.isNotNull() & ~inside).cast("long").alias(f"_out_{v}")]
    a = j.groupBy(group, *[f"_q_{v}" for v in values]).agg(*aggs)
    rows = F.array(*[F.struct(F.lit(v).alias("variable"), F.col(f"_q_{v}")[0].alias("q1"),
                              F.col(f"_q_{v}")[1].alias("median"), F.col(f"_q_{v}")[2].alias("q3"),
                              F.col(f"_n_{v}").alias("n"), F.col(f"_lo_{v}").alias("whisker_lo"),
                              F.col(f"_hi_{v}").alias("whisker_hi"), F.col(f"_out_{v}").alias("n_outliers"))
                     for v in values])
    long = a.select(group, F.inline(rows))
    return long.filter(F.col("n") > 0).select("variable", group, "q1", "median", "q3", "n", "whisker_lo",
                                              "whisker_hi", "n_outliers")


def running_totals(df: DataFrame, order_cols, sums: dict) -> DataFrame:
    """Inclusive running sums along a global total order, without a
    single-partition window.

    The rows are range-partitioned on the whole order (value, then keys, so a
    hot value is split by its keys), written once, and numbered by the partition
    they fell into; per-partition totals give each partition's offset (one row a
    partition, broadcast) and a window inside the partition adds the running
    part.  The same path at every size; nothing is collected.  ``sums`` maps
    output column -> input column expression."""
    order_cols = list(order_cols)
    tagged = written(df.repartitionByRange(*order_cols).withColumn("_bucket", F.spark_partition_id()), "ranges")
    tot = tagged.groupBy("_bucket").agg(*[F.sum(e).alias(f"_t_{o}") for o, e in sums.items()])
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = tot.select("_bucket", *[F.coalesce(F.sum(f"_t_{o}").over(before), F.lit(0)).alias(f"_o_{o}")
                                      for o in sums])
    inner = Window.partitionBy("_bucket").orderBy(*order_cols).rowsBetween(Window.unboundedPreceding, 0)
    j = tagged.join(F.broadcast(offsets), "_bucket")
    j = j.withColumns({o: F.col(f"_o_{o}") + F.sum(e).over(inner) for o, e in sums.items()})
    return j.drop("_bucket", *[f"_o_{o}" for o in sums])


def global_rank(df: DataFrame, order_cols, out: str = "_rank") -> DataFrame:
    """Dense 1..n row number along a global total order (``order_cols``: value
    then keys), computed as a running count over range partitions."""
    return running_totals(df, order_cols, {out: F.lit(1).cast("long")})


def box_stats_ranked(df: DataFrame, value: str, group: str, keys) -> DataFrame:
    """A21 for a value with very many distinct values: the same columns as
    ``box_stats`` with quartiles read off the global rank, so no task keeps a map
    of a group's values.

    Rank (group, value, keys), then a quartile at position p = share * (n - 1)
    is the linear interpolation of the rows at floor(p) and ceil(p) of the group.
    """
    v = F.col(value)
    base = df.filter(v.isNotNull() & F.col(group).isNotNull()).select(group, v.alias("_v"), *keys)
    r = global_rank(base, [group, "_v", *keys], "_rank")
    sizes = base.groupBy(group).agg(F.count(F.lit(1)).alias("_n"))                     # a row per group
    first = F.coalesce(F.sum("_n").over(Window.orderBy(group).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    j = r.join(sizes.withColumn("_first", first), group).withColumn("_at", F.col("_rank") - F.col("_first") - 1)
    aggs = []
    for name, share in (("q1", 0.25), ("median", 0.5), ("q3", 0.75)):
        p = (F.col("_n") - 1) * F.lit(share)
        low, high = (F.max(F.when(F.col("_at") == f(p), F.col("_v"))) for f in (F.floor, F.ceil))
        aggs.append((low + (high - low) * F.max(p - F.floor(p))).alias(name))
    q = j.groupBy(group).agg(*aggs)
    lo, hi = (F.col("q1") - 1.5 * (F.col("q3") - F.col("q1")), F.col("q3") + 1.5 * (F.col("q3") - F.col("q1")))
    inside = (F.col("_v") >= lo) & (F.col("_v") <= hi)
    return base.join(q, group).groupBy(group, "q1", "median", "q3").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.when(inside, F.col("_v"))).alias("whisker_lo"),
        F.max(F.when(inside, F.col("_v"))).alias("whisker_hi"), F.count_if(~inside).cast("long").alias("n_outliers"))


def rank_quartiles(df: DataFrame, value: str, keys, out: str, labels) -> DataFrame:
    """``qcut(rank(method='first'), 4)`` — rank with ties broken by the
    key order, quartile = max(1, ceil(4 (r-1) / (n-1))).

    Only (value, keys) are ranked; the last key tuple of each of the first three
    quartiles is one row, and every row is labelled by comparing its own tuple
    with them, so nothing is joined back."""
    base = df.filter(F.col(value).isNotNull())
    key = F.struct(value, *keys)
    r = global_rank(base.select(value, *keys), [value, *keys], "_rank")
    n = r.agg(F.count(F.lit(1))).scalar()
    q = F.when(n <= 1, F.lit(1)).otherwise(
        F.greatest(F.lit(1), F.ceil(F.lit(4.0) * (F.col("_rank") - 1) / F.greatest(n - 1, F.lit(1))))).cast("int")
    last = r.agg(F.struct(*[F.max(F.when(q <= k, key)).alias(f"q{k}") for k in (1, 2, 3)])).scalar()
    lab = F.lit(labels[3])
    for k in (3, 2, 1):
        lab = F.when(key <= last[f"q{k}"], F.lit(labels[k - 1])).otherwise(lab)
    return base.withColumn(out, lab)


def seeded_sample(df: DataFrame, keys, n: int, seed: int = S.SEED) -> DataFrame:
    """Exact-n repeatable sample: the n rows with the smallest md5(key | seed),
    ties by key (n capped at the table size).

    A plain ``orderBy.limit`` would merge every partition's local top-n in one
    task (partitions x n rows).  Instead a histogram of the hash's first four
    digits (65,536 rows at most) gives the prefix below which at least n rows
    lie, as a scalar subquery; the rows up to it are an initial segment of the
    order and hold the exact top n.
    """
    h = F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in keys], F.lit(str(seed))))
    t = df.withColumn("_h", h)
    prefix = F.substring("_h", 1, 4)
    counts = t.groupBy(prefix.alias("p")).agg(F.count(F.lit(1)).alias("c"))
    upto = F.sum("c").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, 0))
    enough = counts.select("p", upto.alias("u")).filter(F.col("u") >= n).agg(F.min("p")).scalar()
    return t.filter(prefix <= F.coalesce(enough, F.lit("ffff"))).orderBy("_h", *keys).limit(n).drop("_h")


def tiles(df: DataFrame) -> DataFrame:
    """A14 + A22: entities, inspections, failure rate, mean score and rated share in one aggregate."""
    return df.agg(F.countDistinct("camis").alias("n_entities"), F.count(F.lit(1)).alias("n_inspections"),
                  F.avg("failed").alias("failure_rate"), F.avg("score").alias("mean_score"),
                  F.avg("has_yelp").alias("rated_share"))


def monthly_trend(df: DataFrame) -> DataFrame:
    """A15 + F4: inspections per year-month and region."""
    return (df.groupBy(F.date_format("inspection_date", "yyyy-MM").alias("year_month"), "boro")
              .agg(F.count("failed").alias("n")))


def display_labels(df: DataFrame) -> DataFrame:
    """Passed/Failed, 'No grade', month and weekday names."""
    return df.withColumns({
        "failed_label": F.when(F.col("failed") == 1, "Failed").otherwise("Passed"),
        "grade_label": F.coalesce(F.col("grade"), F.lit("No grade")),
        "month_name": F.element_at(F.array(*[F.lit(m) for m in S.MONTH_NAMES]), F.col("inspection_month")),
        "dow_name": F.element_at(F.array(*[F.lit(m) for m in S.WEEKDAY_NAMES]), F.col("inspection_dow") + 1),
    })


def fixed_bins(df: DataFrame) -> DataFrame:
    """Right-closed violation / critical / temperature buckets."""
    return df.withColumns({
        "violation_bucket": E.right_closed_bins("violation_count", S.VIOLATION_BINS),
        "critical_bucket": E.right_closed_bins("critical_count", S.CRITICAL_BINS),
        "temp_bin": E.right_closed_bins("temp_mean", S.TEMP_BINS),
    })


def complete_categories(agg: DataFrame, key: str, categories, fill: dict | None = None) -> DataFrame:
    """Show every category of a fixed list, absent ones with NULL (or ``fill``)."""
    spark = agg.sparkSession
    dim = spark.createDataFrame([(c, i) for i, c in enumerate(categories)], f"{key} string, _ord int")
    out = dim.join(agg, key, "left").orderBy("_ord")
    if fill:
        out = out.fillna(fill)
    return out.drop("_ord")
