"""Stand-in adapters: the driver's TPC-H-like tables mapped onto the domain sources.

The published pipeline reads six landing sources (inspections, restaurant
master, ratings, hourly weather, complaints, census).  The driver's tables hold
no restaurants, so each source is derived from them by the fixed rules of
FIXTURES.md section 3.  Every adapter is a lazy DataFrame over the Parquet
scans, so its work grows with the tables.

Join strategy notes (scale):
* ``nation`` (25 rows) and ``region`` (5 rows) are fixed-size dimensions of the
  schema and are broadcast; the fact-to-fact join (orders x lines) is pinned to
  sort-merge and written as inner join + unmatched rows, so AQE can split a
  skewed key on either side; every other join is left to the planner (sort-merge by
  key, or AQE's size-checked runtime broadcast).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas as S
from .tables import read


def geography(spark: SparkSession, sf_dir: str) -> DataFrame:
    """nation -> (n_name, r_name); 25 rows by the schema's definition."""
    n = read(spark, sf_dir, "nation", "n_nationkey", "n_name", "n_regionkey")
    r = read(spark, sf_dir, "region", "r_regionkey", "r_name")
    return (n.join(F.broadcast(r), n.n_regionkey == r.r_regionkey)
             .select("n_nationkey", "n_name", "r_name"))


def _zip_text(custkey) -> F.Column:
    return F.when(custkey % 50 == 0, F.lit(None).cast("string")).otherwise(
        F.concat((custkey * 37).cast("string"), F.lit(".0")))


def _boro_text(custkey, r_name) -> F.Column:
    return F.when(custkey % 97 == 0, F.lit("0")).otherwise(r_name)


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderstatus",
             "o_totalprice", "o_orderdate", "o_orderpriority")
    return o.filter(F.col("o_orderkey").isNotNull())         # same child for both branches of raw_inspections,
                                                             # so its shuffle is reused


def _with_customer(spark: SparkSession, sf_dir: str, orders: DataFrame) -> DataFrame:
    c = read(spark, sf_dir, "customer", "c_custkey", "c_name", "c_nationkey")
    geo = geography(spark, sf_dir)
    return (orders.join(c, orders.o_custkey == c.c_custkey)
                  .join(F.broadcast(geo), c.c_nationkey == geo.n_nationkey))


def _visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their customer and its geography."""
    return _with_customer(spark, sf_dir, _orders(spark, sf_dir))


def _visit_columns() -> list:
    """The inspection columns that come from the order."""
    no_score = (F.col("o_orderpriority") == "4-NOT SPECIFIED") & (F.col("o_orderstatus") == "P")
    return [
        F.col("o_custkey").cast("string").alias("camis"),
        F.col("c_name").alias("dba"),
        F.upper(_boro_text(F.col("c_custkey"), F.col("r_name"))).alias("boro"),   # P1
        _zip_text(F.col("c_custkey")).alias("zipcode"),
        F.concat(F.lit("  "), F.lower("n_name")).alias("cuisine_description"),
        F.col("o_orderdate").cast("date").alias("inspection_date"),
        F.col("o_orderstatus").alias("action"),
        F.when(no_score, F.lit(None).cast("double"))
         .otherwise(F.floor(F.col("o_totalprice") / 12500).cast("double")).alias("score"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "A")
         .when(F.col("o_orderpriority") == "2-HIGH", "B")
         .when(F.col("o_orderpriority") == "3-MEDIUM", "C").alias("grade"),
        F.col("o_orderkey").alias("ord"),
        F.col("n_name").alias("area"),
    ]


def raw_inspections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S3 stand-in: one row per violation (order line), 13 columns + ``area``.

    ``area`` (the customer's nation) is the census geography key of the stand-in.
    """
    visits = _visits(spark, sf_dir)
    li = read(spark, sf_dir, "lineitem", "l_orderkey", "l_partkey", "l_returnflag")
    # Fact-to-fact left join, written as inner join + unmatched orders.  Both
    # sides grow with the data, so it is a sort-merge join on the order key
    # (never a broadcast of the line table).  As an inner join AQE can split a
    # skewed key on either side (a left outer join only on its left side); the
    # orders without lines come from an anti join against the distinct line
    # keys, which are partially aggregated before their shuffle.
    matched = visits.join(li.hint("merge"), visits.o_orderkey == li.l_orderkey, "inner")
    line_keys = li.select(F.col("l_orderkey").alias("_lk")).distinct()
    unmatched = (visits.join(line_keys.hint("merge"), visits.o_orderkey == F.col("_lk"), "left_anti")
                       .select(*visits.columns, *[F.lit(None).cast(li.schema[c].dataType).alias(c)
                                                   for c in li.columns]))
    rows = matched.unionByName(unmatched)
    return rows.select(
        *_visit_columns(),
        F.col("l_partkey").cast("string").alias("violation_code"),
        F.lit(None).cast("string").alias("violation_description"),
        F.when(F.col("l_orderkey").isNull(), F.lit(None).cast("string"))
         .when(F.col("l_returnflag") == "R", "Critical").otherwise("Not Critical")
         .alias("critical_flag"))


def order_inspections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of ``raw_inspections`` added up per order: violation_count and critical_count.

    Lines are counted per order first (a hash aggregate of two numbers, partial
    before its shuffle), so the join and the collapse after it see one row per
    order, and a hot order key is one row.  They are joined before the customer's
    columns: where both joins are shuffled, only the narrow order rows go through this one.
    """
    lines = (read(spark, sf_dir, "lineitem", "l_orderkey", "l_partkey", "l_returnflag").groupBy("l_orderkey")
             .agg(F.count("l_partkey").alias("_n"), F.count_if(F.col("l_returnflag") == "R").cast("long").alias("_c")))
    o = _orders(spark, sf_dir)
    j = _with_customer(spark, sf_dir, o.join(lines, o.o_orderkey == lines.l_orderkey, "left"))
    return j.select(*_visit_columns(), F.coalesce("_n", F.lit(0)).alias("violation_count"),
                    F.coalesce("_c", F.lit(0)).alias("critical_count"))


def restaurants_master(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S4 stand-in before the coordinate filter: one row per customer."""
    c = read(spark, sf_dir, "customer", "c_custkey", "c_name", "c_nationkey")
    geo = geography(spark, sf_dir)
    k = F.col("c_custkey")
    located = k % 5 == 0
    return (c.join(F.broadcast(geo), c.c_nationkey == geo.n_nationkey)
             .select(k.cast("string").alias("camis"), F.col("c_name").alias("dba"),
                     F.upper(_boro_text(k, F.col("r_name"))).alias("boro"),
                     F.lit(None).cast("string").alias("building"),
                     F.lit(None).cast("string").alias("street"),
                     _zip_text(k).alias("zipcode"),
                     F.lit(None).cast("string").alias("phone"),
                     F.concat(F.lit("  "), F.lower("n_name")).alias("cuisine_description"),
                     F.when(located, F.lit(40.5) + k.cast("double") / F.lit(10000.0)).alias("latitude"),
                     F.when(located, F.lit(-74.0) + k.cast("double") / F.lit(10000.0)).alias("longitude"),
                     k.alias("ord")))


def ratings_landing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S5 landing stand-in: one JSON search response per looked-up entity.

    documents (doc_id = entity key) left join labels; an unlabelled document is
    a lookup that found no business (empty ``businesses``).
    """
    d = read(spark, sf_dir, "documents", "doc_id", "lang", "source", "n_chars")
    lb = read(spark, sf_dir, "labels", "doc_id", "quality", "toxic").withColumnRenamed("doc_id", "lb_id")
    j = d.join(lb, d.doc_id == lb.lb_id, "left")
    biz = F.struct(
        F.concat(F.lit("b"), F.col("doc_id").cast("string")).alias("id"),
        (F.lit(3.0) + F.lit(1.5) * F.col("quality") - F.lit(0.5) * F.col("toxic")).alias("rating"),
        F.col("n_chars").alias("review_count"),
        F.repeat(F.lit("$"), (F.col("doc_id") % 4).cast("int")).alias("price"),
        F.array(F.struct(F.col("source").alias("alias")),
                F.struct(F.col("lang").alias("alias"))).alias("categories"),
    )
    businesses = F.when(F.col("lb_id").isNull(), F.array().cast(S.RATINGS_JSON["businesses"].dataType)) \
                  .otherwise(F.array(biz))
    return j.select(F.col("doc_id").cast("string").alias("camis"),
                    F.to_json(F.struct(businesses.alias("businesses"))).alias("json"))


def weather_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S6 stand-in: one reading per order line, keyed by its ship timestamp."""
    li = read(spark, sf_dir, "lineitem", "l_shipdate", "l_quantity", "l_tax", "l_linestatus",
              "l_discount", "l_extendedprice", "l_linenumber")
    precip = F.col("l_tax") * 100
    return li.select(
        F.col("l_shipdate").cast("timestamp_ntz").alias("timestamp_local"),
        (F.col("l_quantity") - 15).alias("temperature_2m"),
        precip.alias("precipitation"),
        F.when(F.col("l_linestatus") == "O", precip).alias("rain"),
        F.lit(None).cast("double").alias("snowfall"),
        (F.col("l_discount") * 100).alias("wind_speed_10m"),
        (F.col("l_extendedprice") / 5000).alias("wind_gusts_10m"),
        (F.col("l_linenumber") * 10).cast("double").alias("cloud_cover"),
    )


def weather_landing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S6 landing stand-in: columnar JSON ``{"hourly": {"time": [..], m: [..]}}``.

    One document per order and block of eight line numbers, so no document
    grows with the data, however many lines an order has.
    """
    li = read(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_shipdate", "l_quantity",
              "l_tax", "l_linestatus", "l_discount", "l_extendedprice")
    h = weather_hourly_from(li)
    docs = h.groupBy("l_orderkey", F.expr("l_linenumber DIV 8").alias("block")).agg(F.sort_array(F.collect_list(F.struct(
        "l_linenumber", "time", *S.WEATHER_MEASURES))).alias("r"))
    hourly = F.struct(F.col("r.time").alias("time"),
                      *[F.col(f"r.{m}").alias(m) for m in S.WEATHER_MEASURES])
    return docs.select(F.concat_ws("-", "l_orderkey", "block").alias("doc_id"),
                       F.to_json(F.struct(hourly.alias("hourly"))).alias("json"))


def weather_hourly_from(li: DataFrame) -> DataFrame:
    precip = F.col("l_tax") * 100
    return li.select(
        "l_orderkey", "l_linenumber",
        F.date_format(F.col("l_shipdate"), "yyyy-MM-dd'T'HH:mm").alias("time"),
        (F.col("l_quantity") - 15).alias("temperature_2m"),
        precip.alias("precipitation"),
        F.when(F.col("l_linestatus") == "O", precip).alias("rain"),
        F.lit(None).cast("double").alias("snowfall"),
        (F.col("l_discount") * 100).alias("wind_speed_10m"),
        (F.col("l_extendedprice") / 5000).alias("wind_gusts_10m"),
        (F.col("l_linenumber") * 10).cast("double").alias("cloud_cover"),
    )


def complaints_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S7 stand-in: one complaint per order line, borough = supplier's region."""
    li = read(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_suppkey",
              "l_returnflag", "l_shipdate")
    s = read(spark, sf_dir, "supplier", "s_suppkey", "s_nationkey")
    geo = geography(spark, sf_dir)
    # suppliers first: the planner knows their size, but not that of their join with the nations,
    # for which it would shuffle the lines
    j = li.join(s, li.l_suppkey == s.s_suppkey).join(F.broadcast(geo), s.s_nationkey == geo.n_nationkey)
    return j.select(
        F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))
         .alias("unique_key"),
        F.col("l_shipdate").cast("timestamp_ntz").alias("created_date"),
        F.when(F.col("l_returnflag") == "A", "Rodents")
         .when(F.col("l_returnflag") == "N", "Food Safety")
         .otherwise("Food Poisoning").alias("complaint_type"),
        F.col("r_name").alias("borough"),
        F.lit(None).cast("string").alias("incident_zip"),
    )


def census_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S8 stand-in: one row per nation (the census geography), sentinel included.

    income = exact median supplier balance (sentinel when n_nationkey % 6 = 0),
    population = customers, white population = customers in two segments.
    """
    geo = geography(spark, sf_dir)
    s = read(spark, sf_dir, "supplier", "s_nationkey", "s_acctbal")
    c = read(spark, sf_dir, "customer", "c_nationkey", "c_mktsegment")
    inc = s.groupBy("s_nationkey").agg(F.percentile("s_acctbal", 0.5).alias("inc"))
    pop = c.groupBy("c_nationkey").agg(
        F.count(F.lit(1)).cast("double").alias("total_population"),
        F.count_if(F.col("c_mktsegment").isin("BUILDING", "MACHINERY")).cast("double")
         .alias("white_population"))
    j = (geo.join(inc, geo.n_nationkey == inc.s_nationkey, "left")
            .join(pop, geo.n_nationkey == pop.c_nationkey, "left"))
    return j.select(
        F.col("n_name").alias("area"),
        F.col("r_name").alias("boro"),
        F.when(F.col("n_nationkey") % 6 == 0, F.lit(float(S.CENSUS_SENTINEL)))
         .otherwise(F.col("inc")).alias("median_household_income"),
        "total_population", "white_population",
        F.lpad(F.col("n_nationkey").cast("string"), 3, "0").alias("county"),
        F.col("n_name").alias("NAME"),
    )


def census_landing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S8 landing stand-in: one JSON matrix (header row + rows) per region.

    A region holds a fixed number of nations, so a matrix never grows with the
    data.
    """
    raw = census_raw(spark, sf_dir)
    header = F.array(*[F.lit(x) for x in ["B19013_001E", "B01003_001E", "B02001_002E", "NAME",
                                          "state", "county"]])
    row = F.array(F.col("median_household_income").cast("string"),
                  F.col("total_population").cast("string"),
                  F.col("white_population").cast("string"),
                  F.col("NAME"), F.lit("36"), F.col("county"))
    per_region = raw.groupBy("boro").agg(F.sort_array(F.collect_list(
        F.struct(F.col("county"), row.alias("row")))).alias("rows"))
    return per_region.select(
        F.col("boro").alias("doc_id"),
        F.to_json(F.concat(F.array(header), F.transform("rows", lambda r: r["row"]))).alias("json"))


def census_area_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Census geography code -> region (the stand-in's county -> borough map)."""
    geo = geography(spark, sf_dir)
    return geo.select(F.lpad(F.col("n_nationkey").cast("string"), 3, "0").alias("county"),
                      F.col("r_name").alias("boro"), F.col("n_name").alias("area"))
