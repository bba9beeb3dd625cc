"""S14 as a Structured Streaming job: incremental enrichment of the ratings cache.

New lookup responses land as JSON files in a folder.  Each micro-batch parses
them (S5), keeps only entities not yet in the cache (J6, left anti join on the
string key), recomputes the label on the merged rows (U1 + P7) and appends
them to the cache table.  The checkpoint location (under the shared
``spark.checkpoint.dir``) makes the job restartable after a failure: files
already committed are not read again.  A batch that is replayed after its
write committed finds its keys in the cache already (the anti join), so the
append is idempotent and no entity is written twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.panel import dedupe_first
from ..session import ensure_checkpoint_dir
from ..sources.landing import flatten_business_json

LANDING_SCHEMA = T.StructType([T.StructField("camis", T.StringType()), T.StructField("json", T.StringType())])
CACHE_COLUMNS = ["camis", "yelp_id", "yelp_rating", "yelp_reviews", "yelp_price", "yelp_category", "high_rating"]


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def _append_new(batch: DataFrame, cache_path: str) -> None:
    """Append the entities of a batch that the cache lacks; of several responses
    of one entity the smallest (rating id, then all other fields) is taken."""
    spark = batch.sparkSession
    parsed = flatten_business_json(batch)
    order = F.struct(*[F.col(c) for c in CACHE_COLUMNS[1:]])
    fresh = dedupe_first(parsed.select(*CACHE_COLUMNS).withColumn("_order", order), ["camis"], "_order").drop("_order")
    if _exists(spark, cache_path):  # a read that fails for another reason is an error
        cached = spark.read.schema(fresh.schema).parquet(cache_path).select("camis")
        fresh = fresh.join(cached, "camis", "left_anti")
    fresh.select(*CACHE_COLUMNS).write.mode("append").parquet(cache_path)


def start_enrichment(spark: SparkSession, landing_dir: str, cache_path: str, name: str = "enrichment",
                     available_now: bool = True):
    """Start the incremental load; ``available_now`` processes what has landed and stops."""
    ckpt = ensure_checkpoint_dir(spark).rstrip("/") + f"/stream-{name}"
    stream = spark.readStream.schema(LANDING_SCHEMA).json(landing_dir)
    w = (stream.writeStream.foreachBatch(lambda df, _epoch: _append_new(df, cache_path))
               .option("checkpointLocation", ckpt))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()


def cache_table(spark: SparkSession, cache_path: str) -> DataFrame:
    """The cache with the label recomputed over all rows (as the published merge does)."""
    df = spark.read.parquet(cache_path)
    return df.withColumn("high_rating", F.coalesce(F.col("yelp_rating") >= 4.0, F.lit(False)).cast("int"))
