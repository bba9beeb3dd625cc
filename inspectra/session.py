"""Session construction and lineage checkpoints."""

from __future__ import annotations

import contextlib
import functools
import hashlib
import os
import pathlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings a cluster deployment is expected to keep.  AQE re-plans joins at
# runtime (small build sides become broadcasts, skewed partitions are split)
# and coalesces small shuffle partitions.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


# Settings recommended for a large cluster run (100 TB class): partitions sized
# by bytes, AQE sizing shuffle partitions and splitting skewed ones, a shared
# checkpoint folder.  Apply with ``get_spark(extra=CLUSTER_CONF | {...})``.
CLUSTER_CONF = {
    "spark.sql.files.maxPartitionBytes": "256m",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256m",
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "20000",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
    "spark.sql.autoBroadcastJoinThreshold": "64m",
    "spark.sql.shuffle.partitions": "8000",
}


def get_spark(master: str | None = None, app: str = "inspectra",
              shuffle_partitions: int | None = None,
              extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the defaults above."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    if master and master.startswith("local"):
        conf.setdefault("spark.driver.memory", os.environ.get("INSPECTRA_DRIVER_MEM", "16g"))
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the shared folder named by ``spark.checkpoint.dir``.

    Only a local-mode session (tests, laptop runs) without that setting gets a
    private scratch folder; a cluster session without it is an error, because a
    machine-local folder would not survive the loss of an executor.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if configured:
        sc.setCheckpointDir(configured)
        return configured
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder before cutting lineage")
    path = tempfile.mkdtemp(prefix="inspectra-ckpt-", dir="/tmp")
    sc.setCheckpointDir(path)
    return path


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/inspectra-{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table of its own in the shared checkpoint folder, read back (cuts the lineage)."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Partitions of a table (years of the visits) that a task writes side by side; rows of further ones are sorted first.
PARTITION_WRITERS = 32


@contextlib.contextmanager
def setting(spark: SparkSession, key: str, value: str):
    """A setting that holds for the actions inside the block only."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def write_parquet(df: DataFrame, path: str, partition_by: str | None = None, mode: str = "error") -> None:
    """``df`` as Parquet, ``partition_by`` with a file a task and partition.

    Tasks keep a file open per partition: without it each one would sort its wide
    rows by the partition column, and hold them, which grew with the input.
    """
    w = df.write.mode(mode)
    with setting(df.sparkSession, "spark.sql.maxConcurrentOutputFileWriters", str(PARTITION_WRITERS)):
        (w.partitionBy(partition_by) if partition_by else w).parquet(path)


_stage_tables: dict = {}


@functools.lru_cache(maxsize=1)
def _code() -> str:
    """Digest of this package's sources: a table that other code wrote is not taken for ours."""
    root = pathlib.Path(__file__).parent
    return hashlib.sha1(b"".join(p.read_bytes() for p in sorted(root.rglob("*.py")) if "llm" not in p.parts)).hexdigest()


def fingerprint(spark: SparkSession, folder: str) -> str:
    """Digest of the files under ``folder``: names, sizes and times.  New data at the same place has another one."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    files, found = fs.listFiles(path, True), []
    while files.hasNext():
        f = files.next()
        found.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return hashlib.sha1(repr(sorted(found)).encode()).hexdigest()


def stored(spark: SparkSession, name: str, folder: str, make, load):
    """What ``make(path)`` writes for the input folder, as ``load(path)`` reads it.

    The path under the shared checkpoint folder is named after the input's
    fingerprint and the code's, so it is found again by later queries and
    sessions and never taken for other data.  A mark written last tells that it
    is whole; what a lost driver left half-written is made anew beside it.
    """
    tag = hashlib.sha1(f"{name}|{fingerprint(spark, folder)}|{_code()}".encode()).hexdigest()[:20]
    memo = (spark.sparkContext.applicationId, tag)
    if memo not in _stage_tables:
        root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/inspectra-{name}-{tag}"
        mark = spark._jvm.org.apache.hadoop.fs.Path(f"{root}-done")
        fs = mark.getFileSystem(spark._jsc.hadoopConfiguration())
        if not fs.exists(mark):
            own = f"{root}-{uuid.uuid4().hex[:8]}"
            make(own)
            spark.createDataFrame([(own,)], "path string").coalesce(1).write.mode("overwrite").parquet(f"{root}-done")
        _stage_tables[memo] = load(spark.read.schema("path string").parquet(f"{root}-done").first()["path"])
    return _stage_tables[memo]


def stage_table(spark: SparkSession, name: str, key: str, build, partition_by: str | None = None) -> DataFrame:
    """Write a stage output as Parquet under the shared checkpoint folder and read it back.

    The written table cuts the lineage (a lost executor re-reads files instead
    of recomputing the stage), keeps Parquet statistics so later filters and
    projections are pushed to the scan, and is reused by every later query on
    the same files (``key`` is their folder), in this session or another.
    ``partition_by`` lays the table out for partition pruning.
    ``build`` is a thunk so that a reused table costs no planning at all.
    """
    def make(path: str) -> None:
        df = build()
        write_parquet(df.select(*df.columns), path, partition_by)
        # the column order is lost by the partitioning
        spark.createDataFrame([(df.columns,)], "columns array<string>").coalesce(1).write.parquet(f"{path}-columns")

    def load(path: str) -> DataFrame:
        return spark.read.parquet(path).select(*spark.read.parquet(f"{path}-columns").first()["columns"])

    return stored(spark, f"stage-{name}", key, make, load)
