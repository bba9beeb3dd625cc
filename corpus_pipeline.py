"""Corpus pipeline: language ID, quality rules, line dedup, SimHash near-dedup, packing.

``STAGES`` are (name, function) pairs; each function takes (spark, docs, sf_dir)
and returns a DataFrame.  All but the last return the columns of ``docs``, rows
that the stage decided to keep.  ``run`` writes every stage's result as Parquet
into the shared folder and hands the next stage what it reads back, so a lost
executor only re-reads files.

Every stage takes null and empty texts, repeated rows, empty tables and further
columns (which it passes on); what becomes of them is said at each stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inspectra.llm import langid, line_dedup, packing, quality, simhash
from inspectra.llm.common import Scratch, read_table
from inspectra.session import setting

#: Texts that language ID hands to a Python worker at once; some MB, which worker and JVM both hold.
ROWS_AT_ONCE = 1000


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language: too far from every centroid, or no letter in the text (null included).

    The centroids are learnt from the documents that have a lang and aren't held out.
    """
    with setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS_AT_ONCE)):
        model = langid.fit(langid.learnable(docs))
        # written here, while the setting holds
        return Scratch(spark, "pipeline-langid").table(langid.identified(docs, model), "identified")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that fail the base rules or whose likelihood ratio is below the cut.

    Every row has its own verdict, also rows that share a doc_id or have none.
    """
    found = quality.judged(docs, read_table(spark, sf_dir, "labels"), Scratch(spark, "pipeline-quality"), docs.columns)
    return found.where("kept").select("row.*")


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves one line of each group of similar lines; drops documents that have no line left."""
    return line_dedup.drop_repeated_lines(docs, Scratch(spark, "pipeline-lines"))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves the document with the smallest doc_id of each component; repeated rows become one.

    Rows with a null doc_id can't be named as the one that stays and are left alone.
    """
    scratch = Scratch(spark, "pipeline-simhash")
    found = scratch.table(simhash.near_duplicates(docs, scratch).select("doc_id", "component_id"), "found")
    mine = f"_{uuid.uuid4().hex}"  # no column of docs is called like this
    # written, so that the planner goes by its size
    gone = scratch.table(found.where("doc_id <> component_id").select(F.col("doc_id").alias(mine)).distinct(), "gone")
    left = docs.join(gone, F.col("doc_id") == F.col(mine), "left_anti")
    unique = found.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").isEmpty()
    return left if unique else left.where("doc_id IS NOT NULL").dropDuplicates().unionByName(left.where("doc_id IS NULL"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with their bucket, batch and slot."""
    return packing.pack(docs, Scratch(spark, "pipeline-packing"))


STAGES = [("language ID", language_id), ("quality rules", quality_rules), ("line dedup", line_dedup_stage),
          ("SimHash near-dedup", simhash_near_dedup), ("packing", packing_stage)]

#: Tokens, centroids and fuzzy lines are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    scratch = Scratch(spark, "pipeline")
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = scratch.table(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
