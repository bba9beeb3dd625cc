"""Physical-plan checks: broadcast where bounded, no single-partition exchange on
data, pushdown and partition pruning on the stage tables."""

from pyspark.sql import functions as F

from inspectra.operators import cleaning as C
from inspectra.operators import features as FE
from inspectra.plans import build as B
from inspectra.session import setting
from inspectra.sources import standin as SI
from conftest import SF_SMALL


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_panel_plan_shape(spark):
    plan = _plan(B.panel_plan(spark, SF_SMALL))
    assert "BroadcastHashJoin" in plan
    assert "SinglePartition" not in plan
    assert "Window" in plan


def test_time_split_prunes_partitions(spark):
    train, test = FE.train_test(B.clean(spark, SF_SMALL), "2000-01-01")
    plan = _plan(test.select("camis"))
    assert "PartitionFilters: [isnotnull(inspection_year" in plan and "2000" in plan
    assert test.filter(F.col("inspection_date") < "2000-01-01").count() == 0
    assert train.filter(F.col("inspection_date") >= "2000-01-01").count() == 0


def test_scan_is_pruned(spark):
    plan = _plan(B.clean(spark, SF_SMALL).groupBy("boro").agg(F.avg("failed")))
    assert "ReadSchema: struct<boro:string,failed:int>" in plan


def test_stage_tables_live_under_the_configured_checkpoint_dir(spark):
    configured = spark.conf.get("spark.checkpoint.dir")
    panel = B.panel(spark, SF_SMALL)
    files = panel.inputFiles()
    assert files and all(configured.rstrip("/") in f for f in files)


def test_stage_tables_follow_their_input_and_outlive_a_session(spark, tmpdir_path):
    from inspectra import session
    spark.range(10).write.parquet(f"{tmpdir_path}/t.parquet")
    built = []

    def stage():
        def build():
            built.append(1)
            return spark.read.parquet(f"{tmpdir_path}/t.parquet").selectExpr("id % 2 AS part", "id")
        return session.stage_table(spark, "try", tmpdir_path, build, partition_by="part")

    assert stage().count() == 10 and stage().columns == ["part", "id"] and len(built) == 1
    session._stage_tables.clear()  # another session: the table is found again
    assert stage().agg({"id": "sum"}).first()[0] == 45 and stage().columns == ["part", "id"] and len(built) == 1
    spark.range(3).write.mode("append").parquet(f"{tmpdir_path}/t.parquet")  # new data at the same place is seen
    assert stage().count() == 13 and len(built) == 2


def test_a_fitted_model_is_loaded_and_not_fitted_again(spark, tmpdir_path):
    from inspectra import session
    made = []
    take = lambda: session.stored(spark, "try-model", tmpdir_path, lambda p: (made.append(p), spark.range(2).write.parquet(p)),
                                  lambda p: spark.read.parquet(p).count())
    assert take() == 2
    session._stage_tables.clear()
    assert take() == 2 and len(made) == 1


def test_partitioned_writes_do_not_sort_their_rows(spark, tmpdir_path, monkeypatch):
    from pyspark.sql.readwriter import DataFrameWriter
    from inspectra import session
    key, seen, real = "spark.sql.maxConcurrentOutputFileWriters", [], DataFrameWriter.parquet
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, path: (seen.append(spark.conf.get(key)), real(self, path))[1])
    before = spark.conf.get(key)
    df = spark.range(0, 400, 1, 2).selectExpr("id % 40 AS part", "id")  # more parts than writers
    session.stage_table(spark, "unsorted", tmpdir_path, lambda: df, partition_by="part")
    assert int(seen[0]) == session.PARTITION_WRITERS and spark.conf.get(key) == before
    got = session.stage_table(spark, "unsorted", tmpdir_path, lambda: df, partition_by="part")
    assert sorted(tuple(r) for r in got.collect()) == sorted((i % 40, i) for i in range(400))


def test_lines_are_not_shuffled_to_small_suppliers(spark):  # F17, F22, F23
    with setting(spark, "spark.sql.autoBroadcastJoinThreshold", "100k"):
        plan = _plan(SI.complaints_raw(spark, SF_SMALL))
    assert "SortMergeJoin" not in plan and "l_suppkey" in plan


def test_orders_meet_their_lines_before_the_customers_columns(spark):  # F17, F22, F23
    plan = SI.order_inspections(spark, SF_SMALL)._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.split("\n") if "Join " in line]  # the outermost first
    at = [next(i for i, line in enumerate(joins) if key in line) for key in ("c_custkey", "l_orderkey")]
    assert at[0] < at[1]


def test_top_k_of_takes_the_form_of_distinct_values(spark):  # F17, F22, F23
    calls = spark.sparkContext.accumulator(0)

    def upper(s):
        calls.add(1)
        return s.upper()

    df = spark.createDataFrame([(x,) for x in ["a", "A", "b", "c", "c", None] * 200], "x string")
    got = C.top_k_of(df, "x", lambda c: F.udf(upper)(F.trim(c)), 2).collect()
    assert [(r.x, r.n) for r in got] == [("A", 400), ("C", 400)] and 0 < calls.value <= 20
    want = C.top_k_values(df.select(F.upper("x").alias("x")), "x", 2).collect()
    assert [tuple(r) for r in got] == [tuple(r) for r in want]
