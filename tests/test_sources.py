"""Landing parsers (S5, F20, F21), typed CSV scan (S1/S2/P27), sinks."""

import json

from pyspark.sql import functions as F

from inspectra import schemas as S
from inspectra.sources import landing as L
from inspectra.sources import sinks
from inspectra.sources import standin as SI
from conftest import SF_SMALL


def test_flatten_business_json(spark):
    docs = [("1", json.dumps({"businesses": [{"id": "x", "rating": 4.5, "review_count": 10, "price": "$$",
                                                "categories": [{"alias": "pizza"}, {"alias": "bars"}]}]})),
            ("2", json.dumps({"businesses": []})),
            ("3", json.dumps({"businesses": [{"id": "y", "rating": 3.0, "review_count": 1, "categories": []}]}))]
    out = {r.camis: r for r in L.flatten_business_json(spark.createDataFrame(docs, "camis string, json string")).collect()}
    assert (out["1"].yelp_price, out["1"].yelp_category, out["1"].high_rating) == (2.0, "pizza,bars", 1)
    assert out["2"].yelp_rating is None and out["2"].high_rating == 0
    assert out["3"].yelp_price == 0.0


def test_weather_json_round_trip(spark):
    exploded = L.weather_hourly_explode(SI.weather_landing(spark, SF_SMALL))
    direct = SI.weather_hourly(spark, SF_SMALL)
    assert exploded.count() == direct.count()
    assert exploded.exceptAll(direct.select(*exploded.columns)).count() == 0


def test_census_matrix(spark):
    m = json.dumps([["B19013_001E", "B01003_001E", "B02001_002E", "NAME", "state", "county"],
                    ["-666666666", "100", "40", "X County", "36", "061"]])
    out = L.census_explode(spark.createDataFrame([("d", m)], "doc_id string, json string")).first()
    assert out.median_household_income is None and out.total_population == 100.0 and out.boro == "MANHATTAN"


def test_typed_csv_scan(spark, tmpdir_path):
    path = f"{tmpdir_path}/panel.csv"
    with open(path, "w") as f:
        f.write("camis,inspection_date,score\n1,2023-01-05,12\n2,not a date,NaN\n3,2023-02-01 10:00:00,\n")
    schema = S.T.StructType([S.T.StructField("camis", S.T.StringType()), S.T.StructField("inspection_date", S.T.DateType()),
                             S.T.StructField("score", S.T.DoubleType())])
    rows = L.read_typed_csv(spark, path, schema).orderBy("camis").collect()
    assert [r.score for r in rows] == [12.0, None, None]
    assert rows[1].inspection_date is None and str(rows[2].inspection_date) == "2023-02-01"


def test_write_and_read_back(spark, tmpdir_path):
    df = spark.createDataFrame([(1, 2023), (2, 2024)], "x int, inspection_year int")
    sinks.write_table(df, f"{tmpdir_path}/t", partition_by="inspection_year")
    back = spark.read.parquet(f"{tmpdir_path}/t").filter(F.col("inspection_year") == 2024)
    assert [r.x for r in back.collect()] == [2]
    sinks.write_metrics(df, f"{tmpdir_path}/m")
    assert spark.read.option("header", True).csv(f"{tmpdir_path}/m").count() == 2


def test_the_json_landing_is_compressed(spark):
    from inspectra.plans import catalog
    out = catalog.QUERIES["scan_inspections_json"](spark, SF_SMALL)
    files = out.inputFiles()
    assert files and all(f.endswith(".json.gz") for f in files)
    want = catalog.QUERIES["scan_inspections"](spark, SF_SMALL).select(*out.columns)
    assert out.exceptAll(want).isEmpty() and want.exceptAll(out).isEmpty()
