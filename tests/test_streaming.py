"""S14 on Structured Streaming: only new entities are appended, restart-safe."""

import json

from inspectra.streaming.enrichment import cache_table, start_enrichment


def _land(spark, path, items):
    rows = [(k, json.dumps({"businesses": [{"id": k, "rating": r, "review_count": 1, "price": "$",
                                            "categories": [{"alias": "a"}]}]})) for k, r in items]
    spark.createDataFrame(rows, "camis string, json string").write.mode("append").json(path)


def test_incremental_enrichment(spark, tmpdir_path):
    landing, cache = f"{tmpdir_path}/landing", f"{tmpdir_path}/cache"
    _land(spark, landing, [("1", 4.5), ("2", 3.0)])
    start_enrichment(spark, landing, cache, name="t1").awaitTermination(120)
    _land(spark, landing, [("2", 3.0), ("3", 4.0)])
    start_enrichment(spark, landing, cache, name="t1").awaitTermination(120)
    got = {r.camis: r.high_rating for r in cache_table(spark, cache).collect()}
    assert got == {"1": 1, "2": 0, "3": 1}
