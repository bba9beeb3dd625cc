"""Dashboard filter, enrichment anti join, what-if fallback."""

from inspectra.operators import serving as SV


def test_dashboard_empty_lists(spark):  # MF15
    df = spark.createDataFrame([("A", 2023, "x"), ("B", 2024, "y")], "boro string, inspection_year int, cuisine_grouped string")
    assert SV.dashboard_filter(df, [], [2023], []).count() == 0
    assert SV.dashboard_filter(df, ["A", "B"], [2023, 2024], []).count() == 2
    assert SV.dashboard_filter(df, ["A", "B"], [2023, 2024], ["y"]).count() == 1


def test_enrichment_pending_string_keys(spark):  # MF16 (H3)
    cache = spark.createDataFrame([(1,), (2,)], "camis int")
    ents = spark.createDataFrame([("2", "n2", None, None, None), ("3", "n3", "1", "Main St", "10001")],
                                 "camis string, dba string, building string, street string, zipcode string")
    got = SV.enrichment_pending(ents, cache).collect()
    assert [(r.camis, r.location) for r in got] == [("3", "1 Main St 10001 New York")]


def test_fallback_clipped(spark):
    df = spark.createDataFrame([(10, 10, 1), (0, 0, 0)], "critical_count int, violation_count int, prev_failed int")
    got = [(round(r.prob, 6), r.predicted) for r in SV.whatif_fallback(df).collect()]
    assert got == [(0.95, 1), (0.05, 0)]


def test_cube_answers_every_selection(spark):
    import datetime
    import random
    rng = random.Random(4)
    rows = [(rng.choice("AB"), y, rng.choice(["x", "y", "Other"]), datetime.date(y, rng.randrange(1, 4), 3), rng.choice([0, 1, 1, None]), 1.0)
            for y in (rng.choice([2022, 2023, 2024]) for _ in range(400))]
    df = spark.createDataFrame(rows, "boro string, inspection_year int, cuisine_grouped string, inspection_date date, failed int, score double")
    cube = SV.overview_cube(df)
    for regions, years, categories in ((["A"], [2022, 2024], ["x"]), (["A", "B"], [2023], []), (["B"], [2022], ["y", "Other"]), ([], [2022], [])):
        own = [r for r in rows if r[0] in regions and r[1] in years and (not categories or r[2] in categories)]
        want = {}
        for r in own:
            want.setdefault(r[2], []).append(r[4])
        got = {r.cuisine_grouped: (r.n, round(r.failure_rate, 9)) for r in SV.cube_rates(cube, "cuisine_grouped", regions, years, categories).collect()}
        assert got == {k: (len(v), round(sum(x or 0 for x in v) / sum(x is not None for x in v), 9)) for k, v in want.items()}
        trend = {(r.year_month, r.boro): r.n for r in SV.cube_trend(cube, regions, years, categories).collect()}
        months = {(f"{r[3]:%Y-%m}", r[0]) for r in own}
        assert trend == {m: sum(r[4] is not None for r in own if (f"{r[3]:%Y-%m}", r[0]) == m) for m in months}


def test_registered_selections_are_not_empty(spark):
    from conftest import SF_CHECK
    from inspectra.plans import catalog
    for name in ("dashboard_filter", "overview_categories_late", "overview_years_one", "overview_regions", "overview_trend", "map_points_bucket", "map_points_region"):
        assert not catalog.QUERIES[name](spark, SF_CHECK).isEmpty(), name
    assert catalog.QUERIES["overview_tiles"](spark, SF_CHECK).first()["n_inspections"] > 100
