"""Driver contract: entry smoke, catalogue coverage, SQL twins on sf0.001."""

import duckdb
import pytest

import __spark_entry__ as entry
from inspectra.sources.tables import TABLES
from conftest import SF_SMALL

TWINS = sorted(set(entry.oracle_sql()) - set(entry.LLM_ORACLE))


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "failed" in df.columns


def test_oracle_keys_subset_of_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) >= 100


@pytest.mark.parametrize("name", TWINS)
def test_matches_duckdb(spark, name):
    from tools.oracle_check import rows_of
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    sdf = entry.queries()[name](spark, SF_SMALL)
    res = con.execute(entry.oracle_sql()[name])
    dcols = [d[0] for d in res.description]
    assert sorted(sdf.columns) == sorted(dcols)
    assert rows_of(sdf.columns, [tuple(r) for r in sdf.collect()]) == rows_of(dcols, res.fetchall())
