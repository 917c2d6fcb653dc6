"""Registered queries beside their SQL on the smallest tables."""

import glob
import os

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check_queries import compare
from oracle_queries import SQL
from sightline.plans.catalog import QUERIES
from tests.conftest import SMALL

CHOSEN = sorted(name for name in QUERIES if name in SQL)


@pytest.fixture(scope="module")
def database():
    made = duckdb.connect()
    for file in glob.glob(f"{SMALL}/*.parquet"):
        made.execute(f"CREATE VIEW {os.path.basename(file)[:-8]} AS SELECT * FROM '{file}'")
    return made


@pytest.mark.parametrize("name", CHOSEN)
def test_query_agrees_with_its_sql(spark, database, name):
    verdict, _ = compare(spark, database, SMALL, name, oracle_sql()[name])
    assert verdict.startswith("ok"), verdict


@pytest.mark.parametrize("name", ["stream_scan", "stream_severity_counts", "stream_seen_urls", "stream_rate_grants", "stream_adaptive_rates"])
def test_streams_read_tables_of_many_files(spark, tmp_path, name):
    for table in ("pages", "events"):
        spark.read.parquet(f"{SMALL}/{table}.parquet").repartition(3).write.parquet(f"{tmp_path}/{table}.parquet")
    expected, found = (QUERIES[name](spark, folder) for folder in (SMALL, str(tmp_path)))
    assert expected.count() and sorted(map(str, found.collect())) == sorted(map(str, expected.collect()))


def test_registration():
    assert set(oracle_sql()) <= set(queries())
    assert set(QUERIES) <= set(queries())
    assert set(QUERIES) <= set(oracle_sql())
    codes = {row.split("_", 1)[1] for row in queries() if row.startswith("rule_")}
    assert len(codes) == 22


def test_entry(spark):
    rows = entry(spark).collect()
    assert sum(r.pages for r in rows) == 50 and all(r.issues == r.major for r in rows)
