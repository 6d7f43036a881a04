from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as spark_entry
from logloom.plans import registry
from logloom.plans.registry import ORACLES, QUERIES

SF_DIR = "/root/testdata/sf0.001"
TABLES = sorted(path.stem for path in Path(SF_DIR).glob("*.parquet"))

pytestmark = pytest.mark.skipif(not TABLES, reason="the test tables are not here")


@pytest.fixture(scope="module")
def oracle():
    connection = duckdb.connect()
    for name in TABLES:
        connection.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return connection


def in_order(rows):
    return sorted(rows, key=lambda row: [(value is None, str(value)) for value in row])


@pytest.mark.parametrize("name", list(QUERIES))
def test_same_rows_as_sql(spark, oracle, name):
    frame = QUERIES[name](spark, SF_DIR)
    columns = sorted(frame.columns)
    relation = oracle.sql(ORACLES[name])
    assert sorted(relation.columns) == columns
    places = [relation.columns.index(column) for column in columns]
    expected = [tuple(row[place] for place in places) for row in relation.fetchall()]
    assert in_order(map(tuple, frame.select(columns).collect())) == in_order(expected)


def test_registered_in_the_entry():
    assert QUERIES.items() <= spark_entry.queries().items()
    assert ORACLES.items() <= spark_entry.oracle_sql().items()


def test_entry(spark):
    assert spark_entry.entry(spark).columns == ["start", "group", "count"]


# These make a stored table first, so only the plan of their last step could be seen.
_ON_A_TABLE = ("stored", "stream", "retention", "reconcile", "files", "day_window", "catalog")


@pytest.mark.parametrize(
    "name", [name for name in QUERIES if not name.startswith(_ON_A_TABLE)]
)
def test_plan_is_native_and_has_no_bottleneck(spark, name):
    frame = QUERIES[name](spark, SF_DIR)
    plan = frame._jdf.queryExecution().executedPlan().toString()
    for bad in ("EvalPython", "InPandas", "CartesianProduct", "NestedLoop", "SinglePartition"):
        assert bad not in plan


@pytest.mark.parametrize("name", ["catalog_retention_survivors", "files_batch_summary"])
def test_small_files_are_dealt_to_all_tasks(spark, monkeypatch, name):
    """Few bytes in many files are no reason to write them all from one task."""
    folders = []

    def noted(*args):
        folders.append(registry_path(*args))
        return folders[-1]

    registry_path = registry.scratch_path
    monkeypatch.setattr(registry, "scratch_path", noted)
    coalesced = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    QUERIES[name](spark, SF_DIR)
    assert spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled") == coalesced
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folders)
    task = F.regexp_extract("path", "/part-([0-9]+)-[^/]*$", 1)
    assert files.select(task).distinct().count() > 1


def test_a_catalog_table_is_made_without_listing_its_files(spark):
    """The writer knows its partitions; to look for them costs a call for every file."""
    metrics = spark._jvm.org.apache.spark.metrics.source.HiveCatalogMetrics
    before = metrics.METRIC_PARALLEL_LISTING_JOB_COUNT().getCount()
    frame = QUERIES["catalog_retention_survivors"](spark, SF_DIR)
    assert metrics.METRIC_PARALLEL_LISTING_JOB_COUNT().getCount() == before
    assert frame.where("epochs > 1 AND rows > 0").count() > 0
