import datetime as dt

import pytest

from conftest import TODAY, batches, body, entry
from logloom.operators.retention import plan_sweep, run_catalog_retention, run_retention
from logloom.plans.ingest import ingest


def days(first, last):
    first, last = map(dt.date.fromisoformat, (first, last))
    return [(first + dt.timedelta(days=n)).isoformat() for n in range((last - first).days + 1)]


def test_plan_keeps_the_cutoff_day():
    sweep = plan_sweep(days("2026-06-18", "2026-07-20"), TODAY, 30)
    assert sweep.dropped == ["2026-06-18", "2026-06-19"]
    assert sweep.added == ["2026-07-21", "2026-07-22", "2026-07-23"]


def test_plan_leaves_other_names_alone():
    sweep = plan_sweep(["2000-01-01", "default", "2000-01-01-old", "0"], TODAY, 0)
    assert sweep.dropped == ["2000-01-01"]


@pytest.mark.parametrize("value", [-1, 1.5, "30", None, float("nan"), True])
def test_bad_days(value):
    with pytest.raises(ValueError, match="retentionDays must be a non-negative integer, got: "):
        plan_sweep([], TODAY, value)


def test_sweep_of_a_stored_table(spark, table, now):
    table.add_days(["2026-07-10", "2026-07-11"])
    stamps = ["2026-07-10T01:00Z", "2026-07-11T01:00Z", "2026-07-19T01:00Z", "2001-01-01"]
    ingest(table, batches(spark, body(*[entry(timestamp=t) for t in stamps])), now)
    sweep = run_retention(table, TODAY, 9)
    assert sweep.dropped == ["2026-07-10"] and sweep.added == []
    kept = [row.log_day for row in table.scan().orderBy("timestamp").collect()]
    assert kept == ["default", "2026-07-11", "2026-07-19"]
    total = table.aggregate({"since": "2000-01-01", "until": "2027-01-01", "bucket": "1d"})
    assert sum(row["count"] for row in total.collect()) == 3, "stored counts expire with the rows"
    again = run_retention(table, TODAY, 9)
    assert again.dropped == [] and again.added == []
    later = run_retention(table, TODAY + dt.timedelta(days=5), 9)
    assert later.dropped == ["2026-07-11"]
    assert later.added == ["2026-07-25", "2026-07-26", "2026-07-27", "2026-07-28"]


def test_rows_of_a_dropped_day_go_to_default(spark, table, now):
    run_retention(table, TODAY, 0)
    assert table.days()[0] == "2026-07-20"
    ingest(table, batches(spark, body(entry(timestamp="2026-07-18T00:00Z"))), now)
    assert table.scan().first().log_day == "default"


def test_only_days_can_be_dropped(table):
    for name in ("default", "", "..", "2026-7-1"):
        with pytest.raises(ValueError):
            table.drop_day(name)


def test_sweep_of_a_catalog_table(spark):
    spark.sql("DROP TABLE IF EXISTS kept_logs")
    spark.sql(
        """CREATE TABLE kept_logs (id BIGINT, timestamp TIMESTAMP, log_day STRING, ingest_epoch BIGINT)
           USING parquet PARTITIONED BY (log_day, ingest_epoch)"""
    )
    spark.sql(
        """INSERT INTO kept_logs SELECT id, TIMESTAMP '2026-07-01', CASE id % 4
             WHEN 0 THEN '2026-07-10' WHEN 1 THEN '2026-07-11' WHEN 2 THEN '2026-07-20'
             ELSE 'default' END, id % 3 FROM range(24)"""
    )
    sweep = run_catalog_retention(spark, "kept_logs", TODAY, 9)
    assert sweep.dropped == ["2026-07-10"]
    assert sweep.added == ["2026-07-21", "2026-07-22", "2026-07-23"]
    left = spark.table("kept_logs").groupBy("log_day").count().collect()
    assert {row.log_day: row["count"] for row in left} == {"2026-07-11": 6, "2026-07-20": 6, "default": 6}
    shown = {row.partition for row in spark.sql("SHOW PARTITIONS kept_logs").collect()}
    assert "log_day=2026-07-23/ingest_epoch=-1" in shown
    again = run_catalog_retention(spark, "kept_logs", TODAY, 9)
    assert again.added == [] and again.dropped == []
    spark.sql("DROP TABLE kept_logs")
