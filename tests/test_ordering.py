import pytest
from pyspark.sql import functions as F

from logloom.operators import listing
from logloom.operators.ordering import falls, numbered


@pytest.fixture(scope="module")
def logs(spark):
    """Rows of which half share one instant."""
    n = F.col("id")
    return spark.range(1, 1001).select(
        "id",
        F.timestamp_seconds(F.when(n % 2 == 0, F.lit(500)).otherwise((n * 37) % 300)).alias("timestamp"),
        F.when(n % 3 == 0, "error").otherwise("info").alias("level"),
        F.lit("s").alias("service"),
        F.lit("m").alias("message"),
        F.parse_json(F.lit("{}")).alias("attributes"),
    )


def test_rows_are_numbered_in_order_over_all_tasks(spark, logs):
    placed, total = numbered(logs.drop("attributes"), F.desc("timestamp"), F.asc("id"), name="place")
    rows = placed.collect()
    assert total == 1000 and placed.columns == [*logs.drop("attributes").columns, "place"]
    assert len({row.place for row in rows}) == 1000
    in_order = sorted(rows, key=lambda row: (-row.timestamp.timestamp(), row.id))
    assert [row.place for row in in_order] == list(range(1, 1001))


def test_numbering_an_empty_table_and_clashing_columns(spark, logs):
    placed, total = numbered(logs.where("false").select("id"), F.col("id"))
    assert total == 0 and placed.collect() == []
    for name in ("number", "_task", "_rows_before", "_task_row"):
        with pytest.raises(ValueError, match=name):
            numbered(logs.select(F.col("id").alias(name)), F.col(name))


def test_no_task_sees_all_rows(logs):
    placed, _ = numbered(logs.select("id"), F.col("id"))
    plan = placed._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and "Window" not in plan


def test_falls_are_found_wherever_the_tasks_divide_the_rows(spark):
    rows = spark.range(2000).select("id", F.col("id").alias("value"))
    assert falls(rows, "value", F.col("id")).count() == 0
    broken = rows.withColumn("value", F.when(F.col("id").isin(700, 1500), 3).otherwise(F.col("value")))
    assert sorted(map(tuple, falls(broken, "value", F.col("id")).collect())) == [(3, 699), (3, 1499)]
    twice = rows.union(rows.where("id = 5"))
    assert [tuple(row) for row in falls(twice, "value", F.col("id")).collect()] == [(5, 5)]
    assert falls(rows.where("false"), "value", F.col("id")).count() == 0


@pytest.mark.parametrize("params", [{}, {"limit": "7", "level": "error"}, {"limit": "250"}, {"limit": "1000"}], ids=str)
def test_page_keys_are_the_cursors_of_a_walk(logs, params):
    walked = [page.next_cursor for page in listing.walk(lambda p: listing.list_logs(logs, p), params)] if params.get("limit") != "7" else None
    keys = listing.page_keys(logs, params).orderBy("page").collect()
    limit = int(params.get("limit", "100"))
    whole = [row["id"] for row in listing.export(logs, params).collect()]
    assert [str(row.id) for row in keys] == [
        whole[end - 1] for end in range(limit, len(whole), limit)
    ]
    assert [row.page for row in keys] == list(range(1, len(keys) + 1))
    if walked is not None:
        assert [row.next_cursor for row in keys] == walked[:-1] and walked[-1] is None
    for row in keys:
        assert listing.decode_cursor(row.next_cursor).id == row.id
