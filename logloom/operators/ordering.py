"""Places of rows in one order over a whole table, without a single task for all rows."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.session import scratch_path

# Where a task number ends and a row number begins in Spark's per-task row ids.
_ROW_BITS = 33
_TASK_ROW = "_task_row"
_TASK = "_task"
_BEFORE = "_rows_before"


def numbered(rows: DataFrame, *order: Column, name: str = "number") -> tuple[DataFrame, int]:
    """The rows with their number from 1 on in an order, and how many there are.

    Tasks sort ranges of the order and write their rows once, each with its place in the
    task. Only the tasks' row counts reach the driver, where their running sums tell how
    many rows come before each task's. The order should be total: rows that tie in it are
    numbered in any order, and all in one task.
    """
    if clash := {_TASK_ROW, _TASK, _BEFORE, name} & set(rows.columns):
        raise ValueError(f"columns already there: {', '.join(sorted(clash))}")
    spark = rows.sparkSession
    path = scratch_path(spark, "numbered")
    (
        rows.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn(_TASK_ROW, F.monotonically_increasing_id())
        .write.parquet(path)
    )
    schema = rows.withColumn(_TASK_ROW, F.lit(0).cast("long")).schema
    placed = spark.read.schema(schema).parquet(path).withColumn(
        _TASK, F.shiftright(_TASK_ROW, _ROW_BITS)
    )
    counts = sorted(map(tuple, placed.groupBy(_TASK).count().collect()))
    before = [0, *accumulate(count for _, count in counts)]
    tasks = spark.createDataFrame(
        [(task, rows_before) for (task, _), rows_before in zip(counts, before)],
        f"{_TASK} bigint, {_BEFORE} bigint",
    )
    # One short row per task of the sort, so it is sent to all tasks.
    found = placed.join(F.broadcast(tasks), _TASK)
    within = F.col(_TASK_ROW).bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    found = found.withColumn(name, F.col(_BEFORE) + within + 1)
    return found.drop(_TASK_ROW, _TASK, _BEFORE), before[-1]


def falls(rows: DataFrame, value: str, *order: Column) -> DataFrame:
    """Rows whose ``value`` isn't greater than that of the row before them in an order.

    Returns ``value, previous``; none at all if the values rise strictly.
    """
    placed, _ = numbered(rows, *order, name="_place")
    one = placed.select("_place", value)
    other = placed.select((F.col("_place") + 1).alias("_place"), F.col(value).alias("previous"))
    return one.join(other, "_place").where(F.col(value) <= F.col("previous")).drop("_place")
