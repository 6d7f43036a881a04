"""Reading the given tables and cutting long plans at tables in the shared folder."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.session import scratch_path

#: Rows of labels that are sent to every task; more are joined by a shuffle of the texts.
LABELS_SENT = 1_000_000
_ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sent_if_small(labels: DataFrame) -> DataFrame:
    """The frame, marked to be sent to every task if its rows, counted, are few enough.

    The join gives the same rows either way.
    """
    return F.broadcast(labels) if labels.count() <= LABELS_SENT else labels


def stored(
    frame: DataFrame, purpose: str, arrow_rows: int | None = None, **options: str
) -> DataFrame:
    """The frame, computed once, written to the shared folder and read from there.

    Later steps start from these files, so a lost executor costs no earlier step.
    ``arrow_rows`` bounds the rows that are handed to Python at once while writing, for
    rows that are large.
    """
    spark = frame.sparkSession
    path = scratch_path(spark, purpose)
    usual = spark.conf.get(_ARROW_ROWS)
    try:
        if arrow_rows is not None:
            spark.conf.set(_ARROW_ROWS, str(arrow_rows))
        frame.write.options(**options).parquet(path)
    finally:
        spark.conf.set(_ARROW_ROWS, usual)
    return spark.read.schema(frame.schema).parquet(path)


@contextmanager
def bucketed(frame: DataFrame, key: str, purpose: str, **options: str) -> Iterator[DataFrame]:
    """The frame, stored like others but in buckets of ``key``, as many as shuffle partitions.

    Grouping or joining by ``key`` reads a bucket in a task and moves none of its rows. Spark
    knows buckets by a table's entry in the catalog, which goes when the block ends; what
    depends on the rows has to be computed before.
    """
    spark = frame.sparkSession
    name = f"{purpose}_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    writer = frame.write.format("parquet").options(path=scratch_path(spark, purpose), **options)
    try:
        writer.bucketBy(buckets, key).saveAsTable(name)
        yield spark.table(name)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
