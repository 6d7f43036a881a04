"""Settings the operators rely on, applied to whatever session the caller has."""

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

SETTINGS = {
    # Timestamps are UTC instants everywhere.
    "spark.sql.session.timeZone": "UTC",
    # A repeated JSON key keeps its last value instead of failing the body.
    "spark.sql.variant.allowDuplicateKeys": "true",
    # The default timestamp encoding has no min/max, so no row group could be skipped.
    "spark.sql.parquet.outputTimestampType": "TIMESTAMP_MICROS",
    # The table writer leans on adaptive execution to size and split its output.
    "spark.sql.adaptive.enabled": "true",
}


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings; safe to call as often as needed."""
    for key, value in SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


@contextmanager
def small_tasks(spark: SparkSession) -> Iterator[None]:
    """Writes in this block keep all their shuffle partitions, however few bytes each has.

    For rows that make a file each: tasks put together by bytes are few, and one of them may
    hold most of the files. Partitions with many bytes are split as ever.
    """
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    usual = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        yield
    finally:
        spark.conf.set(key, usual)


def scratch_path(spark: SparkSession, purpose: str) -> str:
    """A fresh folder under the shared folder the cluster names for such data.

    Only a session without that setting (a test on one machine) gets a local one.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder all executors share")
        shared = tempfile.mkdtemp(prefix="logloom-")
    return f"{shared.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"
