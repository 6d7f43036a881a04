"""Batches as they arrive: JSON bodies of the form ``{"logs": [entry, ...]}``.

Every reader returns ``batch_id, body_bytes, body``. ``body`` is NULL for a body
over the size limit, so an oversized file is reported without being read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logloom import schema as S
from logloom.functions import variants
from logloom.session import prepare

_FILE_SCHEMA = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("modificationTime", T.TimestampType()),
        T.StructField("length", T.LongType()),
        T.StructField("content", T.BinaryType()),
    ]
)

# Wrapping the body in an array makes text after the object an error, and parsing
# the entries one by one keeps the key dictionary of each as small as the entry.
_WRAPPED = "array<struct<logs:array<variant>>>"
_STRICT_JSON = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}


def _from_files(files: DataFrame) -> DataFrame:
    # The length test reaches the source, which then skips the content.
    small = files.where(F.col("length") <= S.MAX_BODY_BYTES).select(
        F.col("path").alias("batch_id"),
        F.col("length").alias("body_bytes"),
        F.make_valid_utf8(F.col("content").cast("string")).alias("body"),
    )
    large = files.where(F.col("length") > S.MAX_BODY_BYTES).select(
        F.col("path").alias("batch_id"),
        F.col("length").alias("body_bytes"),
        F.lit(None).cast("string").alias("body"),
    )
    return small.unionByName(large)


def _from_lines(lines: DataFrame) -> DataFrame:
    # A line without a tab has neither an id nor a body, which makes it malformed.
    value = F.make_valid_utf8("value")
    tab = F.instr(value, "\t")
    return from_column(
        lines.select(
            F.when(tab > 0, F.substring_index(value, "\t", 1)).alias("batch_id"),
            F.when(tab > 0, F.regexp_replace(value, r"^[^\t]*\t", "")).alias("body"),
        ),
        "batch_id",
        "body",
    )


def from_column(frame: DataFrame, batch_id: str, body: str) -> DataFrame:
    """Batches already held in a table: an id column and a text column."""
    size = F.octet_length(body).cast("long")
    return frame.select(
        F.col(batch_id).cast("string").alias("batch_id"),
        size.alias("body_bytes"),
        F.when(size <= S.MAX_BODY_BYTES, F.col(body)).alias("body"),
    )


def read_files(spark: SparkSession, *paths: str) -> DataFrame:
    """One body per file; the file path is the batch id.

    Spark's file sources pass over files of no bytes at all, so these give no batch.
    """
    prepare(spark)
    return _from_files(
        spark.read.format("binaryFile").schema(_FILE_SCHEMA).load(list(paths))
    )


def read_lines(spark: SparkSession, *paths: str) -> DataFrame:
    """One batch per line: the producer's batch id, a tab, the body.

    For batch rates at which one file each would be too many small files. A line
    without a tab is a malformed batch without an id.
    """
    prepare(spark)
    return _from_lines(spark.read.text(list(paths)))


def stream_files(spark: SparkSession, path: str, **options) -> DataFrame:
    """:func:`read_files` over a folder that keeps receiving files."""
    prepare(spark)
    reader = spark.readStream.format("binaryFile").schema(_FILE_SCHEMA)
    return _from_files(reader.options(**options).load(path))


def stream_lines(spark: SparkSession, path: str, **options) -> DataFrame:
    """:func:`read_lines` over a folder that keeps receiving files."""
    prepare(spark)
    return _from_lines(spark.readStream.options(**options).text(path))


def _body_error(parsed: Column, logs: Column) -> Column:
    """Why the whole batch is refused; only bodies without entries are looked at twice."""
    body = F.col("body")
    wrapped = F.try_parse_json(F.concat(F.lit("["), body, F.lit("]"))).try_cast("array<variant>")
    top_level = F.get(wrapped, F.lit(0))
    well_formed = (F.size(wrapped) == 1) & variants.kind(top_level).rlike("^(OBJECT|ARRAY)")
    return (
        F.when(F.col("body_bytes") > S.MAX_BODY_BYTES, S.BODY_TOO_LARGE)
        .when((F.size(parsed) == 1) & logs.isNotNull(), F.lit(None).cast("string"))
        .when(body == "", S.BAD_ENVELOPE)
        .when(F.coalesce(well_formed, F.lit(False)), S.BAD_ENVELOPE)
        .otherwise(S.MALFORMED_BODY)
    )


def parse(batches: DataFrame) -> DataFrame:
    """``batch_id, body_id, error, logs``: the entries of a batch, or why it is refused.

    ``body_id`` tells bodies apart that a producer sent under one id.
    """
    parsed = F.from_json(F.concat(F.lit("["), "body", F.lit("]")), _WRAPPED, _STRICT_JSON)
    logs = F.get(F.col("parsed"), F.lit(0))["logs"]
    error = _body_error(F.col("parsed"), logs)
    return (
        batches.withColumn("parsed", parsed)
        .withColumn("error", error)
        .select(
            "batch_id",
            F.uuid().alias("body_id"),
            "error",
            F.when(F.col("error").isNull(), logs).alias("logs"),
        )
    )


def explode_entries(batches: DataFrame) -> DataFrame:
    """One row per entry with its position; a batch without entries keeps one row."""
    return batches.select(
        "batch_id", "body_id", "error", F.posexplode_outer("logs").alias("index", "entry")
    )
