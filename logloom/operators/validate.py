"""Validation of exploded entries: one reason per entry, decided in a fixed order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom import schema as S
from logloom.functions import variants
from logloom.functions.text import has_text
from logloom.functions.timestamps import parse_iso

_FIELDS = ("timestamp", "level", "service", "message", "attributes")
_RAW = f"struct<{','.join(f'{name}:variant' for name in _FIELDS)}>"


def _string(value: Column) -> Column:
    """The text of a JSON string; NULL for every other kind of value."""
    return F.when(variants.kind(value) == "STRING", F.try_variant_get(value, "$", "string"))


def _quoted(prefix: str, text: Column) -> Column:
    return F.concat(F.lit(prefix), text, F.lit("'"))


def _reason(now: Column) -> Column:
    raw = {name: F.col(f"raw.{name}") for name in _FIELDS}
    deadline = now + F.expr(f"INTERVAL {S.FUTURE_TOLERANCE_MINUTES} MINUTES")
    return (
        F.when(F.col("raw").isNull(), S.NOT_AN_OBJECT)
        .when(variants.is_absent(raw["timestamp"]), S.TIMESTAMP_MISSING)
        .when(F.col("timestamp_text").isNull(), S.TIMESTAMP_NOT_STRING)
        .when(
            F.col("timestamp").isNull(), _quoted(S.TIMESTAMP_INVALID, F.col("timestamp_text"))
        )
        .when(F.col("timestamp") > deadline, S.TIMESTAMP_IN_FUTURE)
        .when(variants.is_absent(raw["level"]), S.LEVEL_MISSING)
        .when(
            ~F.coalesce(F.col("level").isin(*S.LEVELS), F.lit(False)),
            _quoted(S.LEVEL_INVALID, variants.value_text("raw.level")),
        )
        .when(~F.coalesce(has_text(F.col("service")), F.lit(False)), S.SERVICE_BLANK)
        .when(~F.coalesce(has_text(F.col("message")), F.lit(False)), S.MESSAGE_BLANK)
        .when(~variants.is_flat(F.col("attributes_class")), S.ATTRIBUTES_NOT_FLAT)
    )


def check_entries(entries: DataFrame, now: Column | None = None) -> DataFrame:
    """Add ``reason`` and the typed fields to exploded entries.

    ``entries`` has ``batch_id, body_id, error, index, entry``. An entry is accepted exactly
    if ``index`` is set and ``reason`` is NULL. ``now`` defaults to the time of the
    query, which in a stream is the recorded time of the micro-batch.
    """
    now = F.current_timestamp() if now is None else now
    attributes = F.col("raw.attributes")
    attributes_class = F.when(variants.is_absent(attributes), F.lit(0)).otherwise(
        variants.attributes_class("attribute_values")
    )
    stored_attributes = (
        F.when(variants.is_absent(attributes), variants.empty_object())
        .when(
            variants.needs_rounding(F.col("attributes_class")),
            variants.round_numbers("raw.attributes"),
        )
        .otherwise(attributes)
    )
    texts = {
        "timestamp_text": _string(F.col("raw.timestamp")),
        "level": _string(F.col("raw.level")),
        "service": _string(F.col("raw.service")),
        "message": _string(F.col("raw.message")),
        "attribute_values": variants.field_values("raw.attributes"),
    }
    values = {
        "timestamp": parse_iso("timestamp_text"),
        "attributes_class": attributes_class,
    }
    typed = (
        entries.select(
            "batch_id", "body_id", "error", "index", F.col("entry").try_cast(_RAW).alias("raw")
        )
        .withColumns(texts)
        .withColumns(values)
    )
    reason = F.when(F.col("index").isNotNull(), _reason(now))
    checked = typed.select(
        "batch_id",
        "body_id",
        "error",
        "index",
        reason.alias("reason"),
        "timestamp",
        "level",
        "service",
        "message",
        stored_attributes.alias("attributes"),
    )
    # The counts show in a stream's progress. They also keep a later filter on the
    # verdict from being moved below this point, where it would validate every entry
    # a second time.
    return checked.observe(
        "entries",
        F.count("index").alias("received"),
        F.count_if(is_accepted()).alias("accepted"),
        F.count("reason").alias("rejected"),
    )


def is_accepted() -> Column:
    return F.col("index").isNotNull() & F.col("reason").isNull()


def accepted(checked: DataFrame) -> DataFrame:
    return checked.where(is_accepted()).select(
        "batch_id", "index", "timestamp", "level", "service", "message", "attributes"
    )


def rejected(checked: DataFrame) -> DataFrame:
    return checked.where(F.col("reason").isNotNull()).select("batch_id", "index", "reason")


def summarize(checked: DataFrame) -> DataFrame:
    """One row per received body: ``batch_id, error, status, accepted, rejected``.

    Bodies that share an id are judged each by itself. All rows of a body lie in one
    task, so the partial aggregate sends one row per body through the shuffle; the
    list is bounded by the size of a body.
    """
    rejection = F.when(
        F.col("reason").isNotNull(), F.struct(F.col("index"), F.col("reason"))
    )
    counted = checked.groupBy("batch_id", "body_id").agg(
        F.max("error").alias("error"),
        F.count_if(is_accepted()).alias("accepted"),
        F.array_sort(F.collect_list(rejection)).alias("rejected"),
    )
    status = (
        F.when(F.col("error").isNotNull(), "error")
        .when(F.col("accepted") > 0, "ok")
        .otherwise("rejected")
    )
    return counted.select("batch_id", "error", status.alias("status"), "accepted", "rejected")
