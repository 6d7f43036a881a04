"""Schemas and fixed values of the log data model."""

from pyspark.sql import types as T

# Part of the public contract, so they must not change.
LEVELS = ("debug", "info", "warn", "error")
MAX_BODY_BYTES = 10 * 1024 * 1024
FUTURE_TOLERANCE_MINUTES = 5
DEFAULT_LIMIT = 100
MAX_LIMIT = 1000
BUCKET_SECONDS = {"1m": 60, "5m": 300, "1h": 3600, "1d": 86400}
GROUP_COLUMNS = ("service", "level")
SEED_DAYS_BACK = 3
SEED_DAYS_AHEAD = 4
ROLL_DAYS_AHEAD = 3
DEFAULT_RETENTION_DAYS = 30
DEFAULT_DAY = "default"

# Reasons a whole batch is refused.
MALFORMED_BODY = "malformed JSON in request body"
BODY_TOO_LARGE = "request body exceeds size limit"
BAD_ENVELOPE = "request body must be an object with a 'logs' array"
STORE_FAILED = "internal error while storing logs"

# Fixed value: what a caller is told when a page or counts cannot be read.
READ_FAILED = "database query unavailable, please retry"

# Reasons a single entry is refused, in the order they are tested.
NOT_AN_OBJECT = "entry must be an object"
TIMESTAMP_MISSING = "timestamp is required"
TIMESTAMP_NOT_STRING = "timestamp must be a string"
TIMESTAMP_INVALID = "invalid timestamp: '"
TIMESTAMP_IN_FUTURE = "timestamp must not be more than five minutes in the future"
LEVEL_MISSING = "level is required"
LEVEL_INVALID = "invalid level: '"
SERVICE_BLANK = "service is required and must be a non-empty string"
MESSAGE_BLANK = "message is required and must be a non-empty string"
ATTRIBUTES_NOT_FLAT = (
    "attributes must be a flat object with string, number, or boolean values"
)

LOGS = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("level", T.StringType()),
        T.StructField("service", T.StringType()),
        T.StructField("message", T.StringType()),
        T.StructField("attributes", T.VariantType()),
        T.StructField("log_day", T.StringType()),
        T.StructField("ingest_epoch", T.LongType()),
    ]
)

REJECTED_ENTRY = T.StructType(
    [
        T.StructField("index", T.IntegerType()),
        T.StructField("reason", T.StringType()),
    ]
)

LEDGER = T.StructType(
    [
        T.StructField("batch_id", T.StringType()),
        T.StructField("error", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("accepted", T.LongType()),
        T.StructField("rejected", T.ArrayType(REJECTED_ENTRY)),
        T.StructField("ingest_epoch", T.LongType()),
    ]
)

MINUTE_COUNTS = T.StructType(
    [
        T.StructField("minute", T.TimestampType()),
        T.StructField("service", T.StringType()),
        T.StructField("level", T.StringType()),
        T.StructField("count", T.LongType()),
        T.StructField("log_day", T.StringType()),
        T.StructField("ingest_epoch", T.LongType()),
    ]
)
