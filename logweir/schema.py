"""Record layouts and the limits fixed by the log API contract."""

from __future__ import annotations

from pyspark.sql import types as T

# Fixed values of the log API contract.
LOG_LEVELS = ("debug", "info", "warn", "error")
MAX_LOGS_PER_BATCH = 5_000
MAX_FUTURE_MS = 300_000
DEFAULT_LIMIT = 100
MAX_LIMIT = 1_000
BUCKET_SECONDS = {"1m": 60, "5m": 300, "1h": 3_600, "1d": 86_400}
GROUP_COLUMNS = ("service", "level")

REQUEST = T.StructType(
    [
        T.StructField("request_seq", T.LongType(), False),
        T.StructField("body", T.StringType(), True),
    ]
)

LOG = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("level", T.StringType()),
        T.StructField("service", T.StringType()),
        T.StructField("message", T.StringType()),
        T.StructField("attributes", T.VariantType()),
        T.StructField("attributes_search", T.MapType(T.StringType(), T.StringType())),
    ]
)

ROLLUP = T.StructType(
    [
        T.StructField("minute", T.TimestampType()),
        T.StructField("service", T.StringType()),
        T.StructField("level", T.StringType()),
        T.StructField("count", T.LongType()),
    ]
)

REJECT = T.StructType(
    [
        T.StructField("request_seq", T.LongType()),
        T.StructField("entry_index", T.IntegerType()),
        T.StructField("reason", T.StringType()),
        T.StructField("raw", T.StringType()),
    ]
)

REPORT = T.StructType(
    [
        T.StructField("request_seq", T.LongType()),
        T.StructField("status", T.StringType()),
        T.StructField("accepted", T.LongType()),
        T.StructField(
            "rejected",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("index", T.IntegerType()),
                        T.StructField("reason", T.StringType()),
                    ]
                )
            ),
        ),
        T.StructField("error", T.StringType()),
    ]
)
