"""Column layouts, value domains and text conventions shared by the whole package."""

from __future__ import annotations

from pyspark.sql import types as T

ORDERS = "orders"
ORDER_EVENTS = "order_events"

# Lifecycle event types, order states, rule severities and run modes.
ORDER_CREATED = "order_created"
PAYMENT_CONFIRMED = "payment_confirmed"
ORDER_SHIPPED = "order_shipped"
ORDER_CANCELLED = "order_cancelled"
EVENT_TYPES = (ORDER_CREATED, PAYMENT_CONFIRMED, ORDER_SHIPPED, ORDER_CANCELLED)

COMPLETED = "completed"
CANCELLED = "cancelled"
REFUNDED = "refunded"
ORDER_STATUSES = (COMPLETED, CANCELLED, REFUNDED)

CRITICAL = "critical"
WARNING = "warning"

DEV = "dev"
PROD = "prod"

# Texts that a pandas CSV reader takes as "missing" (exact match, untrimmed).
MISSING_TOKENS = (
    "",
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "<NA>",
    "N/A",
    "NA",
    "NULL",
    "NaN",
    "None",
    "n/a",
    "nan",
    "null",
)

# How a missing key cell is shown inside a text of sample keys.
MISSING_KEY_TEXT = "nan"

# Accepted timestamp texts: a day, optionally T or a space and a time to the minute, second or
# up to nine digits of it (cut to microseconds), optionally with a UTC offset: Z, +hh, +hhmm
# or +hh:mm. Without an offset the time is UTC.
COMMON_TIMESTAMP = r"^\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}:\d{2}$"
PLAIN_TIMESTAMP = r"^\d{4}-\d{2}-\d{2}([ T]\d{2}:\d{2}(:\d{2}(\.\d{1,9})?)?)?$"
OFFSET_TIMESTAMP = (
    r"^\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}(:\d{2}(\.\d{1,9})?)? ?(Z|[+-]\d{2}(:?\d{2})?)$"
)

# Key columns and the tables that have them, for measuring hot keys.
KEY_COLUMNS = {"order_id": (ORDERS, ORDER_EVENTS), "event_id": (ORDER_EVENTS,)}

RAW_ORDERS = T.StructType(
    [
        T.StructField("order_id", T.StringType()),
        T.StructField("customer_id", T.StringType()),
        T.StructField("order_created_at", T.StringType()),
        T.StructField("order_amount", T.DoubleType()),
        T.StructField("currency", T.StringType()),
        T.StructField("order_status", T.StringType()),
    ]
)

RAW_ORDER_EVENTS = T.StructType(
    [
        T.StructField("event_id", T.StringType()),
        T.StructField("order_id", T.StringType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("event_timestamp", T.StringType()),
        T.StructField("source_system", T.StringType()),
    ]
)

DQ_REPORT = T.StructType(
    [
        T.StructField("rule_id", T.StringType()),
        T.StructField("rule_name", T.StringType()),
        T.StructField("table_name", T.StringType()),
        T.StructField("severity", T.StringType()),
        T.StructField("failed_rows", T.LongType()),
        T.StructField("total_rows", T.LongType()),
        T.StructField("failure_rate", T.DoubleType()),
        T.StructField("sample_keys", T.StringType()),
    ]
)

DQ_FAILED_SAMPLES = T.StructType(
    [
        T.StructField("rule_id", T.StringType()),
        T.StructField("event_id", T.StringType()),
        T.StructField("order_id", T.StringType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("event_timestamp", T.StringType()),
        T.StructField("customer_id", T.StringType()),
        T.StructField("order_status", T.StringType()),
        T.StructField("order_amount", T.DoubleType()),
        T.StructField("order_created_at", T.StringType()),
    ]
)

SAMPLE_COLUMNS = tuple(f.name for f in DQ_FAILED_SAMPLES.fields if f.name != "rule_id")
