"""Table schemas and the fixed values that define the event format."""

from pyspark.sql import types as T

# --- fixed values: event types, topics, wire fields, column limits ---------------

VIEW = "VIEW"
CLICK = "CLICK"
PURCHASE = "PURCHASE"

MAIN_TOPIC = "product-events"
CLICK_TOPIC = "product-clicks"
PURCHASE_TOPIC = "product-purchases"
TOPICS = (MAIN_TOPIC, CLICK_TOPIC, PURCHASE_TOPIC)

WIRE_SCHEMA = T.StructType(
    [
        T.StructField("event_id", T.StringType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("product_id", T.StringType()),
        T.StructField("product_name", T.StringType()),
        T.StructField("product_category", T.StringType()),
        T.StructField("product_price", T.DoubleType()),
        T.StructField("user_id", T.StringType()),
        T.StructField("location", T.StringType()),
        T.StructField("session_id", T.StringType()),
        T.StructField("timestamp", T.StringType()),
    ]
)

# Longest text each column may hold.
TEXT_LIMITS = {
    "event_id": 36,
    "event_type": 20,
    "product_id": 50,
    "product_name": 200,
    "product_category": 100,
    "user_id": 50,
    "location": 100,
    "session_id": 36,
    "kafka_topic": 100,
}
REQUIRED = ("event_id", "event_type", "created_at")

# --- stored types ----------------------------------------------------------------

PRICE = T.DecimalType(10, 2)
REVENUE = T.DecimalType(20, 2)

KAFKA_SCHEMA = T.StructType(
    [
        T.StructField("key", T.StringType()),
        T.StructField("value", T.StringType()),
        T.StructField("topic", T.StringType()),
        T.StructField("partition", T.IntegerType()),
        T.StructField("offset", T.LongType()),
    ]
)

RAW_EVENTS = T.StructType(
    [
        T.StructField("event_id", T.StringType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("product_id", T.StringType()),
        T.StructField("product_name", T.StringType()),
        T.StructField("product_category", T.StringType()),
        T.StructField("product_price", PRICE),
        T.StructField("user_id", T.StringType()),
        T.StructField("location", T.StringType()),
        T.StructField("session_id", T.StringType()),
        T.StructField("created_at", T.TimestampNTZType()),
        T.StructField("kafka_offset", T.LongType()),
        T.StructField("kafka_partition", T.IntegerType()),
        T.StructField("kafka_topic", T.StringType()),
    ]
)

# A rejected message keeps its text and its position in the log.
REJECTED_EVENTS = T.StructType(
    [
        T.StructField("raw_value", T.StringType()),
        T.StructField("reject_reason", T.StringType()),
        T.StructField("kafka_offset", T.LongType()),
        T.StructField("kafka_partition", T.IntegerType()),
        T.StructField("kafka_topic", T.StringType()),
    ]
)

# Counters that add up; everything else in a metric row is derived from them.
COUNTERS = ("total_events", "total_views", "total_clicks", "total_purchases")
METRIC_KEYS = ("metric_date", "product_id")

PRODUCT_METRICS = T.StructType(
    [
        T.StructField("metric_date", T.DateType()),
        T.StructField("product_id", T.StringType()),
        T.StructField("product_name", T.StringType()),
        T.StructField("category", T.StringType()),
        T.StructField("total_events", T.LongType()),
        T.StructField("total_views", T.LongType()),
        T.StructField("total_clicks", T.LongType()),
        T.StructField("total_purchases", T.LongType()),
        T.StructField("total_revenue", REVENUE),
        T.StructField("click_through_rate", T.DecimalType(18, 4)),
        T.StructField("conversion_rate", T.DecimalType(18, 4)),
        T.StructField("updated_at", T.TimestampNTZType()),
    ]
)

FUNNEL_METRICS = T.StructType(
    [
        T.StructField("metric_date", T.DateType()),
        T.StructField("total_views", T.LongType()),
        T.StructField("total_clicks", T.LongType()),
        T.StructField("total_purchases", T.LongType()),
        T.StructField("view_to_click_pct", T.DecimalType(18, 2)),
        T.StructField("click_to_purchase_pct", T.DecimalType(18, 2)),
        T.StructField("overall_conversion_pct", T.DecimalType(18, 2)),
        T.StructField("updated_at", T.TimestampNTZType()),
    ]
)

JOB_RUNS = T.StructType(
    [
        T.StructField("run_id", T.StringType()),
        T.StructField("dag_id", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("started_at", T.TimestampNTZType()),
        T.StructField("finished_at", T.TimestampNTZType()),
        T.StructField("records_processed", T.LongType()),
        T.StructField("error_message", T.StringType()),
        T.StructField("batch_id", T.LongType()),
    ]
)

TOPIC_STATS = T.StructType(
    [
        T.StructField("topic_name", T.StringType()),
        T.StructField("message_count", T.LongType()),
        T.StructField("last_offset", T.LongType()),
        T.StructField("offset_span", T.LongType()),
        T.StructField("recorded_at", T.TimestampNTZType()),
    ]
)

TOPIC_COUNTS = T.StructType(
    [
        T.StructField("kafka_topic", T.StringType()),
        T.StructField("kafka_partition", T.IntegerType()),
        T.StructField("messages", T.LongType()),
        T.StructField("first_offset", T.LongType()),
        T.StructField("last_offset", T.LongType()),
    ]
)

# Arrivals per window; counts of several batches add up.
WINDOW_COUNTS = T.StructType(
    [
        T.StructField("seconds", T.IntegerType()),
        T.StructField("window_start", T.TimestampNTZType()),
        T.StructField("total_events", T.LongType()),
        T.StructField("views", T.LongType()),
        T.StructField("clicks", T.LongType()),
        T.StructField("purchases", T.LongType()),
    ]
)

# All-time measures of a product under one name.
PRODUCT_TOTALS = T.StructType(
    [
        T.StructField("product_id", T.StringType()),
        T.StructField("product_name", T.StringType()),
        T.StructField("product_category", T.StringType()),
        *[T.StructField(name, T.LongType()) for name in COUNTERS],
        T.StructField("total_revenue", REVENUE),
    ]
)
