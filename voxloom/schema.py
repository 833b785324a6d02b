"""Table schemas, label domains and column defaults.

Feedback comes in two shapes: the single-label table (``FEEDBACK``) and the
multi-label table (``MULTILABEL``), where ``themes`` is a JSON array held as
text. ``DAILY_METRICS`` is the per-day, per-theme summary of the first one.

``created_at`` is a zone-less timestamp (it is written as UTC wall time), so
no operator depends on the session time zone. The label domains are
conventions only: any string can occur in a label column.
"""

from pyspark.sql import types as T

FEEDBACK = T.StructType(
    [
        T.StructField("id", T.LongType(), False),
        T.StructField("created_at", T.TimestampNTZType(), False),
        T.StructField("channel", T.StringType(), False),
        T.StructField("title", T.StringType(), True),
        T.StructField("content", T.StringType(), False),
        T.StructField("author", T.StringType(), True),
        T.StructField("sentiment", T.StringType(), True),
        T.StructField("sentiment_score", T.DoubleType(), True),
        T.StructField("theme", T.StringType(), True),
        T.StructField("urgency", T.StringType(), True),
        T.StructField("value_score", T.StringType(), True),
        T.StructField("analyzed", T.IntegerType(), True),
    ]
)

MULTILABEL = T.StructType(
    [
        T.StructField("id", T.LongType(), False),
        T.StructField("created_at", T.TimestampNTZType(), False),
        T.StructField("text", T.StringType(), True),
        T.StructField("source", T.StringType(), True),
        T.StructField("user_id", T.StringType(), True),
        T.StructField("sentiment_score", T.DoubleType(), True),
        T.StructField("sentiment_label", T.StringType(), True),
        T.StructField("themes", T.StringType(), True),
        T.StructField("priority", T.StringType(), True),
    ]
)

DAILY_METRICS = T.StructType(
    [
        T.StructField("metric_date", T.DateType(), False),
        T.StructField("theme", T.StringType(), False),
        T.StructField("total_count", T.LongType(), True),
        T.StructField("positive_count", T.LongType(), True),
        T.StructField("neutral_count", T.LongType(), True),
        T.StructField("negative_count", T.LongType(), True),
        T.StructField("urgency_low", T.LongType(), True),
        T.StructField("urgency_medium", T.LongType(), True),
        T.StructField("urgency_high", T.LongType(), True),
        T.StructField("urgency_critical", T.LongType(), True),
        T.StructField("avg_sentiment_score", T.DoubleType(), True),
    ]
)

# Payloads that arrive as JSON text.
CONTENT_PAYLOAD = T.StructType([T.StructField("content", T.StringType())])
SUMMARY_PAYLOAD = T.StructType(
    [
        T.StructField("feedbackTexts", T.ArrayType(T.StringType())),
        T.StructField("theme", T.StringType()),
    ]
)
RECORD_PAYLOAD = T.StructType(
    [
        T.StructField("text", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("user_id", T.StringType()),
    ]
)

# Label domains, column defaults and required columns.
SENTIMENTS = ["positive", "neutral", "negative"]
URGENCIES = ["critical", "high", "medium", "low"]
URGENT = ["critical", "high"]
THEMES = [
    "performance",
    "pricing",
    "documentation",
    "developer-experience",
    "reliability",
    "feature-request",
    "other",
]
UNCATEGORIZED = "uncategorized"
FEEDBACK_DEFAULTS = {
    "sentiment": "pending",
    "sentiment_score": 0.0,
    "theme": "uncategorized",
    "urgency": "low",
    "value_score": "medium",
    "analyzed": 0,
}
FEEDBACK_REQUIRED = ["channel", "content"]
RECORD_REQUIRED = ["text", "source"]
DAILY_METRICS_REQUIRED = ["metric_date", "theme"]
DAILY_METRICS_KEY = ["metric_date", "theme"]
