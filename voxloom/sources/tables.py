"""Scans, sinks and the layout of stored tables."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxloom.functions.json_text import parse_label_array, strict_variant
from voxloom.functions.measures import day_of
from voxloom.schema import DAILY_METRICS, FEEDBACK, MULTILABEL
from voxloom.sources.daily import load_rollup, overwrite_dates

DAY = T.StructField("created_date", T.DateType())
FEEDBACK_BY_DAY = T.StructType([*FEEDBACK, DAY])
MULTILABEL_BY_DAY = T.StructType([*MULTILABEL, DAY])
#: Names one of the texts that stand beside a table; its rows hold it in place of the text.
TEXT_ID = T.StructField("text_id", T.LongType())
SHARED_TEXTS = T.StructType([TEXT_ID, T.StructField("text", T.StringType())])


def scan_feedback(spark, path, by_day=False, shared_texts=False):
    """The single-label table; one that ``write_by_day`` stored also has ``created_date``.

    With ``shared_texts`` the texts that ``write_shared_texts`` stored are joined on.
    """
    if shared_texts:
        return scan_shared(spark, path, FEEDBACK_BY_DAY if by_day else FEEDBACK, "content")
    if by_day:
        return spark.read.schema(FEEDBACK_BY_DAY).parquet(path)
    # Named batches have folders of their own.
    whole = spark.read.schema(FEEDBACK).option("recursiveFileLookup", "true")
    return whole.parquet(path).select(*FEEDBACK.names)


def scan_multilabel(spark, path, by_day=False, shared_texts=False):
    """The multi-label table, its labels also as an array."""
    schema = MULTILABEL_BY_DAY if by_day else MULTILABEL
    if shared_texts:
        return with_label_array(scan_shared(spark, path, schema, "text"))
    return with_label_array(spark.read.schema(schema).parquet(path))


def scan_shared(spark, path, schema, column):
    """A table whose rows hold ``text_id`` in place of ``column``, with the texts joined on.

    A query's filters and choice of columns apply below the join: texts are read only
    where it puts them out, and what is shuffled for it are the narrow rows left and the
    texts as stored, never a row with its text.
    """
    narrow = T.StructType([*[f for f in schema if f.name != column], TEXT_ID])
    rows = spark.read.schema(narrow).option("recursiveFileLookup", "created_date" not in schema.names)
    texts = spark.read.schema(SHARED_TEXTS).parquet(texts_path(path))
    return with_shared_texts(rows.parquet(path), texts, column).select(*schema.names)


def with_shared_texts(rows, texts, column):
    """Put the text that ``text_id`` names in ``column``; rows without one are left out."""
    named = texts.select("text_id", F.col("text").alias(column))
    return rows.join(named, "text_id").drop("text_id")


def texts_path(table_path):
    return f"{table_path.rstrip('/')}.texts"


def write_shared_texts(texts, path):
    """Store texts (``text_id``, ``text``) beside the table whose rows name them.

    A text stands there once, however many rows name it, and is not moved when rows are
    sorted into days or along a curve.
    """
    texts.select(*SHARED_TEXTS.names).write.mode("append").parquet(texts_path(path))


def with_label_array(multilabel):
    return multilabel.withColumn("labels", parse_label_array(F.col("themes")))


def scan_daily_metrics(spark, path):
    return spark.read.schema(DAILY_METRICS).parquet(path).select(*DAILY_METRICS.names)


def select_all(feedback):
    return feedback.select("*")


def select_content(feedback):
    return feedback.select("content")


def append_table(rows, path):
    rows.write.mode("append").parquet(path)


def write_by_day(feedback, path, order=("theme", "sentiment", "channel")):
    """Store feedback in one folder per day, sorted for min/max pruning.

    The rebalance hint gives each day files of a sensible size: it splits a
    day with very many rows and joins small ones.
    """
    (
        feedback.withColumn("created_date", day_of(F.col("created_at")))
        .hint("rebalance", "created_date")
        .sortWithinPartitions("created_date", *order)
        .write.mode("append")
        .partitionBy("created_date")
        .parquet(path)
    )


def write_documents(documents, path):
    """Nested result documents as JSON lines; NULL fields are written out."""
    documents.write.mode("append").option("ignoreNullFields", "false").json(path)


def read_payloads(spark, path, schema):
    """JSON-lines request payloads."""
    return spark.read.schema(schema).json(path)


def parse_payload(rows, column, schema):
    """Add the fields of a JSON payload column; all NULL where it is no valid JSON object."""
    parsed = rows.withColumn("_payload", strict_variant(F.col(column)))
    fields = [
        F.try_variant_get("_payload", f"$[0].{f.name}", f.dataType.simpleString()).alias(f.name)
        for f in schema
    ]
    return parsed.select(*rows.columns, *fields)
