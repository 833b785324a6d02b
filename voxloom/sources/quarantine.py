"""Refused rows, stored with the reason and the batch they came in.

A batch has a folder of its own, so a batch that runs again replaces what it set
aside, and other batches stay as they are.
"""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxloom.functions.json_text import strict_variant
from voxloom.session import path_exists
from voxloom.sources.ledger import folder_name

QUARANTINE = T.StructType(
    [
        T.StructField("batch", T.StringType(), False),
        T.StructField("reason", T.StringType(), False),
        T.StructField("details", T.ArrayType(T.StringType()), False),
        T.StructField("record", T.StringType()),
    ]
)
#: Reasons: a line that is no JSON object, and a row without a required column.
UNREADABLE, MISSING = "unreadable", "missing"


def quarantine_path(table_path):
    return f"{table_path.rstrip('/')}.quarantine"


def missing_rows(rejected):
    """Rows from ``split_required`` as quarantine rows: the row as JSON, and what it lacks."""
    kept = [c for c in rejected.columns if c != "missing"]
    record = F.to_json(F.struct(*kept), {"ignoreNullFields": "false"})
    return rejected.select(
        F.lit(MISSING).alias("reason"), F.col("missing").alias("details"), record.alias("record")
    )


def unreadable_rows(lines):
    """Lines that hold no JSON object as quarantine rows: the text as it came."""
    return lines.select(
        F.lit(UNREADABLE).alias("reason"),
        F.array().cast("array<string>").alias("details"),
        F.col("value").alias("record"),
    )


def set_aside(rows, path, batch):
    """Store the quarantine rows of a batch, in place of any it had."""
    named = rows.withColumn("batch", F.lit(batch)).select(*QUARANTINE.names)
    named.write.mode("overwrite").parquet(f"{path}/from={folder_name(batch)}")


def quarantined(spark, path):
    """All quarantine rows, or those of none."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], QUARANTINE)
    return (
        spark.read.schema(QUARANTINE).option("recursiveFileLookup", "true").parquet(path)
        .select(*QUARANTINE.names)
    )


def split_lines(lines, schema):
    """(payloads, unreadable) of a column ``value`` of JSON lines.

    A line is readable if it is exactly one JSON object; blank lines are not. Fields
    of another type than the schema's are NULL. Every line is in one of the two.
    """
    parsed = lines.withColumn("_line", strict_variant(F.col("value")))
    is_object = F.coalesce(
        F.schema_of_variant(F.try_variant_get("_line", "$[0]", "variant")).startswith("OBJECT"),
        F.lit(False),
    )
    fields = [
        F.try_variant_get("_line", f"$[0].{f.name}", f.dataType.simpleString()).alias(f.name)
        for f in schema
    ]
    return parsed.filter(is_object).select(*fields), parsed.filter(~is_object).select("value")


def read_lines(spark, path):
    """Lines of text files as they are."""
    return spark.read.text(path)
