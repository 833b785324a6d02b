"""The stored daily metrics: one row per date and theme, whatever is loaded and how often.

Beside its mean a stored row holds the sum and the number of its scores, so rows can
be added to it exactly. A load or a publication is a change of some days: the days'
new rows are written aside, the ledger is told, the days are replaced, and the ledger is
told that they are. A change that broke off is finished by whoever comes next, and
finishing it twice is finishing it once.
"""

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxloom.operators.rollup import guessed_scores, mean_of_parts, sums_of_parts
from voxloom.schema import DAILY_METRICS, DAILY_METRICS_REQUIRED
from voxloom.session import path_exists, remove_folder, stored
from voxloom.sources.ingest import split_required
from voxloom.sources.ledger import (
    change_state,
    finish_batch,
    finished_batch,
    ledger_path,
    read_state,
)

SCORES = [T.StructField("score_sum", T.DoubleType()), T.StructField("score_count", T.LongType())]
#: A row as it is stored.
STORED_DAILY = T.StructType([*DAILY_METRICS, *SCORES])
PART_COLUMNS = [c for c in STORED_DAILY.names if c != "avg_sentiment_score"]


def scan_stored(spark, path):
    """Stored rows with their score sums and counts (NULL where a row never had them)."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], STORED_DAILY)
    return spark.read.schema(STORED_DAILY).parquet(path).select(*STORED_DAILY.names)


def as_parts(rollup):
    """Rollup rows as parts that add up: exact where they hold score sums and counts.

    Of a row without these the mean stands for as many scores as it has rows.
    """
    for field in SCORES:
        if field.name not in rollup.columns:
            rollup = rollup.withColumn(field.name, F.lit(None).cast(field.dataType))
    if "avg_sentiment_score" not in rollup.columns:
        return rollup.select(*PART_COLUMNS)
    known = F.col("score_count").isNotNull()
    guess = guessed_scores()
    return rollup.withColumns(
        {name: F.when(known, F.col(name)).otherwise(guess[name]) for name in guess}
    ).select(*PART_COLUMNS)


def as_stored(parts):
    """Parts, one row per date and theme, as stored rows."""
    return parts.withColumn("avg_sentiment_score", mean_of_parts()).select(*STORED_DAILY.names)


def write_days(rows, path):
    """Replace the folders of the days that occur in stored rows."""
    (
        rows.hint("rebalance", "metric_date")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("metric_date")
        .parquet(path)
    )


def merge_parts(parts, path, name=None, log=None, batches=None):
    """Add parts to the stored rows of their dates and themes.

    A change under a ``name`` is made once. ``batches`` of a ``log`` are marked as
    published with the change. Parts need a date and a theme.
    """
    spark = parts.sparkSession
    finish_change(spark, path)
    if name is not None and finished_batch(spark, path, name) is not None:
        return
    change = f"{path.rstrip('/')}.change/{uuid.uuid4().hex}"
    fresh = stored(sums_of_parts(parts.select(*PART_COLUMNS)), "fresh")
    days = fresh.select("metric_date").distinct().agg(F.collect_set("metric_date"))
    # Calendar days: 3.7 million at most.
    held = scan_stored(spark, path).filter(F.array_contains(days.scalar(), F.col("metric_date")))
    merged = as_stored(sums_of_parts(fresh.unionByName(as_parts(held))))
    merged.write.parquet(f"{change}/days")
    if batches is not None:
        batches.write.parquet(f"{change}/batches")

    def begin(state):
        if state.get("change"):
            raise RuntimeError(f"somebody else changes {path}; one writer at a time")
        return state | {"change": {"folder": change, "name": name, "log": log}}

    change_state(spark, ledger_path(path), begin)
    finish_change(spark, path)


def finish_change(spark, path):
    """Do what is left of a change that the ledger knows; nothing if there is none."""
    change = read_state(spark, ledger_path(path))[1].get("change")
    if not change:
        return
    write_days(spark.read.schema(STORED_DAILY).parquet(f"{change['folder']}/days"), path)
    if change["log"]:
        batches = spark.read.parquet(f"{change['folder']}/batches")
        batches.write.mode("append").parquet(f"{change['log']}.published")
    if change["name"] is not None:
        finish_batch(spark, path, change["name"])

    def end(state):
        return {k: v for k, v in state.items() if k != "change"} if "change" in state else None

    change_state(spark, ledger_path(path), end)
    remove_folder(spark, change["folder"])


def load_rollup(rollup, path, name=None):
    """Add rollup rows to the stored ones, one folder per date.

    Rows of a date and theme that the table, or the load, already has are added to
    it, so the key stays unique. Rows with ``score_sum`` and ``score_count`` (as
    ``rollup_parts`` gives them) add exactly. A load under a ``name`` counts once,
    however often it runs; one without counts each time. Gives back the rows that
    lack a date or theme.
    """
    accepted, rejected = split_required(rollup, DAILY_METRICS_REQUIRED)
    merge_parts(as_parts(accepted), path, name)
    return rejected


def overwrite_dates(rollup, path, dates=None):
    """Replace the dates that occur in ``rollup`` and leave the others alone.

    Of the ``dates`` (``metric_date``) given, those without a row are emptied.
    Running it again after a failure does the rest. Gives back the rows that
    lack a date or theme.
    """
    spark = rollup.sparkSession
    finish_change(spark, path)
    accepted, rejected = split_required(rollup, DAILY_METRICS_REQUIRED)
    rows = as_stored(sums_of_parts(as_parts(accepted)))
    if dates is not None:
        rows = stored(rows, "rollup")
    write_days(rows, path)
    if dates is not None:
        known = dates.select("metric_date").filter(F.col("metric_date").isNotNull()).distinct()
        emptied = known.join(rows, "metric_date", "left_anti")
        # Calendar days: 3.7 million at most.
        for (day,) in emptied.collect():
            remove_folder(spark, f"{path}/metric_date={day}")
    return rejected

