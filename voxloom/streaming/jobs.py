"""Keeping the daily rollup current, and ingesting feedback as it arrives."""

import json

from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxloom.operators.enrich import ingest_enriched
from voxloom.operators.filters import analyzed_only
from voxloom.operators.rollup import (
    dedupe_daily,
    rollup_measures,
    rollup_parts,
    rollup_theme,
    sum_of_parts,
    sums_of_parts,
)
from voxloom.schema import DAILY_METRICS, DAILY_METRICS_KEY, RECORD_REQUIRED
from voxloom.session import path_exists, remove_folder, stored
from voxloom.sources.batches import stored_ids
from voxloom.sources.daily import as_parts, finish_change, merge_parts, scan_stored
from voxloom.sources.ingest import number_rows, split_required
from voxloom.sources.ledger import claim_ids, largest_id, ledger_path

SECONDS_PER_DAY = 86400
BATCH = [T.StructField("run", T.StringType()), T.StructField("batch_id", T.LongType())]
BATCH_KEY = ["run", "batch_id"]
COUNTERS = [f for f in DAILY_METRICS if f.dataType == T.LongType()]
KEY = [f for f in DAILY_METRICS if f.name in DAILY_METRICS_KEY]
PARTS = T.StructType(
    [
        *KEY,
        *COUNTERS,
        T.StructField("score_sum", T.DoubleType()),
        T.StructField("score_count", T.LongType()),
    ]
)
COVERS = T.StructType([*BATCH, T.StructField("base", T.StringType())])


def run_id(spark, checkpoint):
    """The id that a stream keeps in its checkpoint, through restarts."""
    return json.loads(spark.read.text(f"{checkpoint}/metadata").first()[0])["id"]


def batch_folder(log_path, run, batch_id):
    return f"{log_path}/run={run}/batch_id={batch_id}"


def log_batches(stream, log_path, checkpoint, prepare, trigger):
    """Write what ``prepare`` makes of each batch to the batch's own folder of a log.

    A batch that runs again after a failure rewrites its folder with the same
    rows, and no batch touches what others wrote, so losing an executor or the
    driver half-way leaves the log right. Another checkpoint is another run with
    folders of its own.
    """

    def write_batch(batch, batch_id):
        run = run_id(batch.sparkSession, checkpoint)
        prepare(batch).write.mode("overwrite").parquet(batch_folder(log_path, run, batch_id))

    return (
        stream.foreachBatch(write_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def stream_daily_rollup(feedback, log_path, checkpoint, **trigger):
    """Log what each batch adds to the daily rollup; ``current_rollup`` sums it up.

    Batches only add, so there is no state to keep and no row comes too late.
    """
    return log_batches(feedback.writeStream, log_path, checkpoint, rollup_parts, trigger)


def rows_or_none(spark, schema, path):
    """A Parquet table that may not be there yet."""
    if path_exists(spark, path):
        return spark.read.schema(schema).parquet(path)
    return no_rows(spark, schema)


def no_rows(spark, schema):
    """An empty table that Spark knows to be empty, so that a join with it moves no row."""
    nulls = [F.lit(None).cast(f.dataType).alias(f.name) for f in schema]
    return spark.range(0).select(*nulls).filter(F.lit(False))


def published(spark, log_path):
    """The batches whose rows the daily metrics table already holds."""
    return rows_or_none(spark, T.StructType(BATCH), f"{log_path}.published").distinct()


def mark_published(batches, log_path):
    batches.select(*BATCH_KEY).write.mode("append").parquet(f"{log_path}.published")


def parts_log(spark, log_path):
    """All logged parts that count: not those folded into a base, nor an unfinished base."""
    return not_folded(rows_or_none(spark, T.StructType([*PARTS, *BATCH]), log_path), log_path)


def folded(spark, log_path):
    """The batches that are folded, and the base each is in."""
    return rows_or_none(spark, COVERS, f"{log_path}.covers")


def not_folded(rows, log_path):
    """Rows of batches that are not folded into a base, and of finished bases."""
    covers = folded(rows.sparkSession, log_path)
    bases = covers.select(F.col("base").alias("run")).distinct()
    is_base = F.col("run").startswith("base-")
    counted = rows.join(covers.select(*BATCH_KEY).distinct(), BATCH_KEY, "left_anti")
    return counted.filter(~is_base).unionByName(
        counted.filter(is_base).join(bases, "run", "left_semi").select(*counted.columns)
    )


def current_rollup(spark, log_path):
    """The daily rollup of all batches logged so far."""
    return sum_of_parts(parts_log(spark, log_path))


def log_loaded(feedback, log_path, name):
    """Tell the log about rows whose counts were loaded into the table by batch.

    Doing it again under the same name replaces what the name stood for.
    """
    spark = feedback.sparkSession
    parts = rollup_parts(feedback)
    parts.write.mode("overwrite").parquet(batch_folder(log_path, f"loaded-{name}", 0))
    mark_published(one_batch(spark, f"loaded-{name}"), log_path)


def one_batch(spark, run, batch_id=0):
    return spark.createDataFrame([(run, batch_id)], T.StructType(BATCH))


def unpublished(spark, log_path):
    """Logged parts of batches that are not in the daily metrics table yet."""
    return parts_log(spark, log_path).join(published(spark, log_path), BATCH_KEY, "left_anti")


def publish_rollup(spark, log_path, table_path):
    """Add the batches not yet published to the daily metrics table.

    Only their days are read and replaced. What the table holds for these days stays
    counted, whoever put it there: a batch adds to it. Running it again after a
    failure at any point does the rest. One writer of the table at a time.
    """
    finish_change(spark, table_path)
    log = unpublished(spark, log_path)
    fresh = stored(log.select(*BATCH_KEY).distinct(), "fresh")
    if fresh.isEmpty():
        return
    dated = log.join(fresh, BATCH_KEY, "left_semi").filter(F.col("metric_date").isNotNull())
    merge_parts(dated.drop(*BATCH_KEY), table_path, log=log_path, batches=fresh)


def live_parts(spark, log_path, table_path):
    """Parts of the daily rollup as of now: the table, what it lacks yet, and undated rows.

    Reads the rollup and its log, no feedback. Rows without a date are in the log only.
    """
    logged = unpublished(spark, log_path).filter(F.col("metric_date").isNotNull())
    undated = parts_log(spark, log_path).filter(F.col("metric_date").isNull())
    rows = as_parts(scan_stored(spark, table_path))
    for part in [logged, undated]:
        rows = rows.unionByName(part.select(*rows.columns))
    return sums_of_parts(rows)


def fold(batches, base, log_path):
    """Have a base that is written stand for some batches, and remove their folders."""
    spark = batches.sparkSession
    batches.withColumn("base", F.lit(base)).write.mode("append").parquet(f"{log_path}.covers")
    # The folders' names, not their rows.
    for run, batch_id in batches.toLocalIterator():
        remove_folder(spark, batch_folder(log_path, run, batch_id))


def compact_log(spark, log_path):
    """Fold all published batches of a log into one, and remove their folders.

    The new base counts from the moment its list of batches is written. Not
    while ``publish_rollup`` runs; the stream may go on.
    """
    done = published(spark, log_path)
    log = parts_log(spark, log_path)
    batches = stored(log.select(*BATCH_KEY).distinct().join(done, BATCH_KEY, "left_semi"), "fold")
    number = done.filter(F.col("run").startswith("base-")).select("run").distinct().count()
    base = f"base-{number}"
    parts = log.join(batches, BATCH_KEY, "left_semi").drop(*BATCH_KEY)
    sums_of_parts(parts).write.mode("overwrite").parquet(batch_folder(log_path, base, 0))
    mark_published(one_batch(spark, base), log_path)
    fold(batches, base, log_path)


def as_utc(created_at):
    """A zone-less timestamp as the instant it names in UTC, in any session zone."""
    return F.concat(created_at.cast("string"), F.lit("Z")).cast("timestamp")


def utc_date(instant):
    return F.date_from_unix_date(F.floor(F.unix_seconds(instant) / SECONDS_PER_DAY).cast("int"))


def rollup_updates(feedback, delay=None):
    """The rollup of a feedback stream, as rows that replace earlier ones."""
    rows = analyzed_only(feedback).withColumn("event_time", as_utc(F.col("created_at")))
    if delay:
        rows = rows.withWatermark("event_time", delay)
    return (
        rows.groupBy(F.window("event_time", "1 day").alias("day"), rollup_theme())
        .agg(*rollup_measures())
        .withColumn("metric_date", utc_date(F.col("day.start")))
        .select(*DAILY_METRICS.names)
    )


def stream_rollup_updates(feedback, log_path, checkpoint, delay=None, **trigger):
    """Log the whole new row of each date and theme a batch changed.

    For consumers that want finished rows as they change. The state keeps one row
    per date and theme, so no row comes too late. With a ``delay`` a watermark
    bounds the state and rows later than that are not counted.
    """
    updates = rollup_updates(feedback, delay).writeStream.outputMode("update")
    return log_batches(updates, log_path, checkpoint, lambda changed: changed, trigger)


def latest_updates(spark, log_path, run=None):
    """The newest logged row of each date and theme, of the only run or the one named."""
    log = spark.read.schema(T.StructType([*DAILY_METRICS, *BATCH])).parquet(log_path)
    runs = [run] if run else [row["run"] for row in log.select("run").distinct().take(2)]
    if len(runs) > 1:
        raise ValueError("the log holds several runs; name one")
    return dedupe_daily(log.filter(F.col("run").isin(runs)).drop("run"), "batch_id")


def stream_ingest(records, path, checkpoint, enrich=ingest_enriched, **trigger):
    """Label and store records as they arrive; rows without text or source are set aside.

    One query reads each batch once and writes it to a folder of its own, accepted
    and refused rows side by side; a batch that runs again rewrites it. Another
    checkpoint is another run with folders of its own. Accepted rows without an
    ``id`` get the next numbers of the table's ledger; a batch that runs again gets
    the same ones, and stored rows are read only when a ledger begins beside an
    older table. ``ingested`` and ``refused`` read the table.
    """

    def write_batch(batch, batch_id):
        spark, run = batch.sparkSession, run_id(batch.sparkSession, checkpoint)
        batch = batch.persist()
        accepted, rejected = split_required(batch, RECORD_REQUIRED, nonblank=["text"])
        if "id" not in batch.columns:
            first = claim_ids(
                spark, ledger_path(path), run, batch_id, accepted.count(),
                lambda: largest_id(stored_ids(spark, path)),
            )
            accepted = number_rows(accepted, first)
        tagged = enrich(accepted).withColumns(
            {"missing": F.array().cast("array<string>"), "accepted": F.lit(True)}
        ).unionByName(rejected.withColumn("accepted", F.lit(False)), allowMissingColumns=True)
        folder = batch_folder(path, run, batch_id)
        tagged.write.mode("overwrite").partitionBy("accepted").parquet(folder)
        batch.unpersist()

    return (
        records.writeStream.foreachBatch(write_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def ingested(spark, path):
    """Accepted rows of ``stream_ingest``."""
    return stored_batches(spark, path, "true").drop("missing")


def refused(spark, path):
    """Refused rows of ``stream_ingest`` with what they lack."""
    return stored_batches(spark, path, "false")


def stored_batches(spark, path, accepted):
    rows = not_folded(spark.read.parquet(path), path).filter(F.col("accepted") == accepted)
    return rows.drop("accepted", *BATCH_KEY)


def compact_ingested(spark, path):
    """Fold the batches of ``stream_ingest``, but each run's newest, into one folder.

    A base counts from the moment its list of batches is written, so readers see every
    row once. The streams may go on. One folding at a time.
    """
    rows = not_folded(spark.read.parquet(path), path)
    batches = rows.select(*BATCH_KEY).distinct()
    newest = batches.filter(~F.col("run").startswith("base-")).groupBy("run").agg(
        F.max("batch_id").alias("batch_id")
    )
    old = stored(batches.join(newest, BATCH_KEY, "left_anti"), "fold")
    if old.isEmpty():
        return
    number = folded(spark, path).select("base").distinct().count()
    whole = rows.join(old, BATCH_KEY, "left_semi").drop(*BATCH_KEY)
    writer = whole.hint("rebalance", "accepted").write.mode("overwrite").partitionBy("accepted")
    writer.parquet(batch_folder(path, f"base-{number}", 0))
    fold(old, f"base-{number}", path)
