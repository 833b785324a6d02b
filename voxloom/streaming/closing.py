"""A rollup stream with a delay: days that are closed for good, and rows that came after.

Every batch notes in a ledger how far event time had come before it: the latest row
of all earlier batches of its run, less the delay. Rows of days that were closed by
then are late and go to a side log; the others go to the log of the rollup. A batch
that runs again finds its own note and parts its rows the same way. Closed days never
change again, and nothing is lost: closed, open and late parts add up to all rows.
"""

from pyspark.sql import functions as F

from voxloom.operators.by_day import feedback_day
from voxloom.operators.filters import analyzed_only
from voxloom.operators.rollup import rollup_parts, sum_of_parts
from voxloom.sources.ledger import change_state, ledger_path, read_state
from voxloom.streaming.jobs import batch_folder, parts_log, run_id


def late_path(log_path):
    return f"{log_path}.late"


def latest_day(rows):
    """The latest day of some rows as days since 1970; None if none has a day."""
    return rows.agg(F.max(F.unix_date(feedback_day(rows)))).first()[0]


def note_batch(spark, path, run, batch, latest, delay):
    """The first day still open before a batch (None: all are), noted with its latest day."""

    def change(state):
        notes = state.setdefault("runs", {})
        held = notes.get(run)
        if held and held["batch"] == batch:
            return None
        if held and held["batch"] > batch:
            raise ValueError(f"batch {batch} of {run} comes after batch {held['batch']}")
        seen = held["seen"] if held else None
        before = held["open"] if held else None
        if seen is not None:
            before = seen - delay if before is None else max(before, seen - delay)
        days = [day for day in (seen, latest) if day is not None]
        notes[run] = {"batch": batch, "open": before, "seen": max(days, default=None)}
        return state

    return change_state(spark, path, change)["runs"][run]["open"]


def stream_closing_rollup(feedback, log_path, checkpoint, delay_days=1, **trigger):
    """Log what each batch adds to open days, and beside it what comes too late.

    A day is closed once a row of an earlier batch lies more than ``delay_days`` after
    it. Rows without a day are never late.
    """

    def write_batch(batch, batch_id):
        spark, run = batch.sparkSession, run_id(batch.sparkSession, checkpoint)
        rows = analyzed_only(batch).persist()
        first_open = note_batch(
            spark, ledger_path(log_path), run, batch_id, latest_day(rows), delay_days
        )
        day = F.unix_date(feedback_day(rows))
        late = F.coalesce(day < F.lit(first_open).cast("int"), F.lit(False))
        for path, part in [(log_path, rows.filter(~late)), (late_path(log_path), rows.filter(late))]:
            folder = batch_folder(path, run, batch_id)
            rollup_parts(part).write.mode("overwrite").parquet(folder)
        rows.unpersist()

    return (
        feedback.writeStream.foreachBatch(write_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def first_open_day(spark, log_path, delay_days=1):
    """The first day to which rows may still be added, over all runs; NULL before any closed."""
    runs = read_state(spark, ledger_path(log_path))[1].get("runs", {}).values()
    opened = [
        max(day for day in (run["open"], run["seen"] - delay_days) if day is not None)
        for run in runs if run["seen"] is not None
    ]
    # A run that has seen no day yet may still begin anywhere.
    if not opened or len(opened) < len(runs):
        return F.lit(None).cast("date")
    return F.date_from_unix_date(F.lit(min(opened)))


def closed_rollup(spark, log_path, delay_days=1):
    """The rollup of closed days without their late rows: rows that stay as they are."""
    first = first_open_day(spark, log_path, delay_days)
    return sum_of_parts(parts_log(spark, log_path).filter(F.col("metric_date") < first))


def open_rollup(spark, log_path, delay_days=1):
    """The rollup of the days still open, and of rows without a day."""
    first = first_open_day(spark, log_path, delay_days)
    closed = F.coalesce(F.col("metric_date") < first, F.lit(False))
    return sum_of_parts(parts_log(spark, log_path).filter(~closed))


def late_parts(spark, log_path):
    """What late rows would add to closed days; ``load_rollup`` takes them."""
    return parts_log(spark, late_path(log_path))


def complete_rollup(spark, log_path):
    """Closed, open and late rows together."""
    return sum_of_parts(
        parts_log(spark, log_path).unionByName(late_parts(spark, log_path))
    )
