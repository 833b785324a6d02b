"""Getting batches of rows ready for a table."""

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from voxloom.functions.labels import is_nonblank
from voxloom.operators.enrich import ingest_enriched, utc_now
from voxloom.schema import FEEDBACK, FEEDBACK_DEFAULTS, FEEDBACK_REQUIRED, RECORD_REQUIRED

#: Ids that ``monotonically_increasing_id`` sets aside for each partition.
PER_PARTITION = 1 << 33


def apply_defaults(batch):
    """Give a batch the feedback columns it lacks; explicit NULLs stay NULL.

    Required columns have no default: a batch without them is NULL there, and
    ``split_required`` sets its rows aside.
    """
    for column in FEEDBACK:
        if column.name in batch.columns or column.name == "id":
            continue
        if column.name == "created_at":
            value = utc_now()
        else:
            value = F.lit(FEEDBACK_DEFAULTS.get(column.name)).cast(column.dataType)
        batch = batch.withColumn(column.name, value)
    return batch


def append_batches(batches, columns=FEEDBACK_REQUIRED):
    """(accepted, rejected) rows of several batches, with the defaults for what each lacks."""
    whole = reduce(
        lambda left, right: left.unionByName(right, allowMissingColumns=True),
        [apply_defaults(batch) for batch in batches],
    )
    return split_required(whole, columns)


def with_missing(rows, columns=FEEDBACK_REQUIRED, nonblank=()):
    """Add the names of the required columns that are NULL, or blank where that counts."""
    names = F.array(*[F.when(lacks(c, nonblank), F.lit(c)) for c in columns])
    return rows.withColumn("missing", F.array_compact(names))


def lacks(column, nonblank=()):
    return ~is_nonblank(F.col(column)) if column in nonblank else F.col(column).isNull()


def split_required(rows, columns=FEEDBACK_REQUIRED, nonblank=()):
    """(accepted, rejected): rows with and without all required columns.

    A table with NOT NULL columns would refuse the whole batch; here the bad
    rows are set aside, with what they lack in ``missing``. Columns in
    ``nonblank`` must hold more than white space.
    """
    lacking = reduce(lambda a, b: a | b, [lacks(c, nonblank) for c in columns])
    return rows.filter(~lacking), with_missing(rows.filter(lacking), columns, nonblank)


def ingest_records(records, table, enrich=ingest_enriched):
    """(accepted, rejected) records: labelled with an id above the table's, or set aside.

    A record needs a source, and a text that is not blank. One that has an
    ``id`` keeps it.
    """
    accepted, rejected = split_required(records, RECORD_REQUIRED, nonblank=["text"])
    if "id" not in accepted.columns:
        # Before a model is asked, which would be asked again for the count.
        accepted = assign_ids(accepted, table)
    return enrich(accepted), rejected


def assign_ids(batch, table):
    """Give a batch the ids after the largest of the table, without a gap and in order."""
    return number_rows(batch, table.agg(F.coalesce(F.max("id"), F.lit(0))).scalar() + 1)


def number_rows(batch, first, column="id"):
    """Number a batch from ``first`` on, without a gap and in order.

    The batch should come straight from a scan: its rows are counted per
    partition in a first pass, and the counts, one per partition, place the
    numbers of the second. Nothing is shuffled.
    """
    part = F.spark_partition_id()
    counts = batch.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_rows"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    ahead = counts.select(
        F.col("_part").alias("_of"),
        F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_ahead"),
    )
    numbered = batch.withColumns(
        {"_part": part, "_place": F.monotonically_increasing_id() % PER_PARTITION}
    )
    placed = numbered.join(F.broadcast(ahead), F.col("_part") == F.col("_of"))
    number = first + F.col("_ahead") + F.col("_place")
    return placed.withColumn(column, number).drop("_part", "_place", "_of", "_ahead")
