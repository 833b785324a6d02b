"""Newest rows, top rows per group, and ranks of short lists.

Ties in ``created_at`` are broken by the larger id, ties in counts by the
label, so every list is the same on each run.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F

from voxloom.functions.labels import urgency_rank
from voxloom.operators.by_day import is_by_day, on_days

SALTS = 256


def newest_first():
    return [F.desc_nulls_last("created_at"), F.desc("id")]


def most_urgent_first():
    return [urgency_rank(F.col("urgency")).asc(), *newest_first()]


def largest_first(label):
    return [F.desc("count"), F.asc_nulls_last(label)]


def checked_limit(limit):
    limit = int(limit)
    if limit < 0:
        raise ValueError("limit must not be negative")
    return limit


def newest_n(rows, n=50, narrow_first=True):
    """The ``n`` newest rows, newest first.

    ``narrow_first`` finds the time of the n-th newest row before wide rows are
    read; without it one pass sorts whole rows, which suits narrow tables.
    """
    n = checked_limit(n)
    if narrow_first:
        rows = since_nth_newest(rows, n)
    return rows.orderBy(*newest_first()).limit(n)


def newest_folders(rows, n):
    """Rows of the newest days that together have ``n`` rows, and those without a day.

    Rows are counted per day, which reads no column but those of earlier filters.
    """
    days = rows.groupBy(F.col("created_date").alias("day")).count()
    day = F.col("created_date")
    return rows.filter((day >= day_of_nth_newest(days, n)) | day.isNull())


def day_of_nth_newest(days, n):
    """The day of the n-th newest row, from rows (``day``, ``count``), as a scalar."""
    newer = Window.orderBy(F.desc("day")).rowsBetween(Window.unboundedPreceding, -1)
    ahead = F.coalesce(F.sum("count").over(newer), F.lit(0))
    known = days.filter(F.col("day").isNotNull()).withColumn("_ahead", ahead)
    return known.filter(F.col("_ahead") < n).agg(F.min("day")).scalar()


def since_nth_newest(rows, n):
    """The rows that are no older than the n-th newest one, and those without a time.

    The first pass reads the time and the filtered columns only. The second
    one then hands on hardly more than n wide rows instead of n per task. On a
    table laid out by day both open the newest folders alone.
    """
    if is_by_day(rows):
        rows = newest_folders(rows, n)
    times = rows.select("created_at").orderBy(F.desc_nulls_last("created_at")).limit(n)
    oldest = F.min("created_at")
    created_at = F.col("created_at")
    return rows.filter((created_at >= times.agg(oldest).scalar()) | created_at.isNull())


def fetch_rows(table, chosen):
    """The whole rows of a table for chosen ids, with what ``chosen`` adds to them.

    ``chosen`` should be ``stored``: its true size then decides on a broadcast.
    The IN comes first because Spark moves it down to the scan, below whatever
    the table's columns are computed from; a join would stay above. A table
    laid out by day opens the folders of the chosen rows only.
    """
    added = [c for c in chosen.columns if c not in table.columns]
    if is_by_day(table) and is_by_day(chosen):
        table = on_days(table, chosen, "created_date")
    rows = table.filter(F.col("id").isin(chosen.select("id")))
    return rows.join(chosen.select("id", *added), "id")


def top_k_per_group(rows, keys, order, k, rank="rank"):
    """The first ``k`` rows of each group in the given order, with their rank.

    Each task keeps k rows per group, a group's survivors are then cut to k
    once per salt and once more per group, so that no task meets a large group
    whole, however its rows are spread over the keys.
    """
    salted = rows.withColumn("_salt", F.spark_partition_id() % SALTS)
    per_salt = Window.partitionBy(*keys, "_salt").orderBy(*order)
    survivors = (
        salted.withColumn("_place", F.row_number().over(per_salt))
        .filter(F.col("_place") <= k)
        .drop("_salt", "_place")
    )
    return first_k_of_groups(survivors, keys, order, k, rank)


def first_k_of_groups(rows, keys, order, k, rank="rank"):
    """``top_k_per_group`` for rows that are few per group, such as aggregates."""
    per_group = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn(rank, F.row_number().over(per_group)).filter(F.col(rank) <= k)


def ranked(top_rows, *order, rank="rank"):
    """Number the rows of a list that a limit has already made short."""
    return top_rows.withColumn(rank, F.row_number().over(Window.orderBy(*order)))


def latest_k_dates_ascending(days, k=14):
    """The ``k`` latest dates that have rows, earliest of them first."""
    return days.orderBy(F.desc_nulls_last("date")).limit(k).orderBy(F.asc_nulls_first("date"))


def display_head(ordered, n):
    """The first ``n`` rows of an ordered list."""
    return ordered.limit(checked_limit(n))
