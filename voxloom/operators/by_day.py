"""Tables laid out by day, whose partition column is ``created_date``."""

from pyspark.sql import functions as F

from voxloom.functions.measures import day_of


def is_by_day(feedback):
    return "created_date" in feedback.columns


def feedback_day(feedback):
    """The partition column of a table laid out by day, else the day of the timestamp."""
    return F.col("created_date") if is_by_day(feedback) else day_of(F.col("created_at"))


def latest_days(feedback, k):
    """The rows of the ``k`` latest days that have rows, or more of them.

    A table laid out by day tells them by a narrow pass and opens their folders
    only; any other table is returned whole.
    """
    if not is_by_day(feedback):
        return feedback
    days = feedback.select("created_date").distinct()
    latest = days.orderBy(F.desc_nulls_last("created_date")).limit(k)
    return on_days(feedback, latest, "created_date")


def on_days(feedback, days, column):
    """Rows of the days in a column of ``days``, and those without a day.

    The days become a scalar before the scan starts, so Spark opens their
    folders only. The calendar bounds them at 3.7 million values of 4 bytes.
    """
    wanted = days.agg(F.collect_set(column)).scalar()
    day = F.col("created_date")
    return feedback.filter(F.array_contains(wanted, day) | day.isNull())
