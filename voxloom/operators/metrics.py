"""Dashboard aggregates over the single-label and the multi-label table.

Each one is a partial and a final aggregate: before the shuffle a task holds
one row per label, so a label with most of the rows is no hot spot.
"""

from pyspark.sql import functions as F

from voxloom.functions.measures import (
    mean_score,
    rows,
    tally_label,
    tally_urgent,
)
from voxloom.operators.by_day import feedback_day, latest_days
from voxloom.operators.filters import analyzed_only, recent_days, themed
from voxloom.operators.topk import largest_first, latest_k_dates_ascending
from voxloom.schema import UNCATEGORIZED, URGENCIES


def overview_stats(feedback):
    """One row of totals over analyzed feedback; sums are NULL when there is none."""
    return analyzed_only(feedback).agg(
        rows().alias("total_feedback"),
        tally_label("sentiment", "positive").alias("positive"),
        tally_label("sentiment", "neutral").alias("neutral"),
        tally_label("sentiment", "negative").alias("negative"),
        tally_label("urgency", "critical").alias("critical_count"),
        tally_label("urgency", "high").alias("high_count"),
        mean_score().alias("avg_sentiment"),
    )


def themes_needing_attention(feedback, limit=5):
    """Themes with most urgent rows."""
    return (
        themed(feedback)
        .groupBy("theme")
        .agg(
            rows().alias("count"),
            mean_score().alias("avg_sentiment"),
            tally_urgent().alias("urgent_count"),
        )
        .orderBy(F.desc("urgent_count"), *largest_first("theme"))
        .limit(limit)
    )


def counts_by(feedback, column):
    return feedback.groupBy(column).agg(rows().alias("count"))


def channel_counts(feedback):
    """Rows per channel, pending rows included."""
    return counts_by(feedback, "channel").orderBy(*largest_first("channel"))


def top_theme(feedback):
    """The most discussed theme."""
    return (
        themed(feedback)
        .groupBy("theme")
        .agg(
            rows().alias("count"),
            mean_score().alias("avg_sentiment"),
            tally_label("sentiment", "positive").alias("positive"),
            tally_label("sentiment", "negative").alias("negative"),
            tally_urgent().alias("urgent_count"),
        )
        .orderBy(*largest_first("theme"))
        .limit(1)
    )


def sentiment_distribution(feedback):
    return counts_by(analyzed_only(feedback), "sentiment")


def urgency_distribution(feedback):
    return counts_by(analyzed_only(feedback), "urgency")


def value_distribution(feedback):
    return counts_by(analyzed_only(feedback), "value_score")


def theme_distribution(feedback):
    return counts_by(themed(feedback), "theme").orderBy(*largest_first("theme"))


def all_distributions(feedback):
    """The four distributions in one scan, as (dimension, label, count).

    Rows are first counted per combination of labels; the grouping sets then
    expand those few counts instead of every row.
    """
    columns = ["sentiment", "urgency", "value_score", "theme"]
    cells = analyzed_only(feedback).groupBy(*columns).agg(rows().alias("cell"))
    # A grouping id has a 0 bit for each column that takes part in the set.
    sets = {7: "sentiment", 11: "urgency", 13: "value", 14: "theme"}
    dimension = F.create_map(*[F.lit(x) for pair in sets.items() for x in pair])
    counted = cells.groupingSets([[c] for c in columns], *columns).agg(
        F.grouping_id().alias("grouping"), F.sum("cell").alias("count")
    )
    return counted.select(
        dimension[F.col("grouping").cast("int")].alias("dimension"),
        F.coalesce(*columns).alias("label"),
        "count",
    ).filter((F.col("dimension") != "theme") | (F.col("label") != UNCATEGORIZED))


def theme_stats(feedback):
    """Totals per theme, largest theme first."""
    return (
        themed(feedback)
        .groupBy("theme")
        .agg(
            rows().alias("total"),
            tally_label("sentiment", "positive").alias("positive"),
            tally_label("sentiment", "negative").alias("negative"),
            tally_label("urgency", "critical").alias("critical"),
            tally_label("urgency", "high").alias("high"),
            mean_score().alias("avg_sentiment"),
        )
        .orderBy(F.desc("total"), "theme")
    )


def sentiment_trend(feedback, days=14):
    """Per-day totals of the latest ``days`` dates that have rows, ascending."""
    daily = (
        latest_days(analyzed_only(feedback), days)
        .groupBy(feedback_day(feedback).alias("date"))
        .agg(
            rows().alias("total"),
            mean_score().alias("avg_sentiment"),
            tally_label("sentiment", "positive").alias("positive"),
            tally_label("sentiment", "negative").alias("negative"),
        )
    )
    return latest_k_dates_ascending(daily, days)


def ordered_urgency(feedback):
    """Urgency counts in the fixed order critical to low; other labels drop out."""
    listed = ", ".join(f"('{name}', {place})" for place, name in enumerate(URGENCIES, 1))
    order = feedback.sparkSession.sql(f"SELECT * FROM VALUES {listed} AS t(urgency, ordinal)")
    counts = urgency_distribution(feedback)
    return counts.join(F.broadcast(order), "urgency").orderBy("ordinal")


def total_feedback(feedback):
    return feedback.agg(rows().alias("count"))


def sentiment_label_counts(feedback):
    return counts_by(feedback, "sentiment_label")


def priority_counts(feedback):
    return counts_by(feedback, "priority")


def lookup_with_default(priorities, priority="high"):
    """The count of one priority, 0 if the counts do not list it."""
    found = F.max(F.when(F.col("priority") == priority, F.col("count")))
    return priorities.agg(F.coalesce(found, F.lit(0)).alias("urgent_count"))


def weekly_avg_trend(feedback, as_of, days=7):
    """Average score per day over the last days, ascending; pending rows count too."""
    return (
        recent_days(feedback, as_of, days)
        .groupBy(feedback_day(feedback).alias("date"))
        .agg(mean_score().alias("avg_sentiment"))
        .orderBy("date")
    )
