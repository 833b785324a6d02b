"""Themes held as a JSON array per row.

Rows are counted per raw text first, so each distinct text is parsed once and
the arrays are expanded after the aggregation, not before.
"""

from pyspark.sql import functions as F

from voxloom.functions.json_text import parse_label_array
from voxloom.functions.measures import label_percentage, rounded_mean, rows
from voxloom.operators.by_day import feedback_day
from voxloom.operators.filters import theme_substring
from voxloom.operators.topk import checked_limit, day_of_nth_newest, largest_first, newest_n
from voxloom.session import stored


def themes_text_counts(feedback):
    """Rows per raw themes text, most frequent first."""
    return feedback.groupBy("themes").agg(rows().alias("count")).orderBy(*largest_first("themes"))


def exploded_labels(per_text):
    """One row per label of each themes text; a repeated label repeats."""
    labels = F.explode(parse_label_array(F.col("themes"))).alias("theme")
    return per_text.select(labels, *[c for c in per_text.columns if c != "themes"])


def share_of_total(counts, counted):
    """Add each count's share of all rows of ``counted``, which may exceed their sum."""
    total = counted.agg(rows()).scalar()
    return counts.withColumn("percentage", label_percentage(F.col("count"), total))


def multilabel_theme_stats(feedback):
    """Rows per label and their share of all rows, most frequent first."""
    per_text = feedback.groupBy("themes").agg(rows().alias("count"))
    counts = exploded_labels(per_text).groupBy("theme").agg(F.sum("count").alias("count"))
    return share_of_total(counts, feedback).orderBy(*largest_first("theme"))


def multilabel_avg_sentiment(feedback):
    """Average score per label."""
    per_text = feedback.groupBy("themes").agg(
        F.sum("sentiment_score").alias("score_sum"),
        F.count("sentiment_score").alias("score_count"),
    )
    sums = exploded_labels(per_text).groupBy("theme").agg(
        F.sum("score_sum").alias("score_sum"), F.sum("score_count").alias("score_count")
    )
    mean = F.try_divide("score_sum", "score_count")
    return sums.select("theme", rounded_mean(mean).alias("avg_sentiment"))


def theme_match_total(feedback, term, limit=20):
    """The newest rows whose themes contain the term, beside the count of all such rows.

    One narrow pass counts the matches per day, which tells both their total and
    the days that the newest ones are of.
    """
    matches = theme_substring(feedback, term)
    limit = checked_limit(limit)
    day = feedback_day(matches)
    days = stored(matches.groupBy(day.alias("day")).agg(rows().alias("count")), "days")
    total = days.agg(F.coalesce(F.sum("count"), F.lit(0))).scalar()
    recent = matches.filter((day >= day_of_nth_newest(days, limit)) | day.isNull())
    return newest_n(recent, limit, narrow_first=False).withColumn("total_count", total)
