"""What the dashboard shows per theme and per day, as added columns."""

from pyspark.sql import functions as F

from voxloom.functions.labels import (
    theme_display_name,
    urgency_badge,
    urgency_badge_legacy,
    urgency_class_legacy,
)
from voxloom.functions.measures import or_zero, percent, sentiment_class, sentiment_percent


def with_sentiment_percent(stats):
    return stats.withColumn("sentiment_percent", sentiment_percent(F.col("avg_sentiment")))


def with_sentiment_class(stats):
    return stats.withColumn("sentiment_class", sentiment_class(F.col("avg_sentiment")))


def with_theme_names(stats):
    return stats.withColumn("display_name", theme_display_name(F.col("theme")))


def with_shares(days, neutral, total):
    """Shares of a day's rows and the net of positive and negative, to 1 place."""
    positive = percent(F.col("positive"), total)
    negative = percent(F.col("negative"), total)
    return days.withColumns(
        {
            "pct_positive": F.round(positive, 1),
            "pct_neutral": F.round(percent(neutral, total), 1),
            "pct_negative": F.round(negative, 1),
            "net_sentiment": F.round(positive - negative, 1),
        }
    )


def trend_shares(trend):
    """Shares of all rows: whatever is not positive or negative counts as neutral."""
    total = F.col("total")
    neutral = total - or_zero(F.col("positive")) - or_zero(F.col("negative"))
    return with_shares(trend, neutral, total)


def theme_trend_shares(trend):
    """Shares of the rows labelled positive, neutral or negative; others are left out."""
    parts = [or_zero(F.col(s)) for s in ["positive", "neutral", "negative"]]
    return with_shares(trend, F.col("neutral"), parts[0] + parts[1] + parts[2])


def sentiment_bar(stats):
    """Whole-number widths that add up to 100."""
    total = F.when(F.col("total") > 0, F.col("total")).otherwise(1)
    positive = F.round(percent(F.col("positive"), total), 0)
    negative = F.round(percent(F.col("negative"), total), 0)
    return stats.withColumns(
        {
            "positive_width": positive,
            "neutral_width": 100 - positive - negative,
            "negative_width": negative,
        }
    )


def with_urgency_badge(stats):
    return stats.withColumn("badge", urgency_badge(F.col("critical"), F.col("high")))


def with_urgency_badge_legacy(stats):
    return stats.withColumns(
        {
            "badge": urgency_badge_legacy(F.col("critical")),
            "urgency_class": urgency_class_legacy(F.col("critical"), F.col("high")),
        }
    )


def volume_trend(trend):
    """The older chart: scaled score and volume per day."""
    scaled = sentiment_percent(F.col("avg_sentiment"))
    return trend.select("date", scaled.alias("sentiment_percent"), F.col("total").alias("volume"))
