"""Aggregates, shares and rounding shared by the operators.

Averages are rounded to 6 places and shares to 1 place.
"""

from pyspark.sql import functions as F

AVERAGE_PLACES = 6
NOISE_PLACES = 9


def rows():
    return F.count(F.lit(1))


def tally(condition):
    """Rows that meet the condition: 0 if none does, NULL for no rows at all."""
    return F.sum(F.when(condition, 1).otherwise(0))


def tally_label(column, label):
    return tally(F.col(column) == label)


def tally_urgent():
    return tally(F.col("urgency").isin("critical", "high"))


def rounded_mean(mean):
    """An average to 6 places, the same whatever order its doubles were added in.

    The first rounding removes the noise of the last digits, so an average on
    the edge between two results always falls the same way.
    """
    return F.round(F.round(mean, NOISE_PLACES), AVERAGE_PLACES)


def mean_score(column="sentiment_score"):
    return rounded_mean(F.avg(column))


def or_zero(value):
    return F.coalesce(value, F.lit(0))


def percent(part, total):
    """100 * part / total, unrounded; 0 when the total is 0."""
    return F.when(total > 0, or_zero(part) * 100.0 / total).otherwise(0.0)


def sentiment_percent(avg_sentiment):
    """An average of -1..1 as a whole percentage of 0..100."""
    return F.round((avg_sentiment + 1) / 2 * 100, 0)


def sentiment_class(avg_sentiment):
    """Above 0.2 positive, below -0.2 negative, else neutral."""
    return (
        F.when(avg_sentiment > 0.2, "positive")
        .when(avg_sentiment < -0.2, "negative")
        .otherwise("neutral")
    )


def label_percentage(count, total):
    return F.round(count * 100.0 / total, 1)


def to_day(created_at):
    """The calendar day of a time held as text; NULL for text that is no time."""
    return F.to_date(created_at.try_cast("timestamp_ntz"))


def day_of(created_at):
    """The calendar day of a timestamp column."""
    return F.to_date(created_at)


def cutoff(as_of, days, like):
    """The moment ``days`` days before ``as_of``, in the type of the column ``like``."""
    return F.lit(str(as_of)).cast(like) - F.make_interval(days=F.lit(days))


def short_date(day):
    """``Jan 5``."""
    return F.date_format(day, "MMM d")
