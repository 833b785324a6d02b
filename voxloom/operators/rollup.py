"""The daily metrics table: one row per date and theme."""

from pyspark.sql import functions as F

from voxloom.functions.measures import mean_score, rounded_mean, rows, tally_label
from voxloom.operators.by_day import feedback_day, is_by_day, on_days
from voxloom.operators.filters import analyzed_only
from voxloom.schema import DAILY_METRICS, DAILY_METRICS_KEY, UNCATEGORIZED

ROLLUP_URGENCIES = ["low", "medium", "high", "critical"]
COUNTERS = [c for c in DAILY_METRICS.names if c.endswith("_count") or c.startswith("urgency")]


def rollup_counters():
    return [
        rows().alias("total_count"),
        *[
            tally_label("sentiment", name).alias(f"{name}_count")
            for name in ["positive", "neutral", "negative"]
        ],
        *[tally_label("urgency", name).alias(f"urgency_{name}") for name in ROLLUP_URGENCIES],
    ]


def rollup_measures():
    return [*rollup_counters(), mean_score().alias("avg_sentiment_score")]


def rollup_theme():
    """The theme of a rollup row, which is never NULL."""
    return F.coalesce("theme", F.lit(UNCATEGORIZED)).alias("theme")


def by_date_and_theme(feedback):
    day = feedback_day(feedback).alias("metric_date")
    return analyzed_only(feedback).groupBy(day, rollup_theme())


def daily_rollup(feedback):
    """Metrics per date and theme, computed from analyzed feedback."""
    return by_date_and_theme(feedback).agg(*rollup_measures())


def rollup_parts(feedback):
    """What some of the rows add to the rollup: counters, score sum and score count."""
    return by_date_and_theme(feedback).agg(
        *rollup_counters(),
        F.sum("sentiment_score").alias("score_sum"),
        F.count("sentiment_score").alias("score_count"),
    )


def mean_of_parts():
    """The average score of one row of parts."""
    return rounded_mean(F.try_divide("score_sum", "score_count"))


def sum_of_parts(parts):
    """The rollup that parts of the rows add up to."""
    whole = sums_of_parts(parts).withColumn("avg_sentiment_score", mean_of_parts())
    return whole.select(*DAILY_METRICS.names)


def sums_of_parts(parts):
    """Parts of the rows put together: still parts."""
    sums = [*COUNTERS, "score_sum", "score_count"]
    return parts.groupBy(*DAILY_METRICS_KEY).agg(*[F.sum(c).alias(c) for c in sums])


def guessed_scores():
    """Score sum and count of a rollup row that holds its mean only, as near as the mean tells."""
    scored = F.when(F.col("avg_sentiment_score").isNotNull(), F.col("total_count")).otherwise(0)
    return {"score_sum": F.col("avg_sentiment_score") * scored, "score_count": scored}


def dedupe_daily(rollup, version):
    """One row per date and theme: the one with the greatest ``version``."""
    values = [c for c in rollup.columns if c not in [*DAILY_METRICS_KEY, version]]
    latest = F.max_by(F.struct(*values), F.col(version))
    return (
        rollup.groupBy(*DAILY_METRICS_KEY)
        .agg(latest.alias("latest"))
        .select(*DAILY_METRICS_KEY, "latest.*")
    )


def touched_dates(new_rows):
    """The distinct days of the rows that came in."""
    return new_rows.select(feedback_day(new_rows).alias("metric_date")).distinct()


def rollup_of_dates(feedback, dates, measure=daily_rollup):
    """The rollup of the given days, recomputed from all their rows.

    With ``rollup_parts`` for ``measure`` it can be added to exactly later on.

    A table laid out by day opens the folders of these days only. In any other
    table the days are broadcast; the calendar bounds distinct days at 3.7
    million values of 4 bytes.
    """
    days = dates.select("metric_date").distinct()
    if is_by_day(feedback):
        dated = feedback.filter(F.col("created_date").isNotNull())
        return measure(on_days(dated, days, "metric_date"))
    return measure(feedback.filter(feedback_day(feedback).isin(F.broadcast(days))))
