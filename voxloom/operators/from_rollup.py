"""Dashboard aggregates answered from the daily rollup instead of the feedback.

Each takes parts of the rollup, one row per date and theme with score sums
(``live_parts`` gives those of the table and the log as of now), and gives what the
operator of the same name in ``metrics`` gives over the feedback. The rollup names three
sentiments and four urgencies: rows with any other label, or none, are told
together as ``(other)`` by the distributions and count in all totals. It does not
hold value scores, channels or pending rows.
"""

from pyspark.sql import functions as F

from voxloom.functions.measures import rounded_mean
from voxloom.operators.rollup import ROLLUP_URGENCIES
from voxloom.operators.topk import largest_first, latest_k_dates_ascending
from voxloom.schema import SENTIMENTS, UNCATEGORIZED, URGENT

OTHER = "(other)"


def average():
    return rounded_mean(F.try_divide(F.sum("score_sum"), F.sum("score_count")))


def total(column="total_count"):
    return F.sum(column)


def urgent_total():
    return sum(total(f"urgency_{name}") for name in URGENT)


def of_themes(parts):
    return parts.filter(F.col("theme") != UNCATEGORIZED)


def overview_stats(parts):
    """One row of totals; sums are NULL when there is nothing."""
    return parts.agg(
        F.coalesce(total(), F.lit(0)).alias("total_feedback"),
        *[total(f"{name}_count").alias(name) for name in SENTIMENTS],
        *[total(f"urgency_{name}").alias(f"{name}_count") for name in URGENT],
        average().alias("avg_sentiment"),
    )


def distribution(parts, column, counters):
    """Counts by label, of the named labels and of all others together."""
    sums = parts.agg(total().alias("all"), *[total(c).alias(c) for c in counters.values()])
    others = F.col("all") - sum(F.col(c) for c in counters.values())
    pairs = [(F.lit(label), F.col(c)) for label, c in counters.items()] + [(F.lit(OTHER), others)]
    rows = F.array(*[F.struct(label.alias(column), n.alias("count")) for label, n in pairs])
    return sums.select(F.inline(rows)).filter(F.col("count") > 0)


def sentiment_distribution(parts):
    return distribution(parts, "sentiment", {name: f"{name}_count" for name in SENTIMENTS})


def urgency_distribution(parts):
    return distribution(parts, "urgency", {name: f"urgency_{name}" for name in ROLLUP_URGENCIES})


def theme_distribution(parts):
    counted = of_themes(parts).groupBy("theme").agg(total().alias("count"))
    return counted.orderBy(*largest_first("theme"))


def theme_stats(parts):
    """Totals per theme, largest theme first."""
    return (
        of_themes(parts)
        .groupBy("theme")
        .agg(
            total().alias("total"),
            *[total(f"{name}_count").alias(name) for name in ["positive", "negative"]],
            *[total(f"urgency_{name}").alias(name) for name in URGENT],
            average().alias("avg_sentiment"),
        )
        .orderBy(F.desc("total"), "theme")
    )


def themes_needing_attention(parts, limit=5):
    """Themes with most urgent rows."""
    return (
        of_themes(parts)
        .groupBy("theme")
        .agg(
            total().alias("count"),
            average().alias("avg_sentiment"),
            urgent_total().alias("urgent_count"),
        )
        .orderBy(F.desc("urgent_count"), *largest_first("theme"))
        .limit(limit)
    )


def top_theme(parts):
    """The most discussed theme."""
    return (
        of_themes(parts)
        .groupBy("theme")
        .agg(
            total().alias("count"),
            average().alias("avg_sentiment"),
            *[total(f"{name}_count").alias(name) for name in ["positive", "negative"]],
            urgent_total().alias("urgent_count"),
        )
        .orderBy(*largest_first("theme"))
        .limit(1)
    )


def sentiment_trend(parts, days=14):
    """Per-day totals of the latest ``days`` dates that have rows, ascending."""
    daily = parts.groupBy(F.col("metric_date").alias("date")).agg(
        total().alias("total"),
        average().alias("avg_sentiment"),
        *[total(f"{name}_count").alias(name) for name in ["positive", "negative"]],
    )
    return latest_k_dates_ascending(daily, days)


def theme_trend(parts, theme, days=14):
    """Per-day totals of one theme on the latest ``days`` dates that have rows of it."""
    daily = (
        parts.filter(F.col("theme") == theme)
        .groupBy(F.col("metric_date").alias("date"))
        .agg(
            total().alias("count"),
            average().alias("avg_sentiment"),
            *[total(f"{name}_count").alias(name) for name in SENTIMENTS],
        )
    )
    return latest_k_dates_ascending(daily, days)
