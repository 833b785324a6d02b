"""Queries over the single-label table: lists, counts, trends and derived columns."""

from pyspark.sql import functions as F

from verification import views
from verification.registry import in_output_order, registered
from voxloom.functions import labels, measures
from voxloom.operators import derive, filters, metrics, topk
from voxloom.operators.topk import largest_first, ranked
from voxloom.sources import tables

RANK = "CAST(row_number() OVER (ORDER BY {}) AS INTEGER) AS rank"


@registered("SELECT * FROM stored_feedback")
def scan_feedback(spark, sf_dir):
    return views.stored_feedback(spark, sf_dir)


@registered("SELECT * FROM feedback_text")
def select_all(spark, sf_dir):
    return tables.select_all(views.with_content(views.feedback(spark, sf_dir), spark, sf_dir))


@registered("SELECT content FROM feedback_text")
def select_content(spark, sf_dir):
    ids = views.feedback(spark, sf_dir).select("id")
    return tables.select_content(views.with_content(ids, spark, sf_dir))


@registered("SELECT * FROM stored_feedback WHERE analyzed = 1")
def analyzed_only(spark, sf_dir):
    return filters.analyzed_only(views.stored_feedback(spark, sf_dir))


@registered("SELECT * FROM stored_feedback WHERE theme <> 'uncategorized'")
def categorized_only(spark, sf_dir):
    return filters.categorized_only(views.stored_feedback(spark, sf_dir))


@registered(
    """
    WITH hit AS (SELECT * FROM stored_feedback WHERE analyzed = 1 AND sentiment = 'negative'
        AND theme = 'reliability' AND urgency = 'high'
      ORDER BY created_at DESC, id DESC LIMIT 50)
    SELECT *, CAST(row_number() OVER (ORDER BY created_at DESC, id DESC) AS INTEGER) AS rank
    FROM hit
    """
)
def facet_filter(spark, sf_dir):
    hit = filters.facet_filter(
        views.stored_feedback(spark, sf_dir),
        sentiment="negative",
        theme="reliability",
        urgency="high",
        channel="all",
    )
    return in_output_order(hit)


@registered("SELECT * FROM stored_feedback WHERE theme = 'pricing' AND analyzed = 1")
def theme_equals(spark, sf_dir):
    return filters.theme_equals(views.stored_feedback(spark, sf_dir), "pricing")


@registered(
    """
    SELECT * FROM stored_feedback
    WHERE created_at > TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 7 DAY
    """
)
def recent_days(spark, sf_dir):
    return filters.recent_days(views.stored_feedback(spark, sf_dir), views.AS_OF)


@registered("SELECT id, urgency, urgency IN ('critical', 'high') AS urgent FROM feedback")
def urgent_flag(spark, sf_dir):
    urgent = labels.is_urgent(F.col("urgency")).alias("urgent")
    return views.feedback(spark, sf_dir).select("id", "urgency", urgent)


@registered("SELECT id, content FROM feedback_text WHERE title IS NOT NULL")
def nonblank_text(spark, sf_dir):
    """Texts, of which those without a title are blanked: the given texts are never blank."""
    text = F.when(F.col("title").isNotNull(), F.col("content")).otherwise(" \t\u00a0\u3000")
    rows = views.stored_feedback(spark, sf_dir).select("id", text.alias("content"))
    return filters.nonblank_text(rows, "content")


@registered(
    """
    SELECT urgency, count(*) AS count,
      CAST(CASE urgency WHEN 'critical' THEN 1 WHEN 'high' THEN 2 WHEN 'medium' THEN 3
        ELSE 4 END AS INTEGER) AS ordinal
    FROM feedback WHERE analyzed = 1 AND urgency IN ('critical', 'high', 'medium', 'low')
    GROUP BY urgency
    """
)
def ordered_urgency(spark, sf_dir):
    return metrics.ordered_urgency(views.feedback(spark, sf_dir))


@registered(
    """
    SELECT count(*) AS total_feedback,
      count(*) FILTER (sentiment = 'positive') AS positive,
      count(*) FILTER (sentiment = 'neutral') AS neutral,
      count(*) FILTER (sentiment = 'negative') AS negative,
      count(*) FILTER (urgency = 'critical') AS critical_count,
      count(*) FILTER (urgency = 'high') AS high_count,
      round(round(avg(sentiment_score), 9), 6) AS avg_sentiment
    FROM feedback WHERE analyzed = 1
    """
)
def overview_stats(spark, sf_dir):
    return metrics.overview_stats(views.feedback(spark, sf_dir))


@registered(
    """
    WITH hit AS (SELECT theme, count(*) AS count,
        round(round(avg(sentiment_score), 9), 6) AS avg_sentiment,
        count(*) FILTER (urgency IN ('critical', 'high')) AS urgent_count
      FROM feedback WHERE analyzed = 1 AND theme <> 'uncategorized' GROUP BY theme)
    SELECT *, CAST(row_number() OVER (ORDER BY urgent_count DESC, count DESC, theme)
        AS INTEGER) AS rank
    FROM hit ORDER BY rank LIMIT 5
    """
)
def themes_needing_attention(spark, sf_dir):
    top = metrics.themes_needing_attention(views.feedback(spark, sf_dir))
    return ranked(top, F.desc("urgent_count"), *largest_first("theme"))


@registered(
    f"""
    SELECT channel, count(*) AS count, {RANK.format("count(*) DESC, channel")}
    FROM feedback GROUP BY channel
    """
)
def channel_counts(spark, sf_dir):
    return in_output_order(metrics.channel_counts(views.feedback(spark, sf_dir)))


@registered(
    """
    SELECT theme, count(*) AS count, round(round(avg(sentiment_score), 9), 6) AS avg_sentiment,
      count(*) FILTER (sentiment = 'positive') AS positive,
      count(*) FILTER (sentiment = 'negative') AS negative,
      count(*) FILTER (urgency IN ('critical', 'high')) AS urgent_count
    FROM feedback WHERE analyzed = 1 AND theme <> 'uncategorized' GROUP BY theme
    ORDER BY count DESC, theme LIMIT 1
    """
)
def top_theme(spark, sf_dir):
    return metrics.top_theme(views.feedback(spark, sf_dir))


@registered("SELECT sentiment, count(*) AS count FROM feedback WHERE analyzed = 1 GROUP BY 1")
def sentiment_distribution(spark, sf_dir):
    return metrics.sentiment_distribution(views.feedback(spark, sf_dir))


@registered("SELECT urgency, count(*) AS count FROM feedback WHERE analyzed = 1 GROUP BY 1")
def urgency_distribution(spark, sf_dir):
    return metrics.urgency_distribution(views.feedback(spark, sf_dir))


@registered("SELECT value_score, count(*) AS count FROM feedback WHERE analyzed = 1 GROUP BY 1")
def value_distribution(spark, sf_dir):
    return metrics.value_distribution(views.feedback(spark, sf_dir))


@registered(
    f"SELECT theme, total AS count, {RANK.format('total DESC, theme')} FROM theme_totals"
)
def theme_distribution(spark, sf_dir):
    return in_output_order(metrics.theme_distribution(views.feedback(spark, sf_dir)))


@registered(
    """
    SELECT 'sentiment' AS dimension, sentiment AS label, count(*) AS count
      FROM feedback WHERE analyzed = 1 GROUP BY sentiment
    UNION ALL SELECT 'urgency', urgency, count(*) FROM feedback WHERE analyzed = 1 GROUP BY urgency
    UNION ALL SELECT 'value', value_score, count(*)
      FROM feedback WHERE analyzed = 1 GROUP BY value_score
    UNION ALL SELECT 'theme', theme, total FROM theme_totals
    """
)
def all_distributions(spark, sf_dir):
    return metrics.all_distributions(views.feedback(spark, sf_dir))


@registered(f"SELECT *, {RANK.format('total DESC, theme')} FROM theme_totals")
def theme_stats(spark, sf_dir):
    return in_output_order(metrics.theme_stats(views.feedback(spark, sf_dir)))


@registered(f"SELECT *, {RANK.format('date')} FROM daily")
def sentiment_trend(spark, sf_dir):
    return in_output_order(metrics.sentiment_trend(views.stored_feedback(spark, sf_dir)))


@registered(
    """
    WITH hit AS (SELECT * FROM stored_feedback ORDER BY created_at DESC, id DESC LIMIT 50)
    SELECT *, CAST(row_number() OVER (ORDER BY created_at DESC, id DESC) AS INTEGER) AS rank
    FROM hit
    """
)
def newest_n(spark, sf_dir):
    return in_output_order(topk.newest_n(views.stored_feedback(spark, sf_dir), 50))


@registered(
    """
    SELECT date, count, CAST(row_number() OVER (ORDER BY date) AS INTEGER) AS rank
    FROM (SELECT CAST(created_at AS DATE) AS date, count(*) AS count FROM feedback
      GROUP BY 1 ORDER BY 1 DESC LIMIT 7)
    """
)
def latest_k_dates_ascending(spark, sf_dir):
    day = measures.day_of(F.col("created_at")).alias("date")
    daily = views.feedback(spark, sf_dir).groupBy(day).agg(measures.rows().alias("count"))
    return ranked(topk.latest_k_dates_ascending(daily, 7), F.asc("date"))


@registered(
    """
    SELECT id, CAST(created_at AS DATE) AS day,
      CASE WHEN title IS NOT NULL THEN CAST(created_at AS DATE) END AS parsed_day
    FROM feedback
    """
)
def to_day(spark, sf_dir):
    as_text = F.when(F.col("title").isNotNull(), F.col("created_at").cast("string")).otherwise("?")
    return views.feedback(spark, sf_dir).select(
        "id",
        measures.day_of(F.col("created_at")).alias("day"),
        measures.to_day(as_text).alias("parsed_day"),
    )


@registered(
    """
    SELECT id, created_at > TIMESTAMP '2024-01-24 00:00:00' AS recent,
      TIMESTAMP '2024-01-24 00:00:00' AS cutoff FROM feedback
    """
)
def cutoff(spark, sf_dir):
    moment = measures.cutoff(views.AS_OF, 7, "timestamp_ntz")
    return views.feedback(spark, sf_dir).select(
        "id", (F.col("created_at") > moment).alias("recent"), moment.alias("cutoff")
    )


@registered(
    """
    SELECT CASE urgency WHEN 'critical' THEN 1 WHEN 'high' THEN 2 WHEN 'medium' THEN 3
        ELSE 4 END AS urgency_rank,
      count(*) AS count, count(*) FILTER (sentiment = 'negative') AS negative
    FROM feedback GROUP BY 1
    """
)
def case_map(spark, sf_dir):
    rank = labels.urgency_rank(F.col("urgency")).alias("urgency_rank")
    return (
        views.feedback(spark, sf_dir)
        .groupBy(rank)
        .agg(
            measures.rows().alias("count"),
            measures.tally_label("sentiment", "negative").alias("negative"),
        )
    )


@registered(
    """
    SELECT theme, avg_sentiment, round((avg_sentiment + 1) / 2 * 100, 0) AS sentiment_percent
    FROM theme_totals
    """
)
def sentiment_percent(spark, sf_dir):
    stats = metrics.theme_stats(views.feedback(spark, sf_dir))
    return derive.with_sentiment_percent(stats.select("theme", "avg_sentiment"))


@registered(
    """
    SELECT CAST(created_at AS DATE) AS date, theme, round(round(avg(sentiment_score), 9), 6) AS avg_sentiment,
      CASE WHEN round(round(avg(sentiment_score), 9), 6) > 0.2 THEN 'positive'
        WHEN round(round(avg(sentiment_score), 9), 6) < -0.2 THEN 'negative'
        ELSE 'neutral' END AS sentiment_class
    FROM feedback WHERE analyzed = 1 AND theme <> 'uncategorized' GROUP BY 1, 2
    """
)
def sentiment_class(spark, sf_dir):
    day = measures.day_of(F.col("created_at")).alias("date")
    means = filters.themed(views.feedback(spark, sf_dir)).groupBy(day, "theme")
    return derive.with_sentiment_class(means.agg(measures.mean_score().alias("avg_sentiment")))


@registered(
    """
    SELECT *, round(positive * 100.0::DOUBLE / total, 1) AS pct_positive,
      round((total - positive - negative) * 100.0::DOUBLE / total, 1) AS pct_neutral,
      round(negative * 100.0::DOUBLE / total, 1) AS pct_negative,
      round(positive * 100.0::DOUBLE / total - negative * 100.0::DOUBLE / total, 1) AS net_sentiment
    FROM daily
    """
)
def trend_shares(spark, sf_dir):
    return derive.trend_shares(metrics.sentiment_trend(views.feedback(spark, sf_dir)))


@registered(
    """
    SELECT *, round(positive * 100.0::DOUBLE / total, 0) AS positive_width,
      100 - round(positive * 100.0::DOUBLE / total, 0)
        - round(negative * 100.0::DOUBLE / total, 0) AS neutral_width,
      round(negative * 100.0::DOUBLE / total, 0) AS negative_width
    FROM theme_totals
    """
)
def sentiment_bar(spark, sf_dir):
    return derive.sentiment_bar(metrics.theme_stats(views.feedback(spark, sf_dir)))


@registered(
    """
    SELECT *, CASE WHEN critical > 0 THEN 'critical' WHEN high > 0 THEN 'high' END AS badge
    FROM theme_totals
    """
)
def urgency_badge(spark, sf_dir):
    return derive.with_urgency_badge(metrics.theme_stats(views.feedback(spark, sf_dir)))


@registered(
    """
    SELECT *, CASE WHEN critical > 0 THEN 'critical' END AS badge,
      CASE WHEN critical > 0 THEN 'critical' WHEN high > 0 THEN 'high'
        ELSE 'medium' END AS urgency_class
    FROM theme_totals
    """
)
def urgency_badge_legacy(spark, sf_dir):
    return derive.with_urgency_badge_legacy(metrics.theme_stats(views.feedback(spark, sf_dir)))


@registered(
    """
    SELECT date, round((avg_sentiment + 1) / 2 * 100, 0) AS sentiment_percent, total AS volume
    FROM daily
    """
)
def volume_trend(spark, sf_dir):
    return derive.volume_trend(metrics.sentiment_trend(views.feedback(spark, sf_dir)))


@registered(
    """
    SELECT theme, count(*) AS count, array_to_string(list_transform(string_split(theme, '-'),
        lambda x: concat(upper(x[1]), x[2:])), ' ') AS display_name
    FROM feedback GROUP BY theme
    """
)
def theme_display_name(spark, sf_dir):
    counts = metrics.counts_by(views.feedback(spark, sf_dir), "theme")
    return derive.with_theme_names(counts)


@registered(
    """
    SELECT theme, count(*) AS count, upper(replace(theme, '-', ' ')) AS upper_name
    FROM feedback GROUP BY theme
    """
)
def theme_upper_name(spark, sf_dir):
    counts = metrics.counts_by(views.feedback(spark, sf_dir), "theme")
    return counts.withColumn("upper_name", labels.theme_upper_name(F.col("theme")))


@registered(
    """
    SELECT concat(upper(value_score[1]), value_score[2:]) AS label, count(*) AS count
    FROM feedback WHERE analyzed = 1 GROUP BY value_score
    """
)
def capitalize_label(spark, sf_dir):
    counts = metrics.value_distribution(views.feedback(spark, sf_dir))
    return counts.select(labels.capitalize_label(F.col("value_score")).alias("label"), "count")


@registered("SELECT strftime(date, '%b %-d') AS label, date, total FROM daily")
def short_date(spark, sf_dir):
    trend = metrics.sentiment_trend(views.feedback(spark, sf_dir))
    return trend.select(measures.short_date(F.col("date")).alias("label"), "date", "total")


@registered(
    """
    SELECT coalesce(count(*), 0) AS total, CAST(0 AS BIGINT) AS positive FROM feedback
    WHERE theme = 'no-such-theme'
    """
)
def null_to_zero(spark, sf_dir):
    found = views.feedback(spark, sf_dir).filter(F.col("theme") == "no-such-theme")
    sums = found.agg(
        measures.rows().alias("total"),
        measures.tally_label("sentiment", "positive").alias("positive"),
    )
    return sums.select(
        *[measures.or_zero(F.col(c)).cast("long").alias(c) for c in ["total", "positive"]]
    )


@registered("SELECT id, title FROM feedback")
def title_or_null(spark, sf_dir):
    stored = views.feedback(spark, sf_dir).select("id", F.coalesce("title", F.lit("")).alias("t"))
    return stored.select("id", labels.title_or_null(F.col("t")).alias("title"))
