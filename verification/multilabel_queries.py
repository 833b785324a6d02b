"""Queries over the multi-label table and over both models together."""

from pyspark.sql import functions as F

from verification import views
from verification.registry import in_output_order, registered
from voxloom.functions import json_text, labels
from voxloom.operators import filters, metrics, multilabel, topk, unify
from voxloom.operators.topk import largest_first, ranked
from voxloom.sources import tables


@registered(
    """
    SELECT s.*, len(l.labels) AS label_count FROM stored_multilabel s JOIN labelled l USING (id)
    """
)
def scan_multilabel(spark, sf_dir):
    rows = tables.with_label_array(views.stored_multilabel(spark, sf_dir))
    return rows.withColumn("label_count", F.array_size("labels").cast("long")).drop("labels")


@registered(
    """
    WITH hit AS (SELECT * FROM stored_multilabel WHERE priority = 'high' AND source = 'github'
        AND themes ILIKE '%PRIC%' AND sentiment_label = 'NEGATIVE'
      ORDER BY created_at DESC, id DESC LIMIT 50)
    SELECT *, CAST(row_number() OVER (ORDER BY created_at DESC, id DESC) AS INTEGER) AS rank
    FROM hit
    """
)
def facet_filter_multilabel(spark, sf_dir):
    hit = filters.facet_filter_multilabel(
        views.stored_multilabel(spark, sf_dir),
        priority="high",
        source="github",
        theme="PRIC",
        sentiment_label="NEGATIVE",
    )
    return in_output_order(hit)


@registered("SELECT * FROM stored_multilabel WHERE themes ILIKE '%doc%'")
def theme_substring(spark, sf_dir):
    return filters.theme_substring(views.stored_multilabel(spark, sf_dir), "doc")


@registered(
    """
    SELECT s.* FROM stored_multilabel s JOIN labelled l USING (id)
    WHERE list_contains(l.labels, 'documentation')
    """
)
def theme_exact(spark, sf_dir):
    return filters.theme_exact(views.stored_multilabel(spark, sf_dir), "documentation")


@registered(
    "SELECT s.* FROM stored_multilabel s JOIN labelled l USING (id) WHERE l.labels IS NOT NULL"
)
def array_only(spark, sf_dir):
    return filters.array_only(views.stored_multilabel(spark, sf_dir))


@registered(
    """
    WITH hit AS (SELECT * FROM stored_multilabel WHERE priority = 'high'
      ORDER BY created_at DESC, id DESC LIMIT 10)
    SELECT *, CAST(row_number() OVER (ORDER BY created_at DESC, id DESC) AS INTEGER) AS rank
    FROM hit
    """
)
def high_priority(spark, sf_dir):
    return in_output_order(filters.high_priority(views.stored_multilabel(spark, sf_dir)))


@registered("SELECT count(*) FILTER (priority = 'high') AS urgent_count FROM multilabel")
def lookup_with_default(spark, sf_dir):
    return metrics.lookup_with_default(metrics.priority_counts(views.multilabel(spark, sf_dir)))


@registered(
    """
    SELECT priority, count(*) AS count,
      round(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM multilabel), 1) AS percentage
    FROM multilabel GROUP BY priority
    """
)
def share_of_total(spark, sf_dir):
    rows = views.multilabel(spark, sf_dir)
    return multilabel.share_of_total(metrics.priority_counts(rows), rows)


@registered("SELECT count(*) AS count FROM multilabel")
def total_feedback(spark, sf_dir):
    return metrics.total_feedback(views.multilabel(spark, sf_dir))


@registered("SELECT sentiment_label, count(*) AS count FROM multilabel GROUP BY 1")
def sentiment_label_counts(spark, sf_dir):
    return metrics.sentiment_label_counts(views.multilabel(spark, sf_dir))


@registered("SELECT priority, count(*) AS count FROM multilabel GROUP BY 1")
def priority_counts(spark, sf_dir):
    return metrics.priority_counts(views.multilabel(spark, sf_dir))


@registered(
    """
    SELECT themes, count(*) AS count,
      CAST(row_number() OVER (ORDER BY count(*) DESC, themes) AS INTEGER) AS rank
    FROM multilabel GROUP BY 1
    """
)
def themes_text_counts(spark, sf_dir):
    return in_output_order(multilabel.themes_text_counts(views.multilabel(spark, sf_dir)))


STATS = """
    SELECT theme, count,
      round(count * 100.0::DOUBLE / (SELECT count(*) FROM multilabel), 1) AS percentage
    FROM label_counts
"""


@registered(
    f"""
    SELECT *, CAST(row_number() OVER (ORDER BY count DESC, theme) AS INTEGER) AS rank
    FROM ({STATS})
    """
)
def multilabel_theme_stats(spark, sf_dir):
    return in_output_order(multilabel.multilabel_theme_stats(views.multilabel(spark, sf_dir)))


@registered("SELECT theme, percentage FROM (" + STATS + ")")
def label_percentage(spark, sf_dir):
    stats = multilabel.multilabel_theme_stats(views.multilabel(spark, sf_dir))
    return stats.select("theme", "percentage")


@registered(
    """
    SELECT theme, count, CAST(row_number() OVER (ORDER BY count DESC, theme) AS INTEGER) AS rank
    FROM label_counts ORDER BY rank LIMIT 12
    """
)
def display_head(spark, sf_dir):
    stats = multilabel.multilabel_theme_stats(views.multilabel(spark, sf_dir))
    return ranked(topk.display_head(stats, 12).select("theme", "count"), *largest_first("theme"))


@registered(
    """
    SELECT theme, round(round(avg(sentiment_score), 9), 6) AS avg_sentiment
    FROM (SELECT unnest(labels) AS theme, sentiment_score FROM labelled) GROUP BY theme
    """
)
def multilabel_avg_sentiment(spark, sf_dir):
    return multilabel.multilabel_avg_sentiment(views.multilabel(spark, sf_dir))


@registered(
    """
    SELECT CAST(created_at AS DATE) AS date, round(round(avg(sentiment_score), 9), 6) AS avg_sentiment,
      CAST(row_number() OVER (ORDER BY CAST(created_at AS DATE)) AS INTEGER) AS rank
    FROM multilabel WHERE created_at > TIMESTAMP '2024-01-24 00:00:00' GROUP BY 1
    """
)
def weekly_avg_trend(spark, sf_dir):
    rows = views.stored_multilabel(spark, sf_dir)
    return in_output_order(metrics.weekly_avg_trend(rows, views.AS_OF))


@registered(
    """
    WITH hit AS (SELECT * FROM stored_multilabel WHERE themes ILIKE '%relia%')
    SELECT *, (SELECT count(*) FROM hit) AS total_count,
      CAST(row_number() OVER (ORDER BY created_at DESC, id DESC) AS INTEGER) AS rank
    FROM hit ORDER BY rank LIMIT 20
    """
)
def theme_match_total(spark, sf_dir):
    return in_output_order(
        multilabel.theme_match_total(views.stored_multilabel(spark, sf_dir), "relia")
    )


@registered(
    """
    SELECT 'single' AS origin, id, created_at, channel, author, sentiment, sentiment_score,
      theme, urgency FROM feedback
    UNION ALL
    SELECT 'multi', id, created_at, source, user_id, lower(sentiment_label), sentiment_score,
      labels[1], priority FROM labelled
    """
)
def unify_models(spark, sf_dir):
    single = views.feedback(spark, sf_dir)
    return unify.unify_models(single, views.multilabel_of(single))


@registered(
    "SELECT id, array_to_string(labels, '|') AS labels, labels IS NULL AS unreadable FROM labelled"
)
def parse_label_array(spark, sf_dir):
    parsed = json_text.parse_label_array(F.col("themes"))
    rows = views.multilabel(spark, sf_dir).select("id", parsed.alias("labels"))
    return rows.select(
        "id",
        F.array_join("labels", "|").alias("labels"),
        F.col("labels").isNull().alias("unreadable"),
    )


@registered(
    """
    SELECT id, concat('["', coalesce(theme, ''), '","', value_score, '"]') AS themes FROM feedback
    """
)
def encode_label_array(spark, sf_dir):
    names = F.array(F.coalesce("theme", F.lit("")), "value_score")
    rows = views.feedback(spark, sf_dir)
    return rows.select("id", json_text.encode_label_array(names).alias("themes"))


@registered("SELECT upper(priority) AS label, count(*) AS count FROM multilabel GROUP BY 1")
def upper_label(spark, sf_dir):
    counts = metrics.priority_counts(views.multilabel(spark, sf_dir))
    return counts.select(labels.upper_label(F.col("priority")).alias("label"), "count")
