"""Queries about one theme, and about all themes at once."""

from verification import views
from verification.registry import in_output_order, registered
from voxloom.operators import derive, drilldown

DETAIL = """
    SELECT {key} count(*) AS total, round(round(avg(sentiment_score), 9), 6) AS avg_sentiment,
      CAST(sum(CASE WHEN sentiment = 'positive' THEN 1 ELSE 0 END) AS BIGINT) AS positive,
      CAST(sum(CASE WHEN sentiment = 'neutral' THEN 1 ELSE 0 END) AS BIGINT) AS neutral,
      CAST(sum(CASE WHEN sentiment = 'negative' THEN 1 ELSE 0 END) AS BIGINT) AS negative,
      CAST(sum(CASE WHEN urgency = 'critical' THEN 1 ELSE 0 END) AS BIGINT) AS critical,
      CAST(sum(CASE WHEN urgency = 'high' THEN 1 ELSE 0 END) AS BIGINT) AS high
      {more}
    FROM feedback WHERE {where} AND analyzed = 1 {group}
"""
MORE = """, CAST(sum(CASE WHEN urgency = 'medium' THEN 1 ELSE 0 END) AS BIGINT) AS medium,
      CAST(sum(CASE WHEN urgency = 'low' THEN 1 ELSE 0 END) AS BIGINT) AS low"""


@registered(DETAIL.format(key="", more=MORE, where="theme = 'reliability'", group=""))
def theme_detail_stats(spark, sf_dir):
    return drilldown.theme_detail_stats(views.feedback(spark, sf_dir), "reliability")


@registered(DETAIL.format(key="", more=MORE, where="theme = 'no-such-theme'", group=""))
def theme_detail_stats_unknown(spark, sf_dir):
    return drilldown.theme_detail_stats(views.feedback(spark, sf_dir), "no-such-theme")


@registered(
    DETAIL.format(key="theme,", more=MORE, where="theme IS NOT NULL", group="GROUP BY theme")
)
def theme_detail_stats_all(spark, sf_dir):
    return drilldown.theme_detail_stats_all(views.feedback(spark, sf_dir))


@registered(DETAIL.format(key="", more="", where="theme = 'documentation'", group=""))
def theme_detail_stats_compact(spark, sf_dir):
    return drilldown.theme_detail_stats_compact(views.feedback(spark, sf_dir), "documentation")


@registered(
    """
    SELECT theme, channel, count(*) AS count FROM feedback
    WHERE analyzed = 1 AND theme IS NOT NULL GROUP BY theme, channel
    """
)
def theme_channels(spark, sf_dir):
    return drilldown.theme_channels(views.feedback(spark, sf_dir))


@registered(
    """
    WITH hit AS (SELECT * FROM theme_daily
      QUALIFY row_number() OVER (PARTITION BY theme ORDER BY date DESC) <= 14)
    SELECT *, CAST(row_number() OVER (ORDER BY theme, date) AS INTEGER) AS rank FROM hit
    """
)
def theme_trend(spark, sf_dir):
    return in_output_order(drilldown.theme_trend(views.stored_feedback(spark, sf_dir)))


@registered(
    """
    WITH hit AS (SELECT date, count, avg_sentiment, positive, neutral, negative FROM theme_daily
      WHERE theme = 'pricing' ORDER BY date DESC LIMIT 14)
    SELECT *, CAST(row_number() OVER (ORDER BY date) AS INTEGER) AS rank FROM hit
    """
)
def theme_trend_one(spark, sf_dir):
    trend = drilldown.theme_trend(views.stored_feedback(spark, sf_dir), "pricing")
    return in_output_order(trend)


@registered(
    """
    SELECT theme, date, count, avg_sentiment FROM theme_daily
    QUALIFY row_number() OVER (PARTITION BY theme ORDER BY date DESC) <= 7
    """
)
def theme_trend_short(spark, sf_dir):
    return drilldown.theme_trend_short(views.stored_feedback(spark, sf_dir))


@registered(
    """
    WITH hit AS (SELECT *, positive + neutral + negative AS n FROM theme_daily
      QUALIFY row_number() OVER (PARTITION BY theme ORDER BY date DESC) <= 14)
    SELECT * EXCLUDE (n),
      CASE WHEN n > 0 THEN round(positive * 100.0::DOUBLE / n, 1) ELSE 0 END AS pct_positive,
      CASE WHEN n > 0 THEN round(neutral * 100.0::DOUBLE / n, 1) ELSE 0 END AS pct_neutral,
      CASE WHEN n > 0 THEN round(negative * 100.0::DOUBLE / n, 1) ELSE 0 END AS pct_negative,
      CASE WHEN n > 0 THEN round(positive * 100.0::DOUBLE / n - negative * 100.0::DOUBLE / n, 1)
        ELSE 0 END AS net_sentiment
    FROM hit
    """
)
def theme_trend_shares(spark, sf_dir):
    return derive.theme_trend_shares(drilldown.theme_trend(views.feedback(spark, sf_dir)))


@registered(
    """
    SELECT s.*, r.rank FROM ranked_samples r JOIN stored_feedback s ON s.id = r.id
    """
)
def samples_per_theme(spark, sf_dir):
    return drilldown.samples_per_theme(views.stored_feedback(spark, sf_dir))


@registered(
    """
    SELECT s.*, r.rank FROM ranked_samples r JOIN stored_feedback s ON s.id = r.id
    WHERE s.theme = 'performance'
    """
)
def urgency_ordered_samples(spark, sf_dir):
    return drilldown.urgency_ordered_samples(views.stored_feedback(spark, sf_dir), "performance")


def recent_texts(spark, sf_dir):
    return drilldown.recent_texts_per_theme(views.stored_feedback(spark, sf_dir))


@registered("SELECT * FROM recent_texts")
def recent_texts_per_theme(spark, sf_dir):
    return recent_texts(spark, sf_dir)


@registered(
    """
    SELECT theme, string_agg(content, concat(chr(10), '---', chr(10)) ORDER BY rank) AS joined
    FROM recent_texts GROUP BY theme
    """
)
def join_texts(spark, sf_dir):
    texts = drilldown.texts_by_theme(recent_texts(spark, sf_dir))
    return texts.select("theme", drilldown.join_texts("texts").alias("joined"))
