"""Dashboard aggregates on hand-made rows with NULLs, ties and pending rows."""

import pytest
from pyspark.sql import functions as F

from tests.conftest import SMALL, feedback_row, moment, rows_of
from voxloom.operators import derive, filters, metrics


def test_overview_counts_analyzed_rows_only(small):
    (stats,) = rows_of(metrics.overview_stats(small))
    assert stats == {
        "total_feedback": 7,
        "positive": 3,
        "neutral": 1,
        "negative": 2,
        "critical_count": 2,
        "high_count": 1,
        "avg_sentiment": 0.0,
    }


def test_overview_of_nothing_has_null_sums(empty):
    (stats,) = rows_of(metrics.overview_stats(empty))
    assert stats["total_feedback"] == 0
    assert all(stats[name] is None for name in stats if name != "total_feedback")


def test_all_pending_is_like_nothing(small):
    (stats,) = rows_of(metrics.overview_stats(small.withColumn("analyzed", F.lit(0))))
    assert stats["total_feedback"] == 0 and stats["positive"] is None


def test_channels_include_pending_rows(small):
    counts = [(r["channel"], r["count"]) for r in rows_of(metrics.channel_counts(small))]
    assert counts == [("github", 5), ("forum", 2), ("email", 1)]


def test_themes_drop_uncategorized_and_null(small):
    counts = [(r["theme"], r["count"]) for r in rows_of(metrics.theme_distribution(small))]
    assert counts == [("pricing", 2), ("reliability", 2), ("API-docs", 1)]


def test_top_theme_breaks_ties_by_name(small):
    (top,) = rows_of(metrics.top_theme(small))
    assert top == {
        "theme": "pricing",
        "count": 2,
        "avg_sentiment": 0.2,
        "positive": 1,
        "negative": 1,
        "urgent_count": 2,
    }


def test_attention_orders_by_urgent_then_count_then_name(make_feedback):
    wanted = ["b", "a", "c", "d", "e"]
    rows, id = [], 0
    for theme, urgent, plain in [("a", 2, 1), ("b", 3, 0), ("c", 2, 0), ("d", 2, 0), ("e", 0, 9),
                                 ("f", 0, 8)]:
        for urgency, number in [("high", urgent), ("low", plain)]:
            for _ in range(number):
                id += 1
                rows.append(feedback_row(id, theme=theme, urgency=urgency))
    found = rows_of(metrics.themes_needing_attention(make_feedback(rows)))
    assert [r["theme"] for r in found] == wanted


def test_distributions_in_one_pass_match_separate_ones(small):
    found = {(r["dimension"], r["label"]): r["count"] for r in rows_of(metrics.all_distributions(small))}
    separate = {}
    for dimension, frame in [
        ("sentiment", metrics.sentiment_distribution(small)),
        ("urgency", metrics.urgency_distribution(small)),
        ("value", metrics.value_distribution(small)),
        ("theme", metrics.theme_distribution(small)),
    ]:
        separate.update({(dimension, row[0]): row[1] for row in frame.collect()})
    assert found == separate


def test_null_labels_are_a_group_but_for_themes(make_feedback):
    rows = make_feedback([feedback_row(1, sentiment=None, theme=None)])
    found = {(r["dimension"], r["label"]): r["count"] for r in rows_of(metrics.all_distributions(rows))}
    assert found == {("sentiment", None): 1, ("urgency", "low"): 1, ("value", "medium"): 1}


def test_distribution_sums_are_the_analyzed_rows(small):
    analyzed = sum(row["analyzed"] for row in SMALL)
    for counts in [metrics.sentiment_distribution, metrics.urgency_distribution,
                   metrics.value_distribution]:
        assert sum(row["count"] for row in rows_of(counts(small))) == analyzed


def test_trend_takes_the_latest_dates_that_have_rows(make_feedback):
    days = [1, 2, 3, 5, 8, 9, 10, 11, 12, 13, 14, 15, 20, 25, 28, 30]
    rows = make_feedback([feedback_row(n, created_at=moment(day)) for n, day in enumerate(days)])
    found = [row["date"].day for row in rows_of(metrics.sentiment_trend(rows))]
    assert found == days[-14:]


def test_weekly_trend_is_strictly_after_the_cutoff_and_counts_pending(make_feedback):
    rows = make_feedback(
        [
            feedback_row(1, created_at=moment(1), sentiment_score=1.0),
            feedback_row(2, created_at=moment(1, 0, 1), sentiment_score=0.5),
            feedback_row(3, created_at=moment(8), sentiment_score=-0.5, analyzed=0),
        ]
    )
    found = rows_of(metrics.weekly_avg_trend(rows, "2024-01-08 00:00:00"))
    assert [(row["date"].day, row["avg_sentiment"]) for row in found] == [(1, 0.5), (8, -0.5)]


def test_ordered_urgency_drops_unknown_levels(small):
    found = [(r["urgency"], r["count"]) for r in rows_of(metrics.ordered_urgency(small))]
    assert found == [("critical", 2), ("high", 1), ("medium", 1), ("low", 2)]


def test_lookup_with_default(spark):
    counts = spark.createDataFrame([("low", 3)], "priority string, count long")
    assert rows_of(metrics.lookup_with_default(counts)) == [{"urgent_count": 0}]
    assert rows_of(metrics.lookup_with_default(counts, "low")) == [{"urgent_count": 3}]
    assert rows_of(metrics.lookup_with_default(counts.limit(0))) == [{"urgent_count": 0}]


def test_average_on_an_edge_does_not_depend_on_the_order_of_rows(make_feedback):
    scores = [0.1, 0.7, -0.3, 0.02] * 15 + [0.06, 0.04, 0.02, 0.02]
    wanted = {}
    for order in [scores, sorted(scores), sorted(scores, reverse=True)]:
        rows = make_feedback([feedback_row(n, sentiment_score=s) for n, s in enumerate(order)])
        wanted[rows_of(metrics.theme_stats(rows))[0]["avg_sentiment"]] = True
    assert len(wanted) == 1


def test_shares_of_the_global_trend_count_other_labels_as_neutral(spark):
    trend = spark.createDataFrame(
        [(4, 1, 1), (0, None, None), (3, 1, 2)], "total long, positive long, negative long"
    )
    found = [
        (r["pct_positive"], r["pct_neutral"], r["pct_negative"], r["net_sentiment"])
        for r in rows_of(derive.trend_shares(trend))
    ]
    assert found == [(25.0, 50.0, 25.0, 0.0), (0.0, 0.0, 0.0, 0.0), (33.3, 0.0, 66.7, -33.3)]


def test_shares_of_a_theme_trend_leave_other_labels_out(spark):
    trend = spark.createDataFrame(
        [(4, 1, 1, 0), (9, 0, 0, 0)], "count long, positive long, neutral long, negative long"
    )
    found = [
        (r["pct_positive"], r["pct_neutral"], r["pct_negative"], r["net_sentiment"])
        for r in rows_of(derive.theme_trend_shares(trend))
    ]
    assert found == [(50.0, 50.0, 0.0, 50.0), (0.0, 0.0, 0.0, 0.0)]


def test_bar_widths_add_up_and_an_empty_theme_is_all_neutral(spark):
    stats = spark.createDataFrame(
        [(3, 1, 1), (0, 0, 0), (8, 1, 1)], "total long, positive long, negative long"
    )
    found = [
        (r["positive_width"], r["neutral_width"], r["negative_width"])
        for r in rows_of(derive.sentiment_bar(stats))
    ]
    assert found == [(33.0, 34.0, 33.0), (0.0, 100.0, 0.0), (13.0, 74.0, 13.0)]


def test_class_thresholds_are_strict(spark):
    means = spark.createDataFrame([(0.2,), (0.21,), (-0.2,), (-0.21,)], "avg_sentiment double")
    found = [r["sentiment_class"] for r in rows_of(derive.with_sentiment_class(means))]
    assert found == ["neutral", "positive", "neutral", "negative"]


def test_badges(spark):
    stats = spark.createDataFrame([(1, 1), (0, 2), (0, 0)], "critical long, high long")
    assert [r["badge"] for r in rows_of(derive.with_urgency_badge(stats))] == [
        "critical", "high", None,
    ]
    legacy = rows_of(derive.with_urgency_badge_legacy(stats))
    assert [r["badge"] for r in legacy] == ["critical", None, None]
    assert [r["urgency_class"] for r in legacy] == ["critical", "high", "medium"]


@pytest.mark.parametrize("facets", [{}, {"theme": "all"}, {"theme": ""}, {"sentiment": "positive"},
                                    {"theme": "pricing", "urgency": "high"}, {"channel": "nowhere"}])
def test_facets_match_brute_force(small, facets):
    wanted = [r for r in SMALL if r["analyzed"] == 1]
    for name, value in facets.items():
        if value not in ("", "all"):
            wanted = [r for r in wanted if r[name] == value]
    wanted.sort(key=lambda r: (r["created_at"], r["id"]), reverse=True)
    assert rows_of(filters.facet_filter(small, **facets)) == wanted


def test_limits_are_checked(small):
    assert filters.facet_filter(small, limit="2").count() == 2
    for limit in [-1, "many"]:
        with pytest.raises(ValueError):
            filters.facet_filter(small, limit=limit)


@pytest.mark.parametrize("missing", [None, ""])
def test_required_parameters(small, missing):
    with pytest.raises(ValueError):
        filters.theme_equals(small, missing)
    with pytest.raises(ValueError):
        filters.theme_substring(small, missing)
    with pytest.raises(ValueError):
        filters.recent_days(small, missing)
