"""Themes held as JSON arrays: weights, bad values, shares and matches."""

import datetime as dt

import pytest

from tests.conftest import rows_of
from voxloom.operators import filters, multilabel, unify
from voxloom.plans import documents
from voxloom.schema import MULTILABEL

THEMES = [
    '["pricing","docs"]',
    '["pricing"]',
    '["pricing","pricing"]',
    '["docs"] junk',
    '{"pricing":1}',
    "not json",
    "[]",
    "",
    None,
    '["pricing","docs"]',
]


@pytest.fixture(scope="module")
def table(spark):
    rows = [
        (n, dt.datetime(2024, 1, 1, n), f"text {n}", "web", "u", n / 10.0, "POSITIVE", themes,
         "high" if n % 2 else "low")
        for n, themes in enumerate(THEMES)
    ]
    return spark.createDataFrame(rows, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in MULTILABEL))


def test_repeats_count_twice_and_bad_rows_stay_in_the_total(table):
    found = rows_of(multilabel.multilabel_theme_stats(table))
    assert found == [
        {"theme": "pricing", "count": 5, "percentage": 50.0},
        {"theme": "docs", "count": 2, "percentage": 20.0},
    ]


def test_no_rows_give_no_stats(table):
    assert rows_of(multilabel.multilabel_theme_stats(table.limit(0))) == []


def test_average_per_label_weighs_rows(table):
    found = {r["theme"]: r["avg_sentiment"] for r in rows_of(multilabel.multilabel_avg_sentiment(table))}
    assert found == {"pricing": round((0.0 + 0.1 + 0.2 + 0.2 + 0.9) / 5, 6), "docs": 0.45}


def test_match_counts_all_and_lists_the_newest(table):
    found = rows_of(multilabel.theme_match_total(table, "PRIC", 2))
    assert [(r["id"], r["total_count"]) for r in found] == [(9, 5), (4, 5)]


def test_exact_and_substring_matches(table):
    assert {r["id"] for r in rows_of(filters.theme_substring(table, "doc"))} == {0, 3, 9}
    assert {r["id"] for r in rows_of(filters.theme_exact(table, "docs"))} == {0, 9}
    assert {r["id"] for r in rows_of(filters.array_only(table))} == {0, 1, 2, 6, 7, 8, 9}


def test_high_priority_lists_the_newest(table):
    assert [r["id"] for r in rows_of(filters.high_priority(table, 3))] == [9, 7, 5]


def test_facets(table):
    found = filters.facet_filter_multilabel(table, priority="high", theme="pricing", source="")
    assert [r["id"] for r in rows_of(found)] == [9, 1]
    assert filters.facet_filter_multilabel(table, sentiment_label="NEGATIVE").count() == 0


def test_both_models_as_one(table, small):
    found = rows_of(unify.unify_models(small, table))
    assert len(found) == small.count() + len(THEMES)
    multi = {r["id"]: r for r in found if r["origin"] == "multi"}
    assert multi[0]["theme"] == "pricing" and multi[5]["theme"] is None
    assert multi[6]["theme"] is None and multi[0]["sentiment"] == "positive"
    assert multi[0]["channel"] == "web" and multi[1]["urgency"] == "high"


def test_match_document_tells_zero_when_nothing_matches(table):
    (found,) = rows_of(documents.theme_match_document(table, "nowhere"))
    assert found == {"theme": "nowhere", "totalCount": 0, "feedback": []}
    (found,) = rows_of(documents.theme_match_document(table, "doc", limit=2))
    assert found["totalCount"] == 3 and [r["id"] for r in found["feedback"]] == [9, 3]
    assert list(found["feedback"][0]) == MULTILABEL.names


def test_insights_document(table):
    (found,) = rows_of(documents.insights_document(table, limit=2))
    assert found["totalFeedback"] == 10
    assert found["sentiment"] == [{"sentiment_label": "POSITIVE", "count": 10}]
    assert found["priority"] == [{"priority": "high", "count": 5}, {"priority": "low", "count": 5}]
    assert [r["id"] for r in found["urgent"]] == [9, 7]
    (nothing,) = rows_of(documents.insights_document(table.limit(0)))
    assert nothing == {"totalFeedback": 0, "sentiment": [], "priority": [], "urgent": []}
