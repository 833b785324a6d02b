"""Lists of newest and most urgent rows against brute force, with ties and a hot group."""

import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tests.conftest import feedback_row, moment, rows_of
from voxloom.operators import drilldown, topk

RANKS = {"critical": 1, "high": 2, "medium": 3}


def random_rows(number, seed=1):
    """A third of the rows share one theme; many share a time."""
    draw = random.Random(seed)
    themes = ["hot"] * 4 + [f"theme-{n}" for n in range(8)] + [None]
    return [
        feedback_row(
            n,
            theme=draw.choice(themes),
            created_at=moment(draw.randint(1, 28), draw.randint(0, 3)),
            urgency=draw.choice(["critical", "high", "medium", "low", None, "odd"]),
            analyzed=draw.choice([0, 1, 1]),
        )
        for n in range(number)
    ]


def brute_force(rows, key, k):
    groups = {}
    for row in rows:
        if row["analyzed"] == 1 and row["theme"] is not None:
            groups.setdefault(row["theme"], []).append(row)
    return {
        (theme, place): row["id"]
        for theme, members in groups.items()
        for place, row in enumerate(sorted(members, key=key)[:k], 1)
    }


def newest_key(row):
    return (-row["created_at"].timestamp(), -row["id"])


def urgent_key(row):
    return (RANKS.get(row["urgency"], 4), *newest_key(row))


@pytest.mark.parametrize("partitions", [1, 7])
@pytest.mark.parametrize("k", [1, 10])
def test_per_theme_lists(make_feedback, partitions, k):
    rows = random_rows(1500)
    feedback = make_feedback(rows).repartition(partitions)
    for operator, key in [
        (drilldown.samples_per_theme, urgent_key),
        (drilldown.recent_per_theme, newest_key),
    ]:
        found = {(r["theme"], r["rank"]): r["id"] for r in operator(feedback, k).collect()}
        assert found == brute_force(rows, key, k)


def test_one_theme_is_the_same_list(make_feedback):
    rows = random_rows(600, seed=2)
    found = [r["id"] for r in drilldown.urgency_ordered_samples(make_feedback(rows), "hot").collect()]
    wanted = brute_force(rows, urgent_key, 10)
    assert found == [wanted["hot", place] for place in range(1, 11)]


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(
    hours=st.lists(st.one_of(st.none(), st.integers(0, 5)), max_size=12),
    n=st.integers(0, 14),
)
def test_newest_n_keeps_ties_and_missing_times(make_feedback, hours, n):
    rows = [
        feedback_row(id, created_at=None if hour is None else moment(1, hour))
        for id, hour in enumerate(hours)
    ]
    known = sorted((r for r in rows if r["created_at"]), key=newest_key)
    unknown = sorted((r for r in rows if not r["created_at"]), key=lambda r: -r["id"])
    assert rows_of(topk.newest_n(make_feedback(rows), n)) == (known + unknown)[:n]


def test_texts_are_joined_newest_first(make_feedback):
    rows = [feedback_row(n, content=f"t{n}", created_at=moment(n)) for n in range(1, 13)]
    recent = drilldown.recent_texts_per_theme(make_feedback(rows))
    texts = drilldown.texts_by_theme(recent)
    joined = texts.select(drilldown.join_texts("texts").alias("joined")).collect()[0]["joined"]
    assert joined == "\n---\n".join(f"t{n}" for n in range(12, 2, -1))


def test_theme_trends_of_all_themes_match_each_one(make_feedback):
    feedback = make_feedback(random_rows(800, seed=3))
    together = {}
    for row in rows_of(drilldown.theme_trend(feedback)):
        together.setdefault(row.pop("theme"), []).append(row)
    assert len(together["hot"]) == 14
    for theme, trend in together.items():
        assert rows_of(drilldown.theme_trend(feedback, theme)) == trend
