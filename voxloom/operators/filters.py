"""Predicates and feedback lists."""

from pyspark.sql import functions as F

from voxloom.functions.json_text import parse_label_array
from voxloom.functions.labels import contains_label, is_nonblank
from voxloom.functions.measures import cutoff
from voxloom.operators.by_day import is_by_day
from voxloom.operators.topk import checked_limit, newest_n
from voxloom.schema import UNCATEGORIZED

FACETS = ["sentiment", "theme", "urgency", "channel"]


def required(name, value):
    """A parameter that must be given; raises when the plan is built."""
    if value is None or value == "":
        raise ValueError(f"{name} is required")
    return value


def analyzed_only(feedback):
    return feedback.filter(F.col("analyzed") == 1)


def categorized_only(feedback):
    """Rows whose theme is known; a NULL theme is dropped with ``uncategorized``."""
    return feedback.filter(F.col("theme") != UNCATEGORIZED)


def themed(feedback):
    return categorized_only(analyzed_only(feedback))


def facet_filter(
    feedback, sentiment=None, theme=None, urgency=None, channel=None, limit=50, narrow_first=True
):
    """Newest analyzed rows that meet the given facets; None, '' and 'all' mean any."""
    limit = checked_limit(limit)
    rows = analyzed_only(feedback)
    for name, value in zip(FACETS, [sentiment, theme, urgency, channel], strict=True):
        if value and value != "all":
            rows = rows.filter(F.col(name) == value)
    return newest_n(rows, limit, narrow_first)


def facet_filter_multilabel(
    feedback, priority=None, source=None, theme=None, sentiment_label=None, limit=50
):
    """Newest multi-label rows that meet the given facets; None and '' mean any."""
    limit = checked_limit(limit)
    rows = feedback
    if priority:
        rows = rows.filter(F.col("priority") == priority)
    if source:
        rows = rows.filter(F.col("source") == source)
    if theme:
        rows = theme_substring(rows, theme)
    if sentiment_label:
        rows = rows.filter(F.col("sentiment_label") == sentiment_label)
    return newest_n(rows, limit)


def theme_equals(feedback, theme):
    """Analyzed rows of one theme."""
    required("theme", theme)
    return feedback.filter((F.col("theme") == theme) & (F.col("analyzed") == 1))


def theme_substring(feedback, term):
    """Rows whose themes text contains the term (``doc`` finds ``documentation``)."""
    required("theme", term)
    return feedback.filter(contains_label(F.col("themes"), term))


def theme_exact(feedback, label):
    """Rows that carry exactly this label in their themes array."""
    required("theme", label)
    return feedback.filter(F.array_contains(parse_label_array(F.col("themes")), label))


def array_only(feedback):
    """Rows whose themes text is a JSON array; missing text counts as an empty one."""
    return feedback.filter(parse_label_array(F.col("themes")).isNotNull())


def recent_days(feedback, as_of, days=7):
    """Rows created strictly after ``days`` days before ``as_of``."""
    required("as_of", as_of)
    like = feedback.schema["created_at"].dataType
    since = cutoff(as_of, days, like)
    recent = feedback.filter(F.col("created_at") > since)
    if is_by_day(feedback):
        # The layout's days are UTC days of zone-less times, which decide which folders open.
        first = cutoff(as_of, days, "timestamp_ntz")
        recent = recent.filter(F.col("created_date") >= F.to_date(first))
    return recent


def high_priority(feedback, limit=10):
    """The newest rows of high priority."""
    return newest_n(feedback.filter(F.col("priority") == "high"), limit)


def nonblank_text(rows, column):
    """Rows whose text holds more than white space."""
    return rows.filter(is_nonblank(F.col(column)))
