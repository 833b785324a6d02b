"""Strict JSON held in text columns.

Spark's JSON readers stop after the first value and accept junk behind it
(``["a"] junk``, ``["a"]]``). Here the text is parsed as the first of two array
elements; the second is a mark that no stored text can know. Only if the text is
exactly one JSON value does the mark come second.
"""

import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

MARK = uuid.uuid4().hex
REPEATED_KEYS = "spark.sql.variant.allowDuplicateKeys"


def allow_repeated_keys():
    """Have a repeated key in a JSON object count once, with its last value.

    Spark decides that by a session setting. It is set where the session leaves
    it open; a session that has turned it off is refused rather than read otherwise.
    """
    session = SparkSession.getActiveSession()
    if session is None:
        return
    given = session.conf.get(REPEATED_KEYS, None)
    if given is None:
        session.conf.set(REPEATED_KEYS, "true")
    elif given.lower() != "true":
        raise ValueError(f"{REPEATED_KEYS} must not be turned off")


def bound(value, use):
    """``use(value)`` with the value computed once, however often it is used.

    Common subexpressions are not shared inside a filter, and parsing is dear.
    """
    return F.element_at(F.transform(F.array(value), use), 1)


def strict_variant(text):
    """A variant array that starts with the text's value; NULL unless it is one value."""
    allow_repeated_keys()
    marked = F.try_parse_json(F.concat(F.lit("["), text, F.lit(f',"{MARK}"]')))

    def if_marked(array):
        return F.when(F.try_variant_get(array, "$[1]", "string") == MARK, array)

    return bound(marked, if_marked)


def parse_label_array(text):
    """A JSON array of labels as ``array<string>``.

    Missing and empty text is an empty array; bad JSON and other JSON types
    are NULL, so that exploding them adds no label.
    """
    given = F.coalesce(F.nullif(text, F.lit("")), F.lit("[]"))
    return F.try_variant_get(strict_variant(given), "$[0]", "array<string>")


def encode_label_array(labels):
    """An array of labels as JSON text."""
    return F.to_json(labels)


def braces_span(text):
    """Everything from the first ``{`` to the last ``}``, NULL when there is none."""
    return F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit(""))
