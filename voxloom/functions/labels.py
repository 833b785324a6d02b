"""Label texts: ranks, flags, badges, defaults and display names."""

from pyspark.sql import functions as F

from voxloom.schema import URGENT

# The code points that ECMAScript's trim removes.
JS_SPACE = [
    0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0xA0, 0x1680, *range(0x2000, 0x200B),
    0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF,
]
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
REST = 2147483647


def urgency_rank(urgency):
    """1 for critical, 2 for high, 3 for medium, 4 for anything else."""
    return (
        F.when(urgency == "critical", 1)
        .when(urgency == "high", 2)
        .when(urgency == "medium", 3)
        .otherwise(4)
    )


def is_urgent(urgency):
    return urgency.isin(*URGENT)


def ascii_lower(text):
    """Lower case for A-Z only, the way a SQL LIKE without Unicode tables folds case."""
    return F.translate(text, UPPER, UPPER.lower())


def contains_label(text, term):
    """``LIKE '%term%'``: ASCII case-insensitive; ``%`` and ``_`` stay wildcards."""
    pattern = F.lit("%" + term.replace("\\", "\\\\") + "%")
    return F.like(ascii_lower(text), ascii_lower(pattern))


def is_nonblank(text):
    """True if the text has a character that is not white space."""
    spaces = "".join(map(chr, JS_SPACE))
    return F.coalesce(F.rlike(text, F.lit(f"[^{spaces}]")), F.lit(False))


def capitalize_label(label):
    """First letter in upper case, the rest unchanged."""
    return F.concat(F.upper(F.substring(label, 1, 1)), F.substring(label, 2, REST))


def theme_display_name(theme):
    """``api-docs`` as ``Api Docs``; unlike initcap, ``API-docs`` keeps its capitals."""
    return F.array_join(F.transform(F.split(theme, "-"), capitalize_label), " ")


def theme_upper_name(theme):
    """``api-docs`` as ``API DOCS``."""
    return F.upper(F.replace(theme, F.lit("-"), F.lit(" ")))


def upper_label(label):
    return F.upper(label)


def title_or_null(title):
    return F.nullif(title, F.lit(""))


def urgency_badge(critical, high):
    """The badge of a theme row: critical if any, else high if any, else none."""
    return F.when(critical > 0, "critical").when(high > 0, "high")


def urgency_badge_legacy(critical):
    """The older badge, which knows critical rows only."""
    return F.when(critical > 0, "critical")


def urgency_class_legacy(critical, high):
    """The older style class of a theme row."""
    return F.when(critical > 0, "critical").when(high > 0, "high").otherwise("medium")


def default_if_empty(value, default):
    """The default for NULL and for ''."""
    return F.coalesce(F.nullif(value, F.lit("")), F.lit(default))


def default_if_zero(value, default):
    """The default for NULL, NaN and 0."""
    return F.coalesce(F.when(~F.isnan(value) & (value != 0), value), F.lit(default))
