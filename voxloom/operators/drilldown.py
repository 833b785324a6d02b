"""Details of one theme, and the same for all themes in one job."""

from pyspark.sql import functions as F

from voxloom.functions.measures import mean_score, rows, tally_label
from voxloom.operators.by_day import feedback_day, is_by_day, latest_days, on_days
from voxloom.operators.filters import analyzed_only, theme_equals
from voxloom.operators.topk import (
    checked_limit,
    fetch_rows,
    first_k_of_groups,
    latest_k_dates_ascending,
    most_urgent_first,
    newest_first,
    ranked,
    top_k_per_group,
)
from voxloom.session import stored


def analyzed_themes(feedback):
    """Analyzed rows with a theme: what asking for each theme in turn would find."""
    return analyzed_only(feedback).filter(F.col("theme").isNotNull())


def sentiment_tallies():
    return [tally_label("sentiment", s).alias(s) for s in ["positive", "neutral", "negative"]]


def urgency_tallies(levels):
    return [tally_label("urgency", level).alias(level) for level in levels]


def detail_measures(levels):
    return [
        rows().alias("total"),
        mean_score().alias("avg_sentiment"),
        *sentiment_tallies(),
        *urgency_tallies(levels),
    ]


def theme_detail_stats(feedback, theme):
    """One row of totals; an unknown theme gives 0 rows and NULL sums."""
    return theme_equals(feedback, theme).agg(
        *detail_measures(["critical", "high", "medium", "low"])
    )


def theme_detail_stats_all(feedback):
    return (
        analyzed_themes(feedback)
        .groupBy("theme")
        .agg(*detail_measures(["critical", "high", "medium", "low"]))
    )


def theme_detail_stats_compact(feedback, theme):
    """The older form, without medium and low."""
    return theme_equals(feedback, theme).agg(*detail_measures(["critical", "high"]))


def theme_channels(feedback, theme=None):
    """Rows per channel of one theme, or of each theme."""
    if theme is not None:
        per_channel = theme_equals(feedback, theme).groupBy("channel")
    else:
        per_channel = analyzed_themes(feedback).groupBy("theme", "channel")
    return per_channel.agg(rows().alias("count"))


def daily_measures():
    return [rows().alias("count"), mean_score().alias("avg_sentiment"), *sentiment_tallies()]


def theme_trend(feedback, theme=None, days=14):
    """Per-day measures of the latest dates of one theme, or of each theme."""
    date = feedback_day(feedback).alias("date")
    if theme is not None:
        rows_of_theme = latest_days(theme_equals(feedback, theme), days)
        return latest_k_dates_ascending(rows_of_theme.groupBy(date).agg(*daily_measures()), days)
    rows_of_themes = analyzed_themes(feedback)
    if is_by_day(feedback):
        dated = rows_of_themes.select("theme", "created_date").distinct()
        listed = first_k_of_groups(dated, ["theme"], [F.desc("created_date")], days, "_latest")
        rows_of_themes = on_days(rows_of_themes, listed, "created_date")
    daily = rows_of_themes.groupBy("theme", date).agg(*daily_measures())
    latest = first_k_of_groups(daily, ["theme"], [F.desc("date")], days, "_latest")
    return latest.drop("_latest").orderBy("theme", "date")


def theme_trend_short(feedback, theme=None, days=7):
    """The older trend: 7 dates, without the split by sentiment."""
    return theme_trend(feedback, theme, days).drop("positive", "neutral", "negative")


LIST_COLUMNS = ["id", "created_at", "theme", "urgency", "analyzed"]


def narrow_columns(feedback):
    """Only the columns that decide the order of lists, and where their rows are."""
    return feedback.select(*LIST_COLUMNS, *listed_day(feedback))


def listed_day(feedback):
    return ["created_date"] if is_by_day(feedback) else []


def with_whole_rows(feedback, chosen, *added):
    """The rows of a short list of ids, which are unique, with the list's own columns."""
    listed = chosen.select("id", *added, *listed_day(feedback))
    return fetch_rows(feedback, stored(listed, "listed"))


def most_urgent_of_themes(narrow, k=10):
    """The most urgent narrow rows of each theme, newest first within an urgency."""
    return top_k_per_group(analyzed_themes(narrow), ["theme"], most_urgent_first(), k)


def newest_of_themes(narrow, k=10):
    """The newest narrow rows of each theme."""
    return top_k_per_group(analyzed_themes(narrow), ["theme"], newest_first(), k)


def samples_per_theme(feedback, k=10):
    """The most urgent rows of each theme, newest first within an urgency."""
    return with_whole_rows(feedback, most_urgent_of_themes(narrow_columns(feedback), k), "rank")


def urgency_ordered_samples(feedback, theme, k=10):
    """The most urgent rows of one theme."""
    rows_of_theme = theme_equals(narrow_columns(feedback), theme)
    first = rows_of_theme.orderBy(*most_urgent_first()).limit(checked_limit(k))
    chosen = ranked(first, *most_urgent_first())
    return with_whole_rows(feedback, chosen, "rank").orderBy("rank")


def recent_per_theme(feedback, k=10):
    """The newest rows of each theme."""
    return with_whole_rows(feedback, newest_of_themes(narrow_columns(feedback), k), "rank")


def recent_texts_per_theme(feedback, k=10):
    """The newest texts of each theme."""
    return recent_per_theme(feedback, k).select("theme", "rank", "id", "content")


def samples_and_recent(feedback, k=10):
    """Ids of both lists of each theme: (theme, kind, rank, id), by day also their day.

    The rows themselves are for ``fetch_rows`` to get.
    """
    narrow = narrow_columns(feedback)
    lists = {"samples": most_urgent_of_themes(narrow, k), "recent": newest_of_themes(narrow, k)}
    samples, recent = (
        chosen.select("theme", F.lit(kind).alias("kind"), "rank", "id", *listed_day(feedback))
        for kind, chosen in lists.items()
    )
    return samples.unionByName(recent)


def texts_by_theme(recent):
    """The texts of ``recent_texts_per_theme`` as one array per theme, newest first."""
    gathered = F.sort_array(F.collect_list(F.struct("rank", "content")))
    return recent.groupBy("theme").agg(
        F.transform(gathered, lambda item: item["content"]).alias("texts")
    )


#: How many texts a summary is made of.
SUMMARY_TEXTS = 10


def first_texts(texts, k=SUMMARY_TEXTS):
    """The first ``k`` texts of an array."""
    return F.slice(texts, 1, k)


def join_texts(texts, k=SUMMARY_TEXTS):
    """The first ``k`` texts of an array in one text, parted by a dashed line."""
    return F.array_join(first_texts(texts, k), "\n---\n")
