"""The dashboard's result documents as nested rows.

Each document starts from one scan that counts rows per combination of labels
("cells"). Grouping sets then turn the cells into all sections at once. Only
aggregates and lists of at most k rows end up in an array.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F

from voxloom.functions.measures import or_zero, rounded_mean, rows
from voxloom.operators.by_day import feedback_day
from voxloom.operators.drilldown import analyzed_themes, samples_and_recent
from voxloom.operators.filters import high_priority, theme_substring
from voxloom.operators.metrics import all_distributions
from voxloom.operators.topk import fetch_rows, newest_first, newest_n, ranked
from voxloom.schema import FEEDBACK, MULTILABEL, UNCATEGORIZED
from voxloom.session import stored

SCORE = "sentiment_score"
#: How many themes needing attention an overview lists.
ATTENTION = 5


def cells(feedback, *columns):
    """Rows, score sum and score count per combination of labels."""
    return feedback.groupBy(*columns).agg(
        rows().alias("n"), F.sum(SCORE).alias("score_sum"), F.count(SCORE).alias("score_n")
    )


def cell_mean(condition=None):
    scores, count = F.col("score_sum"), F.col("score_n")
    if condition is not None:
        scores, count = F.when(condition, scores), F.when(condition, count)
    return rounded_mean(F.try_divide(F.sum(scores), F.sum(count)))


def cell_tally(counted, condition=None):
    """Rows of the cells that meet ``counted``, out of those that meet ``condition``."""
    hit = F.when(counted, F.col("n")).otherwise(0)
    return F.sum(hit if condition is None else F.when(condition, hit))


def gathered(condition, *fields):
    """The matching rows' fields as an array, sorted by the fields in turn."""
    return F.sort_array(F.collect_list(F.when(condition, F.struct(*fields))))


def without(array, *names):
    return F.transform(array, lambda item: item.dropFields(*names))


def list_item(frame, schema):
    """A feedback row as a list item: columns in table order, the time as text."""
    names = [c for c in schema.names if c in frame.columns]
    to_the_second = F.substring(F.col("created_at").cast("string"), 1, 19)
    as_text = to_the_second.alias("created_at")
    return F.struct(*[as_text if c == "created_at" else F.col(c) for c in names])


def in_rank_order(item, condition=None):
    """Items gathered by the rank of their rows, of those rows that meet the condition."""
    ranked_item = F.struct("rank", item.alias("item"))
    if condition is not None:
        ranked_item = F.when(condition, ranked_item)
    ordered = F.sort_array(F.collect_list(ranked_item))
    return F.transform(ordered, lambda entry: entry["item"])


def overview_document(feedback):
    """{stats, topThemes[], channels[], topTheme} as one row."""
    analyzed = F.col("analyzed") == 1
    label = {name: F.col(name) for name in ["sentiment", "urgency"]}
    grouped = (
        cells(feedback, "analyzed", "theme", "channel", "sentiment", "urgency")
        .groupingSets([["theme"], ["channel"], []], "theme", "channel")
        .agg(
            F.grouping_id().alias("g"),
            F.sum("n").alias("all_rows"),
            F.sum(F.when(analyzed, F.col("n"))).alias("total"),
            cell_mean(analyzed).alias("avg_sentiment"),
            *[
                cell_tally(label["sentiment"] == s, analyzed).alias(s)
                for s in ["positive", "neutral", "negative"]
            ],
            *[cell_tally(label["urgency"] == u, analyzed).alias(u) for u in ["critical", "high"]],
        )
    )
    per_theme, per_channel, everything = (F.col("g") == bits for bits in [1, 2, 3])
    known = per_theme & (F.col("total") > 0) & (F.col("theme") != UNCATEGORIZED)
    urgent = (F.col("critical") + F.col("high")).alias("urgent_count")
    total, average = F.col("total").alias("count"), F.col("avg_sentiment")

    def overall(name):
        return F.max(F.when(everything, F.col(name)))

    most_urgent = [
        (-F.col("critical") - F.col("high")).alias("a"), (-F.col("total")).alias("b"), "theme"
    ]
    # Themes are free text: a top-k plan finds the few that are gathered.
    first = grouped.filter(known).select(*most_urgent, total, average, urgent)
    first = first.orderBy("a", "b", "theme").limit(ATTENTION)
    attention = first.agg(without(gathered(F.lit(True), *first.columns), "a", "b")).scalar()
    channels = gathered(
        per_channel, (-F.col("all_rows")).alias("a"), "channel", F.col("all_rows").alias("count")
    )
    largest = F.min_by(
        F.when(known, F.struct("theme", total, average, "positive", "negative", urgent)),
        F.when(known, F.struct(-F.col("total"), "theme")),
    )
    return grouped.agg(
        F.struct(
            or_zero(overall("total")).alias("total_feedback"),
            overall("positive").alias("positive"),
            overall("neutral").alias("neutral"),
            overall("negative").alias("negative"),
            overall("critical").alias("critical_count"),
            overall("high").alias("high_count"),
            overall("avg_sentiment").alias("avg_sentiment"),
        ).alias("stats"),
        attention.alias("topThemes"),
        without(channels, "a").alias("channels"),
        largest.alias("topTheme"),
    )


def distributions_document(feedback):
    """{sentiment[], urgency[], value[], theme[]} as one row."""
    counted = all_distributions(feedback)

    def section(dimension, name, *order):
        label = F.col("label").alias(name)
        items = gathered(F.col("dimension") == dimension, *order, label, "count")
        return without(items, "a") if order else items

    return counted.agg(
        section("sentiment", "sentiment").alias("sentiment"),
        section("urgency", "urgency").alias("urgency"),
        section("value", "value_score").alias("value"),
        section("theme", "theme", (-F.col("count")).alias("a")).alias("theme"),
    )


def theme_sections(feedback, days=14):
    """Per theme: stats, channels[] and trend[] over its latest dates."""
    date = feedback_day(feedback).alias("date")
    levels = ["critical", "high", "medium", "low"]
    grouped = (
        cells(analyzed_themes(feedback), "theme", "channel", date, "sentiment", "urgency")
        .groupingSets(
            [["theme"], ["theme", "channel"], ["theme", "date"]], "theme", "channel", "date"
        )
        .agg(
            F.grouping_id().alias("g"),
            F.sum("n").alias("total"),
            cell_mean().alias("avg_sentiment"),
            *[
                cell_tally(F.col("sentiment") == s).alias(s)
                for s in ["positive", "neutral", "negative"]
            ],
            *[cell_tally(F.col("urgency") == u).alias(u) for u in levels],
        )
    )
    whole, per_channel, per_date = (F.col("g") == bits for bits in [3, 1, 2])
    sentiments = ["positive", "neutral", "negative"]
    count = F.col("total").alias("count")
    # Only the latest dates are gathered, not a theme's whole history.
    newest = F.row_number().over(Window.partitionBy("theme", "g").orderBy(F.desc("date")))
    grouped = grouped.withColumn("place", newest)
    latest = gathered(
        per_date & (F.col("place") <= days), "date", count, "avg_sentiment", *sentiments
    )
    return grouped.groupBy("theme").agg(
        F.max(F.when(whole, F.struct("total", "avg_sentiment", *sentiments, *levels))).alias(
            "stats"
        ),
        gathered(per_channel, "channel", count).alias("channels"),
        latest.alias("trend"),
    )


def theme_documents(feedback, k=10, fetch=None):
    """{theme, stats, channels[], samples[], trend[], recentFeedbackTexts[]} per theme.

    ``fetch`` gets the ids of the rows listed per theme and returns these rows
    with all their columns; by default they come from ``feedback`` itself.
    """
    fetch = fetch or (lambda chosen: fetch_rows(feedback, stored(chosen, "listed")))
    listed = fetch(samples_and_recent(feedback, k))
    kind = F.col("kind")
    lists = listed.groupBy("theme").agg(
        in_rank_order(list_item(listed, FEEDBACK), kind == "samples").alias("samples"),
        in_rank_order(F.col("content"), kind == "recent").alias("recentFeedbackTexts"),
    )
    nested = theme_sections(feedback).join(lists, "theme", "left")

    def or_none(name):
        """A theme of which no row is listed has an empty list."""
        empty = F.array().cast(nested.schema[name].dataType)
        return F.coalesce(name, empty).alias(name)

    return nested.select(
        "theme", "stats", "channels", or_none("samples"), "trend", or_none("recentFeedbackTexts")
    )


def insights_document(multilabel, limit=10, fetch=None):
    """{totalFeedback, sentiment[], priority[], urgent[]} as one row."""
    fetch = fetch or (lambda chosen: chosen)
    counted = (
        multilabel.groupBy("sentiment_label", "priority")
        .agg(rows().alias("n"))
        .groupingSets([["sentiment_label"], ["priority"], []], "sentiment_label", "priority")
        .agg(F.grouping_id().alias("g"), F.sum("n").alias("count"))
    )
    urgent = fetch(ranked(high_priority(multilabel, limit), *newest_first()))
    listed = urgent.agg(in_rank_order(list_item(urgent, MULTILABEL)))
    return counted.agg(
        or_zero(F.max(F.when(F.col("g") == 3, F.col("count")))).alias("totalFeedback"),
        gathered(F.col("g") == 1, "sentiment_label", "count").alias("sentiment"),
        gathered(F.col("g") == 2, "priority", "count").alias("priority"),
    ).withColumn("urgent", listed.scalar())


def theme_match_document(multilabel, term, limit=20, fetch=None):
    """{theme, totalCount, feedback[]} of a label search as one row, also without a match."""
    fetch = fetch or (lambda chosen: chosen)
    matches = theme_substring(multilabel, term)
    newest = fetch(ranked(newest_n(matches, limit), *newest_first()))
    listed = newest.agg(in_rank_order(list_item(newest, MULTILABEL)))
    return matches.agg(F.lit(term).alias("theme"), rows().alias("totalCount")).withColumn(
        "feedback", listed.scalar()
    )


def as_json(documents, plain=()):
    """Each section of a document as JSON text; ``plain`` columns stay as they are."""
    return documents.select(
        *[
            F.col(c) if c in plain else F.to_json(c, {"ignoreNullFields": "false"}).alias(c)
            for c in documents.columns
        ]
    )
