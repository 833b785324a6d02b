"""Labelling and summarising feedback texts through a model the caller supplies.

The model is the only Python in a plan. It sees Arrow batches of one text
column; the other columns stay in the JVM. Each task builds the model once.
"""

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxloom.functions import wordscore
from voxloom.functions.json_text import braces_span, encode_label_array, strict_variant
from voxloom.functions.labels import (
    default_if_empty,
    default_if_zero,
    is_nonblank,
    theme_display_name,
)
from voxloom.functions.wordscore import WordLists
from voxloom.operators.drilldown import (
    SUMMARY_TEXTS,
    first_texts,
    join_texts,
    texts_by_theme,
)
from voxloom.schema import SENTIMENTS, THEMES, URGENCIES

# What a failed analysis or summary says, and the default labels.
PARSE_FAILURE_SUMMARY = "Unable to parse AI response"
MODEL_FAILURE_SUMMARY = "AI analysis unavailable"
NO_TEXTS_SUMMARY = "No feedback to summarize."
SUMMARY_FAILURE = "Unable to generate AI summary. Please review the feedback manually."
FALLBACK = {"sentiment": "neutral", "sentiment_score": 0.0, "theme": "other", "urgency": "medium"}
DEFAULT_USER = "anonymous"
DEFAULT_SCORE = 0.5
DEFAULT_SENTIMENT_LABEL = "NEUTRAL"
DEFAULT_LABELS = ["general"]
DEFAULT_PRIORITY = "medium"

ANALYSIS_FIELDS = {
    "sentiment": "string",
    "sentiment_score": "double",
    "theme": "string",
    "urgency": "string",
    "summary": "string",
}
REPLY = T.StructType(
    [T.StructField("raw_response", T.StringType()), T.StructField("error", T.StringType())]
)


def analysis_prompt(content):
    """The question put to a model about one feedback text."""
    before = (
        "Read the customer feedback below and label it.\n"
        "Reply with a single JSON object and nothing else. Its fields are:\n"
        f"sentiment: {', '.join(SENTIMENTS)};\n"
        "sentiment_score: a number between -1 and 1;\n"
        f"theme: {', '.join(THEMES)};\n"
        f"urgency: {', '.join(reversed(URGENCIES))};\n"
        "summary: one sentence.\n"
        "Feedback:\n"
    )
    return F.concat(F.lit(before), content)


def build_analysis_prompt(feedback, column="content"):
    return feedback.withColumn("prompt", analysis_prompt(F.col(column)))


NO_TEXT = (None, "no text")


#: Texts that a model gets at once.
MODEL_BATCH = 256


def ask_halving(model, texts):
    """(reply, error) per text; a batch that fails is halved until the bad texts stand alone.

    One bad text among n costs at most 2 log2(n) + 1 calls.
    """
    try:
        replies = list(model(texts))
        if len(replies) != len(texts):
            raise ValueError("the model must reply to each text")
        return [(reply, None) for reply in replies]
    except Exception as failure:
        if len(texts) == 1:
            return [(None, str(failure))]
    middle = len(texts) // 2
    return ask_halving(model, texts[:middle]) + ask_halving(model, texts[middle:])


def replies_of(model, texts, batch=MODEL_BATCH):
    """(reply, error) per text; missing texts are not put to the model."""
    asked = [text for text in texts if text is not None]
    replies = []
    for start in range(0, len(asked), batch):
        replies += ask_halving(model, asked[start : start + batch])
    given = iter(replies)
    return [NO_TEXT if text is None else next(given) for text in texts]


def ask_model(rows, column, load_model: Callable, batch=MODEL_BATCH, tasks=None):
    """Add ``raw_response`` and ``error`` of a model asked with the text of a column.

    ``load_model()`` runs once per task and returns a function from a list of
    texts to a list of replies, which gets ``batch`` texts at most. An exception
    becomes the row's error. ``tasks`` spreads the rows first, for scans that
    would leave the model to a few tasks.
    """
    if tasks:
        rows = rows.repartition(tasks)

    @F.pandas_udf(REPLY)
    def reply(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = load_model()
        for texts in batches:
            yield pd.DataFrame(
                replies_of(model, list(texts), batch), columns=REPLY.names, dtype=object
            )

    # Nondeterministic, so that Spark never asks twice about one row.
    asked = rows.withColumn("_reply", reply.asNondeterministic()(F.col(column)))
    return asked.select(*rows.columns, "_reply.*")


def in_domain():
    """True if all labels of an analysis are ones the dashboard knows."""
    return F.coalesce(
        F.col("sentiment").isin(*SENTIMENTS)
        & F.col("sentiment_score").between(-1.0, 1.0)
        & F.col("theme").isin(*THEMES)
        & F.col("urgency").isin(*URGENCIES),
        F.lit(False),
    )


def parse_model_response(replies):
    """Add the analysis fields found in ``raw_response``, or the fallback ones.

    The object is taken from the first to the last brace. Its values are kept
    as they come; ``in_domain`` tells which rows hold unknown labels. The raw
    response stays only where it could not be parsed.
    """
    parsed = replies.withColumn("_analysis", strict_variant(braces_span(F.col("raw_response"))))
    valid = F.col("_analysis").isNotNull()
    fallback = {**FALLBACK, "summary": PARSE_FAILURE_SUMMARY}
    fields = {
        name: F.when(
            valid, F.try_variant_get(F.col("_analysis"), f"$[0].{name}", kind)
        ).otherwise(F.lit(fallback[name]))
        for name, kind in ANALYSIS_FIELDS.items()
    }
    fields["raw_response"] = F.when(~valid, F.col("raw_response"))
    return parsed.withColumns(fields).withColumn("in_domain", in_domain()).drop("_analysis")


def model_unavailable_fallback(replies):
    """``parse_model_response`` that also answers for a model which raised an error."""
    failed = F.col("error").isNotNull()
    fallback = {**FALLBACK, "summary": MODEL_FAILURE_SUMMARY}
    return (
        parse_model_response(replies)
        .withColumns(
            {
                name: F.when(failed, F.lit(fallback[name])).otherwise(F.col(name))
                for name in ANALYSIS_FIELDS
            }
        )
        .withColumn("in_domain", in_domain())
    )


def analyze(feedback, load_model, column="content", batch=MODEL_BATCH, tasks=None):
    """Label a whole table: prompt, model, parsed fields, fallbacks.

    Texts that hold nothing but white space are not put to the model.
    """
    asked = F.when(is_nonblank(F.col(column)), analysis_prompt(F.col(column)))
    replies = ask_model(feedback.withColumn("prompt", asked), "prompt", load_model, batch, tasks)
    return model_unavailable_fallback(replies).drop("prompt")


def with_word_counts(rows, column, lists):
    """Add hits per word list; the text is searched once for all words."""
    found = rows.withColumn("_found", wordscore.listed_words(F.col(column), lists))
    groups = {
        "_positive": lists.positive,
        "_negative": lists.negative,
        "_critical": lists.critical,
        "_high": lists.high,
        **{f"_theme_{theme}": words for theme, words in lists.themes.items()},
    }
    counts = {name: wordscore.hits(F.col("_found"), words) for name, words in groups.items()}
    return found.withColumns(counts).drop("_found")


def label_batch(rows, column="content", lists=None):
    """Label a whole table with the native stand-in scorer."""
    lists = lists or WordLists()
    counted = with_word_counts(rows, column, lists)
    themes = {theme: F.col(f"`_theme_{theme}`") for theme in lists.themes}
    score = wordscore.balance(F.col("_positive"), F.col("_negative"))
    scored = counted.withColumn("sentiment_score", score)
    return scored.select(
        *rows.columns,
        wordscore.sentiment_of(F.col("sentiment_score")).alias("sentiment"),
        "sentiment_score",
        wordscore.theme_of(themes).alias("theme"),
        wordscore.urgency_of(F.col("_critical"), F.col("_high"), F.col("sentiment_score")).alias(
            "urgency"
        ),
    )


def classify_sentiment(rows, column="text", lists=None):
    """A two-class result per text: the stronger class and its share of the hits.

    Texts without a hit get score 0 and an empty label, which the defaults fill.
    """
    lists = lists or WordLists()
    # Only the two lists that decide are searched for.
    lists = WordLists(lists.positive, lists.negative, (), (), {})
    positive, negative = F.col("_positive"), F.col("_negative")
    hits = positive + negative
    share = F.greatest(positive, negative) / hits
    label = F.when(positive >= negative, "POSITIVE").otherwise("NEGATIVE")
    return with_word_counts(rows, column, lists).select(
        *rows.columns,
        F.when(hits > 0, share).otherwise(0.0).alias("score"),
        F.when(hits > 0, label).otherwise("").alias("label"),
    )


def sentiment_label_defaults(classified):
    """Classifier output as stored columns; 0 and empty labels give way to defaults."""
    kept = [c for c in classified.columns if c not in ["score", "label"]]
    return classified.select(
        *kept,
        default_if_zero(F.col("score"), DEFAULT_SCORE).alias("sentiment_score"),
        default_if_empty(F.col("label"), DEFAULT_SENTIMENT_LABEL).alias("sentiment_label"),
        encode_label_array(F.array(*map(F.lit, DEFAULT_LABELS))).alias("themes"),
        F.lit(DEFAULT_PRIORITY).alias("priority"),
    )


def utc_now():
    """The current UTC wall time, which is what a missing ``created_at`` becomes."""
    return F.convert_timezone(F.current_timezone(), F.lit("UTC"), F.localtimestamp())


def ingest_enriched(records, classify=classify_sentiment, as_of=None):
    """Records (text, source, user_id) as rows of the multi-label table."""
    created = F.lit(str(as_of)).cast("timestamp_ntz") if as_of else utc_now()
    return (
        sentiment_label_defaults(classify(records))
        .withColumn("user_id", default_if_empty(F.col("user_id"), DEFAULT_USER))
        .withColumn("created_at", created)
    )


def summary_prompt(theme, joined):
    before = F.concat(
        F.lit("Customers wrote the following about "),
        theme_display_name(theme),
        F.lit(", newest first:\n\n"),
    )
    after = F.lit(
        "\n\nSum this up for a product manager in two or three sentences: what hurts or is"
        " wanted, what recurs, and what to do next."
    )
    return F.concat(before, joined, after)


def summary_input(recent, k=SUMMARY_TEXTS):
    """Per theme, its ``k`` newest texts in one prompt; takes ``recent_texts_per_theme``."""
    return texts_by_theme(recent).select("theme", *summary_request("texts", k))


def summary_request(texts, k):
    """How many texts a summary is asked of, and the prompt."""
    chosen = F.array_size(first_texts(F.col(texts), k)).alias("text_count")
    return chosen, summary_prompt(F.col("theme"), join_texts(F.col(texts), k)).alias("prompt")


def summarize_payloads(payloads, load_model, k=SUMMARY_TEXTS, **asking):
    """Add ``text_count``, ``summary`` and ``error`` to requests of texts and their theme.

    ``payloads`` has the columns of ``SUMMARY_PAYLOAD``. Missing and blank texts
    are left out; a request without texts gets the fixed answer, not the model's.
    """
    given = F.coalesce("feedbackTexts", F.array().cast("array<string>"))
    count, prompt = summary_request("_texts", k)
    asked = (
        payloads.withColumn("_texts", F.filter(given, is_nonblank))
        .select(*payloads.columns, "_texts", count, prompt)
        .withColumn("prompt", F.when(F.col("text_count") > 0, F.col("prompt")))
    )
    answered = ask_model(asked, "prompt", load_model, **asking)
    silent = F.col("text_count") == 0
    return answered.select(
        *payloads.columns,
        "text_count",
        F.when(silent, NO_TEXTS_SUMMARY)
        .when(F.col("error").isNotNull(), SUMMARY_FAILURE)
        .otherwise(F.col("raw_response"))
        .alias("summary"),
        F.when(~silent, F.col("error")).alias("error"),
    )


def summary_or_default(requested, summaries):
    """A summary for each requested theme, with a fixed text where there is none.

    ``summaries`` holds theme, raw_response and error of a model asked with
    ``summary_input``; a theme without texts is not in it.
    """
    answered = summaries.select(
        "theme", F.lit(True).alias("_asked"), F.col("raw_response").alias("_reply"), "error"
    )
    return requested.join(answered, "theme", "left").select(
        "theme",
        F.when(F.col("_asked").isNull(), NO_TEXTS_SUMMARY)
        .when(F.col("error").isNotNull(), SUMMARY_FAILURE)
        .otherwise(F.col("_reply"))
        .alias("summary"),
        "error",
    )
