"""Queries that label, ingest and summarise texts."""

import json
import re

from pyspark.sql import functions as F

from verification import views
from verification.drilldown_queries import recent_texts
from verification.registry import registered
from verification.views import LISTS
from voxloom.functions.labels import UPPER
from voxloom.operators import enrich, metrics
from voxloom.schema import RECORD_PAYLOAD, SUMMARY_PAYLOAD
from voxloom.sources import tables

PROMPT = """concat('Read the customer feedback below and label it.', chr(10),
  'Reply with a single JSON object and nothing else. Its fields are:', chr(10),
  'sentiment: positive, neutral, negative;', chr(10),
  'sentiment_score: a number between -1 and 1;', chr(10),
  'theme: performance, pricing, documentation, developer-experience, reliability, ',
  'feature-request, other;', chr(10), 'urgency: low, medium, high, critical;', chr(10),
  'summary: one sentence.', chr(10), 'Feedback:', chr(10), text)"""


@registered(f"SELECT id, text, source, user_id, {PROMPT} AS prompt FROM incoming")
def build_analysis_prompt(spark, sf_dir):
    return enrich.build_analysis_prompt(views.incoming(spark, sf_dir), "text")


@registered(
    """
    SELECT event_id AS id,
      CASE event_id % 7 WHEN 0 THEN 'positive' WHEN 1 THEN 'negative' WHEN 5 THEN 'furious'
        ELSE 'neutral' END AS sentiment,
      CAST(CASE event_id % 7 WHEN 0 THEN 0.5 WHEN 1 THEN -0.75 WHEN 5 THEN 0.25 ELSE 0 END
        AS DOUBLE) AS sentiment_score,
      CASE event_id % 7 WHEN 0 THEN 'pricing' WHEN 1 THEN 'reliability' WHEN 5 THEN 'misc'
        ELSE 'other' END AS theme,
      CASE event_id % 7 WHEN 0 THEN 'low' WHEN 1 THEN 'critical' WHEN 5 THEN 'low'
        ELSE 'medium' END AS urgency,
      CASE event_id % 7 WHEN 0 THEN 'ok' WHEN 1 THEN 'a {b} c' WHEN 5 THEN 'x'
        ELSE 'Unable to parse AI response' END AS summary,
      CASE event_id % 7 WHEN 2 THEN 'no json here' WHEN 3 THEN '{bad json}'
        WHEN 4 THEN '{"sentiment":"neutral"} and }' END AS raw_response,
      event_id % 7 <> 5 AS in_domain
    FROM events
    """
)
def parse_model_response(spark, sf_dir):
    return enrich.parse_model_response(views.model_responses(spark, sf_dir))


@registered(
    """
    WITH listed AS (SELECT id, len(list_filter(w, lambda x: x IN ('the','and','la','best','of',
        'is','le','worthless','qui','that','les','on','en','for','un','example','or','une','by',
        'des'))) AS n FROM words)
    SELECT id, CASE WHEN n = 0 THEN 'neutral' ELSE sentiment END AS sentiment,
      CASE WHEN n = 0 THEN CAST(0 AS DOUBLE) ELSE sentiment_score END AS sentiment_score,
      CASE WHEN n = 0 THEN 'other' ELSE theme END AS theme,
      CASE WHEN n = 0 THEN 'medium' ELSE urgency END AS urgency,
      CASE WHEN n = 0 THEN 'Unable to parse AI response'
        ELSE concat(CAST(n AS VARCHAR), ' listed words') END AS summary,
      CAST(NULL AS VARCHAR) AS raw_response, TRUE AS in_domain
    FROM word_labels JOIN listed USING (id)
    """
)
def parse_model_replies(spark, sf_dir):
    """The replies of a model to the given texts, parsed; it gives none to some."""
    asked = enrich.build_analysis_prompt(views.incoming(spark, sf_dir), "text")
    replies = enrich.ask_model(asked, "prompt", load_word_model)
    return enrich.parse_model_response(replies.select("id", "raw_response"))


LABELLED = """SELECT id, text, source, user_id, sentiment, sentiment_score, theme, urgency
    FROM word_labels"""


@registered(LABELLED)
def label_batch(spark, sf_dir):
    return enrich.label_batch(views.incoming(spark, sf_dir), "text", views.LISTS)


def load_word_model():
    """A stand-in for a language model: JSON replies made from the word lists.

    It wraps the JSON in chatter, and raises for texts without any listed word.
    """
    lists = LISTS
    pattern = re.compile("(?<![a-z])(?:" + "|".join(lists.all_words()) + ")(?![a-z])")
    fold = str.maketrans(UPPER, UPPER.lower())

    def reply(prompt):
        found = pattern.findall(prompt.split("Feedback:\n", 1)[1].translate(fold))
        if not found:
            raise RuntimeError("no listed word")
        count = {word: found.count(word) for word in set(found)}

        def total(words):
            return sum(count.get(word, 0) for word in words)

        positive, negative = total(lists.positive), total(lists.negative)
        both = positive + negative
        score = (positive - negative) / both if both else 0.0
        themes = {name: total(words) for name, words in lists.themes.items()}
        theme = max(themes, key=themes.get)
        urgency = "low" if score >= 0 else "medium"
        if total(lists.high):
            urgency = "high"
        if total(lists.critical):
            urgency = "critical"
        analysis = {
            "sentiment": "positive" if score > 0 else "negative" if score < 0 else "neutral",
            "sentiment_score": score,
            "theme": theme if themes[theme] else "other",
            "urgency": urgency,
            "summary": f"{len(found)} listed words",
        }
        return f"Here it is: {json.dumps(analysis)}"

    return lambda prompts: [reply(prompt) for prompt in prompts]


@registered(
    """
    WITH listed AS (SELECT id, len(list_filter(w, lambda x: x IN ('the','and','la','best','of',
        'is','le','worthless','qui','that','les','on','en','for','un','example','or','une','by',
        'des'))) AS n FROM words)
    SELECT id, text, source, user_id,
      CASE WHEN n = 0 THEN 'neutral' ELSE sentiment END AS sentiment,
      CASE WHEN n = 0 THEN CAST(0 AS DOUBLE) ELSE sentiment_score END AS sentiment_score,
      CASE WHEN n = 0 THEN 'other' ELSE theme END AS theme,
      CASE WHEN n = 0 THEN 'medium' ELSE urgency END AS urgency,
      CASE WHEN n = 0 THEN 'AI analysis unavailable'
        ELSE concat(CAST(n AS VARCHAR), ' listed words') END AS summary,
      CAST(NULL AS VARCHAR) AS raw_response,
      CASE WHEN n = 0 THEN 'no listed word' END AS error, TRUE AS in_domain
    FROM word_labels JOIN listed USING (id)
    """
)
def model_unavailable_fallback(spark, sf_dir):
    tasks = spark.sparkContext.defaultParallelism
    return enrich.analyze(views.incoming(spark, sf_dir), load_word_model, "text", tasks=tasks)


@registered(
    """
    SELECT id, CASE WHEN k = 0 THEN CAST(0.5 AS DOUBLE) ELSE k / 100.0::DOUBLE END
        AS sentiment_score,
      CASE WHEN k < 50 THEN 'NEUTRAL' ELSE 'POSITIVE' END AS sentiment_label,
      '["general"]' AS themes, 'medium' AS priority
    FROM (SELECT event_id AS id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events)
    """
)
def sentiment_label_defaults(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("int")
    classified = views.table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        (k / 100.0).alias("score"),
        F.when(k < 25, "").when(k >= 50, "POSITIVE").alias("label"),
    )
    return enrich.sentiment_label_defaults(classified)


@registered("SELECT *, TIMESTAMP '2024-01-31 00:00:00' AS created_at FROM classified")
def ingest_enriched(spark, sf_dir):
    return enrich.ingest_enriched(
        views.incoming(spark, sf_dir),
        lambda records: enrich.classify_sentiment(records, "text", views.LISTS),
        as_of=views.AS_OF,
    )


@registered(
    """
    SELECT id, CASE WHEN id % 7 <> 0 THEN text END AS text,
      CASE WHEN id % 7 <> 0 THEN source END AS source,
      CASE WHEN id % 7 <> 0 THEN user_id END AS user_id
    FROM incoming
    """
)
def parse_payload(spark, sf_dir):
    payload = F.to_json(F.struct("text", "source", "user_id"))
    broken = F.concat(payload, F.lit(" junk"))
    bodies = views.incoming(spark, sf_dir).select(
        "id", F.when(F.col("id") % 7 == 0, broken).otherwise(payload).alias("body")
    )
    return tables.parse_payload(bodies, "body", RECORD_PAYLOAD).drop("body")


@registered("SELECT * FROM summary_prompts")
def summary_input(spark, sf_dir):
    return enrich.summary_input(recent_texts(spark, sf_dir))


@registered(
    """
    WITH given AS (SELECT doc_id AS id, lang AS theme,
        CASE WHEN doc_id % 13 = 0 THEN NULL WHEN doc_id % 11 = 0 THEN CAST([] AS VARCHAR[])
          ELSE string_split(text, chr(10)) END AS texts FROM documents),
    cut AS (SELECT id, theme, coalesce(list_filter(texts, lambda x: trim(x) <> ''),
        CAST([] AS VARCHAR[]))[1:4] AS texts FROM given)
    SELECT id, theme, CAST(len(texts) AS INTEGER) AS text_count,
      CASE WHEN len(texts) = 0 THEN 'No feedback to summarize.'
        WHEN theme = 'es' THEN
          'Unable to generate AI summary. Please review the feedback manually.'
        ELSE concat('A prompt of ', CAST(length(concat('Customers wrote the following about ',
          upper(theme[1]), theme[2:], ', newest first:', chr(10), chr(10),
          array_to_string(texts, concat(chr(10), '---', chr(10))), chr(10), chr(10),
          'Sum this up for a product manager in two or three sentences: what hurts',
          ' or is wanted, what recurs, and what to do next.')) AS VARCHAR), ' characters.')
      END AS summary,
      CASE WHEN len(texts) > 0 AND theme = 'es' THEN 'model is down' END AS error
    FROM cut
    """
)
def summarize_payloads(spark, sf_dir):
    """Requests that bring their own texts: the lines of each document, some without any."""
    doc = F.col("doc_id")
    texts = (
        F.when(doc % 13 == 0, None)
        .when(doc % 11 == 0, F.array().cast("array<string>"))
        .otherwise(F.split("text", "\n"))
    )
    body = F.to_json(F.struct(texts.alias("feedbackTexts"), F.col("lang").alias("theme")))
    bodies = views.table(spark, sf_dir, "documents").select(doc.alias("id"), body.alias("body"))
    payloads = tables.parse_payload(bodies, "body", SUMMARY_PAYLOAD).drop("body")
    answered = enrich.summarize_payloads(payloads, lambda: load_summary_model(" about Es, "), k=4)
    return answered.drop("feedbackTexts")


def load_summary_model(failing=" about Other, "):
    """A stand-in that tells the length of its prompt, and fails on one theme."""

    def reply(prompt):
        if failing in prompt:
            raise RuntimeError("model is down")
        return f"A prompt of {len(prompt)} characters."

    return lambda prompts: [reply(prompt) for prompt in prompts]


@registered(
    """
    SELECT t.theme,
      CASE WHEN p.theme IS NULL THEN 'No feedback to summarize.'
        WHEN t.theme = 'other'
        THEN 'Unable to generate AI summary. Please review the feedback manually.'
        ELSE concat('A prompt of ', CAST(length(p.prompt) AS VARCHAR), ' characters.')
      END AS summary,
      CASE WHEN t.theme = 'other' THEN 'model is down' END AS error
    FROM (SELECT DISTINCT theme FROM feedback) t LEFT JOIN summary_prompts p USING (theme)
    """
)
def summary_or_default(spark, sf_dir):
    requested = metrics.counts_by(views.feedback(spark, sf_dir), "theme").select("theme")
    asked = enrich.ask_model(
        enrich.summary_input(recent_texts(spark, sf_dir)), "prompt", load_summary_model
    )
    return enrich.summary_or_default(requested, asked)
