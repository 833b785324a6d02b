"""Collects queries and the SQL that gives the same rows."""

from pyspark.sql import functions as F

from voxloom.sources.ingest import number_rows

QUERIES = {}
ORACLES = {}

VIEWS = """
feedback AS (
  SELECT event_id AS id, ts AS created_at,
    CASE user_id % 6 WHEN 0 THEN 'support' WHEN 1 THEN 'github' WHEN 2 THEN 'discord'
      WHEN 3 THEN 'twitter' WHEN 4 THEN 'forum' ELSE 'email' END AS channel,
    CASE WHEN event_id % 13 = 0 THEN NULL
      ELSE concat(event_type, ' report ', CAST(event_id AS VARCHAR)) END AS title,
    concat('user_', CAST(user_id AS VARCHAR)) AS author,
    CASE WHEN analyzed = 0 THEN 'pending' WHEN k > 60 THEN 'positive'
      WHEN k < 40 THEN 'negative' ELSE 'neutral' END AS sentiment,
    CASE WHEN analyzed = 0 THEN CAST(0 AS DOUBLE)
      ELSE (CAST(k AS DOUBLE) - CAST(50 AS DOUBLE)) / CAST(50 AS DOUBLE) END AS sentiment_score,
    CASE WHEN analyzed = 0 OR event_id % 29 = 0 THEN 'uncategorized'
      WHEN event_id % 31 = 0 THEN 'other' WHEN event_id % 37 = 0 THEN NULL
      WHEN event_type = 'error' THEN 'reliability' WHEN event_type = 'purchase' THEN 'pricing'
      WHEN event_type = 'signup' THEN 'documentation' WHEN event_type = 'view' THEN 'performance'
      WHEN user_id % 2 = 0 THEN 'developer-experience' ELSE 'feature-request' END AS theme,
    CASE WHEN analyzed = 0 THEN 'low' WHEN value > 150 THEN 'critical' WHEN value > 80 THEN 'high'
      WHEN value > 30 THEN 'medium' ELSE 'low' END AS urgency,
    CASE WHEN analyzed = 0 THEN 'medium' WHEN user_id % 5 = 0 THEN 'high'
      WHEN user_id % 5 < 3 THEN 'medium' ELSE 'low' END AS value_score,
    analyzed
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k,
          CASE WHEN event_id % 10 = 7 THEN 0 ELSE 1 END AS analyzed FROM events)),
feedback_text AS (
  SELECT f.*, d.text AS content FROM feedback f
  JOIN documents d ON d.doc_id = f.id % (SELECT count(*) FROM documents)),
multilabel AS (
  SELECT id, created_at, channel AS source, author AS user_id, sentiment_score,
    upper(sentiment) AS sentiment_label,
    CASE WHEN id % 50 = 0 THEN NULL WHEN id % 50 = 1 THEN 'not json'
      WHEN id % 50 = 2 THEN '{"a":1}' WHEN id % 50 = 3 THEN '[]'
      WHEN id % 3 = 0 THEN concat('["', coalesce(theme, 'other'), '"]')
      ELSE concat('["', coalesce(theme, 'other'), '","', value_score, '"]') END AS themes,
    CASE urgency WHEN 'critical' THEN 'high' ELSE urgency END AS priority
  FROM feedback),
multilabel_text AS (
  SELECT m.*, d.text FROM multilabel m
  JOIN documents d ON d.doc_id = m.id % (SELECT count(*) FROM documents)),
stored_feedback AS (SELECT *, CAST(created_at AS DATE) AS created_date FROM feedback_text),
stored_multilabel AS (SELECT *, CAST(created_at AS DATE) AS created_date FROM multilabel_text),
labelled AS (
  SELECT *, CASE WHEN themes IS NULL THEN CAST([] AS VARCHAR[])
      WHEN json_valid(themes) AND json_type(themes) = 'ARRAY'
      THEN from_json(themes, '["VARCHAR"]') END AS labels FROM multilabel),
incoming AS (
  SELECT doc_id AS id, text, CASE WHEN doc_id % 17 <> 0 THEN source END AS source,
    CASE WHEN doc_id % 5 = 0 THEN NULL WHEN doc_id % 5 = 1 THEN ''
      ELSE concat('user_', CAST(doc_id AS VARCHAR)) END AS user_id
  FROM documents),
words AS (
  SELECT id, text, source, user_id,
    string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
      'abcdefghijklmnopqrstuvwxyz'), '[^a-z]+') AS w FROM incoming),
hits AS (
  SELECT id, text, source, user_id,
    len(list_filter(w, lambda x: x IN ('the','and','la','best'))) AS positive,
    len(list_filter(w, lambda x: x IN ('of','is','le','worthless'))) AS negative,
    len(list_filter(w, lambda x: x IN ('worthless','qui'))) AS critical,
    len(list_filter(w, lambda x: x IN ('that','les'))) AS high,
    len(list_filter(w, lambda x: x IN ('on','en'))) AS performance,
    len(list_filter(w, lambda x: x IN ('for','un'))) AS pricing,
    len(list_filter(w, lambda x: x IN ('example','or','une'))) AS documentation,
    len(list_filter(w, lambda x: x IN ('by','des'))) AS reliability
  FROM words),
scored AS (
  SELECT *, CASE WHEN positive + negative > 0
      THEN CAST(positive - negative AS DOUBLE) / CAST(positive + negative AS DOUBLE)
      ELSE CAST(0 AS DOUBLE) END AS sentiment_score,
    greatest(performance, pricing, documentation, reliability) AS most FROM hits),
word_labels AS (
  SELECT id, text, source, user_id, sentiment_score,
    CASE WHEN sentiment_score > 0 THEN 'positive' WHEN sentiment_score < 0 THEN 'negative'
      ELSE 'neutral' END AS sentiment,
    CASE WHEN most = 0 THEN 'other' WHEN performance = most THEN 'performance'
      WHEN pricing = most THEN 'pricing' WHEN documentation = most THEN 'documentation'
      ELSE 'reliability' END AS theme,
    CASE WHEN critical > 0 THEN 'critical' WHEN high > 0 THEN 'high'
      WHEN sentiment_score < 0 THEN 'medium' ELSE 'low' END AS urgency,
    positive + negative + critical + high + most AS any_hit,
    positive, negative
  FROM scored),
classified AS (
  SELECT id, text, source, coalesce(nullif(user_id, ''), 'anonymous') AS user_id,
    CASE WHEN positive + negative > 0
      THEN CAST(greatest(positive, negative) AS DOUBLE) / CAST(positive + negative AS DOUBLE)
      ELSE CAST(0.5 AS DOUBLE) END AS sentiment_score,
    CASE WHEN positive + negative = 0 THEN 'NEUTRAL' WHEN positive >= negative THEN 'POSITIVE'
      ELSE 'NEGATIVE' END AS sentiment_label,
    '["general"]' AS themes, 'medium' AS priority
  FROM hits),
theme_totals AS (
  SELECT theme, count(*) AS total,
    count(*) FILTER (sentiment = 'positive') AS positive,
    count(*) FILTER (sentiment = 'negative') AS negative,
    count(*) FILTER (urgency = 'critical') AS critical,
    count(*) FILTER (urgency = 'high') AS high,
    round(round(avg(sentiment_score), 9), 6) AS avg_sentiment
  FROM feedback WHERE analyzed = 1 AND theme <> 'uncategorized' GROUP BY theme),
daily AS (
  SELECT CAST(created_at AS DATE) AS date, count(*) AS total,
    round(round(avg(sentiment_score), 9), 6) AS avg_sentiment,
    count(*) FILTER (sentiment = 'positive') AS positive,
    count(*) FILTER (sentiment = 'negative') AS negative
  FROM feedback WHERE analyzed = 1 GROUP BY 1 ORDER BY 1 DESC LIMIT 14),
theme_daily AS (
  SELECT theme, CAST(created_at AS DATE) AS date, count(*) AS count,
    round(round(avg(sentiment_score), 9), 6) AS avg_sentiment,
    count(*) FILTER (sentiment = 'positive') AS positive,
    count(*) FILTER (sentiment = 'neutral') AS neutral,
    count(*) FILTER (sentiment = 'negative') AS negative
  FROM feedback WHERE analyzed = 1 AND theme IS NOT NULL GROUP BY 1, 2),
rollup_rows AS (
  SELECT CAST(created_at AS DATE) AS metric_date, coalesce(theme, 'uncategorized') AS theme,
    count(*) AS total_count,
    count(*) FILTER (sentiment = 'positive') AS positive_count,
    count(*) FILTER (sentiment = 'neutral') AS neutral_count,
    count(*) FILTER (sentiment = 'negative') AS negative_count,
    count(*) FILTER (urgency = 'low') AS urgency_low,
    count(*) FILTER (urgency = 'medium') AS urgency_medium,
    count(*) FILTER (urgency = 'high') AS urgency_high,
    count(*) FILTER (urgency = 'critical') AS urgency_critical,
    round(round(avg(sentiment_score), 9), 6) AS avg_sentiment_score
  FROM feedback WHERE analyzed = 1 GROUP BY 1, 2),
label_counts AS (
  SELECT theme, count(*) AS count
  FROM (SELECT unnest(labels) AS theme FROM labelled) GROUP BY theme),
ranked_samples AS (
  SELECT f.*, CAST(row_number() OVER (PARTITION BY theme ORDER BY
      CASE urgency WHEN 'critical' THEN 1 WHEN 'high' THEN 2 WHEN 'medium' THEN 3 ELSE 4 END,
      created_at DESC, id DESC) AS INTEGER) AS rank
  FROM feedback f WHERE analyzed = 1 AND theme IS NOT NULL
  QUALIFY rank <= 10),
ranked_recent AS (
  SELECT f.*, CAST(row_number() OVER (PARTITION BY theme ORDER BY created_at DESC, id DESC)
      AS INTEGER) AS rank
  FROM feedback f WHERE analyzed = 1 AND theme IS NOT NULL
  QUALIFY rank <= 10),
recent_texts AS (
  SELECT r.theme, r.rank, r.id, d.text AS content FROM ranked_recent r
  JOIN documents d ON d.doc_id = r.id % (SELECT count(*) FROM documents)),
summary_prompts AS (
  SELECT theme, CAST(count(*) AS INTEGER) AS text_count,
    concat('Customers wrote the following about ',
      array_to_string(list_transform(string_split(theme, '-'),
        lambda x: concat(upper(x[1]), x[2:])), ' '),
      ', newest first:', chr(10), chr(10),
      string_agg(content, concat(chr(10), '---', chr(10)) ORDER BY rank),
      chr(10), chr(10), 'Sum this up for a product manager in two or three sentences: what hurts',
      ' or is wanted, what recurs, and what to do next.') AS prompt
  FROM recent_texts GROUP BY theme)
"""


def in_output_order(rows):
    """Number the rows in the order in which an operator gives them."""
    return number_rows(rows, 1, "rank").withColumn("rank", F.col("rank").cast("int"))


def registered(sql=None):
    """Register a query under its function's name.

    ``sql`` may start with WITH to add views of its own. Without ``sql`` the
    query has no SQL counterpart and is covered by tests.
    """

    def register(query):
        QUERIES[query.__name__] = query
        if sql is not None:
            text = sql.strip()
            if text.upper().startswith("WITH "):
                text = f"WITH {VIEWS.strip()},\n{text[5:]}"
            else:
                text = f"WITH {VIEWS.strip()}\n{text}"
            ORACLES[query.__name__] = text
        return query

    return register
