"""Labelling through a model that answers, chatters, fails or is down."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from tests.conftest import rows_of
from voxloom.operators import enrich
from voxloom.operators.enrich import FALLBACK

GOOD = {"sentiment": "positive", "sentiment_score": 0.5, "theme": "pricing", "urgency": "low",
        "summary": "ok"}


def parsed(spark, *responses):
    frame = spark.createDataFrame([(r,) for r in responses], "raw_response string")
    return rows_of(enrich.parse_model_response(frame))


@pytest.mark.parametrize(
    "response",
    [json.dumps(GOOD), f"Sure:\n{json.dumps(GOOD, indent=2)}\nDone.", f"```{json.dumps(GOOD)}```"],
)
def test_good_responses(spark, response):
    assert parsed(spark, response) == [{**GOOD, "raw_response": None, "in_domain": True}]


@pytest.mark.parametrize(
    "response",
    ["", "no json", "{", "} {", "{bad}", '{"a":1} and {"b":2}', "{'a':1}", '{"a":1,}', None,
     '{"a":NaN}'],
)
def test_bad_responses_fall_back_and_are_kept(spark, response):
    wanted = {**FALLBACK, "summary": "Unable to parse AI response", "raw_response": response,
              "in_domain": True}
    assert parsed(spark, response) == [wanted]


def is_object(response):
    """Whether another strict parser reads the span from first to last brace."""
    start, end = response.find("{"), response.rfind("}")
    if start < 0 or end < start:
        return False
    try:
        json.loads(response[start : end + 1], parse_constant=lambda name: {}[name])
    except (ValueError, KeyError):
        return False
    return True


def test_responses_agree_with_another_strict_parser(spark):
    """Good responses with chatter around them and a few characters changed."""
    draw = random.Random(11)
    texts = []
    for _ in range(2000):
        text = draw.choice(["", "Sure! ", "{", "```"]) + json.dumps(GOOD) + draw.choice(
            ["", " done", "}", "\n"]
        )
        for _ in range(draw.choice([0, 1, 1, 2])):
            place = draw.randint(0, len(text))
            text = text[:place] + draw.choice(["", *'{}[],:" \\']) + text[place + 1 :]
        texts.append(text)
    frame = spark.createDataFrame(list(enumerate(texts)), "n int, raw_response string")
    for row in enrich.parse_model_response(frame).collect():
        assert (row["raw_response"] is None) == is_object(texts[row["n"]]), texts[row["n"]]


def test_values_are_not_corrected_but_flagged(spark):
    (row,) = parsed(spark, '{"sentiment":"furious","sentiment_score":7}')
    assert row == {"sentiment": "furious", "sentiment_score": 7.0, "theme": None, "urgency": None,
                   "summary": None, "raw_response": None, "in_domain": False}


def test_a_repeated_field_counts_with_its_last_value(spark):
    (row,) = parsed(spark, '{"urgency":"low","urgency":"high"}')
    assert row["urgency"] == "high" and row["raw_response"] is None


def test_repeated_fields_do_not_depend_on_a_hidden_setting(spark):
    key = "spark.sql.variant.allowDuplicateKeys"
    before = spark.conf.get(key, None)
    try:
        spark.conf.unset(key)
        (row,) = parsed(spark, '{"urgency":"low","urgency":"high"}')
        assert row["urgency"] == "high" and row["raw_response"] is None
        spark.conf.set(key, "false")
        with pytest.raises(ValueError):
            parsed(spark, '{"urgency":"low","urgency":"high"}')
    finally:
        spark.conf.set(key, before) if before else spark.conf.unset(key)


def load_picky_model():
    """Answers with the text itself, refuses 'boom' and takes no batch that holds it."""

    def reply(texts):
        if any("boom" in text for text in texts):
            raise RuntimeError("boom refused")
        return [json.dumps({**GOOD, "summary": text[-5:]}) for text in texts]

    return reply


def test_only_the_failing_text_gets_an_error(spark):
    rows = spark.createDataFrame([("first",), ("boom",), ("third",)], "content string").coalesce(1)
    found = rows_of(enrich.analyze(rows, load_picky_model))
    assert [r["summary"] for r in found] == ["first", "AI analysis unavailable", "third"]
    assert [r["error"] for r in found] == [None, "boom refused", None]
    failed = {name: found[1][name] for name in FALLBACK}
    assert failed == FALLBACK


@pytest.mark.parametrize("size", [1, 2, 7, 1000, 1024])
def test_one_bad_text_costs_few_calls(size):
    calls = []

    def model(texts):
        calls.append(len(texts))
        if "bad" in texts:
            raise RuntimeError("refused")
        return list(texts)

    texts = ["ok"] * size
    texts[size * 2 // 3] = "bad"
    replies = enrich.replies_of(model, texts, size)
    assert replies.count((None, "refused")) == 1 and replies.count(("ok", None)) == size - 1
    assert len(calls) <= 2 * math.ceil(math.log2(size)) + 1


def test_batches_are_cut_to_size():
    calls = []

    def model(texts):
        calls.append(len(texts))
        return texts

    assert len(enrich.replies_of(model, ["a"] * 25 + [None], 10)) == 26
    assert calls == [10, 10, 5]


def test_blank_texts_are_not_put_to_the_model(spark):
    rows = spark.createDataFrame([("",), (" \n",), ("x",)], "content string").coalesce(1)
    found = rows_of(enrich.analyze(rows, lambda: lambda texts: [json.dumps(GOOD)] * len(texts)))
    assert [r["error"] for r in found] == ["no text", "no text", None]


def test_summaries_of_payloads(spark):
    rows = spark.createDataFrame(
        [(1, ["a", " ", "b", None, "c"], "pricing"), (2, [], "other"), (3, None, "docs"), (4, ["x"], None)],
        "id int, feedbackTexts array<string>, theme string",
    )
    found = {
        r["id"]: r
        for r in rows_of(enrich.summarize_payloads(rows, lambda: lambda texts: texts, k=2))
    }
    assert found[1]["text_count"] == 2
    assert "\n\na\n---\nb\n\n" in found[1]["summary"] and "Pricing" in found[1]["summary"]
    for empty in (2, 3):
        assert (found[empty]["text_count"], found[empty]["summary"]) == (0, "No feedback to summarize.")
        assert found[empty]["error"] is None
    assert found[4]["text_count"] == 1


def test_summary_input_takes_as_many_texts_as_asked(make_feedback):
    from tests.conftest import feedback_row
    from voxloom.operators import drilldown

    recent = drilldown.recent_texts_per_theme(make_feedback([feedback_row(n) for n in range(25)]), 20)
    for k, wanted in [(10, 10), (20, 20), (30, 20)]:
        (row,) = rows_of(enrich.summary_input(recent, k))
        assert row["text_count"] == wanted and row["prompt"].count("\n---\n") == wanted - 1


def test_missing_texts_and_missing_replies(spark):
    def load():
        return lambda texts: [json.dumps(GOOD)] if texts != ["short"] else []

    rows = spark.createDataFrame([(None,), ("a",), ("b",), ("short",)], "t string").coalesce(1)
    found = rows_of(enrich.ask_model(rows, "t", load))
    assert [r["raw_response"] is not None for r in found] == [False, True, True, False]
    assert found[0]["error"] == "no text" and found[3]["error"]


def test_model_is_loaded_once_per_task(spark, tmp_path):
    log = str(tmp_path / "loads")

    def load():
        with open(log, "a") as lines:
            lines.write("x")
        return lambda texts: ["{}"] * len(texts)

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    try:
        rows = spark.range(0, 400, numPartitions=2).select(F.col("id").cast("string").alias("t"))
        assert enrich.ask_model(rows, "t", load).filter("raw_response = '{}'").count() == 400
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert open(log).read() == "xx"


def test_word_labels(spark):
    texts = ["Great, GREAT docs!", "It crashed: slow and broken", "a crash", "nothing", None,
             "greatness slowly"]
    rows = spark.createDataFrame([(t,) for t in texts], "content string")
    found = [
        (r["sentiment"], r["sentiment_score"], r["theme"], r["urgency"])
        for r in rows_of(enrich.label_batch(rows))
    ]
    assert found[:4] == [
        ("positive", 1.0, "documentation", "low"),
        ("negative", -1.0, "performance", "high"),
        ("negative", -1.0, "reliability", "critical"),
        ("neutral", 0.0, "other", "low"),
    ]
    assert found[5] == ("neutral", 0.0, "other", "low")


def test_the_whole_text_is_read(spark):
    long = "word " * 50000 + "crash"
    rows = spark.createDataFrame([(long,)], "content string")
    assert rows_of(enrich.label_batch(rows))[0]["urgency"] == "critical"


def test_ingest_defaults(spark):
    records = spark.createDataFrame(
        [("great", "web", ""), ("nothing", "app", None), ("bad", "app", "u1")],
        "text string, source string, user_id string",
    )
    found = rows_of(enrich.ingest_enriched(records, as_of="2024-02-01 00:00:00"))
    assert [(r["user_id"], r["sentiment_score"], r["sentiment_label"]) for r in found] == [
        ("anonymous", 1.0, "POSITIVE"), ("anonymous", 0.5, "NEUTRAL"), ("u1", 1.0, "NEGATIVE"),
    ]
    assert {(r["themes"], r["priority"], str(r["created_at"])) for r in found} == {
        ('["general"]', "medium", "2024-02-01 00:00:00"),
    }


def test_summaries_fall_back(spark):
    requested = spark.createDataFrame([("a",), ("b",), ("c",), (None,)], "theme string")
    summaries = spark.createDataFrame(
        [("a", "fine", None), ("b", None, "down")],
        "theme string, raw_response string, error string",
    )
    found = {r["theme"]: (r["summary"], r["error"])
             for r in rows_of(enrich.summary_or_default(requested, summaries))}
    nothing = ("No feedback to summarize.", None)
    failed = "Unable to generate AI summary. Please review the feedback manually."
    assert found == {"a": ("fine", None), "b": (failed, "down"), "c": nothing, None: nothing}
