"""Stored tables: batches, defaults, required columns, ids, rollups, layout."""

import datetime as dt
import glob
import json
import re

import pytest
from pyspark.sql import functions as F

from tests.conftest import feedback_row, moment, rows_of
from voxloom.operators import drilldown, metrics, rollup
from voxloom.operators.topk import fetch_rows
from voxloom.plans import documents
from voxloom.schema import CONTENT_PAYLOAD, FEEDBACK, RECORD_PAYLOAD, SUMMARY_PAYLOAD
from voxloom import session
from voxloom.sources import ingest, tables


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def files_read(frame):
    """The number of files each scan opens when a query first runs."""
    frame.collect()
    names = []

    def visit(node):
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            return visit(node.executedPlan())
        if "QueryStage" in name:
            return visit(node.plan())
        if name.startswith("Scan parquet"):
            names.append(node.metrics().apply("numFiles").value())
        children = node.children()
        for place in range(children.size()):
            visit(children.apply(place))

    visit(frame._jdf.queryExecution().executedPlan())
    return names


def test_defaults_fill_omitted_columns_not_nulls(spark):
    batch = spark.createDataFrame([("web", "hi", None)], "channel string, content string, theme string")
    (row,) = rows_of(ingest.apply_defaults(batch))
    created = row.pop("created_at")
    assert abs(created - dt.datetime.now(dt.UTC).replace(tzinfo=None)) < dt.timedelta(minutes=5)
    assert row == {
        "channel": "web", "content": "hi", "theme": None, "title": None, "author": None,
        "sentiment": "pending", "sentiment_score": 0.0, "urgency": "low", "value_score": "medium",
        "analyzed": 0,
    }


def test_batches_land_in_one_table(spark, small, tmp_path):
    path = str(tmp_path / "feedback")
    bare = small.drop("urgency", "title")
    for batch in [small, bare]:
        accepted, rejected = ingest.append_batches([batch])
        tables.append_table(accepted, path)
        assert rejected.isEmpty()
    stored = tables.scan_feedback(spark, path)
    assert stored.columns == FEEDBACK.names
    assert stored.count() == 16
    assert stored.filter("title IS NULL").count() == 8
    together, _ = ingest.append_batches([small, bare])
    assert sorted(map(str, rows_of(together.select(*FEEDBACK.names)))) == sorted(
        map(str, rows_of(stored))
    )


def test_batches_without_required_columns_are_set_aside(small):
    accepted, rejected = ingest.append_batches([small, small.drop("content")])
    assert accepted.count() == rejected.count() == 8
    assert {tuple(r["missing"]) for r in rows_of(rejected)} == {("content",)}


def test_blank_counts_as_missing_where_asked(spark):
    rows = spark.createDataFrame([("a", " "), (" ", "b"), (None, "c")], "text string, source string")
    accepted, rejected = ingest.split_required(rows, ["text", "source"], nonblank=["text"])
    assert [r["text"] for r in rows_of(accepted)] == ["a"]
    assert [r["missing"] for r in rows_of(rejected)] == [["text"], ["text"]]


def test_records_get_ids_above_the_table(spark):
    records = spark.createDataFrame(
        [("good", "web", None), ("", "web", "u"), ("fine", "app", "u")],
        "text string, source string, user_id string",
    )
    table = spark.createDataFrame([(41,)], "id long")
    accepted, rejected = ingest.ingest_records(records, table)
    assert {r["text"]: r["id"] for r in rows_of(accepted)} == {"good": 42, "fine": 43}
    assert [r["missing"] for r in rows_of(rejected)] == [["text"]]


def test_rollup_rows_without_a_date_are_given_back(make_feedback, spark, tmp_path):
    daily = rollup.daily_rollup(make_feedback([feedback_row(1), feedback_row(2, created_at=None)]))
    rejected = tables.load_rollup(daily, str(tmp_path / "daily"))
    assert [r["missing"] for r in rows_of(rejected)] == [["metric_date"]]
    assert tables.scan_daily_metrics(spark, str(tmp_path / "daily")).count() == 1


def test_rows_without_required_columns_are_set_aside(spark):
    rows = spark.createDataFrame(
        [(1, "web", "a"), (2, None, "b"), (3, "web", None), (4, None, None)],
        "id long, channel string, content string",
    )
    accepted, rejected = ingest.split_required(rows)
    assert [r["id"] for r in rows_of(accepted)] == [1]
    assert {r["id"]: r["missing"] for r in rows_of(rejected)} == {
        2: ["channel"], 3: ["content"], 4: ["channel", "content"],
    }


@pytest.mark.parametrize("stored", [True, False])
def test_ids_are_unique_increasing_and_above_the_table(spark, small, empty, stored):
    batch = spark.range(1000, numPartitions=7).withColumnRenamed("id", "n")
    table = small if stored else empty
    ids = [r["id"] for r in ingest.assign_ids(batch, table).orderBy("n").collect()]
    first = 9 if stored else 1
    assert ids == list(range(first, first + 1000))


def test_payloads(spark, tmp_path):
    bodies = spark.createDataFrame(
        [('{"text":"a","source":"web"}',), ('{"text":"a"} junk',), ("",), (None,), ('{"text":5}',),
         ('[{"text":"a"}]',)],
        "body string",
    )
    found = rows_of(tables.parse_payload(bodies, "body", RECORD_PAYLOAD).drop("body"))
    nothing = {"text": None, "source": None, "user_id": None}
    assert found == [
        {"text": "a", "source": "web", "user_id": None}, nothing, nothing, nothing,
        {**nothing, "text": "5"}, nothing,
    ]
    bodies = spark.createDataFrame([('{"theme":"docs","feedbackTexts":["a",null]}',)], "body string")
    assert rows_of(tables.parse_payload(bodies, "body", SUMMARY_PAYLOAD).drop("body")) == [
        {"feedbackTexts": ["a", None], "theme": "docs"},
    ]
    path = tmp_path / "payloads.json"
    path.write_text('{"feedbackTexts":["a","b"],"theme":"pricing"}\n{"theme":"docs"}\n')
    assert rows_of(tables.read_payloads(spark, str(path), SUMMARY_PAYLOAD)) == [
        {"feedbackTexts": ["a", "b"], "theme": "pricing"}, {"feedbackTexts": None, "theme": "docs"},
    ]
    path.write_text('{"content":"hello"}\n')
    assert rows_of(tables.read_payloads(spark, str(path), CONTENT_PAYLOAD)) == [{"content": "hello"}]


def test_rollup_adds_up_to_theme_totals(small):
    daily = rollup.daily_rollup(small)
    totals = {r["theme"]: r["n"] for r in rows_of(daily.groupBy("theme").agg(F.sum("total_count").alias("n")))}
    assert totals == {"pricing": 2, "reliability": 2, "API-docs": 1, "uncategorized": 2}
    known = {r["theme"]: r["total"] for r in rows_of(metrics.theme_stats(small))}
    assert known == {theme: n for theme, n in totals.items() if theme != "uncategorized"}


def test_upsert_replaces_touched_dates_only(spark, make_feedback, tmp_path):
    path = str(tmp_path / "daily")
    first = [feedback_row(1), feedback_row(2, created_at=moment(2)), feedback_row(3, created_at=moment(3))]
    late = [feedback_row(4, theme="docs", created_at=moment(2)), feedback_row(5, created_at=moment(4))]
    tables.load_rollup(rollup.daily_rollup(make_feedback(first)), path)
    untouched = set(glob.glob(f"{path}/metric_date=2024-01-01/*.parquet"))
    everything = make_feedback(first + late)
    for _ in range(2):
        dates = rollup.touched_dates(make_feedback(late))
        tables.overwrite_dates(rollup.rollup_of_dates(everything, dates), path)
        stored = tables.scan_daily_metrics(spark, path)
        assert sorted(map(str, rows_of(stored))) == sorted(map(str, rows_of(rollup.daily_rollup(everything))))
    assert set(glob.glob(f"{path}/metric_date=2024-01-01/*.parquet")) == untouched


def test_upsert_empties_days_without_rows(spark, make_feedback, tmp_path):
    path = str(tmp_path / "daily")
    rows = [feedback_row(n, created_at=moment(n)) for n in (1, 2, 3)]
    tables.load_rollup(rollup.daily_rollup(make_feedback(rows)), path)
    left = make_feedback([rows[0], {**rows[1], "analyzed": 0}, rows[2]])
    dates = rollup.touched_dates(make_feedback(rows[1:]))
    tables.overwrite_dates(rollup.rollup_of_dates(left, dates), path, dates)
    days = [r["metric_date"].day for r in rows_of(tables.scan_daily_metrics(spark, path))]
    assert sorted(days) == [1, 3]


def test_duplicate_rollup_rows_keep_the_last_version(spark, small):
    daily = rollup.daily_rollup(small).withColumn("version", F.lit(1))
    newer = daily.withColumns({"version": F.lit(2), "total_count": F.lit(99).cast("long")})
    found = rows_of(rollup.dedupe_daily(daily.unionByName(newer), "version"))
    assert len(found) == daily.count() and {r["total_count"] for r in found} == {99}


def test_table_by_day_prunes_partitions(spark, small, tmp_path):
    path = str(tmp_path / "by_day")
    tables.write_by_day(small, path)
    stored = tables.scan_feedback(spark, path, by_day=True)
    assert sorted(map(str, rows_of(stored.drop("created_date")))) == sorted(map(str, rows_of(small)))
    late = small.filter("id = 8")
    recomputed = rollup.rollup_of_dates(stored, rollup.touched_dates(late))
    assert [r["theme"] for r in rows_of(recomputed)] == ["API-docs"]
    assert re.search(r"PartitionFilters: [^\n]*array_contains\([^\n]*ubquery", plan_of(recomputed))
    assert files_read(rollup.rollup_of_dates(stored, rollup.touched_dates(late))) == [1]


def test_dates_of_a_plain_table(spark, small, tmp_path):
    path = str(tmp_path / "plain")
    tables.append_table(small, path)
    dates = rollup.touched_dates(small.filter("id IN (3, 8)"))
    recomputed = rollup.rollup_of_dates(tables.scan_feedback(spark, path), dates)
    assert sorted((r["metric_date"].day, r["theme"]) for r in rows_of(recomputed)) == [
        (2, "reliability"), (5, "API-docs"),
    ]


def document_row(documents_frame):
    (row,) = rows_of(documents_frame)
    return row


def test_overview_document_holds_what_the_parts_hold(small):
    found = document_row(documents.overview_document(small))
    assert found["stats"] == rows_of(metrics.overview_stats(small))[0]
    assert found["topThemes"] == rows_of(metrics.themes_needing_attention(small))
    assert found["channels"] == rows_of(metrics.channel_counts(small))
    assert found["topTheme"] == rows_of(metrics.top_theme(small))[0]


def test_documents_of_nothing(empty):
    found = document_row(documents.overview_document(empty))
    assert found["stats"]["total_feedback"] == 0 and found["stats"]["positive"] is None
    assert found["topThemes"] == [] and found["channels"] == [] and found["topTheme"] is None
    assert document_row(documents.distributions_document(empty)) == {
        "sentiment": [], "urgency": [], "value": [], "theme": [],
    }
    assert documents.theme_documents(empty).count() == 0


def test_documents_of_pending_rows(small):
    pending = small.withColumn("analyzed", F.lit(0))
    found = document_row(documents.overview_document(pending))
    assert found["stats"]["total_feedback"] == 0 and found["stats"]["negative"] is None
    assert found["topThemes"] == [] and len(found["channels"]) == 3


def test_theme_documents_hold_what_the_parts_hold(small):
    found = {r["theme"]: r for r in rows_of(documents.theme_documents(small, k=2))}
    assert set(found) == {"pricing", "reliability", "API-docs", "uncategorized"}
    for theme, document in found.items():
        assert document["stats"] == rows_of(drilldown.theme_detail_stats(small, theme))[0]
        assert document["trend"] == rows_of(drilldown.theme_trend(small, theme))
        channels = rows_of(drilldown.theme_channels(small, theme).orderBy("channel"))
        assert document["channels"] == channels
        samples = rows_of(drilldown.urgency_ordered_samples(small, theme, 2))
        assert [s["id"] for s in document["samples"]] == [s["id"] for s in samples]
    assert found["pricing"]["recentFeedbackTexts"] == ["text 2", "text 1"]
    assert found["pricing"]["samples"][0]["created_at"] == "2024-01-01 00:01:00"
    assert list(found["pricing"]["samples"][0]) == FEEDBACK.names


def test_theme_documents_without_listed_rows_keep_their_themes(small):
    found = rows_of(documents.theme_documents(small, k=0))
    assert {d["theme"] for d in found} == {"pricing", "reliability", "API-docs", "uncategorized"}
    assert all(d["samples"] == [] and d["recentFeedbackTexts"] == [] for d in found)


def test_theme_documents_of_a_table_by_day_open_the_listed_days_only(spark, make_feedback, tmp_path):
    """The 2 newest rows of both themes are on 2 of 20 days, one file each."""
    path = str(tmp_path / "by_day")
    rows = [feedback_row(n, theme="ab"[n % 2], created_at=moment(n // 2 + 1)) for n in range(40)]
    tables.write_by_day(make_feedback(rows), path)
    stored_rows = tables.scan_feedback(spark, path, by_day=True)
    chosen = session.stored(drilldown.samples_and_recent(stored_rows, 2), "t")
    fetched = fetch_rows(stored_rows, chosen)
    assert {(r["theme"], r["kind"], r["rank"], r["id"]) for r in rows_of(fetched)} == {
        (theme, kind, rank, id)
        for kind in ["samples", "recent"]
        for theme, ids in [("a", [38, 36]), ("b", [39, 37])]
        for rank, id in enumerate(ids, 1)
    }
    assert max(files_read(fetch_rows(stored_rows, chosen))) == 2
    (a, b) = sorted(rows_of(documents.theme_documents(stored_rows, 2)), key=lambda d: d["theme"])
    assert a["recentFeedbackTexts"] == ["text 38", "text 36"]
    assert b["samples"][0]["id"] == 39


def test_documents_are_written_with_their_nulls(empty, tmp_path):
    path = str(tmp_path / "documents")
    tables.write_documents(documents.overview_document(empty), path)
    (text,) = [line for name in glob.glob(f"{path}/*.json") for line in open(name)]
    assert json.loads(text)["topTheme"] is None
    assert json.loads(text)["stats"]["positive"] is None
