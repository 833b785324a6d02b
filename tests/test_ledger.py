"""Ids, named batches, loads and publications: once each, through failures and reruns."""

import json

import pytest
from pyspark.sql import functions as F

from tests.conftest import feedback_row, moment, rows_of
from tests.test_tables import plan_of
from verification import views
from voxloom.operators import from_rollup, metrics, rollup
from voxloom.schema import RECORD_PAYLOAD
from voxloom.sources import batches, daily, ledger, quarantine, tables
from voxloom.streaming import jobs

SF_DIR = "/root/testdata/sf0.001"
RECORD = "text string, source string, user_id string"


def texts(frame):
    return sorted(map(str, rows_of(frame.select(*sorted(frame.columns)))))


@pytest.fixture
def path(tmp_path):
    return str(tmp_path / "table")


def test_ids_go_on_and_a_batch_gets_its_own_again(spark, path):
    assert ledger.claim_ids(spark, path, "a", 0, 10, lambda: 41) == 42
    assert ledger.claim_ids(spark, path, "b", 0, 5, lambda: pytest.fail("asked twice")) == 52
    assert ledger.claim_ids(spark, path, "a", 0, 10) == 42
    assert ledger.claim_ids(spark, path, "a", 1, 0) == 57
    assert ledger.claim_ids(spark, path, "a", 2, 3) == 57
    for batch, count in ((2, 4), (1, 0)):
        with pytest.raises(ValueError):
            ledger.claim_ids(spark, path, "a", batch, count)
    ledger.release_claim(spark, path, "b")
    assert "b" not in ledger.read_state(spark, path)[1]["claims"]
    assert ledger.claim_ids(spark, path, "c", 0, 1) == 60


def test_only_one_writer_makes_a_change(spark, path):
    ledger.write_new(spark, ledger.state_file(path, 1), {"n": 1})
    with pytest.raises(ledger.Conflict):
        ledger.write_new(spark, ledger.state_file(path, 1), {"n": 2})
    assert ledger.read_state(spark, path) == (1, {"n": 1})
    met = []

    def change(state):
        if not met:
            met.append(1)
            ledger.write_new(spark, ledger.state_file(path, 2), {"n": state["n"] + 10})
        return {"n": state["n"] + 1}

    assert ledger.change_state(spark, path, change) == {"n": 12}


def test_the_ledger_stays_small(spark, path, tmp_path):
    for batch in range(20):
        ledger.claim_ids(spark, path, "run", batch, 1)
    assert len(list((tmp_path / "table").glob("*.json"))) == ledger.KEPT
    assert ledger.claim_ids(spark, path, "run", 20, 1) == 21


def test_a_batch_is_appended_once(spark, small, path, tmp_path):
    bare = small.drop("id", "urgency")
    for _ in range(2):
        assert batches.append_batch(bare, path, "north/1") == {"accepted": 8, "refused": 0}
    assert batches.append_batch(small.drop("id", "content"), path, "2") == {"accepted": 0, "refused": 8}
    batches.append_batch(bare, path, "3")
    ids = sorted(r["id"] for r in rows_of(tables.scan_feedback(spark, path).select("id")))
    assert ids == list(range(1, 17))
    refused = rows_of(quarantine.quarantined(spark, quarantine.quarantine_path(path)))
    assert {(r["batch"], r["reason"], tuple(r["details"])) for r in refused} == {("2", "missing", ("content",))}
    assert json.loads(refused[0]["record"])["channel"] and len(refused) == 8


def test_a_batch_whose_texts_stand_beside_the_table(spark, small, path):
    shared = spark.createDataFrame([(n, f"long text {n}") for n in range(4)], "text_id long, text string")
    tables.write_shared_texts(shared, path)
    n = F.col("id")
    named = small.drop("content").withColumns({
        "text_id": F.when(n != 2, n % 4), "channel": F.when(n != 3, F.col("channel"))
    })
    for _ in range(2):
        assert batches.append_batch(named, path, "1", texts=shared) == {"accepted": 6, "refused": 2}
    plain = named.join(shared, "text_id", "left").withColumnRenamed("text", "content").drop("text_id")
    batches.append_batch(plain.select(*small.columns), path + "-plain", "1")
    want = tables.scan_feedback(spark, path + "-plain")
    assert texts(tables.scan_feedback(spark, path, shared_texts=True)) == texts(want)
    assert "content" not in spark.read.parquet(f"{path}/batch=1").columns

    def refused(table):
        rows = rows_of(quarantine.quarantined(spark, quarantine.quarantine_path(table)))
        return sorted((r["details"], sorted(json.loads(r["record"]).items(), key=str)) for r in rows)

    assert refused(path) == refused(path + "-plain")
    assert [dict(record)["content"] for _, record in refused(path)] == ["long text 3", None]


def test_a_batch_that_broke_off_keeps_its_ids(spark, small, path, monkeypatch):
    bare = small.drop("id")
    finish = batches.finish_batch

    def break_off(*given, **notes):
        raise RuntimeError("lost")

    monkeypatch.setattr(batches, "finish_batch", break_off)
    with pytest.raises(RuntimeError):
        batches.append_batch(bare, path, "first")
    monkeypatch.setattr(batches, "finish_batch", finish)
    batches.append_batch(bare, path, "second")
    before = texts(tables.scan_feedback(spark, path).select("id", "channel"))
    batches.append_batch(bare, path, "first")
    assert texts(tables.scan_feedback(spark, path).select("id", "channel")) == before


def test_ids_begin_above_an_older_table(spark, small, path):
    tables.append_table(small, path)
    batches.append_batch(small.drop("id"), path, "first")
    ids = sorted(r["id"] for r in rows_of(tables.scan_feedback(spark, path).select("id")))
    assert ids == list(range(1, 17))


LINES = [
    '{"text":"good","source":"web"}', '{"text":"fine","source":"app","user_id":"u"}',
    '{"text":" ","source":"web"}', '{"text":"no source"}', '{"text":"cut', "", "[1]", "null",
    '{"text":"a","source":"b"} junk', "plain",
]


def test_every_line_is_accepted_or_set_aside(spark, path, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "lines.json").write_text("\n".join(LINES) + "\n")
    readable, unreadable = quarantine.split_lines(
        quarantine.read_lines(spark, str(tmp_path / "in")), RECORD_PAYLOAD
    )
    assert readable.count() + unreadable.count() == len(LINES)
    for _ in range(2):
        done = batches.append_lines(spark, str(tmp_path / "in"), path, "monday")
        assert done == {"accepted": 2, "refused": 8}
    found = {r["text"]: r["id"] for r in rows_of(spark.read.parquet(path))}
    assert found == {"good": 1, "fine": 2}
    aside = rows_of(quarantine.quarantined(spark, quarantine.quarantine_path(path)))
    unread = sorted(r["record"] for r in aside if r["reason"] == "unreadable")
    assert unread == sorted(LINES[4:])
    lacking = sorted(tuple(r["details"]) for r in aside if r["reason"] == "missing")
    assert lacking == [("source",), ("text",)]


def test_an_empty_quarantine(spark, path):
    assert rows_of(quarantine.quarantined(spark, path)) == []


def stream_records(spark, tmp_path, state, rows=None, **options):
    source = str(tmp_path / f"records-{state}")
    if rows:
        spark.createDataFrame(rows, RECORD).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(RECORD).options(**options).parquet(source)
    jobs.stream_ingest(stream, str(tmp_path / "table"), str(tmp_path / state)).awaitTermination()


def test_another_checkpoint_adds_to_the_table(spark, path, tmp_path):
    stream_records(spark, tmp_path, "c1", [("a", "s", None), ("b", "s", None), ("c", None, None)])
    stream_records(spark, tmp_path, "c2", [("d", "s", None)])
    stream_records(spark, tmp_path, "c1", [("e", "s", None)])
    found = {r["text"]: r["id"] for r in rows_of(jobs.ingested(spark, path))}
    assert sorted(found) == ["a", "b", "d", "e"] and sorted(found.values()) == [1, 2, 3, 4]
    assert [found["d"], found["e"]] == [3, 4]
    # The last batch of the first run again, after the other run's.
    (tmp_path / "c1" / "commits" / "1").unlink()
    (tmp_path / "c1" / "commits" / ".1.crc").unlink(missing_ok=True)
    stream_records(spark, tmp_path, "c1")
    assert {r["text"]: r["id"] for r in rows_of(jobs.ingested(spark, path))} == found
    assert len(rows_of(jobs.refused(spark, path))) == 1


def test_folding_ingested_batches_changes_no_row(spark, path, tmp_path):
    for n in range(4):
        stream_records(spark, tmp_path, "c1", [(f"a{n}", "s", None), (f"b{n}", None, "u")])
    stream_records(spark, tmp_path, "c2", [("c", "s", None)])

    def state():
        return texts(jobs.ingested(spark, path)), texts(jobs.refused(spark, path))

    before = state()
    # A base that was not finished does not count.
    spark.read.parquet(path).drop("run", "batch_id").write.partitionBy("accepted").parquet(
        jobs.batch_folder(path, "base-0", 0)
    )
    assert state() == before
    for _ in range(2):
        jobs.compact_ingested(spark, path)
        assert state() == before
    folders = [f for run in (tmp_path / "table").glob("run=*") for f in run.glob("batch_id=*")]
    assert len(folders) == 3
    stream_records(spark, tmp_path, "c1", [("last", "s", None)])
    assert sorted(r["id"] for r in rows_of(jobs.ingested(spark, path))) == list(range(1, 7))


def test_a_batch_reads_no_stored_rows(spark, path, tmp_path, monkeypatch):
    stream_records(spark, tmp_path, "c1", [("a", "s", None)])
    monkeypatch.setattr(jobs, "stored_ids", lambda *given: pytest.fail("stored rows were read"))
    stream_records(spark, tmp_path, "c1", [("b", "s", None)])
    assert sorted(r["id"] for r in rows_of(jobs.ingested(spark, path))) == [1, 2]


def scored(make_feedback, *ids, day=1, **given):
    return make_feedback(
        [feedback_row(n, created_at=moment(day), sentiment_score=n / 7, **given) for n in ids]
    )


def test_loads_add_to_a_key(spark, make_feedback, path):
    first, second = scored(make_feedback, 1, 2, 3), scored(make_feedback, 4, 5)
    for rows in (first, second):
        tables.load_rollup(rollup.rollup_parts(rows), path)
    want = texts(rollup.daily_rollup(first.unionByName(second)))
    assert texts(tables.scan_daily_metrics(spark, path)) == want


def test_a_named_load_counts_once(spark, make_feedback, path):
    parts = rollup.rollup_parts(scored(make_feedback, 1, 2))
    for _ in range(3):
        tables.load_rollup(parts, path, "monday")
    assert [r["total_count"] for r in rows_of(tables.scan_daily_metrics(spark, path))] == [2]


def test_keys_given_twice_in_one_load_are_one_row(spark, make_feedback, path):
    daily_rows = rollup.daily_rollup(scored(make_feedback, 1, 2))
    tables.load_rollup(daily_rows.unionByName(daily_rows), path)
    (row,) = rows_of(tables.scan_daily_metrics(spark, path))
    (once,) = rows_of(daily_rows)
    assert row["total_count"] == 4
    assert row["avg_sentiment_score"] == once["avg_sentiment_score"]


def test_a_table_without_score_sums_can_be_added_to(spark, make_feedback, path):
    first, second = scored(make_feedback, 1, 2, 3), scored(make_feedback, 4)
    rollup.daily_rollup(first).write.partitionBy("metric_date").parquet(path)
    tables.load_rollup(rollup.rollup_parts(second), path)
    (row,) = rows_of(tables.scan_daily_metrics(spark, path))
    assert row["total_count"] == 4
    assert row["avg_sentiment_score"] == pytest.approx(10 / 28, abs=1e-6)


@pytest.mark.parametrize("step", ["write_days", "finish_batch", "remove_folder"])
def test_a_load_that_broke_off_is_finished_by_the_next(spark, make_feedback, path, monkeypatch, step):
    first, second = scored(make_feedback, 1, 2, 3), scored(make_feedback, 4, 5)
    tables.load_rollup(rollup.rollup_parts(first), path, "first")
    working = getattr(daily, step)

    def break_off(*given, **more):
        if step != "write_days":
            working(*given, **more)
        raise RuntimeError("lost")

    monkeypatch.setattr(daily, step, break_off)
    with pytest.raises(RuntimeError):
        tables.load_rollup(rollup.rollup_parts(second), path, "second")
    monkeypatch.setattr(daily, step, working)
    tables.load_rollup(rollup.rollup_parts(second), path, "second")
    want = texts(rollup.daily_rollup(first.unionByName(second)))
    assert texts(tables.scan_daily_metrics(spark, path)) == want


@pytest.fixture
def streaming(spark, tmp_path):
    log, table, source = (str(tmp_path / name) for name in ("log", "table", "events"))

    def run(events):
        events.coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(events.schema).parquet(source)
        jobs.stream_daily_rollup(views.feedback_of(stream), log, str(tmp_path / "c")).awaitTermination()

    return run, log, table


def test_a_load_on_a_published_day_is_kept(spark, streaming):
    run, log, table = streaming
    events = views.table(spark, SF_DIR, "events")
    thirds = [events.filter(F.col("event_id") % 3 == n) for n in range(3)]
    run(thirds[0])
    jobs.publish_rollup(spark, log, table)
    tables.load_rollup(rollup.rollup_parts(views.feedback_of(thirds[1])), table)
    run(thirds[2])
    for _ in range(2):
        jobs.publish_rollup(spark, log, table)
        want = texts(rollup.daily_rollup(views.feedback_of(events)))
        assert texts(tables.scan_daily_metrics(spark, table)) == want


@pytest.mark.parametrize("step", ["write_days", "change_state"])
def test_a_publication_that_broke_off_counts_once(spark, streaming, monkeypatch, step):
    run, log, table = streaming
    events = views.table(spark, SF_DIR, "events")
    run(events)
    working = getattr(daily, step)
    calls = []

    def break_off(*given):
        calls.append(1)
        found = working(*given)
        # The second change of state is the one that ends it.
        if step == "write_days" or len(calls) == 2:
            raise RuntimeError("lost")
        return found

    monkeypatch.setattr(daily, step, break_off)
    with pytest.raises(RuntimeError):
        jobs.publish_rollup(spark, log, table)
    monkeypatch.setattr(daily, step, working)
    jobs.publish_rollup(spark, log, table)
    want = texts(rollup.daily_rollup(views.feedback_of(events)))
    assert texts(tables.scan_daily_metrics(spark, table)) == want


ANSWERS = [
    "overview_stats", "sentiment_distribution", "urgency_distribution", "theme_distribution",
    "theme_stats", "themes_needing_attention", "top_theme", "sentiment_trend",
]


def test_answers_from_the_rollup_equal_the_feedbacks(spark, streaming):
    run, log, table = streaming
    events = views.table(spark, SF_DIR, "events")
    quarters = [events.filter(F.col("event_id") % 4 == n) for n in range(4)]
    tables.load_rollup(rollup.rollup_parts(views.feedback_of(quarters[0])), table, "first")
    run(quarters[1])
    jobs.publish_rollup(spark, log, table)
    undated = quarters[3].withColumn(
        "ts", F.when(F.col("event_id") % 20 != 3, F.col("ts"))
    )
    run(quarters[2].unionByName(undated))
    everything = views.feedback_of(
        quarters[0].unionByName(quarters[1]).unionByName(quarters[2]).unionByName(undated)
    )
    live = jobs.live_parts(spark, log, table)
    for name in ANSWERS:
        got, want = (getattr(m, name)(rows) for m, rows in ((from_rollup, live), (metrics, everything)))
        assert [str(r) for r in rows_of(got.select(*want.columns))] == [str(r) for r in rows_of(want)] or (
            texts(got) == texts(want) and "distribution" in name
        ), name
        assert "events" not in plan_of(got)


def test_other_labels_are_told_together(spark, small):
    parts = rollup.rollup_parts(small)
    found = {r["sentiment"]: r["count"] for r in rows_of(from_rollup.sentiment_distribution(parts))}
    assert found == {"positive": 3, "neutral": 1, "negative": 2, "(other)": 1}
    urgent = {r["urgency"]: r["count"] for r in rows_of(from_rollup.urgency_distribution(parts))}
    assert urgent["(other)"] == 1 and sum(urgent.values()) == 7


def test_answers_from_nothing(spark, path):
    nothing = jobs.live_parts(spark, f"{path}-log", path)
    assert rows_of(from_rollup.sentiment_distribution(nothing)) == []
    (row,) = rows_of(from_rollup.overview_stats(nothing))
    assert row["total_feedback"] == 0 and row["positive"] is None
