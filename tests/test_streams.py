"""Streams against the batch operators, over several batches, reruns and restarts."""

import pytest
from pyspark.sql import functions as F

from tests.conftest import rows_of
from tests.test_tables import plan_of
from verification import views
from voxloom.operators import rollup
from voxloom.operators.enrich import classify_sentiment, ingest_enriched
from voxloom.sources import tables
from voxloom.streaming import jobs

SF_DIR = "/root/testdata/sf0.001"


def texts(frame):
    return sorted(map(str, rows_of(frame.select(*sorted(frame.columns)))))


@pytest.fixture
def event_files(spark, tmp_path):
    """``events`` as six files in order of time."""
    events = views.table(spark, SF_DIR, "events")
    path = str(tmp_path / "events")
    for part in range(6):
        low, high = F.lit(f"2024-01-{part * 5 + 1:02}"), F.lit(f"2024-01-{part * 5 + 6:02}")
        day = F.to_date("ts")
        events.filter((day >= low) & (day < high)).coalesce(1).write.mode("append").parquet(path)
    return events, path


STREAMS = {
    "parts": (jobs.stream_daily_rollup, jobs.current_rollup, {}),
    "updates": (jobs.stream_rollup_updates, jobs.latest_updates, {}),
}


@pytest.fixture(params=STREAMS)
def rollup_stream(request, spark, event_files, tmp_path):
    """(run, read, events, path): run a rollup stream to its end, read its result."""
    start, read, options = STREAMS[request.param]
    events, path = event_files

    def run():
        stream = (
            spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(path)
        )
        feedback = views.feedback_of(stream)
        start(feedback, str(tmp_path / "log"), str(tmp_path / "state"), **options).awaitTermination()

    return run, lambda: texts(read(spark, str(tmp_path / "log"))), events, path


def test_rollup_stream_equals_batch(rollup_stream):
    run, read, events, _ = rollup_stream
    run()
    assert read() == texts(rollup.daily_rollup(views.feedback_of(events)))


def test_late_rows_update_their_day_after_a_restart(rollup_stream):
    run, read, events, path = rollup_stream
    run()
    late = events.filter("event_type = 'error'").withColumn("event_id", F.col("event_id") + 10000)
    late.coalesce(1).write.mode("append").parquet(path)
    run()
    assert read() == texts(rollup.daily_rollup(views.feedback_of(events.unionByName(late))))


def test_a_batch_that_runs_again_changes_nothing(rollup_stream, tmp_path):
    run, read, _, _ = rollup_stream
    run()
    before = read()
    commits = tmp_path / "state" / "commits"
    last = max(commits.glob("[0-9]*"), key=lambda commit: int(commit.name))
    last.unlink()
    (commits / f".{last.name}.crc").unlink(missing_ok=True)
    run()
    assert read() == before


def test_published_rollup(spark, event_files, tmp_path):
    events, path = event_files
    stream = spark.readStream.schema(events.schema).parquet(path)
    log, table = str(tmp_path / "log"), str(tmp_path / "daily")
    jobs.stream_daily_rollup(
        views.feedback_of(stream), log, str(tmp_path / "state")
    ).awaitTermination()
    for _ in range(2):
        jobs.publish_rollup(spark, log, table)
        stored = tables.scan_daily_metrics(spark, table)
        assert texts(stored) == texts(rollup.daily_rollup(views.feedback_of(events)))


def part_of(events, low, high):
    return events.filter(f"dayofmonth(ts) >= {low} AND dayofmonth(ts) < {high}")


@pytest.fixture
def publishing(spark, tmp_path):
    """(run, table): stream events into the log; the published table."""
    log, table = str(tmp_path / "log"), str(tmp_path / "daily")
    path = str(tmp_path / "arriving")

    def run(events, state="state"):
        events.coalesce(1).write.mode("append").parquet(path)
        stream = spark.readStream.schema(events.schema).parquet(path)
        jobs.stream_daily_rollup(
            views.feedback_of(stream), log, str(tmp_path / state)
        ).awaitTermination()

    return run, log, table


def test_publishing_keeps_what_was_loaded_by_batch(spark, publishing):
    run, log, table = publishing
    events = views.table(spark, SF_DIR, "events")
    loaded, streamed = part_of(events, 1, 20), part_of(events, 10, 32).withColumn(
        "event_id", F.col("event_id") + 10_000
    )
    everything = rollup.daily_rollup(views.feedback_of(loaded.unionByName(streamed)))
    tables.load_rollup(rollup.daily_rollup(views.feedback_of(loaded)), table)
    run(streamed)
    for _ in range(2):
        jobs.publish_rollup(spark, log, table)
        found = tables.scan_daily_metrics(spark, table)
        counts = [c for c in found.columns if c != "avg_sentiment_score"]
        assert texts(found.select(*counts)) == texts(everything.select(*counts))
    joined = found.alias("f").join(everything.alias("e"), ["metric_date", "theme"])
    gap = F.max(F.abs(F.col("f.avg_sentiment_score") - F.col("e.avg_sentiment_score")))
    assert joined.agg(gap).first()[0] < 1e-5


def test_publishing_rows_told_to_the_log_is_exact(spark, publishing):
    run, log, table = publishing
    events = views.table(spark, SF_DIR, "events")
    loaded = views.feedback_of(part_of(events, 1, 20))
    tables.load_rollup(rollup.daily_rollup(loaded), table)
    jobs.log_loaded(loaded, log, "first")
    late = part_of(events, 5, 8).withColumn("event_id", F.col("event_id") + 10_000)
    wanted = texts(rollup.daily_rollup(views.feedback_of(events.unionByName(late))))
    run(part_of(events, 20, 32))
    jobs.publish_rollup(spark, log, table)
    jobs.compact_log(spark, log)
    run(late)
    jobs.publish_rollup(spark, log, table)
    jobs.compact_log(spark, log)
    assert texts(tables.scan_daily_metrics(spark, table)) == wanted
    assert texts(jobs.current_rollup(spark, log)) == wanted


def test_publishing_touches_the_days_of_new_batches_only(spark, publishing, tmp_path):
    run, log, table = publishing
    events = views.table(spark, SF_DIR, "events")
    run(part_of(events, 1, 32))
    jobs.publish_rollup(spark, log, table)
    folder = tmp_path / "daily" / "metric_date=2024-01-03"
    before = sorted(f.name for f in folder.iterdir())
    run(part_of(events, 5, 6))
    jobs.publish_rollup(spark, log, table)
    assert sorted(f.name for f in folder.iterdir()) == before


def test_folding_leaves_one_folder_and_an_unfinished_one_does_not_count(spark, publishing, tmp_path):
    run, log, table = publishing
    events = views.table(spark, SF_DIR, "events")
    for low in (1, 11, 21):
        run(part_of(events, low, low + 10 if low < 21 else 32))
    jobs.publish_rollup(spark, log, table)
    wanted = texts(jobs.current_rollup(spark, log))
    unfinished = jobs.parts_log(spark, log).drop("run", "batch_id")
    unfinished.write.parquet(jobs.batch_folder(log, "base-9", 0))
    assert texts(jobs.current_rollup(spark, log)) == wanted
    jobs.compact_log(spark, log)
    assert texts(jobs.current_rollup(spark, log)) == wanted
    batches = [f for run in (tmp_path / "log").glob("run=*") for f in run.glob("batch_id=*")]
    assert sorted(f.parent.name for f in batches) == ["run=base-0", "run=base-9"]


def test_another_checkpoint_is_another_run(spark, publishing):
    run, log, _ = publishing
    events = views.table(spark, SF_DIR, "events")
    run(part_of(events, 1, 10), "first")
    # The second run reads the first one's files again and adds to the log.
    run(part_of(events, 10, 32), "second")
    assert jobs.parts_log(spark, log).select("run").distinct().count() == 2
    total = jobs.current_rollup(spark, log).agg(F.sum("total_count")).first()[0]
    once = rollup.daily_rollup(views.feedback_of(events)).agg(F.sum("total_count")).first()[0]
    twice = rollup.daily_rollup(views.feedback_of(part_of(events, 1, 10)))
    assert total == once + twice.agg(F.sum("total_count")).first()[0]


def test_no_row_is_too_late_for_the_parts(spark, tmp_path):
    """The newest day comes first, in a batch of its own."""
    events = views.table(spark, SF_DIR, "events")
    path = str(tmp_path / "events")
    newest = F.to_date("ts") == F.lit("2024-01-30")
    for part in [newest, ~newest]:
        events.filter(part).coalesce(1).write.mode("append").parquet(path)
        stream = spark.readStream.schema(events.schema).parquet(path)
        jobs.stream_daily_rollup(
            views.feedback_of(stream), str(tmp_path / "log"), str(tmp_path / "state")
        ).awaitTermination()
    wanted = texts(rollup.daily_rollup(views.feedback_of(events)))
    assert texts(jobs.current_rollup(spark, str(tmp_path / "log"))) == wanted


def test_ingest_stream_equals_batch(spark, tmp_path):
    documents = views.table(spark, SF_DIR, "documents")
    path = str(tmp_path / "documents")
    documents.repartition(5).write.parquet(path)

    def enrich(records):
        return ingest_enriched(
            records, lambda rows: classify_sentiment(rows, "text", views.LISTS), views.AS_OF
        )

    def run():
        stream = (
            spark.readStream.schema(documents.schema).option("maxFilesPerTrigger", 2).parquet(path)
        )
        incoming = views.incoming_of(stream).drop("id")
        jobs.stream_ingest(
            incoming, str(tmp_path / "rows"), str(tmp_path / "state"), enrich
        ).awaitTermination()

    run()
    run()
    incoming = views.incoming_of(documents).drop("id")
    accepted = jobs.ingested(spark, str(tmp_path / "rows"))
    assert texts(accepted.drop("id")) == texts(enrich(incoming.filter("source IS NOT NULL")))
    ids = sorted(r["id"] for r in rows_of(accepted.select("id")))
    assert ids == list(range(1, len(ids) + 1))
    rejected = jobs.refused(spark, str(tmp_path / "rows"))
    assert {tuple(r["missing"]) for r in rows_of(rejected)} == {("source",)}
    assert accepted.count() + rejected.count() == documents.count()


def test_blank_texts_are_set_aside_and_a_batch_that_runs_again_keeps_its_ids(spark, tmp_path):
    schema = "text string, source string, user_id string"
    path = str(tmp_path / "records")
    batches = [
        [("a", "s", None), (" \t", "s", "u"), (None, "s", "u")],
        [("b", "s", "u"), ("c", None, "u")],
    ]

    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
        jobs.stream_ingest(stream, str(tmp_path / "rows"), str(tmp_path / "state")).awaitTermination()

    for batch in batches:
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(path)
        run()
    found = {r["text"]: r["id"] for r in rows_of(jobs.ingested(spark, str(tmp_path / "rows")))}
    assert found == {"a": 1, "b": 2}
    missing = [r["missing"] for r in rows_of(jobs.refused(spark, str(tmp_path / "rows")))]
    assert sorted(missing) == [["source"], ["text"], ["text"]]
    commits = tmp_path / "state" / "commits"
    (commits / "1").unlink()
    (commits / ".1.crc").unlink(missing_ok=True)
    run()
    again = {r["text"]: r["id"] for r in rows_of(jobs.ingested(spark, str(tmp_path / "rows")))}
    assert again == found


def test_days_do_not_depend_on_the_session_zone(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        row = spark.sql("SELECT TIMESTAMP_NTZ '2024-01-05 00:30:00' AS t").select(
            jobs.utc_date(jobs.as_utc(F.col("t"))).alias("d")
        )
        assert str(row.collect()[0]["d"]) == "2024-01-05"
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_rows_of_a_run_stay_in_their_tasks(spark, tmp_path):
    """Nothing is folded: a join with folded batches would bring a run's rows into one task."""
    path = str(tmp_path / "rows")
    records = spark.createDataFrame([("a", "web", "u"), (None, "web", "u")], "text string, source string, user_id string")
    records.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(records.schema).parquet(str(tmp_path / "in"))
    enrich = lambda rows: classify_sentiment(rows, "text", views.LISTS)
    jobs.stream_ingest(stream, path, str(tmp_path / "state"), enrich).awaitTermination()
    accepted, refused = jobs.ingested(spark, path), jobs.refused(spark, path)
    assert [r["text"] for r in rows_of(accepted)] == ["a"] and len(rows_of(refused)) == 1
    for rows in [accepted, refused]:
        assert "Join" not in plan_of(rows) and "Exchange" not in plan_of(rows)
    assert rows_of(jobs.folded(spark, path)) == [] and jobs.folded(spark, path).schema.names == jobs.COVERS.names
