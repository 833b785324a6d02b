"""What the physical plans must and must not contain."""

import re

import pytest

import __spark_entry__  # noqa: F401
from verification import views
from verification.registry import QUERIES
from tests.conftest import feedback_row, moment
from tests.test_tables import files_read
from voxloom.operators import drilldown, filters, metrics, topk
from voxloom.session import scratch_path, scratch_root, stored
from voxloom.sources import tables

SF_DIR = "/root/testdata/sf0.001"
STORING = {
    "scan_daily_metrics", "load_rollup", "upsert_daily", "append_batches",
    "date_partitioned_layout", "publish_rollup", "stream_daily_rollup", "stream_rollup_updates", "stream_ingest",
}
WITH_PYTHON = {
    "model_unavailable_fallback", "summary_or_default", "parse_model_replies", "summarize_payloads",
}


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - STORING))
def test_no_cross_joins_and_python_only_around_models(spark, name):
    text = plan(QUERIES[name](spark, SF_DIR))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert ("Python" in text) == (name in WITH_PYTHON)


def test_scans_read_needed_columns_only(spark):
    text = plan(metrics.channel_counts(views.feedback(spark, SF_DIR)))
    assert re.findall(r"ReadSchema: struct<([^>]*)>", text) == ["user_id:bigint"]


def test_filters_reach_the_scan_of_a_stored_table(spark, small, tmp_path):
    tables.append_table(small, str(tmp_path / "t"))
    rows = tables.scan_feedback(spark, str(tmp_path / "t"))
    text = plan(metrics.theme_stats(rows))
    assert "EqualTo(analyzed,1)" in text and "Not(EqualTo(theme,uncategorized))" in text
    assert "content" not in re.findall(r"ReadSchema: struct<([^>]*)>", text)[0]


def test_newest_rows_find_their_time_before_reading_texts(spark, small, tmp_path):
    tables.append_table(small, str(tmp_path / "t"))
    rows = tables.scan_feedback(spark, str(tmp_path / "t"))
    text = plan(topk.newest_n(rows.filter("theme = 'pricing'"), 5))
    first_pass = [s for s in re.findall(r"ReadSchema: struct<([^>]*)>", text) if "content" not in s]
    assert first_pass and set(first_pass) == {"created_at:timestamp_ntz,theme:string"}


def test_newest_rows_of_a_table_by_day_open_the_newest_folders(spark, small, tmp_path):
    tables.write_by_day(small, str(tmp_path / "t"))
    rows = tables.scan_feedback(spark, str(tmp_path / "t"), by_day=True)
    newest = topk.newest_n(rows, 3)
    assert [r["id"] for r in newest.collect()] == [8, 4, 3]
    assert re.search(r"PartitionFilters: [^\n]*created_date#\d+ >= [^\n]*ubquery", plan(newest))


def test_top_k_cuts_groups_before_each_shuffle(spark):
    narrow = drilldown.narrow_columns(views.feedback(spark, SF_DIR))
    text = plan(drilldown.most_urgent_of_themes(narrow))
    assert text.count("WindowGroupLimit") == 4
    limits = [m.start() for m in re.finditer(r"WindowGroupLimit .*Partial", text)]
    shuffles = [m.start() for m in re.finditer("Exchange hashpartitioning", text)]
    assert len(limits) == len(shuffles) == 2
    assert all(shuffle < limit for shuffle, limit in zip(shuffles, limits, strict=True))


def test_lists_sort_narrow_rows_and_fetch_whole_ones(spark, small, tmp_path):
    tables.append_table(small, str(tmp_path / "t"))
    rows = tables.scan_feedback(spark, str(tmp_path / "t"))
    for listed in [drilldown.samples_per_theme(rows), drilldown.recent_per_theme(rows),
                   drilldown.urgency_ordered_samples(rows, "pricing")]:
        text = plan(listed)
        assert "content" in text and "Window" not in text
        assert text.count("Exchange hashpartitioning") == 0
    narrow = plan(drilldown.most_urgent_of_themes(drilldown.narrow_columns(rows)))
    assert "content" not in narrow


@pytest.fixture
def thirty_days(spark, make_feedback, tmp_path):
    """Two rows a day over thirty days, one file a day; and the same as a plain table."""
    rows = [
        feedback_row(n, theme="ab"[n % 2], sentiment_score=n / 100, created_at=moment(n // 2 + 1))
        for n in range(60)
    ]
    tables.write_by_day(make_feedback(rows), str(tmp_path / "t"))
    return tables.scan_feedback(spark, str(tmp_path / "t"), by_day=True), make_feedback(rows)


PRUNED = {
    "recent_days": (lambda rows: filters.recent_days(rows, "2024-01-31 00:00:00", 7), 7),
    "weekly_avg_trend": (lambda rows: metrics.weekly_avg_trend(rows, "2024-01-31 00:00:00"), 7),
    "sentiment_trend": (lambda rows: metrics.sentiment_trend(rows, 5), 5),
    "theme_trend_one": (lambda rows: drilldown.theme_trend(rows, "a", 5), 5),
    "theme_trend": (lambda rows: drilldown.theme_trend(rows, days=5), 5),
    "theme_trend_short": (lambda rows: drilldown.theme_trend_short(rows, days=5), 5),
    "newest_n": (lambda rows: topk.newest_n(rows, 6), 4),
}


@pytest.mark.parametrize("name", PRUNED)
def test_tables_by_day_open_only_the_days_asked_for(thirty_days, name):
    by_day, plain = thirty_days
    run, days = PRUNED[name]
    found, wanted = run(by_day), run(plain)
    columns = [c for c in found.columns if c != "created_date"]
    assert sorted(map(str, found.select(*columns).collect())) == sorted(
        map(str, wanted.select(*columns).collect())
    )
    assert re.search(r"PartitionFilters: [^\n]*created_date", plan(found))
    asked = run(by_day)
    assert files_read(asked)[0] <= days


def test_aggregates_combine_before_the_shuffle(spark):
    text = plan(metrics.theme_stats(views.feedback(spark, SF_DIR)))
    assert text.count("partial_sum") >= 1 and text.count("hashpartitioning") == 1


def test_stored_rows_are_broadcast_when_small(spark):
    feedback = views.feedback(spark, SF_DIR)
    chosen = stored(drilldown.samples_and_recent(feedback), "t")
    fetched = topk.fetch_rows(feedback, chosen)
    semi_join, scan = plan(fetched).index("LeftSemi"), plan(fetched).index("FileScan")
    computed = plan(fetched).index("get_json_object")
    assert computed < semi_join < scan and "SortMergeJoin" not in plan(fetched)
    joined = views.with_content(stored(fetched, "t"), spark, SF_DIR)
    assert "BroadcastHashJoin" in plan(joined) and "BuildLeft" in plan(joined)
    assert "SortMergeJoin" not in plan(joined)


class ClusterSession:
    """Just what ``scratch_root`` asks of a session on a cluster."""

    class sparkContext:
        master = "yarn"

    class conf:
        @staticmethod
        def get(key, default):
            return default


def test_a_cluster_without_a_shared_folder_is_refused():
    with pytest.raises(ValueError):
        scratch_root(ClusterSession)


def test_a_session_in_one_process_keeps_one_folder_of_its_own():
    class Alone(ClusterSession):
        class sparkContext:
            master = "local[4]"
            applicationId = "test-alone"

    assert scratch_root(Alone) == scratch_root(Alone)
    Alone.sparkContext.master = "local-cluster[2,1,1024]"
    with pytest.raises(ValueError):
        scratch_root(Alone)


def test_scratch_folder_is_the_one_the_session_names(spark):
    assert scratch_root(spark) == spark.conf.get("spark.checkpoint.dir")
    assert scratch_path(spark, "a") != scratch_path(spark, "a")
