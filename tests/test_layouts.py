"""Clustered layout, label dictionary, kept replies."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tests.conftest import feedback_row, moment, rows_of
from tests.test_tables import plan_of
from verification import (
    dashboard_queries,
    layout_queries,
    multilabel_queries,
    table_queries,
    views,
)
from voxloom.operators import drilldown, enrich, filters, label_search, replies, topk
from voxloom.sources import clustered, tables

SF_DIR = "/root/testdata/sf0.001"


def texts(frame):
    return sorted(map(str, rows_of(frame.select(*sorted(frame.columns)))))


def rows_scanned(frame):
    """Rows that the scan of a query hands on, after row groups are skipped."""
    frame.collect()
    found = []

    def visit(node):
        if node.nodeName() == "AdaptiveSparkPlan":
            return visit(node.executedPlan())
        if node.nodeName().startswith("Scan parquet"):
            found.append(node.metrics().apply("numOutputRows").value())
        for place in range(node.children().size()):
            visit(node.children().apply(place))

    visit(frame._jdf.queryExecution().executedPlan())
    return sum(found)


@pytest.fixture(scope="module")
def one_day(spark, make_feedback):
    """Many rows of one day over all combinations of eight themes, three sentiments, six channels."""
    row = feedback_row(0, content="x" * 50)
    base = make_feedback([row])
    n = F.col("n")
    return spark.range(60_000).withColumnRenamed("id", "n").crossJoin(F.broadcast(base)).select(
        n.alias("id"),
        "created_at", F.concat(F.lit("channel "), (n % 6).cast("string")).alias("channel"), "title",
        F.sha2(n.cast("string"), 256).alias("content"), "author",
        F.concat(F.lit("sentiment "), (n % 3).cast("string")).alias("sentiment"), "sentiment_score",
        F.concat(F.lit("theme "), F.floor(n / 7 % 8).cast("string")).alias("theme"),
        "urgency", "value_score", "analyzed",
    )


def test_every_column_prunes(spark, one_day, tmp_path):
    curve, sorted_path = str(tmp_path / "curve"), str(tmp_path / "sorted")
    small = 1 << 18
    clustered.write_clustered(one_day.coalesce(1), curve, row_group_bytes=small)
    spark.conf.set("parquet.block.size", small)
    try:
        tables.write_by_day(one_day.coalesce(1), sorted_path)
    finally:
        spark.conf.unset("parquet.block.size")
    whole = tables.scan_feedback(spark, curve, by_day=True)
    assert texts(whole.drop("created_date")) == texts(one_day)
    for column, label in [("channel", "channel 4"), ("theme", "theme 5"), ("sentiment", "sentiment 2")]:
        hits = whole.filter(F.col(column) == label)
        assert hits.count() == one_day.filter(F.col(column) == label).count()
        assert rows_scanned(hits.select("id")) < 0.75 * 60_000, column
    channel = F.col("channel") == "channel 4"
    in_turn = rows_scanned(tables.scan_feedback(spark, sorted_path, by_day=True).filter(channel).select("id"))
    assert rows_scanned(whole.filter(channel).select("id")) < in_turn
    none = rows_scanned(whole.filter(F.col("channel") == "channel 44").select("id"))
    assert none == 0


#: Hexadecimal digits hardly compress, so files tell how often a text is stored.
DIGITS = "array_join(transform(sequence(0, 300), k -> sha2(concat(doc_id, ' ', k), 256)), '')"


@pytest.fixture(scope="module")
def sharing(spark, tmp_path_factory):
    """300 events of three days over documents of which one is missing, one doubled, one NULL."""
    sf_dir = str(tmp_path_factory.mktemp("sharing"))
    docs = spark.range(10).withColumnRenamed("id", "doc_id").select(
        F.when(F.col("doc_id") == 9, 8).otherwise(F.col("doc_id")).alias("doc_id"),
        F.when(F.col("doc_id") != 3, F.expr(DIGITS)).alias("text"),
        F.lit("en").alias("lang"), F.lit("web").alias("source"), F.lit(1).cast("long").alias("n_chars"),
    )
    docs.coalesce(1).write.parquet(f"{sf_dir}/documents.parquet")
    n = F.col("id")
    spark.range(300).select(
        n.alias("event_id"),
        F.when(n != 50, F.timestamp_add("hour", (n % 72).cast("int"), F.lit(moment(1)).cast("timestamp_ntz"))).alias("ts"),
        n.alias("user_id"), F.when(n % 2 == 0, "error").otherwise("view").alias("event_type"),
        (n % 200).cast("double").alias("value"), F.concat(F.lit('{"k": '), (n % 100).cast("string"), F.lit("}")).alias("props"),
    ).coalesce(1).write.parquet(f"{sf_dir}/events.parquet")
    return sf_dir


def folder_bytes(folder):
    return sum(f.stat().st_size for f in Path(folder).rglob("*.parquet"))


@pytest.mark.parametrize("query", [
    dashboard_queries.scan_feedback, table_queries.date_partitioned_layout, layout_queries.clustered_layout,
    multilabel_queries.array_only,
])
def test_stored_tables_hold_each_text_once(spark, sharing, tmp_path, monkeypatch, query):
    monkeypatch.setattr(views, "scratch_path", lambda spark, name: str(tmp_path / name))
    monkeypatch.setattr(layout_queries, "scratch_path", views.scratch_path)
    monkeypatch.setattr(table_queries, "scratch_path", views.scratch_path)
    monkeypatch.setattr(views, "WRITTEN", {})
    if query is multilabel_queries.array_only:
        want = filters.array_only(views.with_text(views.multilabel(spark, sharing), spark, sharing))
    else:
        want = views.with_content(views.feedback(spark, sharing), spark, sharing)
    if query is layout_queries.clustered_layout:
        want = want.filter("channel = 'forum' AND sentiment = 'negative'")
    found = query(spark, sharing)
    assert texts(found.drop("created_date")) == texts(want) != []
    days = found.filter("created_date <=> to_date(created_at)").count()
    assert days == found.count()
    # With a text in every row each day would hold the documents again.
    assert folder_bytes(tmp_path) < 2 * folder_bytes(f"{sharing}/documents.parquet")


def test_lists_of_stored_rows_are_cut_before_their_texts(spark, sharing):
    newest = topk.newest_n(views.stored_feedback(spark, sharing), 5)
    want = topk.newest_n(views.with_content(views.feedback(spark, sharing), spark, sharing), 5)
    assert texts(newest.select(*want.columns)) == texts(want)
    trend = plan_of(drilldown.theme_trend(views.stored_feedback(spark, sharing)))
    assert "text_id" in trend and "text:string" not in trend and "content" not in trend


def test_curve_and_ranks(spark, small):
    pairs = spark.range(16).select(F.floor(F.col("id") / 4).cast("int").alias("a"), (F.col("id") % 4).cast("int").alias("b"))
    placed = pairs.select("a", "b", clustered.curve([F.col("a"), F.col("b")], 2).alias("p")).collect()
    want = {(a, b): sum(((a >> i) & 1) << (2 * i) | ((b >> i) & 1) << (2 * i + 1) for i in range(2)) for a in range(4) for b in range(4)}
    assert {(r.a, r.b): r.p for r in placed} == want
    ranks = small.select("theme", clustered.label_ranks(small, "theme").alias("r")).distinct().collect()
    known = sorted((r.theme, r.r) for r in ranks if r.theme is not None)
    assert [r for _, r in known] == sorted(r for _, r in known) and {r.r for r in ranks if r.theme is None} == {0}
    hashed = small.select(clustered.label_ranks(small, "theme", labels=2).alias("r")).collect()
    assert all(0 <= r.r < 256 for r in hashed)
    empty = small.limit(0)
    assert empty.select(clustered.label_ranks(empty, "theme")).collect() == []


def test_a_day_apart_and_rows_without_a_time(spark, make_feedback, tmp_path):
    rows = make_feedback([feedback_row(1), feedback_row(2, created_at=moment(3)), feedback_row(3, created_at=None, theme=None)])
    clustered.write_clustered(rows, str(tmp_path / "t"))
    stored = tables.scan_feedback(spark, str(tmp_path / "t"), by_day=True)
    assert sorted((r.id, str(r.created_date)) for r in stored.collect()) == [(1, "2024-01-01"), (2, "2024-01-03"), (3, "None")]


@pytest.mark.parametrize("term", ["doc", "DOC", "%", "_", "nothing like it", '"'])
def test_search_through_the_dictionary(spark, tmp_path, term):
    multilabel = views.multilabel(spark, SF_DIR)
    halves = [multilabel.filter(F.col("id") % 2 == n) for n in (0, 1)]
    path = str(tmp_path / "dictionary")
    for number, half in enumerate([*halves, halves[1]]):
        label_search.add_to_dictionary(half, path, f"half {min(number, 1)}")
    dictionary = label_search.read_dictionary(spark, path)
    want = filters.theme_substring(multilabel, term)
    found = label_search.search_rows(multilabel, dictionary, term)
    assert texts(found) == texts(want)
    assert label_search.search_total(dictionary, term).first()[0] == want.count()
    assert "like" not in plan_of(found).lower()


def test_no_dictionary_yet(spark, tmp_path):
    nothing = label_search.read_dictionary(spark, str(tmp_path / "none"))
    assert label_search.search_total(nothing, "doc").first()[0] == 0
    with pytest.raises(ValueError):
        label_search.search_total(nothing, "")


def counting_model(folder, fail=()):
    """A model that notes each text it is asked, and fails on some."""

    def load():
        def reply(asked):
            import uuid
            from pathlib import Path

            bad = [t for t in asked if t in fail]
            if bad:
                raise ValueError(f"cannot read {bad[0]}")
            Path(folder, uuid.uuid4().hex).write_text("\n".join(asked))
            return [t.upper() for t in asked]

        return reply

    return load


@pytest.fixture
def asked(tmp_path):
    folder = tmp_path / "asked"
    folder.mkdir()
    return folder, lambda: sorted(t for f in folder.iterdir() for t in f.read_text().split("\n"))


def test_equal_texts_are_asked_once_and_never_again(spark, tmp_path, asked):
    folder, calls = asked
    store = str(tmp_path / "store")
    rows = spark.createDataFrame([(n, t) for n, t in enumerate(["a", "b", "a", None, "c", "b", "a"])], "id long, t string")
    for _ in range(2):
        found = rows_of(replies.ask_once(rows, "t", counting_model(str(folder)), store))
        assert {(r["t"], r["raw_response"], r["error"]) for r in found} == {
            ("a", "A", None), ("b", "B", None), ("c", "C", None), (None, None, "no text"),
        }
        assert len(found) == 7 and calls() == ["a", "b", "c"]
    other = replies.ask_once(rows.limit(1), "t", counting_model(str(folder)), store, model="other")
    assert other.first().raw_response == "A" and calls() == ["a", "a", "b", "c"]


def test_errors_are_told_and_asked_again(spark, tmp_path, asked):
    folder, calls = asked
    store = str(tmp_path / "store")
    rows = spark.createDataFrame([("good",), ("bad",)], "t string")
    found = rows_of(replies.ask_once(rows, "t", counting_model(str(folder), ["bad"]), store))
    assert {(r["t"], r["raw_response"], r["error"]) for r in found} == {
        ("good", "GOOD", None), ("bad", None, "cannot read bad"),
    }
    found = rows_of(replies.ask_once(rows, "t", counting_model(str(folder)), store))
    assert {r["raw_response"] for r in found} == {"GOOD", "BAD"} and calls() == ["bad", "good"]


def test_a_job_that_broke_off_goes_on(spark, tmp_path, asked, monkeypatch):
    folder, calls = asked
    store = str(tmp_path / "store")
    rows = spark.range(40).select(F.col("id").cast("string").alias("t"))
    working, done = replies.ask_model, []

    def break_off(*given):
        if len(done) == 2:
            raise RuntimeError("lost")
        done.append(1)
        return working(*given)

    monkeypatch.setattr(replies, "ask_model", break_off)
    with pytest.raises(RuntimeError):
        replies.ask_once(rows, "t", counting_model(str(folder)), store, parts=4)
    monkeypatch.setattr(replies, "ask_model", working)
    before = calls()
    assert 0 < len(before) < 40
    found = replies.ask_once(rows, "t", counting_model(str(folder)), store, parts=4)
    assert found.filter("raw_response = t").count() == 40
    assert calls() == sorted(map(str, range(40)))
    assert enrich.ask_model is working
