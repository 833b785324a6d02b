import math
import re

import pytest
from pyspark.sql import functions as F

from voxloom.llm import mixing


def filled_by_rounds(sizes, most=3):
    """Targets as the contract words them: cut at the ceiling, share the excess again."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {name: (5, 2, 1)[i % 3] for i, name in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [n for n in names if n not in fixed]
        rest = total - sum(fixed.values())
        whole = sum(weight[n] for n in free)
        shares = {n: rest * weight[n] / whole for n in free}
        over = [n for n in free if shares[n] > most * sizes[n]]
        if not over:
            return {**fixed, **shares}
        fixed.update({n: most * sizes[n] for n in over})


def planned(docs):
    return mixing.plan_mix(docs).collect()


@pytest.mark.parametrize("sizes", [
    {"a": 100, "b": 100, "c": 100},
    {"a": 1, "b": 100, "c": 1000, "d": 2, None: 50},
    {"z": 5, None: 7},
    {"a": 0, "b": 10},
    {"a": 1000, "b": 1, "c": 1, "d": 1, "e": 1, "f": 1},
])
def test_targets(make_docs, sizes):
    docs = make_docs(*[
        (i * 10_000 + n, "w", None, source)
        for i, (source, size) in enumerate(sizes.items())
        for n in range(size)
    ], (-1, None, None, "a"), (-2, " \n\t", None, "b"))
    rows = planned(docs)
    whole = dict.fromkeys(["a", "b"], 0) | sizes
    expected = filled_by_rounds(whole)
    taken = dict.fromkeys(whole, 0)
    for row in rows:
        assert row["__target"] == pytest.approx(expected[row.source])
        assert row["__source_size"] == whole[row.source]
        assert len(row["__positions"]) <= 3
        taken[row.source] += row["__size"] * len(row["__positions"])
    for source, words in taken.items():
        assert abs(words - expected[source]) <= 1


def test_order_follows_the_schedules(spark):
    rows = planned(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"))
    total = sum(row["__size"] for row in rows)
    by_turn = {}
    names = sorted({row.source for row in rows})
    for row in rows:
        for position in row["__positions"]:
            assert 0 <= position <= total
            by_turn.setdefault(names.index(row.source) % 3, []).append(
                (position / total, row["__size"])
            )
    for turn, parts in by_turn.items():
        late = sum(size for time, size in parts if time > 0.5) / sum(s for _, s in parts)
        assert late == pytest.approx({0: 0.375, 1: 0.5, 2: 0.7037}[turn], abs=0.1)


def test_due_time_inverts_the_integral(spark):
    for knots in [*mixing.SCHEDULES, ((0.0, 0.0), (1.0, 2.0)), ((0.0, 2.0), (0.5, 0.0), (1.0, 1.0))]:
        def demand(time, knots=knots):
            done = 0.0
            for (t0, m0), (t1, m1) in zip(knots, knots[1:]):
                x = min(max(time - t0, 0), t1 - t0)
                done += m0 * x + (m1 - m0) / (t1 - t0) * x * x / 2
            return done

        whole = demand(1.0)
        rows = spark.range(0, 101).select((F.col("id") / 100).alias("share"))
        for row in rows.withColumn("time", mixing.due_time(F.col("share"), knots)).collect():
            assert demand(row.time) / whole == pytest.approx(row.share, abs=1e-9)


def test_reruns_and_buckets_agree(given_docs, monkeypatch):
    first = {r.doc_id: list(r["__positions"]) for r in planned(given_docs)}
    again = {r.doc_id: list(r["__positions"]) for r in planned(given_docs.repartition(7))}
    assert first == again
    monkeypatch.setattr(mixing, "PER_BUCKET", 0.01)
    assert {r.doc_id: list(r["__positions"]) for r in planned(given_docs)} == first


def test_mix_repeats_documents_in_order(given_docs):
    plan = {r.doc_id: r for r in planned(given_docs)}
    mixed = mixing.mix(given_docs)
    assert mixed.columns == given_docs.columns
    order = [row.doc_id for row in mixed.collect()]
    assert len(order) == sum(len(r["__positions"]) for r in plan.values())
    for doc_id, row in plan.items():
        assert order.count(doc_id) == len(row["__positions"])
    due = sorted((p, r.doc_id) for r in plan.values() for p in r["__positions"])
    assert [doc_id for _, doc_id in due] == order


def test_edge_rows(make_docs):
    docs = make_docs(
        (1, "a b c", None, "s"), (1, "a b c", None, "s"), (None, "x", None, None), (2, None, None, "s"),
        (3, "", None, "t"), (4, "wide " * 5000, None, "s"),
        size="s", target="t", taken="u",
    )
    rows = planned(docs)
    assert len(rows) == 6
    assert sorted(r["__size"] for r in rows) == [0, 0, 1, 3, 3, 5000]
    assert mixing.mix(docs).columns == docs.columns
    assert planned(docs.limit(0)) == []
    assert mixing.mix(docs.filter("doc_id = 3")).count() == 0


def test_word_counts(given_docs, texts):
    counted = given_docs.select("doc_id", mixing.word_count(F.col("text")).alias("n")).collect()
    for row in counted:
        assert row.n == len(re.findall(r"[^\x20\x09-\x0D]+", texts[row.doc_id]))
    assert math.isfinite(sum(row.n for row in counted))
