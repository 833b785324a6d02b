import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxloom.llm import nearest

SCHEMA = "vec_id long, embedding array<float>"


def slow_search(rows, step=100, k=10):
    usable = {}
    for vec_id, vector in rows:
        if vec_id is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        ints = tuple(math.floor(1024 * float(np.float32(x))) for x in vector)
        usable.setdefault(vec_id, []).append(ints)
    found = set()
    for query_id, vectors in usable.items():
        if query_id % step:
            continue
        query = min(vectors)
        scored = sorted(
            (-sum(a * b for a, b in zip(query, other)), vec_id)
            for vec_id, others in usable.items() if vec_id != query_id
            for other in others if len(other) == len(query)
        )
        found |= {(query_id, n + 1, v, -s) for n, (s, v) in enumerate(scored[:k])}
    return found


def rows_of(frame):
    return {(r.query_id, r["rank"], r.vec_id, r.score) for r in frame.collect()}


def test_given_vectors(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in table.collect()]
    assert rows_of(nearest.search_table(table)) == slow_search(rows)


def test_ties_nulls_and_widths(spark):
    draw = random.Random(5)
    rows = [(i, [draw.choice([-1.0, 0.0, 0.5]) for _ in range(4)]) for i in range(300)]
    rows += [(i, [0.25] * 4) for i in range(300, 420)]
    rows += [
        (500, None), (501, [1.0, None, 1.0, 1.0]), (502, [math.nan] * 4), (503, [math.inf, 0.0, 0.0, 0.0]),
        (600, [9.0, 9.0]), (601, [1.0, 2.0]), (700, []), (701, []), (None, [1.0] * 4),
        (5, rows[5][1]), (100, rows[100][1]), (800, [1e6, -1e6, 3.0, 0.0]),
    ]
    table = spark.createDataFrame(rows, SCHEMA)
    assert rows_of(nearest.search_table(table)) == slow_search(rows)
    assert nearest.search_table(table.limit(0)).count() == 0
    few = spark.createDataFrame([(0, [1.0]), (1, [2.0])], SCHEMA)
    assert rows_of(nearest.search_table(few)) == {(0, 1, 1, 1024 * 2048)}


def test_repeated_rows_are_found_each(spark):
    rows = [(0, [1.0]), (7, [3.0]), (7, [3.0]), (7, [2.0]), (9, [3.0]), (100, [0.5])]
    found = nearest.search_table(spark.createDataFrame(rows, SCHEMA))
    assert rows_of(found.filter("query_id = 0")) == {
        (0, n + 1, i, 1024 * 1024 * x // 1) for n, (i, x) in enumerate([(7, 3), (7, 3), (9, 3), (7, 2)])
    } | {(0, 5, 100, 1024 * 512)}
    many = [(0, [1.0]), *[(5, [2.0])] * 3000, (6, [1.0])]
    found = nearest.search_table(spark.createDataFrame(many, SCHEMA)).collect()
    assert sorted((r["rank"], r.vec_id) for r in found) == [(n, 5) for n in range(1, 11)]


@pytest.mark.parametrize("sizes", [(37, 50, 7, 4), (1000, 1000, 1000, 256), (50, 100, 40, 1)])
def test_blocks_do_not_matter(spark, sizes):
    draw = random.Random(6)
    rows = [(i, [draw.gauss(0, 1) for _ in range(8)]) for i in range(400)]
    names = ("block_rows", "group_rows", "group_queries", "cells")
    table = spark.createDataFrame(rows, SCHEMA)
    found = nearest.search_table(table, 10, 7, **dict(zip(names, sizes)))
    assert rows_of(found) == slow_search(rows, 10, 7)


@pytest.mark.parametrize("cells", [1, 3, 256])
def test_bounds_hold(cells):
    draw = np.random.default_rng(cells)
    vectors, queries = draw.integers(-900, 900, (200, 6)), draw.integers(-900, 900, (20, 6))
    low, high = nearest.Approximation.of(vectors, cells).bounds(queries)
    exact = queries @ vectors.T
    assert (low <= exact).all() and (exact <= high).all()


def test_few_exact_vectors_are_read(spark):
    draw = np.random.default_rng(2)
    rows = [(i, list(map(float, v))) for i, v in enumerate(draw.normal(0, 0.3, (6000, 16)))]
    numbered = nearest.integer_vectors(spark.createDataFrame(rows, SCHEMA)).withColumn(
        "place", F.monotonically_increasing_id()
    )
    vectors = nearest.stored(numbered, "vectors")
    asked = vectors.filter("vec_id % 1000 = 0").drop("place")
    found = nearest.bounded(vectors, asked)
    counts = {r.query_id: r["count"] for r in found.groupBy("query_id").count().collect()}
    assert len(counts) == 6 and max(counts.values()) < 100
    # The file holds a byte per component and no vector.
    file = nearest.approximation_file(vectors)
    assert sum(len(r.cells) for r in file.collect()) == 6000 * 16
    assert "vector" not in file.columns


def test_many_copies_are_few_candidates(spark):
    rows = [(i, [1.0, 2.0]) for i in range(5000)] + [(6000, [1.0, 1.0]), (6100, [3.0, 0.0])]
    table = spark.createDataFrame(rows, SCHEMA).coalesce(1)
    numbered = nearest.integer_vectors(table).withColumn("place", F.monotonically_increasing_id())
    vectors = nearest.stored(numbered, "vectors")
    found = nearest.bounded(vectors, vectors.filter("vec_id % 100 = 0").drop("place"))
    assert found.groupBy("query_id").count().agg(F.max("count")).first()[0] <= 22
    assert rows_of(nearest.search_table(table)) == slow_search(rows)


@pytest.mark.parametrize("seed", range(10))
def test_copies_that_stay_answer_every_query(seed):
    draw = np.random.default_rng(seed)
    vectors, ids = draw.integers(0, 2, (120, 2)), draw.integers(0, 12, 120)
    stays = nearest.useful_copies(vectors, ids, 3)
    for query in range(13):
        for vector in np.unique(vectors, axis=0):
            same = (vectors == vector).all(axis=1) & (ids != query)
            kept = np.zeros(120, bool)
            kept[stays] = True
            assert sorted(ids[same])[:3] == sorted(ids[same & kept])[:3]


def test_outliers_do_not_widen_all_cells(spark):
    draw = np.random.default_rng(3)
    rows = [(i, list(map(float, v))) for i, v in enumerate(draw.normal(0, 0.3, (9000, 8)))]
    rows = [(i, [x * 1e4 for x in v] if i % 9 == 5 else v) for i, v in rows]
    numbered = nearest.integer_vectors(spark.createDataFrame(rows, SCHEMA).coalesce(1)).withColumn(
        "place", F.monotonically_increasing_id()
    )
    steps = nearest.approximation_file(nearest.stored(numbered, "v"), block_rows=1000).collect()
    assert sum(max(r.step) < 50 for r in steps) >= 8


def test_large_components_use_whole_numbers(spark):
    big = 2.0**30
    rows = [(0, [big, 1.0]), (1, [4.0, 1 / 1024]), (2, [4.0, 2 / 1024]), (3, [-4.0, 0.0]), (4, [big, 0.0])]
    found = nearest.search_table(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=3)
    score = 2**40 * 4096
    assert [tuple(r) for r in found.orderBy("rank").collect()] == [
        (0, 1, 4, 2**63 - 1), (0, 2, 2, score + 2048), (0, 3, 1, score + 1024)
    ]
