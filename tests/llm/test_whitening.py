import math

import numpy as np
import pytest

from voxloom.llm import queries, whitening

SCHEMA = "vec_id long, embedding array<float>, x string, component int, n string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, "x", 7, "n") for i, v in rows], SCHEMA)


def results(frame):
    return sorted(frame.collect(), key=lambda row: (row.vec_id is not None, row.vec_id or 0, row.component))


def check(rows, given, components=16):
    """Hold results to an eigen-decomposition over the distinct vectors."""
    ids = [i for i, _ in given]
    # As the table holds them: single precision.
    x = np.floor(64 * np.array([v for _, v in given], np.float32).astype(float)).astype(np.int64) + 1_000_000
    fit = np.unique(x, axis=0)
    n, total = len(fit), fit.sum(axis=0)
    centred = (n * fit - total) / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    count = min(components, int((values > 1e-14 * values[0]).sum()))
    assert len(rows) == len(given) * count
    made = np.array([r.whitened for r in rows]).reshape(-1, count)
    order = np.argsort(ids, kind="stable")
    wanted = ((n * x - total) / n)[order]
    assert {r.n for r in rows} == {n}
    assert [r.component for r in rows[:count]] == list(range(1, count + 1))
    exact = [sum((n * int(e) - int(s)) ** 2 for e, s in zip(row, total, strict=True)) for row in x[order]]
    assert [r.deviation for r in rows[::count]] == [e if e < 2**63 else None for e in exact]
    shares = values[:count] / values.sum()
    assert np.allclose([r.explained for r in rows[:count]], shares, rtol=1e-6, atol=0)
    assert {r.identity_error for r in rows} == {rows[0].identity_error}
    assert rows[0].identity_error <= 1e-4
    distinct = np.unique(np.column_stack([x[order], made]).round(9), axis=0)[:, x.shape[1]:]
    covariance = distinct.T @ distinct / n
    if len(distinct) == n:
        assert np.abs(covariance - np.eye(count)).max() < 1e-4
    # Where eigenvalues stand apart, each component is the one eigenvector.
    for c in range(count):
        near = [values[c - 1] / values[c] if c else math.inf]
        near.append(values[c] / max(values[c + 1], 1e-300) if c + 1 < len(values) else math.inf)
        if min(near) > 1.01:
            want = wanted @ vectors[:, c] / math.sqrt(values[c])
            sign = np.sign(want @ made[:, c])
            assert np.abs(want * sign - made[:, c]).max() < 1e-7


def whitened(spark, given, components=16):
    usable = whitening.whole_vectors(table(spark, given))
    return results(whitening.whiten(usable, components))


def test_query_equals_eigenvectors(spark):
    given = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()
    rows = results(queries.op11_whitening(spark, "/root/testdata/sf0.001"))
    check(rows, [(r.vec_id, r.embedding) for r in given])


@pytest.mark.parametrize("spread", [1.0, 3.0, 10.0])
def test_any_spectrum(spark, spread):
    draw = np.random.default_rng(3)
    values = draw.standard_normal((300, 6)) * 5 * spread ** np.arange(6)
    given = [(i, v.tolist()) for i, v in enumerate(values)]
    check(whitened(spark, given), given)
    check(whitened(spark, given, 3), given, 3)


def test_repeated_rows_count_once_and_equal_eigenvalues_are_all_found(spark):
    # One vector up and one down along each axis: all eigenvalues are equal.
    axes = [(i, (np.eye(5)[i % 5] * (1 if i < 5 else -1)).tolist()) for i in range(10)]
    given = axes + [(10 + 4 * i + k, v) for i, v in axes[:3] for k in range(4)]
    rows = whitened(spark, given)
    assert {row.component for row in rows} == {1, 2, 3, 4, 5}
    check(rows, given)
    assert np.allclose([row.explained for row in rows], 0.2)


def test_fewer_vectors_than_dimensions(spark):
    draw = np.random.default_rng(5)
    given = [(i, draw.standard_normal(40).tolist()) for i in range(6)]
    rows = whitened(spark, given)
    assert {row.component for row in rows} == {1, 2, 3, 4, 5}
    check(rows, given)


def test_steps_stop_where_the_wanted_components_are_sure(spark, monkeypatch):
    draw = np.random.default_rng(6)
    values = draw.standard_normal((400, 48)) * 20 * 0.5 ** np.minimum(np.arange(48), 14)
    given = [(i, v.tolist()) for i, v in enumerate(values)]
    passes = []
    products = whitening.FitList.products
    monkeypatch.setattr(
        whitening.FitList, "products", lambda self, v: passes.append(1) or products(self, v)
    )
    rows = whitened(spark, given, 2)
    check(rows, given, 2)
    assert len(passes) < 48


def test_partial_sums_meet_in_few_rows(spark, monkeypatch):
    monkeypatch.setattr(whitening, "PARTS", 1)
    monkeypatch.setattr(whitening, "BLOCK_ROWS", 7)
    draw = np.random.default_rng(8)
    given = [(i, draw.standard_normal(4).tolist()) for i in range(60)]
    check(whitened(spark, given), given)


def test_rows_that_take_no_part(spark):
    draw = np.random.default_rng(9)
    good = [(i, draw.standard_normal(3).tolist()) for i in range(20)]
    bad = [
        (30, None), (31, []), (32, [1.0, None, 2.0]), (33, [1.0, math.nan, 2.0]),
        (34, [math.inf, 0.0, 0.0]), (35, [1.0, 2.0]),
    ]
    rows = whitened(spark, good + bad + [(None, good[0][1])])
    assert {row.vec_id for row in rows} == {None, *range(20)}
    check([row for row in rows if row.vec_id is not None], good)
    first, copy = ([r.whitened for r in rows if r.vec_id == i] for i in (0, None))
    assert first == copy


def test_no_variance_gives_no_rows(spark):
    for rows in ([], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, None)]):
        frame = whitening.whiten(whitening.whole_vectors(table(spark, rows)))
        assert frame.columns == [
            "vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"
        ]
        assert frame.count() == 0


def test_huge_entries(spark):
    given = [(1, [3.0e38, 1.0]), (2, [-3.0e38, 2.0]), (3, [1.0, 5.0]), (4, [1.0e9, 5.0])]
    rows = whitened(spark, given)
    assert {row.vec_id for row in rows} == {1, 2, 3, 4}
    assert [r.deviation for r in rows if r.vec_id == 1 and r.component == 1] == [None]
    given = [(i, [float(i) * 1.0e7, float(i % 3)]) for i in range(50)]
    check(whitened(spark, given), given)
