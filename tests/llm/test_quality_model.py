import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxloom.llm import quality_model
from voxloom.llm.quality_model import BLOCK, CHUNK_BLOCKS, CHUNK_STEP, FILTERS, WIDTH, Network
from voxloom.llm.shared import id_remainder


def slow_probability(network, text):
    """The same network, position by position."""
    w = network.weights
    size = len(text) + WIDTH - 1
    padded = text + b"\0" * (-size % BLOCK + 2 * WIDTH)
    places = -(-size // BLOCK) * BLOCK
    made = np.zeros((places, FILTERS))
    for i in range(places):
        window = padded[i : i + WIDTH] + b"\0" * WIDTH
        for tap in range(WIDTH):
            made[i] += w["bytes"][window[tap]] @ w["filters"][tap]
    chunks, blocks = [], places // BLOCK
    start = 0
    while True:
        part = made[start * BLOCK : (start + CHUNK_BLOCKS) * BLOCK]
        chunks.append(np.maximum(part.max(axis=0) + w["bias"], 0))
        if start + CHUNK_BLOCKS >= blocks:
            break
        start += CHUNK_STEP
    chunks = np.array(chunks)
    features = np.concatenate([chunks.max(axis=0), chunks.mean(axis=0)])
    hidden = np.tanh(features @ w["hidden"] + w["hidden_bias"])
    return 1 / (1 + np.exp(-(hidden @ w["out"] + w["out_bias"][0])))


TEXTS = [b"", b"a", b"short text!!", b"x" * 61, b"y" * 62, "é ü ß ".encode() * 40, b"word and word " * 150, b"z" * 449]


def test_scores_equal_position_by_position(monkeypatch):
    network = Network.initial(3)
    expected = [slow_probability(network, text) for text in TEXTS]
    assert network.probabilities(TEXTS, network.tables()) == pytest.approx(expected, rel=1e-3)
    monkeypatch.setattr(quality_model, "BYTES_AT_ONCE", 3 * BLOCK)
    assert network.probabilities(TEXTS, network.tables()) == pytest.approx(expected, rel=1e-3)
    for text, one in zip(TEXTS, expected):
        assert network.probabilities([text], network.tables())[0] == pytest.approx(one, rel=1e-3)


def test_gradients_equal_differences():
    network, labels = Network.initial(5), np.array([0, 1, 0, 1, 1, 0, 1, 0.0])

    def loss(weights):
        net = Network(weights)
        p = np.array([slow_probability(net, text) for text in TEXTS])
        return -np.mean(labels * np.log(p) + (1 - labels) * np.log(1 - p))

    found = network.gradients(TEXTS, labels)
    draw = np.random.default_rng(1)
    for name, value in network.weights.items():
        for _ in range(3):
            at = tuple(draw.integers(0, n) for n in value.shape)
            if name == "bytes":
                at = (draw.choice(list(b"word a")), at[1])
            sides = []
            for sign in (1, -1):
                moved = value.copy()
                moved[at] += sign * 1e-5
                sides.append(loss(network.weights | {name: moved}))
            assert found[name][at] == pytest.approx((sides[0] - sides[1]) / 2e-5, rel=2e-2, abs=2e-5)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    scored = quality_model.score(docs, labels, id_remainder("doc_id", 4) != 2)
    rows = scored.join(labels.select("doc_id", "quality"), "doc_id").collect()
    tested = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    right = [(r["__score"] >= 0.7) == (r.quality == 1) for r in tested]
    kept = [r["__score"] >= 0.7 for r in tested if r.quality == 1]
    assert len(tested) > 500 and np.mean(right) > 0.96 and np.mean(kept) > 0.97


def test_held_out_labels_have_no_part(given_docs, spark):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    training = id_remainder("doc_id", 4) != 2
    flipped = labels.withColumn(
        "quality", F.when(training, F.col("quality")).otherwise(1 - F.col("quality"))
    )
    first = {r.doc_id: r["__score"] for r in quality_model.score(given_docs, labels, training).collect()}
    again = quality_model.score(given_docs.repartition(5), flipped.repartition(3), training).collect()
    assert {r.doc_id: r["__score"] for r in again} == pytest.approx(first, rel=1e-5)


def test_edge_rows(make_docs, spark):
    docs = make_docs(
        *[(i, f"good text number {i}") for i in range(20)], *[(i, f"BAD!! {i}!!") for i in range(20, 40)],
        (40, None), (41, ""), (None, "good text"), (40, None), (42, "long " * 60_000), quality="q", score="s",
    )
    labels = spark.createDataFrame(
        [(i, int(i < 20), None) for i in range(40)] + [(41, None, 0), (None, 1, 0)],
        "doc_id long, quality int, toxic int",
    )
    rows = quality_model.score(docs, labels, F.lit(True)).collect()
    assert len(rows) == 45 and all(0 <= r["__score"] <= 1 for r in rows)
    by_id = {r.doc_id: r["__score"] for r in rows}
    assert by_id[3] > by_id[25] and by_id[40] == by_id[41]
    one_sided = quality_model.score(docs, labels.filter("quality = 1"), F.lit(True)).collect()
    assert {r["__score"] for r in one_sided} == {1.0}
    assert {r["__score"] for r in quality_model.score(docs, labels, F.lit(False)).collect()} == {0.5}
    assert quality_model.score(docs.limit(0), labels, F.lit(True)).count() == 0
    assert quality_model.score(docs, labels.limit(0), F.lit(True)).count() == 45


def test_the_sample_is_bounded(given_docs, spark):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    known = quality_model.labelled(given_docs, labels, F.lit(True))
    sample = quality_model.training_sample(given_docs, known, 20, 2000).collect()
    assert len(sample) <= 20 and max(len(r.text.encode()) for r in sample) <= 2000


def test_long_and_missing_texts_leave_no_label_unlearned(make_docs, spark):
    by_hash = sorted(range(20), key=lambda i: hashlib.md5(str(i).encode()).hexdigest())
    good = [(i, None if n < 10 else f"good text number {i}") for n, i in enumerate(by_hash)]
    docs = make_docs(*good, *[(i, f"BAD é!! {i}!! " * 9) for i in range(20, 40)])
    labels = spark.createDataFrame(
        [(i, int(i < 20), None) for i in range(40)], "doc_id long, quality int, toxic int"
    )
    known = quality_model.labelled(docs, labels, F.lit(True))
    sample = quality_model.training_sample(docs, known, 16, 40).collect()
    assert sorted(r["__label"] for r in sample) == [0] * 8 + [1] * 8
    assert {r.doc_id for r in sample if r["__label"]} == set(by_hash[10:18])
    assert all(0 < len(r.text.encode()) <= 40 for r in sample)
