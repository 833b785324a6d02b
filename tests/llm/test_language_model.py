import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxloom.llm import language_model
from voxloom.llm.shared import id_remainder

END = object()


class SlowModel:
    """The same probabilities by their recursion, over words."""

    def __init__(self, texts, order, prior):
        self.order, self.prior, self.counts = order, prior, Counter()
        self.contexts = Counter()
        for text in texts:
            tokens = self.tokens(text)
            for i, word in enumerate(tokens):
                for n in range(order):
                    context = self.context(tokens, i, n)
                    if context is None:
                        continue
                    self.counts[(*context, word)] += 1
                    self.contexts[context] += 1
        self.total = self.contexts[()]
        self.distinct = sum(len(gram) == 1 for gram in self.counts)

    @staticmethod
    def tokens(text):
        folded = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        return [*re.findall(r"[^\x20\x09-\x0D]+", folded), END]

    @staticmethod
    def context(tokens, i, n):
        """n tokens before i; one None stands for what is before the start."""
        if i - n < -1:
            return None
        return tuple([None] * (n > i) + tokens[max(0, i - n) : i])

    def probability(self, tokens, i, n):
        context = self.context(tokens, i, n)
        if n == 0:
            return (self.counts[(tokens[i],)] + 0.5) / (self.total + 0.5 * (self.distinct + 1))
        shorter = self.probability(tokens, i, n - 1)
        if context is None or not self.contexts[context]:
            return shorter
        count = self.counts[(*context, tokens[i])]
        return (count + self.prior * shorter) / (self.contexts[context] + self.prior)

    def score(self, text, order=None):
        tokens = self.tokens(text)
        top = (order or self.order) - 1
        return sum(math.log10(self.probability(tokens, i, top)) for i in range(len(tokens)))


def held_out(doc_id):
    return zlib.crc32(str("" if doc_id is None else doc_id).encode()) % 5 == 1


@pytest.mark.parametrize("order, most_parts", [(1, 4096), (2, 4096), (3, 4096), (3, 4), (2, 2)])
def test_scores_equal_the_recursion(given_docs, texts, order, most_parts):
    model = SlowModel([t for d, t in texts.items() if not held_out(d)], order, 7.0)
    rows = language_model.score(
        given_docs, id_remainder("doc_id", 5) != 1, order, 7.0, 60_000, most_parts
    ).collect()
    assert len(rows) == len(texts)
    for row in rows:
        text = texts[row.doc_id]
        tokens = model.tokens(text)
        assert row.training != held_out(row.doc_id)
        assert row.train_tokens == model.total
        assert row.n_tokens == len(tokens)
        assert row.n_known == sum(model.counts[(t,)] > 0 for t in tokens)
        assert row.base_score == pytest.approx(model.score(text, 1), rel=1e-9)
        assert row.score == pytest.approx(model.score(text), rel=1e-9)


def test_probabilities_sum_to_one(texts):
    model = SlowModel(list(texts.values())[:20], 2, 5.0)
    words = {gram[0] for gram in model.counts if len(gram) == 1}
    for before in (["the"], [], ["nowhere-seen"]):
        tokens = [*before, None]
        total = 0
        for word in [*words, "unknown word"]:
            tokens[-1] = word
            total += model.probability(tokens, len(tokens) - 1, 1)
        assert total == pytest.approx(1)


def test_model_beats_the_base_on_held_out_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = language_model.score(docs, id_remainder("doc_id", 5) != 1).filter("not training").agg(
        F.sum("score"), F.sum("base_score")
    ).first()
    assert rows[0] > rows[1]


def test_edge_rows(make_docs):
    docs = make_docs(
        (1, None), (2, ""), (3, "a b a b"), (3, "a b a b"), (None, "A"), (4, "x " * 100_000), (5, "é\x1cé É"),
        score="s", training="t",
    )
    rows = language_model.score(docs, F.lit(True)).collect()
    assert len(rows) == 7
    texts = [None, "", "a b a b", "a b a b", "A", "x " * 100_000, "é\x1cé É"]
    model = SlowModel(texts, language_model.ORDER, language_model.PRIOR)
    by_id = {1: None, 2: "", 3: "a b a b", None: "A", 4: texts[5], 5: texts[6]}
    for row in rows:
        assert row.score == pytest.approx(model.score(by_id[row.doc_id]), rel=1e-9)
    untrained = language_model.score(docs, F.lit(False)).collect()
    assert {(r.train_tokens, r.n_known) for r in untrained} == {(0, 0)}
    assert all(r.base_score == 0 and r.score == 0 for r in untrained)
    assert language_model.score(docs.limit(0), F.lit(True)).count() == 0


def test_round_trips():
    keys = np.unique(np.random.default_rng(1).integers(0, 2**64, 1000, np.uint64, endpoint=False))
    assert (language_model.read_keys(language_model.write_keys(keys)) == keys).all()
    assert len(language_model.read_keys(language_model.write_keys(keys[:0]))) == 0
    counts = np.array([0, 1, 254, 255, 256, 10**12, 3])
    assert (language_model.read_counts(language_model.write_counts(counts), len(counts)) == counts).all()
    edges = language_model.split_keys(keys, 7, 0, 1, 7)
    assert edges[0] == 0 and edges[-1] == len(keys) and (np.diff(edges) > 80).all()


def test_shards_grow_with_the_root_of_the_input_within_bounds():
    sizes = [language_model.shard_size(n) for n in (0, 10**9, 10**12 // 2, 10**14)]
    assert sizes[0] == sizes[1] == language_model.LEAST_SHARD
    assert language_model.LEAST_SHARD < sizes[2] < language_model.LARGEST_SHARD == sizes[3]


def test_hops_tell_all_shards_apart_with_few_parts():
    for shards in (8, 9, 64, 4096, 4097, 3_200_000, 4096**2, 4096**2 + 1):
        hops, parts = language_model.hops_for(shards)
        assert parts <= language_model.MOST_PARTS and parts**hops >= shards
        assert hops == 1 or language_model.MOST_PARTS ** (hops - 1) < shards
    # At 100 TB: rows from shards to ranges, per level and hop.
    shards = 10**14 // language_model.shard_size(10**14)
    assert shards * language_model.hops_for(shards)[1] < 10**10


def test_equal_rows_are_dealt_apart(spark):
    """A row given very often, without id or text, fills no shard alone."""
    docs = spark.range(20_000).selectExpr("CAST(NULL AS long) AS doc_id", "'a b' AS text")
    place = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(8))
    assert max(r["count"] for r in docs.groupBy(place.alias("shard")).count().collect()) < 3_000
    rows = language_model.score(docs, F.lit(True), shard_bytes=8_000).distinct().collect()
    assert [(r.n_tokens, r.train_tokens) for r in rows] == [(3, 60_000)]


def test_the_shards_are_shuffled_once(given_docs):
    scored = language_model.score(given_docs, F.lit(True), 2, 7.0, 60_000, 4)
    scored.collect()
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert "ReusedExchange" in plan
