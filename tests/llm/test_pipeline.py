import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_packing import one_by_one
from tests.llm.test_repeats import slow_measure
from tests.llm.test_simhash import slow_components, slow_fingerprint
from voxloom.llm import mixing, packing, repeats, tokens

SF = "/root/testdata/sf0.001"


def signed(value):
    return value - 2**64 if value >> 63 else value


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """What each stage returns over a given table and some rows of its own, with its input."""
    root = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{SF}/documents.parquet").filter(F.length("text") < 2500)
    draw = random.Random(1)
    clean = " ".join("".join(draw.choices("abcdefghij", k=6)) for _ in range(90))
    more = [
        (900_001, None, None, "src0", 0), (900_002, "12 34 56", "en", "src1", 8), (900_003, "", "en", None, 0),
        (900_004, clean, "en", None, 0), (900_005, clean.upper(), "en", "src1", 0), (None, clean, "en", "src2", 0),
        (900_004, clean, "en", None, 0),
    ]
    docs = docs.unionByName(spark.createDataFrame(more, docs.schema))
    found, given = {}, docs
    given.write.parquet(f"{root}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        given = spark.read.parquet(f"{root}/{'documents.parquet' if not found else last}")
        stage(spark, given, str(root)).write.parquet(f"{root}/{name}")
        found[name], last = (given, spark.read.parquet(f"{root}/{name}")), name
    return found, str(root)


def test_columns(stages):
    found, _ = stages
    names = ["doc_id", "text", "lang", "source", "n_chars"]
    assert list(found) == [
        "language_id", "quality_rules", "simhash_dedup", "source_mixing", "best_fit_packing"
    ]
    for name in list(found)[:-1]:
        assert found[name][1].columns == names


def test_language_stage(stages):
    given, kept = stages[0]["language_id"]
    expected = [r.doc_id for r in given.collect() if r.text and any(map(str.isalpha, r.text))]
    assert sorted(map(str, expected)) == sorted(str(r.doc_id) for r in kept.collect())


def test_quality_stage(stages):
    given, kept = stages[0]["quality_rules"]

    def passes(text):
        m = slow_measure(text, repeats.MIN_REPEAT)
        long = m["longest_repeat"] > repeats.LONGEST_REPEAT
        return (
            m["n_words"] >= 50
            and 100 * m["n_repeat_words"] <= 50 * m["n_words"]
            and m["covered_words"] <= repeats.MOST_COVERED * m["n_words"]
            and not (long and m["longest_repeat"] > repeats.LONGEST_SHARE * m["n_words"])
        )

    expected = [str(r.doc_id) for r in given.collect() if passes(r.text)]
    assert sorted(expected) == sorted(str(r.doc_id) for r in kept.collect())
    assert "900004" in expected


def test_dedup_stage(stages):
    given, kept = stages[0]["simhash_dedup"]
    prints = [(signed(slow_fingerprint(r.text)), r.doc_id) for r in given.collect()]
    label = slow_components(sorted({p for p, _ in prints}), 4)
    least = {}
    for p, doc_id in prints:
        key = (doc_id is None, doc_id or 0)
        least[label[p]] = min(key, least.get(label[p], key))
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == sorted(least.values())


def test_mixing_stage(stages):
    given, mixed = stages[0]["source_mixing"]
    plan = {r.doc_id: len(r["__positions"]) for r in mixing.plan_mix(given).collect()}
    counts = {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert counts == {d: n for d, n in plan.items() if n}
    assert max(counts.values()) > 1


def test_packing_stage(stages):
    given, packed = stages[0]["best_fit_packing"]
    plain = tokens.load_tokenizer(tokens.vocabulary_path())
    rows = packed.collect()
    lengths = []
    for row in given.collect():
        n = len(plain.encode(row.text, add_special_tokens=False).ids) + 1
        lengths += [packing.CAPACITY] * (n // packing.CAPACITY)
        lengths += [n % packing.CAPACITY] if n % packing.CAPACITY else []
    assert sorted(lengths) == sorted(r.length for r in rows)
    assert len({r.sequence_id for r in rows}) == len(one_by_one(lengths, packing.CAPACITY))
    assert len({(r.sequence_id, r.offset) for r in rows}) == len(rows)


def test_run_equals_the_stages(spark, stages):
    found, root = stages
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    whole = corpus_pipeline.run(spark, root).select(*names).collect()
    by_stage = found["best_fit_packing"][1].select(*names).collect()
    assert sorted(map(str, whole)) == sorted(map(str, by_stage))


def test_empty_table(spark, tmp_path):
    spark.read.parquet(f"{SF}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
