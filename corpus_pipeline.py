"""A corpus pipeline of five stages, each calling one operator of ``voxloom.llm``.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next stage's docs. All but the last return the
columns of ``documents``.
"""

from pyspark.sql import functions as F

from voxloom.llm import language_id, mixing, packing, repeats, simhash, tokens
from voxloom.llm.shared import id_remainder
from voxloom.session import stored


def known_language(spark, docs, sf_dir):
    """Documents whose language can be told."""
    return language_id.with_language(docs, id_remainder("doc_id", 5) != 0)


def good_quality(spark, docs, sf_dir):
    """Documents that pass the quality rules."""
    return repeats.clean(docs)


def without_copies(spark, docs, sf_dir):
    """One document of each group of near-duplicates."""
    return simhash.one_of_each(docs)


def mixed_sources(spark, docs, sf_dir):
    """The training order: copies of documents as the mix of sources takes them."""
    return mixing.mix(docs)


def packed_sequences(spark, docs, sf_dir):
    """Pieces of token ids (as their checksum) with their places in sequences."""
    pieces = packing.cut_pieces(docs, tokens.vocabulary_path())
    return packing.pack(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"))


STAGES = [
    ("language_id", known_language),
    ("quality_rules", good_quality),
    ("simhash_dedup", without_copies),
    ("source_mixing", mixed_sources),
    ("best_fit_packing", packed_sequences),
]

#: Learned models, fingerprints and tokenizers have no SQL form; tests hold the
#: stages to brute-force versions.
ORACLE_SQL = None


def run(spark, sf_dir):
    """The last stage's rows over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
