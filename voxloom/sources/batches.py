"""Named batches: each is in its table once, however often it is appended.

A batch has a folder of its own in the table, ids from the table's ledger, and a
marker that says it is finished. A batch that broke off and runs again replaces its
folder and keeps its ids; one that is finished is not written again. Rows that
lack a required column go to the table's quarantine under the batch's name.
"""

from pyspark.sql import functions as F

from voxloom.operators.enrich import ingest_enriched
from voxloom.schema import FEEDBACK, FEEDBACK_REQUIRED, RECORD_PAYLOAD, RECORD_REQUIRED
from voxloom.session import path_exists, stored
from voxloom.sources.ingest import apply_defaults, number_rows, split_required
from voxloom.sources.ledger import (
    claim_ids,
    finish_batch,
    finished_batch,
    folder_name,
    largest_id,
    ledger_path,
    release_claim,
)
from voxloom.sources.quarantine import (
    missing_rows,
    quarantine_path,
    read_lines,
    set_aside,
    split_lines,
    unreadable_rows,
)


def append_batch(batch, path, name, columns=FEEDBACK_REQUIRED, texts=None):
    """Append a named batch of feedback with the defaults for the columns it lacks, once.

    Rows without ``id`` column get the next free ids. Gives back how many rows
    were accepted and refused, also where the batch was there before.

    With the ``texts`` (``text_id``, ``text``) that stand beside the table, rows hold the
    ``text_id`` of their content, NULL where there is none, and are stored so; refused
    rows are set aside with their text.
    """
    if texts is None:
        accepted, rejected = split_required(apply_defaults(batch), columns)
        return append_once(accepted, missing_rows(rejected), path, name, FEEDBACK.names)
    named = apply_defaults(batch.withColumnRenamed("text_id", "content"))
    accepted, rejected = split_required(named, columns)
    names = ["text_id" if c == "content" else c for c in FEEDBACK.names]
    accepted = accepted.withColumnRenamed("content", "text_id")

    def refused():
        return missing_rows(with_own_text(stored(rejected, "refused"), texts))

    return append_once(accepted, refused, path, name, names)


def with_own_text(rows, texts):
    """Rows whose ``content`` is the id of a text, with the text instead; NULL stays.

    The rows should be ``stored``: if they are few, only their texts are moved.
    """
    wanted = rows.select(F.col("content").alias("_text_id")).distinct()
    named = texts.select(F.col("text_id").alias("_text_id"), F.col("text").alias("_text"))
    found = named.join(wanted, "_text_id", "left_semi")
    joined = rows.join(found, F.col("content") == F.col("_text_id"), "left")
    return joined.select(
        *[F.col("_text").alias(c) if c == "content" else F.col(c) for c in rows.columns]
    )


def append_lines(spark, source, path, name, enrich=ingest_enriched):
    """Append a file or folder of JSON records as one named batch, labelled, once.

    Lines that are no JSON object are set aside as they came; records that lack a
    source or a text that is not blank are set aside as JSON. Every line is accepted
    or in the quarantine.
    """
    readable, unreadable = split_lines(read_lines(spark, source), RECORD_PAYLOAD)
    accepted, rejected = split_required(readable, RECORD_REQUIRED, nonblank=["text"])
    refused = unreadable_rows(unreadable).unionByName(missing_rows(rejected))
    return append_once(accepted, refused, path, name, label=enrich)


def append_once(accepted, refused, path, name, names=None, label=None):
    """Write a batch's accepted rows and set its refused ones aside, unless that is done.

    ``refused`` may be a function that prepares them, which is then not called in vain.
    """
    spark = accepted.sparkSession
    done = finished_batch(spark, path, name)
    if done is not None:
        return done
    set_aside(refused() if callable(refused) else refused, quarantine_path(path), name)
    owner = f"batch {name}"
    if "id" not in accepted.columns:
        first = claim_ids(
            spark, ledger_path(path), owner, 0, accepted.count(),
            lambda: largest_id(stored_ids(spark, path)),
        )
        # Before a model is asked, which would be asked again for the count.
        accepted = number_rows(accepted, first)
    rows = label(accepted) if label else accepted
    folder = f"{path}/batch={folder_name(name)}"
    rows.select(*(names or rows.columns)).write.mode("overwrite").parquet(folder)
    aside = f"{quarantine_path(path)}/from={folder_name(name)}"
    counts = [spark.read.parquet(p).count() for p in (folder, aside)]
    done = finish_batch(spark, path, name, accepted=counts[0], refused=counts[1])
    release_claim(spark, ledger_path(path), owner)
    return done


def stored_ids(spark, path):
    """Ids of a table that may not be there yet; asked for when its ledger begins."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], "id long")
    read = spark.read.schema("id long").option("recursiveFileLookup", "true")
    return read.parquet(path).select(F.col("id"))
