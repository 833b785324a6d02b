"""Model replies that are kept: equal prompts are asked once, ever.

A store is a folder of replies by the SHA-256 of their prompt, beside a name for
the model that gave them. Prompts that it lacks are asked in ``parts`` jobs, each of
which adds its replies when it ends, so work that breaks off is asked again for one
part at most. Errors are told but not kept: the next run asks again.
"""

from pyspark.sql import functions as F

from voxloom.operators.enrich import MODEL_BATCH, ask_model
from voxloom.session import path_exists, scratch_path, stored

REPLIES = "hash binary, raw_response string"
PARTS = 16


def prompt_hash(column):
    return F.unhex(F.sha2(F.col(column), 256))


def reply_folder(store, model):
    return f"{store}/model={model}"


def kept_replies(spark, store, model):
    """Replies that a store holds of a model, one per prompt."""
    folder = reply_folder(store, model)
    if not path_exists(spark, folder):
        return spark.createDataFrame([], REPLIES)
    found = spark.read.schema(REPLIES).option("recursiveFileLookup", "true").parquet(folder)
    # Two jobs at once may both have asked.
    return found.groupBy("hash").agg(F.min("raw_response").alias("raw_response"))


def ask_once(
    rows, column, load_model, store, model="model", batch=MODEL_BATCH, tasks=None, parts=PARTS
):
    """``ask_model`` that asks for each distinct prompt that ``store`` lacks, and keeps the reply.

    Adds ``raw_response`` and ``error``. Missing prompts are not asked. Replies of
    another ``model`` are others.
    """
    spark = rows.sparkSession
    prompts = (
        rows.filter(F.col(column).isNotNull())
        .select(prompt_hash(column).alias("hash"), F.col(column).alias("prompt"))
        .groupBy("hash")
        .agg(F.first("prompt").alias("prompt"))
        .join(kept_replies(spark, store, model), "hash", "left_anti")
    )
    lacking = stored(prompts, "prompts")
    failed = scratch_path(spark, "errors")
    # The first byte of a hash deals prompts evenly.
    part = F.pmod(F.conv(F.substring(F.hex("hash"), 1, 4), 16, 10).cast("int"), F.lit(parts))
    for number in range(parts):
        some = lacking.filter(part == number)
        if some.isEmpty():
            continue
        asked = stored(ask_model(some, "prompt", load_model, batch, tasks), "replies")
        answered = F.col("error").isNull()
        good = asked.filter(answered).select("hash", "raw_response")
        good.write.mode("append").parquet(reply_folder(store, model))
        asked.filter(~answered).select("hash", "error").write.mode("append").parquet(failed)
    errors = (
        spark.read.schema("hash binary, error string").parquet(failed)
        if path_exists(spark, failed) else spark.createDataFrame([], "hash binary, error string")
    )
    replies = kept_replies(spark, store, model).join(errors, "hash", "full")
    known = replies.select(F.col("hash").alias("_hash"), "raw_response", "error")
    found = rows.withColumn("_asked", prompt_hash(column)).join(
        known, F.col("_asked") == F.col("_hash"), "left"
    )
    none = F.when(F.col(column).isNull(), "no text").otherwise(F.col("error"))
    return found.select(*rows.columns, "raw_response", none.alias("error"))
