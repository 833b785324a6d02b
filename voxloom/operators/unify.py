"""One table out of the single-label and the multi-label model."""

from pyspark.sql import functions as F

from voxloom.functions.json_text import parse_label_array

UNIFIED = [
    "origin", "id", "created_at", "channel", "author", "sentiment", "sentiment_score",
    "theme", "urgency",
]


def unify_models(feedback, multilabel):
    """Both tables under the single-label columns, with their origin.

    The source becomes the channel, the label is lower-cased, the priority
    becomes the urgency and the first label of the array the theme. Scores are
    carried over as they are.
    """
    single = feedback.withColumn("origin", F.lit("single"))
    multi = multilabel.select(
        F.lit("multi").alias("origin"),
        "id",
        "created_at",
        F.col("source").alias("channel"),
        F.col("user_id").alias("author"),
        F.lower("sentiment_label").alias("sentiment"),
        "sentiment_score",
        F.try_element_at(parse_label_array(F.col("themes")), F.lit(1)).alias("theme"),
        F.col("priority").alias("urgency"),
    )
    return single.select(*UNIFIED).unionByName(multi)
