"""Label search through a dictionary of the distinct label texts of a multi-label table.

A table has far fewer label texts than rows. The dictionary holds each with its
number of rows, so a search runs its pattern once per distinct text, the total is
known without the table, and the rows are found by equal texts. It is kept up batch by
batch: a batch's part has a folder of its own and replaces itself when it runs again.
"""

from pyspark.sql import functions as F

from voxloom.functions.measures import rows
from voxloom.operators.filters import theme_substring
from voxloom.session import path_exists, stored
from voxloom.sources.ledger import folder_name

DICTIONARY = "themes string, count bigint"


def label_texts(multilabel):
    """The distinct label texts of rows, with their counts."""
    return multilabel.filter(F.col("themes").isNotNull()).groupBy("themes").agg(
        rows().alias("count")
    )


def add_to_dictionary(multilabel, path, batch):
    """Store the label texts of a batch, in place of any it had."""
    label_texts(multilabel).write.mode("overwrite").parquet(f"{path}/from={folder_name(batch)}")


def read_dictionary(spark, path):
    """Each label text of all batches once, with the number of its rows."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], DICTIONARY)
    parts = spark.read.schema(DICTIONARY).option("recursiveFileLookup", "true").parquet(path)
    return parts.groupBy("themes").agg(F.sum("count").alias("count"))


def matching_texts(dictionary, term):
    """The label texts that hold ``term``, as ``theme_substring`` matches."""
    return theme_substring(dictionary, term)


def search_total(dictionary, term):
    """The number of rows that match, from the dictionary alone."""
    return matching_texts(dictionary, term).agg(
        F.coalesce(F.sum("count"), F.lit(0)).alias("count")
    )


def search_rows(multilabel, dictionary, term):
    """The rows that ``theme_substring`` gives, found by equal texts.

    The matching texts are stored first, so that Spark knows their true size and
    broadcasts them only if they are few.
    """
    texts = stored(matching_texts(dictionary, term).select("themes"), "texts")
    return multilabel.join(texts, "themes", "left_semi").select(*multilabel.columns)
