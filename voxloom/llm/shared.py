"""What several operators share: words, table reading, remainders and samples of ids."""

import re

from pyspark.sql import Window
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"


def table(spark, sf_dir, name, *columns):
    """Columns of a given table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def id_remainder(column, divisor):
    """crc32 of the id as text, modulo ``divisor``; a NULL id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))), F.lit(divisor))


def first_by_hash(rows, key, k):
    """The ``k`` rows of each key whose ``doc_id`` has the smallest MD5.

    Rows are distinct (``doc_id``, ``key``) pairs. They are counted per key and
    first digits of the hash; only those up to the digits that hold the k-th row
    meet in a window, however many rows a key has.
    """
    hashed = rows.withColumn("__hash", F.md5(F.col("doc_id").cast("string"))).withColumn(
        "__digits", F.substring("__hash", 1, 3)
    )
    counts = hashed.groupBy(key, "__digits").agg(F.count("*").alias("__rows"))
    before = Window.partitionBy(key).orderBy("__digits").rowsBetween(
        Window.unboundedPreceding, -1
    )
    needed = counts.withColumn("__before", F.coalesce(F.sum("__rows").over(before), F.lit(0)))
    last = needed.filter(F.col("__before") < k).groupBy(key).agg(
        F.max("__digits").alias("__last")
    )
    place = F.row_number().over(Window.partitionBy(key).orderBy("__hash", "doc_id"))
    # One row per key.
    return (
        hashed.join(F.broadcast(last), key)
        .filter(F.col("__digits") <= F.col("__last"))
        .withColumn("__place", place)
        .filter(F.col("__place") <= k)
        .select(*rows.columns)
    )


def window_bytes(column, n):
    """At most ``n`` bytes of a text column, from a place anywhere in it that its hash chooses.

    Parts of characters at both ends are left out.
    """
    places = F.greatest(F.octet_length(column) - n + 1, F.lit(1))
    start = F.pmod(F.xxhash64(column), places).cast("int") + 1
    part = F.substring(F.col(column).cast("binary"), start, F.lit(n)).cast("string")
    cut = F.trim(F.make_valid_utf8(part), F.lit("\ufffd"))
    return F.when(F.octet_length(column) <= n, F.col(column)).otherwise(cut)


PLAIN_NAME = re.compile("(?!__)[A-Za-z_][A-Za-z0-9_]*")


def renamed(rows, keep=()):
    """``rows`` without column names that an operator could use itself, and the way back.

    Operators' own columns begin with two underscores. Given columns that do so too, or
    whose names are no plain words, get other names; those in ``keep`` stay. The second
    value gives a result's columns of ``rows`` under their names, and others named.
    """
    taken = {name.lower() for name in rows.columns}
    names = []
    for place, name in enumerate(rows.columns):
        if not PLAIN_NAME.fullmatch(name) and name not in keep:
            name = f"given_{place}"
            while name in taken:
                name += "_"
        names.append(name)

    def back(result, *more):
        return result.select(*names, *more).toDF(*rows.columns, *more)

    return rows.toDF(*names), back


def byte_list(column):
    """An Arrow string column as a list of UTF-8 bytes; NULL becomes empty."""
    import pyarrow as pa

    return [value or b"" for value in column.cast(pa.binary()).to_pylist()]


def whole_words(data, size=1 << 20):
    """Split UTF-8 bytes into lists of words, about ``size`` bytes of text at a time.

    ``bytes.split`` parts at exactly the characters 0x20 and 0x09 to 0x0D.
    """
    start, end = 0, len(data)
    while end - start > size:
        block = data[start : start + size]
        cut = max(block.rfind(space) for space in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c"))
        if cut < 0:
            size *= 2
            continue
        yield block[:cut].split()
        start += cut + 1
    yield data[start:].split()
