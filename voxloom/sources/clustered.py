"""A table layout by day in which any of several label columns prunes.

Within a day rows are sorted along a space-filling curve: the bits of the columns'
ranks are interleaved, so rows that agree in one column lie in few stretches, whichever
column it is. A sort by the columns in turn would help the first one only. Parquet
Bloom filters tell exactly which row groups hold a label.
"""

from pyspark.sql import functions as F

from voxloom.functions.measures import day_of

COLUMNS = ["theme", "sentiment", "channel"]
#: Bits of a column's rank, and labels whose order is kept.
BITS, LABELS = 8, 4096
ROW_GROUP_BYTES = 32 << 20


def label_ranks(rows, column, labels=LABELS, bits=BITS):
    """A column's rank from 0 to 2^bits - 1: equal labels get equal ranks.

    Up to ``labels`` distinct labels keep their order, which minima and maxima of row
    groups follow; more are ranked by a hash. NULL comes first.
    """
    found = rows.select(column).filter(F.col(column).isNotNull()).distinct().limit(labels + 1)
    known = sorted(row[0] for row in found.collect())
    if len(known) > labels:
        rank = F.pmod(F.xxhash64(column), F.lit(1 << bits)).cast("int")
    elif known:
        # The place of a label among those known: the number of smaller ones.
        place = F.array_position(F.array(*map(F.lit, known)), F.col(column)) - 1
        rank = F.floor(place * (1 << bits) / len(known)).cast("int")
    else:
        rank = F.lit(0)
    return F.coalesce(rank, F.lit(0))


def curve(ranks, bits=BITS):
    """The place on the curve: bit b of each rank in turn, the highest bits first."""
    place = F.lit(0).cast("long")
    for bit in range(bits):
        for number, rank in enumerate(ranks):
            one = F.shiftright(rank, bit).bitwiseAND(F.lit(1)).cast("long")
            place = place + F.shiftleft(one, bit * len(ranks) + number)
    return place


def write_clustered(rows, path, columns=COLUMNS, row_group_bytes=ROW_GROUP_BYTES):
    """Store rows in one folder per day, each sorted along the curve of ``columns``.

    Files of a day hold stretches of the curve. ``scan_feedback(by_day=True)`` reads it.
    """
    place = curve([label_ranks(rows, column) for column in columns])
    placed = rows.withColumns({"created_date": day_of(F.col("created_at")), "_place": place})
    writer = (
        placed.repartitionByRange("created_date", "_place")
        .sortWithinPartitions("created_date", "_place")
        .drop("_place")
        .write.mode("append")
        .option("parquet.block.size", row_group_bytes)
    )
    for column in columns:
        writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true")
        writer = writer.option(f"parquet.bloom.filter.expected.ndv#{column}", LABELS)
    writer.partitionBy("created_date").parquet(path)
