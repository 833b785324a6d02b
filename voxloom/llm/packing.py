"""Best-fit-decreasing packing of token pieces into fixed-size sequences.

Pieces of equal length are interchangeable, so the packing of any number of
pieces follows from how many there are of each length. Spark counts these; the
driver packs the counts, longest first, with a segment tree over the remaining
capacities of open sequences that gives the tightest open one in logarithmic
time; it handles a run of equal pieces and equal open sequences in one step.
Counts and runs are bounded by the capacity, not by the input. Spark then numbers
the pieces of each length and looks every number up in the runs.

The result is exactly that of packing all pieces one by one.

Defined results: a NULL text is empty and gives one piece, the closing id;
repeated rows are separate pieces; an empty table gives an empty result; other
columns of ``pieces`` pass through ``pack``, whatever their names, but for
``sequence_id`` and ``offset``, which are made anew.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F

from voxloom.llm.shared import renamed
from voxloom.llm.tokens import encoded_slices
from voxloom.session import stored

CAPACITY = 2048
CLOSING_ID = 0


class OpenSequences:
    """Open sequences by remaining capacity: a segment tree of counts over 0 to ``capacity``."""

    def __init__(self, capacity):
        self.size = 1
        while self.size < capacity + 1:
            self.size *= 2
        self.counts = [0] * (2 * self.size)
        self.runs = [[] for _ in range(capacity + 1)]

    def push(self, room, first, count):
        """``count`` sequences, numbered from ``first``, have ``room`` left."""
        if room > 0 and count > 0:
            self.runs[room].append((first, count))
            self.add(room, count)

    def pop(self, room):
        first, count = self.runs[room].pop()
        self.add(room, -count)
        return first, count

    def add(self, room, count):
        node = room + self.size
        while node:
            self.counts[node] += count
            node //= 2

    def tightest(self, length):
        """The smallest room of at least ``length`` that is open, or None."""
        node = length + self.size
        if self.counts[node]:
            return length
        while node > 1:
            if node % 2 == 0 and self.counts[node + 1]:
                node += 1
                break
            node //= 2
        else:
            return None
        while node < self.size:
            node = 2 * node if self.counts[2 * node] else 2 * node + 1
        return node - self.size


def plan_packing(histogram, capacity=CAPACITY):
    """Where the pieces of each length go, from {length: how many}.

    Gives runs (length, from, to, sequence, used, each): the pieces numbered
    ``from`` to ``to`` - 1 fill sequences from ``sequence`` on, ``each`` to a
    sequence, after ``used`` tokens already there.
    """
    rooms, runs, opened = OpenSequences(capacity), [], 0
    for length in sorted(histogram, reverse=True):
        left, number = histogram[length], 0
        while left:
            room = rooms.tightest(length)
            if room is None:
                room = capacity
                first, count = opened, -(-left // (capacity // length))
                opened += count
            else:
                first, count = rooms.pop(room)
            each = room // length
            full = min(count, left // each)
            if full:
                runs.append((length, number, number + full * each, first, capacity - room, each))
                rooms.push(room - each * length, first, full)
                number, left = number + full * each, left - full * each
            if full < count and left:
                # Fewer pieces are left than fit into one more sequence.
                runs.append((length, number, number + left, first + full, capacity - room, left))
                rooms.push(room - left * length, first + full, 1)
                number, left, full = number + left, 0, full + 1
            rooms.push(room, first + full, count - full)
    return runs


def cut_pieces(docs, path, capacity=CAPACITY, closing_id=CLOSING_ID, keys=("doc_id",)):
    """Token ids of every text, closed by one id and cut where longer than ``capacity``.

    Gives keys, ``piece``, ``start``, ``length`` and ``ids`` (little-endian
    unsigned 32-bit numbers). The first piece of a cut text takes the remainder.
    """
    import pyarrow as pa

    def cut(batches):
        closing = closing_id.to_bytes(4, "little")
        for part, _, encoded in encoded_slices(batches, path):
            rows, pieces, starts, lengths, ids = [], [], [], [], []
            for row, data in enumerate(encoded):
                data += closing
                total = len(data) // 4
                first = total % capacity or min(total, capacity)
                edges = [0, *range(first, total + 1, capacity)]
                for piece, (low, high) in enumerate(zip(edges, edges[1:], strict=False)):
                    rows.append(row)
                    pieces.append(piece)
                    starts.append(low)
                    lengths.append(high - low)
                    ids.append(data[4 * low : 4 * high])
            columns = [part.column(key).take(pa.array(rows, pa.int32())) for key in keys]
            made = [pa.array(pieces, pa.int32()), pa.array(starts, pa.int64())]
            made += [pa.array(lengths, pa.int64()), pa.array(ids, pa.binary())]
            yield pa.RecordBatch.from_arrays(
                columns + made, [*keys, "piece", "start", "length", "ids"]
            )

    narrow = docs.select(*keys, "text")
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in narrow.schema[:-1])
    return narrow.mapInArrow(cut, f"{types}, piece int, start long, length long, ids binary")


def pack(pieces, capacity=CAPACITY):
    """Add ``sequence_id`` and ``offset`` to pieces that have a ``length`` from 1 to ``capacity``.

    Pieces of one length are numbered per task of the scan that made them, and
    the tasks' counts are added up, so a length that a third of all pieces have
    is no large group. The numbered pieces are written once.
    """
    spark = pieces.sparkSession
    pieces, back = renamed(pieces.drop("sequence_id", "offset"))
    within = Window.partitionBy("__part", "length").orderBy(
        *[c for c in ("doc_id", "piece", "start") if c in pieces.columns] or ["length"]
    )
    numbered = stored(
        pieces.withColumn("__part", F.spark_partition_id()).withColumn(
            "__number", F.row_number().over(within) - 1
        ),
        "pieces",
    )
    counts = numbered.groupBy("length", "__part").agg(F.count("*").alias("__count"))
    # At most one row per possible length reaches the driver.
    lengths = counts.groupBy("length").agg(F.sum("__count")).collect()
    if any(not 1 <= length <= capacity for length, _ in lengths):
        raise ValueError(f"lengths must be from 1 to {capacity}")
    runs = spark.createDataFrame(
        plan_packing(dict(map(tuple, lengths)), capacity),
        "__length long, __from long, __to long, __sequence long, __used long, __each long",
    )
    earlier = (
        Window.partitionBy("length").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = counts.select(
        "length", "__part", F.coalesce(F.sum("__count").over(earlier), F.lit(0)).alias("__earlier")
    )
    rank = F.col("__earlier") + F.col("__number")
    placed = numbered.join(offsets, ["length", "__part"]).withColumn("__rank", rank)
    fits = (
        (F.col("length") == F.col("__length"))
        & (F.col("__rank") >= F.col("__from"))
        & (F.col("__rank") < F.col("__to"))
    )
    # The runs are bounded by the capacity, whatever the number of pieces.
    turn = F.col("__rank") - F.col("__from")
    found = placed.join(F.broadcast(runs), fits).select(
        *pieces.columns,
        (F.col("__sequence") + F.floor(turn / F.col("__each"))).alias("sequence_id"),
        (F.col("__used") + F.pmod(turn, F.col("__each")) * F.col("length")).alias("offset"),
    )
    return back(found, "sequence_id", "offset")


def sequences(packed):
    """The packed sequences themselves: ``sequence_id``, ``ids`` and how many pieces they hold."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(parts, F.lit(b""), lambda done, part: F.concat(done, part["ids"]))
    return packed.groupBy("sequence_id").agg(
        joined.alias("ids"), F.count("*").alias("pieces"), F.sum("length").alias("length")
    )
