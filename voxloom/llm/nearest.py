"""Exact top-k by integer inner product, with a vector-approximation file.

The file is a narrow table beside the exact vectors: a row per block of vectors
with one cell number (a byte) per component and the edges of the cells. Blocks
hold vectors of like magnitude, so a few large ones do not widen the cells of all.
The file is scanned for every block of queries and bounds each score from below
and above. The k-th highest lower bound of a query over the whole file is a score
that its k-th result reaches; only vectors whose upper bound reaches it stay.
Exact vectors are read for the k highest upper bounds of a query first, then for
those that can still reach the k-th score so found; after that no unread vector can.

Of equal vectors in a block only those stay that some query could return, so many
copies do not become many candidates.

Defined results: vectors that are NULL or hold NULL or non-finite components,
and rows without id, take no part; vectors of different length are never
compared; repeated rows are candidates each, and an id given with several vectors
asks with the smallest of them; a query never finds its own id; scores beyond 64
bits stop at its limits and tie there; other columns are not read; an empty table
gives an empty result.
"""

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from voxloom.session import stored

SCALE, K, QUERY_STEP = 1024, 10, 100
#: Vectors of a block, vectors sorted by magnitude before they are cut into
#: blocks, vectors and queries that meet in one task, queries scored at once.
BLOCK_ROWS, SORTED_ROWS, GROUP_ROWS, GROUP_QUERIES = 4096, 16384, 65536, 4096
QUERIES_AT_ONCE = 512
CELLS = 256
LONG = (-(2**63), 2**63 - 1)
FILE = (
    "block long, width int, ids array<long>, places array<long>, low array<long>, "
    "step array<long>, cells binary"
)
BOUNDS = "query_id long, place long, vec_id long, lower long, upper long"

def integer_vectors(table, scale=SCALE):
    """``vec_id``, ``vector`` (integers) and ``width`` of the rows that take part."""

    def odd(x):
        return x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(math.inf))

    usable = F.col("embedding").isNotNull() & F.col("vec_id").isNotNull()
    return (
        table.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
        .filter(usable & ~F.exists("embedding", odd))
        .select(
            "vec_id",
            F.transform("embedding", lambda x: F.floor(x * scale).cast("long")).alias("vector"),
        )
        .withColumn("width", F.size("vector"))
    )


class Approximation:
    """Cells of integer vectors: component d is in [low + cell * step, the same + step - 1]."""

    def __init__(self, low, step, cells):
        self.low, self.step, self.cells = low, step, cells

    @classmethod
    def of(cls, vectors, cells=CELLS):
        import numpy as np

        low = vectors.min(axis=0)
        step = (vectors.max(axis=0) - low) // cells + 1
        return cls(low, step, ((vectors - low) // step).astype(np.uint8))

    def bounds(self, queries):
        """Lowest and highest possible score of every query with every vector."""
        import numpy as np

        corner = queries @ self.low
        base = (queries * self.step) @ self.cells.T.astype(queries.dtype) + corner[:, None]
        spread = self.step - 1
        down = np.minimum(queries, 0) @ spread
        up = np.maximum(queries, 0) @ spread
        return base + down[:, None], base + up[:, None]


def exact_kind(largest, width, cells=CELLS):
    """A type of numbers in which no score or bound of such components is rounded."""
    import numpy as np

    # Python's integers do not overflow.
    return np.float64 if width * (2 * largest + cells) ** 2 < 2**53 else object


def useful_copies(vectors, ids, k):
    """Which rows of a block to keep: of equal vectors the first 2k by id, k of an id at most.

    A query leaves out its own id, k of these at most, and finds k of the others at most.
    """
    import numpy as np

    same = np.zeros(len(ids), np.int64)
    if vectors.shape[1]:
        same = np.unique(vectors, axis=0, return_inverse=True)[1].reshape(-1)
    order = np.lexsort((ids, same))
    index = np.arange(len(order))

    def number_within(new):
        return index - np.maximum.accumulate(np.where(new, index, 0))

    first = np.r_[True, same[order][1:] != same[order][:-1]]
    first_of_id = first | np.r_[True, ids[order][1:] != ids[order][:-1]]
    order = order[number_within(first_of_id) < k]
    first = np.r_[True, same[order][1:] != same[order][:-1]]
    index = np.arange(len(order))
    return np.sort(order[number_within(first) < 2 * k])


def whole_matrix(column):
    """An Arrow column of equally long lists of integers as a matrix."""
    import numpy as np

    if hasattr(column, "combine_chunks"):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(np.int64)


def approximation_file(vectors, k=K, block_rows=BLOCK_ROWS, cells=CELLS):
    """The cells of ``vectors`` (with ``place``), a row per block; written once."""
    import numpy as np
    import pyarrow as pa

    def blocks_of(table):
        for width in np.unique(table.column("width").to_numpy()):
            rows = table.filter(pa.compute.equal(table.column("width"), pa.scalar(int(width))))
            ids, places = (rows.column(c).to_numpy() for c in ("vec_id", "place"))
            matrix = whole_matrix(rows.column("vector"))
            magnitude = np.maximum(matrix.max(axis=1, initial=0), -(matrix.min(axis=1, initial=0) + 1))
            by = np.argsort(magnitude, kind="stable")
            by = by[useful_copies(matrix[by], ids[by], k)]
            for start in range(0, len(by), block_rows):
                part = by[start : start + block_rows]
                low = step = np.zeros(0, np.int64)
                data = b""
                if width:
                    whole = matrix[part]
                    kind = exact_kind(int(magnitude[part].max()) + 1, int(width), cells)
                    made = Approximation.of(whole if kind is np.float64 else whole.astype(object), cells)
                    low, step, data = made.low, made.step, made.cells.tobytes()
                yield {
                    "block": int(places[part[0]]), "width": int(width), "ids": ids[part].tolist(),
                    "places": places[part].tolist(), "low": list(map(int, low)),
                    "step": list(map(int, step)), "cells": data,
                }

    longs = pa.list_(pa.int64())
    schema = pa.schema([
        ("block", pa.int64()), ("width", pa.int32()), ("ids", longs), ("places", longs),
        ("low", longs), ("step", longs), ("cells", pa.binary()),
    ])

    def run(batches):
        held, size = [], 0

        def flush():
            for row in blocks_of(pa.Table.from_batches(held)):
                yield pa.RecordBatch.from_pylist([row], schema)

        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= SORTED_ROWS:
                yield from flush()
                held, size = [], 0
        if size:
            yield from flush()

    return stored(
        vectors.select("place", "vec_id", "vector", "width").mapInArrow(run, FILE), "cells"
    )


def scan_cells(query_ids, queries, blocks, k, cells=CELLS):
    """Bounds of the vectors of ``blocks`` that may be among the k best of each query.

    ``blocks`` are (ids, places, ``Approximation``). Gives arrays: query id, place, vector
    id, lower and upper bound, among them the k highest lower bounds of each query.
    """
    import numpy as np

    width = queries.shape[1]
    found = []
    for start in range(0, len(query_ids), QUERIES_AT_ONCE):
        asking, asked = query_ids[start : start + QUERIES_AT_ONCE], queries[start : start + QUERIES_AT_ONCE]
        # The k highest lower bounds of each query so far.
        sure = np.full((len(asking), k), -math.inf)
        parts = []
        for ids, places, given in blocks:
            edges = np.abs(np.r_[given.low, given.low + cells * given.step, 1].astype(np.float64))
            largest = max(int(edges.max()), int(np.abs(asked.astype(np.float64)).max(initial=0)))
            kind = exact_kind(largest, width, cells)
            these = asked.astype(kind)
            file = Approximation(given.low.astype(kind), given.step.astype(kind), given.cells)
            lower, upper = file.bounds(these)
            own = asking[:, None] == ids[None, :]
            lower[own] = -math.inf
            upper[own] = -math.inf
            best = lower
            if len(ids) > k and kind is not object:
                best = np.partition(lower, len(ids) - k, axis=1)[:, -k:]
            sure = np.sort(np.concatenate([sure, best], axis=1), axis=1)[:, -k:]
            query, vector = np.nonzero((upper >= sure[:, :1]).astype(bool) & ~own)
            parts.append((query, places[vector], ids[vector], lower[query, vector], upper[query, vector]))
        for query, *values in parts:
            stays = (values[-1] >= sure[query, 0]).astype(bool)
            found.append((asking[query[stays]], *[v[stays] for v in values]))
    return [np.concatenate(column) for column in zip(*found, strict=True)]


def as_longs(values):
    """Whole numbers in 64 bits; those beyond stop at the limits."""
    import numpy as np

    values = np.asarray(values)
    if values.dtype != object:
        # Exact by ``exact_kind``.
        return values.astype(np.int64)
    return np.array([min(max(int(v), LONG[0]), LONG[1]) for v in values], np.int64)


def bounded(vectors, queries, k=K, block_rows=BLOCK_ROWS, group_rows=GROUP_ROWS,
            group_queries=GROUP_QUERIES, cells=CELLS):
    """Candidates of each query by the file alone: ``BOUNDS`` and ``turn``, the order to read.

    Every group of queries meets every group of blocks once; both have a bounded size.
    """
    import numpy as np
    import pyarrow as pa

    row_groups = max(1, math.ceil(vectors.count() / group_rows))
    query_groups = max(1, math.ceil(queries.count() / group_queries))

    def numbers(count):
        return F.explode(F.sequence(F.lit(0), F.lit(count - 1)))

    def group(column, count):
        return F.pmod(F.xxhash64(column), F.lit(count)).cast("int")

    left = queries.withColumn("query_group", group("vec_id", query_groups)).withColumn(
        "row_group", numbers(row_groups)
    )
    right = (
        approximation_file(vectors, k, block_rows, cells)
        .withColumn("row_group", group("block", row_groups))
        .withColumn("query_group", numbers(query_groups))
    )

    def scan(key, asked, file):
        found = [[]] * 5
        if asked.num_rows and file.num_rows:
            blocks = []
            for row in file.to_pylist():
                data = np.frombuffer(row["cells"], np.uint8).reshape(len(row["ids"]), -1)
                low, step = (np.array(row[c], np.int64).astype(object) for c in ("low", "step"))
                ids, places = (np.array(row[c], np.int64) for c in ("ids", "places"))
                blocks.append((ids, places, Approximation(low, step, data)))
            ids = asked.column("vec_id").to_numpy()
            found = scan_cells(ids, whole_matrix(asked.column("vector")), blocks, k, cells)
        made = [pa.array(as_longs(column), pa.int64()) for column in found]
        return pa.Table.from_arrays(made, ["query_id", "place", "vec_id", "lower", "upper"])

    by = ["width", "query_group", "row_group"]
    whole = Window.partitionBy("query_id")
    sure = F.max(F.when(F.col("number") == k, F.col("lower"))).over(whole)
    return (
        left.groupBy(*by)
        .cogroup(right.groupBy(*by))
        .applyInArrow(scan, BOUNDS)
        .withColumn("number", F.row_number().over(whole.orderBy(F.desc("lower"), "place")))
        .withColumn("sure", F.coalesce(sure, F.lit(LONG[0])))
        .filter(F.col("upper") >= F.col("sure"))
        .withColumn("turn", F.row_number().over(whole.orderBy(F.desc("upper"), "vec_id", "place")))
        .drop("number", "sure")
    )


def exact_scores(candidates, vectors, queries):
    """``query_id``, ``vec_id`` and ``score`` of candidates, from the exact vectors."""
    import numpy as np
    import pyarrow as pa

    pairs = (
        candidates.select("query_id", "place")
        .join(vectors.select("place", "vec_id", "vector"), "place")
        .join(queries.select(F.col("vec_id").alias("query_id"), F.col("vector").alias("query")),
              "query_id")
        .select("query_id", "vec_id", "query", "vector", F.size("vector").alias("width"))
    )

    def run(batches):
        for batch in batches:
            widths = batch.column("width").to_numpy()
            for width in np.unique(widths):
                part = batch.filter(pa.compute.equal(batch.column("width"), pa.scalar(int(width), pa.int32())))
                asked, read = (whole_matrix(part.column(c)) for c in ("query", "vector"))
                ends = [float(x) for m in (asked, read) for x in (m.min(initial=0), m.max(initial=0))]
                kind = exact_kind(int(max(map(abs, ends))), int(width))
                score = (asked.astype(kind) * read.astype(kind)).sum(axis=1)
                yield pa.RecordBatch.from_arrays(
                    [part.column("query_id"), part.column("vec_id"), pa.array(as_longs(score), pa.int64())],
                    ["query_id", "vec_id", "score"],
                )

    return pairs.mapInArrow(run, "query_id long, vec_id long, score long")


def top_k(vectors, queries, k=K, **given):
    """The ``k`` best ``vectors`` of each of ``queries``; both from ``integer_vectors``.

    ``vectors`` have a ``place``, a number of their own; both are tables that are cheap to
    read again. Gives ``query_id``, ``rank`` from 1, ``vec_id`` and ``score``.
    """
    best = F.row_number().over(
        Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    )
    candidates = stored(bounded(vectors, queries, k, **given), "candidates")
    first = stored(exact_scores(candidates.filter(F.col("turn") <= k), vectors, queries), "scores")
    # A query with fewer than k candidates has read all of them.
    reached = first.groupBy("query_id").agg(F.min("score").alias("reached"))
    rest = candidates.filter(F.col("turn") > k).join(reached, "query_id")
    second = exact_scores(rest.filter(F.col("upper") >= F.col("reached")), vectors, queries)
    return (
        first.unionByName(second)
        .withColumn("rank", best)
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def search_table(table, step=QUERY_STEP, k=K, **given):
    """Queries are the rows whose id ``step`` divides; candidates are all rows."""
    numbered = integer_vectors(table).withColumn("place", F.monotonically_increasing_id())
    vectors = stored(numbered, "vectors")
    asked = vectors.filter(F.col("vec_id") % step == 0)
    asked = asked.groupBy("vec_id").agg(F.min("vector").alias("vector"))
    queries = stored(asked.withColumn("width", F.size("vector")), "queries")
    return top_k(vectors, queries, k, **given)
