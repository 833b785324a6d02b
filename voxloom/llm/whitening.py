"""Whitening of embeddings by Golub-Kahan-Lanczos bidiagonalisation.

The distinct vectors are the fit list X: whole numbers, stored once as blocks.
One pass over it gives n and the exact sums S. Every step of the bidiagonalisation
is one pass over the centred rows: each task forms its part of u = Xv and of Xᵀu
and the small sums are added up. Neither u nor the basis it is kept orthogonal to is ever
stored: every u is X times a vector of the width of the rows, so inner products of u
with all earlier ones follow from Xᵀu, and both bases are made orthogonal in full,
twice, at every step. The SVD of the small bidiagonal matrix gives the components and
deviations. If a start vector is used up (equal eigenvalues, say), a new one
orthogonal to all before goes on. Steps end when the wanted components have
converged and what variance is left could hide no larger one, or when the whole space
is spanned. A last pass measures how far the whitened covariance is from the identity.

Nothing of the length of the table comes to the driver: a pass gives at most
``PARTS`` rows of the width of the vectors.

Defined results: rows whose vector is NULL, empty or holds NULL or non-finite
entries, and rows whose vector is not of the most common width (ties: the greater), take
no part; repeated rows each get results but count once in the fit; a NULL id stays
NULL; entries stop at 2^60 after scaling; components whose eigenvalue is zero to
double precision are not given, so equal vectors, a single one or an empty table give
an empty result; a deviation beyond 64 bits is NULL; other columns take no part and
names cannot clash, as only ``vec_id`` and the named column are read.
"""

import math

import numpy as np
from pyspark.sql import functions as F

from voxloom.session import stored

SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 16
BLOCK_ROWS = 1024
#: Rows that a pass may bring to the driver.
PARTS = 512
LIMIT = float(2**60)
SEED = 11
#: What counts as nothing beside the largest singular value, as a residual that is
#: small enough, and as a singular value that is zero.
TINY, CONVERGED, SMALLEST = 1e-13, 1e-16, 1e-7
#: Share of the variance that is nothing; steps between looks at the residuals.
NOTHING, CHECK_EVERY = 1e-15, 4


def whole_vectors(table, column="embedding", scale=SCALE, shift=SHIFT):
    """``vec_id`` and ``x`` (whole numbers) of the rows whose vector can be used."""

    def odd(c):
        return c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(math.inf))

    def whole(c):
        bounded = F.greatest(F.least(c * scale, F.lit(LIMIT)), F.lit(-LIMIT))
        return F.floor(bounded).cast("long") + shift

    vector = F.col(column).cast("array<double>")
    rows = table.select("vec_id", vector.alias("x")).filter(
        F.col("x").isNotNull() & (F.size("x") > 0) & ~F.exists("x", odd)
    )
    return rows.withColumn("x", F.transform("x", whole))


class FitList:
    """The distinct vectors of a table of ``whole_vectors``, in blocks, with n and S."""

    def __init__(self, vectors):
        widths = vectors.groupBy(F.size("x").alias("width")).count()
        common = widths.orderBy(F.desc("count"), F.desc("width")).first()
        self.width = common["width"] if common else 0
        self.n, self.sums, self.blocks = 0, [], None
        if not common:
            return
        distinct = vectors.filter(F.size("x") == self.width).select("x").distinct()
        self.blocks = stored(in_blocks(distinct, self.width), "whitening")
        self.parts = self.blocks.rdd.getNumPartitions()
        total = self.add_up(block_sums(self.width), exact=True)
        self.n, self.sums = total[0], [
            (high << 32) + low
            for high, low in zip(total[1 : 1 + self.width], total[1 + self.width :], strict=True)
        ]

    def centre(self):
        """(a whole number per dimension near the mean, the mean less it)."""
        base = [s // self.n for s in self.sums]
        rest = [s - self.n * b for s, b in zip(self.sums, base, strict=True)]
        return np.array(base, np.int64), np.array([r / self.n for r in rest])

    def add_up(self, part, exact=False):
        """The sum over all tasks of the array that ``part`` makes of a task's blocks."""
        import pyarrow as pa

        kind, number = (pa.int64(), "long") if exact else (pa.float64(), "double")

        def by_task(batches):
            total = part(matrix for batch in batches for matrix in matrices(batch))
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(kind))], ["total"])

        def together(batches):
            total = None
            for batch in batches:
                flat = batch.column("total").flatten().to_numpy(zero_copy_only=False)
                added = flat.reshape(batch.num_rows, -1).sum(axis=0)
                total = added if total is None else total + added
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(kind))], ["total"])

        sums = self.blocks.mapInArrow(by_task, f"total array<{number}>")
        if self.parts > PARTS:
            sums = sums.repartition(PARTS).mapInArrow(together, f"total array<{number}>")
        rows = [row["total"] for row in sums.collect()]
        if exact:
            return [sum(column) for column in zip(*rows, strict=True)]
        return np.array([math.fsum(column) for column in zip(*rows, strict=True)])

    def products(self, direction):
        """(Xᵀ X direction, squared length of X direction) of the centred rows, one pass."""
        base, rest = self.centre()

        def part(blocks):
            total = None
            for block in blocks:
                rows = (block - base) - rest
                u = rows @ direction
                added = np.append(rows.T @ u, u @ u)
                total = added if total is None else total + added
            return total

        found = self.add_up(part)
        return found[:-1], found[-1]

    def squares(self):
        """The squared entries of the centred rows, added up."""
        base, rest = self.centre()

        def part(blocks):
            sums = [float((((block - base) - rest) ** 2).sum()) for block in blocks]
            return np.array([math.fsum(sums)]) if sums else None

        return float(self.add_up(part)[0])

    def gram(self, columns):
        """(X columns)ᵀ (X columns) of the centred rows."""
        base, rest = self.centre()

        def part(blocks):
            total = None
            for block in blocks:
                made = ((block - base) - rest) @ columns
                added = (made.T @ made).ravel()
                total = added if total is None else total + added
            return total

        size = columns.shape[1]
        return self.add_up(part).reshape(size, size)


def in_blocks(distinct, width):
    """Vectors as binary blocks of at most ``BLOCK_ROWS`` rows of 64-bit numbers."""
    import pyarrow as pa

    def pack(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(start, BLOCK_ROWS)
                flat = part.column("x").flatten().to_numpy(zero_copy_only=False)
                data = pa.array([flat.astype("<i8").tobytes()], pa.binary())
                size = pa.array([width], pa.int32())
                yield pa.RecordBatch.from_arrays([data, size], ["block", "width"])

    return distinct.mapInArrow(pack, "block binary, width int")


def matrices(batch):
    """The blocks of an Arrow batch as matrices."""
    for data, width in zip(batch.column("block"), batch.column("width").to_pylist(), strict=True):
        yield np.frombuffer(data.as_buffer(), "<i8").reshape(-1, width)


def block_sums(width):
    """Rows, and sums of the upper and lower 32 bits of each dimension: exact in 64 bits."""

    def part(blocks):
        total = None
        for block in blocks:
            high, low = (block >> 32).sum(axis=0), (block & 0xFFFFFFFF).sum(axis=0)
            added = np.concatenate([[len(block)], high, low])
            total = added if total is None else total + added
        return total

    return part


class Bidiagonal:
    """X V = U B, grown by one column a step; U = X A, so only A and Xᵀ U are kept."""

    def __init__(self, fit, seed=SEED):
        self.fit, self.draw = fit, np.random.default_rng(seed)
        self.v, self.a, self.z = ([] for _ in range(3))
        self.alphas, self.betas = [], []
        self.next, self.scale = None, 0.0

    def step(self):
        """Add a column; False if the whole space is spanned."""
        width = self.fit.width
        v = self.fresh() if self.next is None else self.next
        if v is None:
            return False
        beta = self.betas[-1] if self.betas else 0.0
        direction = v - beta * self.a[-1] if self.a else v
        z, square = self.fit.products(direction)
        for _ in range(2):
            if self.a:
                # Inner products of u with all earlier ones.
                overlap = np.array(self.a) @ z
                direction = direction - overlap @ np.array(self.a)
                z = z - overlap @ np.array(self.z)
                square = max(square - overlap @ overlap, 0.0)
        alpha = math.sqrt(square)
        self.scale = max(self.scale, alpha)
        self.v.append(v)
        self.alphas.append(alpha)
        if alpha <= TINY * self.scale or alpha == 0.0:
            # X v lies among the earlier u: the column adds no new one.
            self.alphas[-1] = 0.0
            self.a.append(np.zeros(width))
            self.z.append(np.zeros(width))
            rest, beta = None, 0.0
        else:
            self.a.append(direction / alpha)
            self.z.append(z / alpha)
            rest = self.orthogonal(self.z[-1] - alpha * v)
            beta = float(np.linalg.norm(rest))
        self.scale = max(self.scale, beta)
        if rest is None or beta <= TINY * self.scale:
            self.next, beta = None, 0.0
        else:
            self.next = rest / beta
        self.betas.append(beta)
        return len(self.v) < width

    def orthogonal(self, vector):
        basis = np.array(self.v)
        for _ in range(2):
            vector = vector - basis.T @ (basis @ vector)
        return vector

    def fresh(self):
        """A new start vector orthogonal to all before; None if there is none."""
        if len(self.v) >= self.fit.width:
            return None
        vector = self.draw.standard_normal(self.fit.width)
        if self.v:
            vector = self.orthogonal(vector / np.linalg.norm(vector))
        return vector / np.linalg.norm(vector)

    def captured(self):
        """Squared entries of B without its last, unfinished one, added up."""
        return math.fsum(x * x for x in [*self.alphas, *self.betas[:-1]])

    def svd(self):
        """(singular values, falling; right vectors as columns; residual of each)."""
        size = len(self.v)
        small = np.diag(self.alphas) + np.diag(self.betas[: size - 1], 1)
        left, values, right = np.linalg.svd(small)
        return values, np.array(self.v).T @ right.T, self.betas[-1] * np.abs(left[-1])


def fit_components(fit, components=COMPONENTS):
    """(eigenvalues, components as columns, trace of the covariance), falling."""
    if fit.n < 2:
        return np.empty(0), np.empty((fit.width, 0)), 0.0
    squares = fit.squares()
    if squares == 0.0:
        return np.empty(0), np.empty((fit.width, 0)), 0.0
    work = Bidiagonal(fit)
    while work.step():
        size = len(work.v)
        # Squared singular values that no step has met so far add up to this.
        hidden = squares - work.captured()
        if hidden <= NOTHING * squares:
            break
        if size < components or size % CHECK_EVERY:
            continue
        values, _, residuals = work.svd()
        converged = residuals[:components].max() <= CONVERGED * values[0]
        if converged and hidden < values[components - 1] ** 2 / 2:
            break
    values, vectors, _ = work.svd()
    count = min(components, int((values > SMALLEST * values[0]).sum()))
    vectors = vectors[:, :count]
    # Either sign is right; the entry largest in size is made positive.
    largest = np.abs(vectors).argmax(axis=0)
    vectors = vectors * np.sign(vectors[largest, np.arange(count)])
    return values[:count] ** 2 / fit.n, vectors, squares / fit.n


def whiten(vectors, components=COMPONENTS):
    """Whitened coordinates of every row of ``whole_vectors``, one row per component.

    Gives ``vec_id``, ``component`` (from 1), ``n``, ``deviation``, ``whitened``,
    ``explained`` and ``identity_error``.
    """
    import pyarrow as pa

    schema = (
        "vec_id {id}, component int, n long, deviation long, whitened double, "
        "explained double, identity_error double"
    ).format(id=vectors.schema["vec_id"].dataType.simpleString())
    fit = FitList(vectors)
    values, found, trace = fit_components(fit, components)
    if not len(values):
        return vectors.sparkSession.createDataFrame([], schema)
    projection = found / np.sqrt(values)
    identity = fit.gram(projection) / fit.n - np.eye(len(values))
    error = float(np.abs(identity).max())
    base, rest = fit.centre()
    n, sums, width = fit.n, fit.sums, fit.width
    remainders = [s - n * int(b) for s, b in zip(sums, base, strict=True)]
    shares = values / trace

    def deviations(offsets):
        """Sum of (n x - S)^2 in whole numbers; None beyond 64 bits."""
        largest = n * (int(np.abs(offsets).max(initial=0)) + 1)
        if largest < 2**31 and width * largest**2 < 2**63:
            return ((n * offsets - np.array(remainders)) ** 2).sum(axis=1).tolist()
        exact = (n * offsets.astype(object) - np.array(remainders, object)) ** 2
        return [d if d < 2**63 else None for d in exact.sum(axis=1)]

    def project(batches):
        count = len(values)
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(start, BLOCK_ROWS)
                rows = part.num_rows
                flat = part.column("x").flatten().to_numpy(zero_copy_only=False)
                offsets = flat.reshape(rows, width) - base
                made = (offsets - rest) @ projection
                each = pa.array(np.repeat(np.arange(rows), count))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("vec_id").take(each),
                        pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), rows)),
                        pa.array(np.full(rows * count, n, np.int64)),
                        pa.array(deviations(offsets), pa.int64()).take(each),
                        pa.array(made.ravel()),
                        pa.array(np.tile(shares, rows)),
                        pa.array(np.full(rows * count, error)),
                    ],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained",
                     "identity_error"],
                )

    return vectors.filter(F.size("x") == width).mapInArrow(project, schema)
