"""Whitening of embeddings by Golub-Kahan-Lanczos bidiagonalisation.

Entries become integers x = floor(SCALE * c) + OFFSET, so that sums, means and squared deviations are exact. The fit
list holds each distinct x vector once, packed in blocks. With centred rows X the recurrence is

    a_j u_j = X v_j - b_(j-1) u_(j-1),    b_j v_(j+1) = X^T u_j - a_j v_j

and one distributed pass makes both products: every task forms its rows of X v_j - ... from the small matrix that
spans u_j (u_j = X p_j), multiplies them back with X^T and sends one vector. Both sides are orthogonalised again in
full against all earlier vectors: v_j directly, u_j through X^T u and the earlier p, without another pass. Where the
recurrence breaks down it goes on from a new direction, so that it ends with all dimensions; the singular values of the
small bidiagonal matrix are the deviations (times the root of n), its right vectors turn the v_j into components.

Defined results: rows without a vector, or with a null or non-finite entry, take no part, nor do entries of 2^31 and
more in size; among vectors of several lengths the most frequent length holds (the longer of equally frequent ones), the
others take no part; repeated rows each get their rows. Components without variance are left out, so a fit list
of one vector, or an empty table, gives no rows. A deviation beyond a long is null. A sign makes each component's entry
of largest size positive.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bazaarlens.session import cut_lineage

SCALE = 64.0
OFFSET = 1_000_000
COMPONENTS = 16
LARGEST = 2.0**31
# Entries of a block of the fit list.
BLOCK_ENTRIES = 1 << 18
# Tasks of a pass, each of which sends one vector of the dimensions to the driver.
MOST_TASKS = 4_096
# Of the largest singular value: below it a direction has no variance.
NOTHING = 1e-9
LONG = 2**63 - 1


@dataclass(frozen=True)
class Fit:
    """Components by falling deviation (columns of ``axes``, in units of x) over ``n`` rows with sums ``sums``."""

    n: int
    sums: np.ndarray
    axes: np.ndarray
    deviations: np.ndarray
    explained: np.ndarray
    identity_error: float


def grid(vectors: DataFrame, column: str = "vector") -> DataFrame:
    """``vectors`` with x, the integer vector; rows that take no part are gone."""
    c = F.col(column).cast("array<double>")
    good = F.col(column).isNotNull() & (F.size(column) > 0) & F.forall(
        c, lambda e: F.coalesce(~F.isnan(e) & (F.abs(e) < F.lit(LARGEST)), F.lit(False))
    )
    usable = vectors.where(good)
    lengths = usable.groupBy(F.size(column).alias("length")).count().orderBy(F.desc("count"), F.desc("length")).limit(1)
    length = lengths.select("length").scalar()
    x = F.transform(c, lambda e: F.floor(e * F.lit(SCALE)).cast("long") + F.lit(OFFSET))
    return usable.where(F.size(column) == length).withColumn("x", x)


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of a column of equally long lists."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _blocks(x: DataFrame) -> DataFrame:
    """Distinct vectors packed in blocks: rows, dims, data (row-wise longs)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, entries = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            matrix = _matrix(batch.column("x"))
            step = max(1, BLOCK_ENTRIES // matrix.shape[1])
            for at in range(0, len(matrix), step):
                held.append(matrix[at : at + step])
                entries += held[-1].size
                if entries >= BLOCK_ENTRIES:
                    yield _packed(held)
                    held, entries = [], 0
        if held:
            yield _packed(held)

    def _packed(parts: list[np.ndarray]) -> pa.RecordBatch:
        block = np.ascontiguousarray(np.concatenate(parts), np.int64)
        return pa.RecordBatch.from_pydict({
            "rows": pa.array([block.shape[0]], pa.int64()),
            "dims": pa.array([block.shape[1]], pa.int64()),
            "data": pa.array([block.tobytes()], pa.binary()),
        })

    return x.select("x").distinct().mapInArrow(run, "rows long, dims long, data binary")


class FitList:
    """The written blocks and passes over them."""

    def __init__(self, blocks: DataFrame) -> None:
        self.blocks = blocks.coalesce(MOST_TASKS)
        self.context = blocks.sparkSession.sparkContext
        dims = blocks.agg(F.sum("rows"), F.max("dims")).first()
        self.n, self.dims = int(dims[0] or 0), int(dims[1] or 0)
        if self.n:
            self.sums = sum(self._pass(lambda block: block.sum(axis=0), np.int64, "sums"))
            self.spread = float(sum(self._centred(lambda c: np.array([np.square(c).sum()])))[0])

    def _pass(self, work, kind, what: str) -> list[np.ndarray]:
        """Sum of ``work`` over the blocks of each task, as arrays of ``kind``."""
        dims = self.dims

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for batch in batches:
                for data in batch.column("data"):
                    part = work(np.frombuffer(data.as_buffer(), np.int64).reshape(-1, dims))
                    total = part if total is None else total + part
            if total is not None:
                yield pa.RecordBatch.from_pydict({"part": pa.array([total.astype(kind).tobytes()], pa.binary())})

        found = self.blocks.select("data").mapInArrow(run, "part binary").collect()
        return [np.frombuffer(r["part"], kind) for r in found]

    def _centred(self, work) -> list[np.ndarray]:
        """The same over centred rows; the centring is exact before it is rounded to a double."""
        n, sums = self.n, self.sums

        def centred(block: np.ndarray) -> np.ndarray:
            return work((block * n - sums) / float(n))

        return self._pass(centred, np.float64, "centred")

    def back_and_forth(self, p: np.ndarray) -> tuple[np.ndarray, float]:
        """X^T u and u^T u of u = X p."""

        def both(rows: np.ndarray) -> np.ndarray:
            u = rows @ p
            return np.append(rows.T @ u, u @ u)

        total = sum(self._centred(both))
        return total[:-1], float(total[-1])

    def covariance_of(self, axes: np.ndarray) -> np.ndarray:
        """Covariance of the rows projected on ``axes``."""

        def products(rows: np.ndarray) -> np.ndarray:
            projected = rows @ axes
            return (projected.T @ projected).ravel()

        return sum(self._centred(products)).reshape(axes.shape[1], -1) / self.n


def _fresh(basis: list[np.ndarray], dims: int, rng: np.random.Generator) -> np.ndarray:
    """A unit vector orthogonal to ``basis``."""
    while True:
        v = _orthogonal(rng.standard_normal(dims), basis)
        size = np.linalg.norm(v)
        if size > 1e-6:
            return _orthogonal(v / size, basis)


def _orthogonal(v: np.ndarray, basis: list[np.ndarray]) -> np.ndarray:
    """``v`` without its parts along ``basis``, taken off twice."""
    if basis:
        b = np.array(basis)
        for _ in range(2):
            v = v - b.T @ (b @ v)
    return v


def bidiagonalise(rows: FitList) -> tuple[np.ndarray, np.ndarray]:
    """Singular values and right vectors (columns) of the centred rows, by falling value.

    u_j is held as p_j with u_j = X p_j. For an earlier u_i = X p_i the product u_i^T u is p_i^T (X^T u), and X^T u_i
    is known from its own pass, so taking u's part along u_i off again changes p and X^T u on the driver alone.
    """
    dims, rng = rows.dims, np.random.default_rng(20)
    scale = np.sqrt(max(rows.spread, 0.0))
    v_all: list[np.ndarray] = []
    p_all: list[np.ndarray] = []
    z_all: list[np.ndarray] = []  # X^T u_j
    upper = np.zeros((dims, dims))
    v, beta = _fresh([], dims, rng), 0.0
    for j in range(dims):
        v_all.append(v)
        p = v - beta * p_all[-1] if beta else v
        z, square = rows.back_and_forth(p)
        if p_all:
            before, images = np.array(p_all), np.array(z_all)
            along = before @ z
            p, z = p - before.T @ along, z - images.T @ along
            # Orthogonal u_i: the square loses the squares of the parts taken off.
            square -= float(along @ along)
        alpha = np.sqrt(max(square, 0.0))
        if alpha > NOTHING * scale:
            p, z = p / alpha, z / alpha
            upper[j, j] = alpha
        else:
            p, z = np.zeros(dims), np.zeros(dims)
        p_all.append(p)
        z_all.append(z)
        if j + 1 == dims:
            break
        rest = _orthogonal(z - upper[j, j] * v, v_all)
        beta = float(np.linalg.norm(rest))
        if beta > NOTHING * scale:
            v, upper[j, j + 1] = rest / beta, beta
            v = _orthogonal(v, v_all)
            v /= np.linalg.norm(v)
        else:
            v, beta = _fresh(v_all, dims, rng), 0.0
            v /= np.linalg.norm(v)
    _, values, right = np.linalg.svd(upper)
    return values, np.array(v_all).T @ right.T


def fit(x: DataFrame, components: int = COMPONENTS) -> Fit | None:
    """The fit of the distinct vectors in ``x``; None where nothing varies."""
    rows = FitList(cut_lineage(_blocks(x)))
    if not rows.n or rows.spread <= 0:
        return None
    values, vectors = bidiagonalise(rows)
    kept = np.flatnonzero(values > NOTHING * values[0])[:components]
    axes = vectors[:, kept]
    axes = axes * np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(len(kept))])
    deviations = values[kept] / np.sqrt(rows.n)
    error = np.abs(rows.covariance_of(axes / deviations) - np.eye(len(kept))).max()
    return Fit(rows.n, rows.sums, axes, deviations, values[kept] ** 2 / rows.spread, float(error))


def _deviation(block: np.ndarray, n: int, sums: np.ndarray) -> pa.Array:
    """Sums of (n x - S)^2, exact; null beyond a long."""
    apart = block * n - sums
    if np.square(apart.astype(float)).sum(axis=1).max(initial=0.0) < 2.0**62:
        return pa.array(np.square(apart).sum(axis=1))
    exact = [sum(int(d) * int(d) for d in row) for row in apart]
    return pa.array([d if d <= LONG else None for d in exact], pa.int64())


def whiten(vectors: DataFrame, key: str, column: str = "vector", components: int = COMPONENTS) -> DataFrame:
    """A row for each vector and component: the key, component, n, deviation, whitened, explained, identity_error."""
    x = grid(vectors, column).select(key, "x")
    kind = next(f.dataType for f in vectors.schema.fields if f.name == key)
    schema = T.StructType([
        T.StructField(key, kind), T.StructField("component", T.IntegerType()), T.StructField("n", T.LongType()),
        T.StructField("deviation", T.LongType()), T.StructField("whitened", T.DoubleType()),
        T.StructField("explained", T.DoubleType()), T.StructField("identity_error", T.DoubleType()),
    ])
    found = fit(x, components)
    if found is None:
        return vectors.sparkSession.createDataFrame([], schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(found.deviations)
        for batch in batches:
            if not batch.num_rows:
                continue
            block = _matrix(batch.column("x"))
            centred = (block * found.n - found.sums) / float(found.n)
            each = pa.array(np.repeat(np.arange(len(block)), k))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(key).take(each),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(block))),
                    pa.array(np.full(len(each), found.n)),
                    _deviation(block, found.n, found.sums).take(each),
                    pa.array((centred @ found.axes / found.deviations).ravel()),
                    pa.array(np.tile(found.explained, len(block))),
                    pa.array(np.full(len(each), found.identity_error)),
                ],
                schema.names,
            )

    return x.mapInArrow(run, schema)
