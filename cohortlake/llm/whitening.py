"""Whitening of embeddings by the leading eigenvectors of their covariance.

The eigenvectors are found by a block Jacobi-Davidson iteration that never forms the
covariance: all it asks for are products of the covariance with a few columns, each one
pass over the distinct vectors.  A pass centres every vector before it multiplies; tasks
send one small sum each.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField, StructType

from cohortlake.llm.common import stored

# An entry c becomes floor(SCALE * c) + OFFSET.
SCALE, OFFSET = 64, 1_000_000
# Larger entries are treated like those that are not finite, so that sums of a block fit 64 bits.
LARGEST = float(1 << 45)
BLOCK_BYTES = 1 << 20
# Groups in which the sums of tasks are added up.
GROUPS = 32
# Products per correction equation, most columns of the subspace per wanted component, rounds.
INNER, WIDEST, ROUNDS = 5, 4, 60
EPS = float(np.finfo(np.float64).eps)


@dataclass
class Whitening:
    """``components`` has a unit eigenvector a column, by falling eigenvalue."""

    n: int
    sums: list[int]
    trace: float
    eigenvalues: np.ndarray
    components: np.ndarray
    residuals: np.ndarray
    identity_error: float = 0.0

    @property
    def scaled(self) -> np.ndarray:
        return self.components / np.sqrt(self.eigenvalues)


def _whole_numbers(column, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows that can be used, and their vectors as whole numbers less OFFSET."""
    usable = np.flatnonzero(np.asarray(column.value_lengths().fill_null(-1)) == dim)
    lists = column.take(pa.array(usable))
    values = lists.flatten()
    x = values.to_numpy(zero_copy_only=False).reshape(-1, dim)  # null entries become NaN
    good = (np.abs(x) < LARGEST / SCALE).all(axis=1)
    return usable[good], np.floor(SCALE * x[good]).astype(np.int64)


def _spelled(x: np.ndarray) -> list[bytes]:
    """Vectors as bytes, equal ones alike: 4 bytes an entry where all fit, else 8."""
    small = (np.abs(x) < 1 << 31).all(axis=1)
    out = [r.tobytes() for r in x.astype(np.int32)]
    for i in np.flatnonzero(~small):
        out[i] = x[i].tobytes()
    return out


def _blocks(vectors: DataFrame, vector_col: str, dim: int) -> DataFrame:
    """``size, width, data, sums``: the distinct vectors, many to a row."""
    rows = vectors.select(F.col(vector_col).cast("array<double>").alias("v"))

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, x = _whole_numbers(batch.column(0), dim)
            yield pa.RecordBatch.from_arrays([pa.array(sorted(set(_spelled(x))), pa.binary())], names=["x"])

    names, most = ["size", "width", "data", "sums"], max(1, BLOCK_BYTES // (8 * dim))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def block(parts: list[bytes], width: int) -> pa.RecordBatch:
            x = np.frombuffer(b"".join(parts), f"<i{width}").reshape(-1, dim)
            columns = [[len(parts)], [width], [x.tobytes()], [x.sum(axis=0, dtype=np.int64).tolist()]]
            kinds = [pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.int64())]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

        held: dict[int, list[bytes]] = {4: [], 8: []}
        for batch in batches:
            for x in batch.column(0).to_pylist():
                parts = held[len(x) // dim]
                parts.append(x)
                if len(parts) == most:
                    yield block(parts, len(x) // dim)
                    parts.clear()
        for width, parts in held.items():
            if parts:
                yield block(parts, width)

    distinct = rows.mapInArrow(spell, "x binary").distinct()
    return distinct.mapInArrow(pack, "size int, width int, data binary, sums array<bigint>")


class _Passes:
    """Sums over the fit list; every method is one pass."""

    def __init__(self, blocks: DataFrame, dim: int):
        self.blocks, self.dim, self.passes = blocks, dim, 0
        self.n = int(blocks.agg(F.sum("size")).first()[0] or 0)
        total = F.sum(F.col("s").cast("decimal(38,0)")).alias("s")
        sums = blocks.select(F.posexplode("sums").alias("i", "s")).groupBy("i").agg(total).collect()
        found = {r.i: int(r.s) for r in sums}
        self.sums = [found.get(i, 0) for i in range(dim)]
        # The mean is a whole number, taken off exactly, and a fraction.
        split = [divmod(s, self.n) if self.n else (0, 0) for s in self.sums]
        self.whole = np.array([w for w, _ in split], np.int64)
        self.fraction = np.array([f / self.n if self.n else 0.0 for _, f in split])

    def total(self, of: Callable[[np.ndarray], np.ndarray], size: int) -> np.ndarray:
        """The sum over all blocks of ``of(centred vectors)``, an array of a fixed size."""
        dim, whole, fraction = self.dim, self.whole, self.fraction

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums, seen = np.zeros(size), False
            for batch in batches:
                for width, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                    x = np.frombuffer(data.as_buffer(), f"<i{width}").reshape(-1, dim)
                    sums += of((x - whole) - fraction).ravel()
                    seen = True
            if seen:
                yield pa.RecordBatch.from_arrays([pa.array([sums.tobytes()], pa.binary())], names=["part"])

        def add(parts: pa.Table) -> pa.Table:
            sums = np.zeros(size)
            for part in parts.column("part"):
                sums += np.frombuffer(part.as_buffer())
            return pa.table({"part": pa.array([sums.tobytes()], pa.binary())})

        self.passes += 1
        # One row a task; they are added up in groups, and the few sums that are left here.
        parts = self.blocks.select("width", "data").mapInArrow(run, "part binary")
        parts = parts.withColumn("group", F.pmod(F.spark_partition_id(), F.lit(GROUPS)))
        out = np.zeros(size)
        for row in parts.groupBy("group").applyInArrow(add, "part binary").collect():
            out += np.frombuffer(bytes(row.part))
        return out

    def product(self, columns: np.ndarray) -> np.ndarray:
        """The covariance times some columns."""
        return self.total(lambda c: c.T @ (c @ columns), columns.size).reshape(columns.shape) / self.n

    def trace(self) -> float:
        return float(self.total(lambda c: np.array([np.vdot(c, c)]), 1)[0]) / self.n

    def identity_error(self, scaled: np.ndarray) -> float:
        """How far the covariance of the whitened vectors is from the identity."""
        wanted = scaled.shape[1]

        def moments(c: np.ndarray) -> np.ndarray:
            z = c @ scaled
            return np.concatenate([z.sum(axis=0), (z.T @ z).ravel()])

        found = self.total(moments, wanted + wanted * wanted) / self.n
        mean, square = found[:wanted], found[wanted:].reshape(wanted, wanted)
        return float(np.abs(square - np.outer(mean, mean) - np.eye(wanted)).max())


def _orthonormal(columns: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """What columns add to an orthonormal basis; columns that add nothing go."""
    out = basis
    for column in columns.T:
        size = np.linalg.norm(column)
        for _ in range(2):  # twice is enough
            column = column - out @ (out.T @ column)
        if size > 0 and (left := np.linalg.norm(column)) > 1e-8 * size:
            column = column / left
            column -= out @ (out.T @ column)
            out = np.c_[out, column / np.linalg.norm(column)]
    return out[:, basis.shape[1] :]


def _minres(product: Callable, shifts: np.ndarray, right: np.ndarray, against: np.ndarray, steps: int) -> np.ndarray:
    """Approximate solutions t, orthogonal to ``against``, of the projected equations
    (A - shift) t = right, one a column: those of least residual in the Krylov space of
    each.  All columns take a step with one product."""

    def project(x: np.ndarray) -> np.ndarray:
        x = x - against @ (against.T @ x)
        return x - against @ (against.T @ x)

    n = right.shape[1]
    now = project(right)
    first = np.linalg.norm(now, axis=0)
    lanczos = np.zeros((n, steps + 1, steps))
    basis = [now / np.where(first > 0, first, 1)]
    for k in range(steps):
        new = project(product(basis[k]) - basis[k] * shifts)
        for _ in range(2):
            for i, b in enumerate(basis):
                part = (b * new).sum(axis=0)
                lanczos[:, i, k] += part
                new = new - b * part
        size = np.linalg.norm(new, axis=0)
        # An exhausted space gets no more directions.
        size[size <= 1e-12 * np.abs(lanczos[:, :, k]).max(axis=1)] = 0
        lanczos[:, k + 1, k] = size
        basis.append(new / np.where(size > 0, size, 1) * (size > 0))
    out = np.zeros_like(right)
    for j in range(n):
        target = np.zeros(steps + 1)
        target[0] = first[j]
        y = np.linalg.lstsq(lanczos[j], target, rcond=None)[0]
        out[:, j] = sum(y[i] * basis[i][:, j] for i in range(steps))
    return out


def leading_eigenpairs(
    product: Callable[[np.ndarray], np.ndarray], dim: int, wanted: int, seed: int = 7
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The greatest eigenvalues of a symmetric matrix of which only products are known,
    their unit eigenvectors (columns) and residual norms.

    Block Jacobi-Davidson: Ritz pairs are taken from a growing subspace; a pair whose
    residual is as small as double precision allows (``dim`` times the machine's epsilon
    times the greatest eigenvalue) is locked, for the others the projected correction
    equation is solved roughly and its solutions widen the subspace.
    """
    wanted = min(wanted, dim)
    rng = np.random.default_rng(seed)
    widest = min(dim, WIDEST * wanted)
    basis = _orthonormal(rng.standard_normal((dim, min(dim, wanted + 4))), np.zeros((dim, 0)))
    images = product(basis)
    locked = np.zeros(wanted, bool)
    for _ in range(ROUNDS):
        projected = basis.T @ images
        values, turn = np.linalg.eigh((projected + projected.T) / 2)
        order = np.argsort(-values, kind="stable")
        values, turn = values[order], turn[:, order]
        vectors, turned = basis @ turn[:, :wanted], images @ turn[:, :wanted]
        residual = turned - vectors * values[:wanted]
        sizes = np.linalg.norm(residual, axis=0)
        locked = sizes <= max(dim, 16) * EPS * abs(values[0])
        if locked.all() or basis.shape[1] == dim:
            break
        if basis.shape[1] + (~locked).sum() > widest:
            keep = turn[:, : min(2 * wanted, widest - int((~locked).sum()))]
            basis, images = basis @ keep, images @ keep
        open_ = np.flatnonzero(~locked)
        new = _minres(product, values[open_], -residual[:, open_], vectors, min(INNER, dim))
        new = _orthonormal(np.c_[new, residual[:, open_]], basis)[:, : max(1, widest - basis.shape[1])]
        if not new.shape[1]:
            new = _orthonormal(rng.standard_normal((dim, 1)), basis)
        basis, images = np.c_[basis, new], np.c_[images, product(new)]
    else:
        raise RuntimeError("the eigenvectors did not reach double precision")
    # Products of the final columns themselves, not of sums of earlier ones.
    vectors, _ = np.linalg.qr(vectors)
    fresh = product(vectors)
    values, turn = np.linalg.eigh((vectors.T @ fresh + fresh.T @ vectors) / 2)
    values, turn = values[::-1], turn[:, ::-1]
    vectors, fresh = vectors @ turn, fresh @ turn
    vectors, fresh = vectors / (size := np.linalg.norm(vectors, axis=0)), fresh / size
    return values, vectors, np.linalg.norm(fresh - vectors * values, axis=0)


def commonest_length(vectors: DataFrame, vector_col: str) -> int:
    """How many entries most vectors have; of lengths equally common the greatest."""
    lengths = vectors.select(F.size(vector_col).alias("d")).filter("d > 0").groupBy("d").count()
    found = lengths.orderBy(F.desc("count"), F.desc("d")).first()
    return found.d if found else 0


def fit(vectors: DataFrame, vector_col: str = "embedding", wanted: int = 16) -> Whitening:
    """The whitening of the distinct vectors of a table, each vector's entries taken as
    whole numbers floor(64 * c) + 1000000.

    Vectors are left out if null, if an entry is null, not finite or beyond 2^45 / 64 in
    size, and if they have another number of entries than most.  Repeated vectors count
    once.  There are at most as many components as the covariance has eigenvalues above
    rounding; none for an empty table, one distinct vector, or equal ones.
    """
    dim = commonest_length(vectors, vector_col)
    if not dim:
        return Whitening(0, [], 0.0, np.zeros(0), np.zeros((0, 0)), np.zeros(0))
    passes = _Passes(stored(_blocks(vectors, vector_col, dim), "fit-list"), dim)
    sums = [s + passes.n * OFFSET for s in passes.sums]
    trace = passes.trace() if passes.n else 0.0
    if not trace > 0:
        return Whitening(passes.n, sums, trace, np.zeros(0), np.zeros((dim, 0)), np.zeros(0))
    values, columns, residuals = leading_eigenpairs(passes.product, dim, wanted)
    real = values > 16 * dim * EPS * values[0]
    model = Whitening(passes.n, sums, trace, values[real], columns[:, real], residuals[real])
    model.identity_error = passes.identity_error(model.scaled)
    return model


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """For every vector the exact sum of (n * x - S)^2; null beyond 64 bits."""
    if not len(x):
        return []
    ends = [(int(a), int(b)) for a, b in zip(x.min(axis=0), x.max(axis=0))]
    far = max(abs(n * v - s) for pair, s in zip(ends, sums) for v in pair)
    if far * far * len(sums) < 1 << 63 and max(max(abs(a), abs(b)) for a, b in ends) * n < 1 << 62:
        apart = n * x - np.array(sums, np.int64)
        return (apart * apart).sum(axis=1).tolist()
    exact = ((n * x.astype(object) - np.array(sums, object)) ** 2).sum(axis=1)
    return [int(v) if v < 1 << 63 else None for v in exact]


def whiten(vectors: DataFrame, model: Whitening, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``id_col, component, n, deviation, whitened, explained, identity_error``: a row for
    every usable vector (see ``fit``; repeated rows stay repeated, ids may be null) and
    component of the model, numbered from 1.

    ``deviation`` is the exact sum over the entries of (n * x - S)^2, null where it does not
    fit 64 bits; ``whitened`` the centred vector projected on the component, in units of its
    standard deviation; ``explained`` the component's part of the total variance.  Other
    columns are not read.
    """
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    kept = ["component", "n", "deviation", "whitened", "explained", "identity_error"]
    types = [IntegerType(), LongType(), LongType(), DoubleType(), DoubleType(), DoubleType()]
    kind = StructType([rows.schema["id"], *(StructField(c, t) for c, t in zip(kept, types))])
    n, dim, wanted = model.n, len(model.sums), len(model.eigenvalues)
    sums = [s - n * OFFSET for s in model.sums]
    whole = np.array([s // n for s in sums], np.int64) if n else None
    fraction = np.array([s % n / n for s in sums]) if n else None
    scaled, error = model.scaled, model.identity_error
    explained = model.eigenvalues / model.trace if wanted else model.eigenvalues

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not wanted:
                return
            place, x = _whole_numbers(batch.column(1), dim)
            size = len(x)
            columns = [
                batch.column(0).take(pa.array(np.repeat(place, wanted))),
                pa.array(np.tile(np.arange(1, wanted + 1, dtype=np.int32), size)),
                pa.array(np.full(size * wanted, n)),
                pa.array(_deviations(x, n, sums), pa.int64()).take(pa.array(np.repeat(np.arange(size), wanted))),
                pa.array((((x - whole) - fraction) @ scaled).ravel()),
                pa.array(np.tile(explained, size)),
                pa.array(np.full(size * wanted, error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["id", *kept])

    return rows.mapInArrow(run, kind).withColumnRenamed("id", id_col)
