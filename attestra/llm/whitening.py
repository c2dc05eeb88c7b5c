"""Whitening of vectors on their principal components, found by LOBPCG.

The covariance itself is never formed. Its product with a block of directions is one pass
over the rows: each task centres its rows, multiplies them with the block and back, and
the tasks' sums, each as large as the block, are added in a tree. The driver holds blocks
of (dimensions x three times the components) and the small problems between them:

* The iterate X, its residual R and the last direction P span the next subspace.
* Rayleigh-Ritz in that subspace gives the next iterate. Products with X and P are the
  same combinations of known products, so a round needs one pass, with R alone.
* A round's residuals are certified by a pass with the iterate itself, whatever was
  carried along, before anything is whitened.

Entries are whole numbers (``floor(scale * c) + offset``), so sums, centred entries times
the number of rows and deviations are exact.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attestra.llm.common import map_arrow

SCALE, OFFSET = 64, 1_000_000
COMPONENTS = 32
#: Directions iterated beyond the components, which quicken the last of them.
GUARD = 8
#: Scaled entries are whole numbers below this in size.
MOST = 2**40
#: Residuals, as shares of the largest eigenvalue: where rounds end at once, and what is certified at least.
TIGHT, CERTIFIED = 1e-13, 1e-10
MAX_ROUNDS = 500
#: Eigenvalues below this share of the largest can't be told from zero in double precision.
NULL_SHARE = 1e-11
#: Sums of this many tasks are added by one task of the next level.
FAN = 32
LONG = 2**63


@dataclass(frozen=True)
class Fit:
    """What the rows are whitened with: their number, exact sums, eigenvalues and unit eigenvectors (columns), and the trace."""

    n: int
    sums: tuple[int, ...]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    #: largest residual of the components, as a share of the largest eigenvalue, by a pass over the rows
    residual: float
    rounds: int


def integer_rows(vectors: pa.ListArray, scale: int, offset: int) -> tuple[np.ndarray, np.ndarray]:
    """(places of the rows kept, their whole numbers as a matrix) of vectors without null or non-finite entries."""
    lengths = vectors.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # a null entry becomes NaN
    bad = np.zeros(len(lengths) + 1, dtype=np.int64)
    np.add.at(bad, np.repeat(np.arange(len(lengths)), lengths)[~np.isfinite(flat)], 1)
    keep = (lengths > 0) & (bad[:-1] == 0)
    places = np.flatnonzero(keep)
    sizes = np.unique(lengths[keep])
    if len(sizes) > 1:
        raise ValueError(f"vectors of different lengths have no covariance: {sizes.tolist()}")
    scaled = np.floor(scale * flat[np.repeat(keep, lengths)])
    if len(scaled) and np.abs(scaled).max() >= MOST:
        raise ValueError(f"a scaled entry is {np.abs(scaled).max():g}, and {MOST} or more can't be summed exactly")
    return places, scaled.astype(np.int64).reshape(len(places), int(sizes[0]) if len(sizes) else 0) + offset


def times_n_less_sums(x: np.ndarray, n: int, sums: tuple[int, ...]) -> np.ndarray:
    """n * x - S, exact: as longs where these hold it, else as Python's integers."""
    if not len(x) or n * int(np.abs(x).max()) + max(map(abs, sums)) < LONG:
        return n * x - np.array(sums, dtype=np.int64)
    return n * x.astype(object) - np.array(sums, dtype=object)


def _matrices(vectors: DataFrame, scale: int, offset: int, each: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """(task, total): the sum over each task's batches of ``each`` of the batch's rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            _, x = integer_rows(batch.column(0), scale, offset)
            if len(x):
                part = each(x)
                total = part if total is None else total + part
        if total is not None:
            yield _row(TaskContext.get().partitionId(), total)

    return map_arrow(vectors, "task int, total binary", run)


def _row(task: int, total: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([task], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["task", "total"])


def tree_sum(parts: DataFrame, n_parts: int, shape: tuple[int, ...]) -> np.ndarray | None:
    """The sum of all ``total`` of (task, total), in an order that tasks decide: ``FAN`` by ``FAN`` until few are left for the driver."""

    def add(table: pa.Table) -> pa.Table:
        rows = sorted(zip(table.column("task").to_pylist(), table.column("total").to_pylist()))
        total = sum(np.frombuffer(data, dtype=np.float64) for _, data in rows)
        return pa.Table.from_batches([_row(rows[0][0] // FAN, total)])

    while n_parts > FAN:
        n_parts = -(-n_parts // FAN)
        parts = parts.groupBy(F.floor(F.col("task") / FAN).alias("level")).applyInArrow(add, "task int, total binary")
    rows = sorted((r["task"], bytes(r["total"])) for r in parts.collect())
    return sum(np.frombuffer(data, dtype=np.float64) for _, data in rows).reshape(shape) if rows else None


def moments(vectors: DataFrame, scale: int, offset: int) -> tuple[int, tuple[int, ...]]:
    """(number of rows, exact sum of each dimension)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(0, dtype=np.int64)
        for batch in batches:
            _, x = integer_rows(batch.column(0), scale, offset)
            if len(x):
                total = x.sum(axis=0) + (total if n else 0)
                n += len(x)
            if n >= 2**21:  # before a long overflows
                yield _moment(n, total)
                n = 0
        if n:
            yield _moment(n, total)

    sums = map_arrow(vectors, "n long, total array<long>", run)
    places = sums.select("n", F.posexplode("total").alias("at", "value")).groupBy("at").agg(F.sum("n").alias("n"), F.sum(F.col("value").cast("decimal(38,0)")).alias("value"))
    rows = sorted((r["at"], r["n"], int(r["value"])) for r in places.collect())
    if len({n for _, n, _ in rows}) > 1:
        raise ValueError("vectors of different lengths have no covariance")
    return (rows[0][1] if rows else 0), tuple(v for _, _, v in rows)


def _moment(n: int, total: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([total.tolist()], pa.list_(pa.int64()))], names=["n", "total"])


class Covariance:
    """The covariance of the rows (divisor n) as an operator: each use is a pass over them."""

    def __init__(self, vectors: DataFrame, n: int, sums: tuple[int, ...], scale: int, offset: int):
        self.vectors, self.n, self.sums, self.scale, self.offset = vectors, n, sums, scale, offset
        self.n_parts = vectors.rdd.getNumPartitions()

    def _pass(self, each: Callable[[np.ndarray], np.ndarray], shape: tuple[int, ...]) -> np.ndarray:
        n, sums = self.n, self.sums
        centred = lambda x: times_n_less_sums(x, n, sums).astype(np.float64) / n
        return tree_sum(_matrices(self.vectors, self.scale, self.offset, lambda x: each(centred(x))), self.n_parts, shape)

    def times(self, block: np.ndarray) -> np.ndarray:
        """The covariance times a block of columns."""
        sent = self.vectors.sparkSession.sparkContext.broadcast(block)
        return self._pass(lambda c: c.T @ (c @ sent.value), block.shape) / self.n

    def trace(self) -> float:
        return float(self._pass(lambda c: np.array([np.square(c).sum()]), (1,))[0]) / self.n

    def whitened_moments(self, to_white: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(mean, covariance) of the whitened rows, from the rows."""
        k = to_white.shape[1]
        sent = self.vectors.sparkSession.sparkContext.broadcast(to_white)

        def each(c: np.ndarray) -> np.ndarray:
            w = c @ sent.value
            return np.vstack([w.sum(axis=0), w.T @ w])

        both = self._pass(each, (k + 1, k)) / self.n
        return both[0], both[1:] - np.outer(both[0], both[0])


def orthonormal(block: np.ndarray, against: np.ndarray | None = None) -> np.ndarray:
    """Orthonormal columns that span ``block`` less ``against`` (orthonormal); directions that vanish are left out."""
    for _ in range(2):  # the second round removes what rounding left in the first
        sizes = np.linalg.norm(block, axis=0)
        block = block[:, sizes > 0] / sizes[sizes > 0]
        if against is not None:
            block = block - against @ (against.T @ block)
        if not block.size:
            return block
        u, s, _ = np.linalg.svd(block, full_matrices=False)
        block = u[:, s > 1e-8 * max(s[0], 1)] if len(s) else u
    return block


def lobpcg(times: Callable[[np.ndarray], np.ndarray], d: int, k: int, guard: int = GUARD, tight: float = TIGHT, certified: float = CERTIFIED, max_rounds: int = MAX_ROUNDS) -> tuple[np.ndarray, np.ndarray, float, int]:
    """(k greatest eigenvalues, unit eigenvectors, largest residual as a share of the greatest, rounds) of a symmetric operator of d dimensions.

    Rounds end when the residuals are as small as ``tight``, or no longer shrink and are
    certified. Residuals over ``certified`` after ``max_rounds`` are an error.
    """
    m = min(d, k + guard)
    x = orthonormal(np.random.default_rng(7).standard_normal((d, m)))
    ax, p, ap = times(x), np.empty((d, 0)), np.empty((d, 0))
    best, since = np.inf, 0
    for rounds in range(1, max_rounds + 1):
        values, turn = np.linalg.eigh((x.T @ ax + ax.T @ x) / 2)
        turn, values = turn[:, ::-1], values[::-1]
        x, ax = x @ turn, ax @ turn
        residuals = ax - x * values
        scale = max(values[0], np.finfo(float).tiny)
        worst = float(np.linalg.norm(residuals[:, :k], axis=0).max()) / scale
        best, since = (worst, 0) if worst < best / 2 else (best, since + 1)
        if worst <= tight or (worst <= certified and since >= 3) or m == d:
            x = np.linalg.qr(x)[0]
            ax = times(x)  # by the rows, not by what was carried along
            values, turn = np.linalg.eigh((x.T @ ax + ax.T @ x) / 2)
            turn, values = turn[:, ::-1], values[::-1]
            x, ax, p, ap = x @ turn, ax @ turn, np.empty((d, 0)), np.empty((d, 0))
            residuals = ax - x * values
            worst = float(np.linalg.norm(residuals[:, :k], axis=0).max()) / max(values[0], np.finfo(float).tiny)
            if worst <= certified:
                return values[:k], x[:, :k], worst, rounds
        w = orthonormal(residuals, np.hstack([x, p]))
        if not w.shape[1]:
            w = orthonormal(np.random.default_rng(rounds).standard_normal((d, m)), np.hstack([x, p]))[:, : d - x.shape[1] - p.shape[1]]
        aw = times(w) if w.shape[1] else np.empty((d, 0))
        basis, product = np.hstack([x, w, p]), np.hstack([ax, aw, ap])
        small, turn = np.linalg.eigh((basis.T @ product + product.T @ basis) / 2)
        turn = turn[:, ::-1][:, :m]
        # the new direction is the iterate's change outside the old iterate, made orthonormal against the new iterate
        outside = turn.copy()
        outside[:m] = 0
        change = orthonormal(outside, turn)
        x, ax, p, ap = basis @ turn, product @ turn, basis @ change, product @ change
    raise RuntimeError(f"residual {worst:g} after {max_rounds} rounds; {certified:g} is asked for")


def fit(vectors: DataFrame, components: int = COMPONENTS, scale: int = SCALE, offset: int = OFFSET) -> tuple[Fit | None, Covariance | None]:
    """The whitening of one column of vectors, and their covariance; none where no row or no variance is left."""
    n, sums = moments(vectors, scale, offset)
    if not n:
        return None, None
    covariance = Covariance(vectors, n, sums, scale, offset)
    d = len(sums)
    values, found, residual, rounds = lobpcg(covariance.times, d, min(d, components))
    real = values > max(NULL_SHARE * values[0], 0)
    return Fit(n, sums, values[real], found[:, real], covariance.trace(), residual, rounds), covariance


def whiten(df: DataFrame, components: int = COMPONENTS, scale: int = SCALE, offset: int = OFFSET, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained, identity_error, residual for each row and component.

    Rows whose vector is null, empty, or holds null or non-finite entries play no part. Vectors
    of different lengths, and entries of ``MOST`` or more in size once scaled, are an error.
    Repeated rows count as often as they occur and stay apart; a null id stays null. A
    component whose eigenvalue can't be told from zero (``NULL_SHARE``) is left out, so equal
    rows, one row or no row give no result. Equal eigenvalues share their eigenvectors in some
    orthonormal way, the same for all rows. ``deviation`` is null where a long can't hold it.
    Other columns play no part.
    """
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
    found, covariance = fit(rows.select("vector"), components, scale, offset)
    schema = T.StructType.fromDDL("vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double, residual double")
    if found is None or not len(found.values):
        return df.sparkSession.createDataFrame([], schema)
    to_white = found.vectors / np.sqrt(found.values)
    _, white = covariance.whitened_moments(to_white)
    k, error = len(found.values), float(np.abs(white - np.eye(len(white))).max())
    n, sums, explained, residual = found.n, found.sums, found.values / found.trace, found.residual
    sent = df.sparkSession.sparkContext.broadcast(to_white)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places, x = integer_rows(batch.column(1), scale, offset)
            if not len(places):
                continue
            exact = times_n_less_sums(x, n, sums)
            white = (exact.astype(np.float64) / n) @ sent.value
            near = float(np.square(exact.astype(np.float64)).sum(axis=1).max())
            far = (np.square(exact) if near < LONG / 2 else np.square(exact.astype(object))).sum(axis=1).tolist()
            far = [v if v < LONG else None for v in far]
            each = lambda values, kind: pa.array(np.tile(values, len(places)), kind)
            rows_of = pa.array(np.repeat(np.arange(len(places)), k))
            whole = pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(places)).take(rows_of), each(np.arange(1, k + 1), pa.int32()), pa.array(np.full(len(places) * k, n), pa.int64()), pa.array(far, pa.int64()).take(rows_of),
                    pa.array(white.ravel()), each(explained, pa.float64()), pa.array(np.full(len(places) * k, error)), pa.array(np.full(len(places) * k, residual)),
                ],
                names=schema.names,
            )
            yield from (whole.slice(at, 10_000) for at in range(0, whole.num_rows, 10_000))

    return map_arrow(rows, schema, run)
