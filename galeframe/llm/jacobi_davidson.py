"""Embedding whitening: leading eigenvectors of the covariance by Jacobi-Davidson, without the matrix.

Entries c become whole numbers x = floor(1024 c) + 100000, so that sums and centred vectors n x - S are exact. The
covariance V is known only by its products: a distributed pass over all vectors multiplies a few directions at a
time, sum over rows of z (z q) with z = x - S / n. On the driver there are only matrices of dimension by BASIS:

* Rayleigh-Ritz in an orthonormal subspace whose products are known gives approximate pairs and residuals;
* each wanted pair expands the subspace by an approximate solution t of its correction equation
  (I - QQ')(V - e I)(I - QQ') t = -r, Q holding the locked and wanted vectors, by INNER steps of MINRES that all pairs
  take at the same time, one pass a step;
* pairs whose residual reaches double precision are locked, a full subspace is shrunk to its best vectors, and
  the end is a new product of all locked vectors that proves their residuals.

Vectors that are null, empty or hold null or non-finite entries are left out. The vectors of one fit have one length: the one that
most rows have, the smaller of equally frequent ones; other lengths are left out. Each row counts, equal ones and those
without an id too. Directions without variance (eigenvalue at rounding level) cannot be scaled to unit variance
and give no component, so that equal vectors alone, one vector or an empty table give no rows. Entries of 2^42 or more
raise an error, and so do n times an x of 2^62 or more and deviations beyond 38 digits. Extra columns are left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galeframe.llm.folding import fold
from galeframe.llm.scratch import Scratch

BLOCK_BYTES = 1 << 20   # numbers of a stored block, at 8 bytes each
BASIS = 96              # directions of the subspace at most
INNER = 3               # steps of MINRES in a round
ROUNDS = 200
EPS = float(np.finfo(np.float64).eps)
SHIFT = 100_000
EXACT = pa.decimal128(38, 0)
BLOCKS = "dim int, many long, width int, ids array<long>, x binary, sums binary"


# --- distributed: blocks of whole numbers and their products ---

def blocks(rows: DataFrame) -> DataFrame:
    """The usable vectors of rows (vec_id, embedding) in blocks of one length, as whole numbers x - SHIFT of the least width."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column("embedding")
            sizes = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False)
            for dim in np.unique(sizes[sizes > 0]).tolist():
                own = np.flatnonzero(sizes == dim)
                step = max(1, BLOCK_BYTES // (8 * dim))
                for at in range(0, len(own), step):
                    part = batch.take(pa.array(own[at:at + step]))
                    plain = part.column("embedding").flatten()
                    numbers = pc.fill_null(plain, float("nan")).to_numpy(zero_copy_only=False).reshape(-1, dim)
                    good = np.isfinite(numbers).all(axis=1)
                    if not good.any():
                        continue
                    x = np.floor(1024.0 * numbers[good])
                    if np.abs(x).max() >= 1 << 52:
                        raise OverflowError("an entry is too large to be counted in 1024ths")
                    x = x.astype(np.int64)
                    width = next(w for w in (2, 4, 8) if w == 8 or np.abs(x).max() < 1 << (8 * w - 1))
                    ids = part.column("vec_id").filter(pa.array(good))
                    yield pa.record_batch([
                        pa.array([dim], pa.int32()), pa.array([len(x)], pa.int64()), pa.array([width], pa.int32()),
                        pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), ids),
                        pa.array([x.astype(f"<i{width}").tobytes()], pa.binary()),
                        pa.array([(x.sum(axis=0) + len(x) * SHIFT).astype("<i8").tobytes()], pa.binary())],
                        names=["dim", "many", "width", "ids", "x", "sums"])

    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).mapInArrow(
        run, BLOCKS)


@dataclass
class Fit:
    """The fit list: stored blocks of one length, number of vectors, sums of every dimension."""

    table: DataFrame
    dim: int
    n: int
    sums: np.ndarray

    def deviations(self, width: int, raw: memoryview) -> np.ndarray:
        """n x - S of a block's vectors, exact."""
        x = np.frombuffer(raw, f"<i{width}").reshape(-1, self.dim).astype(np.int64) + SHIFT
        if self.n * max(int(x.max()), -int(x.min())) >= 1 << 62:
            raise OverflowError("n times an entry is beyond 64 bits")
        return self.n * x - self.sums

    def summed(self, each: Callable[[np.ndarray], np.ndarray], shape: tuple[int, ...]) -> np.ndarray:
        """Sum over all vectors, block by block, of what each() makes of a block's centred vectors."""
        own = Fit(None, self.dim, self.n, self.sums)  # what tasks need

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(shape, np.longdouble)
            for batch in batches:
                for width, raw in zip(batch.column("width").to_pylist(), batch.column("x"), strict=True):
                    total += each(own.deviations(width, raw.as_buffer()) / own.n)
            yield pa.record_batch([pa.array([total.astype(np.float64).tobytes()], pa.binary())], names=["sum"])

        got = fold(self.table.select("width", "x").mapInArrow(run, "sum binary"), np.float64, np.add)
        return got.reshape(shape)

    def product(self, q: np.ndarray) -> np.ndarray:
        """V q, for the columns of q."""
        return self.summed(lambda z: z.T @ (z @ q), q.shape) / self.n


def fit_list(rows: DataFrame, tables: Scratch) -> Fit | None:
    """None without a usable vector."""
    stored = tables.written(blocks(rows))
    best = stored.groupBy("dim").agg(F.sum("many").alias("n")).orderBy(F.desc("n"), "dim").first()
    if best is None:
        return None
    own = stored.filter(F.col("dim") == best["dim"])
    return Fit(own, best["dim"], best["n"], fold(own.select("sums"), np.int64, np.add))


# --- on the driver: matrices of dim x BASIS at most ---

def _orthonormal(new: np.ndarray, *bases: np.ndarray) -> np.ndarray:
    """An orthonormal basis of what the columns of new add to the bases; columns that add nothing are left out."""
    kept = np.zeros((len(new), 0))
    for column in new.T:
        size = np.linalg.norm(column)
        if not np.isfinite(size) or size == 0:
            continue
        left = column / size
        for _ in range(3):
            for base in (*bases, kept):
                left = left - base @ (base.T @ left)
            size = np.linalg.norm(left)
            if size < 1e-8:
                break
            left = left / size
        else:
            kept = np.column_stack([kept, left])
    return kept


def minres(apply: Callable[[np.ndarray], np.ndarray], b: np.ndarray, steps: int) -> np.ndarray:
    """Approximate solutions of a symmetric system for every column of b; apply() may treat each column in its own way."""
    size = np.linalg.norm(b, axis=0)
    v, v_old = b / np.where(size > 0, size, 1), np.zeros_like(b)
    w, w_old, x = np.zeros_like(b), np.zeros_like(b), np.zeros_like(b)
    cos, cos_old, sin, sin_old = np.ones_like(size), np.ones_like(size), np.zeros_like(size), np.zeros_like(size)
    beta, eta, live = np.zeros_like(size), size.copy(), size > 0
    for _ in range(steps):
        p = apply(v)
        alpha = (v * p).sum(axis=0)
        p = p - alpha * v - beta * v_old
        beta_new = np.linalg.norm(p, axis=0)
        diagonal = cos * alpha - cos_old * sin * beta
        above, far = sin * alpha + cos_old * cos * beta, sin_old * beta
        length = np.hypot(diagonal, beta_new)
        live = live & (length > EPS * np.abs(alpha))  # a column that has its solution stays as it is
        safe = np.where(live, length, 1)
        w, w_old = np.where(live, (v - far * w_old - above * w) / safe, 0), w
        cos, cos_old, sin, sin_old = diagonal / safe, cos, beta_new / safe, sin
        x = x + np.where(live, cos * eta, 0) * w
        eta = -sin * eta
        more = beta_new > EPS * (np.abs(alpha) + beta)
        live = live & more
        v, v_old, beta = p / np.where(more, beta_new, 1), v, beta_new
    return x


def leading_pairs(product: Callable[[np.ndarray], np.ndarray], dim: int, k: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues (all, if fewer), falling, and their eigenvectors as columns, of a symmetric positive operator.
    Residuals are below 16 sqrt(dim) roundings of the largest eigenvalue."""
    k, tolerance = min(k, dim), 16 * np.sqrt(dim) * EPS
    start = np.random.default_rng(seed).normal(size=(dim, min(dim, k + 4)))
    locked = np.zeros((dim, 0))
    basis = _orthonormal(start)
    image = product(basis)
    largest = 0.0
    for _ in range(ROUNDS):
        small = basis.T @ image
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        largest = max(largest, float(values[0]))
        ritz, ritz_image = basis @ turn, image @ turn
        residual = ritz_image - ritz * values
        wanted = min(k - locked.shape[1], len(values))
        ready = np.linalg.norm(residual[:, :wanted], axis=0) <= tolerance * largest
        if locked.shape[1] + basis.shape[1] == dim:
            ready[:] = True  # the subspace is the whole space: nothing is left to correct
        done = wanted if ready.all() else int(np.argmin(ready))
        locked = np.column_stack([locked, ritz[:, :done]])
        if locked.shape[1] == k:
            image = product(locked)
            small = locked.T @ image
            values, turn = np.linalg.eigh((small + small.T) / 2)
            values, vectors, image = values[::-1], locked @ turn[:, ::-1], image @ turn[:, ::-1]
            worst = np.linalg.norm(image - vectors * values, axis=0).max()
            if worst <= 4 * tolerance * largest or k == dim:
                return values, vectors
            basis, image, locked = vectors, image, np.zeros((dim, 0))  # once more, from very near
            continue
        basis, image = ritz[:, done:], ritz_image[:, done:]
        open_pairs = np.flatnonzero(~ready[done:])
        near = np.column_stack([locked, basis[:, :wanted - done]])
        shift, right = values[done:][open_pairs], -residual[:, done:][:, open_pairs]

        def corrected(v: np.ndarray, near: np.ndarray = near, shift: np.ndarray = shift) -> np.ndarray:
            v = v - near @ (near.T @ v)
            v = product(v) - shift * v
            return v - near @ (near.T @ v)

        steps = minres(corrected, right - near @ (near.T @ right), INNER)
        if basis.shape[1] + len(open_pairs) > BASIS:
            basis, image = basis[:, :k + 8], image[:, :k + 8]
        fresh = _orthonormal(np.column_stack([steps, right]), locked, basis)[:, :dim - locked.shape[1] - basis.shape[1]]
        fresh = fresh[:, :max(1, len(open_pairs))]
        if not fresh.shape[1]:  # the corrections lie in the subspace: any other direction
            fresh = _orthonormal(np.random.default_rng(seed + basis.shape[1]).normal(size=(dim, 1)), locked, basis)
        basis, image = np.column_stack([basis, fresh]), np.column_stack([image, product(fresh)])
    raise ArithmeticError(f"no double precision after {ROUNDS} rounds")


# --- whitening ---

def square_sums(whole: np.ndarray) -> pa.Array:
    """The sum of squares of every row, exact: products of parts of 21 bits where 64 bits may not hold it."""
    size = np.abs(whole)
    if int(size.max()) ** 2 * whole.shape[1] < 1 << 63:
        return pa.array((whole * whole).sum(axis=1)).cast(EXACT)
    parts = [size >> 21 * k & (1 << 21) - 1 for k in range(3)]
    products = [sum((parts[i] * parts[k - i]).sum(axis=1) for i in range(3) if 0 <= k - i < 3) for k in range(5)]
    sums = sum(p.astype(object) << 21 * k for k, p in enumerate(products))
    if sums.max() >= 10 ** 38:
        raise OverflowError("a deviation is beyond 38 digits")
    return pa.array(sums.tolist(), EXACT)


def whitened(rows: DataFrame, components: int = 8) -> DataFrame:
    """One row for each usable vector and component: vec_id, component (from 1), n, deviation, whitened, explained,
    identity_error (see the contract of the query). The deviation, which grows with the square of n, is a decimal.
    Every direction is turned so that its largest entry is positive."""
    schema = ("vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, "
              "identity_error double")
    spark = rows.sparkSession
    with Scratch(spark) as tables:
        fit = fit_list(rows, tables)
        if fit is None:
            return spark.createDataFrame([], schema)
        trace = float(fit.summed(lambda z: np.array([(z * z).sum()]), (1,))[0]) / fit.n
        values, vectors = leading_pairs(fit.product, fit.dim, components)
        some = values > fit.dim * EPS * trace
        values, vectors = values[some], vectors[:, some]
        if not len(values):
            return spark.createDataFrame([], schema)
        vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(values))])
        scale, k = vectors / np.sqrt(values), len(values)
        covariance = fit.summed(lambda z: (z @ scale).T @ (z @ scale), (k, k)) / fit.n
        error, explained = float(np.abs(covariance - np.eye(k)).max()), values / trace
        own = Fit(None, fit.dim, fit.n, fit.sums)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for ids, width, raw in zip(batch.column("ids"), batch.column("width").to_pylist(), batch.column("x"), strict=True):
                    whole = own.deviations(width, raw.as_buffer())
                    m = len(whole)
                    each = pa.array(np.repeat(np.arange(m), k))
                    yield pa.record_batch([
                        ids.values.take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                        pa.array(np.full(m * k, own.n)), square_sums(whole).take(each),
                        pa.array(((whole / own.n) @ scale).ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error))],
                        names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

        return tables.written(fit.table.select("ids", "width", "x").mapInArrow(run, schema), stays=True)
