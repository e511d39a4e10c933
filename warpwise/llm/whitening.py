"""Whitening of embeddings by Golub-Kahan-Lanczos bidiagonalisation.

The entries of a vector become whole numbers x = floor(scale * entry). Mean and covariance are those of the fit list, each
distinct x once. With the centred fit list as matrix X, one row a vector, the recurrence

    alpha_k u_k = X v_k - beta_(k-1) u_(k-1),    beta_k v_(k+1) = X' u_k - alpha_k v_k

makes X V = U B with a small upper bidiagonal B, whose singular value decomposition on the driver yields the components
(V times its right vectors) and the deviations (its singular values over the root of n).

Vectors v have one entry per dimension and stay on the driver. Vectors u have one entry per row and are never stored: u_k = X w_k for
a w_k of one entry per dimension, so each task gets its rows of u back by one product. A step is one pass over the
written fit list: every task forms its rows of X w, their products with all earlier u (for full reorthogonalisation) and with X;
these sums, some two numbers per dimension and task, are added up by Spark. The v are reorthogonalised on the driver.

The bidiagonalisation runs through all dimensions up to FULL_STEPS of them, so equal eigenvalues are all found: where a
beta vanishes it goes on from a new direction orthogonal to the others. Beyond that many dimensions it ends when the wanted
components have converged to double precision; of exactly equal eigenvalues one direction may then be found only.

Defined cases: rows whose vector is null or holds null, NaN or an infinity are left out, and so are vectors shorter than the
longest one; no rows left, or no variance, give an empty result; components of zero variance (relative to the largest, by
rounding) are not returned; repeated rows are returned each, and counted once in the fit; a deviation that does not fit a
long is null; columns named like the outputs are replaced, all others of ``keep`` are carried, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..runtime import materialise
from .columns import column, without

SCALE = 256
COMPONENTS = 4
FULL_STEPS = 128  # dimensions up to which the bidiagonalisation is complete
VANISHED = 1e-12  # of the largest singular value
_LONG = (1 << 63) - 1


@dataclass
class Whitening:
    """A fitted transformation; small, lives on the driver."""

    n: int  # vectors of the fit list
    sums: list[int]  # per dimension
    trace: float  # of the covariance
    components: np.ndarray  # one column each
    variances: np.ndarray  # eigenvalues, falling
    identity_error: float = 0.0

    @property
    def explained(self) -> np.ndarray:
        return self.variances / self.trace


def whole_numbers(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * entry) of each entry as long; null for a null vector or one with an entry that is not finite."""
    finite = F.forall(vector, lambda c: c.isNotNull() & (F.abs(c.cast("double")) < F.lit(math.inf)))
    return F.when(finite, F.transform(vector, lambda c: F.floor(c.cast("double") * F.lit(float(scale))).cast("long")))


def _matrix(lists: pa.Array, dimensions: int) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, dimensions)


def _split_mean(total: int, n: int) -> tuple[int, float]:
    """A mean as a whole number and the rest, so that centring loses nothing to large means."""
    whole = round(Fraction(total, n))
    return whole, float(Fraction(total, n) - whole)


def _centring(sums: list[int], n: int) -> Callable[[np.ndarray], np.ndarray]:
    split = [_split_mean(s, n) for s in sums]
    whole, rest = np.array([w for w, _ in split], np.int64), np.array([r for _, r in split])
    return lambda x: (x - whole).astype(np.float64) - rest


def _summed(fit: DataFrame, dimensions: int, work: Callable[[np.ndarray], np.ndarray], size: int) -> np.ndarray:
    """The sum of ``work`` (a vector of ``size`` numbers) over all blocks of the fit list; each task adds its blocks up first."""

    def run(batches):
        total = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                total += work(_matrix(batch.column(0), dimensions))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int32)), pa.array(total)], names=["at", "part"])

    rows = fit.mapInArrow(run, "at int, part double").groupBy("at").agg(F.sum("part").alias("part")).toArrow()
    total = np.zeros(size)
    total[rows["at"].to_numpy()] = rows["part"].to_numpy()
    return total


def _moments(fit: DataFrame, dimensions: int) -> tuple[int, list[int], int]:
    """Number of vectors, sum of each dimension and sum of all squares, exact."""

    def run(batches):
        count, sums, squares = 0, [0] * dimensions, 0
        for batch in batches:
            x = _matrix(batch.column(0), dimensions)
            if not len(x):
                continue
            largest = int(max(-int(x.min()), int(x.max()), 1))
            if largest * largest * x.size > _LONG:
                x = x.astype(object)  # Python's whole numbers have no bound
            count += len(x)
            sums = [a + int(b) for a, b in zip(sums, x.sum(axis=0))]
            squares += int((x * x).sum())
        values = pa.array([count, *sums, squares], pa.decimal128(38, 0))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dimensions + 2, dtype=np.int32)), values], names=["at", "part"])

    rows = fit.mapInArrow(run, "at int, part decimal(38,0)").groupBy("at").agg(F.sum("part").alias("part")).collect()
    values = [int(v) for _, v in sorted((r["at"], r["part"]) for r in rows)] or [0] * (dimensions + 2)
    return values[0], values[1:-1], values[-1]


def bidiagonalised(
    product: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, float, np.ndarray]], dimensions: int, wanted: int, seed: int = 7
) -> tuple[np.ndarray, np.ndarray]:
    """Right vectors (columns) and singular values, falling, of the matrix behind ``product``.

    ``product(w, W)`` gives, with u = X w and the columns of U = X W: U'u, u'u and X'u.
    """
    random = np.random.default_rng(seed)
    v = np.zeros((dimensions, 0))  # orthonormal
    w = np.zeros((dimensions, 0))  # u_k = X w_k
    z = np.zeros((dimensions, 0))  # X' u_k
    alphas: list[float] = []
    betas: list[float] = []

    def new_direction() -> np.ndarray:
        direction = random.standard_normal(dimensions)
        for _ in range(3):
            direction -= v @ (v.T @ direction)
        return direction / np.linalg.norm(direction)

    direction = new_direction()
    while True:
        v = np.column_stack([v, direction])
        beta = betas[-1] if betas else 0.0
        start = direction - beta * w[:, -1] if beta else direction
        along, square, back = product(start, w)
        start, back = start - w @ along, back - z @ along
        alpha = math.sqrt(max(square - float(along @ along), 0.0))
        largest = max([alpha, *alphas, *betas])
        if alpha > VANISHED * largest:
            w, z = np.column_stack([w, start / alpha]), np.column_stack([z, back / alpha])
        else:  # X maps this direction into what is known
            alpha = 0.0
            w, z = np.column_stack([w, np.zeros(dimensions)]), np.column_stack([z, np.zeros(dimensions)])
        alphas.append(alpha)
        known = len(alphas)
        if known == dimensions:
            break
        rest = z[:, -1] - alpha * direction
        for _ in range(2):
            rest -= v @ (v.T @ rest)
        beta = float(np.linalg.norm(rest))
        if beta > VANISHED * largest:
            direction = rest / beta
        else:
            beta, direction = 0.0, new_direction()
        if dimensions > FULL_STEPS and known > wanted and beta:
            left, values, _ = np.linalg.svd(np.diag(alphas) + np.diag(betas, 1))
            if np.all(beta * np.abs(left[-1, :wanted]) <= 1e-14 * values[0]):
                break
        betas.append(beta)
    _, values, right = np.linalg.svd(np.diag(alphas) + np.diag(betas[: len(alphas) - 1], 1))
    return v @ right.T, values


def fit(vectors: DataFrame, vector: str = "embedding", components: int = COMPONENTS, scale: int = SCALE) -> Whitening | None:
    """The whitening of the distinct vectors of column ``vector``; None without any variance."""
    numbers = vectors.select(whole_numbers(column(vector), scale).alias("x")).where("size(x) > 0")
    distinct = materialise(numbers.distinct(), "distinct-vectors")
    dimensions = distinct.agg(F.max(F.size("x"))).first()[0]
    if not dimensions:
        return None
    fitted = distinct.where(F.size("x") == dimensions)
    n, sums, squares = _moments(fitted, dimensions)
    trace = float(Fraction(n * squares - sum(s * s for s in sums), n * n))
    if trace <= 0:
        return None
    centred = _centring(sums, n)

    def product(w, earlier):
        known = earlier.shape[1]

        def work(x):
            x = centred(x)
            u = x @ w
            return np.concatenate([(x @ earlier).T @ u, [u @ u], u @ x])

        found = _summed(fitted, dimensions, work, known + 1 + dimensions)
        return found[:known], float(found[known]), found[known + 1 :]

    right, values = bidiagonalised(product, dimensions, components)
    some = np.flatnonzero(values > VANISHED * values[0] * math.sqrt(dimensions))[:components]
    made = Whitening(n, sums, trace, right[:, some], values[some] ** 2 / n)
    made.identity_error = _identity_error(fitted, dimensions, made)
    return made


def _identity_error(fitted: DataFrame, dimensions: int, made: Whitening) -> float:
    """Largest entry of the whitened vectors' covariance minus the identity."""
    centred, weights = _centring(made.sums, made.n), made.components / np.sqrt(made.variances)
    count = weights.shape[1]

    def work(x):
        white = centred(x) @ weights
        return np.concatenate([white.sum(axis=0), (white.T @ white).ravel()])

    total = _summed(fitted, dimensions, work, count + count * count) / made.n
    mean, products = total[:count], total[count:].reshape(count, count)
    return float(np.abs(products - np.outer(mean, mean) - np.eye(count)).max())


def _deviations(x: np.ndarray, sums: list[int], n: int) -> list[int | None]:
    """The sum over dimensions of (n x - sum) squared, exact; None where it does not fit a long."""
    largest = n * max(-int(x.min()), int(x.max()), 1) + max(map(abs, sums))
    if largest * largest * x.shape[1] <= _LONG:
        apart = n * x - np.array(sums, np.int64)
        return (apart * apart).sum(axis=1).tolist()
    apart = n * x.astype(object) - np.array(sums, object)
    return [d if d <= _LONG else None for d in (apart * apart).sum(axis=1).tolist()]


OUTPUTS = "component int, n long, deviation long, whitened double, explained double, identity_error double"


def whitened(
    vectors: DataFrame, made: Whitening | None, vector: str = "embedding", keep: list[str] | None = None, scale: int = SCALE
) -> DataFrame:
    """One row per vector that is not left out and component: the columns ``keep`` and OUTPUTS."""
    outputs = T.StructType.fromDDL(OUTPUTS)
    carried = without(vectors.select(*[column(c) for c in keep]) if keep is not None else vectors, outputs.names)
    if made is None:
        none = [F.lit(None).cast(f.dataType).alias(f.name) for f in outputs]
        return vectors.limit(0).select(*[column(c) for c in carried], *none)
    dimensions, count = made.components.shape
    rows = vectors.select(F.struct(*[column(c) for c in carried]).alias("row"), whole_numbers(column(vector), scale).alias("x"))
    rows = rows.where(F.size("x") == dimensions)
    centred, weights = _centring(made.sums, made.n), made.components / np.sqrt(made.variances)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(1), dimensions)
            white = pa.ListArray.from_arrays(np.arange(0, x.shape[0] * count + 1, count, dtype=np.int32), pa.array((centred(x) @ weights).ravel()))
            deviations = pa.array(_deviations(x, made.sums, made.n), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), deviations, white], names=["row", "deviation", "white"])

    schema = T.StructType([rows.schema["row"], T.StructField("deviation", T.LongType()), T.StructField("white", T.ArrayType(T.DoubleType()))])
    explained = F.array(*[F.lit(float(e)) for e in made.explained])
    return (
        rows.mapInArrow(run, schema)
        .select("row", "deviation", F.posexplode("white").alias("at", "whitened"))
        .select(
            *[F.col("row").getField(c).alias(c) for c in carried],
            (F.col("at") + 1).cast("int").alias("component"),
            F.lit(made.n).cast("long").alias("n"),
            "deviation",
            "whitened",
            F.element_at(explained, F.col("at") + 1).alias("explained"),
            F.lit(made.identity_error).alias("identity_error"),
        )
    )
