"""Embedding whitening: leading principal components by Jacobi-Davidson, and all vectors projected on them.

The covariance is never formed. It is only multiplied by blocks of vectors: every task centres its rows and adds up what
they give, and Spark adds up the tasks. On the driver are a search space and a few blocks, whose size follows the
number of dimensions and not that of the rows. Ritz pairs are improved together: the projected correction equations of
all that have not converged are solved by a few MINRES steps in lockstep, so that one pass over the rows serves all of them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventdocs.llm.common import summed

#: An entry c becomes floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 64, 1_000_000
#: Scaled entries beyond this have no exact sums in 64 bits; such a vector is left out like one that is not finite.
LARGEST = float(1 << 52)
COMPONENTS = 32
#: Further directions in the search space, MINRES steps of a correction, and rounds at most.
GUARD, INNER, ROUNDS = 8, 5, 60
#: A residual counts as zero below so many units of rounding of the largest eigenvalue, times the root of the dimensions.
TOLERANCE = 16
_EPS = float(np.finfo(float).eps)


def _entries(batch: pa.RecordBatch, column: str, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of usable vectors, and their entries as integers."""
    lists = batch.column(column)
    right = pc.fill_null(pc.equal(pc.list_value_length(lists), dims), False)
    rows = np.flatnonzero(right.to_numpy(zero_copy_only=False))
    flat = lists.take(pa.array(rows)).flatten().cast(pa.float64())
    values = SCALE * flat.to_numpy(zero_copy_only=False).reshape(len(rows), dims)
    with np.errstate(invalid="ignore"):
        usable = (np.abs(values) < LARGEST).all(1)
    return rows[usable], np.floor(values[usable]).astype(np.int64) + SHIFT


@dataclass(frozen=True)
class Moments:
    """Number of vectors, and the sums of their integers by dimension, as whole numbers."""

    n: int
    sums: tuple[int, ...]

    def centre(self) -> tuple[np.ndarray, np.ndarray]:
        """(base, rest): x - S/n is (x - base) - rest/n, both parts small and exact."""
        base = [(2 * s + self.n) // (2 * self.n) for s in self.sums]
        return np.array(base, np.int64), np.array([s - self.n * b for s, b in zip(self.sums, base)], np.int64)


def moments(vectors: DataFrame, column: str, dims: int) -> Moments:
    def partial(batch: pa.RecordBatch) -> np.ndarray:
        _, x = _entries(batch, column, dims)
        return np.concatenate([[len(x)], (x >> 20).sum(0), (x & 0xFFFFF).sum(0)]).astype(np.int64)

    found = summed(vectors.select(column), partial, np.int64)
    if found is None:
        return Moments(0, (0,) * dims)
    high, low = found[1 : 1 + dims].tolist(), found[1 + dims :].tolist()
    return Moments(int(found[0]), tuple((h << 20) + v for h, v in zip(high, low)))


def dimensions(vectors: DataFrame, column: str) -> int:
    """The most frequent length of a vector, of equally frequent ones the largest; 0 without vectors."""
    sizes = vectors.select(F.size(column).alias("size")).where("size > 0").groupBy("size").count()
    found = sizes.orderBy(F.desc("count"), F.desc("size")).first()
    return found["size"] if found else 0


def _orthonormal(block: np.ndarray, *others: np.ndarray) -> np.ndarray:
    """A basis of what ``block`` adds to the spaces of ``others``."""
    size = np.linalg.norm(block, axis=0)
    block = block[:, size > 0] / size[size > 0]
    for _ in range(2):
        for other in others:
            block = block - other @ (other.T @ block)
        if not block.shape[1]:
            return block
        left, weight, _ = np.linalg.svd(block, full_matrices=False)
        block = left[:, weight > 1e-10 * max(1.0, weight[0])]
    return block


def minres(apply: Callable[[np.ndarray], np.ndarray], right: np.ndarray, steps: int) -> np.ndarray:
    """Approximate solutions of one symmetric system per column, each by ``steps`` MINRES steps, all in lockstep."""

    def safe(x: np.ndarray) -> np.ndarray:
        return np.where(x > 0, x, 1.0)

    size = np.linalg.norm(right, axis=0)
    v, before, beta = right / safe(size), np.zeros_like(right), np.zeros(right.shape[1])
    x, w, w_before, eta = np.zeros_like(right), np.zeros_like(right), np.zeros_like(right), size
    cos, cos_before, sin, sin_before = (np.full(right.shape[1], f) for f in (1.0, 1.0, 0.0, 0.0))
    for _ in range(steps):
        following = apply(v)
        alpha = (v * following).sum(0)
        following = following - alpha * v - beta * before
        further = np.linalg.norm(following, axis=0)
        delta = cos * alpha - cos_before * sin * beta
        first = np.hypot(delta, further)
        second, third = sin * alpha + cos_before * cos * beta, sin_before * beta
        live = first > 0
        w, w_before = np.where(live, (v - third * w_before - second * w) / safe(first), 0.0), w
        cos, cos_before, sin, sin_before = delta / safe(first), cos, further / safe(first), sin
        x = x + np.where(live, cos * eta, 0.0) * w
        eta = -sin * eta
        before, v, beta = v, following / safe(further), further
    return x


def jacobi_davidson(
    product: Callable[[np.ndarray], np.ndarray], dims: int, count: int, seed: int = 13
) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` largest eigenvalues, falling, and unit eigenvectors of a symmetric matrix that only ``product`` knows.

    Subspace Rayleigh-Ritz with locking: pairs whose residual is rounding only are set aside, the search space stays
    orthogonal to them, and for the others the correction equation, projected on what is orthogonal to all of them, is
    solved by MINRES. Raises if residuals do not reach rounding within ROUNDS rounds.
    """
    count = min(count, dims)
    random = np.random.default_rng(seed)
    space = np.linalg.qr(random.normal(size=(dims, min(dims, count + GUARD))))[0]
    image = product(space)
    locked, values = np.zeros((dims, 0)), np.zeros(0)
    most = 3 * count + GUARD
    for _ in range(ROUNDS):
        small = space.T @ image
        ritz, turn = np.linalg.eigh((small + small.T) / 2)
        ritz, turn = ritz[::-1], turn[:, ::-1]
        space, image = space @ turn, image @ turn
        want = count - len(values)
        residual = image[:, :want] - space[:, :want] * ritz[:want]
        residual -= locked @ (locked.T @ residual)
        scale = max(ritz[0], values.max(initial=0.0), 0.0)
        done = np.linalg.norm(residual, axis=0) <= TOLERANCE * _EPS * np.sqrt(dims) * scale
        if space.shape[1] + len(values) == dims:
            done[:] = True  # the space is all there is, so Rayleigh-Ritz is exact
        left = np.append(~done, np.ones(space.shape[1] - want, bool))
        locked, values = np.hstack([locked, space[:, ~left]]), np.append(values, ritz[~left])
        if len(values) == count:
            order = np.argsort(-values, kind="stable")
            vectors = locked[:, order]
            signs = np.sign(vectors[np.abs(vectors).argmax(0), np.arange(count)])
            return values[order], vectors * signs
        space, image, ritz, residual = space[:, left], image[:, left], ritz[left], residual[:, ~done]
        open_pairs = residual.shape[1]
        out = np.hstack([locked, space[:, :open_pairs]])

        def projected(block: np.ndarray) -> np.ndarray:
            return block - out @ (out.T @ block)

        shift = ritz[:open_pairs]
        change = minres(lambda v: projected(product(v) - shift * v), projected(-residual), INNER)
        if space.shape[1] + open_pairs > most:
            kept = min(space.shape[1], open_pairs + count)
            space, image = space[:, :kept], image[:, :kept]
        new = _orthonormal(projected(change), locked, space)
        if not new.shape[1]:
            new = _orthonormal(random.normal(size=(dims, GUARD)), locked, space)
        new = new[:, : dims - len(values) - space.shape[1]]
        space, image = np.hstack([space, new]), np.hstack([image, product(new)])
    raise ArithmeticError(f"{count - len(values)} of {count} components have not converged")


@dataclass(frozen=True)
class Whitening:
    """Components by falling eigenvalue, as columns; without any where all vectors are equal."""

    column: str
    moments: Moments
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    @property
    def dims(self) -> int:
        return len(self.moments.sums)


def fit(vectors: DataFrame, column: str = "embedding", count: int = COMPONENTS) -> Whitening:
    """Components of the covariance of all usable vectors: at most ``count``, and those of eigenvalue 0 are left out."""
    dims = dimensions(vectors, column)
    first = moments(vectors, column, dims) if dims else Moments(0, ())
    if not first.n:
        return Whitening(column, first, np.zeros(0), np.zeros((dims, 0)), 0.0)
    n = first.n
    base, rest = first.centre()
    offset = rest / n

    def centred(batch: pa.RecordBatch) -> np.ndarray:
        return (_entries(batch, column, dims)[1] - base) - offset

    rows = vectors.select(column)

    def product(block: np.ndarray) -> np.ndarray:
        def partial(batch: pa.RecordBatch) -> np.ndarray:
            c = centred(batch)
            return (c.T @ (c @ block)).ravel()

        return summed(rows, partial).reshape(block.shape) / n

    trace = float(summed(rows, lambda batch: np.array([(centred(batch) ** 2).sum()]))[0]) / n
    if not trace:
        return Whitening(column, first, np.zeros(0), np.zeros((dims, 0)), 0.0)
    values, found = jacobi_davidson(product, dims, count)
    real = values > 16 * dims * _EPS * values[0]
    return Whitening(column, first, values[real], found[:, real], trace)


def whiten(vectors: DataFrame, fitted: Whitening, key: str = "vec_id") -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error): a row for each usable vector and component.

    Left out are vectors that are null, hold null, infinite, not-a-number or immense entries, or have another length than
    most. Null and repeated keys stay as they are, each row gives its own rows; other columns are not read. Where all
    vectors are equal, or there are none, there are no components and no rows. ``deviation`` is null where it exceeds 64
    bits. Components of equal eigenvalues are any basis of their space.
    """
    column, dims, n = fitted.column, fitted.dims, fitted.moments.n
    count = len(fitted.values)
    schema = T.StructType(
        [
            vectors.schema[key],
            T.StructField("component", T.IntegerType()),
            T.StructField("n", T.LongType()),
            T.StructField("deviation", T.LongType()),
            T.StructField("whitened", T.DoubleType()),
            T.StructField("explained", T.DoubleType()),
            T.StructField("identity_error", T.DoubleType()),
        ]
    )
    if not count:
        return vectors.sparkSession.createDataFrame([], schema)
    base, rest = fitted.moments.centre()
    offset, scaled = rest / n, fitted.vectors / np.sqrt(fitted.values)
    explained = fitted.values / fitted.trace

    def projected(x: np.ndarray) -> np.ndarray:
        return ((x - base) - offset) @ scaled

    def partial(batch: pa.RecordBatch) -> np.ndarray:
        z = projected(_entries(batch, column, dims)[1])
        return np.concatenate([z.sum(0), (z.T @ z).ravel()])

    total = summed(vectors.select(column), partial) / n
    mean, square = total[:count], total[count:].reshape(count, count)
    error = float(np.abs(square - np.outer(mean, mean) - np.eye(count)).max())

    def deviations(x: np.ndarray) -> pa.Array:
        far = np.abs((x - base).astype(float)).max(initial=0.0) * n + n
        if far * far * dims < 2.0**62:
            return pa.array(((n * (x - base) - rest) ** 2).sum(1))
        exact = (((x - base).astype(object) * n - rest.astype(object)) ** 2).sum(1)
        return pa.array([int(v) if v < 1 << 63 else None for v in exact], pa.int64())

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                batch = whole.slice(at, 4096)
                own, x = _entries(batch, column, dims)
                each = pa.array(np.repeat(np.arange(len(own)), count))
                arrays = [
                    batch.column(key).take(pa.array(own)).take(each),
                    pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), len(own))),
                    pa.array(np.full(len(each), n, np.int64)),
                    deviations(x).take(each),
                    pa.array(projected(x).ravel()),
                    pa.array(np.tile(explained, len(own))),
                    pa.array(np.full(len(each), error)),
                ]
                yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return vectors.select(key, column).mapInArrow(rows, schema)
