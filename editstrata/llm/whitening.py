"""Whitening by Golub-Kahan-Lanczos bidiagonalisation of the centred vectors.

With Y the centred rows, the recurrence builds orthonormal right vectors v and left vectors u with Y v_k = beta_(k-1) u_(k-1) + alpha_k u_k
and Y'u_k = alpha_k v_k + beta_k v_(k+1). Every step multiplies Y and then Y' in tasks, block by block. A left vector has an entry for each row; it is never
stored, because it is Y times a short coefficient vector, u = Y c: the task that reads a row makes its entries of all earlier left vectors
again, and from them the inner products that full reorthogonalisation needs. The right vectors are short and are reorthogonalised on the driver.
A step is repeated while its left vector is not orthogonal to double precision. Where the recurrence ends early (equal deviations, constant or
dependent dimensions), it starts anew from a direction orthogonal to all before, so that after as many steps as there are dimensions the small
bidiagonal matrix holds all of Y; its singular values and right vectors are the deviations and components.

What goes to and from the driver is a few vectors of one entry a dimension for every task; tasks' sums are added in groups of FAN before. The rows are packed once into blocks in the
shared folder, and each step reads these.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import scratch, written

#: Numbers in a packed block; tasks whose sums are added together at once.
BLOCK_VALUES, FAN = 1 << 15, 64
#: A component whose deviation is under this share of the greatest one's counts as none.
RANK = 1e-9
#: A left vector is orthogonal when its inner products with the earlier ones are under this share of its length.
_ORTHOGONAL = 1e-11
#: Larger components are taken as this, with their sign.
LARGEST = 1 << 45


@dataclass(frozen=True)
class Centre:
    """n rows whose dimensions sum up to n * whole + rest, with 0 <= rest < n."""

    n: int
    whole: np.ndarray
    rest: np.ndarray

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x less the mean, rounded once."""
        return (x - self.whole) - self.rest / self.n

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """For each row the exact sum of (n * x - S)**2; None where it does not fit a long."""
        about = ((self.n * self.centred(x)) ** 2).sum(1)
        out: list[int | None] = [None] * len(x)
        safe = about < 2.0**62
        for k, v in zip(np.flatnonzero(safe).tolist(), ((self.n * (x[safe] - self.whole) - self.rest) ** 2).sum(1).tolist(), strict=True):
            out[k] = v
        for k in np.flatnonzero(~safe & (about < 2.0**64)).tolist():
            v = sum((self.n * (int(a) - int(w)) - int(r)) ** 2 for a, w, r in zip(x[k], self.whole, self.rest, strict=True))
            out[k] = v if v < 2**63 else None
        return out


def _whole_numbers(batch: pa.RecordBatch, scale: float, shift: int) -> np.ndarray:
    """Rows of floor(scale * entry) + shift; the vectors are the batch's last column and of one length."""
    vectors = batch.column(batch.num_columns - 1)
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return (np.clip(np.floor(scale * flat), -LARGEST, LARGEST).astype(np.int64) + shift).reshape(len(vectors), -1)


def _packed(rows: DataFrame, scale: float, shift: int) -> DataFrame:
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _whole_numbers(batch, scale, shift)
                step = max(1, BLOCK_VALUES // x.shape[1])
                for at in range(0, len(x), step):
                    yield pa.RecordBatch.from_arrays([pa.array([len(x[at : at + step])], pa.int32()), pa.array([x[at : at + step].tobytes()], pa.binary())], ["n", "data"])

    return rows.select("embedding").mapInArrow(pack, "n int, data binary")


def _matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    for batch in batches:
        for n, data in zip(batch.column(0), batch.column(1), strict=True):
            yield np.frombuffer(data.as_buffer(), np.int64).reshape(n.as_py(), -1)


def _vector(x: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x.tolist()], pa.list_(pa.float64()))], ["sums"])


def _summed(blocks: DataFrame, centre: Centre, of: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over all blocks of what `of` gives for the block's centred rows."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [of(centre.centred(x)) for x in _matrices(batches)]
        if sums:
            yield _vector(np.sum(sums, axis=0))

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.array(v.values) for batch in batches for v in batch.column(0)]
        if sums:
            yield _vector(np.sum(sums, axis=0))

    groups = blocks.rdd.getNumPartitions() // FAN + 1
    found = blocks.mapInArrow(partial, "sums array<double>").repartition(groups).mapInArrow(added, "sums array<double>").collect()
    return np.sum([r["sums"] for r in found], axis=0)


def _centre(blocks: DataFrame) -> Centre:
    """Exact sums of all dimensions."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, None
        for x in _matrices(batches):
            n += len(x)
            s = x.sum(0).astype(object)
            total = s if total is None else total + s
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([-1, *range(len(total))], pa.int32()), pa.array([str(n), *map(str, total)])], ["dimension", "total"])

    found = {r["dimension"]: int(r["total"]) for r in blocks.mapInArrow(sums, "dimension int, total string").groupBy("dimension").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()}
    n = found.pop(-1)
    parts = [divmod(found[k], n) for k in sorted(found)]
    return Centre(n, np.array([p[0] for p in parts], np.int64), np.array([p[1] for p in parts], np.int64))


def _free(known: list[np.ndarray], vector: np.ndarray) -> np.ndarray:
    """`vector` less its part in the span of the orthonormal vectors `known`, taken off twice."""
    if known:
        basis = np.array(known)
        for _ in range(2):
            vector = vector - basis.T @ (basis @ vector)
    return vector


def bidiagonalised(products: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, float, np.ndarray]], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Right vectors (rows), the diagonal and the upper diagonal of the bidiagonal form of Y, after `size` steps, the number of its columns.

    products(C, c) gives, for the left vectors Y C and w = Y c: their inner products with w, the square of w's length, and Y'w.
    """
    rng = np.random.default_rng(11)
    right: list[np.ndarray] = []
    left: list[np.ndarray] = []  # coefficients c of u = Y c
    images: list[np.ndarray] = []  # Y'u
    alphas, betas = np.zeros(size), np.zeros(size)
    v = rng.normal(size=size)
    v /= np.linalg.norm(v)
    greatest = 0.0
    for k in range(size):
        right.append(v)
        c = v - betas[k - 1] * left[k - 1] if k else v
        while True:
            known = np.array(left).reshape(k, size)
            inner, square, image = products(known, c)
            c, image = c - known.T @ inner, image - np.array(images).reshape(k, size).T @ inner
            alpha = max(square - inner @ inner, 0.0) ** 0.5
            greatest = max(greatest, square**0.5, alpha)
            if alpha <= 1e-13 * greatest or np.abs(inner).max(initial=0) <= _ORTHOGONAL * alpha:
                break
        if alpha <= 1e-13 * greatest:
            alpha, c, image = 0.0, np.zeros(size), np.zeros(size)
        else:
            c, image = c / alpha, image / alpha
        alphas[k] = alpha
        left.append(c)
        images.append(image)
        if k + 1 == size:
            break
        rest = _free(right, image - alpha * v)
        beta = float(np.linalg.norm(rest))
        if beta <= 1e-13 * greatest:  # the span is closed: go on from any other direction
            beta, rest = 0.0, _free(right, rng.normal(size=size))
        betas[k] = beta
        v = _free(right, rest / np.linalg.norm(rest))
        v /= np.linalg.norm(v)
    return np.array(right), alphas, betas[:-1]


def whitened(vectors: DataFrame, *, components: int = 8, scale: float = 1024, shift: int = 100_000) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error for each row of `vectors` (vec_id, embedding) and component.

    An entry c counts as floor(scale * c) + shift in double precision (scale * c at most 2**45 in magnitude). Rows with a null vector or a null or non-finite entry are dropped, and
    so are empty vectors and those of another length than the most frequent one (of equally frequent ones the longest). All others are the fit list: components are
    unit eigenvectors of its covariance (divisor n), from 1 by falling eigenvalue, at most `components` of them and only those whose deviation is
    over RANK of the greatest. deviation is the exact sum of (n * x - S)**2, null where it does not fit a long; whitened is the
    centred row's projection over the component's deviation; explained is the eigenvalue's share of the trace; identity_error
    is the largest entry of the whitened rows' covariance less the identity, measured over all rows.

    Rows of a null or repeated vec_id are rows like others. One row, or rows that are all equal, have no component and so no result. Other columns are ignored; an empty table gives an empty result.
    """
    spark = vectors.sparkSession
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").filter(F.col("embedding").isNotNull() & finite & (F.size("embedding") > 0))
    usual = rows.groupBy(F.size("embedding").alias("length")).count().orderBy(F.desc("count"), F.desc("length")).first()
    if usual is None:
        return spark.createDataFrame([], schema)
    rows = rows.filter(F.size("embedding") == usual["length"])
    with scratch(spark):
        blocks = written(_packed(rows, scale, shift), "vectors")
        centre = _centre(blocks)

        def products(known: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, float, np.ndarray]:
            every = np.vstack([known, c]).T

            def of(y: np.ndarray) -> np.ndarray:
                u = y @ every
                return np.concatenate([u.T @ u[:, -1], y.T @ u[:, -1]])

            sums, k = _summed(blocks, centre, of), len(known)
            return sums[:k], float(sums[k]), sums[k + 1 :]

        right, alphas, betas = bidiagonalised(products, usual["length"])
        _, singular, turned = np.linalg.svd(np.diag(alphas) + np.diag(betas, 1))
        found = int((singular[:components] > RANK * singular[0]).sum()) if singular[0] > 0 else 0
        if not found:
            return spark.createDataFrame([], schema)
        values = singular[:found] ** 2 / centre.n
        axes = (turned[:found] @ right).T / values**0.5

        def spread(y: np.ndarray) -> np.ndarray:
            w = y @ axes
            return np.concatenate([(w.T @ w).ravel(), w.sum(0), [(y * y).sum()]])

        sums = _summed(blocks, centre, spread) / centre.n
        mean = sums[found * found : -1]
        error = float(np.abs(sums[: found * found].reshape(found, found) - np.outer(mean, mean) - np.eye(found)).max())
        shares = values / sums[-1]

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _whole_numbers(batch, scale, shift)
                w = centre.centred(x) @ axes
                each = np.repeat(np.arange(len(x)), found)
                component = np.tile(np.arange(found), len(x))
                columns = [batch.column(0).take(pa.array(each)), pa.array(component + 1, pa.int32()), pa.array(np.full(len(each), centre.n)), pa.array(centre.deviations(x), pa.int64()).take(pa.array(each)), pa.array(w.ravel()), pa.array(shares[component]), pa.array(np.full(len(each), error))]
                yield pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in schema.split(", ")])

    return rows.mapInArrow(project, schema)
