"""Whitening of embeddings by the leading eigenvectors of their covariance, found by LOBPCG.

The covariance is never formed: a round multiplies it by a block of directions in one pass over the centred rows.
Each task sums its rows' share, and the shares are added by dimension in a shuffle, so the driver sees a block of
(dimensions x directions) numbers, whatever the number of rows. The Rayleigh-Ritz step on the span of iterate,
residuals and previous directions is a small dense problem.

Components are whole numbers here, so counts, sums and deviations are exact and centring loses nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelmint.llm.common import commonest_length, durable, finite, lean, matrix, table, whole

#: A component becomes floor(SCALE * c) + OFFSET.
SCALE, OFFSET = 64, 1_000_000
#: Directions of a block beyond those asked for: they speed up the last ones asked for.
GUARD = 4
#: A residual this small against the largest eigenvalue certifies a direction; LEAST is what must be reached if rounding stops all progress before.
CERTIFIED, LEAST = 1e-13, 1e-10
#: Eigenvalues below this share of the largest are no component: their directions are rounding.
FLAT = 1e-10


@dataclass(frozen=True)
class Centre:
    """n distinct vectors with the sums n * base + rest, 0 <= rest < n, all whole numbers."""

    n: int
    base: np.ndarray
    rest: np.ndarray

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - sums / n, off by one rounding: the whole part is taken off first."""
        return (x - self.base).astype(float) - self.rest / self.n

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """The sum over dimensions of (n * x - sums) ** 2 of each row, exact; None beyond a long."""
        a, r = x - self.base, self.rest
        most = int(np.abs(a).max(initial=0))
        if most * max(most, self.n) * a.shape[1] >= 1 << 62:
            a, r = a.astype(object), r.astype(object)
        squares, mixed = (a * a).sum(1).astype(object), (a * r).sum(1).astype(object)
        rest = sum(int(v) ** 2 for v in r)
        return [int(v) if v < 1 << 63 else None for v in self.n * self.n * squares - 2 * self.n * mixed + rest]


def centre(fit: DataFrame, dims: int) -> Centre:
    """The count and exact sums of fit (x array of long): whole sums of each task, added by dimension."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, np.zeros(dims, object)
        for batch in batches:
            x = matrix(batch.column("x"), dims)
            n += len(x)
            wide = int(np.abs(x).max(initial=0)) * len(x) >= 1 << 62
            sums = sums + (x.astype(object).sum(0) if wide else x.sum(0).astype(object))
        if n:
            yield pa.record_batch({"i": pa.array(range(dims), pa.int32()), "n": pa.array([n] * dims, pa.int64()), "total": pa.array([int(v) for v in sums], pa.decimal128(38))})

    rows = fit.select("x").mapInArrow(partial, "i int, n long, total decimal(38,0)").groupBy("i").agg(F.sum("n"), F.sum("total")).collect()
    n = rows[0][1] if rows else 0
    sums = [int(total) for _, _, total in sorted(rows)]
    return Centre(n, np.array([s // n for s in sums], np.int64), np.array([s % n for s in sums], np.int64))


def covariance_times(fit: DataFrame, at: Centre, block: np.ndarray) -> tuple[np.ndarray, float]:
    """The covariance of fit times a block of directions, and the covariance's trace: one pass, one small shuffle."""
    dims, width = block.shape

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, trace = np.zeros((dims, width)), 0.0
        for batch in batches:
            y = at.centred(matrix(batch.column("x"), dims))
            out += y.T @ (y @ block)
            trace += float((y * y).sum())
        yield pa.record_batch({"i": pa.array(range(-1, dims), pa.int32()), "row": pa.array([[trace] * width, *out.tolist()], pa.list_(pa.float64()))})

    rows = fit.select("x").mapInArrow(partial, "i int, row array<double>").groupBy("i").agg(*[F.sum(F.col("row")[j]).alias(f"c{j}") for j in range(width)]).collect()
    found = np.array([r[1:] for r in sorted(rows)]) / at.n
    return found[1:], float(found[0, 0])


def basis(first: np.ndarray, *more: np.ndarray) -> np.ndarray:
    """first (orthonormal) and an orthonormal basis of what the further blocks add to its span; what is dependent up to rounding goes."""
    rest = np.column_stack([first[:, :0], *more])
    size = np.linalg.norm(rest, axis=0)
    rest = rest[:, size > 0] / size[size > 0]
    if not rest.shape[1]:
        return first
    for _ in range(2):
        rest = rest - first @ (first.T @ rest)
    u, s, _ = np.linalg.svd(rest, full_matrices=False)
    u = u[:, s > 1e-9]
    u = u - first @ (first.T @ u)
    return np.linalg.qr(np.column_stack([first, u]))[0][:, : first.shape[0]]


def lobpcg(times: Callable[[np.ndarray], np.ndarray], dims: int, k: int, guard: int = GUARD, rounds: int = 500) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues, falling, and their unit eigenvectors, of the symmetric positive operator `times`.

    Each round asks for one product with a basis of iterate, residuals and previous directions. It ends when the
    residuals of all k are certified, or when they no longer fall and are below the least demand; otherwise it fails.
    """
    x = np.linalg.qr(np.random.default_rng(17).normal(size=(dims, min(dims, k + guard))))[0]
    width, blocks, best, stuck = x.shape[1], [], np.inf, 0
    for _ in range(rounds):
        q = basis(x, *blocks)
        product = times(q)
        g = q.T @ product
        value, c = np.linalg.eigh((g + g.T) / 2)
        value, c = value[::-1][:width], c[:, ::-1][:, :width]
        new = q @ c
        residual = product @ c - new * value
        worst = float(np.linalg.norm(residual[:, :k], axis=0).max(initial=0) / max(value[0], np.finfo(float).tiny))
        stuck = 0 if worst < best / 2 else stuck + 1
        best = min(best, worst)
        x = np.linalg.qr(new)[0]
        x = x * np.sign((x * new).sum(0))
        if worst <= CERTIFIED or (stuck >= 10 and worst <= LEAST):
            return value[:k], x[:, :k]
        # the part of the step that lies outside the last iterate
        previous = q[:, width:] @ c[width:]
        blocks = [residual, previous] if q.shape[1] > width else [residual]
    raise RuntimeError(f"residuals did not come below {LEAST} of the largest eigenvalue in {rounds} rounds")


@dataclass(frozen=True)
class Whitening:
    """Where vectors are centred, the components' eigenvalues and unit directions, their shares of the trace, and how far from the identity the whitened covariance is."""

    at: Centre
    values: np.ndarray
    directions: np.ndarray
    explained: np.ndarray
    identity_error: float


def fit_whitening(fit: DataFrame, dims: int, k: int) -> Whitening | None:
    """The whitening of distinct vectors (x array of long, all of length dims), None if they do not vary."""
    at = centre(fit, dims)
    k = min(k, dims)
    _, trace = covariance_times(fit, at, np.zeros((dims, 1)))
    if trace <= 0:
        return None
    values, u = lobpcg(lambda block: covariance_times(fit, at, block)[0], dims, k)
    kept = values > FLAT * values[0]
    values, u = values[kept], u[:, kept]
    u = u * np.sign(u[np.abs(u).argmax(0), np.arange(u.shape[1])])
    # a last pass certifies the directions themselves and gives the covariance of what they whiten
    product, _ = covariance_times(fit, at, u)
    worst = np.linalg.norm(product - u * values, axis=0).max() / values[0]
    if worst > LEAST:
        raise RuntimeError(f"a residual of {worst:.1e} is left")
    error = np.abs(u.T @ product / np.sqrt(np.outer(values, values)) - np.eye(len(values))).max()
    return Whitening(at, values, u, values / trace, float(error))


_OUT = "component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(vectors: DataFrame, id_: str, vector: str, k: int = 16) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error) for each row of vectors and component up to k.

    Rows whose vector is null, empty or holds null or not finite entries go, as do vectors of another length than
    the commonest (of equally common ones the shorter). Fitted on each distinct vector once; all rows are whitened,
    repeated ones and those with a null id too. Entries beyond 2**53 in whole numbers stay at it. Fewer components
    come if there are fewer dimensions, or if the others' eigenvalues are nothing but rounding; vectors that do not
    vary, and empty tables, give no rows. deviation is null beyond a long. Signs: the largest entry of a
    direction is positive. Other columns are ignored.
    """
    rows = vectors.select(F.col(id_).alias("id"), F.col(vector).cast("array<double>").alias("v"))
    rows = rows.where(finite(F.col("v")) & (F.size("v") > 0)).select("id", F.transform(whole(F.col("v"), SCALE), lambda x: x + OFFSET).alias("x"))
    kind = f"{id_} {vectors.schema[id_].dataType.simpleString()}, {_OUT}"
    nothing = vectors.sparkSession.createDataFrame([], kind)
    dims = commonest_length(rows, "x")
    if dims is None:
        return nothing
    rows = rows.where(F.size("x") == dims)
    found = fit_whitening(durable(rows.select("x").distinct()), dims, k)
    if found is None:
        return nothing
    at, scaled, many = found.at, found.directions / np.sqrt(found.values), len(found.values)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column("x"), dims)
            each = np.repeat(np.arange(len(x)), many)
            columns = {
                id_: batch.column("id").take(pa.array(each)),
                "component": pa.array(np.tile(np.arange(1, many + 1, dtype=np.int32), len(x))),
                "n": pa.array(np.full(len(each), at.n, np.int64)),
                "deviation": pa.array(at.deviations(x), pa.int64()).take(pa.array(each)),
                "whitened": pa.array((at.centred(x) @ scaled).ravel()),
                "explained": pa.array(np.tile(found.explained, len(x))),
                "identity_error": pa.array(np.full(len(each), found.identity_error)),
            }
            yield pa.record_batch(columns)

    return rows.mapInArrow(lean(project), kind)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
