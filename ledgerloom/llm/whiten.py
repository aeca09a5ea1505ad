"""Whitening of embeddings by the leading eigenvectors of their covariance, found by Jacobi-Davidson.

The covariance is never formed. A product with it is one Spark job over the centred rows: a task adds
up (x - m)((x - m)'B) for a few columns B, and only these sums, a row per dimension, come back. The
driver holds a subspace of bounded size. Each round takes the Ritz vectors of it by Rayleigh-Ritz,
locks those whose residual is that of double precision, and widens it by corrections: solutions of
the equation projected away from the locked and the current vectors, by a few steps of MINRES, for all
wanted vectors side by side, so that a step is one job.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import staged
from ledgerloom.llm.hardneg import padded

COMPONENTS, GUARDS = 8, 2
SCALE, SHIFT = 1024, 100_000
INNER, ROUNDS, BASIS = 6, 200, 8
LARGEST = 2**62
Product = Callable[[np.ndarray], np.ndarray]


class Fit:
    """The number of rows, the sums of each dimension, and what centres rows by them exactly."""

    def __init__(self, n: int, sums: list[int], largest: int):
        self.n, self.sums = n, sums
        self.small = 2 * n * max(largest, 1) < 2**62
        self.whole = np.array(sums, dtype=np.int64 if self.small else object)

    def deviations(self, rows: np.ndarray) -> np.ndarray:
        """n * x - S, exactly: longs if they fit, else Python's numbers."""
        return (rows if self.small else rows.astype(object)) * self.n - self.whole

    def centred(self, rows: np.ndarray) -> np.ndarray:
        return (self.deviations(rows) / self.n).astype(np.float64)

    def squares(self, rows: np.ndarray) -> list[int]:
        """Sum over dimensions of squared deviations, exactly."""
        away = self.deviations(rows)
        most = max(int(away.max(initial=0)), -int(away.min(initial=0)))
        if most * most * max(1, rows.shape[1]) < 2**63:
            return (away.astype(np.int64) ** 2).sum(axis=1).tolist()
        away = away.astype(object)
        return (away * away).sum(axis=1).tolist()


def usable(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """``vec_id`` and ``x`` (array of long) of the vectors without null or non-finite entries."""
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.col(embedding).cast("array<double>").alias("c")).filter(
        F.col("c").isNotNull() & F.forall("c", lambda x: x.isNotNull() & (F.abs(x) < float("inf")) & ~F.isnan(x)))
    limit = F.lit(LARGEST)
    return rows.select("vec_id", F.transform(
        "c", lambda x: F.greatest(F.least(F.floor(x * SCALE), limit), -limit) + SHIFT).alias("x"))


def _blocks(rows: DataFrame, size: int) -> DataFrame:
    """Rows packed by the batch: ``ids`` and ``x``, whole numbers row by row; shorter vectors end in entries of 0.0."""
    kind = rows.schema["vec_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                lists = part.column("x")
                whole = padded(lists, size)
                whole[np.arange(size) >= np.diff(lists.offsets.to_numpy())[:, None]] = SHIFT
                ids = pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column("vec_id"))
                yield pa.RecordBatch.from_arrays([ids, pa.array([whole.tobytes()], pa.binary())], names=["ids", "x"])

    return rows.mapInArrow(run, f"ids array<{kind}>, x binary")


def _matrices(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[np.ndarray]:
    for batch in batches:
        for one in batch.column("x").to_pylist():
            yield np.frombuffer(one, np.int64).reshape(-1, size)


def _fit(blocks: DataFrame, size: int) -> Fit:
    """Exact sums: tasks add whole numbers, Spark adds their sums as decimals; a row per dimension comes back."""
    schema = pa.schema([("dim", pa.int32()), ("n", pa.int64()), ("s", pa.decimal128(38, 0)), ("most", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, most = 0, np.zeros(size, object), np.zeros(size, np.int64)
        for rows in _matrices(batches, size):
            n, most = n + len(rows), np.maximum(most, np.abs(rows).max(axis=0))
            fits = int(most.max()) * len(rows) < 2**62
            sums = sums + (rows.sum(axis=0) if fits else rows.astype(object).sum(axis=0))
        if n:
            yield pa.RecordBatch.from_pylist(
                [{"dim": d, "n": n, "s": Decimal(int(sums[d])), "most": int(most[d])} for d in range(size)], schema=schema)

    parts = blocks.select("x").mapInArrow(run, "dim int, n long, s decimal(38,0), most long")
    found = parts.groupBy("dim").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.max("most").alias("most")).orderBy("dim").collect()
    return Fit(found[0].n, [int(r.s) for r in found], max(r.most for r in found))


def _summed(blocks: DataFrame, size: int, width: int, part: Callable[[np.ndarray], np.ndarray], rows: int) -> np.ndarray:
    """Sum over all blocks of ``part(whole numbers)``, a matrix of ``rows`` by ``width``."""
    names = [f"c{k}" for k in range(width)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for whole in _matrices(batches, size):
            total = part(whole) if total is None else total + part(whole)
        if total is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(rows, dtype=np.int32)), *(pa.array(c) for c in total.T)], names=["dim", *names])

    sums = blocks.select("x").mapInArrow(run, "dim int, " + ", ".join(f"{n} double" for n in names))
    found = sums.groupBy("dim").agg(*[F.sum(n).alias(n) for n in names]).collect()
    out = np.zeros((rows, width))
    for r in found:
        out[r.dim] = [r[n] for n in names]
    return out


def covariance_product(blocks: DataFrame, size: int, fit: Fit) -> Product:
    """Products of the covariance with a few columns, each one job."""
    def product(columns: np.ndarray) -> np.ndarray:
        def part(whole: np.ndarray) -> np.ndarray:
            rows = fit.centred(whole)
            return rows.T @ (rows @ columns)

        return _summed(blocks, size, columns.shape[1], part, size) / fit.n

    return product


# The solver; it only knows the product.


def _off(vectors: np.ndarray, away: np.ndarray) -> np.ndarray:
    """Columns without their parts along the orthonormal columns ``away``; twice, for rounding."""
    for _ in range(2):
        vectors = vectors - away @ (away.T @ vectors)
    return vectors


def orthonormal(vectors: np.ndarray, away: np.ndarray) -> np.ndarray:
    """An orthonormal basis of the columns, at right angles to ``away``; dependent columns go."""
    kept = away
    for column in vectors.T:
        size = np.linalg.norm(column)
        if size == 0:
            continue
        rest = _off((column / size)[:, None], kept)
        left = np.linalg.norm(rest)
        if left > 1e-10:
            kept = np.hstack([kept, _off(rest / left, kept)])
            kept[:, -1] /= np.linalg.norm(kept[:, -1])
    return kept[:, away.shape[1]:]


def corrections(product: Product, values: np.ndarray, residuals: np.ndarray, away: np.ndarray, steps: int) -> np.ndarray:
    """MINRES for (I - QQ')(V - value I)(I - QQ') t = -residual, all columns side by side, one product a step."""
    def inside(columns: np.ndarray) -> np.ndarray:
        return _off(product(columns) - columns * values, away)

    right = _off(-residuals, away)
    beta = np.linalg.norm(right, axis=0)
    safe = np.where(beta > 0, beta, 1.0)
    old, now = np.zeros_like(right), right / safe
    found, before, direction = np.zeros_like(right), np.zeros_like(right), np.zeros_like(right)
    cos, sin, delta, phi = -np.ones_like(beta), np.zeros_like(beta), np.zeros_like(beta), beta.copy()
    epsilon, last = np.zeros_like(beta), np.zeros_like(beta)
    for _ in range(steps):
        ahead = inside(now) - last * old
        alpha = (now * ahead).sum(axis=0)
        ahead = _off(ahead - alpha * now, away)
        step = np.linalg.norm(ahead, axis=0)
        turned, bar = cos * delta + sin * alpha, sin * delta - cos * alpha
        next_epsilon, delta = sin * step, -cos * step
        gamma = np.maximum(np.hypot(bar, step), np.finfo(float).tiny)
        cos, sin = bar / gamma, step / gamma
        before, direction = direction, (now - epsilon * before - turned * direction) / gamma
        found = found + cos * phi * direction
        phi, epsilon = sin * phi, next_epsilon
        old, now, last = now, ahead / np.where(step > 0, step, 1.0), step
        if not (step > 0).any():
            break
    return np.where(beta > 0, found, 0.0)


def jacobi_davidson(
    product: Product, size: int, wanted: int, inner: int = INNER, rounds: int = ROUNDS, basis: int = BASIS,
) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest eigenvalues, falling, and their unit eigenvectors as columns.

    An eigenvector is locked once its residual is within rounding of a product; the largest come first,
    so none is locked before those above it. ``basis`` times the wanted number is the
    largest subspace; then it shrinks to its best vectors. Locked vectors leave it.
    """
    wanted = min(wanted, size)
    locked, values = np.zeros((size, 0)), []
    space = orthonormal(np.random.default_rng(size).standard_normal((size, wanted)), locked)
    image = product(space)
    best, still = np.inf, 0
    for _ in range(rounds):
        small = space.T @ image
        theta, turn = np.linalg.eigh((small + small.T) / 2)
        theta, turn = theta[::-1], turn[:, ::-1]
        space, image = space @ turn, image @ turn
        top = max(abs(theta[0]) if len(theta) else 0.0, *map(abs, values), np.finfo(float).tiny)
        need = min(wanted - len(values), space.shape[1])
        residuals = _off(image[:, :need] - space[:, :need] * theta[:need], locked)
        sizes = np.linalg.norm(residuals, axis=0) / top
        limit = 4 * np.finfo(float).eps * np.sqrt(size)
        # Rounding of the products is the floor; near it, residuals no longer fall.
        still = 0 if sizes.max(initial=0) < 0.5 * best else still + 1
        best = min(best, sizes.max(initial=0))
        done = sizes <= (limit if still < 3 else max(limit, 1e-13))
        count = need if done.all() else int(np.argmin(done))
        if count:
            locked, values = np.hstack([locked, space[:, :count]]), [*values, *theta[:count]]
            space, image, best, still = space[:, count:], image[:, count:], np.inf, 0
            residuals, theta = residuals[:, count:], theta[count:]
        need -= count
        if len(values) == wanted:
            order = np.argsort(-np.array(values), kind="stable")
            return np.array(values)[order], locked[:, order]
        if space.shape[1] + need > basis * wanted:
            space, image = space[:, :2 * wanted], image[:, :2 * wanted]
        around = orthonormal(space[:, :need], locked)
        new = corrections(product, theta[:need], residuals[:, :need], np.hstack([locked, around]), inner)
        # A random direction each round keeps the search from staying in an invariant subspace.
        spare = np.random.default_rng(len(values) + space.shape[1]).standard_normal((size, 1))
        new = orthonormal(np.hstack([new, spare]), np.hstack([locked, space]))
        if new.shape[1]:
            space, image = np.hstack([space, new]), np.hstack([image, product(new)])
    raise ArithmeticError(f"{len(values)} of {wanted} eigenvectors after {rounds} rounds")


def whitened(
    vectors: DataFrame, components: int = COMPONENTS, vec_id: str = "vec_id", embedding: str = "embedding",
) -> DataFrame:
    """A row for each usable vector and component: ``vec_id``, ``component`` (from 1), ``n``, ``deviation``,
    ``whitened``, ``explained``, ``identity_error``, ``deviation_exact``.

    An entry c counts as x = floor(1024 * c) + 100000 (at the ends of +-2**62 beyond them). Null
    vectors and those with null or non-finite entries are left out; a shorter vector counts as filled
    up with 0.0. Every other row counts, whatever its id, repeated rows as often as they occur; ids may
    be null. ``deviation`` is null where it exceeds a long; ``deviation_exact`` is the same as text.
    Directions without variance, of which there are some if rows are few or equal, are no components:
    there are fewer then, none for a single row. Equal eigenvalues may have any basis. No rows, no result.
    """
    rows = staged(usable(vectors, vec_id, embedding), "whiten-rows")
    schema = (f"vec_id {rows.schema['vec_id'].dataType.simpleString()}, component int, n long, deviation long, whitened double, "
              "explained double, identity_error double, deviation_exact string")
    empty = rows.sparkSession.createDataFrame([], schema)
    size = rows.agg(F.max(F.size("x"))).first()[0]
    if not size:
        return empty
    blocks = staged(_blocks(rows, size), "whiten-blocks")
    fit = _fit(blocks, size)
    trace = _summed(blocks, size, 1, lambda whole: np.array([[(fit.centred(whole) ** 2).sum()]]), 1)[0, 0] / fit.n
    if not trace > 0:
        return empty
    values, vectors_ = jacobi_davidson(covariance_product(blocks, size, fit), size, components + GUARDS)
    count = int((values[:components] > trace * size * 4 * np.finfo(float).eps).sum())
    values, vectors_ = values[:count], vectors_[:, :count]
    # One sign for all rows: the largest entry is positive.
    vectors_ = vectors_ * np.sign(vectors_[np.abs(vectors_).argmax(axis=0), np.arange(count)])
    project = vectors_ / np.sqrt(values)

    def moments(whole: np.ndarray) -> np.ndarray:
        w = fit.centred(whole) @ project
        return np.vstack([w.T @ w, w.sum(axis=0)])

    sums = _summed(blocks, size, count, moments, count + 1) / fit.n
    error = float(np.abs(sums[:count] - np.outer(sums[count], sums[count]) - np.eye(count)).max())
    explained = values / trace

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, one in enumerate(batch.column("x").to_pylist()):
                ids, whole = batch.column("ids").slice(k, 1).flatten(), np.frombuffer(one, np.int64).reshape(-1, size)
                squares, w = fit.squares(whole), fit.centred(whole) @ project
                m = len(whole)
                long = [s if s < 2**63 else None for s in squares]
                yield pa.RecordBatch.from_arrays([
                    ids.take(pa.array(np.repeat(np.arange(m), count))), pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * count, fit.n)), pa.array(long, pa.int64()).take(pa.array(np.repeat(np.arange(m), count))),
                    pa.array(w.ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * count, error)),
                    pa.array(list(map(str, squares))).take(pa.array(np.repeat(np.arange(m), count))),
                ], names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error", "deviation_exact"])

    return blocks.mapInArrow(run, schema)
