"""Whitening of embeddings: pivoted Cholesky of the centred scatter, then one-sided Jacobi on its factor.

Vectors are put on an integer grid, ``x = floor(scale * c) + shift``, and the fit list holds each grid vector
once. All sums are exact: a first pass gives the number and the sums of the grid vectors, a second one the
products of ``x - m``, where ``m`` is the mean's nearest integer, and what is left between ``m`` and the mean
is taken off in whole numbers. Tasks add up their products block by block in doubles that stay
below 2^53 (values are cut into limbs of 20 bits where needed), Spark adds up the tasks.

The covariance of ``d`` dimensions is one small matrix whatever the number of rows (``max_dims`` bounds it).
It is factored as ``P'VP = LL'`` with diagonal pivoting; rotations from the right make the columns of ``L``
orthogonal, so their squared norms are the eigenvalues, and the columns over their norms the eigenvectors. A third
pass measures how far the covariance of the whitened fit list is from the identity.

Defined results: a null vector, or one that holds a null, NaN or infinite entry, is no row of the result; grid
values are held between -2^61 and 2^61; repeated rows are all returned and counted once in the fit;
directions without variance (pivots that are rounding errors) are no components, so a fit list of one vector,
vectors of no entries and an empty table give no rows; a null id stays null; other columns are not read.
Vectors of different lengths are an error.
"""

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threatloom.llm.common import materialized

# Rows multiplied at once: products of two limbs, added up over these rows, are whole numbers below 2^53.
BLOCK_ROWS, LIMB_BITS = 8192, 20
GRID_LIMIT = 1 << 61
LONG_LIMIT = 1 << 63


class Whitening(NamedTuple):
    """A fit: ``n`` grid vectors with per-dimension ``sums``; column i of ``axes`` has variance ``variances[i]``."""

    n: int
    sums: list
    axes: np.ndarray
    variances: np.ndarray
    total: float
    identity_error: float


def on_grid(vectors: DataFrame, vector_col="embedding", scale=64, shift=1_000_000, *keep) -> DataFrame:
    """(``keep`` ..., x): the usable vectors as whole numbers."""
    vector = vectors[vector_col]
    usable = lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))
    grid = lambda e: F.least(F.greatest(F.floor(e.cast("double") * scale), F.lit(-GRID_LIMIT)), F.lit(GRID_LIMIT)) + shift
    return vectors.where(vector.isNotNull() & F.forall(vector, usable)).select(*keep, F.transform(vector, grid).alias("x"))


def matrix(batch: pa.RecordBatch) -> np.ndarray:
    """The rows of ``x`` as a matrix of longs; all have one length."""
    lists = batch.column(batch.schema.get_field_index("x"))
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)


def limbs(values: np.ndarray) -> list:
    """Numbers of at most ``LIMB_BITS`` bits, lowest first, that make up ``values``."""
    out = []
    while values.size and np.abs(values).max() >= 1 << LIMB_BITS:
        out.append(values & ((1 << LIMB_BITS) - 1))
        values = values >> LIMB_BITS
    return [*out, values]


def exact_sums(fit: DataFrame) -> list:
    """Sum of each dimension."""

    def run(batches):
        high = low = None
        for batch in batches:
            x = matrix(batch)
            high = (0 if high is None else high) + (x >> 31).sum(axis=0)
            low = (0 if low is None else low) + (x & ((1 << 31) - 1)).sum(axis=0)
        if high is not None:
            yield pa.RecordBatch.from_pydict({"dim": np.arange(len(high), dtype=np.int32), "high": high, "low": low})

    parts = fit.mapInArrow(run, "dim int, high long, low long").groupBy("dim")
    rows = parts.agg(*(F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("high", "low"))).collect()
    return [(int(r["high"]) << 31) + int(r["low"]) for r in sorted(rows, key=lambda r: r["dim"])]


def exact_products(fit: DataFrame, centre: np.ndarray) -> dict:
    """Sums of the products of dimensions i <= j of ``x - centre``, as {(i, j): whole number}."""

    def run(batches):
        sums, bound = {}, 0
        for batch in batches:
            x = matrix(batch) - centre
            for at in range(0, len(x), BLOCK_ROWS):
                parts = [p.astype(np.float64) for p in limbs(x[at : at + BLOCK_ROWS])]
                for a, left in enumerate(parts):
                    for b, right in enumerate(parts):
                        sums[a + b] = sums.get(a + b, 0) + (left.T @ right).astype(np.int64)
                bound += len(parts) << (2 * LIMB_BITS) + 13
                if bound >= 1 << 61:  # sums could pass a long
                    yield from cells(sums)
                    sums, bound = {}, 0
        yield from cells(sums)

    def cells(sums):
        for power, whole in sums.items():
            i, j = np.triu_indices(len(whole))
            columns = {"i": i.astype(np.int32), "j": j.astype(np.int32), "power": np.full(len(i), power, np.int32), "v": whole[i, j]}
            yield pa.RecordBatch.from_pydict(columns)

    parts = fit.mapInArrow(run, "i int, j int, power int, v long").groupBy("i", "j", "power")
    out = {}
    for r in parts.agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).collect():
        out[r["i"], r["j"]] = out.get((r["i"], r["j"]), 0) + (int(r["v"]) << LIMB_BITS * r["power"])
    return out


def pivoted_cholesky(v: np.ndarray) -> tuple:
    """(L, order): ``v[order][:, order] = L @ L.T`` with falling diagonal; L has as many columns as ``v`` has rank."""
    rest, d = v.copy(), len(v)
    order, factor = np.arange(d), np.zeros_like(v)
    least = d * np.finfo(np.float64).eps * max(rest.diagonal().max(initial=0), 0)
    for k in range(d):
        p = k + int(np.argmax(rest.diagonal()[k:]))
        if rest[p, p] <= least:
            return factor[:, :k], order
        for rows in (rest, rest.T, factor, order):
            rows[[k, p]] = rows[[p, k]]
        factor[k, k] = np.sqrt(rest[k, k])
        factor[k + 1 :, k] = rest[k + 1 :, k] / factor[k, k]
        rest[k + 1 :, k + 1 :] -= np.outer(factor[k + 1 :, k], factor[k + 1 :, k])
    return factor, order


def rotated_columns(factor: np.ndarray, sweeps=60) -> np.ndarray:
    """``factor`` times rotations that make its columns orthogonal (one-sided Jacobi).

    A sweep meets every two columns once, in rounds of disjoint pairs: column 0 stays, the others move round.
    """
    g = factor.copy()
    r = g.shape[1]
    ring, tolerance = np.arange(r + r % 2), np.finfo(g.dtype).eps * max(r, 2) ** 0.5
    for _ in range(sweeps):
        turned = False
        for _ in range(len(ring) - 1):
            p, q = ring[: len(ring) // 2], ring[len(ring) // 2 :][::-1]
            both = (p < r) & (q < r)
            a, b = g[:, p[both]], g[:, q[both]]
            aa, bb, ab = (a * a).sum(axis=0), (b * b).sum(axis=0), (a * b).sum(axis=0)
            turn = np.abs(ab) > tolerance * np.sqrt(aa * bb)
            if turn.any():
                turned = True
                zeta = (bb - aa) / np.where(turn, 2 * ab, 1)
                t = np.where(turn, np.where(zeta < 0, -1, 1) / (np.abs(zeta) + np.sqrt(1 + zeta * zeta)), 0)
                c = 1 / np.sqrt(1 + t * t)
                g[:, p[both]], g[:, q[both]] = c * (a - t * b), c * (t * a + b)
            ring = np.concatenate([ring[:1], ring[-1:], ring[1:-1]])
        if not turned:
            return g
    raise ArithmeticError(f"columns are not orthogonal after {sweeps} sweeps")


def principal_axes(covariance: np.ndarray) -> tuple:
    """(axes, variances) by falling variance; each axis is a unit column whose largest entry is positive."""
    factor, order = pivoted_cholesky(covariance.astype(np.longdouble))
    turned = rotated_columns(factor)
    norms = np.sqrt((turned * turned).sum(axis=0))
    axes = np.zeros_like(turned)
    axes[order] = turned / norms
    by_size = np.argsort(-norms, kind="stable")
    axes, norms = axes[:, by_size], norms[by_size]
    axes = axes * np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(len(norms))]) if len(norms) else axes
    return axes.astype(np.float64), (norms * norms).astype(np.float64)


def projection(n: int, sums: list, axes: np.ndarray, variances: np.ndarray):
    """A function from grid rows to (n * x - sum as whole numbers, whitened rows)."""
    centre = np.array([s // n for s in sums], np.int64)
    left = np.array([s % n for s in sums], np.int64)
    scaled = axes / np.sqrt(variances)

    def project(x):
        z = x - centre
        large = n * (int(np.abs(z).max(initial=0)) + 1) >= 1 << 62
        whole = z.astype(object) * n - left.astype(object) if large else z * n - left
        return whole, (whole / n).astype(np.float64) @ scaled

    return project


def measured_error(fit: DataFrame, n: int, project) -> float:
    """Largest entry of the covariance of the whitened rows of ``fit`` minus the identity."""

    def run(batches):
        total, squares = 0, 0
        for batch in batches:
            w = project(matrix(batch))[1]
            total, squares = total + w.sum(axis=0), squares + w.T @ w
        if np.ndim(total):
            i, j = np.indices(squares.shape).reshape(2, -1).astype(np.int32)
            i, j = np.append(i, np.arange(len(total), dtype=np.int32)), np.append(j, np.full(len(total), -1, np.int32))
            yield pa.RecordBatch.from_pydict({"i": i, "j": j, "v": np.append(squares, total)})

    found = {(r["i"], r["j"]): r["v"] for r in fit.mapInArrow(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()}
    return max(abs(v / n - found[i, -1] / n * (found[j, -1] / n) - (i == j)) for (i, j), v in found.items() if j >= 0)


def fit_whitening(vectors: DataFrame, vector_col="embedding", scale=64, shift=1_000_000, components=16, max_dims=4096) -> Whitening | None:
    """The fit over the distinct grid vectors, with at most ``components`` axes; None if there is no axis."""
    fit = materialized(on_grid(vectors, vector_col, scale, shift).distinct())
    size = fit.agg(F.count(F.lit(1)).alias("n"), F.min(F.size("x")).alias("least"), F.max(F.size("x")).alias("most")).first()
    n, d = size["n"], size["most"]
    if not n or not d:
        return None
    if size["least"] != d or d > max_dims:
        raise ValueError(f"vectors have {size['least']} to {d} entries; one length of at most {max_dims} is needed")
    sums = exact_sums(fit)
    centre = [(2 * s + n) // (2 * n) for s in sums]
    left = [s - n * c for s, c in zip(sums, centre)]
    products = exact_products(fit, np.array(centre, np.int64))
    covariance = np.zeros((d, d))
    for (i, j), v in products.items():  # whole numbers up to the one division
        covariance[i, j] = covariance[j, i] = (n * v - left[i] * left[j]) / (n * n)
    total = sum(n * products[i, i] - left[i] ** 2 for i in range(d)) / (n * n)
    axes, variances = principal_axes(covariance)
    axes, variances = axes[:, :components], variances[:components]
    if not len(variances):
        return None
    error = measured_error(fit, n, projection(n, sums, axes, variances))
    return Whitening(n, sums, axes, variances, total, error)


def whiten(vectors: DataFrame, fitted: Whitening | None, id_col="vec_id", vector_col="embedding", scale=64, shift=1_000_000) -> DataFrame:
    """(id, deviation, whitened): each usable vector on the axes of a fit, in units of their standard deviation.

    ``deviation`` is the exact squared length of ``n * x - sums``, null where it passes a long.
    """
    rows = on_grid(vectors, vector_col, scale, shift, vectors[id_col].alias("id"))
    schema = "id {}, deviation long, whitened array<double>".format(vectors.schema[id_col].dataType.simpleString())
    if fitted is None:
        return vectors.sparkSession.createDataFrame([], schema).withColumnRenamed("id", id_col)
    project = projection(fitted.n, fitted.sums, fitted.axes, fitted.variances)

    def run(batches):
        for batch in batches:
            whole, w = project(matrix(batch))
            if whole.dtype != object and whole.shape[1] * int(np.abs(whole).max(initial=0)) ** 2 >= LONG_LIMIT:
                whole = whole.astype(object)
            deviation = (whole * whole).sum(axis=1).tolist()
            deviation = pa.array([v if v < LONG_LIMIT else None for v in deviation], pa.int64())
            offsets = pa.array(np.arange(len(w) + 1, dtype=np.int32) * w.shape[1])
            yield pa.RecordBatch.from_arrays([batch.column(0), deviation, pa.ListArray.from_arrays(offsets, pa.array(w.ravel()))], names=["id", "deviation", "whitened"])

    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def whitened_components(vectors: DataFrame, id_col="vec_id", vector_col="embedding", **options) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error): one row a vector and component, from 1."""
    fitted = fit_whitening(vectors, vector_col, **options)
    grid = {k: v for k, v in options.items() if k in ("scale", "shift")}
    rows = whiten(vectors, fitted, id_col, vector_col, **grid)
    n, error = (fitted.n, fitted.identity_error) if fitted else (0, 0.0)
    shares = [float(v) for v in fitted.variances / fitted.total] if fitted else [0.0]
    rows = rows.select(id_col, "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return rows.select(
        id_col, (F.col("at") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
        F.array(*map(F.lit, shares))[F.col("at")].alias("explained"), F.lit(float(error)).alias("identity_error"),
    )
