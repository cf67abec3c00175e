"""Whitening against exact fractions and NumPy's eigenvectors."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import types as T

from threatloom.llm import whitening

CLASHING = "id long, x string, i int, j int, v double, whitened string, deviation string, component string, n string"


def plain(rows, top=16):
    """Rows by whole numbers and numpy.linalg.eigh: {(place, component): (n, deviation, whitened up to sign, explained)}."""
    ok = [(k, [math.floor(64 * float(c)) + 1_000_000 for c in v]) for k, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in ok})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    y = [[n * a - s for a, s in zip(x, sums)] for x in fit]
    v = np.array([[sum(r[i] * r[j] for r in y) / n**3 for j in range(len(sums))] for i in range(len(sums))])
    e, u = np.linalg.eigh(v)
    e, u = e[::-1], u[:, ::-1]
    rank = min(top, int((e > 1e-12 * e[0]).sum()))
    out = []
    for k, x in ok:
        own = [n * a - s for a, s in zip(x, sums)]
        w = np.array(own, float) / n @ u / np.sqrt(np.maximum(e, 1e-300))
        out += [(k, i + 1, n, sum(a * a for a in own), abs(w[i]), e[i] / e.sum()) for i in range(rank)]
    return out


def check(df, rows, top=16, tolerance=1e-9):
    got = sorted(((r["vec_id"], r["component"], r["n"], r["deviation"], abs(r["whitened"]), r["explained"]) for r in df.collect()), key=repr)
    want = sorted(plain(rows, top), key=repr)
    assert [g[:4] for g in got] == [w[:4] for w in want]
    assert np.allclose([g[4:] for g in got], [w[4:] for w in want], rtol=tolerance, atol=tolerance)


def test_given_table(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    df = whitening.whitened_components(vectors)
    assert df.dtypes == [("vec_id", "bigint"), ("component", "int"), ("n", "bigint"), ("deviation", "bigint"), ("whitened", "double"), ("explained", "double"), ("identity_error", "double")]
    check(df, [(r["vec_id"], r["embedding"]) for r in vectors.select("vec_id", "embedding").collect()])
    assert 0 <= df.first()["identity_error"] < 1e-10


def test_nulls_repeats_and_clashing_names(spark):
    draw = random.Random(4)
    rows = [(i, [draw.gauss(0, 1 + j) for j in range(5)]) for i in range(40)]
    rows += [(100, None), (101, [1.0, None, 2.0, 3.0, 4.0]), (102, [float("nan")] * 5), (103, [0.0, 1.0, 2.0, 3.0, float("inf")]), (None, [0.5] * 5)]
    rows += rows[:7] * 3
    names = [c.split()[0] for c in CLASHING.split(", ")]
    schema = "vec_id long, embedding array<double>, label int, " + CLASHING
    df = spark.createDataFrame([(k, v, None, *[None] * len(names)) for k, v in rows], schema)
    check(whitening.whitened_components(df), rows)
    check(whitening.whitened_components(df, components=2), rows, top=2)


def test_components_without_variance_and_empty_tables(spark):
    schema = "vec_id long, embedding array<float>"
    draw = random.Random(6)
    flat = [(i, [a := draw.random(), a, draw.random(), 0.25, 0.0]) for i in range(30)]  # two of five directions
    df = spark.createDataFrame(flat, schema)
    rows = [(r[0], r[1]) for r in df.collect()]
    check(whitening.whitened_components(df), rows)
    assert {r["component"] for r in whitening.whitened_components(df).collect()} == {1, 2}
    for rows in ([], [(1, [1.0, 2.0])] * 3, [(1, []), (2, [])], [(1, None)]):
        assert whitening.whitened_components(spark.createDataFrame(rows, schema)).collect() == []
    with pytest.raises(ValueError):
        whitening.whitened_components(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], schema))


def test_large_entries_stay_exact(spark):
    """Entries of 2^40 need several limbs; sums and products are whole numbers all the same."""
    draw = random.Random(8)
    rows = [(i, [draw.uniform(-1, 1) * 2.0 ** (10 * j) for j in range(1, 5)]) for i in range(50)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    x = [[math.floor(64 * c) + 1_000_000 for c in v] for _, v in rows]
    fit = whitening.on_grid(df).repartition(3)
    assert whitening.exact_sums(fit) == [sum(c) for c in zip(*x)]
    got = whitening.exact_products(fit, np.array([7, -9, 0, 1 << 30]))
    z = [[a - b for a, b in zip(r, (7, -9, 0, 1 << 30))] for r in x]
    assert got == {(i, j): sum(r[i] * r[j] for r in z) for i in range(4) for j in range(i, 4)}
    got = {r["vec_id"]: r["deviation"] for r in whitening.whitened_components(df).collect()}
    n, sums = len(x), [sum(c) for c in zip(*x)]
    want = {k: sum((n * a - s) ** 2 for a, s in zip(r, sums)) for (k, _), r in zip(rows, x)}
    assert got == {k: v if v < 1 << 63 else None for k, v in want.items()}
    huge = spark.createDataFrame([(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [0.0, 5.0])], "vec_id long, embedding array<double>")
    assert all(math.isfinite(r["whitened"]) for r in whitening.whitened_components(huge).collect())


@pytest.mark.parametrize("d,rank", [(1, 1), (7, 7), (24, 10)])
def test_factor_and_rotations(d, rank):
    rng = np.random.default_rng(d)
    a = rng.standard_normal((d, rank)) * 10.0 ** rng.integers(-3, 3, rank)
    v = a @ a.T
    factor, order = whitening.pivoted_cholesky(v)
    assert factor.shape[1] == rank
    assert np.allclose(factor @ factor.T, v[order][:, order])
    assert np.allclose(np.tril(factor), factor) and (np.diff(factor.diagonal()) <= 0).all()
    axes, e = whitening.principal_axes(v)
    assert np.allclose(axes.T @ axes, np.eye(rank), atol=1e-12)
    assert np.allclose(v @ axes, axes * e, atol=1e-9 * e[0])
    assert np.allclose(e, np.linalg.eigvalsh(v)[::-1][:rank], rtol=1e-8, atol=1e-12 * e[0])
