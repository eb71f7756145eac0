"""Whitening against numpy on small tables, the solver against an SVD."""

import math
import os

import numpy as np
import pytest
from pyspark.sql import types as T

from trackloom.llm import queries, whiten

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
SCHEMA = T.StructType(
    [
        T.StructField("vec_id", T.LongType()),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
        T.StructField("x", T.StringType()),
        T.StructField("whitened", T.StringType()),
    ]
)


def brute(rows, count=4):
    """{(vec_id, component): (n, deviation, whitened up to its sign, explained)} by numpy's eigenvectors."""
    x = [(i, [math.floor(256 * float(np.float32(c))) for c in v]) for i, v in rows]
    fit = np.array(sorted({tuple(v) for _, v in x}))
    n, sums = len(fit), fit.sum(axis=0)
    centred = fit - sums / n
    cov = centred.T @ centred / n
    values, axes = np.linalg.eigh(cov)
    order = np.argsort(values)[::-1][:count]
    out = []
    for i, v in x:
        for k, at in enumerate(order):
            deviation = sum((n * a - int(s)) ** 2 for a, s in zip(v, sums))
            out.append((i, k + 1, n, deviation, abs((v - sums / n) @ axes[:, at] / np.sqrt(values[at])), values[at] / np.trace(cov)))
    return out


def check(got, want):
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[4])
    got, want = sorted(((*r[:4], abs(r[4]), *r[5:]) for r in got), key=key), sorted(want, key=key)
    assert [r[:4] for r in got] == [r[:4] for r in want]
    assert np.allclose([r[4:6] for r in got], [r[4:6] for r in want], rtol=1e-7, atol=1e-9)
    assert all(r[6] < 1e-4 for r in got)


@pytest.mark.parametrize("case", range(9))
def test_solver(case):
    rng = np.random.default_rng(case)
    d = [1, 2, 3, 5, 64, 40, 30, 20, 10][case]
    a = rng.normal(size=(300, d))
    if case == 5:
        a *= 0.5 ** np.arange(d)
    if case == 6:
        a[:, 7:] = 0
    if case == 7:
        a = np.vstack([np.eye(d) * 3, -np.eye(d) * 3])  # all values equal
    if case == 8:
        a = np.vstack([np.eye(d), -np.eye(d)]) * np.array([5, 5, 5, 3, 3, 1, 1, 0, 0, 0])
    r = None
    for i in range(0, len(a), 37):
        r = whiten.fold_rows(r, a[i : i + 37])
    diagonal, upper, w = whiten.bidiagonalise(r)
    b = np.diag(diagonal) + np.diag(upper, 1)
    assert np.allclose(w.T @ w, np.eye(d)) and np.allclose(w @ b.T @ b @ w.T, a.T @ a)
    exact = np.linalg.svd(a, compute_uv=False) ** 2
    assert np.allclose(whiten.dqds(diagonal, upper), exact[:d], rtol=1e-12, atol=1e-12 * exact[0])
    values, axes, total = whiten.principal_axes(r, 4)
    assert len(values) == min(4, d) and np.isclose(total, exact.sum())
    assert np.allclose(axes.T @ axes, np.eye(len(values)), atol=1e-12)
    assert np.allclose(a.T @ (a @ axes), axes * values, atol=1e-10 * exact[0])


def test_small_singular_values_are_accurate():
    """dqds keeps the relative accuracy of values far below the largest."""
    diagonal, upper = 10.0 ** -np.arange(0, 12), np.full(11, 1e-14)
    assert np.allclose(whiten.dqds(diagonal, upper) ** 0.5, np.sort(diagonal)[::-1], rtol=1e-10)


def test_awkward_rows(spark):
    rng = np.random.default_rng(5)
    good = [(i, rng.normal(size=6).tolist()) for i in range(60)]
    good += [(100, good[0][1]), (100, good[0][1]), (None, good[1][1]), (7, [-0.0] * 6)]
    bad = [(200, None), (201, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (202, [math.nan] + [0.0] * 5), (203, [math.inf] + [0.0] * 5), (204, []), (205, [1.0])]
    rows = [(i, v, "y", "z") for i, v in good + bad]
    got = whiten.whiten(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()
    check([tuple(r) for r in got], brute(good))


def test_many_partitions_fold_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(whiten, "FAN_IN", 2)
    monkeypatch.setattr(whiten, "BLOCK_ROWS", 3)
    rng = np.random.default_rng(6)
    rows = [(i, (rng.normal(size=5) * [4, 3, 2, 1, 0.5]).tolist()) for i in range(200)]
    df = spark.createDataFrame([(i, v, "", "") for i, v in rows], SCHEMA).repartition(40)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        check([tuple(r) for r in whiten.whiten(df).collect()], brute(rows))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_large_entries_stay_exact(spark):
    rows = [(i, [float(2**40 + i * 1024), float(i)]) for i in range(10)]
    got = whiten.whiten(spark.createDataFrame([(i, v, "", "") for i, v in rows], SCHEMA)).collect()
    assert all(r["n"] == 10 for r in got) and len(got) in (10, 20)


def test_equal_vectors_and_nothing(spark):
    rows = [(i, [1.0, 2.0], "", "") for i in range(4)]
    assert whiten.whiten(spark.createDataFrame(rows, SCHEMA)).collect() == []
    assert whiten.whiten(spark.createDataFrame([], SCHEMA)).collect() == []
    assert whiten.whiten(spark.createDataFrame([(1, None, "", "")], SCHEMA)).collect() == []


def test_query(spark):
    rows = [(r[0], r[1]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()]
    check([tuple(r) for r in queries.op12_whitening(spark, SF).collect()], brute(rows))
