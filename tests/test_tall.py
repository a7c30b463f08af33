"""QR factors of tall matrices and the truncated decomposition against numpy."""

import numpy as np
import pytest

from rayframe.operators import solvers, tall


def table(spark, a, parts=3):
    rows = [(10 * i - 7, *map(float, r)) for i, r in enumerate(a)]
    return spark.createDataFrame(rows, "key long, " + ", ".join(f"x{k} double" for k in range(a.shape[1]))).repartition(parts)


def dense(q, n, m):
    out = np.zeros((n, m))
    for r in q.collect():
        out[(r.key + 7) // 10] = r[1:]
    return out


@pytest.mark.parametrize("rows, block, fan", [(200, 8, 3), (200, 8, 64), (200, 1000, 64), (37, 5, 2)])
def test_factors(spark, rows, block, fan):
    a = np.random.default_rng(rows + block).normal(size=(rows, 5)) * 10.0 ** -np.arange(0, 15, 3)
    q, r = tall.factor(table(spark, a), "key", 5, block, fan)
    got = dense(q, rows, 5)
    assert q.columns == ["key", "x0", "x1", "x2", "x3", "x4"] and q.count() == rows
    assert np.abs(got.T @ got - np.eye(5)).max() < 1e-13
    assert np.abs(got @ r - a).max() < 1e-13 and (np.tril(r, -1) == 0).all() and (np.diagonal(r) >= 0).all()
    want = np.linalg.qr(a)[1]
    assert np.allclose(np.abs(r), np.abs(want), rtol=1e-9, atol=0)


def test_few_or_no_rows(spark):
    a = np.arange(8.0).reshape(2, 4) + 1
    q, r = tall.factor(table(spark, a), "key", 4)
    assert np.abs(dense(q, 2, 4) @ r - a).max() < 1e-12 and (dense(q, 2, 4)[:, 2:] == 0).all()
    q, r = tall.factor(table(spark, a).limit(0), "key", 4)
    assert q.count() == 0 and not r.any()


def test_dependent_columns(spark):
    a = np.ones((30, 3)) * [1, 2, 0]
    q, r = tall.factor(table(spark, a), "key", 3, 4, 2)
    assert np.abs(dense(q, 30, 3) @ r - a).max() < 1e-13


def elements(spark, a):
    rows = [(i, j, float(v)) for (i, j), v in np.ndenumerate(a)]
    return spark.createDataFrame(rows, "line long, voxel long, value double")


def test_small_singular_values(spark):
    """Values down to 1e-12 of the largest, where a Gram matrix has none below 1e-8."""
    rng = np.random.default_rng(2)
    u, v = np.linalg.qr(rng.normal(size=(60, 12)))[0], np.linalg.qr(rng.normal(size=(12, 12)))[0]
    want = 10.0 ** -np.arange(0, 12)
    a = (u * want) @ v.T
    sigma, left, right = solvers.truncated_svd(elements(spark, a), 12, oversample=0)
    assert np.abs(sigma - np.linalg.svd(a)[1]).max() < 1e-14
    assert np.allclose(sigma, want, rtol=1e-3)
    for table_, key, n in ((left, "line", 60), (right, "voxel", 12)):
        got = np.zeros((n, 12))
        for r in table_.collect():
            got[r[key], r.k] = r.value
        assert np.abs(got.T @ got - np.eye(12)).max() < 1e-12
    back = np.zeros((60, 12))
    for r in solvers.low_rank(elements(spark, a), sigma, left, right).collect():
        back[r.line, r.voxel] = r.value
    assert np.abs(back - a).max() < 1e-13


def test_more_columns_than_voxels(spark):
    a = np.random.default_rng(3).normal(size=(9, 3))
    sigma, left, right = solvers.truncated_svd(elements(spark, a), 3)
    assert np.allclose(sigma, np.linalg.svd(a)[1])
    got = {(r.line, r.voxel): r.value for r in solvers.low_rank(elements(spark, a), sigma, left, right).collect()}
    assert all(abs(got[i, j] - v) < 1e-12 for (i, j), v in np.ndenumerate(a))


def test_zero_matrix(spark):
    a = elements(spark, np.zeros((3, 2)))
    sigma, left, right = solvers.truncated_svd(a, 2)
    assert not sigma.any() and np.isfinite([r.value for r in left.collect()]).all()
    assert [r.value for r in solvers.low_rank(a, sigma, left, right).collect()] == [0.0] * 6
    sigma, left, right = solvers.truncated_svd(elements(spark, np.zeros((1, 1))).limit(0), 2)
    assert not sigma.any() and left.count() == right.count() == 0


def test_few_voxels_are_factored_once(spark, monkeypatch):
    """The matrix is written once, and then as often as one factorisation writes it, not once a product."""
    written = []
    for module in (solvers, tall):
        monkeypatch.setattr(module, "keep", lambda df, what, keep=module.keep: written.append(what) or keep(df, what))
    a = np.random.default_rng(4).normal(size=(50, 4)) * [1, 1e-4, 1e-8, 1e-11]
    sigma, left, right = solvers.truncated_svd(elements(spark, a), 4, oversample=0)
    assert [written.count(x) for x in ("svd-matrix", "qr-blocks", "qr-rows", "svd-left")] == [1] * 4 and not {"svd-product", "svd-right"} & set(written)
    assert np.abs(sigma - np.linalg.svd(a)[1]).max() < 1e-14
    got = {(r.line, r.voxel): r.value for r in solvers.low_rank(elements(spark, a), sigma, left, right).collect()}
    assert all(abs(got[i, j] - v) < 1e-14 for (i, j), v in np.ndenumerate(a))


def test_more_voxels_than_columns(spark):
    """The range finder: small values of a matrix that has more voxels than there are columns, and nulls."""
    rng = np.random.default_rng(5)
    u, v = np.linalg.qr(rng.normal(size=(60, 6)))[0], np.linalg.qr(rng.normal(size=(20, 6)))[0]
    want = 10.0 ** -np.arange(0, 12, 2)
    a = (u * want) @ v.T
    nulls = spark.createDataFrame([(None, 1, 5.0), (1, None, 5.0), (1, 1, None)], "line long, voxel long, value double")
    sigma, left, right = solvers.truncated_svd(elements(spark, a).union(nulls), 6)
    assert np.abs(sigma - want).max() < 1e-14
    got = {(r.line, r.voxel): r.value for r in solvers.low_rank(elements(spark, a), sigma, left, right).collect()}
    assert all(abs(got[i, j] - x) < 1e-13 for (i, j), x in np.ndenumerate(a))
