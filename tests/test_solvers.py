"""Products, solvers and images against numpy."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from rayframe import storage
from rayframe.functions import kernels
from rayframe.model import Volume
from rayframe.operators import image, linop, solvers
from rayframe.sources import geometry as G

N, M = 30, 12


@pytest.fixture(scope="module")
def system(spark):
    rng = np.random.default_rng(1)
    a = np.where(rng.random((N, M)) < 0.5, rng.integers(1, 5, (N, M)), 0).astype(float)
    x = rng.random(M)
    matrix = spark.createDataFrame([(i, j, float(a[i, j])) for i in range(N) for j in range(M) if a[i, j]], "line long, voxel long, value double").cache()
    p = a @ x
    return a, x, p, matrix, spark.createDataFrame([(i, float(v)) for i, v in enumerate(p)], "line long, value double").cache()


def dense(df, n, key="voxel"):
    out = np.zeros(n)
    for r in df.collect():
        out[r[key]] = r.value
    return out


def test_adjoint(spark, system):
    a, x, p, matrix, proj = system
    f = spark.createDataFrame([(j, float(v)) for j, v in enumerate(x)], "voxel long, value double")
    assert np.allclose(dense(linop.forward(matrix, f), N, "line"), a @ x)
    assert np.allclose(dense(linop.back(matrix, proj), M), a.T @ p)
    assert np.isclose(linop.inner(linop.forward(matrix, f), proj, "line"), linop.inner(f, linop.back(matrix, proj), "voxel"))
    assert np.allclose(dense(linop.row_sums(matrix), N, "line"), a.sum(1))
    assert np.allclose(dense(linop.square_norms(matrix, "voxel"), M), (a * a).sum(0))


def test_sirt_and_landweber(system):
    a, _, p, matrix, proj = system
    r, c = 1 / a.sum(1), 1 / a.sum(0)
    x, seen = np.zeros(M), []
    for _ in range(3):
        x = np.clip(x + 0.9 * c * (a.T @ (r * (p - a @ x))), 0.0, 0.8)
    got = solvers.sirt(matrix, proj, 0.9, 3, box=(0.0, 0.8), callback=lambda f, k: seen.append((k, f.count())))
    assert np.allclose(dense(got, M), x) and seen == [(0, M), (1, M), (2, M)]
    x = np.zeros(M)
    for _ in range(2):
        x = x + 1e-3 * (a.T @ (p - a @ x))
    assert np.allclose(dense(solvers.landweber(matrix, proj, 1e-3, 2), M), x)


def test_residual_falls(system):
    a, _, p, matrix, proj = system
    sizes = []
    solvers.sirt(matrix, proj, 1.0, 4, callback=lambda f, k: sizes.append(np.linalg.norm(p - a @ dense(f, M))))
    assert all(x > y for x, y in zip(sizes, sizes[1:], strict=False))


def test_conjugate_gradients(system):
    a, _, p, matrix, proj = system
    for f, weight in ((solvers.cgls, np.ones(M)), (solvers.cgls2, 1 / a.sum(0))):
        x, d = np.zeros(M), p.copy()
        r = a.T @ d
        z = weight * r
        q, gamma = z.copy(), z @ r
        for _ in range(4):
            t = a @ q
            x, d = x + gamma / (t @ t) * q, d - gamma / (t @ t) * t
            r = a.T @ d
            z = weight * r
            q, gamma = z + (z @ r) / gamma * q, z @ r
        assert np.allclose(dense(f(matrix, proj, 4), M), x, rtol=1e-8), f.__name__
    y, r, q = np.zeros(N), p.copy(), p.copy()
    gamma = r @ r
    for _ in range(4):
        w = a.T @ q
        y, r = y + gamma / (w @ w) * q, r - gamma / (w @ w) * (a @ w)
        q, gamma = r + (r @ r) / gamma * q, r @ r
    assert np.allclose(dense(solvers.cg(matrix, proj, 4), M), a.T @ y, rtol=1e-8)


def test_sart_commits_late(system):
    a, _, p, matrix, proj = system
    norms, f, after = (a * a).sum(1), np.zeros(M), np.zeros(M)
    for _ in range(2):
        for b in range(3):
            if b:
                f = after
            own = range(b * 10, b * 10 + 10)
            after = after + sum(0.5 * (p[i] - a[i] @ f) / norms[i] * a[i] for i in own)
    block = F.floor(F.col("line") / 10)
    assert np.allclose(dense(solvers.sart(matrix, proj, block, iterations=2), M), f)
    assert np.allclose(dense(solvers.sart(matrix, proj, block, iterations=2, commit_last=True), M), after)


def test_sart_cg(system):
    a, _, p, matrix, proj = system
    f = np.zeros(M)
    for b in range(3):
        own = slice(b * 10, b * 10 + 10)
        left = p[own] - a[own] @ f
        q = a[own].T @ left
        f = f + (left @ left) / (q @ q) * q
    assert np.allclose(dense(solvers.sart_cg(matrix, proj, F.floor(F.col("line") / 10), 1), M), f)


def test_row_and_column_action(system):
    a, _, p, matrix, proj = system
    x = np.zeros(M)
    for _ in range(2):
        for i in range(N):
            x = x + 0.5 * (p[i] - a[i] @ x) / (a[i] @ a[i]) * a[i]
    assert np.allclose(dense(solvers.art(matrix, proj, 0.5, 2), M), x)
    x, r = np.zeros(M), p.copy()
    for sweep in range(2):
        for j in range(M) if sweep == 0 else range(M - 1, -1, -1):
            delta = 0.5 * (a[:, j] @ r) / (a[:, j] @ a[:, j])
            x[j] += delta
            r = r - delta * a[:, j]
    assert np.allclose(dense(solvers.column_action_cyclic(matrix, proj, 0.5, 2, "back-forth"), M), x)
    x, r = np.zeros(M), p.copy()
    for b in range(2):
        own = slice(b * 6, b * 6 + 6)
        step = 0.5 * (a[:, own].T @ r) / (a[:, own] ** 2).sum(0)
        x[own] += step
        r = r - a[:, own] @ step
    assert np.allclose(dense(solvers.column_action_block(matrix, proj, F.floor(F.col("voxel") / 6), 0.5, 1), M), x)


def test_svd(system):
    a, _, _, matrix, _ = system
    # With as many random vectors as columns the range is the whole one, and the values are exact.
    sigma, left, right = solvers.truncated_svd(matrix, 3, oversample=M - 3)
    want = np.linalg.svd(a, compute_uv=False)[:3]
    assert np.allclose(sigma, want, rtol=1e-6)
    few = solvers.truncated_svd(matrix, 3)[0]
    assert (few <= want * (1 + 1e-9)).all() and (few > 0.95 * want).all()
    assert left.count() == 3 * N and right.count() == 3 * M


def test_empty_input(spark):
    matrix, proj = spark.createDataFrame([], "line long, voxel long, value double"), spark.createDataFrame([], "line long, value double")
    for f in (solvers.sirt, solvers.cgls, solvers.cg, solvers.art):
        assert f(matrix, proj, iterations=1).count() == 0


def test_reconstruction_of_a_phantom(spark):
    v = Volume.cube(16, 2)
    f = image.phantom(spark, v)
    a = kernels.joseph(G.rays(G.parallel(G.view_range(spark, 16), v, 16), 2), v).cache()
    got = solvers.sirt(a, linop.forward(a, f), iterations=8)
    zero = image.mapped(f, lambda x: x * 0.0)
    assert image.errors(got, f).first().l2 < 0.6 * image.errors(zero, f).first().l2


def test_phantoms(spark):
    v = Volume.cube(32, 2)
    whole = dense(image.phantom(spark, v), v.cells)
    part = Volume((16, 16), (0.0, 0.0), (0.5, 0.5))
    corner = dense(image.phantom(spark, part, within=v), part.cells).reshape(16, 16)
    assert np.allclose(whole.reshape(32, 32)[:16, :16], corner)
    with pytest.raises(ValueError):
        image.phantom(spark, Volume.cube(4), "original")


def test_callbacks_of_sequential_solvers(spark):
    a = spark.createDataFrame([(i, j, float(1 + (i * 7 + j * 3) % 5)) for i in range(6) for j in range(4)], "line long, voxel long, value double")
    p = spark.createDataFrame([(i, float(i + 1)) for i in range(6)], "line long, value double")
    for solve, rounds in ((solvers.art, "iterations"), (solvers.column_action_cyclic, "sweeps")):
        seen = []
        last = {r.voxel: r.value for r in solve(a, p, **{rounds: 3}, callback=lambda x, k: seen.append((k, {r.voxel: r.value for r in x.collect()}))).collect()}  # noqa: B023
        assert [k for k, _ in seen] == [0, 1, 2] and seen[2][1] == last
        for k, image in seen:
            assert image == {r.voxel: r.value for r in solve(a, p, **{rounds: k + 1}).collect()}


def test_hilbert_order():
    at = solvers.hilbert_order(np.arange(64))
    x, y = at % 8, at // 8
    assert sorted(at) == list(range(64)) and (np.abs(np.diff(x)) + np.abs(np.diff(y)) == 1).all()
    assert sorted(solvers.ORDERS["hilbert"](np.array([3, 5, 60]), 0)) == [3, 5, 60]


def test_masked_svd(spark):
    a = spark.createDataFrame([(i, j, float((i * 5 + j * j) % 7)) for i in range(9) for j in range(6)], "line long, voxel long, value double")
    whole = solvers.truncated_svd(a.filter("voxel < 4"), 2)[0]
    assert all(abs(x - y) < 1e-9 for x, y in zip(whole, solvers.truncated_svd(a, 2, mask=F.col("voxel") < 4)[0], strict=True))


@pytest.mark.parametrize("solver", [solvers.sirt, solvers.cgls, solvers.cgls2, solvers.cg])
def test_vectors_beyond_broadcasts(spark, system, solver):
    """Two copies in buckets give the same image, and products shuffle no matrix."""
    _, _, _, matrix, proj = system
    few = dense(solver(matrix, proj, iterations=2), M)
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = {t.name for t in spark.catalog.listTables()}
        assert np.allclose(dense(solver(matrix, proj, iterations=2), M), few)
        assert {t.name for t in spark.catalog.listTables()} == before
        a = solvers.copies(matrix, "test")
        for product, key in ((a.forward(proj.withColumnRenamed("line", "voxel")), "voxel"), (a.back(proj), "line")):
            plan = product._jdf.queryExecution().executedPlan().toString()
            scan = plan[: plan.index("Bucketed: true")].rsplit("Join", 1)[1]
            assert "Exchange" not in scan and f"hashpartitioning({key}" in plan
        solvers.discard(*a)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


@pytest.mark.parametrize("solve", ["sirt", "landweber", "cgls", "cgls2", "cg", "sart", "sart_cg", "column_action_block"])
def test_nothing_is_left(spark, tmp_path, monkeypatch, solve):
    """After a run the shared folder holds its result and nothing else; a callback's images stay readable."""
    a = spark.createDataFrame([(i, j, 1.0 + (i * 7 + j * 3) % 5) for i in range(6) for j in range(4)], "line long, voxel long, value double")
    p = spark.createDataFrame([(i, 3.0 + i) for i in range(6)], "line long, value double")
    number = itertools.count()
    monkeypatch.setattr(storage, "shared_dir", lambda _, what: f"{tmp_path.as_uri()}/rayframe/{what}-{next(number)}")
    block = {"sart": (F.floor(F.col("line") / 2),), "sart_cg": (F.floor(F.col("line") / 2),), "column_action_block": (F.floor(F.col("voxel") / 2),)}.get(solve, ())
    rounds = {"sweeps": 3} if solve == "column_action_block" else {"iterations": 3}
    x = getattr(solvers, solve)(a, p, *block, **rounds)
    rows = sorted(map(tuple, x.collect()))
    assert len(rows) == 4 and len(list((tmp_path / "rayframe").iterdir())) == 1
    seen = []
    y = getattr(solvers, solve)(a, p, *block, **rounds, callback=lambda image, *_: seen.append(image))
    assert sorted(map(tuple, y.collect())) == rows and len(seen) == 3 and all(image.count() == 4 for image in seen)
