"""Iterative reconstruction.

Every solver takes a matrix (line, voxel, value) and projections (line, value) and returns an image (voxel, value).
The matrix is written first; each iteration reads it, joins and aggregates twice, and writes its vectors, so that
plans don't grow. While vectors are below Spark's limit for broadcasts, one copy of the matrix is enough; beyond it
there are two, in buckets by voxel and by line, so that products shuffle vectors and partial sums, never the matrix.
``callback(image, k)`` sees the image after iteration k.

Simultaneous methods run over any number of executors. Row- and column-action methods (art, column_action_cyclic)
are sequential by definition: each step reads what the last one wrote. They run in one task, refuse matrices above
``SEQUENTIAL`` elements, and name the block methods as the way beyond it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import bucketed, discard, keep, size_of
from . import linop as L
from . import tall

SEQUENTIAL = 20_000_000
Callback = Callable[[DataFrame, int], None]


def _vector(spark, key: str) -> DataFrame:
    return spark.createDataFrame([], f"{key} long, value double")


class _Vectors:
    """Vectors of an iteration: once their successors are written, what nothing reads any more is deleted."""

    def __init__(self):
        self.held: list[DataFrame] = []
        self.given: list[DataFrame] = []

    def keep(self, df: DataFrame, what: str) -> DataFrame:
        self.held.append(keep(df, what))
        return self.held[-1]

    def give(self, callback, *vectors, k: int) -> None:
        """A callback's vectors are its own from then on."""
        self.given += [v for v in vectors if not any(v is x for x in self.given)]
        callback(vectors[0], k, *vectors[1:])

    def only(self, *needed: DataFrame) -> None:
        for v in self.held:
            if not any(v is x for x in (*needed, *self.given)):
                discard(v)
        self.held = [v for v in self.held if any(v is x for x in needed)]


class Copies(NamedTuple):
    """A matrix for products with images (joined by voxel) and with projections (joined by line)."""

    voxel: DataFrame
    line: DataFrame

    def forward(self, image: DataFrame) -> DataFrame:
        return L.forward(self.voxel, image)

    def back(self, projections: DataFrame) -> DataFrame:
        return L.back(self.line, projections)


#: Bytes of a matrix, as it is stored, in a bucket.
BUCKET = 64 << 20


def copies(matrix: DataFrame, name: str) -> Copies:
    """One copy if its longest vector can be broadcast, by the largest numbers in it, else two in buckets."""
    spark = matrix.sparkSession
    a = keep(matrix.select("line", "voxel", "value"), f"{name}-matrix")
    longest = max((x or 0) for x in a.agg(F.max("line"), F.max("voxel")).first()) + 1
    if 16 * longest <= spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold():
        return Copies(a, a)
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size_of(a) // BUCKET))
    both = Copies(*(bucketed(a, f"{name}-by-{by}", by, n) for by in ("voxel", "line")))
    discard(a)
    return both


def _simultaneous(matrix, projections, beta, iterations, box, callback, weighted: bool, name: str) -> DataFrame:
    a, p = copies(matrix, name), projections.select("line", F.col("value").cast("double").alias("value"))
    if weighted:
        r = keep(L.row_sums(a.line).select("line", L.inverse(F.col("value")).alias("w")), f"{name}-rows")
        c = keep(L.column_sums(a.voxel).select("voxel", L.inverse(F.col("value"), beta).alias("w")), f"{name}-columns")
    x = last = None
    for k in range(iterations):
        residual = p if x is None else L.combine(p, a.forward(x), "line", lambda u, v: u - v)
        if weighted:
            residual = residual.join(r, "line").select("line", (F.col("value") * F.col("w")).alias("value"))
        step = a.back(residual)
        step = step.join(c, "voxel").select("voxel", (F.col("value") * F.col("w")).alias("value")) if weighted else step.select("voxel", (F.col("value") * beta).alias("value"))
        x = step if x is None else L.combine(x, step, "voxel", lambda u, v: u + v)
        if box:
            x = x.select("voxel", F.least(F.greatest("value", F.lit(float(box[0]))), F.lit(float(box[1]))).alias("value"))
        before, x = last, keep(x, f"{name}-image")
        last = x
        if callback:
            callback(x, k)
        elif before is not None:
            discard(before)
    discard(*a, *([r, c] if weighted else []))
    return _vector(matrix.sparkSession, "voxel") if x is None else x


def sirt(matrix: DataFrame, projections: DataFrame, beta: float = 1.0, iterations: int = 10, box: tuple[float, float] | None = None, callback: Callback | None = None) -> DataFrame:
    """f += beta C A^T R (p - A f), with R and C the inverse row and column sums."""
    return _simultaneous(matrix, projections, beta, iterations, box, callback, True, "sirt")


def landweber(matrix: DataFrame, projections: DataFrame, beta: float = 1.0, iterations: int = 10, box: tuple[float, float] | None = None, callback: Callback | None = None) -> DataFrame:
    """f += beta A^T (p - A f)."""
    return _simultaneous(matrix, projections, beta, iterations, box, callback, False, "landweber")


def cgls(matrix: DataFrame, projections: DataFrame, iterations: int = 10, callback: Callback | None = None, preconditioned: bool = False) -> DataFrame:
    """Conjugate gradients on A^T A f = A^T p; preconditioned by the inverse column sums (cgls2) if asked."""
    a = copies(matrix, "cgls")
    d = projections.select("line", F.col("value").cast("double").alias("value"))
    if preconditioned:
        c = keep(L.column_sums(a.voxel).select("voxel", L.inverse(F.col("value")).alias("w")), "cgls-columns")
    weigh = (lambda r: r.join(c, "voxel").select("voxel", (F.col("value") * F.col("w")).alias("value"))) if preconditioned else (lambda r: r)
    vs = _Vectors()
    r = vs.keep(a.back(d), "cgls-r")
    z = vs.keep(weigh(r), "cgls-z") if preconditioned else r
    p, gamma = z, L.inner(z, r, "voxel")
    x = _vector(matrix.sparkSession, "voxel")
    for k in range(iterations):
        t = vs.keep(a.forward(p), "cgls-t")
        size = L.square(t)
        if gamma == 0.0 or size == 0.0:
            break
        alpha = gamma / size
        x = vs.keep(L.combine(x, p, "voxel", lambda u, v: u + v * F.lit(alpha)), "cgls-image")  # noqa: B023
        d = vs.keep(L.combine(d, t, "line", lambda u, v: u - v * F.lit(alpha)), "cgls-d")  # noqa: B023
        r = vs.keep(a.back(d), "cgls-r")
        z = vs.keep(weigh(r), "cgls-z") if preconditioned else r
        after = L.inner(z, r, "voxel")
        beta, gamma = after / gamma, after
        p = vs.keep(L.combine(z, p, "voxel", lambda u, v: u + v * F.lit(beta)), "cgls-p")  # noqa: B023
        vs.only(x, d, r, z, p)
        if callback:
            vs.give(callback, x, k=k)
    vs.only(x)
    discard(*a, *([c] if preconditioned else []))
    return x


def cgls2(matrix: DataFrame, projections: DataFrame, iterations: int = 10, callback: Callback | None = None) -> DataFrame:
    return cgls(matrix, projections, iterations, callback, preconditioned=True)


def cg(matrix: DataFrame, projections: DataFrame, iterations: int = 10, callback: Callback | None = None) -> DataFrame:
    """Conjugate gradients on A A^T y = p; the image is A^T y."""
    a = copies(matrix, "cg")
    r = projections.select("line", F.col("value").cast("double").alias("value"))
    y = _vector(matrix.sparkSession, "line")
    p, gamma, vs = r, L.square(r), _Vectors()
    for k in range(iterations):
        q = vs.keep(a.back(p), "cg-q")
        size = L.square(q)
        if gamma == 0.0 or size == 0.0:
            break
        alpha = gamma / size
        y = vs.keep(L.combine(y, p, "line", lambda u, v: u + v * F.lit(alpha)), "cg-y")  # noqa: B023
        r = vs.keep(L.combine(r, a.forward(q), "line", lambda u, v: u - v * F.lit(alpha)), "cg-r")  # noqa: B023
        after = L.square(r)
        beta, gamma = after / gamma, after
        p = vs.keep(L.combine(r, p, "line", lambda u, v: u + v * F.lit(beta)), "cg-p")  # noqa: B023
        vs.only(y, r, p)
        if callback:
            callback(keep(a.back(y), "cg-image"), k)
    x = keep(a.back(y), "cg-image")
    vs.only()
    discard(*a)
    return x


def sart(matrix: DataFrame, projections: DataFrame, block, beta: float = 0.5, iterations: int = 10, commit_last: bool = False, callback: Callback | None = None) -> DataFrame:
    """Block by block: all rows of a block read the committed image, and their updates are committed together.

    ``block``: a column of the matrix's ``line`` (a view's number). An update is committed when the next block of the
    same iteration begins, so the last block of an iteration takes effect only with the next commit, and the last of
    all does not reach the result unless ``commit_last``.
    """
    a = keep(matrix.select("line", "voxel", "value", block.cast("long").alias("block")), "sart-matrix", by="block")
    norms = keep(L.square_norms(a).filter(F.col("value") > 1e-5).select("line", F.col("value").alias("norm")), "sart-norms")
    p = projections.select("line", F.col("value").cast("double").alias("value"))
    blocks = [r[0] for r in a.select("block").distinct().orderBy("block").collect()]
    f = coming = _vector(matrix.sparkSession, "voxel")
    vs = _Vectors()
    for k in range(iterations):
        for i, b in enumerate(blocks):
            if i:
                f = coming
            own = a.filter(F.col("block") == b).drop("block")
            rows = own.select("line").distinct()
            left = L.combine(p.join(rows, "line", "left_semi"), L.forward(own, f), "line", lambda u, v: u - v)
            left = left.join(norms, "line").select("line", (F.col("value") / F.col("norm") * beta).alias("value"))
            coming = vs.keep(L.combine(coming, L.back(own, left), "voxel", lambda u, v: u + v), "sart-image")
            vs.only(f, coming)
        if callback:
            vs.give(callback, coming, k=k)
    found = coming if commit_last else f
    vs.only(found)
    discard(a, norms)
    return found


def sart_cg(matrix: DataFrame, projections: DataFrame, block, iterations: int = 10, step: float = 1.0, callback: Callback | None = None) -> DataFrame:
    """For each block one step of conjugate gradients on A_b A_b^T y = residual; f += step A_b^T y."""
    a = keep(matrix.select("line", "voxel", "value", block.cast("long").alias("block")), "sart-matrix", by="block")
    p = projections.select("line", F.col("value").cast("double").alias("value"))
    blocks = [r[0] for r in a.select("block").distinct().orderBy("block").collect()]
    f, vs = _vector(matrix.sparkSession, "voxel"), _Vectors()
    for k in range(iterations):
        for b in blocks:
            own = a.filter(F.col("block") == b).drop("block")
            rows = own.select("line").distinct()
            left = vs.keep(L.combine(p.join(rows, "line", "left_semi"), L.forward(own, f), "line", lambda u, v: u - v), "sart-left")
            q = vs.keep(L.back(own, left), "sart-q")
            size = L.square(q)
            if size == 0.0:
                continue
            alpha = step * L.square(left) / size
            f = vs.keep(L.combine(f, q, "voxel", lambda u, v: u + v * F.lit(alpha)), "sart-image")  # noqa: B023
            vs.only(f)
        if callback:
            vs.give(callback, f, k=k)
    vs.only(f)
    discard(a)
    return f


def column_action_block(matrix: DataFrame, projections: DataFrame, block, beta: float = 0.5, sweeps: int = 10, order: Iterable | None = None, callback=None) -> DataFrame:
    """Block by block of voxels: all steps of a block come from the same residual, then all are applied.

    ``block``: a column of ``voxel``; ``order``: the blocks' order, by default ascending.
    """
    a = keep(matrix.select("line", "voxel", "value", block.cast("long").alias("block")), "column-matrix", by="block")
    norms = keep(L.square_norms(a, "voxel").filter(F.col("value") > 1e-5).select("voxel", F.col("value").alias("norm")), "column-norms")
    blocks = list(order) if order is not None else [r[0] for r in a.select("block").distinct().orderBy("block").collect()]
    r = projections.select("line", F.col("value").cast("double").alias("value"))
    x, vs = _vector(matrix.sparkSession, "voxel"), _Vectors()
    for k in range(sweeps):
        for b in blocks:
            own = a.filter(F.col("block") == b).drop("block")
            step = vs.keep(L.back(own, r).join(norms, "voxel").select("voxel", (F.col("value") / F.col("norm") * beta).alias("value")), "column-step")
            x = vs.keep(L.combine(x, step, "voxel", lambda u, v: u + v), "column-image")
            r = vs.keep(L.combine(r, L.forward(own, step), "line", lambda u, v: u - v), "column-residual")
            vs.only(x, r)
        if callback:
            vs.give(callback, x, r, k=k)
    vs.only(x)
    discard(a, norms)
    return x


def _one_task(matrix: DataFrame, projections: DataFrame, run, rounds: int, callback: Callback | None, name: str, other: str) -> DataFrame:
    """``run(line, voxel, value, p, n)`` yields the image after every round; a callback sees each, else only the last is written."""
    if (n := matrix.count()) > SEQUENTIAL:
        raise ValueError(f"{name} is sequential and runs in one task; {n} elements are more than {SEQUENTIAL}, use {other}")
    rows = matrix.select("line", "voxel", "value").unionByName(projections.select("line", F.lit(-1).cast("long").alias("voxel"), F.col("value").cast("double").alias("value")))

    def kernel(batches):
        table = [[x.to_numpy(zero_copy_only=False) for x in b.columns] for b in batches]
        if not table:
            return
        line, voxel, value = (np.concatenate(x) for x in zip(*table, strict=True))
        own = voxel >= 0
        lines, at = np.unique(line[~own], return_inverse=True)
        p = dict(zip(lines.tolist(), np.bincount(at, value[~own]).tolist(), strict=True))
        line, voxel, value = line[own], voxel[own], value[own].astype(np.float64)
        seen = np.unique(voxel)
        for k, image in enumerate(run(line, voxel, value, p, int(seen[-1]) + 1 if len(seen) else 0)):
            if callback or k == rounds - 1:
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(seen), k, np.int32)), pa.array(seen), pa.array(image[seen])], ["k", "voxel", "value"])

    # By a constant: dealt out in turn, rows would be sorted first.
    out = rows.repartition(1, F.lit(0)).mapInArrow(kernel, "k int, voxel long, value double")
    if not callback:
        return out.select("voxel", "value")
    out = keep(out, f"{name}-images")
    for k in range(rounds):
        callback(out.filter(F.col("k") == k).select("voxel", "value"), k)
    return out.filter(F.col("k") == rounds - 1).select("voxel", "value")


def _runs(key: np.ndarray) -> tuple[np.ndarray, dict]:
    order = np.argsort(key, kind="stable")
    sorted_key = key[order]
    start = np.flatnonzero(np.append(True, sorted_key[1:] != sorted_key[:-1])) if len(key) else np.zeros(0, int)
    end = np.append(start[1:], len(key))
    return order, {int(sorted_key[s]): (s, e) for s, e in zip(start, end, strict=True)}


def _repeated(line: np.ndarray, voxel: np.ndarray) -> set[int]:
    """Lines that have a voxel more than once."""
    order = np.lexsort((voxel, line))
    a, b = line[order], voxel[order]
    return set(a[1:][(a[1:] == a[:-1]) & (b[1:] == b[:-1])].tolist())


def _adder(index: np.ndarray):
    """How to add at places: numpy's plain way where none comes twice."""
    if len(np.unique(index)) == len(index):

        def plain(x: np.ndarray, at: np.ndarray, step: np.ndarray) -> None:
            x[at] += step

        return plain
    return np.add.at


def art(matrix: DataFrame, projections: DataFrame, beta: float = 0.5, iterations: int = 10, callback: Callback | None = None) -> DataFrame:
    """Kaczmarz: rows strictly in order. Rows without weight are skipped."""

    def run(line, voxel, value, p, n):
        order, runs = _runs(line)
        voxel, value, x = voxel[order], value[order], np.zeros(n)
        twice = _repeated(line[order], voxel)
        rows = []
        for row, (s, e) in runs.items():
            v, a = voxel[s:e], value[s:e]
            if (size := a @ a) > 0:
                rows.append((v, a, a * (beta / size), p.get(row, 0.0), row not in twice))
        for _ in range(iterations):
            for v, a, step, measured, once in rows:
                own = x[v]
                step = (measured - a @ own) * step
                if once:
                    x[v] = own + step
                else:
                    np.add.at(x, v, step)
            yield x

    return _one_task(matrix, projections, run, iterations, callback, "art", "sart or sirt")


def hilbert_order(voxels: np.ndarray) -> np.ndarray:
    """Voxels of a square image, the least with a power of two a side that holds them, in the order of a Hilbert curve."""
    order = 0
    while (1 << order) ** 2 <= int(max(voxels, default=0)):
        order += 1
    i = np.arange(4**order)
    x, y = np.zeros_like(i), np.zeros_like(i)
    for k in range(order):
        side, pair = 1 << k, i >> 2 * k & 3
        right, up = pair >= 2, (pair == 1) | (pair == 2)
        flip = right & ~up
        x, y = np.where(flip, side - 1 - x, x), np.where(flip, side - 1 - y, y)
        x, y = np.where(up, x, y), np.where(up, y, x)
        x, y = x + side * right, y + side * up
    curve = x + (y << order)
    return curve[np.isin(curve, voxels)]


#: Orders in which cyclic column action visits the voxels, by sweep.
ORDERS = {
    "identity": lambda v, sweep: v,
    "reverse": lambda v, sweep: v[::-1],
    "back-forth": lambda v, sweep: v if sweep % 2 == 0 else v[::-1],
    "hilbert": lambda v, sweep: hilbert_order(v),
    "random": lambda v, sweep: np.random.default_rng(sweep).permutation(v),
}


def column_action_cyclic(matrix: DataFrame, projections: DataFrame, beta: float = 0.5, sweeps: int = 10, order: str | Iterable[int] = "identity", callback: Callback | None = None) -> DataFrame:
    """Voxel by voxel: delta = beta <a_j, r> / |a_j|^2, r -= delta a_j. ``order``: one of ORDERS or voxels one by one."""
    given = None if isinstance(order, str) else list(order)

    def run(line, voxel, value, p, n):
        known = np.fromiter(p, np.int64, len(p))
        lines, at = np.unique(np.concatenate([line, known]), return_inverse=True)
        at, r = at[: len(line)], np.zeros(len(lines))
        r[np.searchsorted(lines, known)] = list(p.values())
        rows, runs = _runs(voxel)
        at, value, x = at[rows], value[rows], np.zeros(n)
        add = {j: _adder(at[s:e]) for j, (s, e) in runs.items()}
        for sweep in range(sweeps):
            for j in given if given is not None else ORDERS[order](np.array(list(runs)), sweep):
                if int(j) not in runs:
                    continue
                s, e = runs[int(j)]
                a = value[s:e]
                size = a @ a
                if size > 1e-5:
                    delta = beta * (a @ r[at[s:e]]) / size
                    x[int(j)] += delta
                    add[int(j)](r, at[s:e], -delta * a)
            yield x

    return _one_task(matrix, projections, run, sweeps, callback, "column_action_cyclic", "column_action_block")


def truncated_svd(matrix: DataFrame, rank: int, oversample: int = 4, powers: int = 2, seed: int = 0, mask=None) -> tuple[np.ndarray, DataFrame, DataFrame]:
    """(singular values, left vectors (k, line, value), right vectors (k, voxel, value)) by a random range finder.

    Products with the matrix run in Spark on all ``rank + oversample`` columns at once, which are then orthonormalised
    by a tree of QR factorisations (``tall.factor``), so values far below the largest are as exact as in a dense
    factorisation. Only triangles of that many columns come to the driver. With at least as many columns as the matrix
    has lines or voxels the result is the whole decomposition; vectors beyond the matrix' rank have a value of 0. Where
    the voxels are that few, one factorisation of the matrix, with a column a voxel, takes the place of the range finder.
    ``mask``: a condition on ``voxel`` or ``line``; what it leaves out counts as zero. Elements that hit a voxel twice
    are added up; a null value counts as zero.
    """
    m = rank + oversample
    known = (matrix if mask is None else matrix.filter(mask)).filter("line IS NOT NULL AND voxel IS NOT NULL")
    a = keep(known.select("line", "voxel", F.coalesce("value", F.lit(0.0)).cast("double").alias("value")), "svd-matrix")
    names = tall.columns(m)
    # With no more voxels than columns, each voxel is a column and the factors of the matrix itself are all that is needed.
    if len(few := sorted(r.voxel for r in a.select("voxel").distinct().limit(m + 1).collect())) <= m:
        column = dict(enumerate(few))
        dense = a.groupBy("line").agg(*[F.sum(F.when(F.col("voxel") == column[k], F.col("value")).otherwise(0.0)).alias(c) if k in column else F.lit(0.0).alias(c) for k, c in enumerate(names)])
        q, r = tall.factor(dense, "line", m)
        u_small, sigma, v_small = np.linalg.svd(r)
        left = keep(tall.long_form(tall.times(q, "line", m, u_small[:, :rank]), "line", rank), "svd-left")
        entries = [(k, voxel, float(v_small[k, i])) for k in range(rank) for i, voxel in column.items()]
        right = matrix.sparkSession.createDataFrame(entries, "k int, voxel long, value double")
        discard(a, q)
        return sigma[:rank], left, right

    def times(x: DataFrame, on: str, to: str) -> DataFrame:
        return a.join(x, on).groupBy(to).agg(*[F.sum(F.col("value") * F.col(c)).alias(c) for c in names])

    # A hash of the voxel, not a draw, so that a lost task makes the same numbers again.
    u = lambda k, i: (F.pmod(F.xxhash64("voxel", F.lit(k), F.lit(seed + i)), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    normal = [(F.sqrt(-2 * F.log(u(k, 0))) * F.cos(u(k, 1) * 2 * np.pi)).alias(c) for k, c in enumerate(names)]
    # A product is read once, by the blocks of its factorisation, so it is not written.
    q = tall.factor(times(a.select("voxel").distinct().select("voxel", *normal), "voxel", "line"), "line", m).q
    for _ in range(powers):
        for on, to in (("line", "voxel"), ("voxel", "line")):
            before, q = q, tall.factor(times(q, on, to), to, m).q
            discard(before)
    b = tall.factor(times(q, "line", "voxel"), "voxel", m)  # Q^T A, transposed
    u_small, sigma, v_small = np.linalg.svd(b.r)
    left = keep(tall.long_form(tall.times(q, "line", m, v_small[:rank].T), "line", rank), "svd-left")
    right = keep(tall.long_form(tall.times(b.q, "voxel", m, u_small[:, :rank]), "voxel", rank), "svd-right")
    discard(a, q, b.q)
    return sigma[:rank], left, right


def low_rank(places: DataFrame, sigma: np.ndarray, left: DataFrame, right: DataFrame) -> DataFrame:
    """(line, voxel, value): the product of singular values and vectors at the given places (line, voxel).

    Places whose line or voxel has no vector are 0.
    """
    weights = F.array(*[F.lit(float(s)) for s in sigma])

    def vectors(x: DataFrame, key: str, name: str) -> DataFrame:
        """An array a key; there are as many entries as singular values."""
        ordered = F.array_sort(F.collect_list(F.struct("k", "value")))
        return x.groupBy(key).agg(F.transform(ordered, lambda p: p["value"]).alias(name))

    rows = places.select("line", "voxel").join(vectors(left, "line", "u"), "line", "left").join(vectors(right, "voxel", "v"), "voxel", "left")
    terms = F.zip_with(F.zip_with("u", "v", lambda a, b: a * b), weights, lambda a, s: a * s)
    return rows.select("line", "voxel", F.coalesce(F.aggregate(terms, F.lit(0.0), lambda a, b: a + b), F.lit(0.0)).alias("value"))
