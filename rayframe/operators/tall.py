"""Tall, skinny dense matrices: one row a key, a column of doubles for each of a few columns (x0, x1, ...).

``factor`` is a QR factorisation as a tree: blocks of rows are factored where they lie, their triangles are stacked
and factored in groups of ``FAN`` until one is left, and the small orthogonal factors go back down the tree. No Gram
matrix is formed, so small singular values keep the accuracy that the matrix gives them. Only the last triangle, of as
many rows as columns, comes to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import discard, keep

#: Numbers in a block, and triangles that one group stacks.
BLOCK, FAN = 1 << 20, 64


class Factors(NamedTuple):
    """Orthonormal columns, as a table like the one that was factored, and the triangle."""

    q: DataFrame
    r: np.ndarray


def columns(m: int) -> list[str]:
    return [f"x{i}" for i in range(m)]


def _lists(a: np.ndarray) -> pa.Array:
    """A list of one value: the matrix, row by row."""
    return pa.array([a.ravel()], pa.list_(pa.float64()))


def _qr(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A reduced QR factorisation, whose triangle has a diagonal that is not negative, so that it is unique."""
    q, r = np.linalg.qr(a)
    sign = np.where(np.diagonal(r) < 0, -1.0, 1.0)
    return q * sign, r * sign[:, None]


def _blocks(x: DataFrame, key: str, m: int, size: int) -> DataFrame:
    """block, keys, q, r of runs of at most ``size`` rows, each factored in the task that reads it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, serial, held, n = TaskContext.get().partitionId() << 32, 0, [], 0

        def flush(rows: pa.Table) -> pa.RecordBatch:
            a = np.stack([rows.column(i + 1).to_numpy() for i in range(m)], 1)
            q, r = _qr(a)
            keys = pa.ListArray.from_arrays(pa.array([0, rows.num_rows], pa.int32()), rows.column(0).combine_chunks())
            return pa.RecordBatch.from_arrays([pa.array([base + serial]), keys, _lists(q), _lists(r)], ["block", "keys", "q", "r"])

        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            while n >= size:
                rows = pa.Table.from_batches(held)
                yield flush(rows.slice(0, size))
                serial, n = serial + 1, n - size
                held = rows.slice(size).to_batches()
        if n:
            yield flush(pa.Table.from_batches(held))

    flat = x.select(F.col(key).cast("long").alias("key"), *[F.col(c).cast("double") for c in columns(m)])
    return flat.mapInArrow(run, "block long, keys array<long>, q array<double>, r array<double>")


def _stacked(nodes: DataFrame, m: int) -> DataFrame:
    """For each group of triangles (parent, block, r): the rows of its orthogonal factor by block, and one triangle."""

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("block")
        triangles = [np.array(r.as_py()).reshape(-1, m) for r in group.column("r")]
        q, r = _qr(np.concatenate(triangles))
        ends = np.cumsum([len(t) for t in triangles])
        parts = [part.ravel() for part in np.split(q, ends[:-1])]
        n = len(parts)
        # The first row of a group carries its triangle.
        up = pa.array([r.ravel(), *[None] * (n - 1)], pa.list_(pa.float64()))
        return pa.table({"parent": group.column("parent"), "block": group.column("block"), "q": pa.array(parts, pa.list_(pa.float64())), "r": up})

    return nodes.groupBy("parent").applyInArrow(run, "parent long, block long, q array<double>, r array<double>")


def _down(nodes: DataFrame, above: DataFrame, m: int) -> DataFrame:
    """(block, w): what the rows of a block are to be multiplied by, from its own factor and its parent's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(np.array(q).reshape(-1, len(w) // m) @ np.array(w).reshape(-1, m)).ravel() for q, w in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.float64()))], ["block", "w"])

    joined = nodes.select("block", "q", "parent").join(above.select(F.col("block").alias("parent"), "w"), "parent")
    return joined.select("block", "q", "w").mapInArrow(run, "block long, w array<double>")


def _rows(blocks: DataFrame, factors: DataFrame, key: str, m: int) -> DataFrame:
    """The rows of blocks, each multiplied by its factor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                w = batch.column(2)[i].values.to_numpy().reshape(-1, m)
                q = batch.column(1)[i].values.to_numpy().reshape(-1, len(w)) @ w
                yield pa.RecordBatch.from_arrays([batch.column(0)[i].values, *[pa.array(q[:, k]) for k in range(m)]], [key, *columns(m)])

    return blocks.join(factors, "block").select("keys", "q", "w").mapInArrow(run, f"{key} long, {', '.join(f'{c} double' for c in columns(m))}")


def factor(x: DataFrame, key: str, m: int, block: int | None = None, fan: int = FAN) -> Factors:
    """The QR factors of the table ``x`` with a row a ``key`` and the columns x0 to x(m-1), none of them null.

    ``block``: rows of a block, by default ``BLOCK`` numbers' worth. With fewer rows than columns, or none, the last
    columns of ``q`` and the last rows of the triangle are zero. Keys may be any distinct numbers.
    """
    spark = x.sparkSession
    size = max(m, block or BLOCK // m)
    leaves = keep(_blocks(x, key, m, size), "qr-blocks")
    n, tops = leaves.count(), leaves.select("block", "r")
    levels = []
    while n > 1:
        groups, level = -(-n // fan), len(levels)
        parent = F.pmod(F.xxhash64("block", F.lit(level)), F.lit(groups))
        levels.append(keep(_stacked(tops.select("block", "r", parent.alias("parent")), m), "qr-level"))
        tops = levels[-1].filter("r IS NOT NULL").select(F.col("parent").alias("block"), "r")
        n = tops.count()
    top = tops.collect()  # one triangle
    r = np.array(top[0].r).reshape(-1, m) if top else np.zeros((0, m))
    # The root's rows become the columns of the result; those that are lacking are zero.
    unit = np.eye(len(r), m)
    w = spark.createDataFrame([(t.block, unit.ravel().tolist()) for t in top], "block long, w array<double>")
    held = []
    for nodes in reversed(levels):
        w = keep(_down(nodes, w, m), "qr-down")
        held.append(w)
    q = keep(_rows(leaves, w, key, m), "qr-rows")
    discard(leaves, *levels, *held)
    return Factors(q, np.concatenate([r, np.zeros((m - len(r), m))]))


def times(x: DataFrame, key: str, m: int, by: np.ndarray) -> DataFrame:
    """The table times a small matrix of m rows, row by row where it lies."""
    terms = [sum((F.col(c) * float(by[i, k]) for i, c in enumerate(columns(m))), F.lit(0.0)).alias(f"x{k}") for k in range(by.shape[1])]
    return x.select(key, *terms)


def long_form(x: DataFrame, key: str, m: int) -> DataFrame:
    """(k, key, value) of every entry."""
    return x.select(key, F.posexplode(F.array(*columns(m))).alias("k", "value")).select("k", key, "value")
