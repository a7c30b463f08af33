"""Kd-tree filtering against plain Lloyd rounds in Python integers, odd vectors, the query against SQL."""

import hashlib
import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from rayframe.llm import kmeans


def plain(rows, k, rounds, dim, scale=64, seed=1):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    digest = lambda i: hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
    c = [v for _, v in sorted(((digest(i), v) for i, v in kept))[:k]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    nearest = lambda v: min((far(v, z), i) for i, z in enumerate(c))
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(nearest(v)[1], []).append(v)
        c = [[sum(x) // len(groups[i]) for x in zip(*groups[i], strict=True)] if i in groups else z for i, z in enumerate(c)]
    at = [(i, *nearest(v)) for i, v in kept]
    inertia = [sum(d for _, d, z in at if z == i) for i in range(len(c))]
    return sorted(((i, z, d, inertia[z], sum(inertia), hashlib.sha256(",".join(map(str, c[z])).encode()).hexdigest()) for i, d, z in at), key=str)


def found(df, **more):
    return sorted(map(tuple, kmeans.cluster(df, **more).collect()), key=str)


@pytest.mark.parametrize("dim", [2, 64])
def test_plain(spark, dim):
    random.seed(dim)
    centre = [[random.uniform(-1, 1) for _ in range(dim)] for _ in range(6)]
    rows = [(i, [x + random.gauss(0, 0.1) for x in centre[i % 6]]) for i in range(600)]
    rows += [(1000 + i, centre[0]) for i in range(300)] + [(5, centre[1])] * 3 + [(None, centre[2])] * 2  # a hot vector, repeated rows, null ids
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3).withColumn("cluster", F.lit(9)).withColumn("v", F.lit(9))
    assert found(df, dim=dim) == plain(rows, 16, 3, dim)


def test_filtering():
    """Whole nodes are assigned, and totals and places are those of plain distances, ties and equal centroids included."""
    rng = np.random.default_rng(3)
    points = np.concatenate([rng.integers(-30, 30, (3000, 2)), np.full((2000, 2), 7)])
    centroids = np.array([[-20, -20], [20, 20], [7, 7], [7, 7], [0, 0], [-20, 20], [500, 500]])
    tree = kmeans.Tree.build(points.copy(), 16)
    want = kmeans.squared_distances(points, centroids)
    cluster, distance = tree.assigned(centroids)
    assert (cluster == want.argmin(1)).all() and (distance == want.min(1)).all()
    counts, sums = tree.totals(centroids)
    assert (counts == np.bincount(cluster, minlength=7)).all()
    assert (sums == np.array([points[cluster == i].sum(0) for i in range(7)])).all()
    parts = list(tree.filtered(centroids))
    assert sum(b - a for a, b, *_ in parts) == len(points)
    assert sum(b - a for a, b, _, node in parts if node) > len(points) // 4
    one = kmeans.Tree.build(points[:1])
    assert one.assigned(centroids)[0].tolist() == [want[0].argmin()]
    large = np.array([[1 << 27] * 64, [-(1 << 27)] * 64])
    assert kmeans.squared_distances(large, large).tolist() == [[0, 1 << 62], [1 << 62, 0]]


def test_odd(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.5, 0.25]), (2, [nan, 0.0]), (3, [0.0, inf]), (4, [0.0]), (5, None), (6, [None, 1.0]), (7, []), (8, [1e30, 0.0]), (9, [-0.5, 3.0]), (9, [-0.5, 3.0]), (10, [-inf, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = found(df, dim=2)
    assert [r for r in got if r[0] != 8] == plain([r for r in rows if r[0] != 8], 16, 3, 2)
    assert [r for r in got if r[0] == 8] == [(8, None, None, None, None, None)]
    assert found(df.where("vec_id IN (2, 4, 5)"), dim=2) == []
    assert found(df.limit(0), dim=2) == []
    strings = df.withColumn("vec_id", F.concat(F.lit("v"), "vec_id"))
    assert len(found(strings, dim=2)) == 4


def test_sql(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    con = duckdb.connect()
    con.execute("create view embeddings as select * from read_parquet('/root/testdata/sf0.001/embeddings.parquet')")
    out = kmeans.cluster(df)
    want = con.execute(f"select {', '.join(out.columns)} from ({kmeans.SQL})").fetchall()
    assert sorted(map(tuple, out.collect())) == sorted(want)
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    assert sorted(want, key=str) == plain(rows, 16, 3, 64)
