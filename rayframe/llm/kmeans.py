"""Centroid clustering by kd-tree filtering: exact Lloyd rounds over integers.

Every task cuts its rows into blocks and builds a kd-tree over each. A node holds the count, the integer sums and the
box of its points. The trees are written once; each round reads them with the current centroids and goes down level by
level: of the centroids that are left to a node, those are pruned that are strictly farther than the one nearest to the
box's middle from every point of the box (the corner furthest their way decides). A node with one centroid left is
assigned whole; what reaches a leaf is resolved point by point. A block returns a row a centroid, however many points.

A hot vector takes no part in any shuffle: blocks are cut where the rows lie. The driver holds k centroids only.

Defined results: vectors that are null, of another size, or hold a null, NaN or infinite component are not kept. Equal
rows are points of their own. Fewer kept vectors than ``k`` give as many centroids; none give no rows. A component
beyond ``largest`` (2^27 at 64 components) after scaling has no exact distance in a long: its vector moves no centroid, and its cluster, distance and
centroid are null. Sums of distances beyond a long are null.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import discard, keep, tidy

#: Points in a tree and in a leaf. Results do not depend on them.
BLOCK, LEAF = 8192, 32
#: Products of components up to this sum exactly in doubles.
EXACT_DOUBLE = 1 << 20


def _exact(*arrays: np.ndarray) -> bool:
    return all(not a.size or max(-int(a.min()), int(a.max())) <= EXACT_DOUBLE for a in arrays) and arrays[0].shape[-1] <= 1 << 12


def largest(dim: int) -> int:
    """The largest component for which all squared distances fit 62 bits."""
    return 1 << ((62 - (dim - 1).bit_length()) // 2 - 1)


def squared_distances(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of all points and centroids as int64."""
    cross = (points.astype(float) @ centroids.T.astype(float)).astype(np.int64) if _exact(points, centroids) else points @ centroids.T
    return (points * points).sum(-1)[:, None] - 2 * cross + (centroids * centroids).sum(-1)[None, :]


@dataclass
class Tree:
    """A balanced kd-tree: level L has 2^L nodes, of which node i covers points[ends[L][i]:ends[L][i + 1]]."""

    points: np.ndarray
    order: np.ndarray
    ends: list[np.ndarray]
    sums: list[np.ndarray]
    low: list[np.ndarray]
    high: list[np.ndarray]

    @classmethod
    def build(cls, points: np.ndarray, leaf: int = LEAF) -> Tree:
        n, order, ends = len(points), np.arange(len(points)), [np.array([0, len(points)])]
        while n and (np.diff(ends[-1]) > leaf).any():
            last, cuts = ends[-1], [0]
            for a, b in zip(last[:-1], last[1:], strict=True):
                own = points[order[a:b]]
                middle = (b - a) // 2
                if middle:
                    axis = int(np.argmax(own.max(0) - own.min(0)))
                    order[a:b] = order[a:b][np.argpartition(own[:, axis], middle)]
                cuts += [a + middle, b]
            ends.append(np.array(cuts))
        points = points[order]
        each = lambda f: [f.reduceat(points, e[:-1], axis=0) if n else points for e in ends]  # noqa: E731  no node is empty
        return cls(points, order, ends, each(np.add), each(np.minimum), each(np.maximum))

    def filtered(self, centroids: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, int | None]]:
        """(first point, end, centroids by point, node) of parts of the tree; node tells whole nodes: (level, node)."""
        k = len(centroids)
        alive = np.ones((1, k), bool)
        open_ = np.ones(1, bool)
        for level, ends in enumerate(self.ends):
            at = np.flatnonzero(open_)
            if not len(at):
                return
            low, high, left = self.low[level][at], self.high[level][at], alive[at].copy()
            # Nearest to the middle, doubled to stay whole; any choice keeps results right, as pruning is checked.
            middle = squared_distances(low + high, 2 * centroids)
            middle[~left] = np.iinfo(np.int64).max
            best = middle.argmin(1)
            for z in range(k):
                to = centroids[z] - centroids[best]
                corner = np.where(to > 0, high, low)
                farther = ((corner - centroids[z]) ** 2).sum(1) > ((corner - centroids[best]) ** 2).sum(1)
                left[:, z] &= ~farther
            alone = left.sum(1) == 1
            for i in at[alone]:
                yield int(ends[i]), int(ends[i + 1]), left[np.searchsorted(at, i)].nonzero()[0], (level, int(i))
            if level + 1 == len(self.ends):
                for row, i in zip(left[~alone], at[~alone], strict=True):
                    among = np.flatnonzero(row)
                    own = self.points[ends[i] : ends[i + 1]]
                    yield int(ends[i]), int(ends[i + 1]), among[squared_distances(own, centroids[among]).argmin(1)], None
                return
            alive = np.zeros((2 * len(open_), k), bool)
            open_ = np.zeros(len(alive), bool)
            for child in (0, 1):
                alive[2 * at[~alone] + child], open_[2 * at[~alone] + child] = left[~alone], True

    def totals(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(count, sums) of the points nearest to each centroid; ties go to the smaller number."""
        counts, sums = np.zeros(len(centroids), np.int64), np.zeros_like(centroids)
        for a, b, to, node in self.filtered(centroids):
            if node:
                counts[to[0]] += b - a
                sums[to[0]] += self.sums[node[0]][node[1]]
            else:
                counts += np.bincount(to, minlength=len(centroids))
                np.add.at(sums, to, self.points[a:b])
        return counts, sums

    def assigned(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cluster, squared distance) of each point, in the points' first order."""
        cluster = np.zeros(len(self.points), np.int64)
        for a, b, to, _ in self.filtered(centroids):
            cluster[a:b] = to
        apart = self.points - centroids[cluster]
        back = np.empty_like(self.order)
        back[self.order] = np.arange(len(back))
        return cluster[back], (apart * apart).sum(1)[back]


def integers(vectors: DataFrame, dim: int, scale: int) -> DataFrame:
    """vec_id and v, the scaled whole components, of vectors with exactly ``dim`` finite components."""
    wide = F.transform("embedding", lambda x: x.cast("double"))
    bad = F.exists(wide, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    # The size is looked at first: nothing else needs to be right about arrays of another size.
    kept = vectors.where((F.size("embedding") == dim) & ~F.coalesce(bad, F.lit(True)))
    scaled = F.transform("embedding", lambda x: F.floor(F.least(F.greatest(x.cast("double") * scale, F.lit(-(2.0**62))), F.lit(2.0**62))).cast("long"))
    return kept.select("vec_id", scaled.alias("v"))


def in_range(v: Column, dim: int) -> Column:
    return ~F.exists(v, lambda x: F.abs(x) > largest(dim))


def _plant(dim: int, schema: pa.Schema):
    """Rows (vec_id, v) to rows (ids, tree): a tree's arrays, each a binary value."""

    def run(batches):
        def row(ids, flat):
            tree = Tree.build(flat)
            parts = [tree.points.astype(np.int32), tree.order.astype(np.int32), np.concatenate(tree.ends), *(np.concatenate(x) for x in (tree.sums, tree.low, tree.high))]
            held = pa.array([pa.concat_arrays(ids).to_pylist()], schema.field("ids").type)
            return pa.RecordBatch.from_arrays([held, pa.array([[p.tobytes() for p in parts]], pa.list_(pa.binary())), pa.array([len(tree.ends)], pa.int32())], schema=schema)

        ids, flats, n = [], [], 0
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK):
                part = batch.slice(start, BLOCK)
                ids.append(part.column(0))
                flats.append(part.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dim))
                n += part.num_rows
                if n >= BLOCK:
                    yield row(ids, np.concatenate(flats))
                    ids, flats, n = [], [], 0
        if n:
            yield row(ids, np.concatenate(flats))

    return tidy(run)


def _tree(parts: list[bytes], levels: int, dim: int) -> Tree:
    points, order = np.frombuffer(parts[0], np.int32).astype(np.int64).reshape(-1, dim), np.frombuffer(parts[1], np.int32)
    sizes = [1 << k for k in range(levels)]
    ends = np.split(np.frombuffer(parts[2], np.int64), np.cumsum([s + 1 for s in sizes])[:-1])
    cut = np.cumsum(sizes)[:-1]
    return Tree(points, order, ends, *(np.split(np.frombuffer(p, np.int64).reshape(-1, dim), cut) for p in parts[3:]))


def trees(points: DataFrame, dim: int) -> DataFrame:
    """kd-trees over blocks of (vec_id, v): rows (ids, tree, levels)."""
    id_type = points.schema["vec_id"].dataType
    schema = T.StructType([T.StructField("ids", T.ArrayType(id_type)), T.StructField("tree", T.ArrayType(T.BinaryType())), T.StructField("levels", T.IntegerType())])
    return points.mapInArrow(_plant(dim, to_arrow_schema(schema)), schema)


def _rows(batches, dim: int):
    for batch in batches:
        for row in range(batch.num_rows):
            yield batch.column(0).slice(row, 1), _tree(batch.column(1)[row].as_py(), batch.column(2)[row].as_py(), dim)


def next_centroids(planted: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Centroids after one round: floors of means; a centroid without a point stays."""
    k, dim = centroids.shape

    def run(batches):
        counts, sums = np.zeros(k, np.int64), np.zeros_like(centroids)
        for _, tree in _rows(batches, dim):
            more = tree.totals(centroids)
            counts, sums = counts + more[0], sums + more[1]
        on = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(on, pa.int32()), pa.array(counts[on]), pa.array(sums[on].tolist(), pa.list_(pa.int64()))], names=["cluster", "n", "sums"])

    found = planted.mapInArrow(tidy(run), "cluster int, n long, sums array<long>")
    found = found.select("cluster", "n", F.posexplode("sums").alias("axis", "s")).groupBy("cluster", "axis").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(20,0)")).alias("s"))
    out = centroids.copy()
    for r in found.collect():  # at most k * dim rows
        out[r.cluster, r.axis] = int(r.s) // r.n
    return out


def assign(planted: DataFrame, centroids: np.ndarray) -> DataFrame:
    """vec_id, cluster, distance of every point."""
    dim = centroids.shape[1]
    id_type = planted.schema["ids"].dataType.elementType

    def run(batches):
        for ids, tree in _rows(batches, dim):
            cluster, distance = tree.assigned(centroids)
            yield pa.RecordBatch.from_arrays([ids.flatten(), pa.array(cluster, pa.int32()), pa.array(distance)], names=["vec_id", "cluster", "distance"])

    schema = T.StructType([T.StructField("vec_id", id_type), T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())])
    return planted.mapInArrow(tidy(run), schema)


def first_centroids(points: DataFrame, k: int, seed: int) -> np.ndarray:
    """Of the ``k`` points whose ``seed:vec_id`` has the smallest SHA-256, the components; ties by components."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    rows = points.select(digest.alias("digest"), "v").orderBy("digest", "v").limit(k).collect()
    return np.array([r.v for r in rows], np.int64)


def cluster(vectors: DataFrame, k: int = 16, rounds: int = 3, dim: int = 64, scale: int = 64, seed: int = 1) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every kept vector (vec_id, embedding)."""
    points = integers(vectors, dim, scale)
    inside = points.where(in_range(F.col("v"), dim))
    centroids = first_centroids(inside, k, seed)
    beyond = points.where(~in_range(F.col("v"), dim)).select("vec_id")
    names = {"cluster": "int", "distance": "long", "cluster_inertia": "long", "inertia": "long", "centroid_sha256": "string"}
    nothing = beyond.select("vec_id", *[F.lit(None).cast(t).alias(n) for n, t in names.items()])
    if not len(centroids):
        return nothing
    planted = keep(trees(inside, dim), "kd-trees")
    for _ in range(rounds):
        centroids = next_centroids(planted, centroids)
    found = keep(assign(planted, centroids), "kd-assigned")
    discard(planted)
    inertia = {r.cluster: int(r.s) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("s")).collect()}
    long = lambda x: F.lit(x if x < 1 << 63 else None).cast("long")
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    of = lambda values: F.element_at(F.array(*values), F.col("cluster") + 1)
    out = found.select(
        "vec_id", "cluster", "distance", of([long(inertia.get(i, 0)) for i in range(len(centroids))]).alias("cluster_inertia"),
        long(sum(inertia.values())).alias("inertia"), of([F.lit(d) for d in digests]).alias("centroid_sha256"),
    )
    return out.unionByName(nothing)


def _sql(k: int = 16, rounds: int = 3) -> str:
    steps = [f"""
p AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, v FROM (SELECT vec_id, [CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64)),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), v) - 1 AS cluster, v AS c FROM p ORDER BY sha256('1:' || vec_id), v LIMIT {k})"""]
    for i in range(rounds + 1):
        steps.append(f"""
a{i} AS MATERIALIZED (SELECT r, min(d * {k} + cluster) // {k} AS distance, min(d * {k} + cluster) % {k} AS cluster FROM
  (SELECT r, cluster, list_sum([(v[i] - c[i]) * (v[i] - c[i]) FOR i IN range(1, 65)])::BIGINT AS d FROM p, c{i}) GROUP BY r)""")
        if i < rounds:
            steps.append(f"""
s{i} AS (SELECT cluster, axis, sum(v[axis]) AS s, count(*) AS n FROM a{i} JOIN p USING (r), range(1, 65) AS x(axis) GROUP BY cluster, axis),
m{i} AS (SELECT cluster, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY axis) AS c FROM s{i} GROUP BY cluster),
c{i + 1} AS MATERIALIZED (SELECT o.cluster, coalesce(m.c, o.c) AS c FROM c{i} o LEFT JOIN m{i} m USING (cluster))""")
    return "WITH" + ",".join(steps) + f"""
SELECT p.vec_id, CAST(a.cluster AS INTEGER) AS cluster, CAST(a.distance AS BIGINT) AS distance, CAST(sum(a.distance) OVER (PARTITION BY a.cluster) AS BIGINT) AS cluster_inertia,
  CAST(sum(a.distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.c, ',')) AS centroid_sha256
FROM a{rounds} a JOIN p USING (r) JOIN c{rounds} c ON c.cluster = a.cluster"""


SQL = _sql()
