"""Recursive bisection of the volume by the lines that a cut crosses.

A level of the tree is the same jobs, whatever the number of nodes in it: lines are cut at their nodes' boxes, their
entries and exits counted by node, axis and voxel layer, and a sweep over each axis's layers, as running sums, finds each
node's best cut. The driver sees a row a node. Lines then go to the left, the right, or both, by a join with the nodes below.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kernels
from ..functions import vec as V
from ..model import Volume
from ..storage import discard, keep
from . import statistics
from .trees import Box, Tree, blocks


def voxel_lines(rays: DataFrame, volume: Volume) -> DataFrame:
    """line, o0.., u0..: the source and unit direction in voxel coordinates."""
    dim = volume.dim
    s, d = V.to_voxel(V.cols("s", dim), volume), V.to_voxel(V.cols("d", dim), volume)
    return V.computed(rays, ["line"], [*V.named(s, "o"), *V.named(V.normalize(V.sub(d, s)), "u")])


def bounded(lines: DataFrame, dim: int) -> DataFrame:
    """``lines`` (with box columns lo_d, hi_d) that meet their box, with a0.. and b0.. where they enter and leave it."""
    o, u = V.cols("o", dim), V.cols("u", dim)
    lo, hi = [F.col(f"lo_{d}").cast("double") for d in range(dim)], [F.col(f"hi_{d}").cast("double") for d in range(dim)]
    sides = [h + 1 - x for h, x in zip(hi, lo, strict=True)]
    far = F.col("far")
    reach = 2 * V.distance(o, [x + 0.5 * s for x, s in zip(lo, sides, strict=True)])
    kept, lines = lines.columns, V.computed(lines, lines.columns, [reach.alias("far")])
    ends, end = V.names("end", dim), V.cols("end", dim)
    lines = V.computed(lines, kept, V.named([x + far * d for x, d in zip(o, u, strict=True)], "end"))
    hits = V.clipped(lines, [*kept, *ends], o, end, sides, lo)
    a, b = ([x + (y - x) * F.col(t) for x, y in zip(o, end, strict=True)] for t in ("t_in", "t_out"))
    return V.computed(hits, kept, [*V.named(a, "a"), *V.named(b, "b")])


def best_cuts(counts: DataFrame, weights: DataFrame, nodes: DataFrame, dim: int) -> DataFrame:
    """node, d, at, crossed, left, total of every node: the best cut, the lines it crosses, the weight before it and in all.

    ``counts`` (node, d, layer, way): entries less exits. ``weights`` (node, d, layer, weight). ``nodes`` (node, lo_0,
    hi_0, .., epsilon), a row a node. Going through the layers in order, a cut midway between two layers with events
    crosses the lines that have been entered and not left; the least number wins, then the least imbalance, which must stay
    below epsilon, then the first axis and layer. Nodes without such a cut are halved along the first axis.
    """
    nodes = F.broadcast(nodes)
    own = lambda x: F.element_at(F.array(*[F.col(f"{x}_{d}") for d in range(dim)]), F.col("d") + 1)
    axis = Window.partitionBy("node", "d")
    before = axis.orderBy("layer").rowsBetween(Window.unboundedPreceding, -1)
    cuts = counts.join(nodes, "node").select("node", "d", "layer", "way", own("lo").alias("lo"), own("hi").alias("hi"), "epsilon")
    cuts = cuts.withColumns({"crossed": F.coalesce(F.sum("way").over(before), F.lit(0)), "last": F.greatest("lo", F.max("layer").over(before))})
    cuts = cuts.where("layer > lo").withColumn("at", F.floor((F.col("layer") - 1 + F.col("last")) / 2).cast("int")).where("at < hi")
    # Weights and cuts in one order, weights first, so that a running sum is the weight up to each cut.
    both = cuts.select("node", "d", F.col("at").alias("place"), "layer", "crossed", "epsilon", F.lit(0.0).alias("weight"))
    both = both.unionByName(weights.select("node", "d", F.col("layer").alias("place"), "weight"), allowMissingColumns=True)
    so_far = axis.orderBy("place", F.col("crossed").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumns({"left": F.sum("weight").over(so_far), "total": F.sum("weight").over(axis)}).where("crossed IS NOT NULL")
    heavy = F.when(F.col("total") > 0, F.greatest("left", F.col("total") - F.col("left")) / (0.5 * F.col("total")) - 1).otherwise(0.0)
    both = both.withColumn("heavy", heavy).where("heavy < epsilon")
    best = both.groupBy("node").agg(F.min_by(F.struct("d", F.col("place").alias("at"), "crossed", "left"), F.struct("crossed", "heavy", "d", "layer")).alias("best"))
    middle = F.floor((F.col("lo_0") + F.col("hi_0")) / 2).cast("int")
    halves = weights.where("d = 0").join(nodes, "node").groupBy("node").agg(F.sum(F.when(F.col("layer") <= middle, F.col("weight")).otherwise(0.0)).alias("half"), F.sum("weight").alias("total"))
    rows = nodes.join(best, "node", "left").join(halves, "node", "left")
    return rows.select(
        "node", F.coalesce("best.d", F.lit(0)).alias("d"), F.coalesce("best.at", middle).alias("at"), F.coalesce("best.crossed", F.lit(0)).alias("crossed"),
        F.coalesce("best.left", "half", F.lit(0.0)).alias("left"), F.coalesce("total", F.lit(0.0)).alias("total"),
    )


def _layered(hits: DataFrame, dim: int) -> DataFrame:
    """``hits`` from ``bounded`` with what counting and splitting need of their ends: the layers a0.. and b0.. in which a
    line enters and leaves its box, and w0.., the way it goes along each axis."""
    ends = [V.truncated(F.col(f"{e}{d}")).cast("int").alias(f"{e}{d}") for e in "ab" for d in range(dim)]
    ways = [V.sign(F.col(f"b{d}") - F.col(f"a{d}")).alias(f"w{d}") for d in range(dim)]
    return hits.select("node", *V.cols("o", dim), *V.cols("u", dim), *ends, *ways)


def _goes(dim: int) -> Column:
    """Whether a line of the parent goes to the child ``node``: of both ends along the cut's axis, the lower decides on
    the left, which is even, and the upper on the right."""
    own = lambda f: reduce(lambda x, d: F.when(F.col("split_d") == d, f(f"a{d}", f"b{d}")).otherwise(x), range(1, dim), f("a0", "b0"))
    return F.when(F.col("node") % 2 == 0, own(F.least) <= F.col("split_at")).otherwise(own(F.greatest) > F.col("split_at"))


def partition_bisection(rays: DataFrame, volume: Volume, parts: int, epsilon: float = 0.2) -> Tree:
    """The voxel tree of ``parts`` (a power of two, 2 or more) parts."""
    depth = parts.bit_length() - 1
    if parts < 2 or 1 << depth != parts:
        raise ValueError("the number of parts must be a power of two, 2 or more")
    spark, dim = rays.sparkSession, volume.dim
    at = volume.unroll(F.col("voxel"))
    weights = statistics.voxel_weights(kernels.closest(rays, volume))
    weights = keep(weights.select(*[x.cast("int").alias(f"i{d}") for d, x in enumerate(at)], "value"), "bisection-weights")
    lines = voxel_lines(rays, volume).select(*V.cols("o", dim), *V.cols("u", dim), F.lit(0).alias("parent"))
    nodes: dict[int, tuple[Box, int, float]] = {1: ([(0, n - 1) for n in volume.voxels], parts, epsilon)}
    tree: Tree = {}
    before = None
    for level in range(depth):
        table = spark.createDataFrame(
            [(k, *[x for ends in b for x in ends], e / (p.bit_length() - 1), k // 2, *tree.get(k // 2, (0, 0))) for k, (b, p, e) in nodes.items()],
            "node int, " + ", ".join(f"lo_{d} int, hi_{d} int" for d in range(dim)) + ", epsilon double, parent int, split_d int, split_at int",
        )
        lines = lines.join(F.broadcast(table), "parent")  # a row a node of the level
        if level:
            lines = lines.where(_goes(dim))
        cut = _layered(bounded(lines.select("node", *V.cols("o", dim), *V.cols("u", dim), *[f"{x}_{d}" for d in range(dim) for x in ("lo", "hi")]), dim), dim)
        # The last level's lines are counted and go nowhere.
        if level < depth - 1:
            cut = keep(cut, "bisection-lines")
        events = F.array(*[F.struct(F.lit(d).alias("d"), F.col(f"{e}{d}").alias("layer"), (F.col(f"w{d}") if e == "a" else -F.col(f"w{d}")).alias("way")) for d in range(dim) for e in "ab"])
        counts = cut.select("node", F.explode(events).alias("e")).groupBy("node", "e.d", "e.layer").agg(F.sum("e.way").alias("way"))
        numbers = F.lit(list(nodes))
        k = statistics.owner([F.col(f"i{d}") for d in range(dim)], [b for b, _, _ in nodes.values()])
        by_axis = F.array(*[F.struct(F.lit(d).alias("d"), F.col(f"i{d}").alias("layer")) for d in range(dim)])
        layers = weights.select(k.alias("k"), "value", F.explode(by_axis).alias("e")).where("k IS NOT NULL")
        layers = layers.groupBy(numbers[F.col("k")].alias("node"), "e.d", "e.layer").agg(F.sum("value").alias("weight"))
        below: dict[int, tuple[Box, int, float]] = {}
        for r in best_cuts(counts, layers, table.drop("parent", "split_d", "split_at"), dim).collect():
            box, p, eps = nodes[r.node]
            d, a = r.d, r.at
            tree[r.node] = (d, a)
            for child, ends, weight in ((2 * r.node, (box[d][0], a), r.left), (2 * r.node + 1, (a + 1, box[d][1]), r.total - r.left)):
                own = list(box)
                own[d] = ends
                below[child] = (own, p // 2, (1 + eps) * (r.total / p) / weight * p / 2 - 1 if weight else eps)
        if before is not None:
            discard(before)
        before = cut
        lines = cut.withColumnRenamed("node", "parent")
        nodes = dict(sorted(below.items()))
    discard(before, weights)
    return tree


def partition_trivial(matrix: DataFrame, volume: Volume, parts: int) -> tuple[int, list[Box], int]:
    """(axis, boxes, communication volume) of the best cut into slabs along one axis, all axes in one job."""
    rows = V.computed(matrix, ["line"], V.named(volume.unroll(F.col("voxel")), "i"))
    slabs = F.array(*[F.struct(F.lit(d).alias("axis"), F.floor(F.col(f"i{d}") / F.lit(-(-n // parts))).cast("int").alias("part")) for d, n in enumerate(volume.voxels)])
    owned = rows.select("line", F.inline(slabs)).distinct()
    by = owned.groupBy("axis", "line").agg(F.count(F.lit(1)).alias("n")).groupBy("axis").agg(F.sum(F.col("n") - 1).alias("volume"))
    cost = {r.axis: r.volume for r in by.collect()}  # a row an axis
    axis = min(range(volume.dim), key=lambda d: (cost.get(d, 0), d))
    return axis, blocks(volume, tuple(parts if k == axis else 1 for k in range(volume.dim))), cost.get(axis, 0)
