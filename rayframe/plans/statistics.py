"""What a partitioning of the volume costs: communication, messages, imbalance, boundary.

Boxes come one row a part, so the table of parts is as small as the cluster. A voxel's owner is found by one pass over
the elements; owners of a line are distinct pairs, which partial aggregation thins out before the shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vec as V
from ..model import Volume
from .trees import Box


#: Boxes up to which owners are found by one condition each; more are looked up by cuts.
EXPRESSION_PARTS = 16


def cuts(of: list[Box]) -> list[tuple[int, int, int, int]] | None:
    """A binary tree of cuts that tells the boxes apart: (axis, at, left, right) by node, (-1, box, 0, 0) at a leaf.

    None where no plane separates them, or where they leave gaps.
    """
    nodes: list[tuple[int, int, int, int]] = []

    def cells(box: Box) -> int:
        return reduce(lambda n, e: n * (e[1] - e[0] + 1), box, 1)

    def build(own: list[int]) -> int:
        k = len(nodes)
        if len(own) == 1:
            nodes.append((-1, own[0], 0, 0))
            return k
        nodes.append((0, 0, 0, 0))
        best = None
        for d in range(len(of[0])):
            for at in {of[i][d][1] for i in own}:
                left = [i for i in own if of[i][d][1] <= at]
                right = [i for i in own if of[i][d][0] > at]
                if left and right and len(left) + len(right) == len(own):
                    uneven = abs(len(left) - len(right))
                    if best is None or (uneven, d, at) < best[:3]:
                        best = (uneven, d, at, left, right)
        if best is None:
            raise ValueError("the boxes interlock")
        nodes[k] = (best[1], best[2], build(best[3]), build(best[4]))
        return k

    whole = [(min(b[d][0] for b in of), max(b[d][1] for b in of)) for d in range(len(of[0]))]
    if sum(map(cells, of)) != cells(whole):
        return None
    try:
        build(list(range(len(of))))
    except ValueError:
        return None
    return nodes


def owner(at: list[Column], of: list[Box]) -> Column:
    """The part whose box a voxel lies in, without a join; ``at`` should be plain columns, as each is used often."""
    if len(of) > EXPRESSION_PARTS and (nodes := cuts(of)):
        axis, cut, left, right = (F.lit([int(n[k]) for n in nodes]) for k in range(4))
        depth = [0] * len(nodes)
        for k, n in enumerate(nodes):
            if n[0] >= 0:
                depth[n[2]] = depth[n[3]] = depth[k] + 1
        here = F.array(*[x.cast("int") for x in at])
        whole = [(min(b[d][0] for b in of), max(b[d][1] for b in of)) for d in range(len(at))]

        def step(n: Column, _) -> Column:
            d = axis[n]
            return F.when(d < 0, n).when(here[d] <= cut[n], left[n]).otherwise(right[n])

        leaf = F.aggregate(F.sequence(F.lit(1), F.lit(max(1, *depth))), F.lit(0), step)
        inside = reduce(lambda a, b: a & b, [(x >= lo) & (x <= hi) for x, (lo, hi) in zip(at, whole, strict=True)])
        return F.when(inside, cut[leaf])
    out = F.lit(None).cast("int")
    for k, box in enumerate(of):
        out = F.when(reduce(lambda a, b: a & b, [(x >= lo) & (x <= hi) for x, (lo, hi) in zip(at, box, strict=True)]), k).otherwise(out)
    return out


def owners(matrix: DataFrame, volume: Volume, of: list[Box]) -> DataFrame:
    """Distinct (line, part)."""
    rows = V.computed(matrix, ["line"], V.named(volume.unroll(F.col("voxel")), "i"))
    return rows.select("line", owner(V.cols("i", volume.dim), of).alias("part")).filter("part IS NOT NULL").distinct()


def communication_volume(owned: DataFrame) -> DataFrame:
    """One row: volume, the sum over lines of owners less one."""
    return owned.groupBy("line").agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("volume"))


def message_count(owned: DataFrame, parts: int) -> DataFrame:
    """One row: messages, the ordered pairs of parts that share a line, each with itself, less the number of parts.

    The pairs are formed from the distinct sets of owners, of which there are few, not line by line.
    """
    sets = owned.groupBy("line").agg(F.array_sort(F.collect_set("part")).alias("set")).select("set").distinct()
    pairs = sets.select(F.explode("set").alias("a"), "set").select("a", F.explode("set").alias("b")).distinct()
    return pairs.agg((F.count(F.lit(1)) - F.lit(parts)).alias("messages"))


def voxel_weights(matrix: DataFrame) -> DataFrame:
    """(voxel, value): how often each voxel is hit."""
    return matrix.groupBy("voxel").agg(F.count(F.lit(1)).cast("double").alias("value"))


def partial_sums(weights: DataFrame, volume: Volume) -> DataFrame:
    """(voxel, i0, i1, .., value) of all voxels: sums over all voxels up to each, one running sum an axis."""
    rows = volume.grid(weights.sparkSession).join(weights.select("voxel", F.col("value").alias("w")), "voxel", "left").fillna(0.0, ["w"])
    axes = [f"i{d}" for d in range(volume.dim)]
    for a in axes:
        rows = rows.withColumn("w", F.sum("w").over(Window.partitionBy(*[x for x in axes if x != a]).orderBy(a).rowsBetween(Window.unboundedPreceding, 0)))
    return rows.select("voxel", *axes, F.col("w").alias("value"))


def box_weight(sums: DataFrame, volume: Volume, box: Box) -> DataFrame:
    """One row: weight of an inclusive box, from the partial sums at its 2^D corners."""
    corners = []
    for k in range(1 << volume.dim):
        at = [(lo - 1 if k >> d & 1 else hi) for d, (lo, hi) in enumerate(box)]
        if min(at) >= 0:
            voxel, stride = 0, 1
            for x, n in zip(at, volume.voxels, strict=True):
                voxel, stride = voxel + x * stride, stride * n
            corners.append((voxel, -1.0 if k.bit_count() % 2 else 1.0))
    signed = reduce(lambda out, c: F.when(F.col("voxel") == c[0], F.col("value") * c[1]).otherwise(out), corners, F.lit(0.0))
    return sums.filter(F.col("voxel").isin([v for v, _ in corners])).agg(F.coalesce(F.sum(signed), F.lit(0.0)).alias("weight"))


def load_imbalance(weights: DataFrame, volume: Volume, of: list[Box]) -> DataFrame:
    """One row: imbalance, the largest weight of a part over the average, less 1, at least 0."""
    rows = V.computed(weights, ["value"], V.named(volume.unroll(F.col("voxel")), "i"))
    rows = rows.select(owner(V.cols("i", volume.dim), of).alias("part"), "value").filter("part IS NOT NULL")
    by = rows.groupBy("part").agg(F.sum("value").alias("w"))
    return by.agg(F.greatest(F.lit(0.0), F.max("w") / (F.sum("w") / F.lit(len(of))) - 1).alias("imbalance"))


def regularizer_volume(volume: Volume, of: list[Box]) -> int:
    """Boundary voxels exchanged by a neighbourhood operator: those of all parts less those of the whole (3-D)."""

    def surface(x: int, y: int, z: int) -> int:
        return 2 * (x * y + (x - 1) * z + (y - 1) * (z - 1))

    return sum(surface(*[hi - lo + 1 for lo, hi in b]) for b in of) - surface(*volume.voxels)


def regularizer_rows(parts: DataFrame, volume: Volume) -> DataFrame:
    """One row: volume, the same from a table of parts (lo_0, hi_0, ..), however many."""
    x, y, z = (F.col(f"hi_{d}") - F.col(f"lo_{d}") + 1 for d in range(3))
    whole = regularizer_volume(volume, [])
    return parts.agg((F.coalesce(F.sum(2 * (x * y + (x - 1) * z + (y - 1) * (z - 1))), F.lit(0)) + whole).cast("long").alias("volume"))
