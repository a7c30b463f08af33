"""What parts of a volume exchange over detector pixels they share.

With global line numbers the exchange itself is one aggregation by line. Shadows, overlaps, owners and messages are
tables of their own, as they are what a partitioning is judged by.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vec as V
from ..functions.kernels import joseph_value
from ..model import Volume
from ..sources.geometry import pixel_ray


def local_volumes(parts: DataFrame, volume: Volume) -> DataFrame:
    """part, origin_d, length_d of each box in the volume's own coordinates."""
    out = []
    for d, (o, x, n) in enumerate(zip(volume.origin, volume.lengths, volume.voxels, strict=True)):
        out += [(o + F.col(f"lo_{d}") * (x / n)).alias(f"origin_{d}"), ((F.col(f"hi_{d}") - F.col(f"lo_{d}") + 1) * (x / n)).alias(f"length_{d}")]
    return parts.select("part", *out)


def shadows(parts: DataFrame, views: DataFrame, volume: Volume, few_parts: bool = True) -> DataFrame:
    """part, view, min_x, min_y, max_x, max_y: pixels around the projections of a box's corners, one to spare.

    ``few_parts``: as many boxes as executors at most, which go to the views; else views go to the boxes.
    """
    boxes = local_volumes(parts, volume)
    rows = views.crossJoin(F.broadcast(boxes)) if few_parts else boxes.crossJoin(F.broadcast(views))  # views: a row a projection
    s, c, a, b = (V.cols(x, 3) for x in "scab")
    names = [x for x in rows.columns if x not in ("view", "part")]
    rows = V.computed(rows, ["part", "view", *names], V.named(V.normalize(V.cross(a, b)), "w"))
    # Corners differ by sides of the box, so products with them are sums of a few numbers; eight corners stay short code.
    parts_of = []
    for f, e in (("w", V.cols("w", 3)), ("a", a), ("b", b)):
        parts_of += [V.dot(V.cols("origin_", 3), e).alias(f"{f}_o"), V.dot(s, e).alias(f"{f}_s"), V.dot(c, e).alias(f"{f}_c"), V.dot(e, e).alias(f"{f}_n")]
        parts_of += [(e[d] * F.col(f"length_{d}")).alias(f"{f}_{d}") for d in range(3)]
    rows = V.computed(rows, ["part", "view", "n0", "n1", "parallel"], parts_of)

    def corner(f: str, k: int) -> Column:
        return reduce(lambda x, d: x + F.col(f"{f}_{d}") if k >> d & 1 else x, range(3), F.col(f"{f}_o"))

    # For parallel views rays run along the line from the source to the detector's corner.
    held = rows.columns
    way = [F.when(F.col("parallel"), F.col("w_c") - F.col("w_s")).otherwise(corner("w", k) - F.col("w_s")) for k in range(8)]
    left = [F.when(F.col("parallel"), F.col("w_c") - corner("w", k)).otherwise(F.col("w_c") - F.col("w_s")) for k in range(8)]
    rows = V.computed(rows, held, [(g / F.when(F.abs(x) >= 1e-3, x)).alias(f"t{k}") for k, (x, g) in enumerate(zip(way, left, strict=True))])
    pixels = []
    for k in range(8):
        for i, e in enumerate("ab"):
            at, t = corner(e, k), F.col(f"t{k}")
            place = F.when(F.col("parallel"), at + t * (F.col(f"{e}_c") - F.col(f"{e}_s"))).otherwise(F.col(f"{e}_s") + t * (at - F.col(f"{e}_s")))
            pixels.append(V.truncated((place - F.col(f"{e}_c")) / F.col(f"{e}_n") + 0.5).alias(f"q{k}_{i}"))
    rows = V.computed(rows, ["part", "view", "n0", "n1"], pixels)
    low = [F.least(*[F.col(f"q{k}_{i}") for k in range(8)]) for i in range(2)]
    high = [F.greatest(*[F.col(f"q{k}_{i}") for k in range(8)]) for i in range(2)]
    edge = [F.col(n).cast("long") - 1 for n in ("n0", "n1")]
    return V.computed(rows, ["part", "view"], [*[F.greatest(x - 1, F.lit(0)).alias(n) for x, n in zip(low, ("min_x", "min_y"), strict=True)], *[F.least(x + 1, e).alias(n) for x, e, n in zip(high, edge, ("max_x", "max_y"), strict=True)]])


def overlaps(shadow: DataFrame, band: int = 256) -> DataFrame:
    """a, b, view, min_x, .. of the non-empty intersections of two parts' shadows (a <> b).

    Shadows meet in bands of ``band`` rows of a view; a pair counts in the band where its intersection begins.
    """
    rows = shadow.filter("max_x >= min_x AND max_y >= min_y")
    rows = rows.withColumn("band", F.explode(F.sequence(F.floor(F.col("min_y") / band), F.floor(F.col("max_y") / band))))
    a, b = (rows.select("view", "band", *[F.col(c).alias(f"{x}_{c}") for c in ("part", "min_x", "min_y", "max_x", "max_y")]) for x in "ab")
    both = a.join(b, ["view", "band"]).filter("a_part <> b_part").filter(F.floor(F.greatest("a_min_y", "b_min_y") / band) == F.col("band"))
    ends = [f("a_" + c, "b_" + c).alias(c) for c, f in (("min_x", F.greatest), ("min_y", F.greatest), ("max_x", F.least), ("max_y", F.least))]
    return both.select(F.col("a_part").alias("a"), F.col("b_part").alias("b"), "view", *ends).filter("max_x >= min_x AND max_y >= min_y")


def restricted(rays: DataFrame, shadow: DataFrame) -> DataFrame:
    """part, local_line, and the columns of the rays whose pixels lie in each part's shadows.

    Local lines are numbered view by view and row by row within a part.
    """
    w, h = F.col("max_x") - F.col("min_x") + 1, F.col("max_y") - F.col("min_y") + 1
    size = shadow.withColumn("n", F.greatest(w, F.lit(0)) * F.greatest(h, F.lit(0)))
    before = F.sum("n").over(Window.partitionBy("part").orderBy("view").rowsBetween(Window.unboundedPreceding, -1))
    first = size.withColumn("first", F.coalesce(before, F.lit(0)).cast("long")).drop("n")
    rows = rays.join(first, "view").filter("p0 BETWEEN min_x AND max_x AND p1 BETWEEN min_y AND max_y")
    local = F.col("first") + (F.col("p1") - F.col("min_y")) * w + F.col("p0") - F.col("min_x")
    return rows.select("part", local.alias("local_line"), *rays.columns)


def contributions(shadow: DataFrame, n0: int, n1: int) -> DataFrame:
    """view, pixel, owner, target: every contributor of a pixel next to the one that owns it.

    Among a pixel's contributors, in order, the one at position pixel modulo their number owns it.
    """
    cell = F.explode(F.sequence(F.col("min_y"), F.col("max_y")))
    rows = shadow.filter("max_x >= min_x AND max_y >= min_y").select("part", "view", "min_x", "max_x", cell.alias("y"))
    rows = rows.select("part", "view", "y", F.explode(F.sequence("min_x", "max_x")).alias("x")).select("part", "view", (F.col("y") * n0 + F.col("x")).alias("pixel"))
    who = rows.groupBy("view", "pixel").agg(F.array_sort(F.collect_list("part")).alias("who"))  # no longer than there are parts
    at = F.pmod(F.col("view").cast("long") * (n0 * n1) + F.col("pixel"), F.size("who")).cast("int") + 1
    return who.select("view", "pixel", F.element_at("who", at).alias("owner"), F.explode("who").alias("target"))


def messages(contributed: DataFrame) -> DataFrame:
    """One row: messages, ordered pairs of different parts that send values, and as many that return sums."""
    pairs = contributed.filter("owner <> target").select("owner", "target").distinct()
    return pairs.agg((F.count(F.lit(1)) * 2).alias("messages"))


def exchanged(local: DataFrame) -> DataFrame:
    """``local`` (part, line, value) with each line's value summed over all parts that hold it."""
    total = local.groupBy("line").agg(F.sum("value").alias("total"))
    return local.join(total, "line").select("part", "line", F.col("total").alias("value"))


def orthogonal_slices(image: DataFrame, volume: Volume) -> list[DataFrame]:
    """The three middle slices."""
    from .image import sliced

    return [sliced(image, volume, d, volume.voxels[d] // 2) for d in range(3)]


def count_messages(matrix_owners: DataFrame) -> DataFrame:
    """owner, partners: how many other parts each part meets on some line."""
    sets = matrix_owners.groupBy("line").agg(F.array_sort(F.collect_set("part")).alias("set")).select("set").distinct()
    pairs = sets.select(F.explode("set").alias("owner"), "set").select("owner", F.explode("set").alias("other")).filter("owner <> other").distinct()
    return pairs.groupBy("owner").agg(F.count(F.lit(1)).alias("partners"))


def column_shadow(voxels: DataFrame, volume: Volume, views: DataFrame) -> DataFrame:
    """Shadows of single voxels (column ``voxel``) as boxes: the pixels a matrix column may have elements in."""
    i = volume.unroll(F.col("voxel"))
    boxes = voxels.select(F.col("voxel").alias("part"), *reduce(lambda out, d: [*out, i[d].alias(f"lo_{d}"), i[d].alias(f"hi_{d}")], range(3), []))
    return shadows(boxes, views, volume, few_parts=False).withColumnRenamed("part", "voxel")


def columns(voxels: DataFrame, volume: Volume, views: DataFrame, value=joseph_value) -> DataFrame:
    """The matrix by its columns: line, voxel, value of every pixel in the shadow of each of ``voxels``, zeros included.

    A voxel's shadow names its pixels, from which their rays follow, so no table of rays is made or joined; ``value``
    is a kernel of one voxel and one line (origin, direction in voxel coordinates). Views have equal shapes.
    """
    shade = column_shadow(voxels, volume, views).filter("max_x >= min_x AND max_y >= min_y")
    rows = shade.join(views, "view").withColumn("p1", F.explode(F.sequence("min_y", "max_y"))).withColumn("p0", F.explode(F.sequence("min_x", "max_x")))
    line = F.col("view").cast("long") * F.col("n0") * F.col("n1") + F.col("p0") + F.col("p1") * F.col("n0")
    source, at = pixel_ray(F.col("p0"), F.col("p1"), 3)
    o, d = V.to_voxel(source, volume), V.to_voxel(at, volume)
    rows = V.computed(rows, ["voxel"], [line.alias("line"), *V.named(o, "o"), *V.named(d, "d")])
    rows = V.computed(rows, ["line", "voxel", *V.cols("o", 3)], [*V.named(V.normalize(V.sub(V.cols("d", 3), V.cols("o", 3))), "u"), *V.named(volume.unroll(F.col("voxel")), "i")])
    return V.computed(rows, ["line", "voxel"], [value(V.cols("o", 3), V.cols("u", 3), V.cols("i", 3)).alias("value")])
