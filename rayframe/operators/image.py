"""Images and projections as (key, value) tables: algebra, slices, scaling, phantoms."""

from __future__ import annotations

from functools import reduce
from math import cos, pi, sin

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vec as V
from ..model import Volume
from .linop import combine

#: The Shepp-Logan phantom's ellipses (intensity, half axes, centre, angle in degrees).
SHEPP_LOGAN = [
    (2, 0.69, 0.92, 0, 0, 0), (-0.98, 0.6624, 0.8740, 0, -0.0184, 0), (-0.02, 0.1100, 0.3100, 0.22, 0, -18), (-0.02, 0.1600, 0.4100, -0.22, 0, 18),
    (0.01, 0.2100, 0.2500, 0, 0.35, 0), (0.01, 0.0460, 0.0460, 0, 0.1, 0), (0.02, 0.0460, 0.0460, 0, -0.1, 0), (0.01, 0.0460, 0.0230, -0.08, -0.605, 0),
    (0.01, 0.0230, 0.0230, 0, -0.606, 0), (0.01, 0.0230, 0.0460, 0.06, -0.605, 0),
]
#: The modified phantom's ellipses, with more contrast.
MODIFIED = [
    (1, 0.69, 0.92, 0, 0, 0), (-0.80, 0.6624, 0.8740, 0, -0.0184, 0), (-0.20, 0.1100, 0.3100, 0.22, 0, -18), (-0.20, 0.1600, 0.4100, -0.22, 0, 18),
    (0.10, 0.2100, 0.2500, 0, 0.35, 0), (0.10, 0.0460, 0.0460, 0, 0.1, 0), (0.10, 0.0460, 0.0460, 0, -0.1, 0), (0.10, 0.0460, 0.0230, -0.08, -0.605, 0),
    (0.10, 0.0230, 0.0230, 0, -0.606, 0), (0.10, 0.0230, 0.0460, 0.06, -0.605, 0),
]
#: The modified phantom's ellipsoids (intensity, half axes, centre, three angles in degrees).
MODIFIED_SPACE = [
    (1.00, 0.6900, 0.9200, 0.810, 0.0000, 0.0000, 0.00, 0.0, 0.0, 0.0), (-0.8, 0.6624, 0.8740, 0.780, 0.0000, -0.0184, 0.00, 0.0, 0.0, 0.0),
    (-0.2, 0.1100, 0.3100, 0.220, 0.2200, 0.0000, 0.00, -18.0, 0.0, 0.0), (-0.2, 0.1600, 0.4100, 0.280, -0.2200, 0.0000, 0.00, 18.0, 0.0, 0.0),
    (0.1, 0.2100, 0.2500, 0.410, 0.0000, 0.3500, 0.00, 0.0, 0.0, 0.0), (0.1, 0.0460, 0.0460, 0.050, 0.0000, 0.1000, 0.00, 0.0, 0.0, 0.0),
    (0.1, 0.0460, 0.0460, 0.050, 0.0000, -0.1000, 0.00, 0.0, 0.0, 0.0), (0.1, 0.0460, 0.0230, 0.050, -0.0800, -0.6050, 0.00, 0.0, 0.0, 0.0),
    (0.1, 0.0230, 0.0230, 0.020, 0.0000, -0.6060, 0.00, 0.0, 0.0, 0.0), (0.1, 0.0230, 0.0460, 0.020, 0.0600, -0.6050, 0.00, 0.0, 0.0, 0.0),
]


def elementwise(a: DataFrame, b: DataFrame, op: str, key: str = "voxel") -> DataFrame:
    """a op b for op in + - * /; division by what is absent or zero gives null."""
    ops = {"+": lambda x, y: x + y, "-": lambda x, y: x - y, "*": lambda x, y: x * y, "/": lambda x, y: x / F.when(y != 0, y)}
    return combine(a, b, key, ops[op])


def mapped(a: DataFrame, f) -> DataFrame:
    """Each value v as f(v): scalar algebra, logarithm, clamp, box."""
    return a.withColumn("value", f(F.col("value")))


def clamped(a: DataFrame, low: float, high: float) -> DataFrame:
    return mapped(a, lambda v: F.least(F.greatest(v, F.lit(float(low))), F.lit(float(high))))


def errors(a: DataFrame, b: DataFrame, key: str = "voxel") -> DataFrame:
    """One row: l1, l2 of the difference."""
    d = combine(a, b, key, lambda x, y: x - y)
    return d.agg(F.sum(F.abs("value")).alias("l1"), F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("l2"))


def summary(a: DataFrame) -> DataFrame:
    """One row: norm, total, min_value, max_value."""
    v = F.col("value")
    return a.agg(F.sqrt(F.sum(v * v)).alias("norm"), F.sum(v).alias("total"), F.min(v).alias("min_value"), F.max(v).alias("max_value"))


def sliced(image: DataFrame, volume: Volume, axis: int, index: int) -> DataFrame:
    """The image of dimension D - 1 in one layer."""
    i = volume.unroll(F.col("voxel"))
    rest = Volume(tuple(n for d, n in enumerate(volume.voxels) if d != axis))
    return image.filter(i[axis] == index).select(rest.index([x for d, x in enumerate(i) if d != axis]).alias("voxel"), "value")


def downscaled(image: DataFrame, volume: Volume, voxels: tuple[int, ...], accumulate: bool = False) -> DataFrame:
    """An image of fewer voxels: every stride-th value, or with ``accumulate`` all values added up and scaled by the ratio."""
    i, small = volume.unroll(F.col("voxel")), Volume(voxels)
    if accumulate:
        at = [F.floor(x * m / n) for x, m, n in zip(i, voxels, volume.voxels, strict=True)]
        return image.groupBy(small.index(at).alias("voxel")).agg((F.sum("value") * (small.cells / volume.cells)).alias("value"))
    stride = [n // m for n, m in zip(volume.voxels, voxels, strict=True)]
    whole = [(F.pmod(x, F.lit(s)) == 0) & (F.floor(x / s) < m) for x, s, m in zip(i, stride, voxels, strict=True)]
    ok = whole[0]
    for w in whole[1:]:
        ok = ok & w
    return image.filter(ok).select(small.index([F.floor(x / s) for x, s in zip(i, stride, strict=True)]).alias("voxel"), "value")


def oblique_slice(image: DataFrame, volume: Volume, base, x_axis, y_axis, n: int) -> DataFrame:
    """(x, y, value) of an n by n slice of a 3-D image; the slice's points are base + x b_x + y b_y in [-1, 1]^3."""
    spark = image.sparkSession
    grid = spark.range(n * n).select(F.pmod(F.col("id"), F.lit(n)).alias("x"), F.floor(F.col("id") / n).alias("y"))
    at = [F.lit(float(b)) + F.col("x") / n * float(p) + F.col("y") / n * float(q) for b, p, q in zip(base, x_axis, y_axis, strict=True)]
    cell = [F.floor((c * 0.5 + 0.5) * k) for c, k in zip(at, volume.voxels, strict=True)]
    grid = grid.withColumn("voxel", F.when(volume.valid(cell), volume.index(cell)))
    return grid.join(image, "voxel", "left").select("x", "y", F.coalesce("value", F.lit(0.0)).alias("value"))


def with_view(projections: DataFrame, view: DataFrame) -> DataFrame:
    """``projections`` with the lines of ``view`` in place of its own."""
    return projections.join(view.select("line"), "line", "left_anti").select("line", "value").unionByName(view.select("line", "value"))


def zipped(images: list[DataFrame], names: list[str]) -> DataFrame:
    """voxel and a column for each image, over the voxels of any; what is absent is 0."""
    rows = [x.select("voxel", F.lit(k).alias("k"), "value") for k, x in enumerate(images)]
    every = reduce(lambda a, b: a.unionByName(b), rows)
    return every.groupBy("voxel").agg(*[F.coalesce(F.sum(F.when(F.col("k") == k, F.col("value"))), F.lit(0.0)).alias(n) for k, n in enumerate(names)])


def phantom(spark: SparkSession, volume: Volume, kind: str = "modified", within: Volume | None = None, voxels: DataFrame | None = None) -> DataFrame:
    """(voxel, value) of every voxel of a 2-D or 3-D phantom that fills ``within``, by default the volume itself.

    ``voxels``: only those of its column ``voxel``, row by row.

    A voxel's lower corner decides. In three dimensions ellipsoids are turned about axis 1 and further angles don't count.
    """
    within = within or volume
    if kind not in ("modified", "original") or kind == "original" and volume.dim == 3:
        raise ValueError(f"no {kind} phantom in {volume.dim} dimensions")
    x = [2 * ((o + F.col(f"i{d}") / n * length - wo) / wl) - 1 for d, (o, n, length, wo, wl) in enumerate(zip(volume.origin, volume.voxels, volume.lengths, within.origin, within.lengths, strict=True))]
    rows = volume.grid(spark) if voxels is None else voxels.select("voxel", *V.named(volume.unroll(F.col("voxel")), "i"))
    rows = rows.select("voxel", *V.named(x, "x"))
    total = F.lit(0.0)
    if volume.dim == 2:
        for value, a, b, x0, y0, angle in MODIFIED if kind == "modified" else SHEPP_LOGAN:
            co, si = cos(angle * pi / 180), sin(angle * pi / 180)
            dx, dy = F.col("x0") - x0, F.col("x1") - y0
            r = (dx * co + dy * si) ** 2 / a**2 + (dy * co - dx * si) ** 2 / b**2
            total = total + F.when(r <= 1.0, float(value)).otherwise(0.0)
    else:
        for value, a, b, c, x0, y0, z0, angle, _, _ in MODIFIED_SPACE:
            co, si = cos(angle * pi / 180), sin(angle * pi / 180)
            dx, dy, dz = F.col("x0") - x0, F.col("x1") - y0, F.col("x2") - z0
            r = F.sqrt(((dx * co + dz * si) / a) ** 2 + (dy / b) ** 2 + ((dz * co - dx * si) / c) ** 2)
            total = total + F.when(r <= 1.0, float(value)).otherwise(0.0)
    return rows.select("voxel", total.alias("value"))
