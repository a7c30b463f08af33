"""Acquisition geometries as tables of views, and views as tables of rays.

A view has columns view, s0.. (source), c0.. (the detector's corner), a0.. and b0.. (steps from pixel to pixel along
its axes), n0, n1 (pixels along them), parallel. Builders take a table with ``view`` (and use further columns such as
``angle`` if given), so views may come from a file as well as from ``range``; everything is column arithmetic, so a
million views are built where their rows are.
"""

from __future__ import annotations

from math import pi

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import vec as V
from ..model import Volume


def view_range(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(n).select(F.col("id").cast("int").alias("view"))


def _views(base: DataFrame, source, corner, steps, shape, parallel: bool) -> DataFrame:
    dim = len(source)
    a = steps[0]
    b = steps[1] if dim == 3 else V.lit([0.0] * dim)
    n1 = F.lit(int(shape[1]) if dim == 3 else 1)
    rows = V.computed(base, ["view"], [*V.named(source, "s"), *V.named(corner, "c"), *V.named(a, "a"), *V.named(b, "b")])
    return rows.select("*", F.lit(int(shape[0])).alias("n0"), n1.alias("n1"), F.lit(parallel).alias("parallel"))


def _trajectory(base, source, detector, size, shape, tilt) -> DataFrame:
    """Source and detector centre by view; a detector of fixed size and shape."""
    corner, steps = detector, []
    for x, n, t in zip(size, shape, tilt, strict=True):
        corner = V.sub(corner, V.scale(t, 0.5 * x))
        steps.append(V.scale(t, x / n))
    return _views(base, source, corner, steps, shape, False)


def _angles(base: DataFrame, default: Column) -> Column:
    return F.col("angle") if "angle" in base.columns else default


def _around(center, x, axis: int, angle: Column):
    c = V.lit(center)
    return V.add(V.rotate_about(V.sub(x, c), axis, angle), c)


def _ends(volume: Volume, axis: int, near, far, source=None, detector=None):
    """Default source and detector on either side of the centre along an axis."""
    c = volume.center
    source = source or [x - (near if d == axis else 0.0) for d, x in enumerate(c)]
    detector = detector or [x + (far if d == axis else 0.0) for d, x in enumerate(c)]
    return V.lit(source), V.lit(detector)


def _parallel(base: DataFrame, volume: Volume, axis_of, angle: Column) -> DataFrame:
    dim, length = volume.dim, volume.lengths[0]
    if len(set(volume.voxels)) > 1:
        raise ValueError("parallel geometries need as many voxels along every axis")
    source, detector = _ends(volume, 0, 2 * length, 2 * length)
    shape = volume.voxels[: dim - 1]

    def turned(x):
        options = [V.rotate_about(x, a, angle) for a in axis_of[1]]
        return options[0] if len(options) == 1 else [F.when(axis_of[0], p).otherwise(q) for p, q in zip(*options, strict=True)]

    center = V.lit(volume.center)
    tilt = [turned(V.lit(V.standard_basis(dim, d + 1))) for d in range(dim - 1)]
    half = V.lit([0.0] * dim)
    for t, x in zip(tilt, volume.lengths[1:], strict=True):
        half = V.add(half, V.scale(t, 0.5 * x))
    source = V.sub(V.add(turned(V.sub(source, center)), center), half)
    corner = V.sub(V.add(turned(V.sub(detector, center)), center), half)
    steps = [V.scale(t, volume.lengths[d] / n) for d, (t, n) in enumerate(zip(tilt, shape, strict=True))]
    return _views(base, source, corner, steps, shape, True)


def parallel(base: DataFrame, volume: Volume, n: int) -> DataFrame:
    """n views over half a turn about the last axis."""
    return _parallel(base, volume, (None, [volume.dim - 1]), _angles(base, F.col("view") * F.lit(pi / n)))


def dual_axis_parallel(base: DataFrame, volume: Volume, n: int) -> DataFrame:
    """2n views: half a turn about the last axis but one, then about the last (from view n + 1 on)."""
    angle = _angles(base, F.pmod(F.col("view"), F.lit(n)) * F.lit(pi / n))
    return _parallel(base, volume, (F.col("view") > n, [volume.dim - 1, volume.dim - 2]), angle)


def fan_beam(base: DataFrame, volume: Volume, n: int, size: float, shape: int, source_distance: float, detector_distance: float) -> DataFrame:
    """Two dimensions, one turn."""
    angle = _angles(base, F.col("view") * F.lit(2 * pi / n))
    s, d = _ends(volume, 0, source_distance, detector_distance)
    return _trajectory(base, _around(volume.center, s, 0, angle), _around(volume.center, d, 0, angle), [size], [shape], [V.rotate_plane(V.lit([0.0, 1.0]), angle)])


def cone_beam(base: DataFrame, volume: Volume, n: int, size, shape, source_distance: float = 1.0, detector_distance: float = 1.0, source=None, detector=None, tilt=((0, 1, 0), (0, 0, 1))) -> DataFrame:
    """One turn about the last axis."""
    angle = _angles(base, F.col("view") * F.lit(2 * pi / n))
    s, d = _ends(volume, 0, source_distance, detector_distance, source, detector)
    return _trajectory(base, _around(volume.center, s, 2, angle), _around(volume.center, d, 2, angle), size, shape, [V.rotate_about(V.lit(t), 2, angle) for t in tilt])


def helical_cone_beam(base: DataFrame, volume: Volume, n: int, size, shape, rotations: float, source_distance: float = 1.0, detector_distance: float = 1.0, source=None, detector=None, tilt=((0, 1, 0), (0, 0, 1))) -> DataFrame:
    """Turns about the last axis while source and detector move along it over the volume's length."""
    if n < 2:
        raise ValueError("a helix needs two views or more")
    angle = _angles(base, F.col("view") * F.lit(2 * pi * rotations / (n - 1)))
    rise = [F.lit(0.0), F.lit(0.0), (F.col("view") / F.lit(n - 1) - 0.5) * volume.lengths[2]]
    s, d = _ends(volume, 0, source_distance, detector_distance, source, detector)
    s, d = (V.add(_around(volume.center, x, 2, angle), rise) for x in (s, d))
    return _trajectory(base, s, d, size, shape, [V.rotate_about(V.lit(t), 2, angle) for t in tilt])


def dynamic_cone_beam(base: DataFrame, volume: Volume, n: int, size, shape) -> DataFrame:
    """One turn about axis 1 at a distance that changes; the centre is half the lengths, whatever the origin."""
    angle = _angles(base, F.col("view") * F.lit(2 * pi / n))
    far = (F.lit(2.0) - F.lit(0.5) * F.cos(F.col("view") * F.lit(pi / n))) * volume.lengths[0]
    center = [0.5 * x for x in volume.lengths]
    s = _around(center, [F.lit(center[0]) - far, *V.lit(center[1:])], 1, angle)
    d = _around(center, [F.lit(center[0]) + far, *V.lit(center[1:])], 1, angle)
    return _trajectory(base, s, d, size, shape, [V.rotate_about(V.lit(V.standard_basis(3, k)), 1, angle) for k in (1, 2)])


def laminography(base: DataFrame, volume: Volume, n: int, size, shape, source_distance: float = 1.0, detector_distance: float = 1.0, source_radius: float = 1.0, detector_radius: float = 1.0, source=None, detector=None) -> DataFrame:
    """Source and detector on opposite circles above and below; the detector faces the source."""
    angle = _angles(base, F.col("view") * F.lit(2 * pi / n))
    s0, d0 = _ends(volume, 2, -source_distance, -detector_distance, source, detector)
    s = V.add(s0, V.rotate_about(V.lit([source_radius, 0, 0]), 2, angle))
    d = V.add(d0, V.rotate_about(V.lit([-detector_radius, 0, 0]), 2, angle))
    rows = V.computed(base, ["view"], [*V.named(s, "s"), *V.named(d, "m")])
    s, d = V.cols("s", 3), V.cols("m", 3)
    rows = V.computed(rows, ["view", *s, *d], V.named(V.cross(V.lit([0, 0, 1]), V.normalize(V.sub(d, s))), "t"))
    turn = V.cols("t", 3)
    rows = V.computed(rows, ["view", *s, *d, *turn], [V.norm(turn).alias("size")])
    size_of = F.col("size")
    # No turn is needed, nor an axis known, where the detector lies straight below.
    axis = [F.when(size_of > 1e-12, x / F.when(size_of > 1e-12, size_of)).otherwise(float(k == 0)) for k, x in enumerate(turn)]
    rows = V.computed(rows, ["view", *s, *d], [*V.named(axis, "k"), (-F.asin(F.least(size_of, F.lit(1.0)))).alias("theta")])
    tilt = [V.rotate(V.lit(V.standard_basis(3, k)), V.cols("k", 3), F.col("theta")) for k in (0, 1)]
    rows = V.computed(rows, ["view", *s, *d], [*V.named(tilt[0], "u"), *V.named(tilt[1], "v")])
    return _trajectory(rows, s, d, size, shape, [V.cols("u", 3), V.cols("v", 3)])


def tomosynthesis(base: DataFrame, volume: Volume, n: int, size, shape, source_distance: float = 1.0, detector_distance: float = 1.0, arc: float = 0.5 * pi, source=None, detector=None) -> DataFrame:
    """A fixed detector; the source swings about axis 0."""
    angle = _angles(base, F.col("view") * F.lit(arc / (n - 1)) - F.lit(0.5 * arc))
    s, d = _ends(volume, 2, -source_distance, -detector_distance, source, detector)
    return _trajectory(base, _around(volume.center, s, 0, angle), d, size, shape, [V.lit([1, 0, 0]), V.lit([0, 1, 0])])


def custom(views: DataFrame) -> DataFrame:
    """Views given one by one: source, detector (its centre), det_size, tilt, det_shape, parallel as arrays."""
    dim = 3
    take = lambda c, k: F.col(c)[k]
    tilt = [[F.col("tilt")[d][k] for k in range(dim)] for d in range(2)]
    size, shape = [take("det_size", d) for d in range(2)], [take("det_shape", d) for d in range(2)]
    corner = [take("detector", k) - 0.5 * (size[0] * tilt[0][k] + size[1] * tilt[1][k]) for k in range(dim)]
    steps = [[size[d] / shape[d] * tilt[d][k] for k in range(dim)] for d in range(2)]
    return views.select("view", *V.named([take("source", k) for k in range(dim)], "s"), *V.named(corner, "c"), *V.named(steps[0], "a"), *V.named(steps[1], "b"), shape[0].alias("n0"), shape[1].alias("n1"), "parallel")


def offsets(views: DataFrame) -> DataFrame:
    """view, first: lines before each view. Views are few next to rays, so one ordered window is enough."""
    n = F.col("n0").cast("long") * F.col("n1")
    before = F.sum(n).over(Window.orderBy("view").rowsBetween(Window.unboundedPreceding, -1))
    return views.select("view", F.coalesce(before, F.lit(0)).cast("long").alias("first"))


def pixel_ray(i: Column, j: Column, dim: int) -> tuple[list[Column], list[Column]]:
    """(source, detector point) of the ray through the middle of pixel (i, j), from a view's columns."""
    at = [c + (i + 0.5) * a for c, a in zip(V.cols("c", dim), V.cols("a", dim), strict=True)]
    if dim == 3:
        at = [x + (j + 0.5) * b for x, b in zip(at, V.cols("b", dim), strict=True)]
    return [F.when(F.col("parallel"), s + p - c).otherwise(s) for s, p, c in zip(V.cols("s", dim), at, V.cols("c", dim), strict=True)], at


def rays(views: DataFrame, dim: int, uniform: bool = True) -> DataFrame:
    """line, view, p0, p1 (pixel), s0.. (source), d0.. (detector point) of every pixel of every view.

    ``uniform``: all views have as many pixels, so that line numbers need no running sum.
    """
    per = F.col("n0").cast("long") * F.col("n1")
    if uniform:
        numbered = views.withColumn("first", F.col("view") * per)
    else:
        numbered = views.join(offsets(views), "view")
    pixels = numbered.filter(per > 0).withColumn("q", F.explode(F.sequence(F.lit(0).cast("long"), per - 1)))
    i, j = F.pmod(F.col("q"), F.col("n0")), F.floor(F.col("q") / F.col("n0"))
    source, at = pixel_ray(i, j, dim)
    return V.computed(pixels, ["view"], [(F.col("first") + F.col("q")).alias("line"), i.cast("long").alias("p0"), j.cast("long").alias("p1"), *V.named(source, "s"), *V.named(at, "d")])


#: Modulus of the draws, a prime, so that products stay within long.
PRIME = 2147483647


def draw(row: Column, k: int, seed: int) -> Column:
    """A number between 0 and 1 from a row's number: the same wherever and however often the row is made."""
    x = F.pmod(row, F.lit(PRIME))
    for r in range(4):
        x = (x * x + x * 48271 + (seed * 7919 + k * 104729 + r * 1299709 + 12345) % PRIME) % PRIME
    return (x + 0.5) / float(PRIME)


def random_rays(spark: SparkSession, volume: Volume, n: int, seed: int = 0, lines: DataFrame | None = None) -> DataFrame:
    """Rays that start at random places of the boundary and point inwards: ``n`` of them, or one for each of ``lines``."""
    dim = volume.dim
    row = F.col("line")
    numbers = spark.range(n).withColumnRenamed("id", "line") if lines is None else lines.select("line")
    rows = V.computed(numbers, ["line"], [draw(row, k, seed).alias(f"r{k}") for k in range(1 + 3 * dim)])
    rows = V.computed(rows, ["line", *[f"r{k}" for k in range(1, 1 + 3 * dim)]], [F.floor(F.col("r0") * (2 * dim)).cast("int").alias("face")])
    # Two uniform numbers make a normal one; its direction does not depend on the axes.
    g = [F.sqrt(-2 * F.ln(F.col(f"r{1 + dim + d}"))) * F.cos(F.col(f"r{1 + 2 * dim + d}") * (2 * pi)) for d in range(dim)]
    start, way = [], []
    for d, (o, x) in enumerate(zip(volume.origin, volume.lengths, strict=True)):
        start.append(o + x * F.when(F.col("face") == 2 * d, 0.0).when(F.col("face") == 2 * d + 1, 1.0).otherwise(F.col(f"r{1 + d}")))
        way.append(F.when(F.col("face") == 2 * d, F.abs(g[d])).when(F.col("face") == 2 * d + 1, -F.abs(g[d])).otherwise(g[d]))
    rows = V.computed(rows, ["line"], [*V.named(start, "s"), *V.named(way, "w")])
    return rows.select("line", F.col("line").cast("int").alias("view"), F.lit(0).cast("long").alias("p0"), F.lit(0).cast("long").alias("p1"), *V.cols("s", dim), *[(F.col(f"s{d}") + F.col(f"w{d}")).alias(f"d{d}") for d in range(dim)])


def rescaled(views: DataFrame, factor: int) -> DataFrame:
    """Every factor-th view with detectors of factor times fewer, larger pixels."""
    kept = views.filter(F.pmod(F.col("view"), F.lit(factor)) == 0).withColumn("view", F.floor(F.col("view") / factor).cast("int"))
    for axis, n in (("a", "n0"), ("b", "n1")):
        new = F.greatest(F.lit(1), F.floor(F.col(n) / factor).cast("int"))
        for c in [x for x in kept.columns if x[0] == axis and x[1:].isdigit()]:
            kept = kept.withColumn(c, F.col(c) * F.col(n) / new)
        kept = kept.withColumn(n, new)
    return kept
