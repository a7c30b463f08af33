"""Kernels: from rays to matrix elements (line, voxel, value).

Rays that miss the volume are filtered out before any is expanded; the samples of a ray are an interval of whole
steps that is known in closed form, so that ``explode(sequence(...))`` makes hardly more rows than are kept. The
same voxel may come more than once for a line; those rows are kept, as norms depend on them.
"""

from __future__ import annotations

from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import EPSILON, Volume
from . import vec as V


def truncated(rays: DataFrame, volume: Volume) -> DataFrame:
    """Rays that hit the volume, with o0.. (first whole step inside) and u0.. (unit direction) in voxel coordinates."""
    dim = volume.dim
    s, d = V.cols("s", dim), V.cols("d", dim)
    hits = V.clipped(rays, ["line", *V.names("s", dim), *V.names("d", dim)], s, d, V.lit(volume.lengths), V.lit(volume.origin))
    entry = [a + (b - a) * F.col("t_in") for a, b in zip(s, d, strict=True)]
    vs, vd, ve = (V.to_voxel(x, volume) for x in (s, d, entry))
    hits = V.computed(hits, ["line"], [*V.named(vs, "v"), *V.named(ve, "e"), *V.named(V.sub(vd, vs), "w")])
    v, e, w = (V.cols(x, dim) for x in "vew")
    hits = V.computed(hits, ["line", *v], [*V.named(V.normalize(w), "u"), (F.floor(V.distance(v, e)) + 1).alias("steps")])
    u = V.cols("u", dim)
    return V.computed(hits, ["line", *u], [(a + F.col("steps") * b).alias(f"o{k}") for k, (a, b) in enumerate(zip(v, u, strict=True))])


def _interval(o: V.Vec, u: V.Vec, volume: Volume, margin: float) -> tuple[Column, Column]:
    """Bounds of the steps k for which o + k u may lie within a margin of the volume.

    ``o`` is within a step of the volume's border or margin, and u a step of one voxel or more along the ray, so the
    sum of all sides, and as much to spare, is beyond any step that counts.
    """
    far = 4.0 * sum(volume.voxels) + 16
    low, high = F.lit(-far), F.lit(far)
    for x, d, n in zip(o, u, volume.voxels, strict=True):
        safe = F.when(F.abs(d) > 1e-12, d)
        t1, t2 = (-margin - x) / safe, (n + margin - x) / safe
        low = F.greatest(low, F.coalesce(F.least(t1, t2), F.lit(-far)))
        high = F.least(high, F.coalesce(F.greatest(t1, t2), F.lit(far)))
    return (F.floor(low) - 1).cast("long"), (F.ceil(high) + 1).cast("long")


def _at(o: V.Vec, u: V.Vec, k) -> V.Vec:
    return [x + k * d for x, d in zip(o, u, strict=True)]


def closest(rays: DataFrame, volume: Volume) -> DataFrame:
    """One element of value 1 for each sample, half a step on, that lies inside."""
    dim = volume.dim
    o, u = V.cols("o", dim), V.cols("u", dim)
    start = truncated(rays, volume).filter(V.inside(_at(o, u, F.lit(0.5)), volume))
    _, last = _interval(o, u, volume, 0.0)
    steps = V.computed(start, ["line", *o, *u], [F.greatest(last, F.lit(0)).alias("last")])
    samples = steps.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last")))).select("line", *V.named(_at(o, u, F.col("k") + 0.5), "x"))
    x = V.cols("x", dim)
    return samples.filter(V.inside(x, volume)).select("line", volume.index([F.floor(c) for c in x]).alias("voxel"), F.lit(1.0).alias("value"))


def _marched(rays: DataFrame, volume: Volume, o: V.Vec, u: V.Vec) -> DataFrame:
    """line, further columns, x0..: all samples within one voxel of the volume, if the first or the one before is."""
    first, last = _interval(o, u, volume, 1.0)
    near = V.inside_margin(_at(o, u, F.lit(0.0)), volume, 1.0) | V.inside_margin(_at(o, u, F.lit(-1.0)), volume, 1.0)
    rows = V.computed(rays.filter(near), rays.columns, [first.alias("first"), last.alias("last")])
    rows = rows.withColumn("k", F.explode(F.sequence(F.col("first"), F.greatest("first", "last"))))
    rows = V.computed(rows, rays.columns, V.named(_at(o, u, F.col("k")), "x"))
    return rows.filter(V.inside_margin(V.cols("x", volume.dim), volume, 1.0))


def _corners(x: V.Vec, sizes: list) -> Column:
    """Array of (cells, weight) of the up to 2^n cells around a point, those outside left out (nulls)."""
    base = [V.round_half_away(c) for c in x]
    out = []
    for shift in product((1, 0), repeat=len(x)):
        cell = [b - s for b, s in zip(base, shift, strict=True)]
        ok = reduce(lambda a, b: a & b, [(c >= 0) & (c < n) for c, n in zip(cell, sizes, strict=True)])
        weight = V.product([1 - F.abs(p - (c + 0.5)) for p, c in zip(x, cell, strict=True)])
        out.append(F.when(ok, F.struct(*[c.cast("long").alias(f"i{d}") for d, c in enumerate(cell)], weight.alias("value"))))
    return F.array(*out)


def interpolate(points: DataFrame, volume: Volume, keys: list[str]) -> DataFrame:
    """keys, voxel, value of the voxels around the points x0.. (voxel coordinates)."""
    dim = volume.dim
    rows = points.withColumn("e", F.explode(_corners(V.cols("x", dim), volume.voxels))).filter("e IS NOT NULL")
    return rows.select(*keys, volume.index([F.col(f"e.i{d}") for d in range(dim)]).alias("voxel"), F.col("e.value").alias("value"))


def linear(rays: DataFrame, volume: Volume) -> DataFrame:
    """Samples at whole steps, each spread over the 2^D voxels around it."""
    dim = volume.dim
    return interpolate(_marched(truncated(rays, volume), volume, V.cols("o", dim), V.cols("u", dim)), volume, ["line"])


def joseph(rays: DataFrame, volume: Volume) -> DataFrame:
    """One sample in each slice across the ray's main axis, spread over the 2^(D-1) voxels around it in the slice."""
    dim = volume.dim
    o, u = V.cols("o", dim), V.cols("u", dim)
    axis = V.max_index([F.abs(x) for x in u])
    pick = lambda xs: reduce(lambda r, d: F.when(F.col("axis") == d, xs[d]).otherwise(r), range(1, dim), xs[0])
    rows = V.computed(truncated(rays, volume), ["line", *o, *u], [axis.alias("axis")])
    rows = V.computed(rows, ["line", "axis", *o, *u], [pick(o).alias("om"), pick(u).alias("um")])
    shift = (V.round_half_away(F.col("om") - 0.5) + 0.5 - F.col("om")) * F.signum("um")
    rows = V.computed(rows, ["line", "axis", *o], [*[(x / F.abs("um")).alias(f"h{d}") for d, x in enumerate(u)], shift.alias("shift")])
    start = [x + F.col("shift") * h for x, h in zip(o, V.cols("h", dim), strict=True)]
    rows = V.computed(rows, ["line", "axis", *V.cols("h", dim)], V.named(start, "g"))
    rows = _marched(rows, volume, V.cols("g", dim), V.cols("h", dim))
    x, n = V.cols("x", dim), [F.lit(k) for k in volume.voxels]
    rows = V.computed(rows, ["line", "axis", *x], [V.round_half_away(pick(x) - 0.5).cast("long").alias("row")]).filter((F.col("row") >= 0) & (F.col("row") < pick(n)))
    # The axes that are left, in order.
    others = [[d for d in range(dim) if d != a] for a in range(dim)]
    left = [pick([x[others[a][k]] for a in range(dim)]) for k in range(dim - 1)]
    sizes = [pick([n[others[a][k]] for a in range(dim)]) for k in range(dim - 1)]
    rows = V.computed(rows, ["line", "axis", "row"], [*V.named(left, "y"), *V.named(sizes, "m")])
    rows = rows.withColumn("e", F.explode(_corners(V.cols("y", dim - 1), V.cols("m", dim - 1)))).filter("e IS NOT NULL")
    cell = [pick([F.col("row") if a == d else F.col(f"e.i{others[a].index(d)}") for a in range(dim)]) for d in range(dim)]
    return rows.select("line", volume.index(cell).alias("voxel"), F.col("e.value").alias("value"))


def joseph_value(o: V.Vec, u: V.Vec, cell: V.Vec) -> Column:
    """The weight of one voxel for a line (origin, direction in voxel coordinates), by its slice alone."""
    dim = len(o)
    axis = V.max_index([F.abs(x) for x in u])
    out = F.lit(None).cast("double")
    for a in range(dim):
        t = (cell[a] + 0.5 - o[a]) / F.when(F.abs(u[a]) > 1e-12, u[a])
        w = V.product([F.greatest(F.lit(0.0), 1 - F.abs(o[d] + t * u[d] - (cell[d] + 0.5))) for d in range(dim) if d != a])
        out = F.when(axis == a, w).otherwise(out)
    return out


def _crossing(a: Column, length: Column):
    return lambda k: (k - a) / length


def exact(rays: DataFrame, volume: Volume) -> DataFrame:
    """Lengths of a ray within each voxel, by its sorted crossings with the planes between voxels."""
    dim = volume.dim
    s, d = V.cols("s", dim), V.cols("d", dim)
    hits = V.clipped(rays, ["line", *V.names("s", dim), *V.names("d", dim)], s, d, V.lit(volume.lengths), V.lit(volume.origin))
    rows = V.computed(hits, ["line", "t_in", "t_out"], [*V.named(V.to_voxel(s, volume), "v"), *V.named(V.to_voxel(d, volume), "w"), V.distance(s, d).alias("length")])
    v, w = V.cols("v", dim), V.cols("w", dim)
    crossings = [F.array(F.col("t_in"), F.col("t_out"))]
    for a, b, n in zip(v, w, volume.voxels, strict=True):
        safe = F.when(F.abs(b - a) > 1e-12, b - a)
        ends = [a + (b - a) * F.col("t_in"), a + (b - a) * F.col("t_out")]
        low, high = F.greatest(F.lit(0), F.ceil(F.least(*ends))).cast("long"), F.least(F.lit(n), F.floor(F.greatest(*ends))).cast("long")
        planes = F.when(safe.isNotNull() & (low <= high), F.sequence(low, F.greatest(low, high)))
        crossings.append(F.coalesce(F.transform(planes, _crossing(a, safe)), F.array().cast("array<double>")))
    sorted_t = F.array_sort(F.filter(F.flatten(F.array(*crossings)), lambda t: (t >= F.col("t_in")) & (t <= F.col("t_out"))))
    rows = V.computed(rows, ["line", "length", *v, *w], [sorted_t.alias("t")])
    pairs = F.arrays_zip(F.slice("t", F.lit(1), F.size("t") - 1).alias("a"), F.slice("t", F.lit(2), F.size("t") - 1).alias("b"))
    rows = rows.withColumn("e", F.explode(pairs)).filter(F.col("e.b") - F.col("e.a") > 1e-12)
    middle = (F.col("e.a") + F.col("e.b")) / 2
    at = [F.floor(a + (b - a) * middle) for a, b in zip(v, w, strict=True)]
    out = V.computed(rows, ["line"], [*V.named(at, "i"), ((F.col("e.b") - F.col("e.a")) * F.col("length")).alias("value")])
    i = V.cols("i", dim)
    return out.filter(volume.valid(i)).select("line", volume.index(i).alias("voxel"), "value")


KERNELS = {"closest": closest, "linear": linear, "joseph": joseph, "exact": exact}
__all__ = ["EPSILON", "KERNELS", "closest", "exact", "interpolate", "joseph", "joseph_value", "linear", "truncated"]
