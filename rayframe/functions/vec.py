"""Vectors as lists of columns, and what the engine computes with them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import EPSILON, Volume

Vec = list[Column]


def lit(xs) -> Vec:
    return [F.lit(float(x)) for x in xs]


def cols(name: str, dim: int) -> Vec:
    return [F.col(f"{name}{d}") for d in range(dim)]


def names(name: str, dim: int) -> list[str]:
    return [f"{name}{d}" for d in range(dim)]


def named(v: Vec, name: str) -> list[Column]:
    return [x.alias(f"{name}{d}") for d, x in enumerate(v)]


def computed(df: DataFrame, keys: list, expressions: list[Column]) -> DataFrame:
    """``keys`` and named expressions as columns that are computed once.

    Catalyst moves filters below projections by putting expressions in place of columns; chains of vector
    arithmetic would be repeated without end. It does not look into the rows a generator makes. The generator itself
    would compute what expressions share once for each; so a projection below it does, in compiled code, where shared parts count once.
    """
    return df.select(*keys, F.struct(*expressions).alias("_computed")).select(*keys, F.inline(F.array("_computed")))


def add(a: Vec, b: Vec) -> Vec:
    return [x + y for x, y in zip(a, b, strict=True)]


def sub(a: Vec, b: Vec) -> Vec:
    return [x - y for x, y in zip(a, b, strict=True)]


def scale(a: Vec, k) -> Vec:
    return [x * k for x in a]


def dot(a: Vec, b: Vec) -> Column:
    return reduce(lambda x, y: x + y, [x * y for x, y in zip(a, b, strict=True)])


def norm(a: Vec) -> Column:
    return F.sqrt(dot(a, a))


def distance(a: Vec, b: Vec) -> Column:
    return norm(sub(a, b))


def normalize(a: Vec) -> Vec:
    n = norm(a)
    return [x / n for x in a]


def cross(a: Vec, b: Vec) -> Vec:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def product(a: Vec) -> Column:
    return reduce(lambda x, y: x * y, a)


def standard_basis(dim: int, axis: int) -> list[float]:
    return [1.0 if d == axis else 0.0 for d in range(dim)]


def sign(x: Column) -> Column:
    """-1, 0 or 1; 0 within EPSILON of zero."""
    return F.when(F.abs(x) <= EPSILON, 0).when(x > 0, 1).otherwise(-1)


def round_half_away(x: Column) -> Column:
    return F.when(x < 0, -F.floor(-x + 0.5)).otherwise(F.floor(x + 0.5))


def truncated(x: Column) -> Column:
    """Towards zero, as a conversion to an integer."""
    return F.when(x < 0, F.ceil(x)).otherwise(F.floor(x)).cast("long")


def approx_equal(a: Column, b: Column, relative: float = 1e-2, absolute: float = EPSILON) -> Column:
    return (F.abs(a - b) <= absolute) | (F.abs(a - b) <= relative * F.abs(b))


def max_index(a: Vec) -> Column:
    """The first axis with the largest value; the true maximum also where nothing is positive."""
    out = F.lit(0)
    for d in range(1, len(a)):
        out = F.when(a[d] > reduce(F.greatest, a[:d]) if d > 1 else a[d] > a[0], d).otherwise(out)
    return out


def rotate_plane(v: Vec, angle: Column) -> Vec:
    c, s = F.cos(angle), F.sin(angle)
    return [v[0] * c - v[1] * s, v[0] * s + v[1] * c]


def rotate(v: Vec, axis: Vec, angle: Column) -> Vec:
    """About a unit axis, right-handed."""
    c, s = F.cos(angle), F.sin(angle)
    k, x = dot(axis, v), cross(axis, v)
    return [v[d] * c + x[d] * s + axis[d] * k * (1 - c) for d in range(3)]


def rotate_about(v: Vec, axis: int, angle: Column) -> Vec:
    """About a coordinate axis; in the plane for two dimensions."""
    if len(v) == 2:
        return rotate_plane(v, angle)
    a, b = (axis + 1) % 3, (axis + 2) % 3
    c, s = F.cos(angle), F.sin(angle)
    out = list(v)
    out[a], out[b] = v[a] * c - v[b] * s, v[a] * s + v[b] * c
    return out


def inside(a: Vec, volume: Volume) -> Column:
    """Strictly inside, by EPSILON, in voxel coordinates."""
    return reduce(lambda x, y: x & y, [(x >= EPSILON) & (x <= n - EPSILON) for x, n in zip(a, volume.voxels, strict=True)])


def inside_margin(a: Vec, volume: Volume, margin: float) -> Column:
    return reduce(lambda x, y: x & y, [(x >= -(margin + EPSILON)) & (x < n + margin + EPSILON) for x, n in zip(a, volume.voxels, strict=True)])


def to_voxel(x: Vec, volume: Volume) -> Vec:
    return [(a - o) / n * k for a, o, n, k in zip(x, volume.origin, volume.lengths, volume.voxels, strict=True)]


def slab(a: Vec, b: Vec, sides: Vec, origin: Vec) -> tuple[Column, Column, Column]:
    """(hit, t_in, t_out) of the line from ``a`` through ``b`` against a box.

    Clipped at ``a``, not at ``b``; an axis along which the ends are approximately equal is not divided by.
    """
    t_in, t_out, ok = F.lit(2.2250738585072014e-308), F.lit(1.7976931348623157e308), F.lit(True)
    for p, q, s, o in zip(a, b, sides, origin, strict=True):
        p, q = p - o, q - o
        flat = approx_equal(p, q)
        delta = F.when(flat, F.lit(1.0)).otherwise(q - p)
        t1, t2 = -p / delta, (s - p) / delta
        # Both skip nulls.
        t_in = F.greatest(t_in, F.when(~flat, F.least(t1, t2)))
        t_out = F.least(t_out, F.when(~flat, F.greatest(t1, t2)))
        ok = ok & (~flat | ((p >= -EPSILON) & (p < s + EPSILON)))
    return ok & (t_out > t_in), t_in, t_out


def clipped(df: DataFrame, keys: list[str], a: Vec, b: Vec, sides: Vec, origin: Vec) -> DataFrame:
    """The rows whose line meets the box, as ``slab`` has it: ``keys``, t_in and t_out, in two short steps."""
    d = range(len(a))
    ends = [(p - o, q - o, s) for p, q, s, o in zip(a, b, sides, origin, strict=True)]
    axes = []
    for k, (p, q, s) in enumerate(ends):
        flat = approx_equal(p, q)
        delta = F.when(flat, F.lit(1.0)).otherwise(q - p)
        axes += [flat.alias(f"_f{k}"), (-p / delta).alias(f"_x{k}"), ((s - p) / delta).alias(f"_y{k}"), ((p >= -EPSILON) & (p < s + EPSILON)).alias(f"_w{k}")]
    rows = computed(df, keys, axes)
    t_in = F.greatest(F.lit(2.2250738585072014e-308), *[F.when(~F.col(f"_f{k}"), F.least(f"_x{k}", f"_y{k}")) for k in d])
    t_out = F.least(F.lit(1.7976931348623157e308), *[F.when(~F.col(f"_f{k}"), F.greatest(f"_x{k}", f"_y{k}")) for k in d])
    ok = reduce(lambda x, y: x & y, [~F.col(f"_f{k}") | F.col(f"_w{k}") for k in d])
    return computed(rows, keys, [t_in.alias("t_in"), t_out.alias("t_out"), ok.alias("_ok")]).where("_ok AND t_out > t_in").drop("_ok")


def segment_intersection(p: Vec, p2: Vec, q: Vec, q2: Vec) -> Vec:
    """Where two plane segments meet, else nulls; only for a positive cross product of their directions."""
    r, s, d = sub(p2, p), sub(q2, q), sub(q, p)
    rs = r[0] * s[1] - r[1] * s[0]
    safe = F.when(rs > EPSILON, rs)
    t, u = (d[0] * s[1] - d[1] * s[0]) / safe, (d[0] * r[1] - d[1] * r[0]) / safe
    ok = (t >= 0) & (t <= 1) & (u >= 0) & (u <= 1)
    return [F.when(ok, x + t * y) for x, y in zip(p, r, strict=True)]


def line_intersection(p: Vec, r: Vec, q: Vec, s: Vec) -> Vec:
    """Where two plane lines (point, direction) meet; nulls if they are parallel."""
    rs = r[0] * s[1] - r[1] * s[0]
    d = sub(q, p)
    t = (d[0] * s[1] - d[1] * s[0]) / F.when(F.abs(rs) > EPSILON, rs)
    return [x + t * y for x, y in zip(p, r, strict=True)]


def box_intersection(p: Vec, p2: Vec, box: Vec) -> Vec:
    """The point nearest to ``p`` where a segment meets the edges of [0, box]; (-1, null) if none."""
    z = F.lit(0.0)
    edges = [([z, z], [z, box[1]]), ([z, box[1]], box), ([box[0], z], box), ([z, z], [box[0], z])]
    found = [segment_intersection(p, p2, a, b) for a, b in edges]
    usable = [F.when(x.isNotNull() & ((x != 0) | (y != 0)), F.struct(distance(p, [x, y]).alias("d"), x.alias("x"), y.alias("y"))) for x, y in found]
    best = F.array_min(F.filter(F.array(*usable), lambda s: s.isNotNull()))
    return [F.coalesce(best["x"], F.lit(-1.0)), best["y"]]


def box_hits(df: DataFrame, keys: list[str], p: Vec, p2: Vec, box: Vec) -> DataFrame:
    """``box_intersection`` of every row: ``keys``, x0 and x1, in short steps."""
    z = F.lit(0.0)
    edges = [([z, z], [z, box[1]]), ([z, box[1]], box), ([box[0], z], box), ([z, z], [box[0], z])]
    k = range(len(edges))
    rows = computed(df, keys, [*named(p, "_p"), *named(sub(p2, p), "_r")])
    p, r, own = cols("_p", 2), cols("_r", 2), [*keys, *names("_p", 2), *names("_r", 2)]
    at = []
    for i, (a, b) in enumerate(edges):
        s, d = sub(b, a), sub(a, p)
        rs = r[0] * s[1] - r[1] * s[0]
        safe = F.when(rs > EPSILON, rs)
        at += [((d[0] * s[1] - d[1] * s[0]) / safe).alias(f"_t{i}"), ((d[0] * r[1] - d[1] * r[0]) / safe).alias(f"_u{i}")]
    rows = computed(rows, own, at)
    met = [F.col(f"_t{i}").between(0, 1) & F.col(f"_u{i}").between(0, 1) for i in k]
    rows = computed(rows, own[:-2], [F.when(met[i], p[j] + F.col(f"_t{i}") * r[j]).alias(f"_{c}{i}") for i in k for j, c in enumerate("xy")])
    hits = [(F.col(f"_x{i}"), F.col(f"_y{i}")) for i in k]
    usable = [F.when(x.isNotNull() & ((x != 0) | (y != 0)), F.struct(distance(p, [x, y]).alias("d"), x.alias("x"), y.alias("y"))).alias(f"_e{i}") for i, (x, y) in enumerate(hits)]
    best = computed(computed(rows, keys, usable), keys, [F.least(*[f"_e{i}" for i in k]).alias("_best")])
    return best.select(*keys, F.coalesce("_best.x", F.lit(-1.0)).alias("x0"), F.col("_best.y").alias("x1"))


def plane_intersection(source: Vec, direction: Vec, point: Vec, normal: Vec) -> Vec:
    """Where a ray meets a plane; nulls where it runs along it."""
    k = dot(normal, direction)
    t = dot(sub(point, source), normal) / F.when(F.abs(k) >= 1e-3, k)
    return [s + t * d for s, d in zip(source, direction, strict=True)]


def detector_pixel(x: Vec, source: Vec, corner: Vec, a: Vec, b: Vec, parallel: Column, half: float = 0.5) -> Vec:
    """The pixel that a world point is projected to; ``a``, ``b`` are the steps between pixels.

    For parallel views the source moves with the pixel, so the direction is the corner less the source.
    """
    direction = [F.when(parallel, c - s).otherwise(w - s) for w, s, c in zip(x, source, corner, strict=True)]
    start = [F.when(parallel, w).otherwise(s) for w, s in zip(x, source, strict=True)]
    at = sub(plane_intersection(start, direction, corner, normalize(cross(a, b))), corner)
    return [truncated(dot(at, a) / dot(a, a) + half), truncated(dot(at, b) / dot(b, b) + half)]


#: Array columns: the reductions of vectors of any length.
def array_sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda x, y: x + y)


def array_product(a: Column) -> Column:
    return F.aggregate(a, F.lit(1.0), lambda x, y: x * y)


def array_dot(a: Column, b: Column) -> Column:
    return array_sum(F.zip_with(a, b, lambda x, y: x * y))


def array_norm(a: Column) -> Column:
    return F.sqrt(array_dot(a, a))


def array_box(a: Column, low, high) -> Column:
    return F.transform(a, lambda x: F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def is_power_of_two(x: Column) -> Column:
    return (x > 0) & (x.bitwiseAND(x - 1) == 0)


def hilbert(i: Column, order: int) -> Vec:
    """(x, y) of the i-th cell of the curve through a square of 2^order cells a side, from the lowest bits up."""
    start = F.struct(F.lit(0).cast("long").alias("x"), F.lit(0).cast("long").alias("y"))

    def step(at: Column, k: Column) -> Column:
        side = F.call_function("shiftleft", F.lit(1).cast("long"), k)
        pair = F.pmod(F.floor(i / F.pow(F.lit(4.0), k.cast("double"))), F.lit(4)).cast("long")
        right = pair >= 2
        up = (pair == 1) | (pair == 2)
        flip = ~up & right
        x = F.when(flip, side - 1 - at["x"]).otherwise(at["x"])
        y = F.when(flip, side - 1 - at["y"]).otherwise(at["y"])
        x, y = F.when(up, x).otherwise(y), F.when(up, y).otherwise(x)
        return F.struct((x + F.when(right, side).otherwise(0)).alias("x"), (y + F.when(up, side).otherwise(0)).alias("y"))

    end = F.aggregate(F.sequence(F.lit(0), F.lit(order - 1)), start, step)
    return [end["x"], end["y"]]
