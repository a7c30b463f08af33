"""Continuous recursive bisection: cuts where the shadows of both halves overlap least on the detectors.

Boxes are pairs (low, high) of corners. Views are rows; hulls and their intersections are convex polygons, computed by
array functions. A level of the tree costs the same few jobs over the views, whatever the number of its nodes: overlaps of
all of its cuts are one job, and a search for cuts goes through all nodes and axes at once, three halvings a job. Samples
are drawn by hash of their number: the same seed gives the same partitioning, also when a task is run again.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import polygon
from ..functions import vec as V
from ..model import Volume
from ..storage import keep
from .trees import Tree

Cube = tuple[tuple[float, ...], tuple[float, ...]]
#: Samples by precision, for an integral and for the simple splitter.
SAMPLES = {"low": 100, "medium": 1000, "high": 10_000}
SPLIT_SAMPLES = {"low": 100_000, "medium": 1_000_000, "high": 10_000_000}


def cross_section_area(v: Cube, axis: int) -> float:
    return float(np.prod([v[1][d] - v[0][d] for d in range(3) if d != axis]))


def split_at(v: Cube, c: float, axis: int) -> tuple[Cube, Cube]:
    high, low = list(v[1]), list(v[0])
    high[axis] = low[axis] = c
    return (v[0], tuple(high)), (tuple(low), v[1])


VIEW_COLUMNS = [f"{x}{d}" for x in "scab" for d in range(3)] + ["n0", "n1"]


def _boxes(of: list[Cube]) -> Column:
    """(k, l0, h0, ..) of each box, as an array for explode; there are a few for each node of a level."""
    return F.array(*[F.struct(F.lit(k).alias("k"), *[F.lit(float(v[i][d])).alias(f"{n}{d}") for d in range(3) for i, n in enumerate("lh")]) for k, v in enumerate(of)])


def _corners(prefix: str) -> Column:
    """A box's corners on the detector, from its centre; null where a ray runs along the detector.

    Reads a box's columns (``prefix``l0, h0, ..) and what ``_framed`` has put beside a view's.
    """

    def at(k: int) -> Column:
        x = [F.col(f"{prefix}{'h' if k >> d & 1 else 'l'}{d}") for d in range(3)]
        way = [p - F.col(f"s{d}") for d, p in enumerate(x)]
        along = V.dot(way, V.cols("w", 3))
        t = F.col("reach") / F.when(F.abs(along) >= 1e-3, along)
        hit = [F.col(f"s{d}") + q * t - F.col(f"m{d}") for d, q in enumerate(way)]
        x, y = V.dot(hit, V.cols("u", 3)), V.dot(hit, V.cols("v", 3))
        return F.when(x.isNotNull() & y.isNotNull(), polygon.point(x, y))

    return F.array(*[at(k) for k in range(8)])


def _shadow(corners: str) -> Column:
    return F.when(~F.exists(corners, lambda p: p.isNull()), polygon.hull(F.col(corners)))


def _framed(views: DataFrame) -> DataFrame:
    """Views with their detector's unit axes u and v, normal w, centre m, distance from the source, and half sizes."""
    s, c, a, b = (V.cols(x, 3) for x in "scab")
    keep_ = ["view", *V.names("s", 3)]
    middle = [p + 0.5 * (F.col("n0") * q + F.col("n1") * r) for p, q, r in zip(c, a, b, strict=True)]
    half = [0.5 * F.col(n) * V.norm(e) for n, e in (("n0", a), ("n1", b))]
    rows = V.computed(views, [*keep_, *V.names("c", 3)], [*V.named(V.normalize(a), "u"), *V.named(V.normalize(b), "v"), *V.named(middle, "m"), half[0].alias("half0"), half[1].alias("half1")])
    own = [*keep_, *V.names("u", 3), *V.names("v", 3), *V.names("m", 3), "half0", "half1"]
    rows = V.computed(rows, [*own, *V.names("c", 3)], V.named(V.cross(V.cols("u", 3), V.cols("v", 3)), "w"))
    return V.computed(rows, [*own, *V.names("w", 3)], [V.dot(V.sub(c, s), V.cols("w", 3)).alias("reach")])


def outlines(views: DataFrame, of: list[Cube]) -> DataFrame:
    """(view, k, outline): the shadow of each box on each detector, null where a ray runs along it."""
    rows = V.computed(_framed(views).select("*", F.inline(_boxes(of))), ["view", "k"], [_corners("").alias("corners")])
    return V.computed(rows, ["view", "k"], [_shadow("corners").alias("outline")])


def overlap_areas(views: DataFrame, pairs: list[tuple[Cube, Cube]]) -> DataFrame:
    """(view, k, area): the detector's area that lies in the shadows of both boxes of pair k, 0 where one has none.

    Views are short rows that cost much work, so a table of them is dealt to all cores first, however few its files are.
    """
    return _areas(views.repartition(views.sparkSession.sparkContext.defaultParallelism), pairs)


def _areas(views: DataFrame, pairs: list[tuple[Cube, Cube]]) -> DataFrame:
    both = F.array(*[F.struct(F.lit(k).alias("k"), *[F.lit(float(p[j][i][d])).alias(f"{x}{n}{d}") for j, x in enumerate("xy") for d in range(3) for i, n in enumerate("lh")]) for k, p in enumerate(pairs)])
    rows = _framed(views).select("*", F.inline(both))
    x, y = F.col("half0"), F.col("half1")
    screen = F.array(polygon.point(-x, -y), polygon.point(x, -y), polygon.point(x, y), polygon.point(-x, y))
    # Step by step: an array function's lambda would compute an argument that is no column again and again.
    rows = V.computed(rows, ["view", "k"], [_corners("x").alias("x"), _corners("y").alias("y"), screen.alias("screen")])
    rows = V.computed(rows, ["view", "k", "screen"], [_shadow("x").alias("left"), _shadow("y").alias("right")])
    rows = V.computed(rows, ["view", "k", "screen"], [polygon.clipped(F.col("left"), F.col("right")).alias("both")])
    rows = V.computed(rows, ["view", "k"], [polygon.clipped(F.col("both"), F.col("screen")).alias("both")])
    return rows.select("view", "k", F.coalesce(polygon.area(F.col("both")), F.lit(0.0)).alias("area"))


def overlaps(views: DataFrame, pairs: list[tuple[Cube, Cube]]) -> list[float]:
    """The overlaps of pairs of boxes, each summed over all views."""
    out = [0.0] * len(pairs)
    for k, x in _areas(views, pairs).groupBy("k").agg(F.sum("area")).collect():
        out[k] = x
    return out


def shadow_areas(views: DataFrame, of: list[Cube]) -> list[float]:
    """The areas of the shadows of boxes, each summed over all views."""
    return overlaps(views, [(v, v) for v in of])


def _uniform(seed: int) -> list[Column]:
    """Three numbers between 0 and 1 by hash of ``id``."""
    return [(F.pmod(F.xxhash64("id", F.lit(seed), F.lit(d)), F.lit(1 << 40)) + 0.5) / float(1 << 40) for d in range(3)]


def points(spark: SparkSession, v: Cube, n: int, seed: int) -> DataFrame:
    """x0, x1, x2 of n uniform points of a box."""
    u = _uniform(seed)
    return spark.range(n).select("id", *[(v[0][d] + (v[1][d] - v[0][d]) * u[d]).alias(f"x{d}") for d in range(3)])


def seen(view_points: DataFrame) -> Column:
    """Whether a point (x0..) is projected into the detector of a view's row."""
    s, c, a, b, x = (V.cols(k, 3) for k in ("s", "c", "a", "b", "x"))
    at = V.sub(V.plane_intersection(s, V.sub(x, s), c, V.cross(V.normalize(a), V.normalize(b))), c)
    inside = [(V.dot(at, e) >= 0) & (V.dot(at, e) <= F.col(n) * V.dot(e, e)) for e, n in ((a, "n0"), (b, "n1"))]
    return F.coalesce(inside[0] & inside[1], F.lit(False))


def weighted(samples: DataFrame, views: DataFrame, cone: bool) -> DataFrame:
    """samples with ``f``, the sum of 1 / r^2 over sources, for ``cone`` only those that see the point.

    Views are far fewer than samples and are bounded by the acquisition; Spark broadcasts them by their size.
    """
    rows = samples.join(views.select(*VIEW_COLUMNS), F.lit(True), "inner")
    d = V.sub(V.cols("x", 3), V.cols("s", 3))
    value = 1 / V.dot(d, d)
    if cone:
        value = F.when(seen(rows), value).otherwise(0.0)
    return rows.withColumn("v", value).groupBy("id", "x0", "x1", "x2").agg(F.sum("v").alias("f"))


def loads(views: DataFrame, of: list[Cube], precision: str = "low", method: str = "two_dim", seed: int = 0) -> list[float]:
    """The integral of the ray density over each box: analytic along axis 2, or 1 / r^2, or that within the cones.

    A view makes its own share of every sample, so that nothing is joined and sums are all that moves; all boxes are one job.
    """
    n = SAMPLES[precision]
    rows = views.select(*VIEW_COLUMNS, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias("id"))
    rows = V.computed(rows, VIEW_COLUMNS, [x.alias(f"r{d}") for d, x in enumerate(_uniform(seed))])
    rows = rows.select("*", F.inline(_boxes(of)))
    rows = V.computed(rows, [*VIEW_COLUMNS, "k", "l2", "h2"], [(F.col(f"l{d}") + (F.col(f"h{d}") - F.col(f"l{d}")) * F.col(f"r{d}")).alias(f"x{d}") for d in range(3)])
    if method == "two_dim":
        r = V.distance([F.col("x0"), F.col("x1")], [F.col("s0"), F.col("s1")])
        value = (F.atan2(F.col("h2") - F.col("s2"), r) - F.atan2(F.col("l2") - F.col("s2"), r)) / r
        size = [cross_section_area(v, 2) for v in of]
    else:
        d = V.sub(V.cols("x", 3), V.cols("s", 3))
        value = 1 / V.dot(d, d)
        value = F.when(seen(rows), value).otherwise(0.0) if method == "cone" else value
        size = [float(np.prod(np.subtract(v[1], v[0]))) for v in of]
    out = [0.0] * len(of)
    for k, x in rows.groupBy("k").agg(F.sum(value)).collect():
        out[k] = size[k] * x / n
    return out


def load(views: DataFrame, v: Cube, precision: str = "low", method: str = "two_dim", seed: int = 0) -> float:
    return loads(views, [v], precision, method, seed)[0]


def split_midway(views: DataFrame, v: Cube, axis: int) -> float:
    return 0.5 * (v[0][axis] + v[1][axis])


#: (box, axis): a key of the search.
Key = tuple[Cube, int]
#: Halvings whose possible cuts are looked at in one job.
AHEAD = 3


def search(keys: list[Key], steps: int, tolerance: Callable[[Cube, int], float], weigh: Callable[[list[Cube]], list[float]]) -> list[float]:
    """For each key, where a halving search finds equal weights of both sides.

    ``weigh`` gives the weights of many boxes at once. All keys go on together: each job weighs the 2^``AHEAD`` - 1 cuts that
    the next halvings may come to, for every key that is not done, so the number of jobs does not depend on that of keys.
    """
    at = [[v[0][d], v[1][d]] for v, d in keys]
    left, taken = list(range(len(keys))), 0
    while left and taken < steps:
        ahead = min(AHEAD, steps - taken)
        cuts: dict[tuple[int, int], float] = {}
        ends = {i: [(at[i][0], at[i][1])] for i in left}
        for depth in range(ahead):
            for i in left:
                below = []
                for j, (low, high) in enumerate(ends[i]):
                    c = 0.5 * (low + high)
                    cuts[i, (1 << depth) - 1 + j] = c
                    below += [(low, c), (c, high)]
                ends[i] = below
        sides = [side for (i, _), c in cuts.items() for side in split_at(keys[i][0], c, keys[i][1])]
        found = weigh(sides)
        heavier = {key: found[2 * n] - found[2 * n + 1] > 0 for n, key in enumerate(cuts)}
        going = []
        for i in left:
            j, done = 0, False
            for _ in range(ahead):
                if done := at[i][1] - at[i][0] < tolerance(*keys[i]):
                    break
                c, heavy = cuts[i, j], heavier[i, j]
                at[i][heavy] = c  # the left side is heavier: the cut is the new upper end
                j = 2 * j + (1 if heavy else 2)
            if not done and at[i][1] - at[i][0] >= tolerance(*keys[i]):
                going.append(i)
        left, taken = going, taken + ahead
    return [0.5 * (low + high) for low, high in at]


def cuts_equal_shadow(views: DataFrame, keys: list[Key]) -> list[float]:
    """Where both halves have shadows of equal area, to within 0.01 of the box."""
    return search(keys, 100, lambda v, d: 0.01 * (v[1][d] - v[0][d]), lambda of: shadow_areas(views, of))


def split_equal_shadow(views: DataFrame, v: Cube, axis: int) -> float:
    return cuts_equal_shadow(views, [(v, axis)])[0]


def cuts_equal_load(views: DataFrame, keys: list[Key], precision: str = "low", method: str = "two_dim", seed: int = 0) -> list[float]:
    """Where both halves have the same load."""
    tolerance = (lambda v, d: 1e-8) if method == "two_dim" else (lambda v, d: 1e-3 * (v[1][d] - v[0][d]))
    return search(keys, 100, tolerance, lambda of: loads(views, of, precision, method, seed))


def split_equal_load(precision: str = "low", method: str = "two_dim", seed: int = 0):
    return lambda views, v, axis: cuts_equal_load(views, [(v, axis)], precision, method, seed)[0]


def simple_split(samples: list[tuple[float, float]], a: float, b: float) -> float:
    """The cut of sorted (coordinate, weight) samples of an interval where the left's load passes the right's."""
    n = len(samples)
    if n < 10:
        return 0.5 * (a + b)
    total, left, k = sum(f for _, f in samples), 0.0, 0
    for k in range(n - 1):
        left += samples[k][1]
        y = samples[k + 1][0]
        if left / (k + 1) * (y - a) > (total - left) / (n - k - 1) * (b - y):
            break
    mean_l, mean_r = left / (k + 1), (total - left) / (n - k - 1)
    c = (mean_r * b + mean_l * a) / (mean_l + mean_r) if mean_l + mean_r else 0.5 * (a + b)
    return max(samples[k][0], min(samples[k + 1][0], c))


def simple_split_rows(samples: DataFrame, a: float, b: float, ties: str, ranges: int = 64) -> float:
    """``simple_split`` of rows (y, f, ``ties``) in any order: totals of ranges of y first, then sums within each range.

    The driver sees a row a range and the row of the cut. Equal y are in one range, in the order of ``ties``.
    """
    edges = sorted(set(samples.approxQuantile("y", [i / ranges for i in range(1, ranges)], 0.1 / ranges)))
    g = sum((F.when(F.col("y") >= e, 1).otherwise(0) for e in edges), F.lit(0))
    rows = samples.select("y", "f", F.col(ties).alias("tie"), g.alias("g"))
    sums = rows.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.sum("f").alias("f"), F.min("y").alias("first")).orderBy("g").collect()
    n, total = sum(r.n for r in sums), float(sum(r.f for r in sums))
    if n < 10:
        return 0.5 * (a + b)
    offsets, k, left = [], 0, 0.0
    for i, r in enumerate(sums):
        offsets.append((r.g, k, left, sums[i + 1].first if i + 1 < len(sums) else None))
        k, left = k + r.n, left + r.f
    before = F.broadcast(samples.sparkSession.createDataFrame(offsets, "g int, k0 long, l0 double, after double"))
    order = Window.partitionBy("g").orderBy("y", "tie")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    sums_at = rows.withColumn("k1", F.row_number().over(order)).withColumn("l1", F.sum("f").over(so_far)).withColumn("next", F.lead("y").over(order)).join(before, "g")
    at = sums_at.select("y", (F.col("k0") + F.col("k1")).alias("k"), (F.col("l0") + F.col("l1")).alias("l"), F.coalesce("next", "after").alias("r"))
    passes = F.col("l") / F.col("k") * (F.col("r") - a) > (total - F.col("l")) / (n - F.col("k")) * (b - F.col("r"))
    cut = at.filter((F.col("k") < n) & (passes | (F.col("k") == n - 1))).orderBy("k").limit(1).first()
    mean_l, mean_r = cut.l / cut.k, (total - cut.l) / (n - cut.k)
    c = (mean_r * b + mean_l * a) / (mean_l + mean_r) if mean_l + mean_r else 0.5 * (a + b)
    return max(cut.y, min(cut.r, c))


#: When the adaptive splitter has found its cut (change and number of rounds), and its samples at most.
STEADY = {"low": (1e-3, 10), "medium": (1e-5, 50), "high": (1e-8, 100)}
MOST_SAMPLES = 10_000
#: Samples of a round of the adaptive splitter.
ROUND = 50


def _cut(layers: list[tuple[float, int, float]], a: float, b: float) -> float:
    """The cut of an interval from the (load, samples, last coordinate) of its layers in order."""
    n, total = sum(m for _, m, _ in layers), sum(f for f, _, _ in layers)
    if n < 10:
        return 0.5 * (a + b)
    left, m = 0.0, 0
    for (f, k, last), (_, _, after) in zip(layers, layers[1:], strict=False):
        left, m = left + f, m + k
        if left / m * (after - a) > (total - left) / (n - m) * (b - after):
            mean_l, mean_r = left / m, (total - left) / (n - m)
            return max(last, min(after, (mean_r * b + mean_l * a) / (mean_l + mean_r)))
    return 0.5 * (a + b)


def steady(cuts: list[float], rho: float, rounds: int) -> bool:
    """Whether each of the last ``rounds`` cuts lies within ``rho`` of the one ``rounds`` before it."""
    return len(cuts) >= 2 * rounds and all(abs(cuts[-k] - cuts[-k - rounds]) < rho for k in range(1, rounds + 1))


def split_smart(views: DataFrame, v: Cube, axis: int, samples: DataFrame | None = None, precision: str = "low", seed: int = 0, bins: int = 4096) -> float:
    """The weighted median cut of 1 / r^2 samples.

    Samples are added up in layers along the axis by Spark, so the driver sees ``bins`` rows however many there are.
    Without ``samples`` they are drawn in rounds until the cut holds still as ``STEADY`` says, or there are ``MOST_SAMPLES``;
    a job draws twice as many rounds as the rule looks back on, and layers of rounds add up to those of all.
    """
    a, b = v[0][axis], v[1][axis]
    layer = F.floor((F.col(f"x{axis}") - a) / (b - a) * bins).alias("layer")
    sums = [F.sum("f").alias("f"), F.count(F.lit(1)).alias("n"), F.max(f"x{axis}").alias("last")]
    if samples is not None:
        ok = F.lit(True)
        for d in range(3):
            ok = ok & (F.col(f"x{d}") > v[0][d]) & (F.col(f"x{d}") < v[1][d])
        return _cut([(r.f, r.n, r["last"]) for r in samples.filter(ok).groupBy(layer).agg(*sums).orderBy("layer").collect()], a, b)
    rho, rounds = STEADY[precision]
    cuts: list[float] = []
    sketch: dict[int, tuple[float, int, float]] = {}
    while len(cuts) * ROUND < MOST_SAMPLES:
        count = min(2 * rounds * ROUND, MOST_SAMPLES - len(cuts) * ROUND)
        drawn = weighted(points(views.sparkSession, v, count, seed + len(cuts)), views, True)
        rows = drawn.groupBy(F.floor(F.col("id") / ROUND).alias("round"), layer).agg(*sums).collect()  # a row a sample at most
        for k in range(-(-count // ROUND)):
            for r in (r for r in rows if r["round"] == k):
                f, n, last = sketch.get(r.layer, (0.0, 0, a))
                sketch[r.layer] = (f + r.f, n + r.n, max(last, r["last"]))
            cuts.append(_cut([sketch[x] for x in sorted(sketch)], a, b))
            if steady(cuts, rho, rounds):
                return cuts[-1]
    return cuts[-1]


def partition(views: DataFrame, volume: Volume, levels: int, splitter: str = "midway", precision: str = "low", method: str = "two_dim", gradient: bool = False, seed: int = 0) -> Tree:
    """The neutral tree of 2^levels parts; of the three axes, the one whose cut has the least overlap is taken."""
    if levels < 1:
        raise ValueError("at least one level is needed")
    whole: Cube = (volume.origin, tuple(o + n for o, n in zip(volume.origin, volume.lengths, strict=True)))
    first = views.select(*VIEW_COLUMNS).first().asDict()
    size = [first[n] * float(np.linalg.norm([first[f"{e}{d}"] for d in range(3)])) for n, e in (("n0", "a"), ("n1", "b"))]
    magnitude = cross_section_area(whole, 0) / float(size[0] * size[1])
    if splitter in ("smart", "smart_simple"):
        samples = keep(weighted(points(views.sparkSession, whole, SPLIT_SAMPLES[precision], seed), views, True), "grcb-samples")
        cut = lambda keys: [split_smart(views, v, d, samples) for v, d in keys]
    elif splitter == "midway":
        cut = lambda keys: [split_midway(views, v, d) for v, d in keys]
    elif splitter == "equal_shadow":
        cut = lambda keys: cuts_equal_shadow(views, keys)
    elif splitter == "equal_load":
        cut = lambda keys: cuts_equal_load(views, keys, precision, method, seed)
    else:
        raise ValueError(f"no splitter {splitter}")
    tree: Tree = {}
    level = {1: whole}
    for _ in range(levels):
        keys = [(n, d) for n in level for d in range(3)]
        tries = [(n, d, c) for (n, d), c in zip(keys, cut([(level[n], d) for n, d in keys]), strict=True)]
        found = overlaps(views, [split_at(level[n], c, d) for n, d, c in tries])  # one job a level
        below = {}
        for n, v in level.items():
            costs = [(x + (magnitude * cross_section_area(v, d) if gradient else 0.0), d, c) for (m, d, c), x in zip(tries, found, strict=True) if m == n]
            _, d, c = min(costs, key=lambda t: t[0])
            tree[n] = (d, (c - whole[0][d]) / (whole[1][d] - whole[0][d]))
            below[2 * n], below[2 * n + 1] = split_at(v, c, d)
        level = below
    return tree
