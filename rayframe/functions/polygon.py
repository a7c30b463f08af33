"""Convex polygons as columns: arrays of (x, y), counter-clockwise, computed by array functions in the JVM.

Arguments should be plain columns (``vec.computed`` makes them so), as they are read many times.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def point(x, y) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def turn(a: Column, b: Column, c: Column) -> Column:
    """Twice the area of the triangle: positive where ``c`` lies to the left of the way from ``a`` to ``b``."""
    return (b["x"] - a["x"]) * (c["y"] - a["y"]) - (b["y"] - a["y"]) * (c["x"] - a["x"])


def _far(a: Column, b: Column) -> Column:
    return (b["x"] - a["x"]) * (b["x"] - a["x"]) + (b["y"] - a["y"]) * (b["y"] - a["y"])


def turned(polygon: Column) -> Column:
    """The same points, each followed by its predecessor's place: with the polygon, its edges."""
    return F.concat(F.slice(polygon, F.lit(2), F.greatest(F.size(polygon) - 1, F.lit(0))), F.slice(polygon, 1, 1))


def hull(points: Column) -> Column:
    """The convex hull of a few points, by going round: the next corner has all others to its left."""
    first = F.array_min(points)

    def step(path: Column, _: Column) -> Column:
        at = F.element_at(path, -1)

        def better(best: Column, p: Column) -> Column:
            t = turn(at, best, p)
            here = (best["x"] == at["x"]) & (best["y"] == at["y"])
            return F.when(here | (t < 0) | ((t == 0) & (_far(at, p) > _far(at, best))), p).otherwise(best)

        return F.concat(path, F.array(F.aggregate(points, at, better)))

    # Once round, the way begins anew; what is found again goes.
    return F.array_distinct(F.aggregate(F.sequence(F.lit(1), F.greatest(F.size(points), F.lit(1))), F.array(first), step))


def clipped(polygon: Column, by: Column) -> Column:
    """The part of a convex polygon inside another, edge by edge; empty where nothing or no area is left."""
    none = F.filter(polygon, lambda _: F.lit(False))

    def cut(rest: Column, edge: Column) -> Column:
        a, b = edge["a"], edge["b"]

        def kept(p: Column, q: Column) -> Column:
            s, t = turn(a, b, p), turn(a, b, q)
            k = s / F.when(s != t, s - t)
            crossing = point(p["x"] + (q["x"] - p["x"]) * k, p["y"] + (q["y"] - p["y"]) * k)
            return F.array_compact(F.array(F.when(s >= 0, point(p["x"], p["y"])), F.when(((s > 0) & (t < 0)) | ((s < 0) & (t > 0)), crossing)))

        return F.when(F.size(rest) < 3, none).otherwise(F.flatten(F.zip_with(rest, turned(rest), kept)))

    edges = F.zip_with(by, turned(by), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    return F.aggregate(edges, polygon, cut)


def area(polygon: Column) -> Column:
    products = F.zip_with(polygon, turned(polygon), lambda p, q: p["x"] * q["y"] - p["y"] * q["x"])
    return F.when(F.size(polygon) < 3, F.lit(0.0)).otherwise(0.5 * F.abs(F.aggregate(products, F.lit(0.0), lambda x, y: x + y)))
