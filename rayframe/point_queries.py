"""Queries of the functions on points, lines and arrays, over every line item, image and view."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import kernels
from .functions import vec as V
from .model import Volume
from .operators import exchange, image
from .plans import statistics, trees
from .queries import CONE_VIEWS, FIG, FOUR, FULL, GOODS_SQL, PART, PLANE, RAY_16, SECOND, SPACE, TREE, TURN, _named_voxels, _shadow_sql, _shadows, cone_rays, cone_views, goods, goods_weights, named_voxels, picture, plane_rays, query, rounded, table
from .sources import geometry as G

KEYS = ["l_orderkey", "l_linenumber"]
POINTS_SQL = "p AS (SELECT l_orderkey, l_linenumber, l_quantity / 50.0::DOUBLE AS a0, l_discount * 10.0::DOUBLE AS a1, l_tax * 12.0::DOUBLE AS a2, l_extendedprice / 99991.0::DOUBLE AS b0, l_linenumber / 7.0::DOUBLE AS b1, (l_partkey % 97) / 97.0::DOUBLE AS b2, l_suppkey % 13 AS n FROM lineitem)"


def points(spark, sf_dir) -> DataFrame:
    """l_orderkey, l_linenumber, two points a and b about the unit cube, and a whole number n."""
    c = F.col
    a = [c("l_quantity") / 50.0, c("l_discount") * 10.0, c("l_tax") * 12.0]
    b = [c("l_extendedprice") / 99991.0, c("l_linenumber") / 7.0, c("l_partkey") % 97 / 97.0]
    return V.computed(table(spark, sf_dir, "lineitem"), KEYS, [*V.named([x.cast("double") for x in a], "a"), *V.named([x.cast("double") for x in b], "b"), (c("l_suppkey") % 13).alias("n")])


def _out(df: DataFrame, *whole: str) -> DataFrame:
    return rounded(df, *KEYS, *whole)


def _r(**columns: str) -> str:
    return ", ".join(f"round({x}, 6) + 0.0 AS {n}" for n, x in columns.items())


DOT = "(a0 * b0 + a1 * b1 + a2 * b2)"
NORM = "sqrt(a0 * a0 + a1 * a1 + a2 * a2)"


@query(
    f"WITH {POINTS_SQL} SELECT l_orderkey, l_linenumber, "
    + _r(dot=DOT, norm=NORM, distance="sqrt(pow(a0 - b0, 2) + pow(a1 - b1, 2) + pow(a2 - b2, 2))", product="a0 * a1 * a2", c0="a1 * b2 - a2 * b1", c1="a2 * b0 - a0 * b2", c2="a0 * b1 - a1 * b0", s0="2 * a0 - b0 + 1", s1="2 * a1 - b1", s2="2 * a2 - b2", u0=f"a0 / {NORM}", u1=f"a1 / {NORM}", u2=f"a2 / {NORM}")
    + " FROM p"
)
def vector_algebra(spark, sf_dir):
    a, b = V.cols("a", 3), V.cols("b", 3)
    s = V.add(V.sub(V.scale(a, 2), b), V.lit(V.standard_basis(3, 0)))
    return _out(points(spark, sf_dir).select(*KEYS, V.dot(a, b).alias("dot"), V.norm(a).alias("norm"), V.distance(a, b).alias("distance"), V.product(a).alias("product"), *V.named(V.cross(a, b), "c"), *V.named(s, "s"), *V.named(V.normalize(a), "u")))


BOX = Volume((50, 11, 9), (0.1, -0.05, 0.02), (0.8, 1.0, 0.9))
BOX_SQL = [f"(a{d} - ({o!r})) / {x!r} * {n}" for d, (o, x, n) in enumerate(zip(BOX.origin, BOX.lengths, BOX.voxels, strict=True))]


@query(
    f"WITH {POINTS_SQL}, v AS (SELECT *, " + ", ".join(f"{x} AS v{d}" for d, x in enumerate(BOX_SQL)) + " FROM p) SELECT l_orderkey, l_linenumber, " + _r(v0="v0", v1="v1", v2="v2") + ", "
    + " AND ".join(f"v{d} >= 1e-5 AND v{d} <= {n} - 1e-5" for d, n in enumerate(BOX.voxels)) + " AS inside, "
    + " AND ".join(f"v{d} >= -(2 + 1e-5) AND v{d} < {n} + 2 + 1e-5" for d, n in enumerate(BOX.voxels)) + " AS near, "
    + " AND ".join(f"floor(v{d}) >= 0 AND floor(v{d}) < {n}" for d, n in enumerate(BOX.voxels)) + " AS valid FROM v"
)
def points_in_volume(spark, sf_dir):
    """World points as voxel coordinates, and whether they are inside, within two voxels, or in a valid voxel."""
    rows = V.computed(points(spark, sf_dir), KEYS, V.named(V.to_voxel(V.cols("a", 3), BOX), "v"))
    v = V.cols("v", 3)
    return _out(rows.select(*KEYS, *v, V.inside(v, BOX).alias("inside"), V.inside_margin(v, BOX, 2.0).alias("near"), BOX.valid([F.floor(x) for x in v]).alias("valid")), "inside", "near", "valid")


ANGLE = f"(n * 0.37 + {TURN})"
AXIS = (1 / 3, 2 / 3, 2 / 3)
ALONG = "(a0 / 3 + a1 * 2 / 3 + a2 * 2 / 3)"
TURNED = [f"a{d} * cos{ANGLE} + ({x}) * sin{ANGLE} + {AXIS[d]!r} * {ALONG} * (1 - cos{ANGLE})" for d, x in enumerate(("a2 * 2 / 3 - a1 * 2 / 3", "a0 * 2 / 3 - a2 / 3", "a1 / 3 - a0 * 2 / 3"))]


@query(
    f"WITH {POINTS_SQL} SELECT l_orderkey, l_linenumber, "
    + _r(p0=f"a0 * cos{ANGLE} - a1 * sin{ANGLE}", p1=f"a0 * sin{ANGLE} + a1 * cos{ANGLE}", r0=TURNED[0], r1=TURNED[1], r2=TURNED[2], y0=f"a2 * sin{ANGLE} + a0 * cos{ANGLE}", y1="a1", y2=f"a2 * cos{ANGLE} - a0 * sin{ANGLE}")
    + " FROM p"
)
def vector_rotations(spark, sf_dir):
    """In the plane, about any axis, and about a coordinate axis."""
    a, angle = V.cols("a", 3), F.col("n") * 0.37 + TURN
    return _out(points(spark, sf_dir).select(*KEYS, *V.named(V.rotate_plane(a[:2], angle), "p"), *V.named(V.rotate(a, V.lit(AXIS), angle), "r"), *V.named(V.rotate_about(a, 1, angle), "y")))


@query(
    f"WITH {POINTS_SQL} SELECT l_orderkey, l_linenumber, abs(a1 - b1) <= 1e-5 OR abs(a1 - b1) <= 1e-2 * abs(b1) AS same, n IN (1, 2, 4, 8) AS power, "
    "CASE WHEN abs(a0 - b0) <= 1e-5 THEN 0 WHEN a0 > b0 THEN 1 ELSE -1 END AS sign, CAST(CASE WHEN a0 < b0 THEN -floor(7.3 * (b0 - a0) + 0.5) ELSE floor(7.3 * (a0 - b0) + 0.5) END AS BIGINT) AS rounded, CAST(trunc(7.3 * (a0 - b0)) AS BIGINT) AS cut, "
    "CASE WHEN a2 > greatest(a0, a1) THEN 2 WHEN a1 > a0 THEN 1 ELSE 0 END AS longest FROM p"
)
def scalar_helpers(spark, sf_dir):
    a, b = V.cols("a", 3), V.cols("b", 3)
    d = (a[0] - b[0]) * 7.3
    return points(spark, sf_dir).select(*KEYS, V.approx_equal(a[1], b[1]).alias("same"), V.is_power_of_two(F.col("n")).alias("power"), V.sign(a[0] - b[0]).alias("sign"), V.round_half_away(d).cast("long").alias("rounded"), V.truncated(d).alias("cut"), V.max_index(a).alias("longest"))


@query(
    "WITH e AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS k FROM embeddings), f AS (SELECT e.*, e.x * 0 + z.x AS y FROM e JOIN e z ON z.vec_id = e.vec_id AND z.k = 65 - e.k) "
    "SELECT vec_id, round(sum(x), 6) + 0.0 AS total, round(sqrt(sum(x * x)), 6) + 0.0 AS norm, round(sum(x * y), 6) + 0.0 AS dot, round(sum(least(greatest(x, -0.1), 0.1)), 6) + 0.0 AS boxed, round(product(1 + x / 8), 6) + 0.0 AS product FROM f GROUP BY vec_id"
)
def array_reductions(spark, sf_dir):
    """Vectors of any length as arrays: sum, norm, dot product with the reversed one, sum of the clamped, product."""
    x = F.transform("embedding", lambda v: v.cast("double"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", x.alias("x"))
    return rounded(rows.select("vec_id", V.array_sum(F.col("x")).alias("total"), V.array_norm(F.col("x")).alias("norm"), V.array_dot(F.col("x"), F.reverse("x")).alias("dot"), V.array_sum(V.array_box(F.col("x"), -0.1, 0.1)).alias("boxed"), V.array_product(F.transform("x", lambda v: 1 + v / 8)).alias("product")), "vec_id")


CROSS = "(r0 * s1 - r1 * s0)"


@query(
    f"WITH {POINTS_SQL}, q AS (SELECT *, 1.0 + a2 AS r0, 0.5 + b2 AS r1, b0 - 0.6 AS s0, 1.0 AS s1, b0 - a0 AS d0, b1 - a1 AS d1 FROM p), "
    f"t AS (SELECT *, CASE WHEN abs{CROSS} > 1e-5 THEN (d0 * s1 - d1 * s0) / {CROSS} END AS t, CASE WHEN {CROSS} > 1e-5 THEN (d0 * r1 - d1 * r0) / {CROSS} END AS u FROM q) "
    "SELECT l_orderkey, l_linenumber, " + _r(l0="a0 + t * r0", l1="a1 + t * r1", s0="CASE WHEN u BETWEEN 0 AND 1 AND t BETWEEN 0 AND 1 THEN a0 + t * r0 END", s1="CASE WHEN u BETWEEN 0 AND 1 AND t BETWEEN 0 AND 1 THEN a1 + t * r1 END") + " FROM t"
)
def line_crossings(spark, sf_dir):
    """Where two lines and two segments in the plane meet."""
    p, q = V.cols("a", 2), V.cols("b", 2)
    r, s = [1.0 + F.col("a2"), 0.5 + F.col("b2")], [F.col("b0") - 0.6, F.lit(1.0)]
    return _out(points(spark, sf_dir).select(*KEYS, *V.named(V.line_intersection(p, r, q, s), "l"), *V.named(V.segment_intersection(p, V.add(p, r), q, V.add(q, s)), "s")))


def _box_crossing_sql() -> str:
    edges = [("0.0", "0.0", "0.0", "0.8"), ("0.0", "0.8", "0.9", "0.8"), ("0.9", "0.0", "0.9", "0.8"), ("0.0", "0.0", "0.9", "0.0")]
    found = []
    for x0, y0, x1, y1 in edges:
        s0, s1 = f"({x1} - {x0})", f"({y1} - {y0})"
        rs = f"(r0 * {s1} - r1 * {s0})"
        t, u = f"((({x0} - p0) * {s1} - ({y0} - p1) * {s0}) / {rs})", f"((({x0} - p0) * r1 - ({y0} - p1) * r0) / {rs})"
        found.append(f"SELECT id, p0, p1, p0 + {t} * r0 AS x, p1 + {t} * r1 AS y FROM q WHERE {rs} > 1e-5 AND {t} BETWEEN 0 AND 1 AND {u} BETWEEN 0 AND 1")
    return f"WITH {POINTS_SQL}, q AS (SELECT row_number() OVER () AS id, l_orderkey, l_linenumber, a0 - 0.5 AS p0, a1 - 0.4 AS p1, b0 + 0.3 - (a0 - 0.5) AS r0, b1 + 0.2 - (a1 - 0.4) AS r1 FROM p), h AS ({' UNION ALL '.join(found)}), b AS (SELECT id, arg_min(x, pow(x - p0, 2) + pow(y - p1, 2)) AS x, arg_min(y, pow(x - p0, 2) + pow(y - p1, 2)) AS y FROM h WHERE x <> 0 OR y <> 0 GROUP BY ALL) SELECT l_orderkey, l_linenumber, round(coalesce(x, -1), 6) + 0.0 AS x0, round(y, 6) + 0.0 AS x1 FROM q LEFT JOIN b USING (id)"


@query(_box_crossing_sql())
def box_crossings(spark, sf_dir):
    """The first edge of a rectangle that a segment meets."""
    rows = V.computed(points(spark, sf_dir), KEYS, [(F.col("a0") - 0.5).alias("p0"), (F.col("a1") - 0.4).alias("p1"), (F.col("b0") + 0.3).alias("q0"), (F.col("b1") + 0.2).alias("q1")])
    return _out(V.box_hits(rows, KEYS, V.cols("p", 2), V.cols("q", 2), V.lit((0.9, 0.8))))


K = "(0.2 * (b0 - 0.5) + 0.3 * b1 + 0.9 * (b2 - 0.2))"


@query(
    f"WITH {POINTS_SQL}, t AS (SELECT *, CASE WHEN abs{K} >= 1e-3 THEN (0.2 * (0.5 - a0) + 0.3 * (0.6 - a1) + 0.9 * (2.0 - a2)) / {K} END AS t FROM p) SELECT l_orderkey, l_linenumber, " + _r(x0="a0 + t * (b0 - 0.5)", x1="a1 + t * b1", x2="a2 + t * (b2 - 0.2)") + " FROM t"
)
def plane_hits(spark, sf_dir):
    """Where rays meet a plane."""
    a, b = V.cols("a", 3), V.cols("b", 3)
    return _out(points(spark, sf_dir).select(*KEYS, *V.named(V.plane_intersection(a, V.sub(b, V.lit((0.5, 0.0, 0.2))), V.lit((0.5, 0.6, 2.0)), V.lit((0.2, 0.3, 0.9))), "x")))


def _pixels_sql() -> str:
    """Projection of every customer's point by one cone view and one parallel view, from their definitions."""
    out = "WITH c AS (SELECT c_custkey, (c_custkey * 7919 % 997) / 997.0::DOUBLE AS x0, (c_custkey * 104729 % 991) / 991.0::DOUBLE AS x1, (c_custkey * 1299709 % 983) / 983.0::DOUBLE AS x2 FROM customer), "
    # The source is at (-2, 0.5, 0.5), the detector is the plane through (2.5, -0.5, -0.5), with steps of 0.2 and 0.25.
    out += "t AS (SELECT *, 4.5 / (x0 + 2) AS k FROM c) "
    cone = [f"CAST(trunc((0.5 + k * (x{d} - 0.5) + 0.5) / {w} + 0.5) AS BIGINT) AS q{d - 1}" for d, w in ((1, 0.2), (2, 0.25))]
    # Parallel rays run from the source to the corner.
    flat = [f"CAST(trunc((x{d} + (2.5 - x0) * (-1.0 / 4.5) + 0.5) / {w} + 0.5) AS BIGINT) AS f{d - 1}" for d, w in ((1, 0.2), (2, 0.25))]
    return out + "SELECT c_custkey, " + ", ".join(cone + flat) + " FROM t"


@query(_pixels_sql())
def detector_pixels(spark, sf_dir):
    """Points projected onto a detector, from a source point and along parallel rays."""
    key = F.col("c_custkey")
    x = [key * 7919 % 997 / 997.0, key * 104729 % 991 / 991.0, key * 1299709 % 983 / 983.0]
    rows = V.computed(table(spark, sf_dir, "customer"), ["c_custkey"], V.named(x, "x"))
    view = [V.lit(v) for v in ((-2.0, 0.5, 0.5), (2.5, -0.5, -0.5), (0.0, 0.2, 0.0), (0.0, 0.0, 0.25))]
    return rows.select("c_custkey", *V.named(V.detector_pixel(V.cols("x", 3), *view, F.lit(False)), "q"), *V.named(V.detector_pixel(V.cols("x", 3), *view, F.lit(True)), "f"))


@query(
    f"WITH {POINTS_SQL}, q AS (SELECT l_orderkey, l_linenumber, a0 * 16 AS x0, b2 * 16 AS x1 FROM p) SELECT l_orderkey, l_linenumber, i0 + 16 * i1 AS voxel, round((1 - abs(x0 - i0 - 0.5)) * (1 - abs(x1 - i1 - 0.5)), 6) + 0.0 AS value "
    "FROM (SELECT *, CAST(floor(x0 + 0.5) AS BIGINT) - m AS i0, CAST(floor(x1 + 0.5) AS BIGINT) - n AS i1 FROM q, range(2) a(m), range(2) b(n)) WHERE i0 BETWEEN 0 AND 15 AND i1 BETWEEN 0 AND 15"
)
def interpolated_points(spark, sf_dir):
    """Every point spread over the voxels around it."""
    rows = points(spark, sf_dir).select(*KEYS, (F.col("a0") * 16).alias("x0"), (F.col("b2") * 16).alias("x1"))
    return rounded(kernels.interpolate(rows, PLANE, KEYS), *KEYS, "voxel")


@query(
    f"WITH {RAY_16}, g AS (SELECT line, o0, o1, u0, u1, i, j FROM o, range(16) a(i), range(16) b(j)), v AS (SELECT line, i + 16 * j AS voxel, CASE WHEN abs(u1) > abs(u0) THEN greatest(0, 1 - abs(o0 + (j + 0.5 - o1) / u1 * u0 - i - 0.5)) ELSE greatest(0, 1 - abs(o1 + (i + 0.5 - o0) / u0 * u1 - j - 0.5)) END AS value FROM g) "
    "SELECT line, voxel, round(value, 6) + 0.0 AS value FROM v WHERE value > 1e-9"
)
def joseph_values(spark, sf_dir):
    """The weight of every voxel for every line, one by one, as a column iterator asks for it."""
    rays = kernels.truncated(plane_rays(spark, sf_dir), PLANE)
    cells = F.array(*[F.struct(F.lit(float(i)).alias("i"), F.lit(float(j)).alias("j")) for j in range(16) for i in range(16)])
    rows = rays.select("line", "o0", "o1", "u0", "u1", F.inline(cells))
    rows = V.computed(rows, ["line", "i", "j"], [kernels.joseph_value(V.cols("o", 2), V.cols("u", 2), [F.col("i"), F.col("j")]).alias("value")])
    return rounded(rows.filter("value > 1e-9").select("line", (F.col("i") + 16 * F.col("j")).cast("long").alias("voxel"), "value"), "line", "voxel")


def _original_sql(n: int) -> str:
    from math import cos, pi, sin

    total = []
    for value, a, b, x0, y0, angle in image.SHEPP_LOGAN:
        co, si = cos(angle * pi / 180), sin(angle * pi / 180)
        total.append(f"CASE WHEN pow((x - {x0!r}) * {co!r} + (y - {y0!r}) * {si!r}, 2) / {a * a!r} + pow((y - {y0!r}) * {co!r} - (x - {x0!r}) * {si!r}, 2) / {b * b!r} <= 1.0 THEN {value!r}::DOUBLE ELSE 0 END")
    return f"SELECT r AS voxel, round({' + '.join(total)}, 6) + 0.0 AS value FROM (SELECT r, 2.0 * (r % {n}) / {n} - 1 AS x, 2.0 * (r // {n}) / {n} - 1 AS y FROM ({_named_voxels(n * n)}) t(r))"


@query(_original_sql(61))
def phantom_original(spark, sf_dir):
    return rounded(image.phantom(spark, Volume.cube(61, 2), "original", voxels=named_voxels(spark, sf_dir, 61**2)), "voxel")


@query(
    "WITH k AS (SELECT n_nationkey AS view, [n_nationkey * 0.1 - 2, 0.5, n_regionkey * 0.2] AS s, [2.0, n_nationkey * 0.05, 0.5] AS m FROM nation), "
    "r AS (SELECT CAST(view AS BIGINT) * 6 + i + 3 * j AS line, s, m[1] AS d0, m[2] - 0.75 + (i + 0.5) * 0.5 AS d1, m[3] - 0.5 + (j + 0.5) * 0.5 AS d2 FROM k, range(3) a(i), range(2) b(j)) "
    "SELECT line, " + ", ".join([f"CAST(round(s[{d + 1}], 6) + 0.0 AS DOUBLE) AS s{d}" for d in range(3)] + [f"CAST(round(d{d}, 6) + 0.0 AS DOUBLE) AS d{d}" for d in range(3)]) + " FROM r"
)
def rays_custom(spark, sf_dir):
    """Views given one by one, as a specification file lists them."""
    key, region = F.col("n_nationkey"), F.col("n_regionkey")
    arr = lambda *x: F.array(*[F.lit(v) if isinstance(v, float) else v.cast("double") for v in x])
    views = table(spark, sf_dir, "nation").select(
        key.alias("view"), arr(key * 0.1 - 2, 0.5, region * 0.2).alias("source"), arr(2.0, key * 0.05, 0.5).alias("detector"), arr(1.5, 1.0).alias("det_size"),
        F.array(arr(0.0, 1.0, 0.0), arr(0.0, 0.0, 1.0)).alias("tilt"), F.array(F.lit(3), F.lit(2)).alias("det_shape"), F.lit(False).alias("parallel"),
    )
    return rounded(G.rays(G.custom(views), 3).drop("view", "p0", "p1"), "line")


@query(
    f"WITH {GOODS_SQL}, w AS (SELECT i0, i1, i2, CAST(count(*) AS DOUBLE) AS value FROM v GROUP BY ALL) "
    "SELECT 0 AS axis, i1 + 11 * i2 AS voxel, value FROM w WHERE i0 = 25 UNION ALL SELECT 1, i0 + 50 * i2, value FROM w WHERE i1 = 5 UNION ALL SELECT 2, i0 + 50 * i1, value FROM w WHERE i2 = 4"
)
def orthogonal_slices(spark, sf_dir):
    """The three middle slices of the volume."""
    from .queries import GOODS

    out = [x.select(F.lit(d).alias("axis"), "voxel", "value") for d, x in enumerate(exchange.orthogonal_slices(goods_weights(spark, sf_dir), GOODS))]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("SELECT c_custkey AS part, " + ", ".join(f"round((c_custkey * {k} % 6) / 12.0::DOUBLE, 6) AS origin_{d}, round((c_custkey * {n} % 6 + 1) / 12.0::DOUBLE, 6) AS length_{d}" for d, (k, n) in enumerate(((7, 5), (11, 7), (13, 11)))) + " FROM customer")
def local_volumes(spark, sf_dir):
    """A box for every customer."""
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("part"), *[(F.col("c_custkey") * k % 6).alias(f"lo_{d}") for d, k in enumerate((7, 11, 13))])
    rows = rows.select("*", *[(F.col(f"lo_{d}") + F.col("part") * n % 6).alias(f"hi_{d}") for d, n in enumerate((5, 7, 11))])
    return rounded(exchange.local_volumes(rows, SPACE), "part")


@query(
    f"WITH s AS ({_shadow_sql()}), n AS (SELECT *, max_x - min_x + 1 AS w, greatest(max_x - min_x + 1, 0) * greatest(max_y - min_y + 1, 0) AS n FROM s), f AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY part ORDER BY view ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first FROM n) "
    "SELECT part, CAST(first + (j - min_y) * w + i - min_x AS BIGINT) AS local_line, CAST(view AS BIGINT) * 100 + i + 10 * j AS line FROM f, range(10) a(i), range(10) b(j) WHERE i BETWEEN min_x AND max_x AND j BETWEEN min_y AND max_y"
)
def restricted_lines(spark, sf_dir):
    """The rays that each part of the volume needs, with its own numbers for them."""
    return exchange.restricted(cone_rays(spark, sf_dir), _shadows(spark, sf_dir)).select("part", "local_line", "line")


@query(f"WITH {FIG}, {SECOND} SELECT voxel, coalesce(f.value, 0) AS goods, coalesce(s.value, 0) AS lines FROM f FULL JOIN s USING (voxel)")
def image_zip(spark, sf_dir):
    return image.zipped([picture(spark, sf_dir), picture(spark, sf_dir, "l_linenumber", "l_suppkey", 100)], ["goods", "lines"])


@query(f"WITH {GOODS_SQL}, w AS (SELECT DISTINCT line, {PART} AS part FROM v) SELECT owner, count(*) AS partners FROM (SELECT DISTINCT a.part AS owner, b.part AS other FROM w a JOIN w b USING (line) WHERE a.part <> b.part) GROUP BY owner")
def partners(spark, sf_dir):
    """How many other parts each part shares lines with."""
    from .queries import GOODS

    return exchange.count_messages(statistics.owners(goods(spark, sf_dir), GOODS, trees.boxes(TREE, GOODS)))


@query(
    f"WITH {GOODS_SQL} SELECT i0 // 7 + 8 * (i1 // 4 + 3 * (i2 // 3)) AS part, count(*) AS n FROM v GROUP BY 1"
)
def many_parts(spark, sf_dir):
    """Weights of 72 blocks, whose owners are looked up by cuts."""
    from .queries import GOODS

    of = trees.blocks(GOODS, (8, 3, 3))
    rows = V.computed(goods(spark, sf_dir), ["line"], V.named(GOODS.unroll(F.col("voxel")), "u"))
    return rows.groupBy(statistics.owner(V.cols("u", 3), of).alias("part")).agg(F.count(F.lit(1)).alias("n")).select(F.col("part").cast("long").alias("part"), "n")


def _column_sql() -> str:
    turn = f"k AS (SELECT n_nationkey AS view, {FULL} AS t FROM nation)"
    return (
        f"WITH {turn}, b AS (SELECT n_nationkey * 67 AS voxel, (n_nationkey * 67) % 12 AS x, (n_nationkey * 67) // 12 % 12 AS y, (n_nationkey * 67) // 144 AS z FROM nation), "
        "c AS (SELECT voxel, view, t, (x + (i & 1)) / 12.0 - 0.5 AS x, (y + (i >> 1 & 1)) / 12.0 - 0.5 AS y, (z + (i >> 2 & 1)) / 12.0 - 0.5 AS z FROM b, k, range(8) r(i)), "
        "p AS (SELECT voxel, view, 3.5 * (y * cos(t) - x * sin(t)) / (x * cos(t) + y * sin(t) + 2) AS u, 3.5 * z / (x * cos(t) + y * sin(t) + 2) AS v FROM c), "
        "n AS (SELECT voxel, view, CAST(trunc((u + 1) * 5 + 0.5) AS BIGINT) AS i, CAST(trunc((v + 1) * 5 + 0.5) AS BIGINT) AS j FROM p) "
        "SELECT voxel, view, greatest(min(i) - 1, 0) AS min_x, greatest(min(j) - 1, 0) AS min_y, least(max(i) + 1, 9) AS max_x, least(max(j) + 1, 9) AS max_y FROM n GROUP BY voxel, view"
    )


@query(_column_sql())
def column_shadows(spark, sf_dir):
    """The pixels in which a matrix column may have elements, of one voxel a nation."""
    voxels = table(spark, sf_dir, "nation").select((F.col("n_nationkey") * 67).cast("long").alias("voxel"))
    return exchange.column_shadow(voxels, SPACE, cone_views(spark, sf_dir))


def _columns_sql() -> str:
    """Shadows as in ``column_shadows`` for the voxels of line items; rays of their pixels; weights in the voxel's own slice."""
    d3 = range(3)
    shade = _column_sql().split(", c AS (SELECT voxel", 1)[1]
    first = f"{CONE_VIEWS}, b AS (SELECT DISTINCT voxel, voxel % 12 AS x, voxel // 12 % 12 AS y, voxel // 144 AS z FROM (SELECT (l_orderkey * 7 + l_partkey * 31) % 1728 AS voxel FROM lineitem))"
    out = f"WITH {first}, sh AS (WITH c AS (SELECT voxel{shade})"
    out += ", px AS (SELECT voxel, view, x, y, z, i, j FROM sh JOIN b USING (voxel), range(10) p(i), range(10) q(j) WHERE i BETWEEN min_x AND max_x AND j BETWEEN min_y AND max_y)"
    out += ", r AS (SELECT voxel, x, y, z, CAST(view AS BIGINT) * 100 + i + 10 * j AS line, " + ", ".join(f"12 * s{d} AS o{d}, 12 * (c{d} + (i + 0.5) * a{d} + (j + 0.5) * b{d} - s{d}) AS u{d}" for d in d3) + " FROM px JOIN w USING (view))"
    out += ", e AS (SELECT *, CASE WHEN abs(u2) > greatest(abs(u0), abs(u1)) THEN 2 WHEN abs(u1) > abs(u0) THEN 1 ELSE 0 END AS axis FROM r)"
    out += ", met AS (SELECT *, CASE axis WHEN 0 THEN (x + 0.5 - o0) / u0 WHEN 1 THEN (y + 0.5 - o1) / u1 ELSE (z + 0.5 - o2) / u2 END AS t FROM e)"
    near = [f"CASE axis WHEN {d} THEN 1.0 ELSE greatest(0.0, 1 - abs(o{d} + t * u{d} - {n} - 0.5)) END" for d, n in enumerate("xyz")]
    out += ", g AS (SELECT voxel, line, " + " * ".join(near) + " AS value FROM met)"
    return out + " SELECT voxel, count(*) AS entries, sum(CASE WHEN value > 1e-9 THEN 1 ELSE 0 END)::BIGINT AS positive, round(sum(value), 6) + 0.0 AS total, round(sum(value * (line % 97)), 4) + 0.0 AS by_line FROM g GROUP BY voxel"


@query(_columns_sql())
def column_values(spark, sf_dir):
    """Columns of the matrix, zeros included, of all voxels that line items name: their entries and sums."""
    voxels = table(spark, sf_dir, "lineitem").select(((F.col("l_orderkey") * 7 + F.col("l_partkey") * 31) % SPACE.cells).alias("voxel")).distinct()
    rows = exchange.columns(voxels, SPACE, cone_views(spark, sf_dir)).groupBy("voxel")
    rows = rows.agg(F.count(F.lit(1)).alias("entries"), F.sum((F.col("value") > 1e-9).cast("long")).alias("positive"), F.sum("value").alias("total"), F.sum(F.col("value") * (F.col("line") % 97)).alias("by_line"))
    return rows.select("voxel", "entries", "positive", (F.round("total", 6) + F.lit(0.0)).alias("total"), (F.round("by_line", 4) + F.lit(0.0)).alias("by_line"))
