"""Trees, partitionings, their statistics, exchange, formats and observers."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rayframe.functions import kernels, polygon
from rayframe.functions import vec as V
from rayframe.model import Volume
from rayframe.operators import exchange
from rayframe.plans import bisection, grcb, statistics, trees
from rayframe.sources import formats
from rayframe.sources import geometry as G
from rayframe.streaming import observe

V8 = Volume.cube(8)


@pytest.fixture(scope="module")
def scan(spark):
    views = G.cone_beam(G.view_range(spark, 6), V8, 6, (2.0, 2.0), (6, 6), 2.0, 2.0).cache()
    rays = G.rays(views, 3).cache()
    return views, rays, kernels.closest(rays, V8).cache()


def covers(boxes, volume):
    seen = np.zeros(volume.voxels, int)
    for b in boxes:
        seen[tuple(slice(lo, hi + 1) for lo, hi in b)] += 1
    return (seen == 1).all()


def test_trees():
    tree = {1: (2, 0.5), 2: (0, 0.5), 3: (1, 0.25)}
    text = "[[2, 0.5], [[0, 0.5], [], []], [[1, 0.25], [], []]]"
    assert trees.serialized(tree) == text and trees.parsed(text) == tree
    assert trees.parsed(text, 1) == {1: (2, 0.5)} and trees.parsed(text, 0) == {}
    voxel = trees.to_voxels(tree, V8)
    assert voxel == {1: (2, 3), 2: (0, 3), 3: (1, 1)} and trees.to_neutral(voxel, V8) == tree
    boxes = trees.load_partitioning(text, V8, 2)
    assert len(boxes) == 4 and covers(boxes, V8)
    assert covers(trees.blocks(Volume((7, 5, 3)), (3, 2, 1)), Volume((7, 5, 3)))
    with pytest.raises(ValueError):
        trees.parsed("[[2, 0.5], []")
    assert "axis 2 at 0.5" in trees.printed(tree)


def owners_by_hand(matrix, boxes):
    out = {}
    for r in matrix.collect():
        at = (r.voxel % 8, r.voxel // 8 % 8, r.voxel // 64)
        k = next(k for k, b in enumerate(boxes) if all(lo <= x <= hi for x, (lo, hi) in zip(at, b, strict=True)))
        out.setdefault(r.line, set()).add(k)
    return out


@pytest.mark.parametrize("limit", [128, 0])
def test_statistics(scan, limit, monkeypatch):
    monkeypatch.setattr(statistics, "EXPRESSION_PARTS", limit)
    _, _, matrix = scan
    boxes = trees.boxes({1: (0, 3), 2: (1, 2), 3: (2, 5)}, V8)
    sets = owners_by_hand(matrix, boxes)
    owned = statistics.owners(matrix, V8, boxes)
    assert statistics.communication_volume(owned).first()[0] == sum(len(s) - 1 for s in sets.values())
    pairs = {(a, b) for s in sets.values() for a in s for b in s}
    assert statistics.message_count(owned, 4).first()[0] == len(pairs) - 4
    assert sum(r.partners for r in exchange.count_messages(owned).collect()) == len(pairs) - len({a for a, _ in pairs})
    whole = [[(0, 7)] * 3]
    assert statistics.communication_volume(statistics.owners(matrix, V8, whole)).first()[0] == 0
    assert statistics.regularizer_volume(V8, whole) == 0


def test_weights(scan):
    _, _, matrix = scan
    weights = statistics.voxel_weights(matrix)
    sums = statistics.partial_sums(weights, V8)
    box = [(1, 5), (0, 3), (2, 7)]
    at = V8.unroll(F.col("voxel"))
    direct = weights.filter(statistics.owner(at, [box]).isNotNull()).agg(F.sum("value")).first()[0]
    assert statistics.box_weight(sums, V8, box).first()[0] == direct


def best_cut(counts, weights, box, epsilon):
    """The rule by a plain loop over axes and layers."""
    total = sum(weights[0].values())
    best, least, level = None, None, epsilon
    for d, (lo, hi) in enumerate(box):
        crossed, last = 0, lo
        for layer in sorted(counts.get(d, {})):
            if layer != last and layer > lo:
                at, last = (layer - 1 + last) // 2, layer
                if at >= hi:
                    break
                left = sum(w for i, w in weights[d].items() if i <= at)
                heavy = max(left, total - left) / (0.5 * total) - 1 if total else 0.0
                if (least is None or crossed < least) and heavy < epsilon or crossed == least and heavy < level:
                    best, least, level = (d, at), crossed, heavy
            crossed += counts[d][layer]
    d, at = best or (0, sum(box[0]) // 2)
    left = sum(w for i, w in weights[d].items() if i <= at)
    return d, at, least if best else 0, float(left), float(total)


def test_best_cuts(spark):
    """All nodes in one sweep against the loop: lone layers, ties, no events, no weight, bounds that no cut meets."""
    rng = np.random.default_rng(11)
    nodes, counts, weights = {}, {}, {}
    for n in range(40):
        nodes[n] = ([(int(lo), int(lo + size)) for lo, size in zip(rng.integers(0, 5, 3), rng.integers(0, 9, 3), strict=True)], float(rng.choice([0.0, 0.1, 0.4, 3.0])))
        counts[n] = {d: {int(k): int(rng.integers(-2, 4)) for k in rng.choice(14, rng.integers(0, 9), False)} for d in range(3)}
        cells = rng.integers(0, 3, [hi - lo + 1 for lo, hi in nodes[n][0]]) * (n % 7 > 0)
        weights[n] = [{lo + i: float(w) for i, w in enumerate(cells.sum(tuple(x for x in range(3) if x != d))) if w} for d, (lo, _) in enumerate(nodes[n][0])]
    table = spark.createDataFrame([(n, *[x for e in b for x in e], eps) for n, (b, eps) in nodes.items()], "node int, lo_0 int, hi_0 int, lo_1 int, hi_1 int, lo_2 int, hi_2 int, epsilon double")
    events = spark.createDataFrame([(n, d, k, w) for n, c in counts.items() for d, e in c.items() for k, w in e.items()], "node int, d int, layer int, way int")
    load = spark.createDataFrame([(n, d, k, w) for n, c in weights.items() for d, e in enumerate(c) for k, w in e.items()], "node int, d int, layer int, weight double")
    got = {r.node: (r.d, r["at"], r.crossed, r.left, r.total) for r in bisection.best_cuts(events, load, table, 3).collect()}
    assert got == {n: best_cut(counts[n], weights[n], b, eps) for n, (b, eps) in nodes.items()}
    assert len({x[:2] for x in got.values()}) > 10


@pytest.mark.parametrize("parts", [2, 8])
def test_bisection(scan, parts):
    _, rays, matrix = scan
    boxes = trees.boxes(bisection.partition_bisection(rays, V8, parts, 0.4), V8)
    assert len(boxes) == parts and covers(boxes, V8)
    assert statistics.load_imbalance(statistics.voxel_weights(matrix), V8, boxes).first()[0] < 1.0
    with pytest.raises(ValueError):
        bisection.partition_bisection(rays, V8, 3)


def test_bisection_writes_few_bytes(scan, monkeypatch):
    """Lines of the last level are not written; of the others, no more than origin, direction, layers and ways."""
    _, rays, _ = scan
    written, keep = [], bisection.keep
    monkeypatch.setattr(bisection, "keep", lambda df, what: written.append((what, dict(df.dtypes))) or keep(df, what))
    bisection.partition_bisection(rays, V8, 8, 0.4)
    lines = [kinds for what, kinds in written if what == "bisection-lines"]
    assert len(lines) == 2
    for kinds in lines:
        assert [c for c, kind in kinds.items() if kind != "int"] == [f"{c}{d}" for c in "ou" for d in range(3)]


def test_trivial(scan):
    _, _, matrix = scan
    axis, boxes, volume = bisection.partition_trivial(matrix, V8, 2)
    assert covers(boxes, V8) and volume >= 0 and axis in (0, 1, 2)


def plain_hull(points):
    pts = sorted(set(map(tuple, points)))

    def half(order):
        out = []
        for p in order:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out

    return pts if len(pts) < 3 else half(pts)[:-1] + half(pts[::-1])[:-1]


def plain_area(p):
    return 0.5 * abs(sum(a[0] * b[1] - a[1] * b[0] for a, b in zip(p, p[1:] + p[:1], strict=True))) if len(p) > 2 else 0.0


def plain_common(a, b):
    """The area of two convex polygons' common part by the inclusion of a fine grid's cells."""
    n = 400
    x, y = np.meshgrid((np.arange(n) + 0.5) / n * 2 - 1, (np.arange(n) + 0.5) / n * 2 - 1)
    inside = np.ones((n, n), bool)
    for poly in (a, b):
        for p, q in zip(poly, poly[1:] + poly[:1], strict=True):
            inside &= (q[0] - p[0]) * (y - p[1]) - (q[1] - p[1]) * (x - p[0]) >= 0
    return inside.sum() * 4 / n**2


def test_polygons(spark):
    rng = np.random.default_rng(2)
    sets = [rng.uniform(-1, 1, (int(k), 2)).tolist() for k in rng.integers(3, 9, 60)]
    square = [[-0.5, -0.5], [0.5, -0.5], [0.5, 0.5], [-0.5, 0.5]]
    sets += [square, square + [[0.0, 0.0], [0.0, -0.5], [0.5, 0.5]], [[0.1, 0.1]] * 8, [[0.0, 0.0], [0.5, 0.5], [1.0, 1.0]], [[0.0, 0.0], [0.5, 0.0]]]
    rows = [(i, a, b) for i, (a, b) in enumerate(zip(sets, sets[1:] + sets[:1], strict=True))]
    df = spark.createDataFrame(rows, "i int, a array<array<double>>, b array<array<double>>")
    df = V.computed(df, ["i"], [F.transform(c, lambda p: polygon.point(p[0], p[1])).alias(c) for c in "ab"])
    df = V.computed(df, ["i"], [polygon.hull(F.col(c)).alias(c) for c in "ab"])
    df = V.computed(df, ["i", "a", "b"], [polygon.area(F.col("a")).alias("size"), polygon.clipped(F.col("a"), F.col("b")).alias("both")])
    for r in df.select("*", polygon.area(F.col("both")).alias("common")).collect():
        a, b = plain_hull(rows[r.i][1]), plain_hull(rows[r.i][2])
        got = [tuple(p) for p in r.a]
        assert sorted(got) == sorted(a) and (len(a) < 3 or abs(r["size"] - plain_area(a)) < 1e-12)
        if min(len(a), len(b)) > 2:
            assert abs(r.common - plain_common(a, b)) < 0.02
            assert r.common == 0 or abs(r.common - plain_area([tuple(p) for p in r.both])) < 1e-12
        if set(map(tuple, rows[r.i][1])) == set(map(tuple, square)) == set(map(tuple, rows[r.i][2])):
            assert r.common == 1.0


def test_outlines(scan):
    """Shadows of a box against a plain projection; a view along whose detector a ray runs has none."""
    views, _, _ = scan
    box = ((0.2, 0.3, 0.1), (0.7, 0.9, 0.6))
    got = {r.view: [tuple(p) for p in r.outline] for r in grcb.outlines(views, [box]).collect()}
    assert len(got) == 6
    for v in views.collect():
        s, c, a, b = (np.array([v[f"{x}{d}"] for d in range(3)]) for x in "scab")
        u, w = a / np.linalg.norm(a), b / np.linalg.norm(b)
        middle, normal = c + 0.5 * (v.n0 * a + v.n1 * b), np.cross(u, w)
        points = []
        for k in range(8):
            x = np.array([box[k >> d & 1][d] for d in range(3)])
            hit = s + (x - s) * ((c - s) @ normal / ((x - s) @ normal)) - middle
            points.append((hit @ u, hit @ w))
        want = plain_hull([tuple(np.round(p, 9)) for p in points])
        assert sorted(tuple(np.round(p, 9)) for p in got[v.view]) == sorted(want)
    first = views.filter("view = 0").first()
    source = tuple(first[f"s{d}"] for d in range(3))  # rays to a corner there have no way to the detector
    assert grcb.outlines(views.filter("view = 0"), [(source, (2.0, 2.0, 2.0))]).first().outline is None
    assert grcb.overlaps(views, [(box, box), (box, ((0.2, 0.3, 0.6), (0.7, 0.9, 0.9)))])[0] > 0


def test_overlap_areas_use_all_cores(spark, scan):
    """Views that come in one task are dealt out; each has its rows, as before."""
    views, pairs = scan[0].coalesce(1), [grcb.split_at(((0.0,) * 3, (1.0,) * 3), 0.5, d) for d in range(3)]
    got = grcb.overlap_areas(views, pairs)
    assert got.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism > 1
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, grcb._areas(views, pairs).collect()))


def test_search(scan):
    """All keys at once come to the cuts of plain halving, in a number of jobs that does not depend on their number."""
    views, _, _ = scan
    boxes = [((0.0, 0.0, 0.0), (1.0, 1.0, 1.0)), ((0.0, 0.2, 0.1), (0.5, 0.9, 0.4)), ((0.3, 0.0, 0.0), (0.4, 1.0, 1.0))]
    keys = [(v, d) for v in boxes for d in range(3)]

    def plain(weight, v, axis, tolerance):
        low, high = v[0][axis], v[1][axis]
        while high - low >= tolerance:
            c = 0.5 * (low + high)
            left, right = (weight(x) for x in grcb.split_at(v, c, axis))
            low, high = (low, c) if left > right else (c, high)
        return 0.5 * (low + high)

    weight = lambda v: float(np.prod([np.exp(v[1][d]) - np.exp(v[0][d]) for d in range(3)]))
    jobs = []
    for some in (keys[:1], keys):
        jobs.append(0)

        def weigh(of):
            jobs[-1] += 1
            return [weight(v) for v in of]

        got = grcb.search(some, 100, lambda v, d: 1e-3 * (v[1][d] - v[0][d]), weigh)
        assert got == [plain(weight, v, d, 1e-3 * (v[1][d] - v[0][d])) for v, d in some]
    assert jobs == [4, 4]
    halves = [x for c, (v, d) in zip(grcb.cuts_equal_shadow(views, keys[:2]), keys, strict=False) for x in grcb.split_at(v, c, d)]
    left, right, low, high = grcb.shadow_areas(views, halves)
    assert abs(left - right) < 0.05 * left and abs(low - high) < 0.05 * low


@pytest.mark.parametrize("splitter", ["midway", "equal_shadow", "smart_simple"])
def test_continuous(scan, splitter, monkeypatch):
    views, _, _ = scan
    monkeypatch.setitem(grcb.SPLIT_SAMPLES, "low", 2000)
    tree = grcb.partition(views, V8, 2, splitter, gradient=splitter == "midway")
    boxes = trees.boxes(trees.to_voxels(tree, V8), V8)
    assert len(tree) == 3 and covers(boxes, V8)
    with pytest.raises(ValueError):
        grcb.partition(views, V8, 0)


def test_loads(scan):
    views, _, _ = scan
    cube = ((0.0,) * 3, (1.0,) * 3)
    loads = [grcb.load(views, cube, "medium", m) for m in ("two_dim", "three_dim", "cone")]
    assert all(x > 0 for x in loads) and abs(loads[0] - loads[1]) < 0.1 * loads[0] and loads[2] <= loads[1] + 1e-9
    c = grcb.split_equal_load("low", "two_dim")(views, cube, 0)
    assert 0.3 < c < 0.7
    halves = grcb.split_at(cube, 0.25, 1)
    both = grcb.loads(views, [cube, *halves], "medium", "three_dim")
    assert both[0] == grcb.load(views, cube, "medium", "three_dim") and abs(both[0] - both[1] - both[2]) < 0.05 * both[0]


@pytest.mark.parametrize("box", [((0.0, 0.0, 0.0), (1.0, 1.0, 1.0)), ((0.0, 0.2, 0.1), (0.5, 0.9, 0.4)), ((0.3, 0.0, 0.0), (0.4, 1.0, 1.0))])
def test_adaptive_split(scan, box):
    """The cut that holds still lies near the sample-exact cut of many more samples."""
    views, _, _ = scan
    many = grcb.weighted(grcb.points(views.sparkSession, box, 20_000, 77), views, True).cache()
    for axis in (0, 2):
        exact = grcb.simple_split_rows(many.select(F.col(f"x{axis}").alias("y"), "f", "id"), box[0][axis], box[1][axis], "id")
        assert abs(grcb.split_smart(views, box, axis) - exact) < 0.03 * (box[1][axis] - box[0][axis])
        assert abs(grcb.split_smart(views, box, axis, many) - exact) < 0.001


def test_stop_rule(scan, monkeypatch):
    views, _, _ = scan
    assert not grcb.steady([1.0] * 19, 1e-3, 10) and grcb.steady([1.0] * 20, 1e-3, 10) and grcb.steady([9.0] + [1.0] * 20, 1e-3, 10)
    assert not grcb.steady([1.0] * 15 + [1.1] + [1.0] * 10, 1e-3, 10) and grcb.steady([k * 1e-5 for k in range(30)], 1e-3, 10)
    drawn = []
    monkeypatch.setattr(grcb, "points", lambda spark, v, n, seed, f=grcb.points: drawn.append(n) or f(spark, v, n, seed))
    grcb.split_smart(views, ((0.0,) * 3, (1.0,) * 3), 1, precision="medium", bins=64)
    assert sum(drawn) == grcb.MOST_SAMPLES  # at this precision the limit ends it
    drawn.clear()
    monkeypatch.setitem(grcb.STEADY, "low", (1.0, 10))
    grcb.split_smart(views, ((0.0,) * 3, (1.0,) * 3), 1)
    assert drawn == [2 * 10 * grcb.ROUND]


def test_simple_split():
    assert grcb.simple_split([(0.1, 1.0)] * 5, 0.0, 1.0) == 0.5
    even = [((i + 0.5) / 100, 1.0) for i in range(100)]
    assert abs(grcb.simple_split(even, 0.0, 1.0) - 0.5) < 0.02


def test_exchange(scan, spark):
    views, rays, _ = scan
    parts = trees.parts(spark, trees.boxes({1: (0, 3), 2: (1, 2), 3: (2, 5)}, V8))
    shadow = exchange.shadows(parts, views, V8).cache()
    rows = exchange.contributions(shadow, 6, 6).collect()
    by = {}
    for r in rows:
        by.setdefault((r.view, r.pixel), []).append((r.target, r.owner))
    for (view, pixel), x in by.items():
        who = sorted(t for t, _ in x)
        assert {o for _, o in x} == {who[(view * 36 + pixel) % len(who)]}
    local = exchange.restricted(rays, shadow)
    size = local.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.max("local_line").alias("top"), F.countDistinct("local_line").alias("d")).collect()
    assert all(r.n == r.top + 1 == r.d for r in size)
    both = exchange.overlaps(shadow)
    assert both.filter("a = b").count() == 0 and both.count() == both.select(F.col("b").alias("a"), F.col("a").alias("b"), "view").distinct().count()
    assert exchange.column_shadow(spark.range(5).withColumnRenamed("id", "voxel"), V8, views).count() == 30
    bounds = observe.part_bounds(parts, V8).orderBy("part").first()
    assert bounds.min_0 == 0.0 and bounds.max_0 == 0.5


def test_formats(spark, tmp_path):
    base = 'specifies = "geometry"\ndimension = 3\ntype = "{0}"\n[volume]\nvoxels = [8, 8, 8]\nmin-point = [0.0, 0.0, 0.0]\nmax-point = [1.0, 1.0, 1.0]\n[parameters]\nprojection-count = 4\n'
    detector = "detector-size = [2.0, 2.0]\ndetector-shape = [4, 4]\nsource-position = [-1.0, 0.5, 0.5]\ndetector-position = [2.0, 0.5, 0.5]\ndetector-tilt = [[0.0, 1.0, 0.0], [0.0, 0.0, 1.0]]\nrotations = 2.0\nsource-radius = 1.0\ndetector-radius = 1.0\nsource-arc = 1.0\n"
    for kind in ("parallel", "dual-parallel", "circular-cone-beam", "helical-cone-beam", "laminography", "tomosynthesis"):
        volume, views = formats.read_specification(spark, base.format(kind) + detector, 6)
        assert volume.voxels == (6, 6, 6) and views.count() == 4
    for text in (base.format("spiral"), base.format("parallel").replace("dimension = 3", "dimension = 2"), base.format("parallel").replace('"geometry"', '"volume"')):
        with pytest.raises(ValueError):
            formats.read_specification(spark, text)
    matrix = spark.createDataFrame([(0, 1, 0.5), (0, 1, 0.5), (1, 0, 1.0)], "line long, voxel long, value double")
    formats.write_matrix_market(matrix.repartition(3), 2, 2, f"{tmp_path.as_uri()}/a.mtx")
    head, size, *entries = (tmp_path / "a.mtx").read_text().splitlines()
    assert head.startswith("%%MatrixMarket") and size == "2 2 3" and sorted(entries) == ["1 2 0.5", "1 2 0.5", "2 1 1.0"]
    cells = {("a", "x"): 1, ("b", "y"): "zz"}
    assert "| b |   | zz |" in formats.report(["a", "b"], ["x", "y"], cells) and "tabular" in formats.report(["a"], ["x"], cells, latex=True)
    assert "0.5" in formats.report_frame(matrix.filter("line = 0"), "line", "voxel", "value")
    picture = formats.ascii_plot(spark.createDataFrame([(0, 1.0), (3, 0.25)], "voxel long, value double"), Volume((2, 2)))
    assert picture.split("\n")[0][0] == formats.RAMP[-1] and len(picture.split("\n")) == 2
    assert formats.polygon_wkt([(0, 0), (1, 0), (0, 1)]) == "POLYGON((0 0, 1 0, 0 1, 0 0))" and formats.polygon_svg([[(0, 0), (1, 0), (0, 2)]]).count("polygon") == 1
    views = formats.astra_views(spark, "cone_vec", 4, 5, [[-2, 0, 0, 2, 0, 0, 0, 0.1, 0, 0, 0, 0.2]])
    r = views.first()
    assert (r.n0, r.n1) == (5, 4) and abs(r.a1 - 0.2) < 1e-12
    (tmp_path / "scan_7.tif").write_bytes(b"x")
    assert [(r.view, bytes(r.content)) for r in formats.read_stack(spark, f"{tmp_path}/scan_*.tif").collect()] == [(7, b"x")]


def test_observers(spark):
    matrix = spark.createDataFrame([(0, 0, 1.0), (1, 1, 2.0)], "line long, voxel long, value double")
    seen = []
    run = observe.Reconstructor(matrix, spark.createDataFrame([(0, 1.0), (1, 2.0)], "line long, value double"), 1.0, 2)
    run.observe(lambda image, k: seen.append((k, spark.table("current_image").count())))
    run.run()
    assert seen == [(0, 2), (1, 2)]


def test_slice_requests(spark, tmp_path):
    rows = [(1, "set", 7, 0, 0.5), (2, "set", 8, 1, 0.1), (3, "set", 7, 2, 0.9), (4, "remove", 8, 0, 0.0)]
    schema = "request_id long, kind string, slice_id int, axis int, position double"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/in")
    got = []
    query = observe.serve(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), lambda df: got.append(sorted(map(tuple, df.collect()))))
    query.processAllAvailable()
    query.stop()
    assert got[-1] == [(7, 2, 0.9)]


def test_owners_of_many_parts(spark):
    """Cuts find the same owners as one condition a box, for trees, blocks, gaps and boxes that interlock."""
    v = Volume((9, 8, 7))
    rows = v.grid(spark).collect()
    four = trees.boxes({1: (0, 3), 2: (1, 2), 3: (2, 5)}, v)
    pinwheel = [[(0, 5), (0, 1), (0, 6)], [(6, 8), (0, 5), (0, 6)], [(3, 8), (6, 7), (0, 6)], [(0, 2), (2, 7), (0, 6)], [(3, 5), (2, 5), (0, 6)]]
    assert statistics.cuts(pinwheel) is None and statistics.cuts(four[:3]) is None
    for of in (trees.blocks(v, (3, 4, 2)), trees.blocks(v, (9, 8, 1)), four, four[:3], pinwheel):
        for limit in (0, 1000):
            statistics.EXPRESSION_PARTS, before = limit, statistics.EXPRESSION_PARTS
            try:
                found = v.grid(spark).select("voxel", statistics.owner([F.col(f"i{d}") for d in range(3)], of).alias("part")).collect()
            finally:
                statistics.EXPRESSION_PARTS = before
            got = {r.voxel: r.part for r in found}
            for r in rows:
                want = [k for k, b in enumerate(of) if all(lo <= x <= hi for x, (lo, hi) in zip((r.i0, r.i1, r.i2), b, strict=True))]
                assert got[r.voxel] == (want[0] if want else None)
