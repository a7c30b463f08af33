"""SIRT over parts against SIRT over the whole, what moves, and the matrix by its columns."""

import re

import pytest
from pyspark.sql import functions as F

from rayframe import queries as Q
from rayframe.functions import kernels
from rayframe.model import Volume
from rayframe.operators import distributed, exchange, image, linop, solvers
from rayframe.plans import trees
from rayframe.sources import geometry as G
from rayframe.storage import keep

SF = "/root/testdata/sf0.001"
SPACE = Q.SPACE


@pytest.fixture(scope="module")
def scan(spark):
    views = keep(Q.cone_views(spark, SF), "test-views")
    matrix = keep(kernels.joseph(G.rays(views, 3), SPACE), "test-matrix")
    return views, matrix, keep(linop.forward(matrix, image.phantom(spark, SPACE)), "test-projections")


def values(df):
    return {r.voxel: r.value for r in df.collect()}


@pytest.mark.parametrize("counts", [(2, 1, 1), (2, 2, 1), (6, 4, 3)])
def test_same_image(spark, scan, counts):
    views, matrix, p = scan
    boxes = trees.blocks(SPACE, counts)
    want, rounds, seen = values(solvers.sirt(matrix, p, iterations=2)), [], []
    got = values(distributed.sirt(matrix, p, SPACE, boxes, iterations=2, rounds=rounds, callback=lambda x, k: seen.append((k, x.count()))))
    assert got.keys() == want.keys() and max(abs(got[k] - want[k]) for k in want) < 1e-9
    assert seen == [(0, len(want)), (1, len(want))]
    assert all(r.sent == r.returned > 0 and r.seconds > r.exchange > 0 for r in rounds)
    assert all(set(r.forward) == set(range(len(boxes))) and min(r.forward.values()) >= 0 for r in rounds)
    assert not spark.sql("SHOW TABLES").collect() and spark.conf.get(distributed.CO_PARTITION) == "true"


def test_large_parts_are_sliced(spark, scan, monkeypatch):
    """Parts above the limit go to several tasks, none of which has a whole part; image, values sent and times are as before."""
    _, matrix, p = scan
    boxes = trees.blocks(SPACE, (2, 2, 1))
    made, rounds = [], []
    monkeypatch.setattr(distributed, "SLICE", matrix.count() // 11)
    monkeypatch.setattr(distributed.Parts, "close", lambda self, f=distributed.Parts.close: (made.append((self.n, max(r["count"] for r in self.matrix.groupBy("place").count().collect()))), f(self)))
    got = values(distributed.sirt(matrix, p, SPACE, boxes, iterations=2, rounds=rounds))
    want = values(solvers.sirt(matrix, p, iterations=2))
    assert got.keys() == want.keys() and max(abs(got[k] - want[k]) for k in want) < 1e-9
    assert made[0][0] == 12 and made[0][1] < 0.75 * matrix.count() / 4
    assert all(r.sent == r.returned > 0 and set(r.forward) == {0, 1, 2, 3} for r in rounds)
    assert not spark.sql("SHOW TABLES").collect()


def test_exchange_as_predicted(spark, scan):
    """With owners by shadows, as many values go out and come back as the contributions say."""
    views, matrix, p = scan
    boxes = trees.boxes(Q.FOUR, SPACE)
    contributions = exchange.contributions(exchange.shadows(trees.parts(spark, boxes), views, SPACE), 10, 10)
    predicted = contributions.filter("owner <> target").count()
    rounds = []
    shared = distributed.contributed(contributions, views, 10, 10)
    got = values(distributed.sirt(matrix, p, SPACE, boxes, beta=0.7, iterations=2, shared=shared, rounds=rounds))
    want = values(solvers.sirt(matrix, p, beta=0.7, iterations=2))
    assert max(abs(got[k] - want[k]) for k in want) < 1e-9
    assert [(r.sent, r.returned) for r in rounds] == [(predicted, predicted)] * 2


def test_nothing_else_moves(spark, scan):
    _, matrix, _ = scan
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    parts = distributed.Parts(matrix, SPACE, trees.blocks(SPACE, (2, 2, 1)))
    try:
        with distributed.co_partitioned(spark):
            x = parts.put(parts.matrix.select("place", "voxel").distinct().withColumn("value", F.lit(1.0)), "image")
            q = parts.product(x, "voxel", "line")
            assert "Exchange" not in q._jdf.queryExecution().executedPlan().toString()
            local = parts.put(parts.lines.join(q, ["place", "line"], "left").select("place", "line", "owner", F.coalesce("value", F.lit(0.0)).alias("value")), "local")
            plan = parts.exchanged(local)._jdf.queryExecution().executedPlan().toString()
            assert set(re.findall(r"Exchange \w+\((\w+)#", plan)) == {"place"} and "ENSURE_REQUIREMENTS" not in plan
            files = [r.n for r in parts.matrix.groupBy(F.input_file_name().alias("f")).agg(F.countDistinct("place").alias("n")).collect()]
            assert files == [1] * 4
    finally:
        parts.close()
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_odd_systems(spark):
    """Lines without elements, elements without a measurement, repeated elements, rows of zero weight, voxels of no box."""
    v = Volume((4, 1, 1))
    a = spark.createDataFrame([(0, 0, 1.0), (0, 0, 0.5), (0, 3, 2.0), (1, 1, 1.0), (1, 2, -1.0), (2, 2, 3.0)], "line long, voxel long, value double")
    p = spark.createDataFrame([(0, 2.0), (1, 1.0), (9, 5.0)], "line long, value double")
    for iterations in (0, 1, 3):
        got = values(distributed.sirt(a, p, v, trees.blocks(v, (2, 1, 1)), iterations=iterations))
        want = values(solvers.sirt(a, p, iterations=iterations))
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    part = values(distributed.sirt(a, p, v, [[(0, 1), (0, 0), (0, 0)]], iterations=2))
    inside = values(solvers.sirt(a.where("voxel < 2"), p, iterations=2))
    assert part.keys() == inside.keys() and all(abs(part[k] - inside[k]) < 1e-12 for k in inside)
    assert distributed.sirt(a.limit(0), p, v, trees.blocks(v, (2, 1, 1)), iterations=1).count() == 0


def test_places(spark):
    for n in (1, 7, 200):
        found = distributed.places(spark, n)
        at = spark.createDataFrame([(x,) for x in found], "place int").select(F.pmod(F.hash("place"), F.lit(n))).collect()
        assert [r[0] for r in at] == list(range(n))


def test_columns(spark, scan):
    """Wherever the kernel has an element, the column has it with the same value; the rest of a shadow is there too."""
    views, matrix, p = scan
    column = keep(exchange.columns(spark.range(SPACE.cells).withColumnRenamed("id", "voxel"), SPACE, views), "test-columns")
    joined = matrix.where("value > 1e-9").alias("a").join(column.alias("c"), ["line", "voxel"], "left").select("line", "voxel", F.col("a.value").alias("a"), F.col("c.value").alias("c"))
    assert joined.filter("c IS NULL OR abs(a - c) > 1e-9").count() == 0
    assert column.groupBy("line", "voxel").count().filter("count > 1").count() == 0 and column.filter("value = 0").count() > 0
    # Column action over the columns, and over those of their elements that the kernel has.
    a = column.join(matrix.where("value > 0").select("line", "voxel"), ["line", "voxel"], "left_semi")
    block = F.floor(F.col("voxel") / 600)
    one, two = (values(solvers.column_action_block(m, p, block, sweeps=1)) for m in (a, matrix.where("value > 0")))
    assert one.keys() == two.keys() and max(abs(one[k] - two[k]) for k in one) < 1e-9
    assert values(solvers.column_action_block(column, p, block, sweeps=1)).keys() >= one.keys()


def test_measure_tool(spark, tmp_path, capsys):
    from rayframe import tools

    boxes = trees.blocks(SPACE, (2, 1, 1))
    found, times = tools.measured(Q.cone_views(spark, SF), SPACE, boxes, 1)
    assert found.count() > 0 and list(times) == ["", " (com)", " (avg fp)", " (max fp)", " (avg eps)"]
