"""The engine's operators as queries over the test tables, with SQL for those that SQL can express.

The tables stand in for what a scanner delivers: ``lineitem`` as a sparse matrix, as projections and as an integer
volume, ``nation`` as a list of views, ``embeddings`` as 8 by 8 images, ``events`` as a stream of requests.
"""

from __future__ import annotations

from collections.abc import Callable
from math import pi

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import kernels
from .functions import vec as V
from .model import Volume
from .operators import distributed, exchange, image, linop, solvers
from .plans import bisection, grcb, statistics, trees
from .sources import geometry as G
from .sources import scan
from .storage import keep, shared_dir
from .streaming import observe

LINES, CELLS, TURN = 500, 200, 0.123
#: quantity, discount and tax of line items as whole numbers.
GOODS = Volume((50, 11, 9))
PLANE, IMAGE = Volume.cube(16, 2), Volume.cube(8, 2)
SPACE = Volume.cube(12)
#: A tree of four parts of GOODS.
TREE: trees.Tree = {1: (0, 24), 2: (1, 5), 3: (2, 3)}
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").groupBy((F.col("l_orderkey") % LINES).alias("line"), (F.col("l_partkey") % CELLS).alias("voxel"))
    return rows.agg(F.sum("l_quantity").alias("value"))


def measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy((F.col("l_orderkey") % LINES).alias("line")).agg(F.sum("l_linenumber").cast("double").alias("value"))


def picture(spark: SparkSession, sf_dir: str, column: str = "l_quantity", by: str = "l_partkey", n: int = CELLS) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy((F.col(by) % n).alias("voxel")).agg(F.sum(column).cast("double").alias("value"))


def goods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """line, i0, i1, i2, voxel of every line item."""
    i = [F.round("l_quantity").cast("long") - 1, F.round(F.col("l_discount") * 100).cast("long"), F.round(F.col("l_tax") * 100).cast("long")]
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("line"), *V.named(i, "i"))
    return rows.withColumn("voxel", GOODS.index(V.cols("i", 3)))


def goods_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.voxel_weights(goods(spark, sf_dir))


def nation_views(spark: SparkSession, sf_dir: str, angle: Column | None = None) -> DataFrame:
    rows = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("view"))
    return rows.withColumn("angle", F.col("view") * F.lit(pi / 25) + F.lit(TURN) if angle is None else angle)


def plane_rays(spark: SparkSession, sf_dir: str, volume: Volume = PLANE) -> DataFrame:
    return G.rays(G.parallel(nation_views(spark, sf_dir), volume, 25), 2)


def cone_rays(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.rays(cone_views(spark, sf_dir), 3)


def cone_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.cone_beam(nation_views(spark, sf_dir, full_turn()), SPACE, 25, (2.0, 2.0), (10, 10), 2.0, 1.5)


def rounded(df: DataFrame, *keys: str, digits: int = 6) -> DataFrame:
    """Values to so many digits; + 0.0 makes a negative zero positive."""
    return df.select(*keys, *[(F.round(c, digits) + F.lit(0.0)).alias(c) for c in df.columns if c not in keys])


A = f"a AS (SELECT l_orderkey % {LINES} AS line, l_partkey % {CELLS} AS voxel, sum(l_quantity) AS value FROM lineitem GROUP BY 1, 2)"
P = f"p AS (SELECT l_orderkey % {LINES} AS line, CAST(sum(l_linenumber) AS DOUBLE) AS value FROM lineitem GROUP BY 1)"
FIG = f"f AS (SELECT l_partkey % {CELLS} AS voxel, sum(l_quantity) AS value FROM lineitem GROUP BY 1)"
GOODS_SQL = "g AS (SELECT l_orderkey AS line, CAST(round(l_quantity) AS BIGINT) - 1 AS i0, CAST(round(l_discount * 100) AS BIGINT) AS i1, CAST(round(l_tax * 100) AS BIGINT) AS i2 FROM lineitem), v AS (SELECT *, i0 + 50 * (i1 + 11 * i2) AS voxel FROM g)"


# Numbering


@query(f"WITH {GOODS_SQL} SELECT voxel, i0, i1, i2, count(*) AS n FROM v GROUP BY ALL")
def voxel_index(spark, sf_dir):
    return goods(spark, sf_dir).groupBy("voxel", "i0", "i1", "i2").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {GOODS_SQL} SELECT DISTINCT voxel, i0 AS u0, i1 AS u1, i2 AS u2 FROM v")
def voxel_unroll(spark, sf_dir):
    return goods(spark, sf_dir).select("voxel").distinct().select("voxel", *V.named(GOODS.unroll(F.col("voxel")), "u"))


@query("SELECT n_nationkey AS view, CAST(coalesce(sum((1 + n_nationkey % 3) * (2 + n_regionkey)) OVER (ORDER BY n_nationkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first FROM nation")
def view_offsets(spark, sf_dir):
    rows = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("view"), (1 + F.col("n_nationkey") % 3).alias("n0"), (2 + F.col("n_regionkey")).alias("n1"))
    return G.offsets(rows)


# Products and sums


@query(f"WITH {A}, {FIG} SELECT line, sum(a.value * f.value) AS value FROM a JOIN f USING (voxel) GROUP BY line")
def forward_projection(spark, sf_dir):
    return linop.forward(matrix(spark, sf_dir), picture(spark, sf_dir))


@query(f"WITH {A}, {P} SELECT voxel, sum(a.value * p.value) AS value FROM a JOIN p USING (line) GROUP BY voxel")
def back_projection(spark, sf_dir):
    return linop.back(matrix(spark, sf_dir), measured(spark, sf_dir))


@query(f"WITH {A} SELECT line, sum(value) AS value FROM a GROUP BY line")
def row_sums(spark, sf_dir):
    return linop.row_sums(matrix(spark, sf_dir))


@query(f"WITH {A} SELECT voxel, sum(value) AS value FROM a GROUP BY voxel")
def column_sums(spark, sf_dir):
    return linop.column_sums(matrix(spark, sf_dir))


@query(f"WITH {A} SELECT line, sum(value * value) AS value FROM a GROUP BY line")
def square_norms(spark, sf_dir):
    return linop.square_norms(matrix(spark, sf_dir))


@query(f"WITH {A} SELECT line + 1 AS row, voxel + 1 AS col, value FROM a")
def matrix_market_entries(spark, sf_dir):
    return linop.matrix_market(matrix(spark, sf_dir), LINES, CELLS)[1]


# Solvers


def _iterations(k: int, beta: float, weighted: bool, tables: str = f"{A}, {P}") -> str:
    """SIRT or Landweber as nested common table expressions."""
    r = "CASE WHEN abs(s) > 1e-5 THEN 1.0 / s ELSE 0 END" if weighted else "1.0"
    c = f"CASE WHEN abs(s) > 1e-5 THEN {beta!r} / s ELSE 0 END" if weighted else repr(beta)
    out = f"WITH {tables}, r AS (SELECT line, {r} AS w FROM (SELECT line, sum(value) AS s FROM a GROUP BY line)), c AS (SELECT voxel, {c} AS w FROM (SELECT voxel, sum(value) AS s FROM a GROUP BY voxel)), x0 AS (SELECT DISTINCT voxel, 0.0::DOUBLE AS value FROM a)"
    for i in range(k):
        out += f", s{i} AS (SELECT line, (p.value - coalesce(q.value, 0)) * r.w AS value FROM p JOIN r USING (line) LEFT JOIN (SELECT line, sum(a.value * x{i}.value) AS value FROM a JOIN x{i} USING (voxel) GROUP BY line) q USING (line))"
        out += f", x{i + 1} AS (SELECT voxel, x{i}.value + c.w * b.value AS value FROM x{i} JOIN c USING (voxel) JOIN (SELECT voxel, sum(a.value * s{i}.value) AS value FROM a JOIN s{i} USING (line) GROUP BY voxel) b USING (voxel))"
    return out + f" SELECT voxel, round(value, 6) + 0.0 AS value FROM x{k}"


@query(_iterations(3, 1.0, True))
def sirt(spark, sf_dir):
    return rounded(solvers.sirt(matrix(spark, sf_dir), measured(spark, sf_dir), iterations=3), "voxel")


ORDERS = f"{GOODS_SQL}, a AS (SELECT line, voxel, CAST(count(*) AS DOUBLE) AS value FROM v GROUP BY ALL), p AS (SELECT l_orderkey AS line, CAST(sum(l_linenumber) AS DOUBLE) AS value FROM lineitem GROUP BY 1)"


@query(_iterations(2, 1.0, True, ORDERS))
def sirt_of_parts(spark, sf_dir):
    """Orders as lines through the four parts of GOODS: local products and an exchange of shared lines."""
    a = goods(spark, sf_dir).groupBy("line", "voxel").agg(F.count(F.lit(1)).cast("double").alias("value"))
    p = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("line")).agg(F.sum("l_linenumber").cast("double").alias("value"))
    return rounded(distributed.sirt(a, p, GOODS, trees.boxes(TREE, GOODS), iterations=2), "voxel")


@query(_iterations(2, 1e-9, False))
def landweber(spark, sf_dir):
    return rounded(solvers.landweber(matrix(spark, sf_dir), measured(spark, sf_dir), beta=1e-9, iterations=2), "voxel")


def _cgls(weighted: bool) -> str:
    """Two steps of conjugate gradients on the normal equations."""
    w = "CASE WHEN abs(s) > 1e-5 THEN 1.0 / s ELSE 0 END" if weighted else "1.0"
    out = f"WITH {A}, {P}, c AS (SELECT voxel, {w} AS w FROM (SELECT voxel, sum(value) AS s FROM a GROUP BY voxel)), d0 AS (SELECT * FROM p)"
    for i in range(3):
        out += f", r{i} AS (SELECT voxel, sum(a.value * d{i}.value) AS value FROM a JOIN d{i} USING (line) GROUP BY voxel), z{i} AS (SELECT voxel, value * w AS value FROM r{i} JOIN c USING (voxel)), g{i} AS (SELECT sum(z.value * r.value) AS v FROM z{i} z JOIN r{i} r USING (voxel))"
        if i:
            out += f", p{i} AS (SELECT voxel, z.value + q.value * (SELECT v FROM g{i}) / (SELECT v FROM g{i - 1}) AS value FROM z{i} z JOIN p{i - 1} q USING (voxel))"
        else:
            out += ", p0 AS (SELECT * FROM z0)"
        out += f", t{i} AS (SELECT line, sum(a.value * q.value) AS value FROM a JOIN p{i} q USING (voxel) GROUP BY line), e{i} AS (SELECT (SELECT v FROM g{i}) / sum(value * value) AS v FROM t{i})"
        out += f", d{i + 1} AS (SELECT line, d{i}.value - t{i}.value * (SELECT v FROM e{i}) AS value FROM d{i} JOIN t{i} USING (line))"
    return out + " SELECT voxel, round(p0.value * (SELECT v FROM e0) + p1.value * (SELECT v FROM e1), 6) + 0.0 AS value FROM p0 JOIN p1 USING (voxel)"


@query(_cgls(False))
def cgls(spark, sf_dir):
    return rounded(solvers.cgls(matrix(spark, sf_dir), measured(spark, sf_dir), iterations=2), "voxel")


@query(_cgls(True))
def cgls_preconditioned(spark, sf_dir):
    return rounded(solvers.cgls2(matrix(spark, sf_dir), measured(spark, sf_dir), iterations=2), "voxel")


@query(
    f"WITH {A}, {P}, q0 AS (SELECT voxel, sum(a.value * p.value) AS value FROM a JOIN p USING (line) GROUP BY voxel), e0 AS (SELECT (SELECT sum(value * value) FROM p) / sum(value * value) AS v FROM q0), "
    "r1 AS (SELECT line, p.value - (SELECT v FROM e0) * t.value AS value FROM p JOIN (SELECT line, sum(a.value * q0.value) AS value FROM a JOIN q0 USING (voxel) GROUP BY line) t USING (line)), "
    "p1 AS (SELECT line, r1.value + p.value * (SELECT sum(value * value) FROM r1) / (SELECT sum(value * value) FROM p) AS value FROM r1 JOIN p USING (line)), "
    "q1 AS (SELECT voxel, sum(a.value * p1.value) AS value FROM a JOIN p1 USING (line) GROUP BY voxel), e1 AS (SELECT (SELECT sum(value * value) FROM r1) / sum(value * value) AS v FROM q1) "
    "SELECT voxel, round(q0.value * (SELECT v FROM e0) + q1.value * (SELECT v FROM e1), 6) + 0.0 AS value FROM q0 JOIN q1 USING (voxel)"
)
def cg(spark, sf_dir):
    return rounded(solvers.cg(matrix(spark, sf_dir), measured(spark, sf_dir), iterations=2), "voxel")


@query(
    f"WITH {A}, {P}, n AS (SELECT line, sum(value * value) AS norm FROM a GROUP BY line), s AS (SELECT line, 0.5 * p.value / norm AS value FROM p JOIN n USING (line) WHERE norm > 1e-5 AND line < {LINES // 2}) "
    "SELECT voxel, round(sum(a.value * s.value), 6) + 0.0 AS value FROM a JOIN s USING (line) GROUP BY voxel"
)
def sart(spark, sf_dir):
    """Two blocks, one iteration: the second block's update is not committed."""
    return rounded(solvers.sart(matrix(spark, sf_dir), measured(spark, sf_dir), F.floor(F.col("line") / (LINES // 2)), iterations=1), "voxel")


@query(
    f"WITH {A}, {P}, b AS (SELECT *, line // {LINES // 2} AS block FROM a), l0 AS (SELECT * FROM p WHERE line < {LINES // 2}), q0 AS (SELECT voxel, sum(b.value * l0.value) AS value FROM b JOIN l0 USING (line) GROUP BY voxel), "
    "f0 AS (SELECT voxel, value * (SELECT sum(value * value) FROM l0) / (SELECT sum(value * value) FROM q0) AS value FROM q0), "
    f"l1 AS (SELECT line, p.value - coalesce(t.value, 0) AS value FROM p LEFT JOIN (SELECT line, sum(b.value * f0.value) AS value FROM b JOIN f0 USING (voxel) WHERE block = 1 GROUP BY line) t USING (line) WHERE line >= {LINES // 2}), "
    "q1 AS (SELECT voxel, sum(b.value * l1.value) AS value FROM b JOIN l1 USING (line) GROUP BY voxel), k AS (SELECT (SELECT sum(value * value) FROM l1) / (SELECT sum(value * value) FROM q1) AS v) "
    "SELECT voxel, round(coalesce(f0.value, 0) + coalesce(q1.value, 0) * (SELECT v FROM k), 6) + 0.0 AS value FROM f0 FULL JOIN q1 USING (voxel)"
)
def sart_cg(spark, sf_dir):
    return rounded(solvers.sart_cg(matrix(spark, sf_dir), measured(spark, sf_dir), F.floor(F.col("line") / (LINES // 2)), iterations=1), "voxel")


@query(
    f"WITH {A}, {P}, n AS (SELECT voxel, sum(value * value) AS norm FROM a GROUP BY voxel), x0 AS (SELECT voxel, 0.5 * sum(a.value * p.value) / any_value(norm) AS value FROM a JOIN p USING (line) JOIN n USING (voxel) WHERE voxel < {CELLS // 2} GROUP BY voxel), "
    "r AS (SELECT line, p.value - coalesce(t.value, 0) AS value FROM p LEFT JOIN (SELECT line, sum(a.value * x0.value) AS value FROM a JOIN x0 USING (voxel) GROUP BY line) t USING (line)), "
    f"x1 AS (SELECT voxel, 0.5 * sum(a.value * r.value) / any_value(norm) AS value FROM a JOIN r USING (line) JOIN n USING (voxel) WHERE voxel >= {CELLS // 2} GROUP BY voxel) "
    "SELECT voxel, round(value, 6) + 0.0 AS value FROM (SELECT * FROM x0 UNION ALL SELECT * FROM x1)"
)
def column_action_block(spark, sf_dir):
    return rounded(solvers.column_action_block(matrix(spark, sf_dir), measured(spark, sf_dir), F.floor(F.col("voxel") / (CELLS // 2)), sweeps=1), "voxel")


def _blocks_sql(iterations: int, blocks: int, conjugate: bool) -> str:
    """SART, or SART by conjugate gradients, over consecutive blocks of lines, as nested common table expressions."""
    size = -(-LINES // blocks)
    out = f"WITH {A}, {P}, n AS (SELECT line, sum(value * value) AS norm FROM a GROUP BY line), b AS (SELECT *, line // {size} AS block FROM a), x0 AS (SELECT DISTINCT voxel, 0.0::DOUBLE AS value FROM a)"
    held, now = 0, 0  # the image that rows read, and the one with all updates
    for _ in range(iterations):
        for k in range(blocks):
            if k or conjugate:
                held = now
            weight = "1.0" if conjugate else "0.5 / norm"
            out += f", l{now} AS (SELECT line, (p.value - coalesce(t.value, 0)) * {weight} AS value FROM p JOIN n USING (line) LEFT JOIN (SELECT line, sum(b.value * x{held}.value) AS value FROM b JOIN x{held} USING (voxel) WHERE block = {k} GROUP BY line) t USING (line) WHERE line // {size} = {k})"
            out += f", q{now} AS (SELECT voxel, sum(b.value * l{now}.value) AS value FROM b JOIN l{now} USING (line) GROUP BY voxel)"
            step = f"(SELECT sum(value * value) FROM l{now}) / (SELECT sum(value * value) FROM q{now})" if conjugate else "1.0"
            out += f", x{now + 1} AS (SELECT voxel, x{now}.value + coalesce(q{now}.value, 0) * {step} AS value FROM x{now} LEFT JOIN q{now} USING (voxel))"
            now += 1
    return out + f" SELECT voxel, round(value, 6) + 0.0 AS value FROM x{now if conjugate else held}"


def _third(c: str, n: int) -> Column:
    return F.floor(F.col(c) / (-(-n // 3)))


@query(_blocks_sql(2, 3, False))
def sart_three_blocks(spark, sf_dir):
    """Two iterations over three blocks: an update is committed when the next block begins, and not between iterations."""
    return rounded(solvers.sart(matrix(spark, sf_dir), measured(spark, sf_dir), _third("line", LINES), iterations=2), "voxel")


@query(_blocks_sql(2, 3, True))
def sart_cg_three_blocks(spark, sf_dir):
    return rounded(solvers.sart_cg(matrix(spark, sf_dir), measured(spark, sf_dir), _third("line", LINES), iterations=2), "voxel")


def _rows_in_turn_sql(iterations: int) -> str:
    """Row action: a fold over dense rows, each followed by its measurement and its square norm."""
    dense = f"c AS (SELECT line, list(coalesce(value, 0) ORDER BY voxel) AS v FROM (SELECT * FROM range({LINES}) i(line), range({CELLS}) j(voxel)) LEFT JOIN a USING (line, voxel) GROUP BY line), w AS (SELECT list(list_concat(v, [p.value, list_inner_product(v, v)]) ORDER BY line) AS rows FROM c JOIN p USING (line))"
    step = f"list_transform(list_zip(x[:{CELLS}], r[:{CELLS}], list_resize([]::DOUBLE[], {CELLS}, (r[{CELLS + 1}] - list_inner_product(x[:{CELLS}], r[:{CELLS}])) / r[{CELLS + 2}] * 0.5)), lambda e: e[1] + e[2] * e[3])"
    every = ", ".join(["rows"] * iterations)
    return f"WITH {A}, {P}, {dense}, s AS (SELECT list_reduce(list_concat([list_resize([]::DOUBLE[], {CELLS}, 0.0::DOUBLE)], {every}), lambda x, r: {step}) AS x FROM w) SELECT j - 1 AS voxel, round(x[j], 6) + 0.0 AS value FROM s, range(1, {CELLS + 1}) t(j)"


def _columns_in_turn_sql(order: str, steps: int) -> str:
    """Column action: step by step, with the residual as a list."""
    dense = f"c AS (SELECT voxel, list(coalesce(value, 0) ORDER BY line) AS v FROM (SELECT * FROM range({CELLS}) i(voxel), range({LINES}) j(line)) LEFT JOIN a USING (line, voxel) GROUP BY voxel), w AS (SELECT voxel AS k, v, list_inner_product(v, v) AS size FROM c)"
    first = f"SELECT 0 AS i, (SELECT list(value ORDER BY line) FROM p) AS x, list_resize([]::DOUBLE[], {CELLS}, 0.0::DOUBLE) AS f"
    return f"WITH RECURSIVE {A}, {P}, {dense}, s AS ({first} UNION ALL SELECT i + 1, list_transform(list_zip(x, v), lambda e: e[1] - d * e[2]), list_transform(list_zip(f, range({CELLS})), lambda e: e[1] + CASE WHEN e[2] = k THEN d ELSE 0 END) FROM (SELECT s.i, s.x, s.f, w.v, w.k, 0.5 * list_inner_product(v, x) / size AS d FROM s JOIN w ON w.k = {order} WHERE s.i < {steps})) SELECT j - 1 AS voxel, round(f[j], 6) + 0.0 AS value FROM s, range(1, {CELLS + 1}) t(j) WHERE i = {steps}"


@query(_rows_in_turn_sql(3))
def art(spark, sf_dir):
    return rounded(solvers.art(matrix(spark, sf_dir), measured(spark, sf_dir), iterations=3), "voxel")


@query(_columns_in_turn_sql(f"CASE WHEN s.i < {CELLS} THEN s.i ELSE {2 * CELLS - 1} - s.i END", 2 * CELLS))
def column_action_cyclic(spark, sf_dir):
    return rounded(solvers.column_action_cyclic(matrix(spark, sf_dir), measured(spark, sf_dir), sweeps=2, order="back-forth"), "voxel")


@query()
def truncated_svd(spark, sf_dir):
    return solvers.truncated_svd(matrix(spark, sf_dir), 3)[2]


@query(
    "SELECT l_orderkey AS line, CAST(v.k AS INT) AS voxel, round(sum(CASE v.k WHEN 0 THEN l_quantity WHEN 1 THEN l_extendedprice WHEN 2 THEN l_discount ELSE l_tax END), 4) AS value FROM lineitem, range(4) AS v(k) GROUP BY l_orderkey, v.k"
)
def svd_products(spark, sf_dir):
    """Four sums of each order, put together again from their whole decomposition."""
    names = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
    sums = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("line")).agg(*[F.sum(c).alias(c) for c in names])
    a = sums.select("line", F.posexplode(F.array(*names)).alias("voxel", "value"))
    return solvers.low_rank(a, *solvers.truncated_svd(a, 4, oversample=0)).withColumn("value", F.round("value", 4))


# Images


SECOND = "s AS (SELECT l_suppkey % 100 AS voxel, CAST(sum(l_linenumber) AS DOUBLE) AS value FROM lineitem GROUP BY 1)"


def _pair(op: str) -> str:
    y = "coalesce(s.value, 0)"
    expression = f"coalesce(f.value, 0) / nullif({y}, 0)" if op == "/" else f"coalesce(f.value, 0) {op} {y}"
    return f"WITH {FIG}, {SECOND} SELECT voxel, {expression} AS value FROM f FULL JOIN s USING (voxel)"


def _two(spark, sf_dir, op):
    return image.elementwise(picture(spark, sf_dir), picture(spark, sf_dir, "l_linenumber", "l_suppkey", 100), op)


@query(_pair("+"))
def image_add(spark, sf_dir):
    return _two(spark, sf_dir, "+")


@query(_pair("-"))
def image_subtract(spark, sf_dir):
    return _two(spark, sf_dir, "-")


@query(_pair("*"))
def image_multiply(spark, sf_dir):
    return _two(spark, sf_dir, "*")


@query(_pair("/"))
def image_divide(spark, sf_dir):
    return _two(spark, sf_dir, "/")


@query(f"WITH {FIG} SELECT voxel, round(-ln(value) * 2.5, 6) AS value FROM f")
def image_scalar_log(spark, sf_dir):
    return rounded(image.mapped(picture(spark, sf_dir), lambda v: -F.ln(v) * 2.5), "voxel")


@query(f"WITH {FIG} SELECT voxel, least(greatest(value, 1000.0), 8000.0) AS value FROM f")
def image_clamp(spark, sf_dir):
    return image.clamped(picture(spark, sf_dir), 1000.0, 8000.0)


@query(f"WITH {FIG}, {SECOND} SELECT sum(abs(d)) AS l1, round(sqrt(sum(d * d)), 6) AS l2 FROM (SELECT coalesce(f.value, 0) - coalesce(s.value, 0) AS d FROM f FULL JOIN s USING (voxel))")
def image_errors(spark, sf_dir):
    return rounded(image.errors(picture(spark, sf_dir), picture(spark, sf_dir, "l_linenumber", "l_suppkey", 100)), "l1")


@query(f"WITH {FIG} SELECT round(sqrt(sum(value * value)), 6) AS norm, sum(value) AS total, min(value) AS min_value, max(value) AS max_value FROM f")
def image_summary(spark, sf_dir):
    return rounded(image.summary(picture(spark, sf_dir)), "total", "min_value", "max_value")


@query(f"WITH {P} SELECT * FROM p WHERE line // 20 <> 3 UNION ALL SELECT line, -value AS value FROM p WHERE line // 20 = 3")
def replace_view(spark, sf_dir):
    p = measured(spark, sf_dir)
    return image.with_view(p, image.mapped(p.filter(F.floor(F.col("line") / 20) == 3), lambda v: -v))


@query(f"WITH {GOODS_SQL} SELECT i0 + 50 * i2 AS voxel, CAST(count(*) AS DOUBLE) AS value FROM v WHERE i1 = 4 GROUP BY 1")
def slice_axis(spark, sf_dir):
    return image.sliced(goods_weights(spark, sf_dir), GOODS, 1, 4)


@query(f"WITH {GOODS_SQL} SELECT (i0 // 5) + 10 * ((i1 // 2) + 5 * (i2 // 3)) AS voxel, CAST(count(*) AS DOUBLE) AS value FROM v WHERE i0 % 5 = 0 AND i1 % 2 = 0 AND i1 < 10 AND i2 % 3 = 0 GROUP BY 1")
def downscale(spark, sf_dir):
    return image.downscaled(goods_weights(spark, sf_dir), GOODS, (10, 5, 3))


@query(f"WITH {GOODS_SQL} SELECT (i0 * 10 // 50) + 10 * ((i1 * 5 // 11) + 5 * (i2 * 3 // 9)) AS voxel, round(count(*) * (150.0 / 4950), 6) AS value FROM v GROUP BY 1")
def downscale_accumulated(spark, sf_dir):
    return rounded(image.downscaled(goods_weights(spark, sf_dir), GOODS, (10, 5, 3), accumulate=True), "voxel")


@query(
    f"WITH {GOODS_SQL}, w AS (SELECT voxel, CAST(count(*) AS DOUBLE) AS value FROM v GROUP BY 1), q AS (SELECT r % 20 AS x, r // 20 AS y FROM range(400) t(r)), "
    "c AS (SELECT x, y, floor((-0.813 + x / 20.0 * 1.2 + y / 20.0 * 0.1 + 1) * 25) AS i, floor((-0.71 + x / 20.0 * 0.2 + y / 20.0 * 1.1 + 1) * 5.5) AS j, floor((-0.37 + x / 20.0 * 0.3 + y / 20.0 * 0.5 + 1) * 4.5) AS k FROM q) "
    "SELECT x, y, coalesce(value, 0) AS value FROM c LEFT JOIN w ON w.voxel = i + 50 * (j + 11 * k) AND i BETWEEN 0 AND 49 AND j BETWEEN 0 AND 10 AND k BETWEEN 0 AND 8"
)
def slice_oblique(spark, sf_dir):
    return image.oblique_slice(goods_weights(spark, sf_dir), GOODS, (-0.813, -0.71, -0.37), (1.2, 0.2, 0.3), (0.1, 1.1, 0.5), 20)


def _named_voxels(n: int) -> str:
    return f"SELECT DISTINCT (l_orderkey * 7 + l_partkey * 31) % {n} FROM lineitem"


def named_voxels(spark, sf_dir, n: int) -> DataFrame:
    """The voxels below ``n`` that line items name."""
    return table(spark, sf_dir, "lineitem").select(((F.col("l_orderkey") * 7 + F.col("l_partkey") * 31) % n).alias("voxel")).distinct()


def _phantom_sql(dim: int, n: int) -> str:
    from math import cos, sin

    total = []
    if dim == 2:
        for value, a, b, x0, y0, angle in image.MODIFIED:
            co, si = cos(angle * pi / 180), sin(angle * pi / 180)
            r = f"pow((x - {x0!r}) * {co!r} + (y - {y0!r}) * {si!r}, 2) / {a * a!r} + pow((y - {y0!r}) * {co!r} - (x - {x0!r}) * {si!r}, 2) / {b * b!r}"
            total.append(f"CASE WHEN {r} <= 1.0 THEN {value!r}::DOUBLE ELSE 0 END")
    else:
        for value, a, b, c, x0, y0, z0, angle, _, _ in image.MODIFIED_SPACE:
            co, si = cos(angle * pi / 180), sin(angle * pi / 180)
            r = f"pow(((x - {x0!r}) * {co!r} + (z - {z0!r}) * {si!r}) / {a!r}, 2) + pow((y - {y0!r}) / {b!r}, 2) + pow(((z - {z0!r}) * {co!r} - (x - {x0!r}) * {si!r}) / {c!r}, 2)"
            total.append(f"CASE WHEN {r} <= 1.0 THEN {value!r}::DOUBLE ELSE 0 END")
    z = f", 2.0 * (r // {n * n}) / {n} - 1 AS z" if dim == 3 else ""
    return f"SELECT r AS voxel, round({' + '.join(total)}, 6) + 0.0 AS value FROM (SELECT r, 2.0 * (r % {n}) / {n} - 1 AS x, 2.0 * ((r // {n}) % {n}) / {n} - 1 AS y{z} FROM ({_named_voxels(n**dim)}) t(r))"


@query(_phantom_sql(2, 61))
def phantom_plane(spark, sf_dir):
    return rounded(image.phantom(spark, Volume.cube(61, 2), voxels=named_voxels(spark, sf_dir, 61**2)), "voxel")


@query(_phantom_sql(3, 23))
def phantom_space(spark, sf_dir):
    return rounded(image.phantom(spark, Volume.cube(23), voxels=named_voxels(spark, sf_dir, 23**3)), "voxel")


# Geometries


def _rays_sql(views: str, n0: int, n1: int, dim: int, parallel: bool) -> str:
    """Rays of a table ``w`` with view, s0.., c0.., a0.., b0..."""
    at = [f"c{d} + (i + 0.5) * a{d}" + (f" + (j + 0.5) * b{d}" if dim == 3 else "") for d in range(dim)]
    source = [f"s{d} + {at[d]} - c{d}" if parallel else f"s{d}" for d in range(dim)]
    out = ", ".join(f"round({x}, 6) + 0.0 AS {n}{d}" for n, xs in (("s", source), ("d", at)) for d, x in enumerate(xs))
    return f"WITH {views} SELECT CAST(view AS BIGINT) * {n0 * n1} + i + {n0} * j AS line, {out} FROM w, range({n0}) p(i), range({n1}) q(j)"


def _turned(x: tuple[str, str, str], axis: int, angle: str = "t") -> list[str]:
    a, b = (axis + 1) % 3, (axis + 2) % 3
    out = list(x)
    out[a], out[b] = f"({x[a]}) * cos({angle}) - ({x[b]}) * sin({angle})", f"({x[a]}) * sin({angle}) + ({x[b]}) * cos({angle})"
    return out


def _trajectory_sql(angle: str, source: list[str], detector: list[str], tilt: list[list[str]], size: float = 2.0, n: int = 4) -> str:
    named = ", ".join([*[f"{x} AS s{d}" for d, x in enumerate(source)], *[f"{x} AS m{d}" for d, x in enumerate(detector)], *[f"{x} AS {e}{d}" for e, t in zip("uv", tilt, strict=True) for d, x in enumerate(t)]])
    views = f"k AS (SELECT n_nationkey AS view, {angle} AS t FROM nation), m AS (SELECT view, {named} FROM k)"
    views += ", w AS (SELECT view, s0, s1, s2, " + ", ".join(f"m{d} - {size / 2} * (u{d} + v{d}) AS c{d}, u{d} * {size / n} AS a{d}, v{d} * {size / n} AS b{d}" for d in range(3)) + " FROM m)"
    return _rays_sql(views, n, n, 3, False)


def _ray_rows(views: DataFrame, dim: int = 3) -> DataFrame:
    return rounded(G.rays(views, dim).drop("view", "p0", "p1"), "line")


FULL = f"n_nationkey * (2 * pi() / 25) + {TURN}"


def full_turn() -> Column:
    return F.col("view") * F.lit(2 * pi / 25) + F.lit(TURN)


@query(
    _rays_sql(
        f"k AS (SELECT n_nationkey AS view, n_nationkey * (pi() / 25) + {TURN} AS t FROM nation), w AS (SELECT view, 0.5 - 2 * cos(t) + 0.5 * sin(t) AS s0, 0.5 - 2 * sin(t) - 0.5 * cos(t) AS s1, 0.5 + 2 * cos(t) + 0.5 * sin(t) AS c0, 0.5 + 2 * sin(t) - 0.5 * cos(t) AS c1, -sin(t) / 16 AS a0, cos(t) / 16 AS a1 FROM k)",
        16, 1, 2, True,
    )
)
def rays_parallel(spark, sf_dir):
    return _ray_rows(G.parallel(nation_views(spark, sf_dir), PLANE, 25), 2)


@query(
    _rays_sql(
        f"k AS (SELECT n_nationkey AS view, (n_nationkey % 12) * (pi() / 12) + {TURN} AS t, n_nationkey > 12 AS z FROM nation), "
        "m AS (SELECT view, z, t, CASE WHEN z THEN -2 * cos(t) ELSE -2 * cos(t) END AS x0, CASE WHEN z THEN -2 * sin(t) ELSE 0 END AS x1, CASE WHEN z THEN 0 ELSE 2 * sin(t) END AS x2, "
        "CASE WHEN z THEN -sin(t) ELSE 0 END AS u0, CASE WHEN z THEN cos(t) ELSE 1 END AS u1, 0 AS u2, CASE WHEN z THEN 0 ELSE sin(t) END AS v0, 0 AS v1, CASE WHEN z THEN 1 ELSE cos(t) END AS v2 FROM k), "
        "w AS (SELECT view, " + ", ".join(f"0.5 + x{d} - 0.5 * (u{d} + v{d}) AS s{d}, 0.5 - x{d} - 0.5 * (u{d} + v{d}) AS c{d}, u{d} / 4.0 AS a{d}, v{d} / 4.0 AS b{d}" for d in range(3)) + " FROM m)",
        4, 4, 3, True,
    )
)
def rays_dual_axis(spark, sf_dir):
    return _ray_rows(G.dual_axis_parallel(nation_views(spark, sf_dir, F.col("view") % 12 * F.lit(pi / 12) + F.lit(TURN)), Volume.cube(4), 12))


@query(
    _rays_sql(
        f"k AS (SELECT n_nationkey AS view, {FULL} AS t FROM nation), w AS (SELECT view, 0.5 - 4 * cos(t) AS s0, 0.5 - 4 * sin(t) AS s1, 0.5 + 3 * cos(t) + 1.25 * sin(t) AS c0, 0.5 + 3 * sin(t) - 1.25 * cos(t) AS c1, -sin(t) * 2.5 / 8 AS a0, cos(t) * 2.5 / 8 AS a1 FROM k)",
        8, 1, 2, False,
    )
)
def rays_fan(spark, sf_dir):
    return _ray_rows(G.fan_beam(nation_views(spark, sf_dir, full_turn()), PLANE, 25, 2.5, 8, 4.0, 3.0), 2)


def _about(x: tuple[str, str, str], axis: int, rise: str = "0", angle: str = "t") -> list[str]:
    out = [f"0.5 + {c}" for c in _turned(x, axis, angle)]
    out[2] += f" + {rise}"
    return out


@query(_trajectory_sql(FULL, _about(("-2.0", "0", "0"), 2), _about(("1.5", "0", "0"), 2), [_turned(("0", "1", "0"), 2), ["0", "0", "1"]]))
def rays_cone(spark, sf_dir):
    return _ray_rows(G.cone_beam(nation_views(spark, sf_dir, full_turn()), SPACE, 25, (2.0, 2.0), (4, 4), 2.0, 1.5))


RISE = "(n_nationkey / 24.0 - 0.5)"


@query(
    _trajectory_sql(f"{FULL}, {RISE} AS h", _about(("-2.0", "0", "0"), 2, "h"), _about(("1.5", "0", "0"), 2, "h"), [_turned(("0", "1", "0"), 2), ["0", "0", "1"]]).replace(f"{FULL}, {RISE} AS h AS t", f"{FULL} AS t, {RISE} AS h")
)
def rays_helical(spark, sf_dir):
    return _ray_rows(G.helical_cone_beam(nation_views(spark, sf_dir, full_turn()), SPACE, 25, (2.0, 2.0), (4, 4), 3.0, 2.0, 1.5))


FAR = "(2 - 0.5 * cos(n_nationkey * pi() / 25))"


@query(
    _trajectory_sql(f"{FULL} AS t, {FAR} AS h", _about(("-h", "0", "0"), 1), _about(("h", "0", "0"), 1), [["0", "1", "0"], _turned(("0", "0", "1"), 1)]).replace(f"{FAR} AS h AS t", f"{FAR} AS h")
)
def rays_dynamic_cone(spark, sf_dir):
    return _ray_rows(G.dynamic_cone_beam(nation_views(spark, sf_dir, full_turn()), SPACE, 25, (2.0, 2.0), (4, 4)))


@query(_trajectory_sql("n_nationkey * (0.5 * pi() / 24) - 0.25 * pi()", _about(("0", "0", "2.0"), 0), ["0.5", "0.5", "-1.0"], [["1", "0", "0"], ["0", "1", "0"]]))
def rays_tomosynthesis(spark, sf_dir):
    return _ray_rows(G.tomosynthesis(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("view")), SPACE, 25, (2.0, 2.0), (4, 4), 2.0, 1.5))


def _laminography_sql() -> str:
    s, d = ["0.5 + cos(t)", "0.5 + sin(t)", "1.5"], ["0.5 - 0.8 * cos(t)", "0.5 - 0.8 * sin(t)", "-0.5"]
    # The detector's normal turns from the third axis to the line of sight, about its direction's normal.
    n = "sqrt(1.8 * 1.8 + 4)"
    q = f"(1.8 / {n})"
    theta = f"(-asin({q}))"
    axis = ["sin(t)", "-cos(t)", "0"]
    tilt = []
    for e in range(2):
        unit = ["1" if k == e else "0" for k in range(3)]
        cross = [f"({axis[(k + 1) % 3]} * {unit[(k + 2) % 3]} - {axis[(k + 2) % 3]} * {unit[(k + 1) % 3]})" for k in range(3)]
        tilt.append([f"({unit[k]} * cos{theta} + {cross[k]} * sin{theta} + {axis[k]} * {axis[e]} * (1 - cos{theta}))" for k in range(3)])
    return _trajectory_sql(FULL, s, d, tilt)


@query(_laminography_sql())
def rays_laminography(spark, sf_dir):
    return _ray_rows(G.laminography(nation_views(spark, sf_dir, full_turn()), SPACE, 25, (2.0, 2.0), (4, 4), 1.0, 1.0, 1.0, 0.8))


def _draw_sql(k: int, seed: int) -> str:
    x = f"(line % {G.PRIME})"
    out = f"SELECT line, {x} AS x FROM (SELECT o_orderkey AS line FROM orders)"
    for r in range(4):
        out = f"SELECT line, (x * x + x * 48271 + {(seed * 7919 + k * 104729 + r * 1299709 + 12345) % G.PRIME}) % {G.PRIME} AS x FROM ({out})"
    return f"SELECT line, (x + 0.5) / {G.PRIME}.0::DOUBLE AS r{k} FROM ({out})"


def _random_sql(seed: int) -> str:
    draws = " JOIN ".join(f"({_draw_sql(k, seed)}) q{k}" + (" USING (line)" if k else "") for k in range(10))
    normal = [f"sqrt(-2 * ln(r{4 + d})) * cos(r{7 + d} * 2 * pi())" for d in range(3)]
    start = [f"CASE WHEN f = {2 * d} THEN 0.0 WHEN f = {2 * d + 1} THEN 1.0 ELSE r{1 + d} END" for d in range(3)]
    way = [f"CASE WHEN f = {2 * d} THEN abs({g}) WHEN f = {2 * d + 1} THEN -abs({g}) ELSE {g} END" for d, g in enumerate(normal)]
    out = ", ".join(f"round({x}, 6) + 0.0 AS s{d}" for d, x in enumerate(start)) + ", " + ", ".join(f"round({x} + ({w}), 6) + 0.0 AS d{d}" for d, (x, w) in enumerate((f"({s})", w) for s, w in zip(start, way, strict=True)))
    return f"WITH y AS (SELECT *, CAST(floor(r0 * 6) AS INT) AS f FROM {draws}) SELECT line, {out} FROM y"


@query(_random_sql(7))
def rays_random(spark, sf_dir):
    lines = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("line"))
    return rounded(G.random_rays(spark, SPACE, 0, 7, lines).drop("view", "p0", "p1"), "line")


CONE = (_about(("-2.0", "0", "0"), 2), _about(("1.5", "0", "0"), 2), [_turned(("0", "1", "0"), 2), ["0", "0", "1"]])
#: Views of the cone beam with 10 x 10 pixels, as the table w.
CONE_VIEWS = _trajectory_sql(FULL, *CONE, 2.0, 10).removeprefix("WITH ").split(" SELECT CAST(view")[0]


@query(f"WITH {CONE_VIEWS} SELECT CAST(view // 2 AS INT) AS view, " + ", ".join(f"CAST(round({x}{d}{' * 2' if x in 'ab' else ''}, 6) + 0.0 AS DOUBLE) AS {x}{d}" for x in "scab" for d in range(3)) + ", 5 AS n0, 5 AS n1, false AS parallel FROM w WHERE view % 2 = 0")
def views_rescaled(spark, sf_dir):
    return rounded(G.rescaled(cone_views(spark, sf_dir), 2), "view", "n0", "n1", "parallel")


# Kernels


RAY_16 = (
    f"k AS (SELECT n_nationkey AS view, n_nationkey * (pi() / 25) + {TURN} AS t FROM nation), y AS (SELECT view * 16 + i AS line, cos(t) AS u0, sin(t) AS u1, 0.5 - 2 * cos(t) + 0.5 * sin(t) - (i + 0.5) * sin(t) / 16 AS s0, 0.5 - 2 * sin(t) - 0.5 * cos(t) + (i + 0.5) * cos(t) / 16 AS s1 FROM k, range(16) p(i)), "
    # Entry into the unit square along the ray; an axis whose ends agree to a hundredth is only checked for being inside.
    "z AS (SELECT *, abs(4 * u0) <= 1e-5 OR abs(4 * u0) <= 1e-2 * abs(s0 + 4 * u0) AS f0, abs(4 * u1) <= 1e-5 OR abs(4 * u1) <= 1e-2 * abs(s1 + 4 * u1) AS f1 FROM y), "
    "h AS (SELECT *, greatest(0, CASE WHEN f0 THEN 0 ELSE least(-s0 / (4 * u0), (1 - s0) / (4 * u0)) END, CASE WHEN f1 THEN 0 ELSE least(-s1 / (4 * u1), (1 - s1) / (4 * u1)) END) AS t1, "
    "least(CASE WHEN f0 THEN 1e300 ELSE greatest(-s0 / (4 * u0), (1 - s0) / (4 * u0)) END, CASE WHEN f1 THEN 1e300 ELSE greatest(-s1 / (4 * u1), (1 - s1) / (4 * u1)) END) AS t2 FROM z), "
    "o AS (SELECT line, 16 * s0 + (floor(64 * t1) + 1) * u0 AS o0, 16 * s1 + (floor(64 * t1) + 1) * u1 AS o1, u0, u1 FROM h WHERE t2 > t1 AND (NOT f0 OR (s0 >= -1e-5 AND s0 < 1 + 1e-5)) AND (NOT f1 OR (s1 >= -1e-5 AND s1 < 1 + 1e-5)))"
)


@query(f"WITH {RAY_16} SELECT line, round(o0, 6) + 0.0 AS o0, round(o1, 6) + 0.0 AS o1, round(u0, 6) + 0.0 AS u0, round(u1, 6) + 0.0 AS u1 FROM o")
def truncated_rays(spark, sf_dir):
    return rounded(kernels.truncated(plane_rays(spark, sf_dir), PLANE), "line")


INSIDE = "x0 BETWEEN 1e-5 AND 16 - 1e-5 AND x1 BETWEEN 1e-5 AND 16 - 1e-5"
CLOSEST = f"{RAY_16}, q AS (SELECT line, k, o0 + (k + 0.5) * u0 AS x0, o1 + (k + 0.5) * u1 AS x1 FROM o, range(30) r(k)), e AS (SELECT line, CAST(floor(x0) + 16 * floor(x1) AS BIGINT) AS voxel, 1.0::DOUBLE AS value FROM q WHERE {INSIDE} AND line IN (SELECT line FROM q WHERE k = 0 AND {INSIDE}))"


@query(f"WITH {CLOSEST} SELECT line, voxel, value FROM e")
def kernel_closest(spark, sf_dir):
    return kernels.closest(plane_rays(spark, sf_dir), PLANE)


MARGIN = "x0 >= -1.00001 AND x0 < 17.00001 AND x1 >= -1.00001 AND x1 < 17.00001"
SPREAD = "SELECT line, i0 + 16 * i1 AS voxel, round((1 - abs(x0 - i0 - 0.5)) * (1 - abs(x1 - i1 - 0.5)), 6) + 0.0 AS value FROM (SELECT *, CAST(floor(x0 + 0.5) AS BIGINT) - m AS i0, CAST(floor(x1 + 0.5) AS BIGINT) - n AS i1 FROM q, range(2) a(m), range(2) b(n) WHERE line IN (SELECT line FROM q WHERE k IN (0, -1))) WHERE i0 BETWEEN 0 AND 15 AND i1 BETWEEN 0 AND 15"


@query(f"WITH {RAY_16}, q AS (SELECT * FROM (SELECT line, k - 5 AS k, o0 + (k - 5) * u0 AS x0, o1 + (k - 5) * u1 AS x1 FROM o, range(40) r(k)) WHERE {MARGIN}) {SPREAD}")
def kernel_linear(spark, sf_dir):
    return rounded(kernels.linear(plane_rays(spark, sf_dir), PLANE), "line", "voxel")


@query(
    f"WITH {RAY_16}, j AS (SELECT *, CASE WHEN abs(u1) > abs(u0) THEN u1 ELSE u0 END AS u, CASE WHEN abs(u1) > abs(u0) THEN o1 ELSE o0 END AS c, abs(u1) > abs(u0) AS second FROM o), "
    "l AS (SELECT *, u0 / abs(u) AS h0, u1 / abs(u) AS h1, (CASE WHEN c - 0.5 < 0 THEN -floor(-(c - 0.5) + 0.5) ELSE floor(c) END + 0.5 - c) * sign(u) AS g FROM j), "
    f"q AS (SELECT * FROM (SELECT line, second, k - 5 AS k, o0 + (g + k - 5) * h0 AS x0, o1 + (g + k - 5) * h1 AS x1 FROM l, range(40) r(k)) WHERE {MARGIN}), "
    "w AS (SELECT line, second, CAST(CASE WHEN x - 0.5 < 0 THEN -floor(0.5 - x + 0.5) ELSE floor(x) END AS BIGINT) AS layer, y FROM (SELECT *, CASE WHEN second THEN x1 ELSE x0 END AS x, CASE WHEN second THEN x0 ELSE x1 END AS y FROM q WHERE line IN (SELECT line FROM q WHERE k IN (0, -1)))), "
    "c AS (SELECT *, CAST(CASE WHEN y < 0 THEN -floor(-y + 0.5) ELSE floor(y + 0.5) END AS BIGINT) - m AS i FROM w, range(2) a(m)) "
    "SELECT line, CASE WHEN second THEN i + 16 * layer ELSE layer + 16 * i END AS voxel, round(1 - abs(y - i - 0.5), 6) + 0.0 AS value FROM c WHERE layer BETWEEN 0 AND 15 AND i BETWEEN 0 AND 15"
)
def kernel_joseph(spark, sf_dir):
    return rounded(kernels.joseph(plane_rays(spark, sf_dir), PLANE), "line", "voxel")


def _truncated_sql(y: str) -> str:
    """Rays of the table y that hit SPACE, truncated as ``truncated_rays`` has it in the plane: table o."""
    d3, n = range(3), 12
    out = y + ", z AS (SELECT *, " + ", ".join(f"abs(d{d} - s{d}) <= 1e-5 OR abs(d{d} - s{d}) <= 1e-2 * abs(d{d}) AS f{d}" for d in d3) + " FROM y)"
    low = ", ".join(f"CASE WHEN f{d} THEN 0 ELSE least(-s{d} / (d{d} - s{d}), (1 - s{d}) / (d{d} - s{d})) END" for d in d3)
    high = ", ".join(f"CASE WHEN f{d} THEN 1e300 ELSE greatest(-s{d} / (d{d} - s{d}), (1 - s{d}) / (d{d} - s{d})) END" for d in d3)
    inside = " AND ".join(f"(NOT f{d} OR (s{d} >= -1e-5 AND s{d} < 1 + 1e-5))" for d in d3)
    out += f", h AS (SELECT * FROM (SELECT *, greatest(0, {low}) AS t1, least({high}) AS t2, sqrt({' + '.join(f'pow(d{d} - s{d}, 2)' for d in d3)}) AS long FROM z) WHERE t2 > t1 AND {inside})"
    out += ", g AS (SELECT *, " + ", ".join(f"(d{d} - s{d}) / long AS u{d}" for d in d3) + f", floor({n} * t1 * long) + 1 AS steps FROM h)"
    return out + ", o AS (SELECT line, " + ", ".join(f"{n} * s{d} + steps * u{d} AS o{d}, u{d}" for d in d3) + " FROM g)"


def _space() -> str:
    """Rays of the cone beam through SPACE."""
    at = [f"c{d} + (i + 0.5) * a{d} + (j + 0.5) * b{d}" for d in range(3)]
    y = "y AS (SELECT CAST(view AS BIGINT) * 100 + i + 10 * j AS line, " + ", ".join([*[f"s{d}" for d in range(3)], *[f"{x} AS d{d}" for d, x in enumerate(at)]]) + " FROM w, range(10) p(i), range(10) q(j))"
    return f"{CONE_VIEWS}, {_truncated_sql(y)}"


SPACE_RAYS = _space()
WITHIN = " AND ".join(f"x{d} BETWEEN 1e-5 AND 12 - 1e-5" for d in range(3))
NEAR = " AND ".join(f"x{d} >= -1.00001 AND x{d} < 13.00001" for d in range(3))


@query(
    f"WITH {SPACE_RAYS}, c AS (SELECT line, t1 AS t FROM h UNION ALL SELECT line, t2 FROM h"
    + "".join(f" UNION ALL SELECT line, (k / 12.0 - s{d}) / (d{d} - s{d}) AS t FROM h, range(13) r(k) WHERE abs(d{d} - s{d}) * 12 > 1e-12 AND (k / 12.0 - s{d}) / (d{d} - s{d}) BETWEEN t1 AND t2" for d in range(3))
    + "), e AS (SELECT line, t, lead(t) OVER (PARTITION BY line ORDER BY t) AS r FROM c), inner_ AS (SELECT line, (r - t) * long AS value, "
    + ", ".join(f"CAST(floor(12 * (s{d} + (d{d} - s{d}) * (t + r) / 2)) AS BIGINT) AS i{d}" for d in range(3))
    + " FROM e JOIN h USING (line) WHERE r - t > 1e-9) SELECT line, i0 + 12 * (i1 + 12 * i2) AS voxel, round(value, 6) + 0.0 AS value FROM inner_ WHERE i0 BETWEEN 0 AND 11 AND i1 BETWEEN 0 AND 11 AND i2 BETWEEN 0 AND 11"
)
def kernel_exact(spark, sf_dir):
    rays = cone_rays(spark, sf_dir)
    long = rays.select("line", V.distance(V.cols("s", 3), V.cols("d", 3)).alias("long"))
    # A corner that a ray touches to rounding is no element.
    return rounded(kernels.exact(rays, SPACE).join(long, "line").filter("value / long > 1e-9").drop("long"), "line", "voxel")


@query(
    f"WITH {SPACE_RAYS}, q AS (SELECT line, k, " + ", ".join(f"o{d} + (k + 0.5) * u{d} AS x{d}" for d in range(3)) + f" FROM o, range(40) r(k)) SELECT line, CAST(floor(x0) + 12 * (floor(x1) + 12 * floor(x2)) AS BIGINT) AS voxel, 1.0::DOUBLE AS value FROM (SELECT *, bool_or(k = 0) OVER (PARTITION BY line) AS starts FROM q WHERE {WITHIN}) WHERE starts"
)
def kernel_closest_space(spark, sf_dir):
    return kernels.closest(cone_rays(spark, sf_dir), SPACE)


def _joseph_space() -> str:
    d3 = range(3)
    pick = lambda xs: "CASE axis " + " ".join(f"WHEN {d} THEN {xs[d]}" for d in d3) + " END"
    away = lambda x: f"CASE WHEN {x} < 0 THEN -floor(-({x}) + 0.5) ELSE floor({x} + 0.5) END"
    out = f"WITH {SPACE_RAYS}, j AS (SELECT *, CASE WHEN abs(u2) > greatest(abs(u0), abs(u1)) THEN 2 WHEN abs(u1) > abs(u0) THEN 1 ELSE 0 END AS axis FROM o), main AS (SELECT *, {pick(['o0', 'o1', 'o2'])} AS om, {pick(['u0', 'u1', 'u2'])} AS um FROM j)"
    out += ", l AS (SELECT line, axis, o0, o1, o2, " + ", ".join(f"u{d} / abs(um) AS h{d}" for d in d3) + f", ({away('om - 0.5')} + 0.5 - om) * sign(um) AS shift FROM main)"
    out += f", q AS (SELECT * FROM (SELECT line, axis, k - 30 AS k, " + ", ".join(f"o{d} + (shift + k - 30) * h{d} AS x{d}" for d in d3) + f" FROM l, range(90) r(k)) WHERE {NEAR})"
    out += f", slices AS (SELECT *, {pick(['x0', 'x1', 'x2'])} AS x, CASE axis WHEN 0 THEN x1 ELSE x0 END AS y0, CASE axis WHEN 2 THEN x1 ELSE x2 END AS y1 FROM (SELECT *, bool_or(k IN (0, -1)) OVER (PARTITION BY line) AS starts FROM q) WHERE starts)"
    out += f", c AS (SELECT line, axis, CAST({away('x - 0.5')} AS BIGINT) AS row, y0, y1, CAST({away('y0')} AS BIGINT) - m AS i, CAST({away('y1')} AS BIGINT) - n AS j FROM slices, range(2) a(m), range(2) b(n))"
    return out + " SELECT line, CASE axis WHEN 0 THEN row + 12 * (i + 12 * j) WHEN 1 THEN i + 12 * (row + 12 * j) ELSE i + 12 * (j + 12 * row) END AS voxel, round((1 - abs(y0 - i - 0.5)) * (1 - abs(y1 - j - 0.5)), 6) + 0.0 AS value FROM c WHERE row BETWEEN 0 AND 11 AND i BETWEEN 0 AND 11 AND j BETWEEN 0 AND 11"


@query(_joseph_space())
def kernel_joseph_space(spark, sf_dir):
    return rounded(kernels.joseph(cone_rays(spark, sf_dir), SPACE), "line", "voxel")


@query(
    f"WITH {SPACE_RAYS}, q AS (SELECT * FROM (SELECT line, k - 30 AS k, " + ", ".join(f"o{d} + (k - 30) * u{d} AS x{d}" for d in range(3)) + f" FROM o, range(90) r(k)) WHERE {NEAR}), c AS (SELECT *, "
    + ", ".join(f"CAST(CASE WHEN x{d} < 0 THEN -floor(-x{d} + 0.5) ELSE floor(x{d} + 0.5) END AS BIGINT) - {m} AS i{d}" for d, m in enumerate("mno"))
    + " FROM (SELECT *, bool_or(k IN (0, -1)) OVER (PARTITION BY line) AS starts FROM q), range(2) a(m), range(2) b(n), range(2) c(o) WHERE starts) SELECT line, i0 + 12 * (i1 + 12 * i2) AS voxel, round("
    + " * ".join(f"(1 - abs(x{d} - i{d} - 0.5))" for d in range(3)) + ", 6) + 0.0 AS value FROM c WHERE i0 BETWEEN 0 AND 11 AND i1 BETWEEN 0 AND 11 AND i2 BETWEEN 0 AND 11"
)
def kernel_linear_space(spark, sf_dir):
    return rounded(kernels.linear(cone_rays(spark, sf_dir), SPACE), "line", "voxel")


EIGHT = CLOSEST.replace("16 * s0", "8 * s0").replace("16 * s1", "8 * s1").replace("64 * t1", "32 * t1").replace("16 - 1e-5", "8 - 1e-5").replace("+ 16 * floor(x1)", "+ 8 * floor(x1)").replace("view * 16 + i", "view * 8 + i").replace("/ 16 AS", "/ 8 AS").replace("range(16) p(i)", "range(8) p(i)")
PIXELS = "x AS (SELECT vec_id, unnest(embedding) AS value, generate_subscripts(embedding, 1) - 1 AS voxel FROM embeddings)"


def _images(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("voxel", "f"))


@query(f"WITH {EIGHT}, {PIXELS} SELECT vec_id, line, round(sum(x.value::DOUBLE * e.value), 6) + 0.0 AS value FROM e JOIN x USING (voxel) GROUP BY ALL")
def forward_images(spark, sf_dir):
    """All images through one matrix: line sums of every embedding taken as a picture."""
    a = kernels.closest(plane_rays(spark, sf_dir, IMAGE), IMAGE)
    rows = _images(spark, sf_dir).join(a, "voxel").groupBy("vec_id", "line")
    return rounded(rows.agg(F.sum(F.col("f").cast("double") * F.col("value")).alias("value")), "vec_id", "line")


# Partitionings


@query(f"WITH {GOODS_SQL} SELECT voxel, CAST(count(*) AS DOUBLE) AS value FROM v GROUP BY voxel")
def voxel_weights(spark, sf_dir):
    return goods_weights(spark, sf_dir)


@query(
    f"WITH {GOODS_SQL}, w AS (SELECT voxel, count(*) AS n FROM v GROUP BY 1), d AS (SELECT r AS voxel, r % 50 AS i0, (r // 50) % 11 AS i1, r // 550 AS i2, CAST(coalesce(n, 0) AS DOUBLE) AS n FROM range(4950) t(r) LEFT JOIN w ON w.voxel = r), "
    "x AS (SELECT *, sum(n) OVER (PARTITION BY i1, i2 ORDER BY i0) AS m FROM d), y AS (SELECT *, sum(m) OVER (PARTITION BY i0, i2 ORDER BY i1) AS k FROM x) SELECT voxel, i0, i1, i2, sum(k) OVER (PARTITION BY i0, i1 ORDER BY i2) AS value FROM y"
)
def partial_sums(spark, sf_dir):
    return statistics.partial_sums(goods_weights(spark, sf_dir), GOODS)


@query(f"WITH {GOODS_SQL} SELECT CAST(count(*) AS DOUBLE) AS weight FROM v WHERE i0 BETWEEN 7 AND 31 AND i1 BETWEEN 0 AND 6 AND i2 BETWEEN 2 AND 8")
def box_weight(spark, sf_dir):
    return statistics.box_weight(statistics.partial_sums(goods_weights(spark, sf_dir), GOODS), GOODS, [(7, 31), (0, 6), (2, 8)])


PART = "CASE WHEN i0 <= 24 THEN CASE WHEN i1 <= 5 THEN 0 ELSE 1 END ELSE CASE WHEN i2 <= 3 THEN 2 ELSE 3 END END"
OWNED = f"{GOODS_SQL}, w AS (SELECT DISTINCT line, {PART} AS part FROM v)"


def _owned(spark, sf_dir, boxes=None):
    return statistics.owners(goods(spark, sf_dir), GOODS, boxes or trees.boxes(TREE, GOODS))


@query(f"WITH {OWNED} SELECT CAST(sum(n - 1) AS BIGINT) AS volume FROM (SELECT count(*) AS n FROM w GROUP BY line)")
def communication_volume(spark, sf_dir):
    return statistics.communication_volume(_owned(spark, sf_dir))


@query(f"WITH {GOODS_SQL}, w AS (SELECT DISTINCT line, i0 // 13 AS part FROM v) SELECT CAST(sum(n - 1) AS BIGINT) AS volume FROM (SELECT count(*) AS n FROM w GROUP BY line)")
def communication_volume_blocks(spark, sf_dir):
    return statistics.communication_volume(_owned(spark, sf_dir, trees.blocks(GOODS, (4, 1, 1))))


@query(f"WITH {OWNED} SELECT count(*) - 4 AS messages FROM (SELECT DISTINCT a.part, b.part FROM w a JOIN w b USING (line))")
def message_count(spark, sf_dir):
    return statistics.message_count(_owned(spark, sf_dir), 4)


@query(f"WITH {GOODS_SQL} SELECT round(greatest(0, max(n) / (sum(n) / 4) - 1), 6) AS imbalance FROM (SELECT {PART} AS part, count(*) AS n FROM v GROUP BY 1)")
def load_imbalance(spark, sf_dir):
    return rounded(statistics.load_imbalance(goods_weights(spark, sf_dir), GOODS, trees.boxes(TREE, GOODS)))


@query(
    "WITH s AS (SELECT DISTINCT l_suppkey * 7 % 50 AS pos FROM lineitem), b AS (SELECT lead(pos, 1, 50) OVER (ORDER BY pos) - CASE WHEN lag(pos) OVER (ORDER BY pos) IS NULL THEN 0 ELSE pos END AS x, 11 AS y, 9 AS z FROM s) "
    "SELECT CAST(sum(2 * (x * y + (x - 1) * z + (y - 1) * (z - 1))) - 2 * (50 * 11 + 49 * 9 + 10 * 8) AS BIGINT) AS volume FROM b"
)
def regularizer_volume(spark, sf_dir):
    """Slabs that begin where suppliers' numbers say."""
    at = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") * 7 % 50).alias("at")).distinct()  # fifty at most
    order = Window.orderBy("at")
    low, high = F.when(F.lag("at").over(order).isNull(), F.lit(0)).otherwise(F.col("at")), F.lead("at", 1, 50).over(order) - 1
    parts = at.select(low.alias("lo_0"), high.alias("hi_0"), F.lit(0).alias("lo_1"), F.lit(10).alias("hi_1"), F.lit(0).alias("lo_2"), F.lit(8).alias("hi_2"))
    return statistics.regularizer_rows(parts, GOODS)


@query(
    f"WITH {GOODS_SQL}, w AS (SELECT DISTINCT line, 0 AS axis, i0 // 13 AS part FROM v UNION ALL SELECT DISTINCT line, 1, i1 // 3 FROM v UNION ALL SELECT DISTINCT line, 2, i2 // 3 FROM v), "
    "c AS (SELECT axis, CAST(sum(n - 1) AS BIGINT) AS volume FROM (SELECT axis, line, count(*) AS n FROM w GROUP BY ALL) GROUP BY axis) SELECT axis, volume FROM c ORDER BY volume, axis LIMIT 1"
)
def trivial_axis(spark, sf_dir):
    axis, _, volume = bisection.partition_trivial(goods(spark, sf_dir), GOODS, 4)
    return spark.createDataFrame([(axis, volume)], "axis int, volume long")


def listed_rays(spark, sf_dir) -> DataFrame:
    """A ray for every line item, along one of the axes or across it; coordinates by divisions only, so that SQL has the same bits."""
    rows = table(spark, sf_dir, "lineitem")
    line, turn = F.col("l_orderkey") * 8 + F.col("l_linenumber"), F.col("l_linenumber") % 3
    at = [F.lit(-1.0), (F.col("l_partkey") * 17 % 101) / F.lit(101.0), (F.col("l_suppkey") * 29 % 103) / F.lit(103.0)]
    to = [F.lit(2.0), (F.col("l_orderkey") * 31 % 107) / F.lit(107.0), (F.col("l_partkey") * 37 % 109) / F.lit(109.0)]
    turned = lambda xs, d: F.when(turn == 0, xs[d]).when(turn == 1, xs[(d + 2) % 3]).otherwise(xs[(d + 1) % 3])
    return rows.select(line.alias("line"), *V.named([turned(at, d) for d in range(3)], "s"), *V.named([turned(to, d) for d in range(3)], "d"))


def _bisection_sql(levels: int, epsilon: float) -> str:
    """Level by level: lines at their nodes' boxes, events by layer, candidates with weights by subqueries, the first in order."""
    d3 = range(3)
    at, to = ["-1.0::DOUBLE", "(l_partkey * 17 % 101) / 101.0::DOUBLE", "(l_suppkey * 29 % 103) / 103.0::DOUBLE"], ["2.0::DOUBLE", "(l_orderkey * 31 % 107) / 107.0::DOUBLE", "(l_partkey * 37 % 109) / 109.0::DOUBLE"]
    turned = lambda xs, d: f"CASE l_linenumber % 3 WHEN 0 THEN {xs[d]} WHEN 1 THEN {xs[(d + 2) % 3]} ELSE {xs[(d + 1) % 3]} END"
    y = "y AS (SELECT l_orderkey * 8 + l_linenumber AS line, " + ", ".join([f"{turned(xs, d)} AS {n}{d}" for n, xs in (("s", at), ("d", to)) for d in d3]) + " FROM lineitem)"
    samples = "q AS (SELECT line, k, " + ", ".join(f"o{d} + (k + 0.5) * u{d} AS x{d}" for d in d3) + " FROM o, range(40) r(k))"
    hits = f"hits AS MATERIALIZED (SELECT i0, i1, i2, count(*)::DOUBLE AS v FROM (SELECT CAST(floor(x0) AS BIGINT) AS i0, CAST(floor(x1) AS BIGINT) AS i1, CAST(floor(x2) AS BIGINT) AS i2, bool_or(k = 0) OVER (PARTITION BY line) AS starts FROM q WHERE {WITHIN}) WHERE starts GROUP BY ALL)"
    out = f"WITH {_truncated_sql(y)}, {samples}, {hits}"
    out += ", m0 AS (SELECT line, " + ", ".join(f"s{d} * 12 AS o{d}, d{d} * 12 - s{d} * 12 AS w{d}" for d in d3) + " FROM y)"
    out += ", l0 AS (SELECT line, o0, o1, o2, " + ", ".join(f"w{d} / sqrt(w0 * w0 + w1 * w1 + w2 * w2) AS u{d}" for d in d3) + " , 1 AS node FROM m0)"
    out += ", n0 AS (SELECT 1 AS node, " + ", ".join(f"0 AS lo{d}, 11 AS hi{d}" for d in d3) + f", {1 << levels} AS p, {epsilon!r}::DOUBLE AS eps)"
    for i in range(levels):
        flat = [f"(abs(o{d} - lo{d} - (e{d} - lo{d})) <= 1e-5 OR abs(o{d} - lo{d} - (e{d} - lo{d})) <= 1e-2 * abs(e{d} - lo{d}))" for d in d3]
        t = [f"((-(o{d} - lo{d})) / (e{d} - lo{d} - (o{d} - lo{d})))" for d in d3], [f"((hi{d} + 1 - lo{d} - (o{d} - lo{d})) / (e{d} - lo{d} - (o{d} - lo{d})))" for d in d3]
        low = ", ".join(f"CASE WHEN {flat[d]} THEN 0 ELSE least({t[0][d]}, {t[1][d]}) END" for d in d3)
        high = ", ".join(f"CASE WHEN {flat[d]} THEN 1e300 ELSE greatest({t[0][d]}, {t[1][d]}) END" for d in d3)
        ok = " AND ".join(f"(NOT {flat[d]} OR (o{d} - lo{d} >= -1e-5 AND o{d} - lo{d} < hi{d} + 1 - lo{d} + 1e-5))" for d in d3)
        middle = [f"(o{d} - (lo{d} + 0.5::DOUBLE * (hi{d} + 1 - lo{d})))" for d in d3]
        out += f", f{i} AS (SELECT *, 2 * sqrt({' + '.join(f'{m} * {m}' for m in middle)}) AS far FROM l{i} JOIN n{i} USING (node)), e{i} AS (SELECT *, " + ", ".join(f"o{d} + far * u{d} AS e{d}" for d in d3) + f" FROM f{i})"
        out += f", t{i} AS (SELECT *, greatest(2.2250738585072014e-308, {low}) AS t1, least({high}) AS t2 FROM e{i} WHERE {ok})"
        out += f", b{i} AS MATERIALIZED (SELECT line, node, o0, o1, o2, u0, u1, u2, " + ", ".join(f"o{d} + (e{d} - o{d}) * t1 AS a{d}, o{d} + (e{d} - o{d}) * t2 AS b{d}" for d in d3) + f" FROM t{i} WHERE t2 > t1)"
        sign = [f"CASE WHEN abs(b{d} - a{d}) <= 1e-5 THEN 0 WHEN b{d} > a{d} THEN 1 ELSE -1 END" for d in d3]
        events = " UNION ALL ".join(f"SELECT node, {d} AS d, CAST(trunc({e}{d}) AS INT) AS layer, {'' if e == 'a' else '-'}({sign[d]}) AS way FROM b{i}" for d in d3 for e in "ab")
        out += f", g{i} AS (SELECT node, d, layer, sum(way) AS way FROM ({events}) GROUP BY ALL)"
        out += f", w{i} AS MATERIALIZED (SELECT node, i0, i1, i2, v FROM hits JOIN n{i} ON i0 BETWEEN lo0 AND hi0 AND i1 BETWEEN lo1 AND hi1 AND i2 BETWEEN lo2 AND hi2), k{i} AS (SELECT node, sum(v) AS total FROM w{i} GROUP BY node)"
        own = lambda x: f"CASE d WHEN 0 THEN {x}0 WHEN 1 THEN {x}1 ELSE {x}2 END"
        out += f", c{i} AS (SELECT node, d, layer, {own('lo')} AS lo, {own('hi')} AS hi, eps / log2(p) AS eps, coalesce(sum(way) OVER (PARTITION BY node, d ORDER BY layer ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS crossed, lag(layer) OVER (PARTITION BY node, d ORDER BY layer) AS last FROM g{i} JOIN n{i} USING (node))"
        out += f", a{i} AS (SELECT node, d, layer, (layer - 1 + greatest(lo, coalesce(last, lo))) // 2 AS pos, crossed, eps, hi FROM c{i} WHERE layer > lo)"
        out += f", s{i} AS (SELECT a.*, total, (SELECT coalesce(sum(v), 0) FROM w{i} w WHERE w.node = a.node AND CASE a.d WHEN 0 THEN i0 WHEN 1 THEN i1 ELSE i2 END <= a.pos) AS lower FROM a{i} a JOIN k{i} USING (node) WHERE pos < hi)"
        out += f", r{i} AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY crossed, heavy, d, layer) AS place FROM (SELECT *, greatest(lower, total - lower) / (0.5 * total) - 1 AS heavy FROM s{i}) WHERE heavy < eps)"
        out += f", h{i} AS MATERIALIZED (SELECT n.*, coalesce(d, 0) AS d, coalesce(pos, (lo0 + hi0) // 2) AS pos, k.total, coalesce(lower, (SELECT sum(v) FROM w{i} w WHERE w.node = n.node AND i0 <= (lo0 + hi0) // 2)) AS lower FROM n{i} n JOIN k{i} k USING (node) LEFT JOIN (SELECT node, d, pos, lower FROM r{i} WHERE place = 1) USING (node))"
        sides = []
        for child, weight, ends in (("2 * node", "lower", ["lo{d}", "CASE d WHEN {d} THEN pos ELSE hi{d} END"]), ("2 * node + 1", "(total - lower)", ["CASE d WHEN {d} THEN pos + 1 ELSE lo{d} END", "hi{d}"])):
            sides.append(f"SELECT {child} AS node, " + ", ".join(f"{ends[0].format(d=d)} AS lo{d}, {ends[1].format(d=d)} AS hi{d}" for d in d3) + f", p // 2 AS p, (1 + eps) * (total / p) / {weight} * p / 2 - 1 AS eps FROM h{i}")
        out += f", n{i + 1} AS MATERIALIZED ({' UNION ALL '.join(sides)})"
        end = {e: f"trunc(CASE d WHEN 0 THEN {e}0 WHEN 1 THEN {e}1 ELSE {e}2 END)" for e in "ab"}
        go = [f"SELECT line, o0, o1, o2, u0, u1, u2, {child} AS node FROM b{i} JOIN h{i} USING (node) WHERE {f}({end['a']}, {end['b']}) {op} pos" for child, f, op in (("2 * node", "least", "<="), ("2 * node + 1", "greatest", ">"))]
        out += f", l{i + 1} AS ({' UNION ALL '.join(go)})"
    return out + f" SELECT node - {1 << levels} AS part, " + ", ".join(f"lo{d} AS lo_{d}, hi{d} AS hi_{d}" for d in d3) + f" FROM n{levels}"


@query(_bisection_sql(3, 0.2))
def partition_bisection(spark, sf_dir):
    return trees.parts(spark, trees.boxes(bisection.partition_bisection(listed_rays(spark, sf_dir), SPACE, 8), SPACE))


def _overlap_sql() -> str:
    """Corners of both halves turned back and projected; hulls as half-planes; the common part's corners are crossings inside all."""
    out = "WITH k AS (SELECT c_custkey AS view, c_custkey * 0.7310585786300049::DOUBLE AS t FROM customer), boxes(axis, part, x0, x1, y0, y1, z0, z1) AS (VALUES "
    boxes = []
    for axis in range(3):
        for part in range(2):
            ends = [v for d in range(3) for v in ((0.5 if part else 0.0, 1.0 if part else 0.5) if d == axis else (0.0, 1.0))]
            boxes.append(f"({axis}, {part}, {', '.join(f'{v}::DOUBLE' for v in ends)})")
    out += ", ".join(boxes) + "), c AS (SELECT view, axis, part, i, t, (CASE WHEN i & 1 = 1 THEN x1 ELSE x0 END) - 0.5 AS x, (CASE WHEN i & 2 = 2 THEN y1 ELSE y0 END) - 0.5 AS y, (CASE WHEN i & 4 = 4 THEN z1 ELSE z0 END) - 0.5 AS z FROM k, boxes, range(8) r(i))"
    out += ", p AS MATERIALIZED (SELECT view, axis, part, i, 3.5 * (y * cos(t) - x * sin(t)) / (x * cos(t) + y * sin(t) + 2) AS u, 3.5 * z / (x * cos(t) + y * sin(t) + 2) AS v FROM c)"
    # An edge has all corners to its left: nx u + ny v <= d. The detector reaches from -1 to 1.
    out += ", e AS (SELECT a.view, a.axis, a.part, a.i, b.i AS j, any_value(b.v - a.v) AS nx, any_value(a.u - b.u) AS ny, any_value((b.v - a.v) * a.u + (a.u - b.u) * a.v) AS d FROM p a JOIN p b ON a.view = b.view AND a.axis = b.axis AND a.part = b.part AND a.i <> b.i JOIN p o ON a.view = o.view AND a.axis = o.axis AND a.part = o.part GROUP BY a.view, a.axis, a.part, a.i, b.i HAVING min((b.u - a.u) * (o.v - a.v) - (b.v - a.v) * (o.u - a.u)) >= -1e-12 AND any_value(abs(b.u - a.u) + abs(b.v - a.v)) > 1e-12)"
    out += ", h AS MATERIALIZED (SELECT view, axis, row_number() OVER (PARTITION BY view, axis) AS n, nx / l AS nx, ny / l AS ny, d / l AS d FROM (SELECT view, axis, nx, ny, d, sqrt(nx * nx + ny * ny) AS l FROM e UNION ALL SELECT view, axis, nx, ny, 1.0, 1.0 FROM (SELECT DISTINCT view, axis FROM p), (VALUES (1.0, 0.0), (-1.0, 0.0), (0.0, 1.0), (0.0, -1.0)) s(nx, ny)))"
    out += ", x AS (SELECT a.view, a.axis, a.n AS a, b.n AS b, (a.d * b.ny - b.d * a.ny) / (a.nx * b.ny - b.nx * a.ny) AS u, (a.nx * b.d - b.nx * a.d) / (a.nx * b.ny - b.nx * a.ny) AS v FROM h a JOIN h b ON a.view = b.view AND a.axis = b.axis AND a.n < b.n WHERE abs(a.nx * b.ny - b.nx * a.ny) > 1e-9)"
    out += ", y AS (SELECT x.view, x.axis, round(u, 10) AS u, round(v, 10) AS v FROM x JOIN h USING (view, axis) GROUP BY x.view, x.axis, x.a, x.b, x.u, x.v HAVING max(nx * u + ny * v - d) <= 1e-10), z AS (SELECT DISTINCT view, axis, u, v FROM y)"
    out += ", w AS (SELECT *, atan2(v - avg(v) OVER g, u - avg(u) OVER g) AS way FROM z WINDOW g AS (PARTITION BY view, axis)), f AS (SELECT view, axis, u, v, coalesce(lead(u) OVER o, first_value(u) OVER o) AS u1, coalesce(lead(v) OVER o, first_value(v) OVER o) AS v1 FROM w WINDOW o AS (PARTITION BY view, axis ORDER BY way))"
    return out + " SELECT view, axis, round(coalesce(area, 0), 6) + 0.0 AS area FROM (SELECT DISTINCT view, axis FROM p) LEFT JOIN (SELECT view, axis, 0.5 * abs(sum(u * v1 - u1 * v)) AS area FROM f GROUP BY view, axis) USING (view, axis)"


@query(_overlap_sql())
def overlap_areas(spark, sf_dir):
    """A cone view for every customer: where the shadows of the two halves overlap, for cuts along each axis."""
    views = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("view"), (F.col("c_custkey") * F.lit(0.7310585786300049)).alias("angle"))
    views = G.cone_beam(views, SPACE, 25, (2.0, 2.0), (10, 10), 2.0, 1.5)
    cube = ((0.0,) * 3, (1.0,) * 3)
    found = grcb.overlap_areas(views, [grcb.split_at(cube, 0.5, d) for d in range(3)])
    return rounded(found.withColumnRenamed("k", "axis"), "view", "axis")


@query()
def partition_continuous(spark, sf_dir):
    tree = grcb.partition(cone_views(spark, sf_dir), SPACE, 2)
    return trees.parts(spark, trees.boxes(trees.to_voxels(tree, SPACE), SPACE))


@query(
    "WITH x AS (SELECT e_value AS y, row_number() OVER (ORDER BY e_value, event_id) AS k, count(*) OVER () AS n, sum(f) OVER (ORDER BY e_value, event_id ROWS UNBOUNDED PRECEDING) AS l, sum(f) OVER () AS total FROM (SELECT event_id, (event_id * 7919 % 10007) / 10007.0 AS e_value, CAST(1 + user_id % 5 AS DOUBLE) AS f FROM events)), "
    "t AS (SELECT *, lead(y) OVER (ORDER BY k) AS r FROM x), b AS (SELECT * FROM t WHERE k < n AND (l / k * r > (total - l) / (n - k) * (1 - r) OR k = n - 1) ORDER BY k LIMIT 1) SELECT round(least(r, greatest(y, ((total - l) / (n - k)) / (l / k + (total - l) / (n - k)))), 6) AS at FROM b"
)
def simple_split(spark, sf_dir):
    rows = table(spark, sf_dir, "events").selectExpr("event_id", "(event_id * 7919 % 10007) / 10007.0D AS y", "CAST(1 + user_id % 5 AS DOUBLE) AS f")
    return spark.createDataFrame([(round(grcb.simple_split_rows(rows, 0.0, 1.0, "event_id"), 6),)], "at double")


# Exchange


FOUR = {1: (0, 5), 2: (1, 3), 3: (2, 7)}


def _shadows(spark, sf_dir) -> DataFrame:
    return exchange.shadows(trees.parts(spark, trees.boxes(FOUR, SPACE)), cone_views(spark, sf_dir), SPACE)


def _shadow_sql() -> str:
    boxes = "b(part, x0, x1, y0, y1, z0, z1) AS (VALUES (0, 0, 6, 0, 4, 0, 12), (1, 0, 6, 4, 12, 0, 12), (2, 6, 12, 0, 12, 0, 8), (3, 6, 12, 0, 12, 8, 12))"
    return (
        f"WITH {boxes}, k AS (SELECT n_nationkey AS view, {FULL} AS t FROM nation), "
        "c AS (SELECT part, view, t, (CASE WHEN i & 1 = 1 THEN x1 ELSE x0 END) / 12.0 - 0.5 AS x, (CASE WHEN i & 2 = 2 THEN y1 ELSE y0 END) / 12.0 - 0.5 AS y, (CASE WHEN i & 4 = 4 THEN z1 ELSE z0 END) / 12.0 - 0.5 AS z FROM b, k, range(8) r(i)), "
        # Turned back, the source is at -2 and the detector at 1.5 along the first axis.
        "p AS (SELECT part, view, 3.5 * (y * cos(t) - x * sin(t)) / (x * cos(t) + y * sin(t) + 2) AS u, 3.5 * z / (x * cos(t) + y * sin(t) + 2) AS v FROM c), "
        "n AS (SELECT part, view, CAST(trunc((u + 1) * 5 + 0.5) AS BIGINT) AS i, CAST(trunc((v + 1) * 5 + 0.5) AS BIGINT) AS j FROM p) "
        "SELECT part, view, greatest(min(i) - 1, 0) AS min_x, greatest(min(j) - 1, 0) AS min_y, least(max(i) + 1, 9) AS max_x, least(max(j) + 1, 9) AS max_y FROM n GROUP BY part, view"
    )


@query(_shadow_sql())
def shadows(spark, sf_dir):
    return _shadows(spark, sf_dir)


@query(
    f"WITH s AS ({_shadow_sql()}), o AS (SELECT x.part AS a, y.part AS b, view, greatest(x.min_x, y.min_x) AS min_x, greatest(x.min_y, y.min_y) AS min_y, least(x.max_x, y.max_x) AS max_x, least(x.max_y, y.max_y) AS max_y FROM s x JOIN s y USING (view) WHERE x.part <> y.part) "
    "SELECT * FROM o WHERE max_x >= min_x AND max_y >= min_y"
)
def shadow_overlaps(spark, sf_dir):
    return exchange.overlaps(_shadows(spark, sf_dir))


CONTRIBUTIONS = (
    f"WITH s AS ({_shadow_sql()}), c AS (SELECT view, part, i + 10 * j AS pixel FROM s, range(10) p(i), range(10) q(j) WHERE i BETWEEN min_x AND max_x AND j BETWEEN min_y AND max_y), w AS (SELECT view, pixel, list(part ORDER BY part) AS who FROM c GROUP BY ALL) "
    "SELECT view, pixel, who[(view * 100 + pixel) % len(who) + 1] AS owner, unnest(who) AS target FROM w"
)


@query(CONTRIBUTIONS)
def contributions(spark, sf_dir):
    return exchange.contributions(_shadows(spark, sf_dir), 10, 10)


@query(f"SELECT CAST(2 * count(*) AS BIGINT) AS messages FROM (SELECT DISTINCT owner, target FROM ({CONTRIBUTIONS}) WHERE owner <> target)")
def exchange_messages(spark, sf_dir):
    return exchange.messages(exchange.contributions(_shadows(spark, sf_dir), 10, 10))


@query(f"WITH {GOODS_SQL}, c AS (SELECT {PART} AS part, line % 100 AS line, CAST(count(*) AS DOUBLE) AS n FROM v GROUP BY ALL) SELECT part, line, sum(n) OVER (PARTITION BY line) AS value FROM c")
def exchanged_sums(spark, sf_dir):
    rows = goods(spark, sf_dir).select(statistics.owner(V.cols("i", 3), trees.boxes(TREE, GOODS)).alias("part"), (F.col("line") % 100).alias("line"))
    return exchange.exchanged(rows.groupBy("part", "line").agg(F.count(F.lit(1)).cast("double").alias("value")))


@query(
    "WITH r AS (SELECT user_id % 50 AS slice_id, arg_max(event_type, event_id) AS kind, arg_max(user_id % 3, event_id) AS axis, arg_max(value, event_id) AS position FROM events GROUP BY 1) SELECT slice_id, axis, position FROM r WHERE kind <> 'error'"
)
def slice_registry(spark, sf_dir):
    kind = F.when(F.col("event_type") == "error", "remove").otherwise("set")
    requests = table(spark, sf_dir, "events").select(F.col("event_id").alias("request_id"), kind.alias("kind"), (F.col("user_id") % 50).alias("slice_id"), (F.col("user_id") % 3).alias("axis"), F.col("value").alias("position"))
    return observe.slices(requests)


def _written_scan(spark, sf_dir) -> str:
    """The pattern of a stack of images, one for 64 order keys, that executors have written."""
    at = [F.floor(F.col("l_orderkey") / 64).cast("int").alias("view"), (F.col("l_partkey") % 24).cast("int").alias("pixel_row"), (F.col("l_suppkey") % 32).cast("int").alias("pixel_column")]
    pattern = f"{shared_dir(spark, 'scan')}/view_*.tif"
    scan.write_scan(table(spark, sf_dir, "lineitem").groupBy(*at).agg(F.sum("l_quantity").alias("value")), 32, 24, pattern).count()
    return pattern


@query(
    "WITH p AS (SELECT CAST(l_orderkey // 64 AS INT) AS view, CAST(l_partkey % 24 AS INT) AS r, CAST(l_suppkey % 32 AS INT) AS c, sum(l_quantity) AS value FROM lineitem GROUP BY ALL), v AS (SELECT DISTINCT view FROM p) "
    "SELECT v.view, (v.view * 24 + y.r) * 32 + x.c AS line, coalesce(p.value, 0) AS value FROM v, range(24) AS y(r), range(32) AS x(c) LEFT JOIN p ON p.view = v.view AND p.r = y.r AND p.c = x.c"
)
def scan_round_trip(spark, sf_dir):
    """A stack of images written by executors and read again by runs of bytes."""
    return scan.read_scan(spark, _written_scan(spark, sf_dir)).select("view", "line", "value")


@query("SELECT CAST(l_orderkey // 64 AS INT) AS view, sum(l_quantity) AS total FROM lineitem WHERE l_orderkey // 64 >= 10 GROUP BY 1")
def scan_of_some_views(spark, sf_dir):
    """Sums of the images of a range of views: no other file is opened."""
    return scan.read_scan(spark, _written_scan(spark, sf_dir)).filter("view >= 10").groupBy("view").agg(F.sum("value").alias("total"))


REGISTRY_SQL = "WITH r AS (SELECT user_id AS slice_id, arg_max(event_type, event_id) AS kind, CAST(arg_max(user_id % 3, event_id) AS INT) AS axis, arg_max({position}, event_id) AS position FROM events GROUP BY 1), s AS (SELECT slice_id, axis, position FROM r WHERE kind <> 'error')"


@query(REGISTRY_SQL.format(position="value") + " SELECT * FROM s")
def slice_changes(spark, sf_dir):
    """The registry of slices as a stateful stream leaves it, from the changes of all its batches."""
    kind = F.when(F.col("event_type") == "error", "remove").otherwise("set")
    events = table(spark, sf_dir, "events").select(F.col("event_id").alias("request_id"), kind.alias("kind"), F.col("user_id").alias("slice_id"), (F.col("user_id") % 3).alias("axis"), F.col("value").alias("position"))
    requests = keep(events, "slice-requests")
    log = shared_dir(spark, "slice-log")
    arriving = spark.readStream.schema(requests.schema).option("maxFilesPerTrigger", 4).parquet(requests._kept_at)
    observe.serve_changes(arriving, lambda batch, k: batch.write.mode("overwrite").parquet(f"{log}/batch={k}"), once=True).awaitTermination()
    return observe.registry(spark.read.schema(f"{observe.CHANGE}, batch long").parquet(log))


@query(
    REGISTRY_SQL.format(position="(event_id % 1000) / 1000.0")
    + f", {GOODS_SQL}, w AS (SELECT i0, i1, i2, CAST(count(*) AS DOUBLE) AS value FROM v GROUP BY ALL), p AS (SELECT slice_id, axis, least(CAST(floor(CAST(position AS DOUBLE) * CASE axis WHEN 0 THEN 50 WHEN 1 THEN 11 ELSE 9 END) AS BIGINT), CASE axis WHEN 0 THEN 49 WHEN 1 THEN 10 ELSE 8 END) AS layer FROM s) "
    "SELECT slice_id, CASE axis WHEN 0 THEN i1 + 11 * i2 WHEN 1 THEN i0 + 50 * i2 ELSE i0 + 50 * i1 END AS pixel, value FROM p JOIN w ON CASE axis WHEN 0 THEN i0 WHEN 1 THEN i1 ELSE i2 END = layer"
)
def slice_pixels(spark, sf_dir):
    """The pixels of all slices that are set."""
    kind = F.when(F.col("event_type") == "error", "remove").otherwise("set")
    position = (F.col("event_id") % 1000) / F.lit(1000.0)
    requests = table(spark, sf_dir, "events").select(F.col("event_id").alias("request_id"), kind.alias("kind"), F.col("user_id").alias("slice_id"), (F.col("user_id") % 3).alias("axis"), position.alias("position"))
    image = goods(spark, sf_dir).groupBy("voxel").agg(F.count(F.lit(1)).cast("double").alias("value"))
    return observe.slice_pixels(observe.slices(requests), image, GOODS)


def _hilbert_sql(order: int) -> str:
    out = f"SELECT id, CAST(0 AS BIGINT) AS x, CAST(0 AS BIGINT) AS y FROM (SELECT DISTINCT l_orderkey % {4**order} AS id FROM lineitem)"
    for k in range(order):
        out = f"SELECT *, (id >> {2 * k}) & 3 AS pair FROM ({out})"
        out = f"SELECT id, pair, CASE WHEN pair = 3 THEN {(1 << k) - 1} - x ELSE x END AS x, CASE WHEN pair = 3 THEN {(1 << k) - 1} - y ELSE y END AS y FROM ({out})"
        out = f"SELECT id, CASE WHEN pair IN (1, 2) THEN x ELSE y END + CASE WHEN pair >= 2 THEN {1 << k} ELSE 0 END AS x, CASE WHEN pair IN (1, 2) THEN y ELSE x END + CASE WHEN pair IN (1, 2) THEN {1 << k} ELSE 0 END AS y FROM ({out})"
    return f"SELECT id, x AS h0, y AS h1 FROM ({out})"


@query(_hilbert_sql(8))
def hilbert_curve(spark, sf_dir):
    ids = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 4**8).alias("id")).distinct()
    return ids.select("id", *V.named(V.hilbert(F.col("id"), 8), "h"))


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: three iterations of SIRT."""
    return sirt(spark, sf_dir)


from . import point_queries  # noqa: E402, F401  its queries use the tables and SQL above
