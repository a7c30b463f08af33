"""Products with a sparse matrix (line, voxel, value) and its sums.

The vector side of a product is joined by whatever adaptive execution finds cheapest: it is broadcast only while it
is below Spark's own size limit. Partial sums are taken before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import EPSILON


def forward(matrix: DataFrame, image: DataFrame) -> DataFrame:
    """(line, value): sum over voxels of A * f."""
    f = image.select("voxel", F.col("value").alias("f"))
    return matrix.join(f, "voxel").groupBy("line").agg(F.sum(F.col("value") * F.col("f")).alias("value"))


def back(matrix: DataFrame, projections: DataFrame) -> DataFrame:
    """(voxel, value): sum over lines of A * p."""
    p = projections.select("line", F.col("value").alias("p"))
    return matrix.join(p, "line").groupBy("voxel").agg(F.sum(F.col("value") * F.col("p")).alias("value"))


def row_sums(matrix: DataFrame) -> DataFrame:
    return matrix.groupBy("line").agg(F.sum("value").alias("value"))


def column_sums(matrix: DataFrame) -> DataFrame:
    return matrix.groupBy("voxel").agg(F.sum("value").alias("value"))


def square_norms(matrix: DataFrame, by: str = "line") -> DataFrame:
    """Sums of squares of elements; an element that comes twice counts twice."""
    return matrix.groupBy(by).agg(F.sum(F.col("value") * F.col("value")).alias("value"))


def inverse(x: Column, scale: float = 1.0) -> Column:
    """scale / x, and 0 where x is about zero."""
    return F.when(F.abs(x) > EPSILON, F.lit(float(scale)) / x).otherwise(0.0)


def combine(a: DataFrame, b: DataFrame, key: str, f) -> DataFrame:
    """(key, value) of f(a, b) where either has a row; what is absent is 0."""
    x, y = a.select(key, F.col("value").alias("_a")), b.select(key, F.col("value").alias("_b"))
    zero = F.lit(0.0)
    return x.join(y, key, "full").select(key, f(F.coalesce("_a", zero), F.coalesce("_b", zero)).alias("value"))


def inner(a: DataFrame, b: DataFrame, key: str) -> float:
    """The dot product, as one number."""
    row = a.select(key, F.col("value").alias("_a")).join(b.select(key, F.col("value").alias("_b")), key).agg(F.sum(F.col("_a") * F.col("_b"))).first()
    return row[0] or 0.0


def square(a: DataFrame) -> float:
    return a.agg(F.sum(F.col("value") * F.col("value"))).first()[0] or 0.0


def matrix_market(matrix: DataFrame, lines: int, cells: int) -> tuple[str, DataFrame]:
    """(header, entries): the coordinate format, numbered from 1; repeated entries stay."""
    n = matrix.count()
    return f"%%MatrixMarket matrix coordinate real general\n{lines} {cells} {n}", matrix.select((F.col("line") + 1).alias("row"), (F.col("voxel") + 1).alias("col"), "value")
