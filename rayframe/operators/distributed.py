"""SIRT over the parts of a volume: local products, and an exchange of the lines that parts share.

Each part's elements lie in one bucket, and so do its image, its lines and its sums. Joins and aggregations by (place,
voxel) or (place, line) then need no shuffle: what moves in an iteration are partial sums of shared lines, to the part
that owns a line and back, and nothing else. A line's owner is one of the parts that hold it, in turn by line number, or
as ``exchange.contributions`` says. A part of up to ``SLICE`` elements is one task's work: its image and its lines are held
in memory, its elements stream. Larger ones are cut into slices by line, each a place of its own with a copy of the part's
image; sums over voxels are then added up over a part's slices too.

Spark hashes a bucket's key. ``places`` finds a number for each bucket, so that every bucket has exactly one part.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions import vec as V
from ..model import Volume
from ..plans import statistics
from ..plans.trees import Box
from ..storage import bucketed, discard, keep
from . import linop as L

#: Elements of a part, on average, that one task takes; parts with more are cut into slices.
SLICE = 1 << 19

CO_PARTITION = "spark.sql.requireAllClusterKeysForCoPartition"


@dataclass
class Round:
    """Seconds of an iteration and of its exchange, rows that were sent to owners and returned, seconds of forward products by part."""

    seconds: float
    exchange: float
    sent: int
    returned: int
    forward: dict[int, float] = field(default_factory=dict)


@contextmanager
def co_partitioned(spark: SparkSession):
    """Lets rows that lie together by ``place`` be joined by (place, voxel) where they are."""
    before = spark.conf.get(CO_PARTITION)
    spark.conf.set(CO_PARTITION, "false")
    try:
        yield
    finally:
        spark.conf.set(CO_PARTITION, before)


def places(spark: SparkSession, n: int) -> list[int]:
    """For each of ``n`` buckets, the least number that Spark hashes into it."""
    rows = spark.range(64 * n + 4096).select(F.col("id").cast("int").alias("place"))
    found = rows.groupBy(F.pmod(F.hash("place"), F.lit(n)).alias("bucket")).agg(F.min("place").alias("place")).collect()
    if len(found) < n:
        raise ValueError(f"no place found for one of {n} parts")
    return [r.place for r in sorted(found, key=lambda r: r.bucket)]


def _stamp(each: int = 1) -> Column:
    """The executor's clock in nanoseconds, read at every ``each``-th row of a task."""
    now = F.reflect(F.lit("java.lang.System"), F.lit("nanoTime")).cast("long")
    return now if each == 1 else F.when(F.monotonically_increasing_id().bitwiseAND(F.lit(each - 1)) == 0, now)


class Parts:
    """A matrix dealt out to the boxes of a partitioning, and who shares which line."""

    def __init__(self, matrix: DataFrame, volume: Volume, boxes: list[Box], shared: DataFrame | None = None, slices: int = 1):
        """``shared``: (line, owner, part) of the holders of each line, as of ``contributed``; by default those with elements."""
        self.spark, self.n, self.slices = matrix.sparkSession, len(boxes) * slices, slices
        self.places = places(self.spark, self.n)
        self.tables: list[DataFrame] = []
        with co_partitioned(self.spark):
            rows = V.computed(matrix, ["line", "voxel", "value"], V.named(volume.unroll(F.col("voxel")), "i"))
            rows = rows.select(self.place(statistics.owner(V.cols("i", volume.dim), boxes)).alias("place"), "line", "voxel", F.col("value").cast("double").alias("value"))
            self.matrix = self.put(rows.where("place IS NOT NULL"), "matrix", placed=False)
            if shared is None:
                held = self.matrix.select("line", "place").distinct()
                who = held.groupBy("line").agg(F.array_sort(F.collect_list("place")).alias("who"))  # no longer than there are parts
                own = F.element_at("who", F.pmod("line", F.size("who")).cast("int") + 1)
                lines = who.select(F.explode("who").alias("place"), "line", own.alias("owner"))
            else:
                lines = shared.select(self.place(F.col("part")).alias("place"), "line", self.place(F.col("owner")).alias("owner"))
            self.lines = self.put(lines, "lines", placed=False)
            others = self.lines.where("owner <> place")
            self.targets = self.put(others.select(F.col("owner").alias("place"), "line", F.col("place").alias("target")), "targets", placed=False)

    def place(self, part: Column) -> Column:
        """The place of a part's slice that holds the row's ``line``."""
        if self.slices > 1:
            part = part * self.slices + F.pmod(F.xxhash64("line"), F.lit(self.slices))
        # Spark takes element_at for never null here, even where the index is.
        return F.when(part.isNotNull(), F.element_at(F.lit(self.places), part.cast("int") + 1))

    def gathered(self, local: DataFrame) -> DataFrame:
        """(place, voxel, value) summed over a part's slices, at each of them."""
        if self.slices == 1:
            return local
        total = local.groupBy("voxel").agg(F.sum("value").alias("value"))  # a voxel is in one part
        return local.select("place", "voxel").join(total, "voxel").select("place", "voxel", "value").repartition(self.n, "place")

    def image(self, x: DataFrame) -> DataFrame:
        """(voxel, value): slices have equal copies."""
        return x.select("voxel", "value") if self.slices == 1 else x.groupBy("voxel").agg(F.min("value").alias("value"))

    def put(self, df: DataFrame, what: str, placed: bool = True) -> DataFrame:
        out = bucketed(df, f"parts-{what}", "place", self.n, placed)
        self.tables.append(out)
        return out

    def drop(self, *tables: DataFrame) -> None:
        discard(*tables)
        self.tables = [t for t in self.tables if not any(t is x for x in tables)]

    def close(self) -> None:
        self.drop(*self.tables)

    def product(self, vector: DataFrame, over: str, by: str, stamp: Column | None = None) -> DataFrame:
        """(place, ``by``, value, begun): sums of elements times ``vector``'s values at ``over``, within each part.

        ``begun`` is the least ``stamp`` of a row's elements.
        """
        held = vector.select("place", over, F.col("value").alias("f")).hint("shuffle_hash")
        at = F.lit(None).cast("long") if stamp is None else stamp
        rows = self.matrix.join(held, ["place", over]).select("place", by, (F.col("value") * F.col("f")).alias("value"), at.alias("at"))
        return rows.groupBy("place", by).agg(F.sum("value").alias("value"), F.min("at").alias("begun"))

    def exchanged(self, local: DataFrame, sent: Observation | None = None, returned: Observation | None = None) -> DataFrame:
        """(place, line, value) at every holder of a line, from local (place, line, owner, value), one a holder."""
        counted = lambda df, o: df.observe(o, F.count(F.lit(1)).alias("n")) if o else df
        out = counted(local.where("owner <> place").select(F.col("owner").alias("place"), "line", "value"), sent)
        got = out.repartition(self.n, "place").groupBy("place", "line").agg(F.sum("value").alias("more"))
        own = local.where("owner = place").select("place", "line", "value").join(got, ["place", "line"], "left")
        own = own.select("place", "line", (F.col("value") + F.coalesce("more", F.lit(0.0))).alias("value"))
        back = own.join(self.targets, ["place", "line"]).select(F.col("target").alias("place"), "line", F.col("value").alias("again"))
        back = counted(back, returned).repartition(self.n, "place")
        rows = local.select("place", "line").join(own, ["place", "line"], "left").join(back, ["place", "line"], "left")
        return rows.select("place", "line", F.coalesce("value", "again").alias("value"))


def contributed(contributions: DataFrame, views: DataFrame, n0: int, n1: int) -> DataFrame:
    """(line, owner, part) from ``exchange.contributions``, for views of equal shape."""
    return contributions.select((F.col("view").cast("long") * (n0 * n1) + F.col("pixel")).alias("line"), "owner", F.col("target").alias("part"))


def sirt(
    matrix: DataFrame, projections: DataFrame, volume: Volume, boxes: list[Box], beta: float = 1.0, iterations: int = 10,
    shared: DataFrame | None = None, rounds: list[Round] | None = None, callback: Callable[[DataFrame, int], None] | None = None,
) -> DataFrame:
    """``solvers.sirt`` over parts: the same image. ``rounds`` gets a Round for every iteration."""
    spark = matrix.sparkSession
    matrix = keep(matrix.select("line", "voxel", "value"), "parts-input")
    parts = Parts(matrix, volume, boxes, shared, max(1, -(-matrix.count() // (SLICE * len(boxes)))))
    discard(matrix)
    try:
        with co_partitioned(spark):
            return _iterate(parts, projections, beta, iterations, rounds, callback)
    finally:
        parts.close()


def _iterate(parts: Parts, projections: DataFrame, beta: float, iterations: int, rounds, callback) -> DataFrame:
    spark, zero = parts.spark, F.lit(0.0)
    local = parts.matrix.groupBy("place", "line").agg(F.sum("value").alias("value"))
    local = parts.put(parts.lines.join(local, ["place", "line"], "left").select("place", "line", "owner", F.coalesce("value", zero).alias("value")), "row-sums")
    sums = parts.put(parts.exchanged(local), "rows")
    parts.drop(local)
    # Measured values count at a line's owner alone, so that the exchange adds them once.
    measured = projections.select("line", F.col("value").cast("double").alias("p")).join(parts.lines.where("owner = place"), "line").select("place", "line", "p")
    measured = parts.put(measured, "measured", placed=False)
    rows = parts.lines.join(sums, ["place", "line"]).join(measured, ["place", "line"], "left")
    rows = parts.put(rows.select("place", "line", "owner", L.inverse(F.col("value")).alias("r"), F.coalesce("p", zero).alias("p")), "weights")
    parts.drop(sums, measured)
    local = parts.put(parts.matrix.groupBy("place", "voxel").agg(F.sum("value").alias("value")), "column-sums")
    columns = parts.put(parts.gathered(local).select("place", "voxel", L.inverse(F.col("value"), beta).alias("c")), "columns")
    parts.drop(local)
    x = parts.put(columns.select("place", "voxel", zero.alias("value")), "image")
    for k in range(iterations):
        began = time.time()
        residual = (F.col("p") - F.coalesce("value", zero)) * F.col("r")
        d = rows.join(parts.product(x, "voxel", "line", _stamp(4096)), ["place", "line"], "left")
        d = parts.put(d.select("place", "line", "owner", residual.alias("value"), "begun", _stamp().alias("ended")), "residual")
        moved = time.time()
        sent, returned = Observation("sent"), Observation("returned")
        z = parts.put(parts.exchanged(d, sent, returned), "exchanged")
        moved = time.time() - moved
        own = parts.product(z, "line", "voxel").select("place", "voxel", "value")
        if parts.slices > 1:
            own = parts.put(own, "step")  # its rows are read twice
        step = parts.gathered(own).select("place", "voxel", F.col("value").alias("step"))
        after = x.join(step, ["place", "voxel"], "left").join(columns, ["place", "voxel"])
        after = parts.put(after.select("place", "voxel", (F.col("value") + F.coalesce("step", zero) * F.col("c")).alias("value")), "image")
        if rounds is not None:
            by = d.groupBy("place").agg(F.min("begun").alias("a"), F.max("ended").alias("b")).collect()  # a row a part
            number = {p: i // parts.slices for i, p in enumerate(parts.places)}
            times: dict[int, float] = {}
            for r in (r for r in by if r.a is not None):
                times[number[r.place]] = times.get(number[r.place], 0.0) + (r.b - r.a) / 1e9
            rounds.append(Round(time.time() - began, moved, sent.get["n"], returned.get["n"], times))
        parts.drop(d, z, x, *[own] * (parts.slices > 1))
        x = after
        if callback:
            callback(parts.image(x), k)
    return keep(parts.image(x), "parts-result") if iterations else spark.createDataFrame([], "voxel long, value double")

