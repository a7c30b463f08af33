"""Around a running reconstruction: observers of iterations, and a stream of slice requests.

Requests (request_id, kind, slice_id, axis, position) arrive as a stream; ``set`` requests insert or replace a slice,
``remove`` ones delete it. The last request of each slice is the state, kept by the stream for each slice.

``slices`` and ``serve`` give the whole registry after each batch. ``changes`` and ``serve_changes`` give the slices
that a batch changed and nothing else, from state that is kept on disk by slice: what a batch costs grows with its
requests, not with the registry.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..model import Volume
from ..operators.solvers import sirt
from ..storage import shared_dir

CHANGE = "slice_id long, request_id long, kind string, axis int, position double"
#: What is remembered of a slice; ``heard`` is the time of its last request in milliseconds.
REQUEST = "request_id long, kind string, axis int, position double, heard long"
#: State by slice needs this store.
ROCKSDB = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


class Reconstructor:
    """Runs SIRT and tells its observers about each iteration; the newest image is a temporary view."""

    def __init__(self, matrix: DataFrame, projections: DataFrame, beta: float = 0.5, iterations: int = 10, view: str = "current_image"):
        self.matrix, self.projections, self.beta, self.iterations, self.view = matrix, projections, beta, iterations, view
        self.observers: list[Callable[[DataFrame, int], None]] = []

    def observe(self, f: Callable[[DataFrame, int], None]) -> None:
        self.observers.append(f)

    def _notify(self, image: DataFrame, k: int) -> None:
        image.createOrReplaceTempView(self.view)
        for f in self.observers:
            f(image, k)

    def run(self) -> DataFrame:
        return sirt(self.matrix, self.projections, self.beta, self.iterations, callback=self._notify)


def slices(requests: DataFrame) -> DataFrame:
    """slice_id, axis, position of the slices that are set after all requests; works on tables and on streams."""
    last = F.max(F.struct("request_id", "kind", "axis", "position")).alias("last")
    return requests.groupBy("slice_id").agg(last).filter("last.kind = 'set'").select("slice_id", "last.axis", "last.position")


def serve(requests: DataFrame, answer: Callable[[DataFrame], None]):
    """Starts the stream; ``answer`` gets the table of all slices that are set after each batch of requests."""
    query = slices(requests).writeStream.outputMode("complete").option("checkpointLocation", shared_dir(requests.sparkSession, "slices"))
    return query.foreachBatch(lambda batch, _: answer(batch)).start()


class Registry(StatefulProcessor):
    """The last request of one slice. Rows come out only when what is set has changed.

    A request older than the last one changes nothing, also after a removal, so requests may come in any order and
    twice. ``expire``: milliseconds of processing time after which a slice that nobody asked for again is removed and
    forgotten; each request sets the clock anew.
    """

    def __init__(self, expire: int | None = None):
        self.expire = expire

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", REQUEST)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        before = self.last.get() if self.last.exists() else None
        last = tuple(before[:4]) if before else None
        for r in rows:
            if last is None or r.request_id > last[0]:
                last = (r.request_id, r.kind, r.axis, r.position)
        now = timerValues.getCurrentProcessingTimeInMs() if self.expire else 0
        self.last.update((*last, now))
        if self.expire:
            self.handle.registerTimer(now + self.expire)
        shown = tuple(before[1:4]) if before and before[1] == "set" else None
        if last[1] == "set" and shown != last[1:]:
            yield Row(slice_id=key[0], request_id=last[0], kind="set", axis=last[2], position=last[3])
        elif last[1] != "set" and shown:
            yield Row(slice_id=key[0], request_id=last[0], kind="remove", axis=None, position=None)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if not self.last.exists():
            return
        last = self.last.get()
        # Timers of earlier requests also run out; a later request's timer is still to come.
        if last[4] + self.expire > expiredTimerInfo.getExpiryTimeInMs():
            return
        self.last.clear()
        if last[1] == "set":
            yield Row(slice_id=key[0], request_id=last[0], kind="remove", axis=None, position=None)

    def close(self) -> None:
        pass


def changes(requests: DataFrame, expire: int | None = None) -> DataFrame:
    """A stream of the slices that changed: slice_id, request_id, kind (set or remove), axis, position.

    Requests without a slice or an id are ignored; any kind but ``set`` removes. The session needs the settings of
    ``ROCKSDB`` when the stream starts, as ``serve_changes`` gives them.
    """
    known = requests.filter("slice_id IS NOT NULL AND request_id IS NOT NULL")
    known = known.select(F.col("slice_id").cast("long").alias("slice_id"), F.col("request_id").cast("long").alias("request_id"), F.coalesce("kind", F.lit("remove")).alias("kind"), F.col("axis").cast("int").alias("axis"), F.col("position").cast("double").alias("position"))
    return known.groupBy("slice_id").transformWithState(Registry(expire), CHANGE, "Update", "ProcessingTime" if expire else "None")


@contextmanager
def _settings(spark: SparkSession, settings: dict[str, str]):
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def serve_changes(requests: DataFrame, answer: Callable[[DataFrame, int], None], folder: str | None = None, expire: int | None = None, once: bool = False):
    """Starts the stream; ``answer`` gets the changes of each batch and the batch's number.

    ``folder``: where state and progress are kept; a stream started with the same one goes on where the last stopped,
    and may give its last batch again, under the same number. ``once``: end when all that is there has been answered.
    """
    spark = requests.sparkSession
    with _settings(spark, ROCKSDB):
        query = changes(requests, expire).writeStream.outputMode("update").option("checkpointLocation", folder or shared_dir(spark, "slice-state"))
        query = query.trigger(availableNow=True) if once else query
        return query.foreachBatch(answer).start()


def registry(log: DataFrame) -> DataFrame:
    """slice_id, axis, position of the slices that are set, from the changes (batch, *CHANGE) that were written down.

    A slice changes once in a batch at most; a batch that was written twice counts once.
    """
    last = Window.partitionBy("slice_id").orderBy(F.desc("batch"))
    return log.withColumn("n", F.row_number().over(last)).filter("n = 1 AND kind = 'set'").select("slice_id", "axis", "position")


def slice_pixels(changed: DataFrame, image: DataFrame, volume: Volume) -> DataFrame:
    """(slice_id, pixel, value): the voxels of an image in each slice that is set.

    ``position`` is the share of the axis, from 0 to 1, and is held to that range. Pixels are numbered like voxels of
    the volume without the slice's axis. Only layers with a slice leave the image, which is read once; a slice without
    an axis of the volume or a position has no pixels.
    """
    sizes = F.array(*[F.lit(n) for n in volume.voxels])
    shown = changed.filter("kind = 'set'") if "kind" in changed.columns else changed
    places = shown.filter(f"axis BETWEEN 0 AND {volume.dim - 1} AND position IS NOT NULL AND NOT isnan(position)")
    n = F.get(sizes, F.col("axis"))
    layer = F.floor(F.least(F.greatest("position", F.lit(0.0)), F.lit(1.0)) * n)
    places = places.select("slice_id", F.col("axis").cast("int").alias("axis"), F.least(layer, n - 1).cast("long").alias("layer"))
    i = volume.unroll(F.col("voxel"))
    rest = lambda axis: Volume(tuple(m for d, m in enumerate(volume.voxels) if d != axis)).index([x for d, x in enumerate(i) if d != axis])
    layers = F.array(*[F.struct(F.lit(d).alias("axis"), i[d].alias("layer"), rest(d).alias("pixel")) for d in range(volume.dim)])
    return image.select("value", F.inline(layers)).join(places, ["axis", "layer"]).select("slice_id", "pixel", "value")


def part_bounds(parts: DataFrame, volume) -> DataFrame:
    """part, min_d, max_d in the volume's coordinates, as they are announced to observers."""
    from ..operators.exchange import local_volumes

    rows = local_volumes(parts, volume)
    return rows.select("part", *[c for d in range(volume.dim) for c in (F.col(f"origin_{d}").alias(f"min_{d}"), (F.col(f"origin_{d}") + F.col(f"length_{d}")).alias(f"max_{d}"))])
