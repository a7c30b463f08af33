"""Stacks of TIFF images as a data source of Spark: ``read_scan`` and ``write_scan``.

A partition is a run of bytes of one file, or of several small files, so that an image may be larger than a task's
memory: a task takes the rows that begin in its run, some megabytes at a time. Filters on ``view`` choose the files
before any is opened. The driver lists files and reads none. Paths are local ones or URIs of a file system that
pyarrow knows; for others there is ``formats.read_stack``, which reads whole files through Spark.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from .images import Layout, encode_tiff, tiff_layout

NAME = "rayframe_scan"
SCHEMA = "view int, line long, pixel_row int, pixel_column int, value double"
#: Bytes of files in a partition, and bytes that a task holds of an image at a time.
PARTITION_BYTES, CHUNK = 64 << 20, 4 << 20
#: What opening a file counts for, in bytes: a task of small images takes 512, a fifth of a second as measured.
OPENING = 1 << 17

TESTS = {
    EqualTo: lambda view, v: view == v,
    In: lambda view, v: view in v,
    GreaterThan: lambda view, v: view > v,
    GreaterThanOrEqual: lambda view, v: view >= v,
    LessThan: lambda view, v: view < v,
    LessThanOrEqual: lambda view, v: view <= v,
}


@dataclass
class Run(InputPartition):
    """(view, path, first byte, byte after the last) of the runs of one partition."""

    pieces: list[tuple[int, str, int, int]]


def _listed(pattern: str) -> list[tuple[int, str, int]]:
    """(view, path, size) of the files of a pattern with one ``*`` in its name for the view's number, by view."""
    if pattern.count("*") != 1 or "*" not in pattern.rsplit("/", 1)[-1]:
        raise ValueError("a stack's path has one * in its last part, for the view's number")
    folder, name = pattern.rsplit("/", 1)
    store, at = fs.FileSystem.from_uri(folder or "/")
    form = re.compile("(\\d+)".join(map(re.escape, name.split("*"))))
    found = [(form.fullmatch(f.base_name), f) for f in store.get_file_info(fs.FileSelector(at)) if f.type == fs.FileType.File]
    return sorted((int(m[1]), f"{folder}/{f.base_name}", f.size) for m, f in found if m)


class ScanReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        given = {k.lower(): v for k, v in options.items()}
        self.pattern, self.size = given["path"], max(1, int(given.get("partitionbytes", PARTITION_BYTES)))
        self.tasks = max(1, int(given.get("tasks", 1)))
        self.filters: list[tuple[type, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if type(f) in TESTS and f.attribute == ("view",) and f.value is not None:
                self.filters.append((type(f), f.value))
            else:
                yield f

    def partitions(self) -> Sequence[InputPartition]:
        out, held, n = [], [], 0
        files = [f for f in _listed(self.pattern) if all(TESTS[kind](f[0], v) for kind, v in self.filters)]
        # As Spark does for files of its own: a small stack is dealt to all tasks.
        share = sum(size + OPENING for *_, size in files) // self.tasks
        most = min(self.size, max(OPENING, share))
        for view, path, size in files:
            if n + size + OPENING > most and held:
                out.append(Run(held))
                held, n = [], 0
            # All runs but a file's last are partitions of their own.
            starts = range(0, max(size, 1), most)
            out += [Run([(view, path, s, s + most)]) for s in starts[:-1]]
            held.append((view, path, starts[-1], size))
            n += size - starts[-1] + OPENING
        return [*out, Run(held)] if held else out

    def read(self, partition: Run | None) -> Iterator[pa.RecordBatch]:
        for view, path, start, end in partition.pieces if partition else ():
            store, at = fs.FileSystem.from_uri(path)
            with store.open_input_file(at) as f:
                try:
                    layout = tiff_layout(lambda a, n: f.read_at(n, a))  # noqa: B023
                    for first, pixels in rows_between(f, layout, start, end):
                        yield _batch(view, layout, first, pixels)
                except (ValueError, zlib.error) as e:
                    raise ValueError(f"{path}: {e}") from e


def rows_between(f, t: Layout, start: int, end: int) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, rows) of an image, some at a time: of plain strips the rows, of deflated ones the strips, that
    begin at bytes from ``start`` to before ``end`` of the file."""
    wide = t.width * t.dtype.itemsize
    step = max(1, CHUNK // max(wide, 1))
    for k, (at, size) in enumerate(zip(t.starts, t.sizes, strict=True)):
        n = min(t.rows, t.height - k * t.rows)
        if n <= 0 or not wide:
            continue
        if t.deflated:
            if start <= at < end:
                yield from _inflated(f, t, k * t.rows, n, at, size, step)
            continue
        if size < n * wide:
            raise ValueError("broken TIFF file: a strip ends too early")
        low, high = (min(n, max(0, -(-(x - at) // wide))) for x in (start, end))
        for r in range(low, high, step):
            m = min(step, high - r)
            yield k * t.rows + r, _pixels(f.read_at(m * wide, at + r * wide), t, m)


def _inflated(f, t: Layout, row: int, n: int, at: int, size: int, step: int) -> Iterator[tuple[int, np.ndarray]]:
    """A deflated strip, inflated as it is read: no more than a chunk is held."""
    wide = t.width * t.dtype.itemsize
    z, done, held = zlib.decompressobj(), 0, b""
    for a in range(at, at + size, CHUNK):
        data = f.read_at(min(CHUNK, at + size - a), a)
        while done < n:
            held += z.decompress(data, step * wide - len(held))
            data = z.unconsumed_tail
            m = min(len(held) // wide, n - done)
            if m:
                yield row + done, _pixels(held[: m * wide], t, m)
                done, held = done + m, held[m * wide :]
            elif not data:
                break
    if done < n:
        raise ValueError("broken TIFF file: a strip ends too early")


def _pixels(data: bytes, t: Layout, rows: int) -> np.ndarray:
    if len(data) < rows * t.width * t.dtype.itemsize:
        raise ValueError("broken TIFF file: a strip ends too early")
    return np.frombuffer(data, t.dtype, rows * t.width).astype(np.float64)


def _batch(view: int, t: Layout, first: int, pixels: np.ndarray) -> pa.RecordBatch:
    at = np.arange(pixels.size, dtype=np.int64) + first * t.width
    columns = [np.full(pixels.size, view, np.int32), view * t.width * t.height + at, (at // t.width).astype(np.int32), (at % t.width).astype(np.int32), pixels]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["view", "line", "pixel_row", "pixel_column", "value"])


class Scan(DataSource):
    """Options: ``path``, ``partitionBytes``, ``tasks`` (that run at a time)."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return ScanReader(dict(self.options))


def read_scan(spark: SparkSession, pattern: str, partition_bytes: int = PARTITION_BYTES) -> DataFrame:
    """view, line, pixel_row, pixel_column, value of every pixel of a stack of TIFF images of one shape.

    ``pattern``: a path with one ``*`` for the view's number. Lines are numbered as in ``geometry.rays``, so view and
    line, with value, are projections. Reading switches Spark's push-down to Python sources on for the session. A stack
    without files has no rows; a folder that is not there, or a file of another kind, raises.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Scan)
    return spark.read.format(NAME).option("path", pattern).option("partitionBytes", str(partition_bytes)).option("tasks", str(spark.sparkContext.defaultParallelism)).load()


def write_scan(pixels: DataFrame, width: int, height: int, pattern: str, dtype: str = "f4") -> DataFrame:
    """Writes an image for each ``view`` of (view, pixel_row, pixel_column, value); (view, path) of what was written.

    Runs when the result is read, one view of a task's at a time, so an image must fit a task's memory. Files are moved
    to their names once they are whole; a task that runs again replaces its own. Pixels without a row, or with a null,
    are 0; of several the last counts; rows outside the image or without a view are left out.
    """
    folder, name = pattern.rsplit("/", 1)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, at = fs.FileSystem.from_uri(folder)
        view, image, done = None, np.zeros((height, width), dtype), []

        def finish() -> None:
            if view is None:
                return
            part, whole = f"{at}/.{uuid.uuid4().hex}", f"{at}/{name.replace('*', str(view))}"
            with store.open_output_stream(part) as f:
                f.write(encode_tiff(image))
            store.move(part, whole)
            done.append(view)

        def written() -> pa.RecordBatch:
            paths = [f"{folder}/{name.replace('*', str(v))}" for v in done]
            return pa.RecordBatch.from_arrays([pa.array(done, pa.int32()), pa.array(paths, pa.string())], ["view", "path"])

        for batch in filter(len, batches):
            views, row, column, value = (c.to_numpy() for c in batch.columns)
            starts = np.flatnonzero(np.diff(views, prepend=views[:1] - 1))
            for s, e in zip(starts, [*starts[1:], len(views)], strict=True):
                if view != int(views[s]):
                    if view is None:
                        store.create_dir(at, recursive=True)
                    finish()
                    view = int(views[s])
                    image[:] = 0
                image[row[s:e], column[s:e]] = value[s:e]
            yield written()
            done.clear()
        finish()
        yield written()

    inside = (F.col("pixel_row") >= 0) & (F.col("pixel_row") < height) & (F.col("pixel_column") >= 0) & (F.col("pixel_column") < width)
    known = pixels.filter(inside & F.col("view").isNotNull()).select("view", "pixel_row", "pixel_column", F.coalesce("value", F.lit(0.0)).cast("double").alias("value"))
    # Views lie together in a task, one after another.
    return known.repartition("view").sortWithinPartitions("view").mapInArrow(write, "view int, path string")
