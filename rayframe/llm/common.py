"""What the training-data operators share: rows' places, text slices, word caches."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import discard, exists, keep, shared_dir

#: Bytes of text that a Python worker turns into Python objects at a time.
SLICE_BYTES = 4 << 20
#: Bytes of a list of rows that is sent to all executors; a longer one is joined by a shuffle.
BROADCAST_ROWS = 32 << 20


def located(docs: DataFrame, what: str) -> tuple[DataFrame, list[str]]:
    """``docs`` with two more columns that tell its rows apart: file and row number. (their names)

    Both are read from the Parquet files and so stay the same whenever rows are read again, by whichever task.
    Rows that come from anything but Parquet files are written first.
    """
    try:
        docs.select("_metadata.row_index")
    except AnalysisException:
        docs = keep(docs, what)
    names = ["file", "row"]
    while set(names) & {c.lower() for c in docs.columns}:
        names = [f"{n}_" for n in names]
    return docs.select("*", F.col("_metadata.file_path").alias(names[0]), F.col("_metadata.row_index").alias(names[1])), names


def without(docs: DataFrame, names: list[str], dropped: DataFrame) -> DataFrame:
    """The rows of ``located`` whose place is not among ``dropped`` (columns file, row), without their place."""
    dropped = keep(dropped.select("file", "row"), "dropped-rows")
    keys = dropped.select(F.col("file").alias(names[0]), F.col("row").alias(names[1]))
    if dropped.count() * 256 <= BROADCAST_ROWS:
        keys = F.broadcast(keys)
    return docs.join(keys, names, "left_anti").drop(*names)


def tidy(run):
    """``run`` for mapInArrow, after which a worker gives back the memory it no longer needs.

    Workers are used again for other tasks, and what the allocators hold on to would add up over stages.
    """

    def tidied(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # not glibc
                ctypes.CDLL("libc.so.6").malloc_trim(0)

    return tidied


def crc_mod(doc_id, modulus: int):
    """Column: crc32 of the id written in decimal, modulo ``modulus``; null ids count as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def runs(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """(first row, part) of runs of rows with about ``limit`` bytes."""
    lengths = pc.fill_null(pc.binary_length(texts.cast(pa.large_binary())), 0).to_pylist()
    first = total = 0
    for i, n in enumerate(lengths):
        if i > first and total + n > limit:
            yield first, texts.slice(first, i - first)
            first, total = i, 0
        total += n
    if first < len(lengths):
        yield first, texts.slice(first)


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, list[str]]]:
    """The same with texts as strings; null counts as empty."""
    for first, part in runs(texts, limit):
        yield first, [x or "" for x in part.to_pylist()]


class WordCache:
    """Bounded map from a word to what was computed for it; two generations stand in for recency.

    ``fill(words)`` returns the values of a list of words that are new. ``table(texts)`` returns a dict
    that holds every word of every one of ``texts`` (lists of words). At most ``2 * limit`` entries plus those of one call stay in memory.
    """

    def __init__(self, fill, limit: int = 500_000):
        self.fill, self.limit = fill, limit
        self.young: dict = {}
        self.old: dict = {}

    def table(self, texts) -> dict:
        # Millions of new tuples and strings would set off the cycle collector again and again, for nothing.
        collects = gc.isenabled()
        gc.disable()
        try:
            return self._table(texts)
        finally:
            if collects:
                gc.enable()

    def _table(self, texts) -> dict:
        young = self.young
        if len(young) > self.limit:
            self.old, self.young = young, {}
            young = self.young
        old = self.old
        words, missing = set(), []
        for ws in texts:
            words.update(ws)
        for w in words.difference(young):
            if (v := old.get(w)) is not None:
                young[w] = v
            else:
                missing.append(w)
        if missing:
            young.update(zip(missing, self.fill(missing), strict=True))
        return young


__all__ = ["SLICE_BYTES", "WordCache", "crc_mod", "discard", "exists", "keep", "located", "runs", "shared_dir", "slices", "tidy", "without"]
