"""Shingle sets of texts, and which shingles are frequent in a corpus."""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, tidy

SEED = 42
#: Shingles whose counts a task adds up before it passes on the frequent ones.
WINDOW = 2_000_000
#: Most shingles that count as frequent: as many as have a share of documents that so many cannot reach.
FREQUENT = 500_000
#: Rounding of similarity times size.
EPSILON = 1e-9


def shingles(text: str, words: int) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles; A-Z count as a-z, white space is the six ASCII characters."""
    import xxhash

    parts = text.encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    data, digest = b" ".join(parts), xxhash.xxh64_intdigest
    size = np.fromiter(map(len, parts), np.int64, len(parts))
    end = np.cumsum(size + 1) - 1
    k = min(words, len(parts))
    first, last = (end - size)[: len(parts) - k + 1].tolist(), end[k - 1 :].tolist()
    return np.unique(np.fromiter((digest(data[s:e], SEED) for s, e in zip(first, last, strict=True)), np.uint64, len(first)))


def frequent(docs: DataFrame, words: int, share: float, text_col: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """(sorted shingles that at least ``share`` of all documents have, their ranks by count, 1 the least frequent).

    All documents are counted. A task passes on what is frequent within a window of its own documents; whatever has
    a share of the corpus has that share of some window. The threshold rises, if need be, to where no more than
    ``FREQUENT`` shingles can reach it, so the list that is sent to executors is bounded.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(sets: list[np.ndarray]) -> pa.RecordBatch:
            own = np.concatenate(sets)
            value, n = np.unique(own, return_counts=True)
            often = n >= max(2, ceil(share * len(sets)))
            value, n = value[often].view(np.int64), n[often]
            # The last row has the number of all shingles.
            return pa.RecordBatch.from_arrays([pa.array(np.append(value, 0)), pa.array(np.append(n, len(own))), pa.array(np.append(np.zeros(len(n), bool), True))], ["shingle", "n", "all"])

        held, size = [], 0
        for batch in batches:
            for _, texts in slices(batch.column(0)):
                for t in texts:
                    held.append(shingles(t, words))
                    size += len(held[-1])
                    if size > WINDOW:
                        yield flush(held)
                        held, size = [], 0
        if held:
            yield flush(held)

    n_docs = docs.count()
    counts = docs.select(F.col(text_col).alias("text")).mapInArrow(tidy(run), "shingle long, n long, all boolean").groupBy("all", "shingle").agg(F.sum("n").alias("n"))
    table = counts.filter(F.col("all") | (F.col("n") >= share * n_docs)).orderBy(F.desc("all"), F.desc("n"), "shingle").limit(FREQUENT + 1).toArrow()
    if not table.num_rows:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    n = table["n"].to_numpy()
    hot = table["shingle"].to_numpy()[1:][n[1:] >= n[0] / FREQUENT].view(np.uint64)
    order = np.argsort(hot)
    return hot[order], (len(hot) - np.arange(len(hot)))[order]


def prefix(own: np.ndarray, hot: np.ndarray, rank: np.ndarray, similarity: float) -> np.ndarray:
    """The first shingles of a set in the order that has those in ``hot`` last, by ``rank``.

    Two sets that are similar enough share one of them: more than n - ceil(similarity n) shingles of either may not
    be missing from the other.
    """
    n = len(own)
    if not n:
        return own
    key = np.zeros(n, np.int64)
    if len(hot):
        at = np.minimum(np.searchsorted(hot, own), len(hot) - 1)
        key = np.where(hot[at] == own, rank[at], 0)
    return own[np.argsort(key, kind="stable")[: n - ceil(similarity * n - EPSILON) + 1]]
