"""SimHash near-deduplication for a similarity of shingle sets.

Two texts are near copies if the Jaccard similarity of their sets of word runs is at least ``similarity``. Each set
has a SimHash of 1,024 bits. At similarity s a bit differs with probability acos(2 s / (1 + s)) / pi, and more often
in small sets, for which chances are added up; near copies
differ in no more bits than the mean and four standard deviations. Fingerprints meet in a bucket for each shingle of
their sets' first n - ceil(s n) + 1, rare ones first; similar sets share one of these in any order. Within the buckets
the first 64 bits are compared as bit planes with carry-save counters, 64 fingerprints at a time, and blocks that are
too far away are abandoned (``simhash.near_steps``); what is left is compared by all bits. Of a bucket's pairs the
forest of the nearest ones leaves the task, never all pairs, and each of its links is then checked on the whole sets,
so documents are only joined by links that hold. Where one of them does not hold and so leaves a cluster of the forests
in several parts, all near pairs across parts are checked on the whole sets, cut into pairs of chunks: no link within
the radii is lost.

Texts with equal sets are one node. Shingles and sets are told apart by 64-bit hashes.

Edge cases: null and blank texts have the empty set and are copies of each other; fewer words than a shingle's make
one shingle; a null id stays only if all ids of its component are null; of repeated rows the first in its file stays;
an empty table yields no row.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from math import acos, comb, floor, pi, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, keep, located, slices, tidy, without
from .graph import components, forest
from .shingles import EPSILON, SEED, frequent, prefix, shingles
from .simhash import BITS, BUCKET, ROWS, mixed, chunks, near_steps

#: Bits of a fingerprint, of which the first ``BITS`` are compared as planes.
LONG = 1024
#: Shingles of such a share of documents are last in order.
SHARE = 1e-3
#: Pairs of a task that are held before all but the nearest ones go.
PAIRS = 2_000_000
#: Shingles of a chunk of a cluster whose pairs are checked on whole sets.
HELD = 1_000_000


#: Sizes of sets up to which chances are added up exactly; beyond, they are within a hundredth of the limit.
SMALL = 64


@cache
def differing(n: int, similarity: float) -> float:
    """The greatest chance that a bit of a set of ``n`` differs from that of a set as large or larger, at least so similar."""

    def over(x: int, more: int, total: int) -> float:
        return sum(comb(more, j) for j in range(more + 1) if 2 * (x + j) > total) / 2**more

    worst = 0.0
    for own in range(n):
        both = n - own
        if both < similarity * n - EPSILON:
            break
        for other in range(own, n):
            if both < similarity * (both + own + other) - EPSILON:
                break
            chance = 0.0
            for x in range(both + 1):
                p, q = over(x, own, n), over(x, other, both + other)
                chance += comb(both, x) / 2**both * (p * (1 - q) + (1 - p) * q)
            worst = max(worst, chance)
    return worst


def radius(similarity: float, bits: int, deviations: float = 4, size: int | None = None) -> int:
    """Most differing bits of two sets with at least that similarity, to so many standard deviations.

    ``size``: of the smaller set; few shingles tie more often, so that more bits may differ.
    """
    p = acos(2 * similarity / (1 + similarity)) / pi
    if size is not None and size <= SMALL:
        p = max(p, differing(size, similarity))
    return floor(bits * p + deviations * sqrt(bits * p * (1 - p)))


def radii(similarity: float, bits: int) -> np.ndarray:
    """The radius by size of the smaller set, the last for all sizes above ``SMALL``."""
    return np.array([radius(similarity, bits, size=n) for n in range(SMALL + 1)] + [radius(similarity, bits)])


def long_fingerprint(own: np.ndarray) -> np.ndarray:
    """The fingerprint of a set as words of 64 bits: a bit is 1 if set in over half the shingles' hashes."""
    ones, n = np.zeros(LONG, np.int64), len(own)
    for i in range(0, n, 255):  # so many sums hold in a byte
        h = np.stack([mixed(own[i : i + 255], k) for k in range(LONG // 64)], 1)
        ones += np.unpackbits(h.view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.uint8)
    return np.packbits(2 * ones > n, bitorder="little").view("<u8")


def spanning(n: int, a: np.ndarray, b: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Places of the links of a spanning forest of least weight among nodes below ``n``, by Boruvka's rounds."""
    order = np.lexsort((b, a, weight))
    label, chosen, edge = np.arange(n), [np.zeros(0, np.int64)], np.arange(len(a))
    while True:
        la, lb = label[a[order[edge]]], label[b[order[edge]]]
        live = la != lb
        edge, la, lb = edge[live], la[live], lb[live]
        if not len(edge):
            return order[np.unique(np.concatenate(chosen))]
        best = np.full(n, len(order))
        np.minimum.at(best, la, edge)
        np.minimum.at(best, lb, edge)
        pick = np.unique(best[best < len(order)])
        chosen.append(pick)
        label = forest(n, label[a[order[pick]]], label[b[order[pick]]])[label]


def nearest(fp: np.ndarray, group: np.ndarray, short: int, far: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The spanning forest of the nearest pairs within both radii; ``fp`` is (rows, words), ``group`` is sorted.

    ``far`` is a radius a row; the wider of a pair's counts.
    """
    n, found, held = len(fp), [], 0

    def reduced() -> list:
        if not found:
            return [(np.zeros(0, np.int64),) * 3]
        a, b, d = (np.concatenate(x) for x in zip(*found, strict=True))
        k = spanning(n, a, b, d)
        return [(a[k], b[k], d[k])]

    for q, lane in near_steps(np.ascontiguousarray(fp[:, 0]), group, short):
        for i in range(0, len(q), 100_000):
            a, b = q[i : i + 100_000], lane[i : i + 100_000]
            d = np.bitwise_count(fp[a] ^ fp[b]).sum(1, dtype=np.int64)
            near = d <= np.maximum(far[a], far[b])
            found.append((a[near], b[near], d[near]))
            held += int(near.sum())
        if held > PAIRS + n:
            found = reduced()
            held = len(found[0][0])
    ((a, b, _),) = reduced()
    return a, b


def whole_groups(batches: Iterator[pa.RecordBatch], keys: int, most: int, bytes_: int = 64 << 20) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Rows by whole groups, and their groups' numbers; groups lie together and are told apart by the first ``keys`` columns.

    A table has more than ``most`` rows or ``bytes_`` only where a group or batch does.
    """
    last, serial, held, groups = None, 0, [], []
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = np.stack([batch.column(i).to_numpy().astype(np.int64) for i in range(keys)], 1)
        new = (cols[1:] != cols[:-1]).any(1)
        serial += int(last is not None and (cols[0] != last).any())
        groups.append(serial + np.append(0, np.cumsum(new)))
        held.append(batch)
        serial, last = int(groups[-1][-1]), cols[-1]
        if sum(map(len, held)) > most or sum(x.nbytes for x in held) > bytes_:
            rows, group = pa.Table.from_batches(held), np.concatenate(groups)
            cut = int(np.searchsorted(group, group[-1]))  # the last group may go on
            if cut:
                yield rows.slice(0, cut), group[:cut]
            held, groups = rows.slice(cut).to_batches(), [group[cut:]]
    if held:
        yield pa.Table.from_batches(held), np.concatenate(groups)


def words_of(column: pa.ChunkedArray) -> np.ndarray:
    """All rows' words of 64 bits, one after the other."""
    return np.frombuffer(b"".join(column.to_pylist()), "<u8")


def _rows(docs: DataFrame, names: list[str], words: int, similarity: float, id_col: str, text_col: str) -> DataFrame:
    """Per row: file, row, doc_id, node (of its set), prefix, fp, size."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent(docs, words, SHARE, text_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        hot, rank = shared.value
        for batch in batches:
            for first, texts in slices(batch.column(3)):
                sets = [shingles(t, words) for t in texts]
                node = np.array([xxhash.xxh3_64_intdigest(s.tobytes(), SEED) for s in sets], np.uint64).view(np.int64)
                starts = [prefix(s, hot, rank, similarity) for s in sets]
                offsets = np.cumsum([0, *map(len, starts)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(starts).view(np.int64)))
                own = [batch.column(i).slice(first, len(texts)) for i in range(3)]
                fps = pa.array([long_fingerprint(s).tobytes() for s in sets], pa.binary())
                sizes = pa.array([len(s) for s in sets], pa.int32())
                yield pa.RecordBatch.from_arrays([*own, pa.array(node), lists, fps, sizes], ["file", "row", "doc_id", "node", "prefix", "fp", "size"])

    rows = docs.select(F.col(names[0]).alias("file"), F.col(names[1]).alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(tidy(run), "file string, row long, doc_id long, node long, prefix array<long>, fp binary, size int")


def _candidates(nodes: DataFrame, similarity: float, bucket: int) -> DataFrame:
    """(a, b): the nearest pairs of all buckets."""
    short, far_of, width = int(radii(similarity, BITS).max()), radii(similarity, LONG), LONG // 64
    starts = nodes.select("node", F.explode("prefix").alias("shingle"))
    met = keep(starts.groupBy("shingle").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "near-buckets")
    starts = keep(chunks(starts.join(met, "shingle"), ["shingle"], "node", bucket).drop("n"), "near-members")
    rows = starts.join(nodes.select("node", "fp", "size"), "node").select("shingle", "i", "j", "node", "fp", "size")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, group in whole_groups(batches, 3, ROWS // 2):
            node, size = (rows[c].to_numpy() for c in ("node", "size"))
            a, b = nearest(words_of(rows["fp"]).reshape(-1, width), group, short, far_of[np.minimum(size, SMALL + 1)])
            a, b = node[a], node[b]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    ordered = rows.repartition("shingle", "i", "j").sortWithinPartitions("shingle", "i", "j")
    return ordered.mapInArrow(tidy(compare), "a long, b long").distinct()


def _sets(docs: DataFrame, names: list[str], nodes: DataFrame, pairs: DataFrame, words: int, text_col: str) -> DataFrame:
    """(node, own): the whole sets of all nodes in ``pairs``."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in slices(batch.column(1)):
                sets = [shingles(t, words).tobytes() for t in texts]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(texts)), pa.array(sets, pa.binary())], ["node", "own"])

    wanted = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    places = keep(nodes.join(wanted, "node").select("node", F.col("file").alias(names[0]), F.col("row").alias(names[1])), "near-places")
    if places.count() * 256 <= BROADCAST_ROWS:
        places = F.broadcast(places)
    return keep(docs.join(places, names).select("node", F.col(text_col).alias("text")).mapInArrow(tidy(encode), "node long, own binary"), "near-sets")


def _checked(sets: DataFrame, pairs: DataFrame, similarity: float) -> DataFrame:
    """The ``pairs`` of nodes whose whole sets are similar enough."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                p, q = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                both = len(np.intersect1d(p, q, assume_unique=True))
                good.append(both >= similarity * (len(p) + len(q) - both) - EPSILON)
            yield pa.RecordBatch.from_arrays(batch.columns[:2], ["a", "b"]).filter(pa.array(good, pa.bool_()))

    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("own").alias("own_a")), "a").join(sets.select(F.col("node").alias("b"), F.col("own").alias("own_b")), "b")
    return both.select("a", "b", "own_a", "own_b").mapInArrow(tidy(verify), "a long, b long")


def joined(own: np.ndarray, size: np.ndarray, part: np.ndarray, pairs: Iterator[tuple[np.ndarray, np.ndarray]], similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Those of ``pairs`` whose sets are similar enough and that join parts which no earlier one has joined.

    ``own`` has the sets one after the other, of ``size`` each.
    """
    _, code = np.unique(own, return_inverse=True)
    end = np.cumsum(size)
    sets = np.split(code.astype(np.int32), end[:-1])
    mark = np.zeros(int(code.max(initial=-1)) + 1, bool)
    _, label = np.unique(part, return_inverse=True)
    found_a, found_b = [], []
    for a, b in pairs:
        order = np.argsort(a, kind="stable")
        a, b = a[order], b[order]
        for x, others in zip(*_runs(a, b), strict=True):
            others = others[(label[others] != label[x]) & (size[others] > 0)]
            if not len(others) or not size[x]:
                continue
            mark[sets[x]] = True
            start = np.append(0, np.cumsum(size[others])[:-1])
            both = np.add.reduceat(mark[np.concatenate([sets[o] for o in others])], start, dtype=np.int64)
            mark[sets[x]] = False
            for o in others[both >= similarity * (size[x] + size[others] - both) - EPSILON].tolist():
                if label[o] != label[x]:
                    label[label == label[o]] = label[x]
                    found_a.append(x)
                    found_b.append(o)
    return np.array(found_a, np.int64), np.array(found_b, np.int64)


def _runs(a: np.ndarray, b: np.ndarray) -> tuple[list[int], list[np.ndarray]]:
    """Each value of the sorted ``a`` with its entries of ``b``."""
    value, start = np.unique(a, return_index=True)
    return value.tolist(), np.split(b, start[1:])


def _missed(nodes: DataFrame, sets: DataFrame, pairs: DataFrame, held: DataFrame, similarity: float, bucket: int) -> DataFrame:
    """(a, b): links between parts of a cluster of ``pairs`` which those that ``held`` leave apart."""
    short, far_of, width = int(radii(similarity, BITS).max()), radii(similarity, LONG), LONG // 64
    clusters = components(pairs).select("node", F.col("root").alias("cluster"))
    rows = clusters.join(components(held), "node", "left").select("cluster", "node", F.coalesce("root", "node").alias("part"))
    rows = keep(rows.join(nodes.select("node", "fp", "size"), "node"), "near-clusters")
    whole = rows.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("total"), F.min("part").alias("p"), F.max("part").alias("q"))
    number = F.ceil(F.greatest(F.col("n") / bucket, F.col("total") / HELD, F.lit(1))).cast("int")
    split = keep(whole.filter("p <> q").select("cluster", number.alias("number")), "near-split")
    # Every pair of chunks meets once, every chunk also by itself.
    rows = rows.join(split, "cluster").withColumn("chunk", F.pmod(F.xxhash64("node"), "number").cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("number") - 1)))
    rows = rows.select("cluster", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), "chunk", "node", "part", "fp", "size").join(sets, "node")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, group in whole_groups(batches, 3, ROWS // 2):
            i, j, chunk, node, part, size = (rows[c].to_numpy() for c in ("i", "j", "chunk", "node", "part", "size"))
            fp, far = words_of(rows["fp"]).reshape(-1, width), far_of[np.minimum(size, SMALL + 1)]

            def apart() -> Iterator[tuple[np.ndarray, np.ndarray]]:
                for q, lane in near_steps(np.ascontiguousarray(fp[:, 0]), group, short):
                    for k in range(0, len(q), 100_000):
                        a, b = q[k : k + 100_000], lane[k : k + 100_000]
                        open_ = (group[a] == group[b]) & (part[a] != part[b]) & ((i[a] == j[a]) | (chunk[a] != chunk[b]))
                        a, b = a[open_], b[open_]
                        near = np.bitwise_count(fp[a] ^ fp[b]).sum(1, dtype=np.int64) <= np.maximum(far[a], far[b])
                        yield a[near], b[near]

            a, b = joined(words_of(rows["own"]), size, part, apart(), similarity)
            yield pa.RecordBatch.from_arrays([pa.array(node[a]), pa.array(node[b])], ["a", "b"])

    ordered = rows.select("cluster", "i", "j", "chunk", "node", "part", "fp", "size", "own").repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j")
    return ordered.mapInArrow(tidy(compare), "a long, b long")


def distinct_documents(docs: DataFrame, words: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text", bucket: int = BUCKET) -> DataFrame:
    """The rows of ``docs`` that stay, of each component the one with the least id, with all their columns."""
    docs, names = located(docs, "near-input")
    rows = keep(_rows(docs, names, words, similarity, id_col, text_col), "near-rows")
    nodes = keep(rows.groupBy("node").agg(F.min(F.struct("file", "row", "prefix", "fp", "size")).alias("x")).select("node", "x.*"), "near-nodes")
    pairs = keep(_candidates(nodes, similarity, bucket), "near-pairs")
    sets = _sets(docs, names, nodes, pairs, words, text_col)
    held = keep(_checked(sets, pairs, similarity), "near-held")
    roots = components(held.unionByName(_missed(nodes, sets, pairs, held, similarity, bucket)))
    rows = rows.select("file", "row", "doc_id", "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    rows = keep(rows.select("file", "row", "doc_id", "root"), "near-components")
    stays = rows.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "file", "row")).alias("stays"))
    return without(docs, names, rows.join(stays.select("stays.file", "stays.row"), ["file", "row"], "left_anti"))
