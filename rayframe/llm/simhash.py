"""SimHash near-deduplication with bit-sliced comparison.

Fingerprints within ``radius`` of each other agree in at least two of ``radius + 2`` runs of bits, so each
distinct fingerprint goes to one bucket for every pair of runs. Within the buckets of a task, 64 fingerprints
at a time are stored as bit planes; a fingerprint is compared with a block of 64 by adding the planes that
differ to carry-save bitwise counters, and is done with the block once all 64 distances exceed the radius.
Of the links found only a spanning forest of stars leaves a task, and components are found over all of them.

Equal fingerprints are one row before anything is compared. A bucket above ``BUCKET`` fingerprints is cut into
chunks, and each pair of chunks is a bucket of its own; no link is lost and no task gets it whole.

Edge cases: a null or blank text has the fingerprint zero and is linked like any other; fewer words than a
shingle's make one shingle; a null id takes part but is never a component's id unless all ids are null;
repeated rows yield a row each; an empty table yields no row.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep, slices, tidy
from .graph import components, forest

BITS = 64
SEED = 42
#: Most fingerprints of a bucket that are compared in one task; larger buckets are cut into chunks.
BUCKET = 20_000
#: Rows of a task that are compared at a time, besides a last bucket.
ROWS = 200_000
#: Bytes of large buckets' keys that are sent to all executors; beyond it they are joined by a shuffle.
BROADCAST_KEYS = 8 << 20


def mixed(x: np.ndarray, k: int) -> np.ndarray:
    """splitmix64 of the k-th stream."""
    with np.errstate(over="ignore"):
        z = x + np.uint64((0x9E3779B97F4A7C15 * (k + 1)) & 0xFFFFFFFFFFFFFFFF)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def fingerprint(text: str, words: int) -> int:
    """The fingerprint of one text as an unsigned 64-bit integer."""
    import xxhash

    parts = text.encode().lower().split()  # both of bytes: A-Z only, and the six ASCII white-space characters
    if not parts:
        return 0
    data, digest = b" ".join(parts), xxhash.xxh64_intdigest
    size = np.fromiter(map(len, parts), np.int64, len(parts))
    end = np.cumsum(size + 1) - 1
    k = min(words, len(parts))
    first, last = (end - size)[: len(parts) - k + 1].tolist(), end[k - 1 :].tolist()
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(first), 1 << 16):
        h = np.array([digest(data[s:e], SEED) for s, e in zip(first[i : i + (1 << 16)], last[i : i + (1 << 16)], strict=True)], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(first), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, fp (the fingerprint's bits as a signed long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(t, words) for _, texts in slices(batch.column(1)) for t in texts], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(tidy(run), "doc_id long, fp long")


def near_steps(fp: np.ndarray, group: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs (places a < b) of fingerprints within ``radius`` of the same group, in steps; ``group`` is sorted.

    Each fingerprint is compared with the blocks of 64 that reach to its group's end, one block a step. Near pairs
    across groups that share a block come too.
    """
    n = len(fp)
    blocks = -(-n // BITS)
    lanes = np.zeros(blocks * BITS, np.uint64)
    lanes[:n] = fp
    bits = np.unpackbits(lanes.view(np.uint8).reshape(blocks, BITS, 8), axis=2, bitorder="little")  # block, lane, bit
    planes = np.ascontiguousarray(np.packbits(bits.transpose(2, 0, 1), axis=2, bitorder="little")).view("<u8").reshape(BITS, blocks)
    del bits
    end = np.searchsorted(group, group, "right")  # one past the group's last row
    full, one = np.uint64(0xFFFFFFFFFFFFFFFF), np.uint64(1)
    counters = max(1, radius.bit_length())
    query, step = np.arange(n), 0
    while True:
        block = query // BITS + step
        query = query[block * BITS < end[query]]
        if not len(query):
            return
        block = query // BITS + step
        # Lanes at or before the fingerprint itself, and those past the last row, count as too far away.
        over = np.where(step == 0, full >> (np.uint64(BITS - 1) - (query % BITS).astype(np.uint64)), np.uint64(0))
        tail = n - block * BITS
        over = np.where(tail < BITS, over | (full << np.minimum(tail, BITS - 1).astype(np.uint64)), over)
        live = np.flatnonzero(over != full)
        q, w, over = query[live], block[live], over[live]
        value, count = fp[q], [np.zeros(len(q), np.uint64) for _ in range(counters)]
        for b in range(BITS):
            carry = planes[b][w] ^ (np.uint64(0) - ((value >> np.uint64(b)) & one))
            for i in range(counters):  # carry-save: add one bit to every lane's counter
                count[i], carry = count[i] ^ carry, count[i] & carry
            over |= carry
            if b % 4 == 3:
                over |= _exceeds(count, radius)
                live = np.flatnonzero(over != full)
                if len(live) < 0.8 * len(q):
                    q, w, over, value, count = q[live], w[live], over[live], value[live], [c[live] for c in count]
                    if not len(q):
                        break
        if len(q):
            over |= _exceeds(count, radius)
            hit = np.unpackbits((~over).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            i, lane = np.nonzero(hit)
            if len(i):
                yield q[i], w[i] * BITS + lane
        step += 1


def near_pairs(fp: np.ndarray, group: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Stars that join what pairs within ``radius`` of the same group join; ``group`` is sorted.

    A star's ends need not be near each other, but a chain of near pairs joins them.
    """
    n, found_a, found_b, held = len(fp), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0

    def stars() -> tuple[np.ndarray, np.ndarray]:
        label = forest(n, np.concatenate(found_a), np.concatenate(found_b))
        at = np.flatnonzero(label != np.arange(n))
        return at, label[at]

    for a, b in near_steps(fp, group, radius):
        found_a.append(a)
        found_b.append(b)
        held += len(a)
        if held > 2_000_000 + n:
            a, b = stars()
            found_a, found_b, held = [a], [b], len(a)
    return stars()


def _exceeds(count: list[np.ndarray], radius: int) -> np.ndarray:
    """Lanes whose counter is above ``radius``; the counters are bit planes, the lowest first."""
    above, equal = np.zeros_like(count[0]), ~np.zeros_like(count[0])
    for i in reversed(range(len(count))):
        if radius >> i & 1:
            equal &= count[i]
        else:
            above |= equal & count[i]
            equal &= ~count[i]
    return above


def chunks(rows: DataFrame, keys: list[str], by: str, bucket: int) -> DataFrame:
    """``rows`` with the pair of chunks (i <= j) in which each is compared; groups of ``bucket`` rows or less have one.

    A larger group is cut into chunks by the hash of ``by``, and every pair of chunks meets once.
    """
    large = keep(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("chunked_rows")).filter(F.col("chunked_rows") > bucket), "large-buckets")
    n = large.count()
    if not n:
        return rows.select("*", F.lit(0).alias("i"), F.lit(0).alias("j"))
    both = rows.join(F.broadcast(large) if n * 32 <= BROADCAST_KEYS else large, keys, "left")
    number = F.ceil(F.col("chunked_rows") / bucket).cast("int")
    own = F.pmod(F.xxhash64(by), number).cast("int")
    # One chunk with itself is (i, i); with another, the pair in order. A group without chunks is (0, 0).
    others = F.when(F.col("chunked_rows").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.coalesce(number, F.lit(1)) - 1))
    cut = both.select(*rows.columns, F.coalesce(own, F.lit(0)).alias("i"), F.explode(others).alias("j"))
    return cut.select(*rows.columns, F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"))


def links(classes: DataFrame, radius: int, bucket: int = BUCKET) -> DataFrame:
    """(a, b): stars that join the same fingerprints as all links between the distinct ``classes.fp``."""
    runs = radius + 2
    edges = [round(i * BITS / runs) for i in range(runs + 1)]
    masks = [sum(((1 << edges[r + 1]) - (1 << edges[r])) for r in pair) for pair in combinations(range(runs), 2)]
    keys = [F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m)).alias("key")) for t, m in enumerate(masks)]
    rows = classes.select("fp", F.explode(F.array(*keys)).alias("k")).select("k.t", "k.key", "fp")
    rows = chunks(rows, ["t", "key"], "fp", bucket)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(fp: np.ndarray, group: np.ndarray) -> pa.RecordBatch:
            a, b = near_pairs(fp.view(np.uint64), group, radius)
            return pa.RecordBatch.from_arrays([pa.array(fp[a]), pa.array(fp[b])], ["a", "b"])

        last, serial = None, 0
        fps, groups, held = [], [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            fp, cols = batch.column(4).to_numpy(), np.stack([batch.column(i).to_numpy().astype(np.int64) for i in range(4)], 1)
            new = (cols[1:] != cols[:-1]).any(1)
            serial += int(last is not None and (cols[0] != last).any())
            group = serial + np.append(0, np.cumsum(new))
            serial, last = int(group[-1]), cols[-1]
            fps, groups, held = [*fps, fp], [*groups, group], held + len(fp)
            if held > ROWS:
                fp, group = np.concatenate(fps), np.concatenate(groups)
                cut = int(np.searchsorted(group, group[-1]))  # the last group may go on
                if cut:
                    yield flush(fp[:cut], group[:cut])
                fps, groups, held = [fp[cut:]], [group[cut:]], len(fp) - cut
        if held:
            yield flush(np.concatenate(fps), np.concatenate(groups))

    ordered = rows.select("t", "key", "i", "j", "fp").repartition("t", "key", "i", "j").sortWithinPartitions("t", "key", "i", "j")
    return ordered.mapInArrow(tidy(compare), "a long, b long")


def near_dedup(docs: DataFrame, words: int = 5, radius: int = 2, id_col: str = "doc_id", text_col: str = "text", bucket: int = BUCKET) -> DataFrame:
    """Per row: doc_id, fingerprint (16 hex digits), component_id (the least id reachable over links)."""
    out = _components(keep(fingerprints(docs, words, id_col, text_col), "fingerprints"), radius, bucket)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _components(fps: DataFrame, radius: int, bucket: int) -> DataFrame:
    """``fps`` with root (a fingerprint of the component) and component_id."""
    classes = keep(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "fingerprint-classes")
    roots = components(links(classes, radius, bucket))
    joined = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    return fps.join(joined.select("fp", "root").join(least, "root"), "fp")
