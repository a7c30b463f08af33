"""I-Match fingerprints over randomised lexicons.

The lexicon holds the terms whose document frequency, counted over all documents, lies in a band. A document's
distinct lexicon terms are sorted; each of many random subsets of the lexicon keeps some of them, and what it
keeps is hashed to 16 bits (0: nothing kept). The first subset is the whole lexicon, the others keep a term with
probability 1/4, 1/8, ... 1/512, 16 subsets each, so that some suit short and some long documents. The likeness
of two fingerprints is the share of equal hashes among the subsets that keep a term of either, taken over the
sparser subsets from the density on that gives the largest share.

The lexicon's size is bounded: the lower edge of the band is ``low`` of all documents, or the mean number of distinct
terms of a document over ``terms`` if that is more, as no more than ``terms`` terms can reach that share; either
is a share, whatever the corpus's size.

Terms are runs of anything but ASCII white space, punctuation and control characters, A-Z in lower case.
A document without lexicon terms is fingerprinted by all its terms. Edge cases: null text is empty; a text without
terms has the fingerprint of zeros, which is like itself only; ties of ids follow the texts' lengths, then their
compressed bytes; null ids come first, in the order of their texts' hashes, so that many of them are spread over
tasks; a single row is its own next; an empty table yields no row; repeated rows yield a row each.
"""

from __future__ import annotations

import hashlib
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep, slices, tidy
from .simhash import mixed

SUBSETS, GROUPS = 128, 8
#: Subsets that keep a term of either text, of which a share is taken at least.
LEAST = 12
#: Distinct terms that a task counts before it passes them on.
COUNTED = 400_000
#: Of bytes: ASCII letters in lower case and digits, and all bytes of other characters; a space for the rest.
_FOLD = bytes(b if b >= 0x80 else ord(chr(b).lower()) if chr(b).isalnum() else 0x20 for b in range(256))


def terms(text: str) -> set[bytes]:
    return set(text.encode("utf-8", "surrogatepass").translate(_FOLD).split())


def hashes(words: list[bytes]) -> np.ndarray:
    import xxhash

    return np.fromiter((xxhash.xxh64_intdigest(w) for w in words), np.uint64, len(words))


def memberships(h: np.ndarray) -> np.ndarray:
    """(terms, SUBSETS) of 0 and 1: which subsets keep the terms with these hashes."""
    words = np.stack([mixed(h, k) for k in range(11)], 1).view("<u2")  # 44 words of 16 bits
    out, used = np.empty((len(h), GROUPS), np.uint16), 0
    for g in range(GROUPS):  # 16 subsets at a time; one bit in 2^(g+2) is left
        out[:, g] = np.bitwise_and.reduce(words[:, used : used + g + 2], axis=1)
        used += g + 2
    bits = np.unpackbits(out.view(np.uint8), axis=1, bitorder="little")
    bits[:, 0] = 1
    return bits


def signature(h: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """SUBSETS hashes of 16 bits from the sorted distinct terms' hashes and memberships."""
    import xxhash

    out = np.zeros(SUBSETS, np.uint16)
    subset, term = np.nonzero(bits.T)
    data, digest = h[term].tobytes(), xxhash.xxh32_intdigest
    end = 8 * np.cumsum(np.bincount(subset, minlength=SUBSETS))
    start = 0
    for k, e in enumerate(end.tolist()):
        if e > start:
            out[k] = digest(data[start:e]) % 0xFFFF + 1
            start = e
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Of the subsets as sparse as some density or sparser, the share of equal hashes; the density that suits best."""
    either = ((a != 0) | (b != 0)).reshape(GROUPS, -1).sum(1)[::-1].cumsum()
    same = ((a == b) & (a != 0)).reshape(GROUPS, -1).sum(1)[::-1].cumsum()
    if not either[-1]:
        return 1.0
    enough = either >= min(LEAST, either[-1])
    return float((same[enough] / either[enough]).max())


class Fingerprinter:
    """Signatures of texts for one lexicon, a sorted list of terms."""

    def __init__(self, lexicon: list[bytes]):
        self.place = {t: i for i, t in enumerate(lexicon)}
        self.hash = hashes(lexicon)
        self.packed = np.packbits(memberships(self.hash), axis=1) if lexicon else np.zeros((0, SUBSETS // 8), np.uint8)

    def __call__(self, text: str) -> np.ndarray:
        found = terms(text)
        place = self.place
        at = np.array(sorted([place[t] for t in found if t in place]), np.int64)
        if len(at):
            return signature(self.hash[at], np.unpackbits(self.packed[at], axis=1))
        if not found:
            return np.zeros(SUBSETS, np.uint16)
        h = hashes(sorted(found))
        return signature(h, memberships(h))


def document_frequencies(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(term, df) over all documents; a task's counts are added up before they are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: Counter = Counter()

        def batch_of():
            out = pa.RecordBatch.from_arrays([pa.array(list(count), pa.binary()), pa.array(list(count.values()), pa.int64())], ["term", "n"])
            count.clear()
            return out

        for batch in batches:
            for _, texts in slices(batch.column(0)):
                for t in texts:
                    count.update(terms(t))
                if len(count) > COUNTED:
                    yield batch_of()
        if count:
            yield batch_of()

    rows = docs.select(F.col(text_col).alias("text")).mapInArrow(tidy(run), "term binary, n long")
    return rows.groupBy("term").agg(F.sum("n").alias("df"))


def lexicon(docs: DataFrame, low: float = 1e-3, high: float = 0.2, terms: int = 500_000, text_col: str = "text") -> list[bytes]:
    """The terms with a document frequency in the band, sorted; at most ``terms``."""
    df = keep(document_frequencies(docs, text_col), "document-frequencies")
    n, total = docs.count(), df.agg(F.sum("df")).first()[0] or 0
    if not n:
        return []
    # Fewer than terms + 1 terms can have total / terms documents each.
    least = max(low * n, total / terms, 1)
    return sorted(bytes(r.term) for r in df.filter((F.col("df") >= least) & (F.col("df") <= high * n)).select("term").toLocalIterator())


_printers: dict[str, Fingerprinter] = {}


def fingerprint_edits(docs: DataFrame, low: float = 1e-3, high: float = 0.2, terms: int = 500_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has its last half replaced by the first as many characters of the next document.
    """
    spark = docs.sparkSession
    words = spark.sparkContext.broadcast(lexicon(docs, low, high, terms, text_col))
    run_id = uuid.uuid4().hex

    def printer() -> Fingerprinter:
        if run_id not in _printers:
            _printers.clear()
            _printers[run_id] = Fingerprinter(words.value)
        return _printers[run_id]

    def first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        of, pack = printer(), zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            bucket = pa.array(bucket_of(batch.column(0), batch.column(1)))
            for first, texts in slices(batch.column(2)):
                fps = [of(t).tobytes() for t in texts]
                packed = [pack(t.encode("utf-8", "surrogatepass")) for t in texts]
                own = [x.slice(first, len(texts)) for x in (bucket, *batch.columns[:2])]
                yield pa.RecordBatch.from_arrays([*own, pa.array(list(map(len, texts)), pa.int64()), pa.array(fps, pa.binary()), pa.array(packed, pa.binary())], ["bucket", "doc_id", "tie", "n_chars", "fp", "packed"])

    def second_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        of, unpack = printer(), zstandard.ZstdDecompressor().decompress
        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        last = None

        def row(this, text: str, fp: np.ndarray) -> tuple:
            doc_id, own, own_fp = this
            n = len(own)
            edited = own[: n - n // 2] + text[: n // 2]
            efp = of(edited)
            return doc_id, n, hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), _hex(own_fp), _hex(efp), likeness(own_fp, efp), likeness(own_fp, fp)

        bucket = None
        for batch in batches:
            out, held = [], 0
            for b, tail, doc_id, fp, packed in zip(*(batch.column(i) for i in range(5)), strict=True):
                text = unpack(packed.as_buffer().to_pybytes()).decode("utf-8", "surrogatepass")
                fp = np.frombuffer(fp.as_buffer().to_pybytes(), np.uint16)
                if b.as_py() != bucket:
                    bucket, last = b.as_py(), None
                if last is not None:
                    out.append(row(last, text, fp))
                last = None if tail.as_py() else (doc_id.as_py(), text, fp)
                held += 1
                if held >= 2000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)
                    out, held = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    # Null ids are ordered by a hash of their texts and have buckets of their own, as many as the other ids.
    tie = F.when(F.col(id_col).cast("long").isNull(), F.xxhash64(text_col)).otherwise(F.lit(0).cast("long"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), tie.alias("tie"), F.col(text_col).alias("text"))
    ids = rows.select("doc_id", "tie")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    edges = sorted(set(ids.approxQuantile("doc_id", [i / parts for i in range(1, parts)], 0.1 / parts))) if parts > 1 else []
    edges = np.array(edges, np.int64)

    def bucket_of(doc_id: pa.Array, tie: pa.Array) -> np.ndarray:
        known = doc_id.is_valid().to_numpy(zero_copy_only=False)
        own = np.searchsorted(edges, doc_id.fill_null(0).to_numpy(), "right") + parts
        return np.where(known, own, ((tie.to_numpy() / 2.0**64 + 0.5) * parts).astype(np.int64).clip(0, parts - 1)).astype(np.int32)

    def bucketed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(bucket_of(batch.column(0), batch.column(1))), *batch.columns], ["bucket", "doc_id", "tie"])

    # The first document of each bucket also ends the bucket before it; the first of all ends the last.
    least = F.min(F.struct(F.coalesce("doc_id", F.lit(0).cast("long")).alias("id"), "tie"))
    firsts = ids.mapInArrow(tidy(bucketed), "bucket int, doc_id long, tie long").groupBy("bucket").agg(least.alias("least")).select("bucket", "least.*").orderBy("bucket").collect() or [(0, 0, 0)]
    before = [(*firsts[i], firsts[i - 1][0]) for i in range(len(firsts))]
    before = F.broadcast(spark.createDataFrame(before, "bucket int, first_id long, first_tie long, previous int"))  # one row per bucket

    rows = rows.mapInArrow(tidy(first_pass), "bucket int, doc_id long, tie long, n_chars long, fp binary, packed binary").join(before, "bucket")
    own = F.struct(F.col("bucket"), F.lit(False).alias("tail"))
    tail = F.struct(F.col("previous").alias("bucket"), F.lit(True).alias("tail"))
    is_first = (F.coalesce("doc_id", F.lit(0).cast("long")) == F.col("first_id")) & (F.col("tie") == F.col("first_tie"))
    rows = rows.withColumn("at", F.explode(F.when(is_first, F.array(own, tail)).otherwise(F.array(own)))).select("at.bucket", "at.tail", "doc_id", "tie", "fp", "packed", "n_chars")
    rows = rows.repartition(parts, "bucket").sortWithinPartitions("bucket", "tail", F.asc_nulls_first("doc_id"), "tie", "n_chars", "packed")
    return rows.select("bucket", "tail", "doc_id", "fp", "packed").mapInArrow(tidy(second_pass), "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def _hex(fp: np.ndarray) -> str:
    return fp.astype(">u2").tobytes().hex()
