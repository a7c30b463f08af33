"""WARC archives: writing with segmentation and revisits, reading back with reassembly.

A payload is sent as an HTTP response in chunked transfer framing. A block longer than ``segment_bytes`` is cut
into a first record and continuation records. Equal payloads of at least ``min_revisit`` bytes are stored once,
in the record with the largest id; the others are revisit records that refer to it.

Reading groups continuation records by origin identifier, orders them by segment number, checks that the numbers
are gapless and the lengths add up to the total that the last segment states, then takes off the chunked
framing and compares the payload with its digest. A record that fails says so in ``problem``; where a file is broken,
a row of type ``broken`` says why, and reading goes on at the next place that looks like a record. Archives may be
compressed with gzip, whole or record by record. Files are read once for whole records, whose payloads are never
shuffled, and once for segments.

Archives are written by Spark's text writer: a record's closing blank lines are its line separator, and binary
content passes through it unchanged. So any file system that Spark writes to will do, and a lost task's files are
written anew.

Edge cases: a null payload is empty; of repeated rows with the largest id one is the response; null ids are below
any other; an empty table gives an archive without records; segments may lie in any files in any order.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import located, shared_dir, tidy

#: Most bytes of one archive file, if no record is larger.
FILE_BYTES = 64 << 20
CHUNK = 4096
#: Bytes of the list of repeated payloads that is sent to all executors; beyond it payloads are shuffled to it.
BROADCAST_KEYS = 16 << 20
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
#: Fixed value of the WARC 1.1 standard.
PROFILE = b"http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Digits alone: no sign, space or underscore, and no more than any size needs.
HEX, DECIMAL = re.compile(rb"[0-9A-Fa-f]{1,16}"), re.compile(r"[0-9]{1,19}")
RECORD = "record_id string, record_type string, page_id long, url string, refers_to string, payload_digest string, segment long, origin_id string, total_length long, block binary, problem string"
PAYLOAD = "record_id string, record_type string, page_id long, url string, refers_to string, payload_digest string, payload binary, problem string"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    parts = [payload[i : i + size] for i in range(0, len(payload), size)]
    return b"".join(b"%x\r\n%s\r\n" % (len(p), p) for p in parts) + b"0\r\n\r\n"


def dechunked(body: bytes) -> bytes:
    """The payload of a body in chunked transfer framing; raises ValueError where the framing is broken."""
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        digits = body[at:end].partition(b";")[0].strip(b" \t")
        if not HEX.fullmatch(digits):
            raise ValueError("a chunk's size is no number")
        size = int(digits, 16)
        at = end + 2
        if not size:
            return b"".join(out)
        if body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("a chunk is not as long as it says")
        out.append(body[at : at + size])
        at += size + 2


def record(kind: str, record_id: str, block: bytes, fields: dict[str, object], content_type: str = "application/http;msgtype=response") -> bytes:
    """A record without its two closing line ends."""
    head = {"WARC-Type": kind, "WARC-Record-ID": f"<{record_id}>", "WARC-Date": "1970-01-01T00:00:00Z", **fields, "WARC-Block-Digest": f"sha1:{base32_sha1(block)}", "Content-Type": content_type, "Content-Length": len(block)}
    lines = "".join(f"{k}: {str(v).replace(chr(13), ' ').replace(chr(10), ' ')}\r\n" for k, v in head.items() if v is not None)
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block


def records(page_id, record_id: str, url: str | None, payload: bytes, refers_to: str | None, segment_bytes: int) -> Iterator[bytes]:
    """The records of one payload: a revisit, or a response and its continuations."""
    fields = {"WARC-Target-URI": url, "Page-ID": page_id, "WARC-Payload-Digest": f"sha1:{base32_sha1(payload)}"}
    if refers_to is not None:
        yield record("revisit", record_id, HTTP + b"\r\n", fields | {"WARC-Profile": PROFILE.decode(), "WARC-Refers-To": f"<{refers_to}>"})
        return
    block = HTTP + b"Transfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    parts = [block[i : i + segment_bytes] for i in range(0, len(block), segment_bytes)]
    if len(parts) == 1:
        yield record("response", record_id, block, fields)
        return
    yield record("response", record_id, parts[0], fields | {"WARC-Segment-Number": 1})
    for n, part in enumerate(parts[1:], 2):
        total = len(block) if n == len(parts) else None
        yield record("continuation", f"{record_id}:{n}", part, {"WARC-Target-URI": url, "WARC-Segment-Number": n, "WARC-Segment-Origin-ID": f"<{record_id}>", "WARC-Segment-Total-Length": total}, "application/octet-stream")


def write_archives(pages: DataFrame, path: str, segment_bytes: int = 1 << 20, min_revisit: int = 0, id_col: str = "page_id", url_col: str = "url", body_col: str = "html") -> None:
    """Writes ``pages`` as WARC files below ``path``."""
    body = F.coalesce(F.col(body_col), F.lit("")).cast("binary")
    # A row is named by its place in the input's files, which stays the same whenever it is read again.
    pages, place = located(pages, "warc-input")
    row = F.concat(F.lower(F.hex(F.xxhash64(place[0]))), F.lit("-"), F.col(place[1]).cast("string"))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), body.alias("body"), row.alias("row"))
    rows = rows.withColumn("equal", F.unhex(F.sha2("body", 256)))
    counted = rows.filter(F.octet_length("body") >= min_revisit).groupBy("equal")
    top = counted.agg(F.max(F.struct(F.coalesce("page_id", F.lit(-(1 << 63))), "page_id", "row")).alias("top"), F.count(F.lit(1)).alias("n"))
    top = top.filter("n > 1").select("equal", F.col("top.page_id").alias("top_id"), F.col("top.row").alias("top_row"))
    found = shared_dir(pages.sparkSession, "warc-repeats")
    top.write.parquet(found)
    top = pages.sparkSession.read.schema(top.schema).parquet(found)
    if top.count() * 64 <= BROADCAST_KEYS:
        top = F.broadcast(top)
    rows = rows.join(top, "equal", "left").select("page_id", "url", "body", "row", "top_id", "top_row")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def name(page_id, row):
            return f"urn:page:{'' if page_id is None else page_id}:{row}"

        for batch in batches:
            out, held = [], 0
            for r in zip(*(batch.column(i) for i in range(6)), strict=True):
                page_id, url, payload, row, top_id, top_row = (x.as_py() for x in r)
                other = top_row is not None and top_row != row
                for x in records(page_id, name(page_id, row), url, payload, name(top_id, top_row) if other else None, segment_bytes):
                    out.append(x)
                    held += len(x)
                if held > 8 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])
                    out, held = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])

    text = rows.mapInArrow(tidy(write), "value binary").select(F.col("value").cast("string").alias("value"))
    text.write.option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", max(1, FILE_BYTES // (segment_bytes + 1024))).text(path)


def parse(data: bytes) -> Iterator[tuple]:
    """Rows of RECORD of one archive file."""
    if data[:2] == b"\x1f\x8b":
        try:
            data = gzip.decompress(data)
        except (OSError, EOFError, zlib.error) as e:
            yield (*_broken(f"the file cannot be decompressed: {e}"),)
            return
    at = 0
    while at < len(data):
        try:
            row, end = _record_at(data, at)
        except (ValueError, KeyError) as e:
            yield _broken(f"the record at byte {at} is broken: {e}")
            again = data.find(b"\r\n\r\nWARC/", at)
            if again < 0:
                return
            at = again + 4
            continue
        yield row
        at = end + 4


def _broken(problem: str) -> tuple:
    return (None, "broken", *[None] * 8, problem)


def _record_at(data: bytes, at: int) -> tuple[tuple, int]:
    """(row of RECORD, where its block ends)."""
    if data[at : at + 5] != b"WARC/":
        raise ValueError("no record starts here")
    head_end = data.index(b"\r\n\r\n", at)
    head = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in data[at:head_end].decode().split("\r\n")[1:])}
    start = head_end + 4
    if not DECIMAL.fullmatch(head.get("content-length", "")):
        raise ValueError("its length is no number")
    end = start + int(head["content-length"])
    if end > len(data):
        raise ValueError("it is longer than the file")

    def bare(k):
        return head[k].strip("<>") if k in head else None

    def number(k):
        if not head.get(k):
            return None
        if not DECIMAL.fullmatch(head[k].removeprefix("-")) or not -(1 << 63) <= int(head[k]) < 1 << 63:
            raise ValueError(f"its {k} is no number")
        return int(head[k])

    return (bare("warc-record-id"), head["warc-type"], number("page-id"), head.get("warc-target-uri"), bare("warc-refers-to"), head.get("warc-payload-digest", "").removeprefix("sha1:") or None, number("warc-segment-number"), bare("warc-segment-origin-id"), number("warc-segment-total-length"), data[start:end], None), end


def payload_of(block: bytes) -> bytes:
    head, _, body = block.partition(b"\r\n\r\n")
    fields = {k.strip().lower(): v.strip().lower() for k, _, v in (x.partition(b":") for x in head.split(b"\r\n")[1:])}
    return dechunked(body) if fields.get(b"transfer-encoding") == b"chunked" else body


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of PAYLOAD from (record_id, record_type, page_id, url, refers_to, payload_digest, blocks, problem)."""
    names = [x.split()[0] for x in PAYLOAD.split(", ")]
    for batch in batches:
        payloads, problems = [], []
        for kind, want, parts, problem in zip(*(batch.column(i).to_pylist() for i in (1, 5, 6, 7)), strict=True):
            payload = None
            if kind == "response" and problem is None:
                try:
                    payload = payload_of(b"".join(parts))
                    if want is not None and base32_sha1(payload) != want:
                        problem = "the payload does not match its digest"
                except ValueError as e:
                    problem = str(e)
            payloads.append(payload)
            problems.append(problem)
        yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(6)), pa.array(payloads, pa.binary()), pa.array(problems, pa.string())], names)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row of PAYLOAD per response or revisit; a revisit has no payload of its own."""
    names = [x.split()[0] for x in RECORD.split(", ")]
    kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.string()]

    def parsed(segmented: bool) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for content in batch.column(0):
                    out, held = [], 0
                    for r in parse(content.as_buffer().to_pybytes()):
                        if (r[6] is not None) != segmented or r[1] not in ("response", "revisit", "continuation", "broken"):
                            continue
                        out.append(r)
                        held += len(r[9] or b"")
                        if held > 8 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)
                            out, held = [], 0
                    if out:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

        return spark.read.format("binaryFile").load(path).select("content").mapInArrow(tidy(run), RECORD)

    fields = ["record_id", "record_type", "page_id", "url", "refers_to", "payload_digest"]
    whole = parsed(False).select(*fields, F.array("block").alias("blocks"), "problem")
    segments = parsed(True).withColumn("origin", F.coalesce("origin_id", "record_id"))
    first = F.col("segment") == 1
    grouped = segments.groupBy("origin").agg(
        F.sort_array(F.collect_list(F.struct("segment", "total_length", "block"))).alias("parts"),
        *[F.max(F.when(first, F.col(c))).alias(c) for c in fields[1:]],
    )
    lengths = F.aggregate("parts", F.lit(0).cast("long"), lambda a, p: a + F.octet_length(p["block"]))
    gapless = F.transform(F.col("parts"), lambda p: p["segment"]) == F.sequence(F.lit(1).cast("long"), F.size("parts").cast("long"))
    stated = F.element_at("parts", -1)["total_length"]
    problem = F.when(F.col("record_type").isNull() | ~gapless, "segments are missing or repeated").when(stated.isNull() | (stated != lengths), "the segments' lengths do not add up to the total")
    blocks = F.transform("parts", lambda p: p["block"])  # joined by the task that opens them
    whole = whole.unionByName(grouped.select(F.col("origin").alias("record_id"), *fields[1:], blocks.alias("blocks"), problem.alias("problem")))
    return whole.mapInArrow(tidy(_opened), PAYLOAD)


def round_trip(pages: DataFrame, segment_bytes: int = 1 << 14) -> DataFrame:
    """Per row of ``pages``: page_id, payload_bytes, payload_digest, record_type, refers_to, from archives written and read."""
    spark = pages.sparkSession
    path = shared_dir(spark, "warc")
    write_archives(pages, path, segment_bytes)
    # Only what is asked for of each payload is kept, so that the archives are opened once.
    kept = shared_dir(spark, "warc-records")
    rows = read_archives(spark, path).select("record_id", "record_type", "page_id", "refers_to", "payload_digest", F.octet_length("payload").cast("long").alias("payload_bytes"), "problem")
    rows.write.parquet(kept)
    rows = spark.read.schema(rows.schema).parquet(kept)
    if bad := rows.filter("problem IS NOT NULL").first():
        raise ValueError(f"record {bad.record_id}: {bad.problem}")
    there = rows.filter("record_type = 'response'").select(F.col("record_id").alias("refers_to"), F.col("page_id").alias("there_id"), F.col("payload_bytes").alias("there_bytes"))
    out = ["page_id", "payload_bytes", "payload_digest", "record_type"]
    responses = rows.filter("record_type = 'response'").select(*out, F.lit(None).cast("long").alias("refers_to"))
    revisits = rows.filter("record_type = 'revisit'").drop("payload_bytes").join(there.withColumnRenamed("there_bytes", "payload_bytes"), "refers_to")
    return responses.unionByName(revisits.select(*out, F.col("there_id").alias("refers_to")))
