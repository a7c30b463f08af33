"""Exact deduplication as a stateful stream.

The documents' digests arrive as a stream whose state is keyed by digest, kept on disk by the RocksDB state
store, and never expires. A key's state holds the identifier of the row that stays, that row's content locator
(file and row number) and the number of rows so far. After the stream has caught up, groups with hits are checked
over the full normalised bytes: rows of one digest are grouped by their bytes, and a group of bytes that does not
hold the row at the locator differs from the content that the state stands for. Such rows are told apart.

The rows to check are picked by a bitmap of fixed size over the digests with hits, so the plan is the same at every
size; the more hits, the more other rows pass the bitmap, to no effect but their shuffle. Equal texts meet on the map
side, so a group with many copies is a few rows after it.

``deliver`` keeps the state in a lasting folder, so that a later delivery is deduplicated against all earlier ones, and
a delivery that failed half-way can be repeated.

Only DataFrame operations run on the data. Edge cases: a null text counts as empty; a null id is larger than
any other, so it stays only where all ids of the group are null; of repeated rows with the smallest id the one
read first stays; an empty table yields no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, exists, keep, located, shared_dir, without

#: Bits of the bitmap that picks rows to check: 16 MiB, sent to all executors.
BITMAP = 1 << 27
#: Bits of one row of a bitmap, as Spark's bitmap functions have it.
BITMAP_ROW = 32768
#: Digests of a state partition, whose number a stream cannot change later.
STATE_ROWS = 100_000
#: Of each state partition: as there may be many on an executor, its share of native memory stays small.
WRITE_BUFFER_MB, STATE_MB = 1, 64
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
FIRST = "struct<no_id: boolean, doc_id: bigint, file: string, row: bigint>"
DIGESTS = f"key binary, first {FIRST}, sha string"


def normalised(text: Column) -> Column:
    """Each run of blank, tab, line feed, vertical tab, form feed or carriage return as one space; null as empty."""
    # Only runs that are not one space already are touched.
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+", " ")


def digest_state(spark: SparkSession, digests: str, at: str, partitions: int) -> DataFrame:
    """Runs the stream over the Parquet folder ``digests`` until it has caught up; the state it leaves at ``at``.

    Columns: key, first (the least struct of the group), n. ``partitions`` counts where the stream starts anew.
    """
    conf = {"spark.sql.streaming.stateStore.providerClass": ROCKSDB, "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true", "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": str(STATE_MB), "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false", "spark.sql.streaming.stateStore.rocksdb.writeBufferSizeMB": str(WRITE_BUFFER_MB), "spark.sql.streaming.stateStore.maintenanceInterval": "10s", "spark.sql.shuffle.partitions": str(partitions)}
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        arriving = spark.readStream.schema(DIGESTS).parquet(digests)
        grouped = arriving.groupBy("key").agg(F.min("first").alias("first"), F.count(F.lit(1)).alias("n"))
        query = grouped.writeStream.outputMode("update").format("noop").option("checkpointLocation", at).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    state = spark.read.format("statestore").load(at)
    names = state.schema["value"].dataType.names
    return state.select(F.col("key.key").alias("key"), F.col("value")[names[0]].alias("first"), F.col("value")[names[1]].alias("n"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest_bits: int = 256) -> DataFrame:
    """Per row: doc_id, keep_id, group_size, kept, text_sha256. ``digest_bits`` below 256 is for tests of collisions."""
    return _groups(*located(docs, "dedup-input"), id_col, text_col, digest_bits).drop("file", "row")


def deliver(docs: DataFrame, folder: str, delivery: str, id_col: str = "doc_id", text_col: str = "text", digest_bits: int = 256) -> DataFrame:
    """The same for one of several deliveries, with the groups of all that came so far; their state is in ``folder``.

    ``folder`` is on storage that driver and executors share, and so must be the deliveries' files, as hits are checked
    against the content at their locators. ``delivery`` is a name of its own for each; one that came before, whole or
    in part, is not counted twice. The least id of all deliveries so far stays, so a later one may take an earlier's place.
    """
    try:
        docs.select("_metadata.row_index")
    except Exception as e:
        raise ValueError("a delivery is read from Parquet files, to which its locators point") from e
    return _groups(*located(docs, "dedup-input"), id_col, text_col, digest_bits, folder.rstrip("/"), delivery).drop("file", "row")


def distinct_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, one of each group of equal texts, with all their columns."""
    docs, names = located(docs, "dedup-input")
    return without(docs, names, _groups(docs, names, id_col, text_col, 256).filter("NOT kept"))


def _marked(rows: DataFrame, hits: DataFrame) -> DataFrame:
    """The ``rows`` whose key's bit is set by ``hits``: all whose key is among them, and some others."""
    place = F.pmod(F.xxhash64("key"), F.lit(BITMAP))  # from 0; the functions' numbers start from 1
    bits = hits.select((place + 1).alias("p")).groupBy(F.expr("bitmap_bucket_number(p)").alias("bits_at")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(p))").alias("bits"))
    bits = F.broadcast(bits)  # at most BITMAP / 8 bytes, in rows of 4 KiB
    marked = rows.select("*", place.alias("marked_at"), (F.floor(place / BITMAP_ROW) + 1).alias("bits_at")).join(bits, "bits_at")
    byte = f"cast(conv(hex(substring(bits, cast(marked_at % {BITMAP_ROW} / 8 as int) + 1, 1)), 16, 10) as int)"
    return marked.filter(f"{byte} & shiftleft(1, cast(marked_at % 8 as int)) <> 0").select(*rows.columns)


def _groups(docs: DataFrame, names: list[str], id_col: str, text_col: str, digest_bits: int, folder: str | None = None, delivery: str = "all") -> DataFrame:
    spark = docs.sparkSession

    def hashed(docs: DataFrame, doc_id: Column, file: str, row: str) -> DataFrame:
        texts = docs.select(doc_id.cast("long").alias("doc_id"), normalised(F.col(text_col)).alias("norm"), F.col(file).alias("file"), F.col(row).alias("row")).withColumn("sha", F.sha2("norm", 256))
        first = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "file", "row")
        return texts.select(F.unhex(F.col("sha").substr(1, max(2, digest_bits // 4))).alias("key"), first.alias("first"), "sha", "norm")

    own = hashed(docs, F.col(id_col), *names)
    at = folder or shared_dir(spark, "dedup")
    arrived = f"{at}/digests/{delivery}"
    if not exists(spark, f"{arrived}/_SUCCESS"):
        own.select("key", "first", "sha").write.mode("overwrite").parquet(arrived)
    digests = spark.read.schema(DIGESTS).parquet(arrived)
    rows = digests.count()
    if not rows:
        return digests.select("first.doc_id", F.col("first.doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.col("sha").alias("text_sha256"), "first.file", "first.row")
    state = keep(digest_state(spark, f"{at}/digests/*", f"{at}/stream", max(1, -(-rows // STATE_ROWS))), "dedup-groups")

    hits = state.filter("n > 1").select("key", F.col("first").alias("stays"))
    checked = _marked(own.select("key", "first", "norm"), hits)
    if folder:  # what an earlier delivery has at the locators of this one's hits
        digests_of_hits = digests.select("key").distinct()
        there = keep(hits.join(digests_of_hits, "key", "left_semi").select("stays.*").join(digests.select("first.file", "first.row"), ["file", "row"], "left_anti"), "dedup-earlier")
        if files := [r.file for r in there.select("file").distinct().collect()]:  # a path a file, not a row
            earlier, place = located(spark.read.parquet(*files), "dedup-earlier-docs")
            earlier = earlier.join(there.select(F.col("file").alias(place[0]), F.col("row").alias(place[1])), place, "left_semi")
            checked = checked.unionByName(hashed(earlier, F.col(id_col), *place).select("key", "first", "norm"))
    texts = checked.groupBy("key", "norm").agg(F.min("first").alias("least")).select("key", "least")
    # The bytes at the locator have the group's least row; any others under the same digest have another.
    collided = texts.join(hits, "key").filter("least.file <> stays.file OR least.row <> stays.row").select("key").distinct()
    collided = keep(collided, "dedup-collisions")

    out = digests.join(state.select("key", F.col("first").alias("stays"), "n"), "key")
    columns = ["first.doc_id", F.col("stays.doc_id").alias("keep_id"), F.col("n").alias("group_size"), ((F.col("first.row") == F.col("stays.row")) & (F.col("first.file") == F.col("stays.file"))).alias("kept"), F.col("sha").alias("text_sha256"), "first.file", "first.row"]
    if collided.isEmpty():
        discard(collided)
        return out.select(*columns)
    if folder:
        raise ValueError("digests of different texts meet; use whole digests")
    # Digests that meet with different bytes: their groups are those of equal bytes. SHA-256 knows no such case.
    apart = own.join(collided, "key", "left_semi")
    groups = apart.groupBy("key", "norm").agg(F.min("first").alias("stays"), F.count(F.lit(1)).alias("n"))
    return out.join(collided, "key", "left_anti").select(*columns).unionByName(apart.join(groups, ["key", "norm"]).select(*columns))


SQL = r"""
WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS sha FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, sha AS text_sha256
FROM t WINDOW w AS (PARTITION BY sha)
"""
