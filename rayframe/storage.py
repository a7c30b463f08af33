"""The cluster's shared folder: where lineage is cut."""

from __future__ import annotations

import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession, what: str) -> str:
    """A new folder below ``spark.checkpoint.dir``, which driver and executors share.

    Only a local session without that setting gets a folder of its own.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = base.get() if base.isDefined() else None
    if not base:
        base = Path(tempfile.mkdtemp(prefix="rayframe-")).as_uri()
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/rayframe/{what}-{uuid.uuid4().hex}"


def keep(df: DataFrame, what: str, by: str | None = None) -> DataFrame:
    """``df`` written to the shared folder and read again: lineage ends here and survives lost executors.

    ``by``: a column with few values, each of which gets a folder, so that a filter on it reads nothing else.
    """
    spark = df.sparkSession
    path = shared_dir(spark, what)
    if by:
        df.hint("rebalance", by).write.partitionBy(by).parquet(path)
    else:
        df.write.parquet(path)
    kept = spark.read.schema(df.schema).parquet(path)
    kept._kept_at = path
    return kept


def bucketed(df: DataFrame, what: str, by: str, buckets: int, placed: bool = False) -> DataFrame:
    """``df`` in the shared folder as a table with a file for each bucket of ``by``: joins on ``by`` don't shuffle it.

    ``placed``: the rows lie in these buckets already, as they come from such a table, and are written where they are.
    """
    spark = df.sparkSession
    path = shared_dir(spark, what)
    name = f"rayframe_{uuid.uuid4().hex}"
    (df if placed else df.repartition(buckets, by)).write.bucketBy(buckets, by).option("path", path).format("parquet").saveAsTable(name)
    kept = spark.table(name)
    kept._kept_at, kept._kept_as = path, name
    return kept


def size_of(kept: DataFrame) -> int:
    """Bytes of a table from ``keep``."""
    spark = kept.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(kept._kept_at)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(at).getLength()


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder at ``path``, on whatever file system."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def discard(*kept: DataFrame) -> None:
    """Deletes the folders of tables from ``keep`` and ``bucketed`` that nothing will read any more."""
    for df in kept:
        if name := getattr(df, "_kept_as", None):
            df.sparkSession.sql(f"DROP TABLE IF EXISTS {name}")
        if path := getattr(df, "_kept_at", None):
            at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)
