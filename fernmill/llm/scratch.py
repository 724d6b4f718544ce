"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a few ids and hashes that may be broadcast: tens of megabytes.
FEW_ROWS = 1_000_000
#: Bytes of texts among them.
FEW_BYTES = 64 << 20


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; one of our own only where it is unset and all runs on this machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="fernmill-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def remove(spark: SparkSession, path: str) -> None:
    """Delete a scratch path through Hadoop's file system, if it is there."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared folder, deleted when the driver ends."""
    path = f"{shared_dir(spark)}/fernmill-{label}-{uuid.uuid4().hex}"

    def clean() -> None:
        try:
            remove(spark, path)
        except Exception:  # the session has ended: the cluster's own cleaning applies
            pass

    atexit.register(clean)
    return path


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and return a scan of it.

    This cuts lineage as a checkpoint does: a lost executor costs a reread, not
    the work before it.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def few(rows: DataFrame, *long: str) -> DataFrame:
    """A table, marked to be broadcast if a count finds it small enough; else joins shuffle it.

    That is at most ``FEW_ROWS`` short rows; where columns in ``long`` may hold
    texts of any length, at most ``FEW_BYTES`` of those as well.
    """
    size = sum((F.coalesce(F.octet_length(c), F.lit(0)).cast("long") for c in long), F.lit(0).cast("long"))
    n, held = rows.limit(FEW_ROWS + 1).agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).first()
    return F.broadcast(rows) if n <= FEW_ROWS and held <= FEW_BYTES else rows
