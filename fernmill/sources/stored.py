"""Intermediate tables and notes in the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import hashlib
import tempfile
import uuid
from collections.abc import Callable

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession


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
    """Delete a path through Hadoop's file system, if it is there."""
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


def stored(rows: DataFrame, label: str) -> DataFrame:
    """Write ``rows`` to the shared folder and return a scan of them.

    Plans that use the rows several times, or lose an executor, read the file
    again and call nothing again.
    """
    spark = rows.sparkSession
    path = new_path(spark, label)
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


class Interrupted(Exception):
    """A call that an earlier attempt began and did not finish."""


class Noted(Exception):
    """The failure that a call had when it was made."""


class Ledger:
    """Notes of calls in a shared folder: what was begun, what it answered, and whether to stop.

    A task that runs again finds the answers and failures of its first run, so
    calls are made once; one that was begun and left neither counts as made and is
    not repeated.
    """

    def __init__(self, folder: str) -> None:
        self.folder = folder.rstrip("/")

    def _at(self, kind: str, key: str) -> tuple[fs.FileSystem, str]:
        store, base = fs.FileSystem.from_uri(self.folder)
        return store, f"{base}/{kind}/{hashlib.sha256(key.encode()).hexdigest()}"

    def _read(self, kind: str, key: str) -> str | None:
        store, path = self._at(kind, key)
        if store.get_file_info(path).type != fs.FileType.File:
            return None
        with store.open_input_stream(path) as f:
            return f.read().decode()

    def _write(self, kind: str, key: str, value: str) -> None:
        store, path = self._at(kind, key)
        store.create_dir(path.rpartition("/")[0], recursive=True)
        part = f"{path}.{uuid.uuid4().hex}"
        with store.open_output_stream(part) as f:
            f.write(value.encode())
        store.move(part, path)

    def answer(self, key: str) -> str | None:
        return self._read("answers", key)

    def begin(self, key: str) -> bool:
        """Note that a call begins; false if it has begun before."""
        if self._read("begun", key) is not None:
            return False
        self._write("begun", key, key)
        return True

    def finish(self, key: str, answer: str) -> None:
        self._write("answers", key, answer)

    def once(self, key: str, call: Callable[[], str]) -> str:
        """The noted answer, or that of ``call``, which is made at most once."""
        if (known := self.answer(key)) is not None:
            return known
        if (failure := self._read("failures", key)) is not None:
            raise Noted(failure)
        if not self.begin(key):
            raise Interrupted("an earlier attempt made this call and left no answer")
        try:
            answer = call()
        except Exception as e:
            self._write("failures", key, f"{type(e).__name__}: {e}")
            raise
        self.finish(key, answer)
        return answer

    def stop(self, reason: str) -> None:
        """No more calls, in any task."""
        self._write("stop", "", reason)

    def stopped(self) -> str | None:
        return self._read("stop", "")

    def begun(self) -> list[str]:
        """Keys of all calls that were begun."""
        store, base = fs.FileSystem.from_uri(self.folder)
        out = []
        for f in store.get_file_info(fs.FileSelector(f"{base}/begun", allow_not_found=True)):
            with store.open_input_stream(f.path) as data:
                out.append(data.read().decode())
        return sorted(out)
