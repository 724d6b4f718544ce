"""The feed's state as streams: an extension for sources that arrive continuously."""

from __future__ import annotations

import json

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def distinct_offers(stream: DataFrame, time: str = "seen_at", key: str = "id", late: str = "2 days") -> DataFrame:
    """The first arrival of each offer; state older than the watermark goes."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def activity(stream: DataFrame, time: str = "ts", group: str = "event_type", value: str = "value", window: str = "1 day", late: str = "1 day") -> DataFrame:
    """Counts and sums by tumbling window and group, final once the watermark passes."""
    rows = stream.withWatermark(time, late).groupBy(F.window(time, window), group)
    out = rows.agg(F.count("*").alias("n"), F.round(F.sum(value), 6).alias("total"))
    return out.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), group, "n", "total")


#: Parts of a snapshot, by a hash of the key.
PARTS = 64


def keep_latest(stream: DataFrame, path: str, checkpoint: str, key: str, time: str, parts: int = PARTS) -> StreamingQuery:
    """Maintain the latest row of each key in a Parquet snapshot; of equal times the greatest row by all its columns.

    Keys fall into ``parts``. A batch reads and writes only the parts that it
    touches, in a folder of its own, and then a list of which folder holds each
    part. A batch that is run again after a failure starts from the list before it
    and leaves the same state. Folders that neither this list nor the one before
    names are dropped. :func:`latest` reads the snapshot.
    """

    def upsert(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        part = F.pmod(F.xxhash64(key), F.lit(parts)).cast("int").alias("part")
        new = batch.select("*", part)
        touched = [r["part"] for r in new.select("part").distinct().collect()]  # at most ``parts``
        held = _listed(path, number - 1)
        old = _read_parts(spark, path, batch, {p: held[p] for p in touched if p in held})
        rows = old.unionByName(new) if old is not None else new
        columns = [F.col(c) for c in batch.columns]
        best = F.max_by(F.struct(*columns), F.struct(F.col(time), *columns)).alias("row")
        rows.groupBy("part", key).agg(best).select("row.*", "part").write.mode("overwrite").partitionBy("part").parquet(f"{path}/batch={number}")
        store, base = fs.FileSystem.from_uri(path)
        now = held | dict.fromkeys(touched, number)
        with store.open_output_stream(f"{base}/parts-{number}.json", compression=None) as out:
            out.write(json.dumps(now).encode())
        for gone in set(_listed(path, number - 2).items()) - set(held.items()) - set(now.items()):
            store.delete_dir(f"{base}/batch={gone[1]}/part={gone[0]}")

    return stream.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _listed(path: str, number: int) -> dict[int, int]:
    """Which batch holds each part, after a batch."""
    store, base = fs.FileSystem.from_uri(path)
    name = f"{base}/parts-{number}.json"
    if number < 0 or store.get_file_info(name).type != fs.FileType.File:
        return {}
    with store.open_input_stream(name, compression=None) as f:
        return {int(p): n for p, n in json.loads(f.read()).items()}


def _read_parts(spark: SparkSession, path: str, like: DataFrame, held: dict[int, int]) -> DataFrame | None:
    if not held:
        return None
    folders = [f"{path}/batch={n}/part={p}" for p, n in sorted(held.items())]
    rows = spark.read.schema(like.schema).parquet(*folders)
    return rows.select("*", F.regexp_extract(F.input_file_name(), r"/part=(\d+)/", 1).cast("int").alias("part"))


def latest(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """The snapshot that :func:`keep_latest` has left, with the columns of ``like``."""
    store, base = fs.FileSystem.from_uri(path)
    names = [f.base_name for f in store.get_file_info(fs.FileSelector(base, allow_not_found=True))]
    done = [int(n[6:-5]) for n in names if n.startswith("parts-") and n.endswith(".json")]
    rows = _read_parts(spark, path, like, _listed(path, max(done))) if done else None
    return rows.drop("part") if rows is not None else like.limit(0)
