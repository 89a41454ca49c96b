"""Run streams over files: a sink that takes a batch once, and replays for twins of batch queries and for backfills."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from timeweave.operators.lineage import shared_path, staged

#: State of arbitrary stateful operators lives in RocksDB, with a changelog instead of whole snapshots at every batch.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Session settings for a while; a query keeps those it was started with."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def once(out: str, mode: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that writes each batch to a folder of its own number and overwrites it, so a batch that runs again
    after a failure replaces what it wrote before. In complete mode a batch replaces the whole result."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(out if mode == "complete" else f"{out}/batch={number}")

    return write


def drain(stream: DataFrame, out: str, state: str, mode: str = "append", sink: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Run a stream through what its source has now, from where `state` left off, and return the ended query."""
    with settings(stream.sparkSession, STATE):
        writer = stream.writeStream.outputMode(mode).option("checkpointLocation", state).trigger(availableNow=True)
        query = writer.foreachBatch(sink or once(out, mode)).start()
    query.awaitTermination()
    return query


def read_out(spark: SparkSession, stream: DataFrame, out: str) -> DataFrame:
    """What a stream has written; without a batch that wrote rows, none."""
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(out)
    if not fs_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(fs_path):
        return spark.createDataFrame([], stream.schema)
    return spark.read.schema(stream.schema).option("recursiveFileLookup", True).parquet(out)


def dropped_late(query: StreamingQuery) -> tuple[int, int]:
    """(rows that came in, rows that stateful operators dropped as later than the watermark) of an ended query."""
    progress = query.recentProgress
    return sum(p["numInputRows"] for p in progress), sum(s["numRowsDroppedByWatermark"] for p in progress for s in p["stateOperators"])


def replay(rows: DataFrame, transform: Callable[[DataFrame], DataFrame], mode: str, per_batch: int = 1000) -> DataFrame:
    """Write rows to the shared folder, stream the files through `transform` until none is left, and read what came out."""
    spark: SparkSession = rows.sparkSession
    source, out, state = (shared_path(spark, f"stream-{k}") for k in ("in", "out", "state"))
    rows.write.parquet(source)
    stream = transform(spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", per_batch).parquet(source))
    drain(stream, out, state, mode)
    return read_out(spark, stream, out)


def replay_in_order(rows: DataFrame, slice_of: Column, slices: int, transform: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, list[tuple[int, int]]]:
    """Let rows arrive slice by slice (0 to slices - 1): each slice is one batch of a query that starts again from its
    checkpoint, as a scheduled job does, so state and watermark have to survive. Append mode.

    Returns what came out, and of each slice (rows in, rows dropped as late). A row whose slice is null comes with the last.
    """
    spark: SparkSession = rows.sparkSession
    source, out, state = (shared_path(spark, f"stream-{k}") for k in ("in", "out", "state"))
    arriving = staged(rows.withColumn("__slice", F.coalesce(slice_of, F.lit(slices - 1))), "arriving")
    stream, counts = None, []
    for k in range(slices):
        arriving.where(F.col("__slice") == k).drop("__slice").write.mode("append").parquet(source)
        stream = transform(spark.readStream.schema(rows.schema).parquet(source))
        counts.append(dropped_late(drain(stream, out, state)))
    return read_out(spark, stream, out), counts
