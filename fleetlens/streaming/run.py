"""Run a stream over what is there now and hand back its table."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from fleetlens.plans.durable import scratch_path

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def parquet_stream(spark: SparkSession, path: str, files_per_trigger: int | None = None
                   ) -> DataFrame:
    """A table as a stream; ``path`` is one file or a folder of part files."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if files.getFileStatus(where).isFile():  # a stream reads folders
        return reader.option("pathGlobFilter", where.getName()).parquet(where.getParent().toString())
    return reader.parquet(path)


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state in RocksDB, which state processors need."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before) if before else spark.conf.unset(PROVIDER)


def drain(stream: DataFrame, name: str) -> DataFrame:
    """Process all available input into a parquet table in the shared folder, exactly once."""
    spark = stream.sparkSession
    folder = scratch_path(spark, name)
    with rocksdb(spark):
        _finish(stream, folder)
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


def drain_clock(stream: DataFrame, name: str, quiet: int = 2, done: Callable[[DataFrame], bool] | None = None,
                limit_s: float = 600.0) -> DataFrame:
    """``drain`` for a stream with timers on the clock, which goes on without input and never ends itself.

    It is stopped after ``quiet`` batches without input, or when ``done`` of its table holds.
    """
    spark = stream.sparkSession
    folder = scratch_path(spark, name)
    with rocksdb(spark):
        query = (stream.writeStream.format("parquet").outputMode("append")
                 .option("checkpointLocation", f"{folder}/state").trigger(processingTime="0 seconds").start(f"{folder}/out"))
    out = spark.read.schema(stream.schema)
    end, seen, idle = time.monotonic() + limit_s, -1, 0
    try:
        while time.monotonic() < end:
            if not query.isActive:
                raise RuntimeError(f"the stream ended: {query.exception()}")
            for batch in query.recentProgress:
                if batch["batchId"] > seen and "addBatch" in batch["durationMs"]:
                    seen, idle = batch["batchId"], idle + 1 if batch["numInputRows"] == 0 else 0
            if (done is None and idle >= quiet) or (done is not None and seen >= 0 and done(out.parquet(f"{folder}/out"))):
                return out.parquet(f"{folder}/out")
            time.sleep(0.2)
    finally:
        query.stop()
    raise TimeoutError(f"{name} was not done after {limit_s} seconds")


def _finish(stream: DataFrame, folder: str) -> None:
    query = (stream.writeStream.format("parquet").outputMode("append")
             .option("checkpointLocation", f"{folder}/state").trigger(availableNow=True)
             .start(f"{folder}/out"))
    query.awaitTermination()
