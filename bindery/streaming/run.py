"""Landing tables as batches of files, and running a stream over them to its end."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from bindery.storage import settings

#: Partitions of the state of a stream; fixed when its checkpoint is made.
STATE_PARTITIONS = 8
#: Files of a landing at most.
FILES = 64
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def land(df: DataFrame, path: str, part: Column, parts: int, first: int = 0) -> str:
    """Writes `df` as `parts` landings, one after the other: rows whose `part` is 0, then 1 and so on."""
    for i in range(first, first + parts):
        df.where(part == i).coalesce(1).write.mode("append").parquet(path)
    return path


def spread(df: DataFrame, path: str, part: Column, parts: int) -> int:
    """The same by all tasks: each landing is as many files as the first one, FILES at most, filled up with empty ones, so that a
    micro-batch of that many files is one landing. Returns that number. `df` is read once for each landing, so it should be stored."""
    spark, files, n = df.sparkSession, FILES, 0
    for i in range(parts):
        df.where(part == i).coalesce(files).write.mode("append").parquet(path)
        made = len(spark.read.schema(df.schema).parquet(path).inputFiles()) - n
        files = made if i == 0 else files
        for _ in range(files - made):
            spark.createDataFrame([], df.schema).coalesce(1).write.mode("append").parquet(path)
        n += files
    return files


def landed(spark: SparkSession, path: str, schema, files: int = 1) -> DataFrame:
    """The landings as a stream, `files` of them in a micro-batch, the oldest first. The checkpoint of the query that reads
    it remembers which it has seen, so a query that is started again goes on with the next."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def drained(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Runs a stream over what has landed so far into a table that holds each micro-batch once, even if it is run again."""
    spark = stream.sparkSession
    with settings(spark, spark__sql__streaming__stateStore__providerClass=ROCKS, spark__sql__shuffle__partitions=str(STATE_PARTITIONS)):
        query = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).format("parquet").start(path)
    query.awaitTermination()
    return query


def settled(stream: DataFrame, path: str, checkpoint: str, seconds: float = 0) -> StreamingQuery:
    """Runs a stream with timers until a micro-batch finds nothing new, and for `seconds` at least. Timers keep such a stream at
    work, so it never ends by itself; stopped at any moment, it goes on from its checkpoint, and the table holds each micro-batch once."""
    spark = stream.sparkSession
    with settings(spark, spark__sql__streaming__stateStore__providerClass=ROCKS, spark__sql__shuffle__partitions=str(STATE_PARTITIONS)):
        query = stream.writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(processingTime="200 milliseconds").format("parquet").start(path)
    began = time.monotonic()
    while query.isActive and (time.monotonic() - began < seconds or (p := query.lastProgress) is None or p["numInputRows"] > 0):
        query.awaitTermination(0.2)
    query.stop()
    if (failed := query.exception()) is not None:
        raise failed
    return query


def updated(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Runs a stream of updates over what has landed so far. Each micro-batch writes what it changed under its own number, so one
    that is run again replaces what it wrote; returns the table of all updates."""
    spark = stream.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    with settings(spark, spark__sql__streaming__stateStore__providerClass=ROCKS, spark__sql__shuffle__partitions=str(STATE_PARTITIONS)):
        query = stream.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path).select(*stream.columns)
