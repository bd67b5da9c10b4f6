"""Findings of a growing edge table: each micro-batch is joined into the snapshot and the difference is kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def watch(stream: DataFrame, state: str, find: Callable[[DataFrame], DataFrame], checkpoint: str, once: bool = True) -> StreamingQuery:
    """Appends each batch of edges to ``state``/edges and writes new and gone findings to ``state``/changes.

    A batch that is run again overwrites its own folders, so results are exactly-once.
    """

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{state}/edges/batch={number:08d}")
        now = find(spark.read.parquet(f"{state}/edges").drop("batch"))
        now.write.mode("overwrite").parquet(f"{state}/findings/{number:08d}")
        now = spark.read.parquet(f"{state}/findings/{number:08d}")
        before = spark.read.parquet(f"{state}/findings/{number - 1:08d}") if number else now.limit(0)
        new, gone = now.exceptAll(before).selectExpr("'new' as change", "*"), before.exceptAll(now).selectExpr("'gone' as change", "*")
        new.unionByName(gone).write.mode("overwrite").parquet(f"{state}/changes/{number:08d}")

    writer = stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
