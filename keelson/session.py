"""Session helpers shared by every operator: worker imports, shared folders, lineage cuts."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def ship(spark: SparkSession) -> SparkSession:
    """Make this package importable in Python workers and keep Arrow batches small.

    Batches are bounded by bytes as well as rows, since one text may be very long.
    """
    env = spark.sparkContext.environment
    have = env.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in have:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, have)])
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or on one machine an own one where it is unset."""
    set_to = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not set_to:
        set_to = spark.sparkContext.getCheckpointDir()
        if not set_to:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir is not set: name a folder that driver and executors share")
            set_to = "file://" + tempfile.mkdtemp(prefix="keelson-shared-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(set_to)
    return set_to


ADVISED = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage: write to the shared checkpoint folder and read back, so lost executors lose nothing.

    The shuffle files behind it go as soon as it is written; else they stay until the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    shared_dir(spark)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        # The setting holds for frames that are made under it.
        return df.select("*").checkpoint(eager=True)
    finally:
        spark.conf.set(CLEANUP, before) if before is not None else spark.conf.unset(CLEANUP)


MOST_PARTITION_MB, TABLE_MB_A_PARTITION = 8, 4  # a shuffle of all rows of a table is about twice the table


def spread(spark: SparkSession, table: str) -> SparkSession:
    """Keep shuffle partitions small: as many as ``table``, the largest, needs, and none put together beyond some megabytes.

    Else a task's memory for sorts and groups grows with the tables until 64 MB, compressed, are put together, and beyond
    that if the number of partitions is fixed. Settings that are finer already stay.
    """
    java = spark.sparkContext._jvm
    now = java.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(ADVISED, "64MB"))
    spark.conf.set(ADVISED, str(min(now, MOST_PARTITION_MB << 20)))
    path = java.org.apache.hadoop.fs.Path(table)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    size = files.getContentSummary(path).getLength() if files.exists(path) else 0
    spark.conf.set("spark.sql.shuffle.partitions", str(max(partitions(spark), -(-size // (TABLE_MB_A_PARTITION << 20)))))
    return spark


def fresh_folder(spark: SparkSession, kind: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
