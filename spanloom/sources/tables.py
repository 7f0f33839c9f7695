"""Table access: one Parquet file or folder per table under a common folder, which may lie in any store Spark reads."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: A table of fewer bytes than this is dealt out before work on its texts: it may lie in one row group, which is one task.
SPREAD_BYTES = 256 << 20


def tasks(spark: SparkSession) -> int:
    """How many tasks a shuffle of unknown size should have."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def spread(df: DataFrame, key: str, text: str) -> DataFrame:
    """A small table dealt to all cores by a key; a large one as it is, since its files are many tasks anyway. Rows are the same.

    What is made of the text must not be moved below the shuffle, as filters would be; so the text depends, for the optimizer, on the task that reads it.
    """
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size > SPREAD_BYTES:
        return df
    return df.repartition(tasks(df.sparkSession), key).withColumn(text, F.when(F.spark_partition_id() >= 0, F.col(text)))


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: the session's checkpoint folder, or ``spark.checkpoint.dir``; a local master alone gets one of its own, which goes when the driver ends."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not sc.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="spanloom-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def removed_at_exit(spark: SparkSession, path: str) -> str:
    """The path, which is deleted when the driver ends with its JVM still up, on whatever file system it is: results are read lazily, so it cannot go before."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def remove() -> None:
        with contextlib.suppress(Exception):  # a JVM that is gone
            folder = jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(conf).delete(folder, True)

    atexit.register(remove)
    return path


def materialized(df: DataFrame) -> DataFrame:
    """The rows, written as Parquet to the shared folder and read from there: what is used more than once is computed once, and survives lost executors."""
    path = removed_at_exit(df.sparkSession, f"{shared_folder(df.sparkSession).rstrip('/')}/table-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
