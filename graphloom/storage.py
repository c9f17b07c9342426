"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import gc
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a folder is made only where it is unset and Spark runs locally."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="graphloom-"))
    return context._jsc.sc().getCheckpointDir().get()


def shared_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder; what is written there goes when the application ends."""
    path = f"{shared_dir(spark).rstrip('/')}/graphloom/{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def shared_table(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again.

    It cuts lineage, and a lost executor costs no more than its running tasks. The files go when
    the application ends.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._shared_path = path
    return table


#: Bytes of an Arrow batch; bytes of a shuffle that a task reads, about, and the parts that it is dealt in at least.
BATCH_BYTES, TASK_BYTES, PARTS = 1 << 19, 8 << 20, 200


def bound_batches(spark: SparkSession) -> None:
    """Python workers get batches of BATCH_BYTES at most, whatever the length of the rows; a bound of the session's own stays."""
    _bound(spark, "spark.sql.execution.arrow.maxBytesPerBatch", 64 << 20, BATCH_BYTES)


def bound_tasks(spark: SparkSession) -> None:
    """Tasks read about TASK_BYTES of a shuffle: larger tables are more tasks, not larger ones, so what one sorts or
    aggregates stays as it is. A bound of the session's own stays."""
    _bound(spark, "spark.sql.adaptive.advisoryPartitionSizeInBytes", 64 << 20, TASK_BYTES)
    parts = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    if spark.conf.get(parts, None) is None and int(spark.conf.get("spark.sql.shuffle.partitions")) < PARTS:
        spark.conf.set(parts, str(PARTS))


def _bound(spark: SparkSession, key: str, default: int, value: int) -> None:
    if spark.conf.get(key).rstrip("b") == str(default):
        spark.conf.set(key, str(value))


def exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def has_rows_files(spark: SparkSession, path: str) -> bool:
    """Whether a Parquet table's folder holds files of rows; a run that was killed may leave one without."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/*.parquet")
    found = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(target)
    return found is not None and len(found) > 0


def append_by_task(rows: DataFrame, path: str) -> None:
    """Appends the rows; what a task has written stays when it ends, even if the job is killed after.

    A task that runs again writes the file of the same name, so no row is there twice.
    """
    rows.write.mode("append").option("mapreduce.fileoutputcommitter.algorithm.version", "2").parquet(path)


def broadcast_if_small(df: DataFrame, max_rows: int = 10_000) -> DataFrame:
    """A broadcast hint where a count shows at most ``max_rows`` rows; else left to the planner."""
    from pyspark.sql import functions as F

    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def discard(spark: SparkSession, *tables: DataFrame) -> None:
    """Removes tables of ``shared_table`` that nothing reads any more, and asks the JVM to let go of unused shuffles.

    Spark removes the files of a shuffle or broadcast when the driver collects the object that
    stands for it; a driver with memory to spare would keep them for long. The first collection lets
    go of what the last call still held, so there are two.
    """
    for table in tables:
        _remove(spark, table._shared_path)
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.2)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder, if it is there."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session may have ended before the interpreter
        return
