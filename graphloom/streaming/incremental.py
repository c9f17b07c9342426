"""Growing graphs from streams: the union of graphs is idempotent, so batches may come again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.storage import shared_table

TRIPLES = "graph_id string, s string, p string, o string"
KEYS = ["graph_id", "s", "p", "o"]
#: Hash buckets that each batch's folder is divided into.
BUCKETS = 32
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def union_stream(spark: SparkSession, source: str, target: str, checkpoint: str):
    """Starts a stream that adds the source folder's new triples to the target table, once each.

    The triples that a checkpoint has seen are the keys of its state, looked up in the executors'
    stores: a batch costs what its own triples cost, however large the target is. Where other
    checkpoints write to the same target, what is new to this one is also held against theirs, in the
    hash buckets that it falls in; two that run at the same time may both write a triple.

    A checkpoint has a name of its own, kept beside its offsets; a batch is written under that name
    and its number, so a batch that is run again after a failure overwrites what it had written and
    nothing else. ``union_table`` reads the target.
    """
    run = _name_of(spark, checkpoint)
    bucket = F.pmod(F.xxhash64(*KEYS), F.lit(BUCKETS)).cast("int").alias("bucket")

    def add(batch: DataFrame, number: int) -> None:
        fresh, others = batch.select(*KEYS, bucket), _others(batch.sparkSession, target, run)
        if others is not None:
            fresh = shared_table(fresh, "fresh")  # the state is asked once
            met = [r["bucket"] for r in fresh.select("bucket").distinct().collect()]  # BUCKETS at most
            known = others.where(F.col("bucket").isin(met)).alias("known")
            same = [F.col(f"fresh.{k}").eqNullSafe(F.col(f"known.{k}")) for k in ["bucket", *KEYS]]
            fresh = fresh.alias("fresh").join(known, same, "left_anti")
        fresh.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{target}/run={run}/batch={number}")

    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKS)  # a stream keeps the settings it starts with
    try:
        stream = spark.readStream.schema(TRIPLES).parquet(source).dropDuplicates(KEYS)
        return stream.writeStream.foreachBatch(add).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        spark.conf.set(PROVIDER, before)


def union_table(spark: SparkSession, target: str) -> DataFrame:
    """The triples that streams have added to a target; none where there is no target."""
    path, files = _files(spark, target)
    return (_written(spark, target) if files.exists(path) else spark.createDataFrame([], TRIPLES)).select(*KEYS)


def _written(spark: SparkSession, target: str) -> DataFrame:
    return spark.read.schema(f"{TRIPLES}, run string, batch long, bucket int").parquet(target)


def _files(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _name_of(spark: SparkSession, checkpoint: str) -> str:
    """The checkpoint's name: that of the folder names/<name> in it, made when first asked for."""
    folder, files = _files(spark, f"{checkpoint.rstrip('/')}/names")
    if not files.exists(folder):
        files.mkdirs(_files(spark, f"{checkpoint.rstrip('/')}/names/r{uuid.uuid4().hex}")[0])
    return files.listStatus(folder)[0].getPath().getName()


def _others(spark: SparkSession, target: str, run: str) -> DataFrame | None:
    """What other checkpoints have written; None where they have written nothing."""
    path, files = _files(spark, target)
    found = files.exists(path) and any((n := s.getPath().getName()).startswith("run=") and n != f"run={run}" for s in files.listStatus(path))
    return _written(spark, target).where(F.col("run") != run).select(*KEYS, "bucket") if found else None
