"""Append logs and resumable sinks: batch forms, and their Structured Streaming twins (ST1-ST5)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def latest_state(log: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last event of every key."""
    w = Window.partitionBy(key).orderBy(*[F.desc(c) for c in order])
    return log.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def longest_failure_run(log: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The longest run of successive failures by key; keys without a failure are left out."""
    by = Window.partitionBy(*keys).orderBy(*order)
    island = F.row_number().over(by) - F.row_number().over(Window.partitionBy(*keys, "failed").orderBy(*order))
    runs = log.withColumn("_i", island).where("failed").groupBy(*keys, "_i").agg(F.count(F.lit(1)).alias("run"))
    return runs.groupBy(*keys).agg(F.max("run").alias("longest"))


def append_new(rows: DataFrame, path: str, key: str) -> int:
    """Append the rows whose key the Parquet sink does not hold yet; how many there were."""
    spark = rows.sparkSession
    fresh = rows
    if exists(spark, path):
        fresh = rows.join(spark.read.parquet(path).select(key).distinct(), key, "left_anti")
    fresh = fresh.persist()
    try:
        n = fresh.count()
        if n:
            fresh.write.mode("append").parquet(path)
    finally:
        fresh.unpersist()
    return n


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def run_available(source: DataFrame, path: str, checkpoint: str, key: str, work: Callable[[DataFrame], DataFrame]) -> None:
    """Stream what has arrived through work into the sink, once per key, and stop."""

    def batch(df: DataFrame, _: int) -> None:
        append_new(work(df.dropDuplicates([key])), path, key)

    source.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def update_state(changes: DataFrame, root: str, key: str) -> DataFrame:
    """Keyed state in numbered versions under root: the last version with the rows of changes over it, written as the next.

    A version is complete or not there, and older ones stay, so a run that fails halfway is run again. Returns the new state.
    """
    spark = changes.sparkSession
    version = 0
    while exists(spark, f"{root}/v{version + 1:06d}/_SUCCESS"):
        version += 1
    if version:
        old = spark.read.parquet(f"{root}/v{version:06d}").join(changes.select(key).distinct(), key, "left_anti")
        changes = changes.unionByName(old)
    changes.write.mode("overwrite").parquet(f"{root}/v{version + 1:06d}")
    return spark.read.parquet(f"{root}/v{version + 1:06d}")
