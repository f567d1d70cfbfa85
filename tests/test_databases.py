"""Tables in databases: over JDBC, in files that machines share, and what a query does on several executors."""

import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from cairn.plans import registry
from cairn.sources import databases

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_shards_keep_every_row_and_value(spark, tmp_path):
    df = spark.range(0, 1000, 1, 7).select("id", F.when(F.col("id") % 3 > 0, F.concat(F.lit("가\"'"), F.col("id").cast("string"))).alias("a b"), (F.col("id") / 7).alias("v"), F.encode(F.col("id").cast("string"), "utf-8").alias("raw"))
    databases.write_shards(df, f"file://{tmp_path}/db", "places")
    got = databases.read_shards(spark, f"file://{tmp_path}/db", "places", df.schema)
    assert got.schema == df.schema and got.rdd.getNumPartitions() == 7
    assert got.exceptAll(df).count() == 0 and df.exceptAll(got).count() == 0
    assert sorted(os.listdir(tmp_path / "db")) == [f"{k:06d}.sqlite" for k in range(7)]
    with pytest.raises(ValueError, match="mount"):
        databases.write_shards(df, "hdfs://x/db", "places")
    with pytest.raises(ValueError, match="day"):
        databases.write_shards(df.select(F.current_date().alias("day")), str(tmp_path / "other"), "places")


def test_jdbc_ranges_keep_every_row(spark):
    url, driver = "jdbc:derby:memory:cairntest;create=true", {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    df = spark.range(0, 100, 1, 3).select(F.when(F.col("id") > 3, F.col("id")).alias("k"), F.col("id").alias("v"))
    databases.write_database(df, url, "places", driver)
    assert sorted(r[1] for r in databases.read_database(spark, url, "places", "k", 4, driver).collect()) == list(range(100))


def test_round_trip_on_several_executors(tmp_path):
    code = f"""
import sys
sys.path.insert(0, {ROOT!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local-cluster[2,1,1024]").config("spark.ui.enabled", "false").config("spark.driver.host", "127.0.0.1").config("spark.checkpoint.dir", "file://{tmp_path}/shared").getOrCreate()
import __spark_entry__
got = __spark_entry__.queries()["database_round_trip"](spark, "/root/testdata/sf0.001")
want = spark.read.parquet("/root/testdata/sf0.001/customer.parquet").select("c_custkey", "c_name", "c_nationkey")
print("DIFFERENT", got.exceptAll(want).count() + want.exceptAll(got).count(), got.count())
"""
    r = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=240, cwd=tmp_path)
    assert "DIFFERENT 0 150" in r.stdout, r.stderr[-2000:]


def test_place_arrays_has_every_place_whatever_the_shuffle(spark, tmp_path):
    """Each array has a file of its own: of two in one file a reader of whole files would take the first."""
    spark.range(40_000).withColumnRenamed("id", "c_custkey").write.parquet(str(tmp_path / "customer.parquet"))
    held = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        for parts in (1, 2, 3, 4, 5, 16):
            spark.conf.set("spark.sql.shuffle.partitions", str(parts))
            got = registry.QUERIES["place_arrays"](spark, str(tmp_path))
            assert tuple(got.agg(F.count("*"), F.count_if(F.col("source") == "late"), F.countDistinct("place_id")).first()) == (40_000, 20_000, 40_000), parts
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
