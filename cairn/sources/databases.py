"""Tables of a relational database over JDBC, and of one in files that driver and executors share (SRC10)."""

from __future__ import annotations

import glob
import os
import sqlite3
import uuid
from contextlib import closing
from urllib.parse import urlparse

from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import BinaryType, ByteType, DoubleType, IntegerType, LongType, ShortType, StringType, StructType

# The column types of SQLite that keep a value as it is.
FILE_TYPES = {ByteType: "INTEGER", ShortType: "INTEGER", IntegerType: "INTEGER", LongType: "INTEGER", DoubleType: "REAL", StringType: "TEXT", BinaryType: "BLOB"}


def read_database(spark: SparkSession, url: str, source: str, key: str | None = None, parts: int = 16, options: dict[str, str] | None = None, quote: str = '"') -> DataFrame:
    """A table, or a query in brackets with a name, read in `parts` ranges of a whole-number key; without a key in one task.

    The bounds of the ranges are asked from the database; rows outside of them, and those without a key, are read, too.
    """
    def reader():
        return spark.read.format("jdbc").option("url", url).options(**(options or {}))

    if key is None:
        return reader().option("dbtable", source).load()
    low, high = reader().option("query", f"SELECT MIN({quote}{key}{quote}) AS low, MAX({quote}{key}{quote}) AS high FROM {source}").load().first()
    if low is None or low == high:
        return reader().option("dbtable", source).load()
    return reader().option("dbtable", source).option("partitionColumn", key).option("lowerBound", str(low)).option("upperBound", str(high)).option("numPartitions", str(parts)).load()


def write_database(df: DataFrame, url: str, name: str, options: dict[str, str] | None = None) -> None:
    """Replace a table by df; one connection a partition."""
    df.write.format("jdbc").option("url", url).option("dbtable", name).options(**(options or {})).mode("overwrite").save()


class _Shard(InputPartition):
    def __init__(self, file: str):
        self.file = file


class _ShardReader(DataSourceReader):
    def __init__(self, folder: str, name: str, columns: list[str]):
        self.folder, self.name, self.columns = folder, name, columns

    def partitions(self):
        return [_Shard(f) for f in sorted(glob.glob(f"{glob.escape(self.folder)}/*.sqlite"))]

    def read(self, partition):
        listed = ", ".join(f'"{c}"' for c in self.columns)
        with closing(sqlite3.connect(f"file:{partition.file}?mode=ro", uri=True)) as db:
            yield from db.execute(f'SELECT {listed} FROM "{self.name}"')


class _ShardWriter(DataSourceWriter):
    """A task writes a file of its own and renames it when it is whole, so one that runs again replaces what it left."""

    def __init__(self, folder: str, name: str, fields: list[tuple[str, str]]):
        self.folder, self.name, self.fields = folder, name, fields

    def write(self, iterator):
        shard = f"{self.folder}/{TaskContext.get().partitionId():06d}"
        own = f"{shard}-{uuid.uuid4().hex}.tmp"
        os.makedirs(self.folder, exist_ok=True)
        with closing(sqlite3.connect(own)) as db:
            db.execute("PRAGMA journal_mode = OFF")  # of a broken file nothing is read
            db.execute(f'CREATE TABLE "{self.name}" ({", ".join(f'"{c}" {kind}' for c, kind in self.fields)})')
            db.executemany(f'INSERT INTO "{self.name}" VALUES ({", ".join("?" * len(self.fields))})', (tuple(r) for r in iterator))
            db.commit()
        os.replace(own, f"{shard}.sqlite")
        return WriterCommitMessage()


def _sharded(spark: SparkSession, folder: str, name: str, schema: StructType) -> str:
    """The data source of that table, under its name."""
    at = urlparse(folder)
    if at.scheme not in ("", "file"):
        raise ValueError(f"a database in files needs a folder of a file system that all machines mount, not {folder}")
    kinds = [(f.name, FILE_TYPES.get(type(f.dataType))) for f in schema.fields]
    if missing := [c for c, kind in kinds if kind is None]:
        raise ValueError(f"columns of a type that SQLite does not keep: {', '.join(missing)}")

    class Sharded(DataSource):
        @classmethod
        def name(cls):
            return "cairn_shards"

        def schema(self):
            return schema

        def reader(self, schema):
            return _ShardReader(at.path, name, [c for c, _ in kinds])

        def writer(self, schema, overwrite):
            return _ShardWriter(at.path, name, kinds)

    spark.dataSource.register(Sharded)
    return "cairn_shards"


def write_shards(df: DataFrame, folder: str, name: str) -> None:
    """df as a table of SQLite files in a new folder that driver and executors share, a file a task, with no lock between them."""
    df.write.format(_sharded(df.sparkSession, folder, name, df.schema)).mode("append").save()


def read_shards(spark: SparkSession, folder: str, name: str, schema: StructType) -> DataFrame:
    """What write_shards wrote, a task a file."""
    return spark.read.format(_sharded(spark, folder, name, schema)).load()
