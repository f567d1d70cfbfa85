"""Session helpers: a builder for tests and benches, scratch space, and shipping of the package to executors."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

PACKAGE_ROOT = Path(__file__).resolve().parent
#: Rows that a task gets where a table is dealt by a key.
ROWS_A_TASK = 500_000


def local_session(cpus: int | str = 8, app: str = "cairn", memory: str = "8g") -> SparkSession:
    """A local session for tests and benches; on a cluster the caller brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that driver and executors share (spark.checkpoint.dir).

    Only where that setting is absent and all runs on one machine, as in tests, a temporary folder stands in for it; a
    cluster without the setting is an error, as its executors see no folder of the driver.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = f"file://{tempfile.mkdtemp(prefix='cairn-')}"
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/cairn/{name}-{uuid.uuid4().hex[:12]}"


def tasks_for(df: DataFrame) -> int:
    """Tasks over which the rows of df are dealt, ROWS_A_TASK each, as many as the cores at least.

    Partitions that Spark sizes itself grow with the table until they hold its advisory size of compressed bytes, which is
    many times that in sorts and hash tables. df is counted: give a stored table, whose files know their rows.
    """
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // ROWS_A_TASK))


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared scratch folder and read it back: the lineage ends there."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cairn_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table that materialize wrote, once nothing reads it any more."""
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._cairn_path)
    path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def ship(spark: SparkSession) -> None:
    """Make this package importable on the executors, once per application, and keep Arrow batches of long texts small.

    Results are lazy, so the size of batches must last as long as the session; a size that the session chose itself stays.
    """
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":  # Spark's default
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    sc = spark.sparkContext
    if getattr(sc, "_cairn_shipped", False):
        return
    bundle = os.path.join(tempfile.mkdtemp(prefix="cairn-ship-"), "cairn_bundle.zip")
    with zipfile.ZipFile(bundle, "w") as z:
        for p in sorted(PACKAGE_ROOT.rglob("*.py")):
            z.write(p, Path("cairn") / p.relative_to(PACKAGE_ROOT))
    sc.addPyFile(bundle)
    sc._cairn_shipped = True
