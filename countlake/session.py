"""Session-level helpers: the shared workspace, size-checked broadcasts and table cuts."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a side may be broadcast; the row count is always measured first.
BROADCAST_ROWS = 200_000
#: Spark's setting that a query's shuffle files are deleted when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors can reach: ``spark.checkpoint.dir``, else (tests only) a local one.

    A session on one machine without the setting gets a folder under the system's temporary directory; on a
    cluster the setting has to name a shared file system, and its absence is an error.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="countlake-")
        spark.conf.set("spark.checkpoint.dir", at)
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(at)
    return at.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def cut(df: DataFrame, label: str, release: bool = False) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: lineage ends here.

    The table survives the loss of executors, and later steps read only the columns they need. With ``release`` the shuffle
    files of the write are deleted with its end, not only when the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    path, before = fresh_path(spark, label), spark.conf.get(CLEANUP, "false")
    try:
        if release:
            spark.conf.set(CLEANUP, "true")
        df.write.parquet(path)
    finally:
        if release:
            spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def from_driver(spark: SparkSession, data: pa.Table) -> DataFrame:
    """A table of the driver by way of a file in the shared folder, so that no row of it stays in the driver's JVM."""
    path = fresh_path(spark, "driver").removeprefix("file://") + ".parquet"
    os.makedirs(os.path.dirname(path), exist_ok=True)
    pq.write_table(data, path, row_group_size=1 << 17)
    return spark.read.parquet(f"file://{path}")


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path of the shared folder."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(conf).delete(p, True)


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it is measured to have at most ``limit`` rows.

    Beyond the limit it is returned as it is, and the join becomes a shuffled one, whose skewed
    partitions adaptive execution splits.
    """
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stream_path(spark: SparkSession, path: str) -> str:
    """A stream's source is a folder or a pattern: a table that is one file is named by a pattern."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    single = p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isFile()
    return f"{path[:-1]}[{path[-1]}]" if single else path


def spread(df: DataFrame) -> DataFrame:
    """df over as many partitions as there are cores, if a scan of few or small files gives fewer.

    For work that costs far more than moving its rows once; a table of many parts is left as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application, unless their PYTHONPATH has it."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    app = spark.sparkContext.applicationId
    if app in _shipped or root in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    archive = shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="countlake-"), "countlake"), "zip", root, "countlake")
    spark.sparkContext.addPyFile(archive)  # Spark serves it to all executors
    _shipped.add(app)
