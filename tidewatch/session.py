"""Session helper and the shared work folder."""

from __future__ import annotations

import hashlib
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(name: str = "tidewatch", cores: int | None = None) -> SparkSession:
    """A local session for tests and the benchmark; on a cluster, use the session it gives you."""
    n = cores or os.cpu_count() or 8
    return (
        SparkSession.builder.master(f"local[{n}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(n))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Where it is unset a temporary folder serves, but only in local mode: on a cluster other
    machines could not read it.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
        root = tempfile.mkdtemp(prefix="run-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", root)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    return root


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, for a table that cuts lineage or outlives a job."""
    return f"{checkpoint_root(spark).rstrip('/')}/tidewatch/{uuid.uuid4().hex}/{name}"


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists in whatever file system it names."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop_path)


def make_folder(spark: SparkSession, path: str) -> None:
    """Create a folder where there is none, in whatever file system the path names."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(hadoop_path)


def input_state(spark: SparkSession, folder: str) -> str:
    """A digest of the files below a folder: their paths, sizes and times."""
    root = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(root, True)
    found = []
    while files.hasNext():
        status = files.next()
        found.append(f"{status.getPath()} {status.getLen()} {status.getModificationTime()}")
    return hashlib.sha256("\n".join(sorted(found)).encode()).hexdigest()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors of a session whose workers cannot import it by themselves.

    Needed only where the package is not installed on the machines. Done once per session.
    """
    name = "tidewatch"
    sent = getattr(spark.sparkContext, "_tidewatch_sent", False)
    if sent:
        return
    folder = os.path.dirname(os.path.abspath(__file__))
    archive = shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="ship-"), name), "zip", os.path.dirname(folder), name)
    spark.sparkContext.addPyFile(archive)  # Spark serves the file to every executor
    spark.sparkContext._tidewatch_sent = True


def drop_table(spark: SparkSession, path: str) -> None:
    """Remove a stored table that no later step reads."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop_path, True)


def store(df: DataFrame, name: str) -> str:
    """Write a table to the shared folder and return its path."""
    path = work_path(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return path


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back, so later steps do not recompute it."""
    return df.sparkSession.read.schema(df.schema).parquet(store(df, name))
