"""Questions to the file system that holds a path, whatever kind it is."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):  # noqa: ANN202
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    """Whether something lies there. A storage error is raised, not taken for "nothing there"."""
    fs, p = _at(spark, path)
    return bool(fs.exists(p))


def children(spark: SparkSession, path: str) -> list[str]:
    """Names of what lies in the folder, in order; none where there is no folder."""
    fs, p = _at(spark, path)
    return sorted(x.getPath().getName() for x in fs.listStatus(p)) if fs.exists(p) else []


def delete_at_end(spark: SparkSession, path: str) -> None:
    """Delete the folder when the driver's JVM ends."""
    fs, p = _at(spark, path)
    fs.mkdirs(p)
    fs.deleteOnExit(p)
