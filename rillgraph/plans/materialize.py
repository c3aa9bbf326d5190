"""Lineage cuts that survive the loss of executors.

Intermediate results that are read more than once are written as Parquet into the shared folder that
``spark.checkpoint.dir`` names, in a folder of the application that goes when the driver's JVM ends. Only where the session
names none and runs on one machine (tests, a laptop) a folder of this machine is used; on a cluster that is an error.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillgraph.plans.files import delete_at_end

_folders: dict[str, str] = {}


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables; set to a local one only where a session of one machine has none."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="rillgraph-")
        spark.sparkContext.setCheckpointDir(named)
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def application_folder(spark: SparkSession) -> str:
    """The application's own part of the shared folder."""
    key = f"{spark.sparkContext.applicationId} {checkpoint_root(spark)}"
    if key not in _folders:
        _folders[key] = f"{checkpoint_root(spark)}/rillgraph-{spark.sparkContext.applicationId}-{uuid.uuid4().hex[:8]}"
        delete_at_end(spark, _folders[key])
    return _folders[key]


def materialize(df: DataFrame, name: str = "step") -> DataFrame:
    """Write ``df`` once and return the written table."""
    spark = df.sparkSession
    path = f"{application_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, max_rows: int) -> tuple[DataFrame, bool]:
    """``df`` (already materialized) with a broadcast hint if it has at most ``max_rows`` rows.

    The count reads Parquet footers only. Beyond the bound the caller joins by shuffling.
    """
    small = df.limit(max_rows + 1).count() <= max_rows
    return (F.broadcast(df), True) if small else (df, False)
