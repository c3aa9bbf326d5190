"""Scans of posts."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillgraph.functions.text import epoch_seconds, text_of
from rillgraph.schemas import NESTED, POSTS

try:
    from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
except ImportError:  # older Spark
    DataSource = DataSourceReader = InputPartition = object


def scan_posts(spark: SparkSession, path: str) -> DataFrame:
    """Posts from Parquet, with ``text`` and ``ts`` derived where the file lacks them."""
    posts = spark.read.parquet(path)
    if "text" not in posts.columns:
        posts = posts.withColumn("text", text_of("tokens"))
    return posts if "ts" in posts.columns else posts.withColumn("ts", epoch_seconds("dt"))


def read_posts(spark: SparkSession, path: str) -> DataFrame:
    """Posts from Parquet or, by its name, from an ``.npy`` corpus; naming one means to trust it."""
    if not path.endswith(".npy"):
        return scan_posts(spark, path)
    register(spark)
    posts = spark.read.format("npy_corpus").option("path", path).option("trusted", "true").load()
    return posts.withColumns({"text": text_of("tokens"), "ts": epoch_seconds("dt")})


def from_nested(windows: DataFrame) -> DataFrame:
    """Posts from one row per window with parallel arrays (see :data:`rillgraph.schemas.NESTED`)."""
    zipped = F.arrays_zip(F.col("pids").alias("pid"), F.col("tokens"), F.col("types"), F.col("dts").alias("dt"), F.col("user_ids").alias("user_id"), F.col("deleted"))
    return windows.select(F.explode(zipped).alias("x"), "window_no").select("x.pid", "x.tokens", "x.types", "x.dt", "x.user_id", "window_no", "x.deleted")


class NumpyCorpus(DataSource):
    """``spark.read.format("npy_corpus").option("path", ...).option("trusted", "true")``: the seven-part object array. The
    file is one pickle, which cannot be read in parts: it is one task, which loads it once and yields a batch per window.
    Reading object arrays runs code of the file, so the option ``trusted`` must be set."""

    @classmethod
    def name(cls) -> str:
        return "npy_corpus"

    def schema(self) -> str:
        return POSTS

    def reader(self, schema):  # noqa: ANN001, ANN201
        if str(self.options.get("trusted", "false")).lower() != "true":
            raise ValueError("an .npy corpus can run code when it is read; set the option trusted to true")
        return _NumpyReader(self.options["path"])


class _NumpyReader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path = path

    def partitions(self) -> list:
        return [InputPartition(0)]

    def read(self, partition) -> Iterator[tuple]:  # noqa: ANN001
        import numpy as np

        for ids, tokens, types, deleted, dts, users, numbers in zip(*np.load(self.path, allow_pickle=True)):
            number = int(numbers) if not hasattr(numbers, "__len__") else int(numbers[0])
            for k, pid in enumerate(ids):
                yield int(pid), [str(t) for t in tokens[k]], [str(t) for t in types[k]], dts[k], int(users[k]), number, str(deleted[k])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(NumpyCorpus)


def from_nested_json(spark: SparkSession, path: str) -> DataFrame:
    """Posts from JSON lines, one window a line."""
    return from_nested(spark.read.schema(NESTED).json(path))
