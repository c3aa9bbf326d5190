"""Caches of scores and embeddings: tables keyed by what they depend on; only what is missing is computed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillgraph.plans.files import exists

EMBEDDING_FORMAT = "raw-v2"


def _read(spark: SparkSession, path: str) -> DataFrame | None:
    return spark.read.parquet(path) if exists(spark, path) else None


def cached_scores(posts: DataFrame, path: str, key: str, compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``(pid, subject_idx, score)`` of ``posts``; those without rows under ``key`` are computed and appended.

    A post without any score is remembered by a row without a subject.
    """
    spark = posts.sparkSession
    have = _read(spark, path)
    known = have.where(F.col("key") == key) if have is not None else None
    todo = posts.join(known.select("pid").distinct(), "pid", "left_anti") if known is not None else posts
    new = compute(todo)
    marks = todo.select("pid").join(new.select("pid").distinct(), "pid", "left_anti").select("pid", F.lit(None).cast("int").alias("subject_idx"), F.lit(None).cast("float").alias("score"))
    new.select("pid", "subject_idx", "score").unionByName(marks).withColumn("key", F.lit(key)).write.mode("append").partitionBy("key").parquet(path)
    return spark.read.parquet(path).where((F.col("key") == key) & F.col("subject_idx").isNotNull()).join(posts.select("pid").distinct(), "pid", "left_semi").select("pid", "subject_idx", "score")


class CachedClassifier:
    """A classifier that asks another one only for posts without scores in the cache."""

    def __init__(self, classifier, path: str, key: str) -> None:  # noqa: ANN001
        self.classifier, self.path, self.key = classifier, path, key

    def scores(self, posts: DataFrame) -> DataFrame:
        return cached_scores(posts, self.path, self.key, self.classifier.scores)


def cached_embeddings(phrases: DataFrame, path: str, model: str, embed: Callable) -> DataFrame:
    """``(phrase, vector)`` of the distinct phrases; each is embedded once per model and format."""
    spark = phrases.sparkSession
    want = phrases.select("phrase").where("phrase is not null").distinct()
    have = _read(spark, path)
    same = lambda d: d.where((F.col("model") == model) & (F.col("format") == EMBEDDING_FORMAT))
    todo = want.join(same(have).select("phrase"), "phrase", "left_anti") if have is not None else want
    rows = todo.select("phrase", embed(F.col("phrase")).alias("vector"), F.lit(model).alias("model"), F.lit(EMBEDDING_FORMAT).alias("format"))
    rows.write.mode("append").partitionBy("model", "format").parquet(path)
    return same(spark.read.parquet(path)).join(want, "phrase", "left_semi").select("phrase", "vector")
