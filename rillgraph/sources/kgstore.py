"""The store of graphs: an append-only log, one line per extraction; the last line of a post holds."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rillgraph.operators.triples import as_triples, clean_triples
from rillgraph.plans.files import exists

JSON_SCHEMA = "pid bigint, triples array<array<string>>, backend string, seq bigint, part bigint, _corrupt_record string"


def scan_json(spark: SparkSession, path: str) -> DataFrame:
    """The log as JSON lines, with the lines that cannot be read as rows of ``_corrupt_record``; blank lines are skipped."""
    return spark.read.schema(JSON_SCHEMA).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)


def readable(log: DataFrame) -> DataFrame:
    """The lines that could be read and name a post."""
    rows = log.where("_corrupt_record is null") if "_corrupt_record" in log.columns else log
    return rows.drop("_corrupt_record").where("pid is not null")


def latest(log: DataFrame, by_backend: bool = False) -> DataFrame:
    """The last record of each post (of each post and backend, if wanted), by ``seq`` and, where there is one, ``part``."""
    last = Window.partitionBy("pid", *["backend"] * by_backend).orderBy(*(F.desc(c) for c in ("seq", "part") if c in log.columns))
    return log.withColumn("__n", F.row_number().over(last)).where("__n = 1").drop("__n")


def graphs(log: DataFrame) -> DataFrame:
    """``(pid, triples)``: the cleaned triples of each post's last record."""
    return latest(log).select("pid", clean_triples(as_triples("triples")).alias("triples"))


def lookup(posts: DataFrame, store: DataFrame) -> DataFrame:
    """Every post's triples, an empty array where the store has none."""
    found = latest(store).select("pid", "triples")
    return posts.select("pid").join(found, "pid", "left").withColumn("triples", F.coalesce("triples", F.array().cast("array<array<string>>")))


def missing(posts: DataFrame, store: DataFrame) -> DataFrame:
    """The posts without a record."""
    return posts.join(store.select("pid"), "pid", "left_anti")


def put(extracted: DataFrame, path: str, backend: str) -> None:
    """Append ``(pid, triples)`` as JSON lines. ``seq`` is the time of writing, one value for all rows of a call; ``part``, unique
    among those, the order of rows. Rows whose ``status`` is not ``ok`` are no graphs: they stay missing and are asked again."""
    rows = extracted.where("status = 'ok'") if "status" in extracted.columns else extracted
    lists = F.transform("triples", lambda t: F.array(t["h"], t["r"], t["o"])).alias("triples")
    rows = rows.select("pid", lists, F.lit(backend).alias("backend"), F.lit(time.time_ns() // 1000).alias("seq"), F.monotonically_increasing_id().alias("part"))
    rows.write.mode("append").json(path)


def shown(log: DataFrame, n: int) -> DataFrame:
    """``(seq, pid, triples)``: the first ``n`` graphs of the log that have triples, in the order of appending."""
    rows = latest(log).select("seq", "pid", clean_triples(as_triples("triples")).alias("triples")).where("size(triples) > 0")
    return rows.orderBy("seq", "pid").limit(n)


def compact(log: DataFrame, path: str) -> None:
    """Write the last record of each post, without its backend, to a new folder."""
    latest(readable(log)).select("pid", "triples", *(c for c in ("seq", "part") if c in log.columns)).write.mode("overwrite").json(path)


def ensure_graphs(posts: DataFrame, path: str, extractor, backend: str) -> DataFrame:
    """Extract what the store at ``path`` lacks, append it, and return the store. Runs again where it stopped."""
    spark = posts.sparkSession
    have = readable(scan_json(spark, path)).select("pid") if exists(spark, path) else spark.createDataFrame([], "pid bigint")
    put(extractor(posts.join(have, "pid", "left_anti")), path, backend)
    return readable(scan_json(spark, path))
