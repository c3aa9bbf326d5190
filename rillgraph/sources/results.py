"""Result tables and files: topics, assignments, the event report, the evaluation report."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillgraph.config import SUBJECTS, parse_stamp, stamped_path
from rillgraph.functions.text import joined_nonempty
from rillgraph.operators.evaluate import evaluate, first_number, titles_in_text
from rillgraph.plans.files import children


def topics(events: DataFrame) -> DataFrame:
    """``(window, topic)``: one row per event, its titles joined by `` | ``."""
    return events.select("window", joined_nonempty("titles", " | ").alias("topic"))


def assignments(posts: DataFrame, numbered: DataFrame) -> DataFrame:
    """``(window, pid, event_number)`` of every post: the events of its window that hold it, joined by commas, else ``0``.

    ``numbered`` has ``(window, post_ids, number)``. The join is by post; posts of other windows find nothing.
    """
    held = numbered.select("window", F.explode("post_ids").alias("pid"), "number").distinct()
    lists = held.groupBy("window", "pid").agg(F.array_join(F.transform(F.sort_array(F.collect_set("number")), lambda n: n.cast("string")), ",").alias("event_number"))
    return posts.select("window", "pid").join(lists, ["window", "pid"], "left").withColumn("event_number", F.coalesce("event_number", F.lit("0")))


def report(finals: DataFrame) -> DataFrame:
    """``(event, subjects, windows, posts, titles)`` of each global event; the first ten titles."""
    names = F.array(*(F.lit(s) for s in SUBJECTS))
    text = lambda c: F.array_join(F.transform(F.array_sort(c), lambda x: x.cast("string")), ",")
    return finals.select(F.col("event_number").alias("event"), F.array_join(F.array_sort(F.transform("subjects", lambda i: F.element_at(names, i + 1))), ",").alias("subjects"), text("windows").alias("windows"), F.size("post_ids").cast("long").alias("posts"), F.array_join(F.slice("titles", 1, 10), " | ").alias("titles"))


def save_table(df: DataFrame, path: str, partition: str | None = None) -> None:
    """Tab-separated text with a header; one folder per value of ``partition``."""
    writer = df.write.mode("overwrite").option("sep", "\t").option("header", True)
    (writer.partitionBy(partition) if partition else writer).csv(path)


def read_table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.option("sep", "\t").option("header", True)
    return (reader.schema(schema) if schema else reader).csv(path)


def scan_topics(spark: SparkSession, path: str) -> DataFrame:
    """``(window, title)``, each title once per window."""
    rows = read_table(spark, path, "window bigint, topic string")
    return rows.select("window", F.explode(F.split("topic", r"\|")).alias("title")).select("window", F.trim("title").alias("title")).where("title <> ''").distinct()


def scan_assignments(spark: SparkSession, path: str) -> DataFrame:
    """``(window, pid, event_number)`` of all window folders, the first event number of each post."""
    rows = read_table(spark, path, "pid bigint, event_number string, window bigint")
    return rows.select("window", "pid", first_number("event_number").alias("event_number"))


def paired_runs(topic_files: DataFrame, assignment_files: DataFrame) -> DataFrame:
    """The parameter stamps for which both results exist, from two lists ``(stamp, path)``."""
    return topic_files.select("stamp", F.col("path").alias("topics")).join(assignment_files.select("stamp", F.col("path").alias("assignments")), "stamp")


def stamped(spark: SparkSession, out_dir: str, base: str) -> DataFrame:
    """``(stamp, path)`` of the results of one kind that lie in a folder."""
    head = f"{base}_"
    rows = [(n[len(head) :], f"{out_dir.rstrip('/')}/{n}") for n in children(spark, out_dir) if n.startswith(head)]
    return spark.createDataFrame(rows, "stamp string, path string")


def runs(spark: SparkSession, out_dir: str) -> DataFrame:
    """``(stamp, topics, assignments)`` of the parameter sets with both results in a folder."""
    return paired_runs(stamped(spark, out_dir, "topics"), stamped(spark, out_dir, "assignments"))


def evaluation_report(figures: DataFrame, stamp: str) -> DataFrame:
    """The figures of one run with the parameters of its stamp as columns in front."""
    return figures.select(*(F.lit(v).alias(k) for k, v in parse_stamp(stamp).items()), "*")


def evaluated(spark: SparkSession, posts: DataFrame, gold: DataFrame, out_dir: str, stamp: str, compat: str = "labels") -> DataFrame:
    """The figures of one stored run, with the parameters of its stamp in front. ``posts`` has ``(pid, text)``."""
    assigned = scan_assignments(spark, stamped_path(out_dir, "assignments", stamp))
    texts = posts.select("pid", "text").join(assigned.select("pid", "window"), "pid")
    rows = standardised(assigned, titles_in_text(texts, scan_topics(spark, stamped_path(out_dir, "topics", stamp))))
    system = rows.select("sequence_id", "event_number", F.filter(F.split("title", r"\|"), lambda t: t != "").alias("titles"))
    return evaluation_report(evaluate(gold, system, compat), stamp)


def evaluated_runs(spark: SparkSession, posts: DataFrame, gold: DataFrame, out_dir: str, compat: str = "labels") -> DataFrame | None:
    """The figures of every run in a folder that has both results, one row each; None where there is none."""
    found = [evaluated(spark, posts, gold, out_dir, r.stamp, compat) for r in runs(spark, out_dir).orderBy("stamp").collect()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), found) if found else None


def standardised(assigned: DataFrame, titles: DataFrame) -> DataFrame:
    """``(sequence_id, event_number, window, title)``: assignments with the titles found in the text."""
    rows = assigned.join(titles, "pid", "left")
    return rows.select(F.col("pid").alias("sequence_id"), "event_number", "window", F.coalesce("titles", F.lit("")).alias("title"))
