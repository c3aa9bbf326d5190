"""Posts and their tumbling windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rillgraph.functions.text import epoch_seconds


def distinct_posts(posts: DataFrame) -> DataFrame:
    """One row per ``pid``: a second delivery is dropped (the earliest ``dt``, then window, stays)."""
    first = Window.partitionBy("pid").orderBy(F.col("dt").asc_nulls_last(), F.col("window_no").asc_nulls_last())
    return posts.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")


def with_windows(posts: DataFrame, hours: float = 12) -> DataFrame:
    """``window``, from 1, counted from midnight before the earliest post; ``hours=0`` keeps each row's own ``window_no``."""
    if not hours:
        return posts.withColumn("window", F.col("window_no").cast("long"))
    origin = F.broadcast(posts.agg(F.date_trunc("day", F.min("dt")).alias("__origin")))
    seconds = epoch_seconds("dt") - epoch_seconds("__origin")
    return posts.join(origin).withColumn("window", (F.floor(seconds / (hours * 3600)) + 1).cast("long")).drop("__origin")


def first_windows(posts: DataFrame, n: int) -> DataFrame:
    """The posts of the first ``n`` windows that exist."""
    some = posts.select("window").distinct().orderBy("window").limit(n)
    return posts.join(F.broadcast(some), "window", "left_semi")


def window_stats(posts: DataFrame) -> DataFrame:
    """First and last second and number of posts of each window."""
    return posts.groupBy("window").agg(F.min(epoch_seconds("dt")).alias("first_s"), F.max(epoch_seconds("dt")).alias("last_s"), F.count("*").alias("n_posts"))


def window_ordinals(posts: DataFrame) -> DataFrame:
    """``(window, ordinal)``: the rank of each window among those that exist, from 1."""
    return posts.select("window").distinct().withColumn("ordinal", F.row_number().over(Window.orderBy("window")).cast("long"))


def stream_stats(posts: DataFrame) -> DataFrame:
    """Posts, windows, first and last second, posts a window."""
    per = window_stats(posts)
    return per.agg(F.coalesce(F.sum("n_posts"), F.lit(0)).alias("n_posts"), F.count("*").alias("n_windows"), F.min("first_s").alias("first_s"), F.max("last_s").alias("last_s"), F.avg("n_posts").alias("posts_a_window"))
