"""Burst scores of entities from the times of their mentions.

Time since the first mention is cut into ``m`` intervals; later intervals weigh more (a linear ramp from ``wmin`` to
``wmax``). The score is the weighted number of mentions over the same sum with the order of intervals reversed. With
``x`` the sum of intervals' places divided by ``m - 1`` it has the closed form

    (n * wmin + (wmax - wmin) * x) / (n * wmax - (wmax - wmin) * x),      1 where m = 1,

so one partial aggregate per entity is enough and no list of times is ever built.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def interval_count(first: Column, now: Column, seconds: float) -> Column:
    return F.greatest(F.lit(1), F.ceil((now - first) / seconds)).cast("long")


def interval_of(t: Column, first: Column, now: Column, seconds: float) -> Column:
    """The interval of a mention, from 0; one at ``now`` belongs to the last."""
    return F.greatest(F.lit(0), F.least(F.floor((t - first) / seconds), interval_count(first, now, seconds) - 1)).cast("long")


def ramp(k: Column, m: Column, wmin: float = 0.1, wmax: float = 1.0) -> Column:
    """Weight of interval ``k`` of ``m``."""
    return F.when(m <= 1, F.lit(wmax)).otherwise(F.lit(wmin) + (wmax - wmin) * k / (m - 1))


def with_first(mentions: DataFrame, by: list[str]) -> DataFrame:
    """``(*by, t, t1, __c)``: mentions of one time counted together, with their entity's first time."""
    mentions = mentions.groupBy(*by, "t").agg(F.count("*").alias("__c"))
    return mentions.join(mentions.groupBy(*by).agg(F.min("t").alias("t1")), by)


def nap_histogram(mentions: DataFrame, by: list[str], now: float | Column, seconds: float = 60) -> DataFrame:
    """``(*by, interval, n)``: mentions of each interval that has any."""
    now = F.lit(now) if not isinstance(now, Column) else now
    rows = with_first(mentions.where("t is not null"), by)
    return rows.groupBy(*by, interval_of(F.col("t"), F.col("t1"), now, seconds).alias("interval")).agg(F.sum("__c").alias("n"))


def dense_histogram(mentions: DataFrame, by: list[str], now: float, seconds: float = 60) -> DataFrame:
    """``(*by, naps ARRAY<BIGINT>)``: the histogram with its zeros, for short histories."""
    sparse = nap_histogram(mentions, by, now, seconds)
    size = mentions.groupBy(*by).agg(interval_count(F.min("t"), F.lit(now), seconds).alias("m"))
    maps = sparse.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("interval", "n"))).alias("of"))
    dense = F.transform(F.sequence(F.lit(0).cast("long"), F.col("m") - 1), lambda k: F.coalesce(F.element_at("of", k), F.lit(0).cast("long")))
    return size.join(maps, by).select(*by, dense.alias("naps"))


def closed_form(n: Column, places: Column, m: Column, wmin: float = 0.1, wmax: float = 1.0) -> Column:
    """The score from the number of mentions and the sum of their intervals' places."""
    x = F.lit(wmax - wmin) * places / (m - 1)
    return F.when(m <= 1, 1.0).otherwise((n * wmin + x) / (n * wmax - x))


def least_mentions(t_d: float, wmin: float = 0.1, wmax: float = 1.0) -> int:
    """Mentions below which no entity reaches ``t_d``; only sound strictly between 1 and ``wmax / wmin``."""
    if not 1 < t_d < wmax / wmin:
        return 1
    share = (t_d * wmax - wmin) / ((wmax - wmin) * (1 + t_d))
    return max(1, math.ceil(1 / (1 - share) - 1e-9))


def burst_scores(mentions: DataFrame, by: list[str], now: float | Column, seconds: float = 60, wmin: float = 0.1, wmax: float = 1.0, mode: str = "reverse", node_life: float | None = None, at_least: int = 1) -> DataFrame:
    """``(*by, n, t1, score)``. ``mode`` is ``reverse`` or ``reciprocal`` (the reversed sum takes the inverse of each
    interval's frequency, for which the entity's life counts). Entities of fewer than ``at_least`` mentions are left out
    before they are scored; mentions without a time do not count."""
    now = F.lit(float(now)) if not isinstance(now, Column) else now
    rows = mentions.where("t is not null")
    if mode == "reverse":
        # with t = q * seconds + r an interval is q - q1, less one where r < r1: mentions are counted per remainder first, so
        # an entity of a third of all mentions shuffles a few rows a task and none of its mentions
        q = F.floor(F.col("t") / seconds).cast("long")
        parts = rows.select(*by, "t", q.alias("__q"), (F.col("t") - q * seconds).alias("__r"), (F.col("t") == now).cast("long").alias("__last"))
        parts = parts.groupBy(*by, "__r").agg(F.count("*").alias("n"), F.sum("__q").alias("__q"), F.min("t").alias("t1"), F.sum("__last").alias("__last"))
        per = Window.partitionBy(*by)
        parts = parts.withColumn("t1", F.min("t1").over(per)).withColumn("__q1", F.floor(F.col("t1") / seconds).cast("long"))
        behind = F.sum(F.when(F.col("__r") < F.col("t1") - F.col("__q1") * seconds, F.col("n")).otherwise(0))
        sums = parts.groupBy(*by, "t1", "__q1").agg(F.sum("n").alias("n"), F.sum("__q").alias("__q"), behind.alias("__behind"), F.sum("__last").alias("__last")).where(F.col("n") >= at_least)
        clipped = F.when((now > F.col("t1")) & ((now - F.col("t1")) % seconds == 0), F.col("__last")).otherwise(0)
        places = F.col("__q") - F.col("n") * F.col("__q1") - F.col("__behind") - clipped
        return sums.select(*by, "n", "t1", closed_form(F.col("n"), places, interval_count(F.col("t1"), now, seconds), wmin, wmax).alias("score"))
    if mode != "reciprocal":
        raise ValueError(f"unknown mode: {mode!r}")
    bins = with_first(rows, by).groupBy(*by, "t1", interval_of(F.col("t"), F.col("t1"), now, seconds).alias("__k")).agg(F.sum("__c").alias("__nap"))
    w = ramp(F.col("__k"), interval_count(F.col("t1"), now, seconds), wmin, wmax)
    life = F.lit(float(node_life)) if node_life is not None else F.greatest(F.lit(1.0), now - F.col("t1"))
    sums = bins.groupBy(*by, "t1").agg(F.sum("__nap").alias("n"), F.sum(F.col("__nap") / life * w).alias("s"), F.sum(life / F.col("__nap") * w).alias("r")).where(F.col("n") >= at_least)
    return sums.select(*by, "n", "t1", F.when(F.col("r") > 0, F.col("s") / F.col("r")).otherwise(F.when(F.col("s") > 0, F.lit(float("inf"))).otherwise(0.0)).alias("score"))


def survivors(scores: DataFrame, t_d: float = 1.2) -> DataFrame:
    """The entities that are not forgotten."""
    return scores.where(F.col("score") >= t_d)


def interpret(score: Column) -> Column:
    return F.when(score < 1, "not bursty").when(score == 1, "verge").otherwise("bursty")
