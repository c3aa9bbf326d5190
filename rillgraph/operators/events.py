"""Events: the ordered fold per subject, its description, and the global list."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillgraph.config import Options
from rillgraph.functions.text import epoch_seconds, normalise_phrase
from rillgraph.functions.vectors import cosine, hashed_vector, l2_normalise
from rillgraph.operators.fold import GlobalEvents, SubjectFold, unit
from rillgraph.plans.materialize import materialize
from rillgraph.schemas import SUBJECT_EVENTS

Embed = Callable[[str], np.ndarray]
EVENT_COLUMNS = ["subject_idx", "window", "event_no", "nodes", "titles", "post_ids", "score", "vector", "keywords"]


def phrase_embedder(options: Options, embed: Embed | None = None) -> Embed:
    """A cached function from phrases to raw vectors: an injected one, or the hashing embedder."""
    if embed is None:
        if options.embed_backend != "hashing":
            raise ValueError(f"unknown embedding backend: {options.embed_backend!r}")
        embed = lambda p: hashed_vector(p, options.embed_dim_hashing)
    known: dict[str, np.ndarray] = {}

    def cached(phrase: str) -> np.ndarray:
        if phrase not in known:
            if len(known) > 200_000:
                known.clear()
            known[phrase] = np.asarray(embed(phrase), "float32")
        return known[phrase]

    return cached


def window_clock(posts: DataFrame) -> DataFrame:
    """``(window, ordinal, now)`` of the windows that exist; ``now`` is the last time over all posts, labelled or not."""
    clock = posts.groupBy("window").agg(F.max(epoch_seconds("dt")).alias("now"))
    return clock.withColumn("ordinal", F.row_number().over(Window.orderBy("window")).cast("long"))


def subject_events(placed: DataFrame, clock: DataFrame, options: Options, embed: Embed | None = None, vectors: DataFrame | None = None) -> DataFrame:
    """The events of every subject and window. ``placed`` has ``(subject_idx, window, pid, t, pos, h, r, o)``.

    The fold depends on the order of the stream, so a subject is one partition, sorted by (window, time, pid, place) and
    read as a stream of batches: memory holds the living entities and one batch, never the subject's history. Only ids,
    times and phrases travel there; and the phrases' vectors, where they come from a table ``(phrase, vector)``.
    """
    rows = placed.select("subject_idx", "window", "pid", "t", "pos", *(normalise_phrase(F.col(c)).alias(c) for c in "hro"))
    given = vectors is not None
    for c in "hro" if given else ():
        rows = rows.join(vectors.select(F.col("phrase").alias(c), F.col("vector").alias(f"v_{c}")), c, "left")
    ticks = list(clock.select("window", "ordinal", "now").toPandas().sort_values("window").itertuples(index=False, name=None))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, np.ndarray] = {}  # vectors of the table, of the stretch at hand and of living entities
        raw = phrase_embedder(options, embed) if not given else known.__getitem__
        vector = lambda p: unit(raw(p))
        subject, graph, tick = None, SubjectFold(options), 0

        def close(upto: float) -> list[dict]:
            """End the windows before ``upto``."""
            nonlocal tick
            out = []
            while subject is not None and tick < len(ticks) and ticks[tick][0] < upto:
                window, ordinal, now = ticks[tick]
                out += [{"subject_idx": subject, "window": window, "event_no": k} | e for k, e in enumerate(graph.end_window(ordinal, now, raw))]
                tick += 1
            return out

        for pdf in batches:
            out: list[dict] = []
            where = pdf[["subject_idx", "window"]].to_numpy()
            starts = np.flatnonzero(np.r_[True, (where[1:] != where[:-1]).any(1)]) if len(pdf) else []
            for lo, hi in zip(starts, [*starts[1:], len(pdf)]):  # stretches of one subject and window
                part, (own, window) = pdf.iloc[lo:hi], where[lo].tolist()
                if own != subject:
                    out += close(float("inf"))
                    subject, graph, tick = own, SubjectFold(options), 0
                out += close(window)
                if given:
                    living = {*graph.nodes.forms, *graph.edges.forms}
                    for p in [p for p in known if p not in living]:
                        del known[p]
                    for c in "hro":
                        known |= {p: np.asarray(v, "float32") for p, v in zip(part[c], part[f"v_{c}"]) if p}
                graph.take(part["h"].tolist(), part["r"].tolist(), part["o"].tolist(), part["t"].to_numpy(), part["pid"].to_numpy(), vector)
            yield pd.DataFrame(out, columns=EVENT_COLUMNS)
        yield pd.DataFrame(close(float("inf")), columns=EVENT_COLUMNS)

    ordered = rows.repartition("subject_idx").sortWithinPartitions("subject_idx", "window", "t", "pid", "pos")
    return ordered.mapInPandas(run, SUBJECT_EVENTS)


def register(events: DataFrame, threshold: float = 2.0) -> tuple[DataFrame, DataFrame]:
    """The global events, and ``(subject_idx, window, event_no, number)``.

    Which global event takes a subject event in depends on all before it, by (window, subject, event): one ordered stream over
    the events' keys and vectors only, whose state is the centres of the global events. It is run once and written; titles,
    posts, subjects and windows are gathered from its result in parallel.
    """
    order = ["window", "subject_idx", "event_no"]

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = GlobalEvents(threshold)
        for pdf in batches:
            if len(pdf):
                numbers = known.join(np.stack(pdf["vector"].to_list()))
                yield pdf[order].assign(number=numbers, n=None, centre=None)
        rows = [{"number": k + 1, "n": int(n), "centre": c} for k, (n, c) in enumerate(zip(known.sizes, known.centres))]
        yield pd.DataFrame(rows, columns=[*order, "number", "n", "centre"])

    every = events.where("vector is not null")
    keys = every.select(*order, "vector").repartition(1).sortWithinPartitions(*order)
    joined = materialize(keys.mapInPandas(fold, "window bigint, subject_idx int, event_no int, number int, n int, centre array<float>"), "registered")
    bridge = joined.where("n is null").select("subject_idx", "window", "event_no", "number")
    none = F.array().cast("array<string>")
    held = every.join(bridge, order).select("number", *order, F.coalesce("titles", none).alias("titles"), F.coalesce("post_ids", F.array().cast("array<bigint>")).alias("post_ids"))
    parts = held.groupBy("number").agg(
        F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(*order, "titles"))), lambda x: x["titles"]))).alias("titles"),
        F.array_sort(F.collect_set("subject_idx")).alias("subjects"), F.array_sort(F.collect_set("window")).alias("windows"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("post_ids")))).alias("post_ids"),
    )
    centres = joined.where("n is not null").select("number", "n", F.col("centre").alias("vector"))
    finals = parts.join(centres, "number").select(F.col("number").alias("event_number"), "titles", "subjects", "windows", "post_ids", "vector", "n")
    return finals, bridge


# -- describing clusters with tables: the exact-phrase mode --------------------------------------------------------


def top_titles(candidates: DataFrame, by: list[str], k: int = 3) -> DataFrame:
    """``(*by, title, rank)``: of ``(*by, similarity, seq, title)`` the ``k`` most similar rows, then each title once."""
    best = candidates.withColumn("__n", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("similarity"), "seq"))).where(F.col("__n") <= k)
    return best.groupBy(*by, "title").agg(F.min("__n").cast("long").alias("rank"))


def relation_similarity(n1: Column, e: Column, n2: Column, centre: Column) -> Column:
    """Cosine of the sum of the three vectors to the centroid."""
    both = F.zip_with(F.zip_with(n1, e, lambda x, y: x + y), n2, lambda x, y: x + y)
    return cosine(both, centre)


def top_keywords(nodes: DataFrame, by: list[str], k: int = 3) -> DataFrame:
    """``(*by, keyword, rank)``: titles of the ``max(1, k)`` nodes most mentioned, ties to the larger node, each title once."""
    best = nodes.withColumn("__n", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("n"), F.desc("node")))).where(F.col("__n") <= max(1, k))
    return best.groupBy(*by, F.col("title").alias("keyword")).agg(F.min("__n").cast("long").alias("rank"))


def large_clusters(members: DataFrame, by: list[str], least: int = 2) -> DataFrame:
    """The members of clusters of ``least`` nodes or more."""
    sizes = members.groupBy(*by).agg(F.count("*").alias("__size")).where(F.col("__size") >= least)
    return members.join(sizes.drop("__size"), by, "left_semi")


def event_scores(members: DataFrame, by: list[str]) -> DataFrame:
    """``(*by, score)``: the mean of the finite scores, 0 where there is none."""
    finite = F.when(~F.isnan("score") & (F.abs("score") < float("inf")), F.col("score"))
    return members.groupBy(*by).agg(F.coalesce(F.avg(finite), F.lit(0.0)).alias("score"))


def ranked_events(scored: DataFrame, by: list[str], order: str) -> DataFrame:
    """``event_no`` from 0: the highest score first, ties by ``order``."""
    return scored.withColumn("event_no", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), order)) - 1)


def centroid(vector: Column) -> Column:
    return l2_normalise(vector)


def all_strings(titles: str, keywords: str) -> Column:
    """Titles and keywords, each once, in order."""
    return F.array_distinct(F.concat(F.coalesce(titles, F.array().cast("array<string>")), F.coalesce(keywords, F.array().cast("array<string>"))))
