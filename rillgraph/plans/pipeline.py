"""The whole run as one plan: windows, subjects, triples, events, global events, results."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillgraph.config import Options
from rillgraph.functions.text import epoch_seconds, normalise_phrase
from rillgraph.functions.vectors import build_embedder
from rillgraph.operators import events, graph, subjects, triples, windows
from rillgraph.plans.materialize import materialize
from rillgraph.sources import kgstore, results
from rillgraph.sources.caches import cached_embeddings


@dataclass
class Run:
    """The tables of a run."""

    posts: DataFrame
    assigned: DataFrame
    events: DataFrame
    finals: DataFrame
    topics: DataFrame
    assignments: DataFrame
    report: DataFrame
    stats: DataFrame


def prepared(posts: DataFrame, options: Options) -> DataFrame:
    """Distinct posts with their window, cut to the first windows if wanted."""
    rows = windows.distinct_posts(windows.with_windows(posts, options.window_hours))
    return windows.first_windows(rows, options.max_windows) if options.max_windows else rows


def assigned_subjects(posts: DataFrame, classifier: subjects.SubjectClassifier, options: Options) -> DataFrame:
    scores = classifier.scores(posts)
    if not options.calibrate_thresh_ps:
        return subjects.assign_subjects(scores, options.thresh_ps)
    threshold = F.broadcast(subjects.calibrated_threshold(posts, scores))
    return scores.join(threshold).where(F.col("score") >= F.col("threshold").cast("float")).select("pid", "subject_idx")


def extracted(posts: DataFrame, options: Options, ask: Callable | None = None) -> DataFrame:
    """``(pid, triples, status)`` of posts by the options' backend."""
    more = {"retries": options.kg_max_retries, "workers": options.kg_workers} if options.kg_backend == "client" else {}
    return triples.extract(posts, options.kg_backend, ask, most=options.kg_max_triples_per_post, **more)


def run(posts: DataFrame, classifier: subjects.SubjectClassifier, options: Options | None = None, store: DataFrame | None = None, embed: Callable | None = None, ask: Callable | None = None, encode: Callable | None = None) -> Run:
    """All stages. ``store`` holds graphs that are already there; posts without one are extracted.

    ``encode``, from lists of phrases to vectors, serves the backend ``model``: every phrase is embedded once, and kept in the
    cache that the options name. ``embed``, from one phrase to its vector, takes the place of the backend.
    """
    o = options or Options()
    posts = materialize(prepared(posts, o).select("pid", "tokens", "dt", "window"), "posts")
    assigned = materialize(assigned_subjects(posts, classifier, o), "assigned")
    kept = subjects.labelled_posts(posts, assigned)
    todo = kgstore.missing(kept, store) if store is not None else kept
    graphs = extracted(todo, o, ask).where("status = 'ok'").select("pid", "triples")
    if store is not None:
        graphs = graphs.unionByName(kgstore.graphs(store))
    placed = graph.placed_triples(kept, assigned, graphs).join(posts.select("pid", "window"), "pid")
    clock = materialize(events.window_clock(posts), "clock")
    vectors = None
    if embed is None and o.embed_backend == "model":
        placed = materialize(placed, "placed")
        phrases = placed.select(F.explode(F.array(*(normalise_phrase(F.col(c)) for c in "hro"))).alias("phrase")).where("phrase <> ''")
        vectors = cached_embeddings(phrases, o.embed_cache, o.embed_model, build_embedder("model", encode=encode, batch=o.embed_batch_size))
    found = materialize(events.subject_events(placed, clock, o, embed, vectors), "events")
    finals, bridge = events.register(found, o.thresh_ts)
    finals = materialize(finals, "finals")
    numbered = found.join(bridge, ["subject_idx", "window", "event_no"])
    named = numbered.withColumn("titles", events.all_strings("titles", "keywords"))
    stats = posts.agg(F.count("*").alias("n_posts"), F.count_distinct("window").alias("n_windows")).join(F.broadcast(finals.agg(F.count("*").alias("n_events")))).join(F.broadcast(graph.relations(placed).agg(F.count("*").alias("n_relations"))))
    return Run(posts, assigned, found, finals, results.topics(named), results.assignments(posts, numbered), results.report(finals), stats)


def bursty_entities(posts: DataFrame, assigned: DataFrame, graphs: DataFrame, options: Options | None = None) -> DataFrame:
    """``(subject_idx, kind, phrase, n, t1, score)`` of the entities that are bursty at the end of the stream: all native."""
    from rillgraph.operators import burst

    o = options or Options()
    found = graph.mentions(graph.placed_triples(posts, assigned, graphs))
    now = posts.agg(F.max(epoch_seconds("dt")).alias("now")).first()["now"] or 0.0
    scores = burst.burst_scores(found, graph.ENTITY, now, o.ts_seconds, o.weight_min, o.weight_max, at_least=burst.least_mentions(o.t_d, o.weight_min, o.weight_max))
    return burst.survivors(scores, o.t_d)


def save(result: Run, options: Options) -> None:
    """Topics, assignments by window, and the event report, under paths with the stamp of the options."""
    from rillgraph.config import stamped_path

    path = lambda base: stamped_path(options.out_dir, base, options.stamp())
    results.save_table(result.topics, path("topics"))
    results.save_table(result.assignments, path("assignments"), "window")
    results.save_table(result.report, path("events"))
