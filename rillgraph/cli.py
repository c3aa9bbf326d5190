"""``python -m rillgraph.cli run|graphs|evaluate``: every option of :class:`rillgraph.config.Options` is a flag."""

from __future__ import annotations

import argparse
from dataclasses import fields

from pyspark.sql import SparkSession

from rillgraph.config import Options, options_from


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="rillgraph")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("run", "graphs", "evaluate"):
        c = sub.add_parser(name)
        c.add_argument("--posts", help="Parquet of posts, or an .npy corpus that is trusted")
        c.add_argument("--lexicon", help="Parquet of (subject_idx, term)")
        c.add_argument("--store", help="folder of the graph store, JSON lines")
        c.add_argument("--gold", help="Parquet of the gold standard")
        c.add_argument("--score-cache", help="folder of a cache of subject scores")
        c.add_argument("--all", action="store_true", help="every parameter set in the results folder (evaluate)")
        c.add_argument("--compat", default="labels", choices=("labels", "chars"), help="how comma lists of labels are read (evaluate)")
        c.add_argument("--limit", type=int, help="first posts in order of time (graphs)")
        c.add_argument("--show", type=int, help="print so many stored graphs and stop (graphs)")
        c.add_argument("--subject-filter", action="store_true", help="only posts with a subject (graphs)")
        c.add_argument("--offline", action="store_true", help="keyword, heuristic and hashing backends")
        for f in fields(Options):
            flag = "--" + f.name.replace("_", "-")
            if isinstance(f.default, bool):
                c.add_argument(flag, action=argparse.BooleanOptionalAction, default=None)
            else:
                c.add_argument(flag, type=float if isinstance(f.default, float) else int if isinstance(f.default, int) or f.name == "max_windows" else float if f.name == "kg_temperature" else str, default=None)
    return p


def main(argv: list[str] | None = None) -> int:
    args = vars(parser().parse_args(argv))
    if args["offline"]:
        args |= {"subject_backend": "keyword", "kg_backend": "heuristic", "embed_backend": "hashing"}
    options = options_from(args)
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    from rillgraph.operators import subjects, triples
    from rillgraph.plans import clients, pipeline
    from rillgraph.plans.files import exists
    from rillgraph.plans.ship import ship_package
    from rillgraph.sources import caches, corpus, kgstore, results

    ship_package(spark)
    folder = args["store"] or options.kg_dir
    if args["command"] == "graphs" and args["show"]:
        kgstore.shown(kgstore.readable(kgstore.scan_json(spark, folder)), args["show"]).show(truncate=False)
        return 0
    posts = corpus.read_posts(spark, args["posts"] or options.data_file)
    if args["command"] == "evaluate":
        gold = spark.read.parquet(args["gold"])
        found = results.evaluated_runs(spark, posts, gold, options.out_dir, args["compat"]) if args["all"] else results.evaluated(spark, posts, gold, options.out_dir, options.stamp(), args["compat"])
        if found is None:
            print(f"no complete runs in {options.out_dir}")
            return 1
        results.save_table(found, f"{options.out_dir.rstrip('/')}/evaluation")
        results.read_table(spark, f"{options.out_dir.rstrip('/')}/evaluation").show(truncate=False)
        return 0
    lexicon = spark.read.parquet(args["lexicon"]) if args["lexicon"] else None
    model = clients.classifier(options) if options.subject_backend == "model" else None
    classifier = subjects.build_classifier(options.subject_backend, lexicon, model)
    if args["score_cache"]:
        classifier = caches.CachedClassifier(classifier, args["score_cache"], f"{options.subject_backend}-{options.subject_model}-{options.subject_score_mode}")
    ask = clients.asker(options) if options.kg_backend == "client" else None
    extractor = lambda p: pipeline.extracted(p, options, ask)
    if args["command"] == "graphs":
        if args["limit"]:
            posts = posts.orderBy("dt", "pid").limit(args["limit"])
        if args["subject_filter"]:
            posts = subjects.labelled_posts(posts, subjects.assign_subjects(classifier.scores(posts), options.thresh_ps))
        triples.triple_stats(kgstore.ensure_graphs(posts, folder, extractor, options.kg_backend)).show()
        return 0
    store = None
    if args["store"] or exists(spark, folder):  # what the store lacks is extracted and kept there
        labelled = pipeline.prepared(posts, options)
        labelled = subjects.labelled_posts(labelled, pipeline.assigned_subjects(labelled, classifier, options))
        store = kgstore.ensure_graphs(labelled, folder, extractor, options.kg_backend)
    encode = clients.encoder(options) if options.embed_backend == "model" else None
    result = pipeline.run(posts, classifier, options, store, ask=ask, encode=encode)
    pipeline.save(result, options)
    if options.verbose:
        result.stats.show()
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
