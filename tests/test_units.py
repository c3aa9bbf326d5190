"""Operators on small literals."""

import math
import tracemalloc
import re
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from rillgraph.config import Options, options_from, parse_stamp, stamped_path
from rillgraph.functions import text, vectors
from rillgraph.operators import burst, cluster, evaluate, events, fold, graph, subjects, triples, windows
from rillgraph.plans import pipeline
from rillgraph.plans.materialize import broadcast_if_small, materialize
from rillgraph.sources import caches, corpus, kgstore, results


def one(df):
    return df.first()[0]


def column(spark, value, f, kind="string"):
    return one(spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x"))))


# -- text and vectors


@pytest.mark.parametrize(("given", "want"), [("كتاب  عربي", "کتاب عربی"), ("می‌شود", "می شود"), (" a b ", "a b"), (None, ""), ("", "")])
def test_normalise_phrase(spark, given, want):
    assert column(spark, given, text.normalise_phrase) == want


def test_strip_punctuation(spark):
    assert column(spark, "سلام، كي؟ a_b!", text.strip_punctuation) == "سلام کی a_b"


@pytest.mark.parametrize(("label", "want"), [("Cultural_Art", "cultural_art"), ("SPORT ", "sport"), ("سياسي", "political"), ("science-technology", "science_tech"), ("بین‌الملل", "international"), ("بینالملل", "international"), ("x", None), (None, None)])
def test_canonical_subject(spark, label, want):
    assert column(spark, label, subjects.canonical_subject) == want


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0]), ([0.0, 0.0], [1.0, 0.0])], "a array<float>, b array<float>")
    got = df.select(vectors.l2_normalise(F.col("a")).alias("u"), vectors.cosine(F.col("a"), F.col("b")).alias("c"), vectors.euclidean(F.col("a"), F.col("b")).alias("e")).collect()
    assert np.allclose(got[0].u, [0.6, 0.8]) and math.isclose(got[0].c, 0.96) and math.isclose(got[0].e, math.sqrt(2))
    assert got[1].u == [0.0, 0.0] and got[1].c == 0.0 and got[1].e == 1.0


def test_mean_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 3.0]), (1, [3.0, 5.0]), (2, [0.0, 1.0])], "k int, vector array<float>")
    assert {r.k: list(r.vector) for r in vectors.mean_vectors(df, ["k"]).collect()} == {1: [2.0, 4.0], 2: [0.0, 1.0]}


def test_hashing_embedder(spark):
    df = spark.createDataFrame([("abc",), ("abc",), ("",), (None,)], "p string")
    got = [np.array(r.v) for r in df.select(vectors.hashing_embedder(64)(F.col("p")).alias("v")).collect()]
    assert (got[0] == got[1]).all() and (got[0] == vectors.hashed_vector("abc", 64)).all() and np.abs(got[0]).sum() > 0
    assert not got[2].any() and not got[3].any()
    assert math.isclose(float(np.linalg.norm(fold.unit(got[0]))), 1.0, rel_tol=1e-6)


def test_masked_mean_and_injected_embedder(spark):
    df = spark.createDataFrame([([[1.0, 2.0], [3.0, 4.0], [9.0, 9.0]], [1, 1, 0]), ([[1.0, 2.0]], [0])], "h array<array<float>>, m array<int>")
    assert [list(r[0]) for r in df.select(vectors.masked_mean(F.col("h"), F.col("m"))).collect()] == [[2.0, 3.0], [0.0, 0.0]]
    words = spark.createDataFrame([("ab",), ("abc",), (None,)], "p string")
    embed = vectors.build_embedder("model", encode=lambda texts: np.array([[len(t), 1.0] for t in texts]))
    assert [list(r[0]) for r in words.select(embed(F.col("p"))).collect()] == [[2.0, 1.0], [3.0, 1.0], [0.0, 1.0]]
    with pytest.raises(ValueError):
        vectors.build_embedder("other")


# -- options


def test_options():
    assert Options().stamp() == "win-12_tn-0.15_te-0.2_td-1.2_ts-2.0_ps-0.5_clu-louvain"
    assert parse_stamp("td-1e-05_clu-louvain") == {"td": "1e-05", "clu": "louvain"}
    assert stamped_path("o/", "events", "td-1", ".tsv") == "o/events_td-1.tsv"
    assert options_from({"t_d": 3.0, "nothing": 1, "seed": None}).t_d == 3.0


# -- windows


def posts_of(spark, rows):
    return spark.createDataFrame(rows, "pid bigint, dt timestamp_ntz, window_no int")


def test_windows(spark):
    t = datetime(2017, 1, 1, 3)
    posts = posts_of(spark, [(1, t, 1), (2, t + timedelta(hours=9), 2), (3, t + timedelta(hours=40), 9), (1, t, 1)])
    found = windows.with_windows(windows.distinct_posts(posts))
    assert {r.pid: r.window for r in found.collect()} == {1: 1, 2: 2, 3: 4}
    assert {r.window for r in windows.first_windows(found, 2).collect()} == {1, 2}
    assert {r.window: r.ordinal for r in windows.window_ordinals(found).collect()} == {1: 1, 2: 2, 4: 3}
    assert windows.stream_stats(found).first().asDict() | {"first_s": 0, "last_s": 0} == {"n_posts": 3, "n_windows": 3, "first_s": 0, "last_s": 0, "posts_a_window": 1.0}
    assert {r.pid: r.window for r in windows.with_windows(posts, 0).collect()}[3] == 9
    assert windows.stream_stats(windows.with_windows(posts.limit(0))).first().n_posts == 0


# -- burst scores


def scores(spark, times, now, seconds=60, **options):
    df = spark.createDataFrame([("e", float(t)) for t in times], "k string, t double")
    return burst.burst_scores(df, ["k"], float(now), seconds, **options).first().score


def test_naps(spark):
    df = spark.createDataFrame([("a", 0.0), ("a", 30.0), ("a", 150.0)], "k string, t double")
    assert list(burst.dense_histogram(df, ["k"], 180.0).first().naps) == [2, 0, 1]
    df = spark.createDataFrame([("a", 0.0), ("a", 10.0)], "k string, t double")
    assert list(burst.dense_histogram(df, ["k"], 600.0).first().naps) == [2] + [0] * 9


def defined_score(times, now, seconds, mode):
    m = max(1, math.ceil((now - min(times)) / seconds))
    nap = np.bincount(np.clip(np.floor((np.array(times) - min(times)) / seconds).astype(int), 0, m - 1), minlength=m) / max(1.0, now - min(times))
    w = np.linspace(0.1, 1.0, m) if m > 1 else np.array([1.0])
    other = nap[::-1] if mode == "reverse" else np.where(nap > 0, 1 / np.maximum(nap, 1e-12), 0)
    return (nap * w).sum() / (other * w).sum()


@pytest.mark.parametrize("mode", ["reverse", "reciprocal"])
def test_scores_against_the_definition(spark, mode):
    rng = np.random.default_rng(5)
    for _ in range(4):
        times = np.sort(rng.integers(0, 4000, rng.integers(1, 30))).tolist()
        now = max(times) + int(rng.integers(0, 300))
        assert math.isclose(scores(spark, times, now, mode=mode), defined_score(times, now, 60, mode), rel_tol=1e-9)


def test_score_shapes(spark):
    assert math.isclose(scores(spark, [60 * i for i in range(20)], 1200), 1.0)
    assert scores(spark, [0, 60, *range(3000, 3040)], 3100) > 1 > scores(spark, range(40), 5000)
    assert scores(spark, [7], 7) == 1.0
    with pytest.raises(ValueError):
        scores(spark, [1], 2, mode="other")


def test_survivors_and_filter(spark):
    df = spark.createDataFrame([(i, s) for i, s in enumerate([0.5, 1.0, 1.3, 9.0])], "i int, score double")
    assert [r.i for r in burst.survivors(df, 1.2).orderBy("i").collect()] == [2, 3]
    assert [r[0] for r in df.orderBy("i").select(burst.interpret(F.col("score"))).collect()] == ["not bursty", "verge", "bursty", "bursty"]
    assert burst.least_mentions(1.2) == 3 and burst.least_mentions(0.9) == 1 and burst.least_mentions(11) == 1


def brute_score(times, now, seconds=60, wmin=0.1, wmax=1.0):
    if not times:
        return 0.0
    m = max(1, math.ceil((now - min(times)) / seconds))
    if m == 1:
        return 1.0
    x = (wmax - wmin) * sum(min(max(math.floor((t - min(times)) / seconds), 0), m - 1) for t in times) / (m - 1)
    return (len(times) * wmin + x) / (len(times) * wmax - x)


def test_forgetting_fold_against_brute_force(spark):
    rng = np.random.default_rng(3)
    rows, clock = [], []
    for w in range(1, 9):
        for e in "abc":
            rows += [(0, "node", e, w, float((w - 1) * 1000 + int(x))) for x in rng.integers(0, 1000, rng.integers(0, 12))]
        clock.append((w, w, max([r[4] for r in rows if r[3] == w], default=w * 1000.0)))
    got = graph.forgetting_fold(spark.createDataFrame(rows, "subject_idx int, kind string, phrase string, window bigint, t double"), spark.createDataFrame(clock, "window bigint, ordinal bigint, now double"), 60, t_d=1.05)
    want = {}
    for e in "abc":
        held = []
        for w, _, now in clock:
            held += [r[4] for r in rows if r[2] == e and r[3] == w]
            if held and (s := brute_score(held, now)) >= 1.05:
                want[e, w] = (len(held), min(held), round(s, 9))
            else:
                held = []
    assert {(r.phrase, r.window): (r.n, r.t1, round(r.score, 9)) for r in got.collect()} == want and want


# -- subjects


def test_keyword_scores(spark):
    lexicon = spark.createDataFrame([(6, "goal"), (6, "team"), (1, "bank"), (1, None)], "subject_idx int, term string")
    posts = spark.createDataFrame([(1, ["goal", "goal", "team", "x"]), (2, ["bank", "goal"]), (3, []), (4, None)], "pid bigint, tokens array<string>")
    found = subjects.KeywordClassifier(lexicon).scores(posts)
    assert {(r.pid, r.subject_idx): r.score for r in found.collect()} == {(1, 6): 1.0, (2, 1): 0.5, (2, 6): 0.5}
    assigned = subjects.assign_subjects(found, 0.5)
    assert sorted((r.pid, r.subject_idx) for r in assigned.collect()) == [(1, 6), (2, 1), (2, 6)]
    counts = {r.subject: r.n_posts for r in subjects.subject_counts(posts, assigned).collect()}
    assert counts["sport"] == 2 and counts["economic"] == 1 and counts["medical"] == 0 and counts["(unlabelled)"] == 2
    assert sorted(r.pid for r in subjects.labelled_posts(posts, assigned).collect()) == [1, 2]
    with pytest.raises(ValueError):
        subjects.build_classifier("other")
    built_in = subjects.build_classifier("keyword").scores(spark.createDataFrame([(1, ["گل", "تیم", "بانک"])], "pid bigint, tokens array<string>"))
    assert {r.subject_idx: round(r.score, 4) for r in built_in.collect()} == {6: 0.6667, 1: 0.3333}


@pytest.mark.parametrize(("target", "want"), [(0, 0.1), (2, 0.25), (10, 0.9), (3, 0.35)])
def test_calibration(spark, target, want):
    best = [0.1, 0.2, 0.3, 0.4]
    posts = spark.createDataFrame([(i,) for i in range(4)], "pid bigint")
    found = spark.createDataFrame([(i, 0, s) for i, s in enumerate(best)], "pid bigint, subject_idx int, score float")
    assert math.isclose(one(subjects.calibrated_threshold(posts, found, target)), want, rel_tol=1e-6)


def test_calibration_leaves_the_target(spark):
    x = np.random.default_rng(1).random((100, 8)).astype("float32")
    posts = spark.createDataFrame([(i,) for i in range(100)], "pid bigint")
    found = spark.createDataFrame([(i, s, float(x[i, s])) for i in range(100) for s in range(8)], "pid bigint, subject_idx int, score float")
    assert 100 - subjects.assign_subjects(found, one(subjects.calibrated_threshold(posts, found, 10))).select("pid").distinct().count() == 10


def test_model_scores(spark):
    logits = spark.createDataFrame([(1, 0, 0.0), (1, 1, 0.0), (1, 2, math.log(2.0))], "pid bigint, label int, logit double")
    soft = {r.subject_idx: r.score for r in subjects.logits_to_scores(logits, {0: 3, 2: 3, 1: 5}).collect()}
    assert math.isclose(soft[3], 0.5, rel_tol=1e-6) and math.isclose(soft[5], 0.25, rel_tol=1e-6)
    assert math.isclose({r.subject_idx: r.score for r in subjects.logits_to_scores(logits, {0: 3}, "sigmoid").collect()}[3], 0.5)
    with pytest.raises(ValueError):
        subjects.logits_to_scores(logits, {}, "max")


# -- triples


@pytest.mark.parametrize(
    ("answer", "want"),
    [
        ('{"Knowledge Graph": "[[\\"a\\", \\"r\\", \\"b\\"]]"}', [("a", "r", "b")]),
        ('```json\n[["a", "r", "b"], ["x", "y"]]\n```', [("a", "r", "b")]),
        ("Here: [a, 'r', b] and [x]", [("a", "r", "b")]),
        ('{"other": 1, "triples": [["a", 1, " b "]]}', [("a", "1", "b")]),
        ("", []), (None, []), ("{broken", []),
    ],
)
def test_parse_answer(answer, want):
    assert triples.parse_answer(answer) == want


def test_parse_column(spark):
    assert [tuple(t) for t in column(spark, '[["a","r","b"]]', triples.parse_triples)] == [("a", "r", "b")]


def test_clean(spark):
    given = [["a", "r", "a"], ["", "r", "b"], ["a", "r", "b"], [" a ", "r", "b"], ["a", "", "c"], ["a", "r"], ["x" * 61, "r", "b"]]
    got = column(spark, given, lambda c: triples.clean_triples(triples.as_triples(c)), "array<array<string>>")
    assert [tuple(t) for t in got] == [("a", "r", "b"), ("a", triples.DEFAULT_RELATION, "c")]
    assert column(spark, None, lambda c: triples.clean_triples(triples.as_triples(c)), "array<array<string>>") == []


@pytest.mark.parametrize(("tokens", "want"), [(list("abcde"), [("a b", "c d"), ("c d", "e")]), (["a"], []), ([], []), (None, []), (["a b", "c"], [("a b", "c")]), (["a", "b"], [])])
def test_chain(spark, tokens, want):
    assert [(t.h, t.o) for t in column(spark, tokens, triples.chain_triples, "array<string>")] == want


def test_client_retries(spark):
    posts = spark.createDataFrame([(1, ["x"]), (2, ["bad"])], "pid bigint, tokens array<string>")

    def ask(text, seen={}):  # noqa: B006
        seen[text] = seen.get(text, 0) + 1
        if text == "bad" or seen[text] < 2:
            raise RuntimeError
        return '[["a","r","b"]]'

    got = {r.pid: (len(r.triples), r.status) for r in triples.extract(posts, "client", ask, retries=2, first_wait=0.0).collect()}
    assert got == {1: (1, "ok"), 2: (0, "failed")}
    with pytest.raises(ValueError):
        triples.extract(posts, "other")


def test_store(spark, tmp_path):
    path = str(tmp_path / "store")
    posts = spark.createDataFrame([(1, ["a", "b", "c"]), (2, ["d", "e", "f"]), (3, ["g"])], "pid bigint, tokens array<string>")
    first = kgstore.ensure_graphs(posts.where("pid < 3"), path, triples.extract, "heuristic")
    assert sorted(r.pid for r in first.collect()) == [1, 2]
    again = kgstore.ensure_graphs(posts, path, triples.extract, "heuristic")
    assert sorted(r.pid for r in again.collect()) == [1, 2, 3]
    (tmp_path / "store" / "bad.json").write_text('{"pid": 9, broken\n\n{"pid": 2, "triples": [["x","y","z"]], "backend": "b", "seq": 9223372036854775807}\n')
    log = kgstore.scan_json(spark, path)
    assert len([r for r in log.select("pid", "_corrupt_record").collect() if r._corrupt_record]) == 1
    rows = {r.pid: r for r in kgstore.latest(kgstore.readable(log)).collect()}
    assert rows[2].triples == [["x", "y", "z"]] and len(rows) == 3
    kgstore.compact(log, str(tmp_path / "small"))
    small = kgstore.readable(kgstore.scan_json(spark, str(tmp_path / "small")))
    assert small.count() == 3 and small.where("backend is not null").count() == 0
    assert kgstore.missing(posts, small).count() == 0
    assert {r.pid: len(r.triples) for r in kgstore.lookup(posts, small.where("pid = 1")).collect()} == {1: 1, 2: 0, 3: 0}
    assert triples.triple_stats(kgstore.graphs(small)).first().n_triples == 2


# -- the graph


def placed_of(spark, rows):
    return spark.createDataFrame([(0, p, float(t), k, h, r, o) for k, (p, t, h, r, o) in enumerate(rows)], "subject_idx int, pid bigint, t double, pos int, h string, r string, o string")


def test_graph_tables(spark):
    placed = placed_of(spark, [(1, 0, "a", "r", "b"), (2, 5, "a", "r", "c"), (2, 5, "كا", "r", "کا")])
    found = graph.mentions(placed)
    rows = {(r.kind, r.phrase): (r.n_mentions, r.n_posts, r.first_t, r.last_t) for r in graph.entities(found).collect()}
    assert rows["node", "a"] == (2, 2, 0.0, 5.0) and rows["edge", "r"] == (3, 2, 0.0, 5.0) and rows["node", "کا"] == (2, 1, 5.0, 5.0)
    assert {r.phrase: r.title for r in graph.modal_titles(found).collect()}["کا"] == "كا"
    rels = graph.relations(placed)
    assert sorted((r.n1, r.n2) for r in rels.collect()) == [("a", "b"), ("a", "c")]
    alive = spark.createDataFrame([(0, "node", "a"), (0, "node", "b"), (0, "edge", "r")], "subject_idx int, kind string, phrase string")
    assert [(r.n1, r.n2) for r in graph.prune_relations(rels, alive).collect()] == [("a", "b")]
    scored = spark.createDataFrame([(0, "r", 2.0)], "subject_idx int, e string, score double")
    assert sorted((r.a, r.b, r.weight) for r in graph.pair_weights(rels, scored).collect()) == [("a", "b", 2.0), ("a", "c", 2.0)]
    assert {r.weight for r in graph.pair_weights(rels, scored.where("score < 0")).collect()} == {0.0}


def test_components(spark):
    chain = [(0, f"n{i:02}", f"n{i + 1:02}") for i in range(30)] + [(0, "x", "y"), (1, "n00", "n01")]
    nodes = spark.createDataFrame([(0, f"n{i:02}") for i in range(31)] + [(0, "x"), (0, "y"), (0, "alone"), (1, "n00"), (1, "n01")], "subject_idx int, node string")
    got = {(r.subject_idx, r.node): r.component for r in graph.components(nodes, spark.createDataFrame(chain, "subject_idx int, a string, b string")).collect()}
    assert {got[0, f"n{i:02}"] for i in range(31)} == {"n00"} and got[0, "y"] == "x" and got[0, "alone"] == "alone" and got[1, "n01"] == "n00" and len(got) == 36


TWO = [(0, 1, 1.0), (1, 2, 1.0), (0, 2, 1.0), (3, 4, 1.0), (4, 5, 1.0), (3, 5, 1.0)]


@pytest.mark.parametrize("method", ["louvain", "components", "spectral"])
def test_two_stories_are_two_clusters(method):
    options = {"clusters": 2} if method == "spectral" else {}
    assert cluster.clusters_of(method, 6, TWO, **options) == [[0, 1, 2], [3, 4, 5]]


def test_clustering_edges():
    joined = [*TWO, (2, 3, 0.1)]
    labels = cluster.louvain(6, joined)
    assert cluster.modularity(6, joined, labels) > cluster.modularity(6, joined, cluster.connected(6, joined))
    assert cluster.clusters_of("louvain", 3, []) == [[0], [1], [2]]
    v = np.array([[1.0, 0], [0.9, 0.1], [0, 1.0]])
    assert cluster.clusters_of("hcluster", 3, [], v, distance=0.5) == [[0, 1], [2]]
    assert cluster.clusters_of("spectral", 2, [(0, 1, 1.0)]) == [[0, 1]]
    with pytest.raises(ValueError):
        cluster.clusters_of("other", 1, [])


def test_spectral_keeps_no_square(monkeypatch):
    """Leading eigenvectors by components are those of the whole matrix; of 5,000 nodes it (200 MB) is not held."""
    rng = np.random.default_rng(1)
    pairs = {(int(a), int(b)) for a, b in rng.integers(0, 400, (900, 2)) if a < b} | {(450 + 2 * k, 451 + 2 * k) for k in range(20)}
    edges = [(a, b, 0.9 + float(x)) for (a, b), x in zip(sorted(pairs), rng.uniform(0, 1, len(pairs)))]
    for k in (2, 5, 8):
        monkeypatch.setattr(cluster, "_DENSE", 100)
        parts, kept = cluster.spectral(600, edges, clusters=k), [np.linalg.qr(f(600, edges, k))[0] for f in (cluster._leading, cluster._leading_dense)]
        assert np.linalg.svd(kept[0].T @ kept[1])[1].min() > 1 - 1e-9
        monkeypatch.undo()
        same = cluster.spectral(600, edges, clusters=k)
        assert len(set(zip(parts, same))) == len(set(parts)) == len(set(same))
    tracemalloc.start()
    labels = cluster.spectral(5000, edges, clusters=4)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(labels) == 5000 and len(set(labels)) == 4 and most < 100e6


def test_average_linkage_keeps_no_square():
    """As plain average linkage; and of 6,000 nodes memory holds the near pairs, not the matrix of all distances (144 MB)."""
    rng = np.random.default_rng(8)
    for n, spread in ((60, 0.5), (120, 1.0), (40, 0.2)):
        v = rng.normal(size=(4, 6))[rng.integers(0, 4, n)] + spread * rng.normal(size=(n, 6))
        unit = v / np.linalg.norm(v, axis=1, keepdims=True)
        groups = [[k] for k in range(n)]
        while len(groups) > 1:
            d, a, b = min((float((1 - unit[x] @ unit[y].T).mean()), k, m) for k, x in enumerate(groups) for m, y in enumerate(groups) if k < m)
            if d > 0.5:
                break
            groups[a] += groups.pop(b)
        assert cluster.clusters_of("hcluster", n, [], v, distance=0.5) == sorted(map(sorted, groups))
    v = rng.normal(size=(6000, 32))
    tracemalloc.start()
    labels = cluster.hierarchical(6000, [], np.concatenate([v[:3000], v[:3000]]), distance=0.2)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert labels[:3000] == labels[3000:] and most < 60e6


def test_cluster_graphs(spark):
    nodes = spark.createDataFrame([(s, f"n{i}") for s in (0, 1) for i in range(6)], "subject_idx int, node string")
    pairs = spark.createDataFrame([(0, f"n{a}", f"n{b}", w) for a, b, w in TWO], "subject_idx int, a string, b string, weight double")
    got = {(r.subject_idx, r.node): r.cluster for r in cluster.cluster_graphs(nodes, pairs).collect()}
    assert [got[0, f"n{i}"] for i in range(6)] == [0, 0, 0, 1, 1, 1] and len({got[1, f"n{i}"] for i in range(6)}) == 6


# -- the fold with merging


def unit_of(p):
    return fold.unit(vectors.hashed_vector(p, 128))


def taken(g, triples, t, pid):
    h, r, o = zip(*triples)
    return g.take(h, r, o, np.full(len(h), float(t)), np.full(len(h), pid), unit_of)


def test_fold_merges():
    g = fold.SubjectFold(Options(t_n=0.1, t_e=0.1))
    assert taken(g, [("علی", "رفت", "خانه")], 1, 1) == 1
    assert (len(g.nodes), len(g.edges), len(g.relations)) == (2, 1, 1)
    taken(g, [("علی", "رفت", "خانه"), ("", "رفت", "خانه")], 2, 2)
    assert len(g.nodes) == 2 and np.bincount(g.nodes.m_entity).tolist() == [2, 3] and set(g.nodes.m_pid[g.nodes.m_entity == 0]) == {1, 2} and len(g.relations) == 2
    apart = fold.SubjectFold(Options(t_n=0.0, t_e=0.0))
    taken(apart, [("کتاب", "r", "کتابی"), ("کتابها", "r", "خانه")], 1, 1)
    assert len(apart.nodes) == 4
    loose = fold.SubjectFold(Options(t_n=0.9, t_e=0.9))
    taken(loose, [("کتاب", "r", "میز"), ("کتابها", "r", "میزها")], 1, 1)
    assert len(loose.nodes) == 2
    g.keep(np.array([False, True]), np.array([True]))
    assert g.nodes.titles() == ["خانه"] and len(g.relations) == 0 and g.nodes.form_of == {"خانه": 0}


def test_first_form_counts_twice():
    index, of = fold.Phrases(2.1), {"a": np.array([1.0, 0.0], "float32"), "b": np.array([0.0, 1.0], "float32")}
    index.mention(["a", "b"], np.zeros(2), np.ones(2, "int64"), of.get)
    assert np.allclose(index.sums[0], [2.0, 1.0]) and np.allclose(index.place[0], fold.unit(np.array([2.0, 1.0])))


@pytest.mark.parametrize("threshold", [0.0, 0.3, 0.7])
@pytest.mark.parametrize("together", [1, 4, 512])
def test_phrases_settle_as_one_by_one(threshold, together, monkeypatch):
    """In stretches of any length, as a plain loop over single mentions does it."""
    monkeypatch.setattr(fold, "_TOGETHER", together)
    rng = np.random.default_rng(5)
    names = ["".join(rng.choice(list("abcd"), 4)) for _ in range(60)]
    stream = [str(x) for x in rng.choice(names, 200)]
    index, lo, got = fold.Phrases(threshold), 0, []
    while lo < len(stream):
        hi = lo + int(rng.integers(1, 30))
        part = stream[lo:hi]
        got += index.mention(part, np.zeros(len(part)), np.ones(len(part), "int64"), unit_of).tolist()
        lo = hi
    sums, places, known, want = [], [], {}, []
    for p in stream:
        if p not in known:
            near = [float(c @ unit_of(p)) for c in places]
            best = int(np.argmax(near)) if near else -1
            if best < 0 or 1 - near[best] >= threshold:
                best = len(sums)
                sums.append(unit_of(p).copy())
                places.append(None)
            sums[best] = sums[best] + unit_of(p)
            places[best] = fold.unit(sums[best])
            known[p] = best
        want.append(known[p])
    assert got == want


def test_scores_of_columns():
    rng = np.random.default_rng(6)
    entity, times = rng.integers(0, 9, 80), rng.uniform(0, 1000, 80).round()
    got = fold.burst_scores(entity, times, 10, 1100.0, 60, 0.1, 1.0)
    assert np.allclose(got, [brute_score(times[entity == k].tolist(), 1100.0) for k in range(10)])


def test_detect_and_registry():
    g = fold.SubjectFold(Options(t_n=0.0, t_e=0.0))
    taken(g, [("a", "r", "b"), ("b", "r", "c")], 1, 7)
    found = g.events(np.ones(3), np.array([1.5]), lambda p: vectors.hashed_vector(p, 128))
    assert len(found) == 1 and found[0]["post_ids"] == [7] and found[0]["nodes"] == [0, 1, 2] and found[0]["keywords"] == ["b", "c", "a"]
    r = fold.GlobalEvents(2.0)
    assert r.join(np.array([[5.0, 0, 0], [5.0, 0.5, 0.5]])).tolist() == [1, 1] and r.join(np.array([[2.0, 0, 0]])).tolist() == [2]
    assert np.allclose(r.centres[0], [5.0, 0.25, 0.25]) and r.sizes.tolist() == [2, 1]


def _joined_plainly(vectors, threshold):
    """Every vector measured against every centre, one after another."""
    centres, sizes, numbers = [], [], []
    for v in np.asarray(vectors, "float32"):
        far = np.linalg.norm(np.array(centres) - v, axis=1) if centres else np.array([np.inf])
        at = int(far.argmin()) if centres and far.min() < threshold else len(centres)
        if at == len(centres):
            centres, sizes = [*centres, np.zeros_like(v)], [*sizes, 0]
        sizes[at] += 1
        centres[at] = centres[at] * np.float32((sizes[at] - 1) / sizes[at]) + v * np.float32(1 / sizes[at])
        numbers.append(at + 1)
    return numbers, np.array(centres), sizes


def test_registry_measures_few_centres(monkeypatch):
    """Joining measures the centres that can be the nearest, not all of them: else its time grows with the square."""
    v, rows, norm = np.random.default_rng(4).normal(size=(1500, 16)) * 5, [], np.linalg.norm
    monkeypatch.setattr(np.linalg, "norm", lambda x, *a, **k: rows.append(len(x)) or norm(x, *a, **k))
    numbers = fold.GlobalEvents(12.0).join(v)
    monkeypatch.undo()
    assert sum(rows) < 20 * len(v) and numbers.tolist() == _joined_plainly(v, 12.0)[0] and numbers.max() > 300


def test_registry_ties_and_stretches():
    """Equal and zero vectors, ones that are no numbers, any cut of the stream, and centres that were stored: as measured plainly."""
    rng = np.random.default_rng(5)
    v = rng.integers(-2, 3, (700, 4)).astype("float32")
    v[::50] = 0
    for rows, threshold in ((v, 1.5), (np.where(np.arange(700)[:, None] == 650, np.nan, v), 1.5), (v[:0], 1.0), (v, 0.0)):
        numbers, centres, sizes = _joined_plainly(rows, threshold)
        known = fold.GlobalEvents(threshold)
        assert np.concatenate([known.join(rows[:100]), known.join(rows[100:])]).tolist() == numbers
        assert known.sizes.tolist() == sizes and (not len(rows) or np.array_equal(known.centres, centres, equal_nan=True))
    first = fold.GlobalEvents(1.5)
    first.join(v[:300])
    assert fold.GlobalEvents(1.5, first.centres, first.sizes).join(v[300:]).tolist() == _joined_plainly(v, 1.5)[0][300:]


def test_register_matches_the_fold(spark):
    rng = np.random.default_rng(2)
    rows = [(int(s), int(w), k, [f"t{k}", "t"], [k, 1], rng.normal(size=4).tolist()) for k, (s, w) in enumerate(rng.integers(0, 8, (40, 2)))]
    df = spark.createDataFrame(rows, "subject_idx int, window bigint, event_no int, titles array<string>, post_ids array<bigint>, vector array<float>")
    finals, bridge = events.register(df, 1.5)
    ordered = sorted(rows, key=lambda x: (x[1], x[0], x[2]))
    numbers = fold.GlobalEvents(1.5).join(np.array([x[5] for x in ordered])).tolist()
    assert {(b.subject_idx, b.window, b.event_no): b.number for b in bridge.collect()} == {x[:3]: k for x, k in zip(ordered, numbers)}
    of = {f.event_number: f for f in finals.collect()}
    for k in set(numbers):
        own = [x for x, number in zip(ordered, numbers) if number == k]
        assert of[k].n == len(own) and of[k].titles == list(dict.fromkeys(t for x in own for t in x[3])) and of[k].post_ids == sorted({p for x in own for p in x[4]})
        assert of[k].windows == sorted({x[1] for x in own}) and np.allclose(of[k].vector, np.mean([x[5] for x in own], 0), atol=1e-5)


# -- evaluation


def brute_entropy(evals, desires):
    """Every sample in each of its groups is given the commonest label, step by step."""
    total = 0.0
    for g in dict.fromkeys(x for e in evals for x in e):
        of = {i: list(d) for i, d in enumerate(desires) if g in evals[i]}
        count = {}
        for d in of.values():
            for c in d:
                count[c] = count.get(c, 0) + 1
        while count:
            best = max(count, key=count.get)
            if not count[best]:
                break
            for i, d in of.items():
                if best in d:
                    for c in d:
                        count[c] -= 1 if c in count else 0
                    of[i] = [best]
            count.pop(best)
        s = {}
        for i, d in of.items():
            s[d[0]] = s.get(d[0], 0) + 1 / len(evals[i])
        z = sum(s.values())
        total += -sum(v * math.log2(v / z) for v in s.values())
    return total / len(evals)


def test_entropy(spark):
    rng = np.random.default_rng(4)
    for many in (False, True):
        some = lambda: [str(x) for x in rng.choice(4, rng.integers(1, 3) if many else 1, replace=False)]  # noqa: B023, E731
        rows = [(i, some(), some()) for i in range(60)]
        df = spark.createDataFrame(rows, "i bigint, e array<string>, d array<string>")
        got = one(evaluate.entropy(df, "e", "d", "i"))
        assert math.isclose(got, brute_entropy([r[1] for r in rows], [r[2] for r in rows]), rel_tol=1e-9)
        if not many:
            assert math.isclose(one(evaluate.entropy_single(df.select(F.col("e")[0].alias("e"), F.col("d")[0].alias("d")), "e", "d")), got, rel_tol=1e-9)


def test_topic_scores(spark):
    kind = "label int, titles array<string>"
    gold = spark.createDataFrame([(0, ["WRONGDETECT"]), (1, ["fire tower"]), (2, ["gold"])], kind)
    system = spark.createDataFrame([(0, []), (1, ["big gold rush"]), (2, ["firemen"])], kind)
    got = evaluate.topic_scores(gold, system).first()
    assert math.isclose(got.topic_precision, 1 / 3) and math.isclose(got.topic_recall, 2 / 3)
    assert math.isclose(got.keyword_precision, 2 / 5) and math.isclose(got.keyword_recall, 2 / 4)


def test_gold_titles(spark):
    gold = spark.createDataFrame([("1, 3", "a,b"), ("0", "0"), ("1", None)], "topics_id string, topics_str string")
    assert {r.label: r.titles for r in evaluate.gold_titles(gold).collect()} == {0: ["0"], 1: ["a"], 2: ["WRONGDETECT"], 3: ["b"]}
    labels = spark.createDataFrame([(2, ["x", "y"]), (-1, ["z"]), (2, ["x"])], "label int, titles array<string>")
    assert {r.label: r.titles for r in evaluate.label_titles(labels).collect()} == {0: [], 1: [], 2: ["x", "y"]}


def test_labels(spark):
    assert column(spark, "12, 5", evaluate.label_list) == ["12", "5"] and column(spark, "1,2", lambda c: evaluate.label_list(c, "chars")) == ["1", ",", "2"]
    assert [r[0] for r in spark.createDataFrame([("3,4",), ("",), (None,), ("x",)], "x string").select(evaluate.first_number("x")).collect()] == [3, -1, -1, -1]
    with pytest.raises(ValueError):
        evaluate.label_list("x", "other")


def test_titles_in_text(spark):
    posts = spark.createDataFrame([(1, 1, "the big fire tower fell"), (2, 1, "nothing"), (3, 2, "fire")], "pid bigint, window bigint, text string")
    topics = spark.createDataFrame([(1, "ig fire tow"), (1, "e big"), (1, "ower"), (1, "absent"), (1, ""), (2, "tower")], "window bigint, title string")
    assert {r.pid: r.titles for r in evaluate.titles_in_text(posts, topics).collect()} == {1: "e big|ig fire tow|ower"}


def test_titles_in_text_by_parts_and_tasks(spark, monkeypatch):
    """Every title that stands in a text, however a window is cut; only texts and titles travel, no pieces of their words."""
    rng = np.random.default_rng(6)
    phrase = lambda most: "".join(rng.choice(list("ab  c"), rng.integers(0, most)))
    titles = sorted({(int(w), phrase(7)) for w in rng.integers(1, 4, 300)} | {(1, " "), (1, "a"), (2, "a b a b")})
    posts = [(k, k % 4, phrase(25)) for k in range(80)] + [(99, 1, None)]
    want = {k: "|".join(sorted(t for v, t in titles if v == w and t.strip(" ") and t in x)) for k, w, x in posts if x}
    at = [spark.createDataFrame(posts, "pid long, window long, text string"), spark.createDataFrame(titles, "window long, title string")]
    for sizes in ((500_000, 10_000), (10, 7), (500_000, 7)):
        monkeypatch.setattr(evaluate, "TITLES_AT_ONCE", sizes[0])
        monkeypatch.setattr(evaluate, "POSTS_AT_ONCE", sizes[1])
        got = evaluate.titles_in_text(*at).collect()
        assert {r.pid: r.titles for r in got} == {k: t for k, t in want.items() if t} and len(got) == len({r.pid for r in got})


# -- sources and sinks


def test_results_round_trip(spark, tmp_path):
    found = spark.createDataFrame([(1, ["a b", ""], [1, 2], 1), (1, [], [2], 2), (2, ["c"], [3], 2)], "window bigint, titles array<string>, post_ids array<bigint>, number int")
    posts = spark.createDataFrame([(1, 1), (1, 2), (1, 9), (2, 3)], "window bigint, pid bigint")
    assigned = results.assignments(posts, found)
    assert {r.pid: r.event_number for r in assigned.collect()} == {1: "1", 2: "1,2", 9: "0", 3: "2"}
    results.save_table(assigned, str(tmp_path / "a"), "window")
    results.save_table(results.topics(found), str(tmp_path / "t"))
    assert {r.pid: r.event_number for r in results.scan_assignments(spark, str(tmp_path / "a")).collect()} == {1: 1, 2: 1, 9: 0, 3: 2}
    assert sorted((r.window, r.title) for r in results.scan_topics(spark, str(tmp_path / "t")).collect()) == [(1, "a b"), (2, "c")]
    runs = lambda x: spark.createDataFrame(x, "stamp string, path string")
    assert results.evaluation_report(posts.limit(1), "td-1.2_clu-louvain").columns == ["td", "clu", "window", "pid"]
    assert [r.stamp for r in results.paired_runs(runs([("s", "p"), ("u", "q")]), runs([("s", "r")])).collect()] == ["s"]


def test_nested_and_numpy(spark, tmp_path):
    t = datetime(2017, 1, 1)
    parts = np.empty(7, object)
    for k, x in enumerate(([[1, 2], [3]], [[["a"], ["b", "c"]], [["d"]]], [[["W"], ["W", "W"]], [["W"]]], [["", ""], ["x"]], [[t, t], [t]], [[5, 6], [7]], [1, 2])):
        parts[k] = x
    np.save(tmp_path / "c.npy", parts, allow_pickle=True)
    corpus.register(spark)
    reader = spark.read.format("npy_corpus").option("path", str(tmp_path / "c.npy"))
    rows = reader.option("trusted", "true").load()
    assert [(r.pid, r.tokens, r.window_no) for r in rows.orderBy("pid").collect()] == [(1, ["a"], 1), (2, ["b", "c"], 1), (3, ["d"], 2)]
    with pytest.raises(Exception, match="trusted"):
        reader.option("trusted", "false").load().count()
    nested = spark.createDataFrame([([1, 2], [["a"], ["b"]], [["W"], ["W"]], ["", ""], [t, t], [5, 6], 1)], "pids array<bigint>, tokens array<array<string>>, types array<array<string>>, deleted array<string>, dts array<timestamp_ntz>, user_ids array<bigint>, window_no int")
    assert sorted((r.pid, r.tokens[0], r.user_id) for r in corpus.from_nested(nested).collect()) == [(1, "a", 5), (2, "b", 6)]


def test_caches(spark, tmp_path):
    asked = []
    posts = spark.createDataFrame([(1,), (2,)], "pid bigint")

    def compute(todo):
        asked.append(sorted(r.pid for r in todo.collect()))
        return todo.where("pid <> 2").select("pid", F.lit(1).alias("subject_idx"), F.lit(0.5).cast("float").alias("score"))

    for p in (posts, posts, posts.union(spark.createDataFrame([(3,)], "pid bigint"))):
        got = caches.cached_scores(p, str(tmp_path / "s"), "k", compute)
    assert asked == [[1, 2], [], [3]] and sorted(r.pid for r in got.collect()) == [1, 3]
    phrases = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "phrase string")
    for _ in range(2):
        got = caches.cached_embeddings(phrases, str(tmp_path / "e"), "m", vectors.hashing_embedder(16))
    assert sorted(r.phrase for r in got.collect()) == ["a", "b"]


def test_materialize(spark):
    df = materialize(spark.range(10), "x")
    assert df.count() == 10 and broadcast_if_small(df, 10)[1] and not broadcast_if_small(df, 9)[1]


def test_pipeline_has_all_results():
    assert {"topics", "assignments", "report", "stats"} <= set(pipeline.Run.__dataclass_fields__)


def test_every_option_is_read():
    from dataclasses import fields
    from pathlib import Path

    import rillgraph

    root = Path(rillgraph.__file__).parent
    code = "\n".join(p.read_text() for p in root.rglob("*.py") if "llm" not in p.parts)
    for f in fields(Options):
        assert re.search(rf"(?:o|options|self)\.{f.name}\b", code), f.name


def test_no_local_folder_on_a_cluster():
    from types import SimpleNamespace

    from rillgraph.plans.materialize import checkpoint_root

    session = lambda master: SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master=master, getCheckpointDir=lambda: None))
    with pytest.raises(RuntimeError, match="share"):
        checkpoint_root(session("spark://host:7077"))


def test_samples_do_not_depend_on_the_tasks(spark):
    from rillgraph.plans.sampling import hash_sample

    rows = spark.range(20_000).withColumnRenamed("id", "k")
    got = [{r.k for r in hash_sample(rows.repartition(n), "k", 500).collect()} for n in (1, 16)]
    assert got[0] == got[1] and 400 < len(got[0]) <= 500 and hash_sample(rows.limit(10), "k", 500).count() == 10
