"""The stream graph as tables: mentions, entities, relations. Entities are exact phrases here (both merge thresholds 0);
:mod:`rillgraph.operators.fold` merges similar phrases in stream order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillgraph.functions.arrays import let
from rillgraph.functions.text import epoch_seconds, normalise_phrase
from rillgraph.operators.burst import closed_form, interval_count, least_mentions
from rillgraph.plans.materialize import materialize

ENTITY = ["subject_idx", "kind", "phrase"]


def placed_triples(posts: DataFrame, assigned: DataFrame, graphs: DataFrame) -> DataFrame:
    """``(subject_idx, pid, t, pos, h, r, o)``: every triple of every post in each of the post's subjects."""
    rows = graphs.where("size(triples) > 0").select("pid", F.posexplode("triples").alias("pos", "x"))
    timed = posts.select("pid", epoch_seconds("dt").alias("t"))
    return rows.join(timed, "pid").join(assigned, "pid").select("subject_idx", "pid", "t", "pos", "x.h", "x.r", "x.o")


def mentions(placed: DataFrame) -> DataFrame:
    """``(subject_idx, kind, phrase, surface, t, pid, pos, role)``: head, tail and relation of each triple, one row each, in
    the order in which they are merged. Phrases that normalise to nothing are no entities."""
    of = lambda kind, role, c: F.struct(F.lit(kind).alias("kind"), F.lit(role).alias("role"), F.col(c).alias("surface"))
    rows = placed.select("subject_idx", "pid", "t", "pos", F.explode(F.array(of("node", 0, "h"), of("node", 1, "o"), of("edge", 2, "r"))).alias("x"))
    return rows.select("subject_idx", "x.kind", normalise_phrase(F.col("x.surface")).alias("phrase"), "x.surface", "t", "pid", "pos", "x.role").where("phrase <> ''")


def entities(found: DataFrame) -> DataFrame:
    """Mentions, first and last time and number of posts of each entity."""
    per_post = found.groupBy(*ENTITY, "pid").agg(F.count("*").alias("n"), F.min("t").alias("a"), F.max("t").alias("b"))
    return per_post.groupBy(*ENTITY).agg(F.sum("n").alias("n_mentions"), F.min("a").alias("first_t"), F.max("b").alias("last_t"), F.count("*").alias("n_posts"))


def titles(found: DataFrame, by: list[str] = ENTITY) -> DataFrame:
    """``(*by, surface, n, rank)``: the written forms of each entity, the commonest first, ties to the one seen first."""
    forms = found.groupBy(*by, "surface").agg(F.count("*").alias("n"), F.min(F.struct("t", "pid", "pos", "role")).alias("seen"))
    return forms.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("n"), "seen"))).drop("seen")


def modal_titles(found: DataFrame, by: list[str] = ENTITY) -> DataFrame:
    """``(*by, title)``: the commonest written form."""
    forms = found.groupBy(*by, "surface").agg(F.count("*").alias("n"), F.min(F.struct("t", "pid", "pos", "role")).alias("seen"))
    least = F.struct(-F.col("n"), F.col("seen"))
    return forms.groupBy(*by).agg(F.min_by("surface", least).alias("title"))


def relations(placed: DataFrame) -> DataFrame:
    """``(subject_idx, n1, e, n2, t, pid, pos)``: relations between two different entities, repeats kept."""
    norm = lambda c: normalise_phrase(F.col(c))
    rows = placed.select("subject_idx", norm("h").alias("n1"), norm("r").alias("e"), norm("o").alias("n2"), "t", "pid", "pos")
    return rows.where("n1 <> '' and e <> '' and n2 <> '' and n1 <> n2")


def prune_relations(rels: DataFrame, alive: DataFrame) -> DataFrame:
    """The relations of which both ends and the relation phrase survive. ``alive`` has :data:`ENTITY` of the survivors."""
    for end, kind in (("n1", "node"), ("n2", "node"), ("e", "edge")):
        keys = alive.where(F.col("kind") == kind).select("subject_idx", F.col("phrase").alias(end))
        rels = rels.join(keys, ["subject_idx", end], "left_semi")
    return rels


def with_dense_ids(alive: DataFrame, by: list[str], order: str) -> DataFrame:
    """``entity_id`` from 0 in ascending order within each group."""
    return alive.withColumn("entity_id", (F.row_number().over(Window.partitionBy(*by).orderBy(order)) - 1).cast("long"))


def pair_weights(rels: DataFrame, scores: DataFrame) -> DataFrame:
    """``(subject_idx, a, b, weight)``: of each unordered pair the best score of its relation phrases, at least 0, which also
    stands for phrases without a score. ``scores`` has ``(subject_idx, e, score)``."""
    known = rels.select("subject_idx", F.least("n1", "n2").alias("a"), F.greatest("n1", "n2").alias("b"), "e").distinct().join(scores, ["subject_idx", "e"], "left")
    return known.groupBy("subject_idx", "a", "b").agg(F.greatest(F.max(F.coalesce("score", F.lit(0.0))), F.lit(0.0)).alias("weight"))


def induced_relations(rels: DataFrame, members: DataFrame) -> DataFrame:
    """The relations with both ends in one cluster, repeats kept. ``members`` has ``(subject_idx, phrase, cluster)``."""
    one = members.select("subject_idx", F.col("phrase").alias("n1"), F.col("cluster").alias("c1"))
    two = members.select("subject_idx", F.col("phrase").alias("n2"), F.col("cluster").alias("c2"))
    return rels.join(one, ["subject_idx", "n1"]).join(two, ["subject_idx", "n2"]).where("c1 = c2").withColumnRenamed("c1", "cluster").drop("c2")


def components(nodes: DataFrame, edges: DataFrame, by: str = "subject_idx", most_rounds: int = 60) -> DataFrame:
    """``(by, node, component)``: connected components, named by their smallest node.

    Alternates large-star and small-star steps, which need a number of rounds that grows with the logarithm of the
    longest path, not with the path. Each round is written to the shared folder, so lineage stays short.
    """
    links = edges.select(by, "a", "b").where("a <> b").distinct()
    links = links.select(by, F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    before = None
    for _ in range(most_rounds):
        both = links.unionByName(links.select(by, F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy(by, "u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, [by, "u"]).select(by, F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.unionByName(low.where("m < u").select(by, "u", F.col("m").alias("v"))).where("u <> v").distinct()
        down = large.groupBy(by, "u").agg(F.min("v").alias("m"))
        small = large.join(down, [by, "u"]).where("v <> m").select(by, F.col("v").alias("u"), F.col("m").alias("v"))
        links = materialize(small.unionByName(down.select(by, "u", F.col("m").alias("v"))).distinct(), "components")
        state = tuple(links.agg(F.count("*"), F.sum(F.xxhash64(by, "u", "v").cast("decimal(38,0)"))).first())
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return nodes.select(by, "node").distinct().join(links.select(by, F.col("u").alias("node"), "v"), [by, "node"], "left").select(by, "node", F.coalesce("v", "node").alias("component"))


def modularity(members: DataFrame, pairs: DataFrame, cluster: str, by: str = "subject_idx") -> DataFrame:
    """``(by, modularity)`` of the clusters in the column ``cluster`` of ``(by, node)``, over weights above 0."""
    pairs = pairs.where("weight > 0 and a <> b")
    ends = pairs.select(by, F.explode(F.array("a", "b")).alias("node"), "weight").groupBy(by, "node").agg(F.sum("weight").alias("degree"))
    degree = members.join(ends, [by, "node"]).groupBy(by, cluster).agg(F.sum("degree").alias("degree"))
    side = lambda c: members.select(by, F.col("node").alias(c), F.col(cluster).alias(f"__{c}"))
    inside = pairs.join(side("a"), [by, "a"]).join(side("b"), [by, "b"]).where("__a = __b").groupBy(by, F.col("__a").alias(cluster)).agg((2 * F.sum("weight")).alias("inside"))
    parts = degree.join(inside, [by, cluster], "left").withColumn("total", F.sum("degree").over(Window.partitionBy(by)))
    part = F.coalesce("inside", F.lit(0.0)) / F.col("total") - (F.col("degree") / F.col("total")) ** 2
    return parts.groupBy(by).agg(F.sum(part).alias("modularity"))


def forgetting_fold(found: DataFrame, windows: DataFrame, seconds: float = 60, wmin: float = 0.1, wmax: float = 1.0, t_d: float = 1.2, forget_every: int = 1) -> DataFrame:
    """``(entity, window, n, t1, score)`` after each window in which the entity lives and survives.

    ``windows`` is ``(window, ordinal, now)``. At the end of a window each living entity is scored over the mentions since
    it was (re)born; below ``t_d`` it is forgotten with its whole history, if the window is one in which forgetting runs.

    With ``t = q * seconds + r`` a mention's interval counted from ``t1`` is ``q - q1``, less one where ``r < r1``. So an
    entity and window need only a count, a sum of ``q``, and the counts of the remainders (at most ``seconds`` of them for
    whole-second times): they are partial aggregates, and what reaches the fold is bounded by the number of windows, however
    often an entity is mentioned. The fold itself is a higher-order function in the JVM.
    """
    key = [*ENTITY, "window"]
    q = F.floor(F.col("t") / seconds).cast("long")
    parts = found.withColumns({"q": q, "r": F.col("t") - q * seconds}).groupBy(*key, "r").agg(F.count("*").alias("n"), F.sum("q").alias("q"), F.min("t").alias("first"))
    late = found.join(F.broadcast(windows), "window").where("t = now").groupBy(*key).agg(F.count("*").alias("at_now"))
    per = parts.groupBy(*key).agg(F.sum("n").alias("n"), F.sum("q").alias("q"), F.min("first").alias("first"), F.collect_list(F.struct("r", "n")).alias("rs"))
    per = per.join(late, key, "left").withColumn("at_now", F.coalesce("at_now", F.lit(0)))
    least = least_mentions(t_d, wmin, wmax) if forget_every <= 1 else 1  # entities that never reach t_d have no rows
    per = per.groupBy(*ENTITY).agg(F.map_from_entries(F.collect_list(F.struct("window", F.struct("n", "q", "first", "at_now", "rs")))).alias("of"), F.sum("n").alias("all"))
    per = per.where(F.col("all") >= least).drop("all")
    line = windows.agg(F.array_sort(F.collect_list(F.struct("ordinal", "window", "now"))).alias("line"))
    zero, none = F.lit(0).cast("long"), F.array().cast("array<struct<r:double,n:bigint>>")
    log = F.array().cast("array<struct<window:bigint,n:bigint,t1:double,score:double>>")
    unborn = lambda out: F.struct(zero.alias("n"), zero.alias("q"), F.lit(None).cast("double").alias("t1"), none.alias("rs"), out.alias("log"))

    def step(state: Column, w: Column) -> Column:
        def joined(new: Column) -> Column:
            n, q = state["n"] + F.coalesce(new["n"], zero), state["q"] + F.coalesce(new["q"], zero)
            t1, rs = F.coalesce(state["t1"], new["first"]), F.concat(state["rs"], F.coalesce(new["rs"], none))
            return F.struct(n.alias("n"), q.alias("q"), t1.alias("t1"), rs.alias("rs"), F.coalesce(new["at_now"], zero).alias("at_now"))

        def scored(x: Column) -> Column:
            q1 = F.floor(x["t1"] / seconds).cast("long")
            behind = F.aggregate(F.filter(x["rs"], lambda y: y["r"] < x["t1"] - q1 * seconds), zero, lambda s, y: s + y["n"])
            clipped = F.when((w["now"] > x["t1"]) & ((w["now"] - x["t1"]) % seconds == 0), x["at_now"]).otherwise(zero)
            places = x["q"] - x["n"] * q1 - behind - clipped
            return let(F.struct(places.alias("p"), interval_count(x["t1"], w["now"], seconds).alias("m")), lambda y: closed_form(x["n"], y["p"], y["m"], wmin, wmax))

        def settled(x: Column, score: Column) -> Column:
            row = F.array(F.struct(w["window"].alias("window"), x["n"].alias("n"), x["t1"].alias("t1"), score.alias("score")))
            kept = F.struct(x["n"].alias("n"), x["q"].alias("q"), x["t1"].alias("t1"), x["rs"].alias("rs"), F.concat(state["log"], row).alias("log"))
            return F.when((score >= t_d) | (w["ordinal"] % max(1, forget_every) != 0), kept).otherwise(unborn(state["log"]))

        after = let(joined(F.element_at("of", w["window"])), lambda x: F.when(x["n"] > 0, let(scored(x), lambda score: settled(x, score))).otherwise(unborn(state["log"])))
        return F.when((state["n"] > 0) | F.array_contains(F.map_keys("of"), w["window"]), after).otherwise(state)

    folded = per.join(F.broadcast(line)).select(*ENTITY, F.explode(F.aggregate("line", unborn(log), step, lambda s: s["log"])).alias("x"))
    return folded.select(*ENTITY, "x.*")
