"""Evaluation against a gold standard: entropies, topic and keyword precision, recall and F1."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillgraph.plans.materialize import materialize

WRONG = "WRONGDETECT"


def label_list(labels: str | Column, compat: str = "labels") -> Column:
    """The labels of a comma list. ``chars`` takes every character as a label, as the published figures did."""
    if compat == "chars":
        return F.split(F.col(labels) if isinstance(labels, str) else labels, "")
    if compat != "labels":
        raise ValueError(f"unknown mode: {compat!r}")
    return F.transform(F.split(F.col(labels) if isinstance(labels, str) else labels, ","), lambda x: F.trim(x))


def first_number(labels: str | Column) -> Column:
    """The first number of a comma list, -1 where there is none."""
    return F.coalesce(F.expr(f"try_cast(trim(split_part({labels}, ',', 1)) as int)") if isinstance(labels, str) else F.split_part(labels, F.lit(","), F.lit(1)).try_cast("int"), F.lit(-1))


def _resolved(sets: pd.DataFrame) -> float:
    """The entropy of one group: ``d``, label sets in the order of ``o``; ``n`` samples and weight ``w`` of each."""
    flat = np.array([x for d in sets["d"] for x in d], object)
    names, code = (np.unique(flat.astype(str), return_inverse=True) if len(flat) else (np.empty(0), np.empty(0, int)))
    has = np.zeros((len(sets), len(names)), bool)
    has[np.repeat(np.arange(len(sets)), sets["d"].map(len)), code] = True
    seen = np.full(len(names), len(flat))
    np.minimum.at(seen, code, np.arange(len(flat)))
    n, w = sets["n"].to_numpy("int64"), sets["w"].to_numpy(float)
    given, open_ = np.zeros(len(names)), np.ones(len(sets), bool)
    while open_.any() and len(names):
        count = n[open_] @ has[open_]
        best = np.lexsort((seen, -count))[0]
        if not count[best]:
            break
        mine = open_ & has[:, best]
        given[best] = w[mine].sum()
        open_ &= ~mine
    given = given[given > 0]
    return float(-(given * np.log2(given / given.sum())).sum())


def entropy(samples: DataFrame, evals: str, desires: str, order: str) -> DataFrame:
    """``(entropy)`` of the labels ``desires`` within the groups of ``evals``, both arrays of labels without repeats.

    In each group every sample is given the commonest of its labels, step by step; its weight is one over the number of
    its groups. Samples with equal labels in a group fare alike, so they are counted together first: a task gets the
    distinct sets of labels of one group. Ties go to the label seen first in ``order``.
    """
    total = samples.agg(F.count("*").alias("__all"))
    rows = samples.select(F.explode(evals).alias("g"), (1 / F.size(evals)).alias("w"), F.col(desires).alias("d"), F.col(order).alias("o"))
    sets = rows.groupBy("g", "d").agg(F.count("*").alias("n"), F.sum("w").alias("w"), F.min("o").alias("o"))

    def group(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"h": [_resolved(pdf.sort_values("o", kind="stable"))]})

    h = sets.groupBy("g").applyInPandas(group, "h double")
    return h.agg(F.coalesce(F.sum("h"), F.lit(0.0)).alias("h")).join(F.broadcast(total)).select((F.col("h") / F.greatest("__all", F.lit(1))).alias("entropy"))


def entropy_single(samples: DataFrame, evals: str, desires: str) -> DataFrame:
    """``(entropy)`` for samples with one label on either side: two plain aggregates."""
    cells = samples.groupBy(evals, desires).agg(F.count("*").alias("n"))
    whole = F.sum("n").over(Window.partitionBy(evals))
    return cells.select(F.col("n"), (-F.col("n") * F.log2(F.col("n") / whole)).alias("h")).agg((F.coalesce(F.sum("h"), F.lit(0.0)) / F.greatest(F.coalesce(F.sum("n"), F.lit(0)), F.lit(1))).alias("entropy"))


def matched_samples(gold: DataFrame, system: DataFrame) -> DataFrame:
    """The gold rows that the system knows, each with one system row; -1 for an empty system label."""
    first = Window.partitionBy("sequence_id").orderBy("event_number")
    one = system.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")
    return gold.join(one, "sequence_id").withColumn("event_number", F.coalesce("event_number", F.lit(-1)))


def in_class(rows: DataFrame, topics: str = "topics_id") -> DataFrame:
    """Rows whose gold label is not exactly ``0``; unknown labels are dropped too."""
    return rows.where(F.trim(F.col(topics)) != "0")


def gold_titles(gold: DataFrame) -> DataFrame:
    """``(label, titles)`` of every gold label from 0 to the largest: titles stand by position; gaps get ``WRONGDETECT``."""
    ids, names = F.split("topics_id", ","), F.split(F.coalesce("topics_str", F.lit("")), ",")
    pairs = gold.select(F.explode(F.arrays_zip(F.transform(ids, lambda x: F.trim(x).try_cast("int")).alias("label"), F.slice(names, 1, F.size(ids)).alias("title"))).alias("x")).select("x.*")
    known = pairs.where("label is not null and title is not null and trim(title) <> ''").groupBy("label").agg(F.sort_array(F.collect_set(F.trim("title"))).alias("titles"))
    return _dense(known, pairs.agg(F.max("label").alias("most")), F.array(F.lit(WRONG)))


def label_titles(rows: DataFrame) -> DataFrame:
    """``(label, titles)`` of every system label from 0 to the largest, from ``(label, titles)`` of posts; gaps are empty."""
    known = rows.where("label >= 0").select("label", F.explode("titles").alias("t")).groupBy("label").agg(F.sort_array(F.collect_set("t")).alias("titles"))
    return _dense(known, rows.agg(F.max("label").alias("most")), F.array().cast("array<string>"))


def _dense(known: DataFrame, most: DataFrame, gap: Column) -> DataFrame:
    every = most.where("most >= 0").select(F.explode(F.sequence(F.lit(0), F.col("most"))).alias("label"))
    return every.join(known, "label", "left").select("label", F.coalesce("titles", gap).alias("titles"))


def merged_titles(rows: DataFrame) -> DataFrame:
    """``(label, merged)``: the label's titles joined by commas; -1 stays ``-1``."""
    return label_titles(rows).select("label", F.array_join("titles", ",").alias("merged"))


#: Letters of a word by which it is looked up in a text before it is compared whole.
KEY = 8


def _places(texts: DataFrame, column: str, keep: list[str], lengths: DataFrame) -> DataFrame:
    """``(*keep, token, at, key)``: of every word of a text the pieces that a looked-up word can begin with, one for each place and
    each length in ``lengths`` (at most ``KEY`` of them): their number grows with the text, not with its square."""
    tokens = texts.select(*keep, F.explode(F.split(column, " ")).alias("token")).where("token <> ''").distinct()
    sizes = [r.n for r in lengths.select(F.least(F.col("n"), F.lit(KEY)).alias("n")).distinct().collect() if r.n]
    starts = tokens.select(*keep, "token", F.explode(F.sequence(F.lit(1), F.length("token"))).alias("at"))
    piece = lambda n: F.when(F.col("at") + n - 1 <= F.length("token"), F.substring("token", F.col("at"), F.lit(n)))
    keys = F.array(*map(piece, sorted(sizes))) if sizes else F.array().cast("array<string>")
    return starts.select(*keep, "token", "at", F.explode(F.filter(keys, lambda k: k.isNotNull())).alias("key"))


def _standing(words: DataFrame, texts: DataFrame, column: str) -> DataFrame:
    """The distinct ``word``s, none with a space, that stand somewhere inside a word of the texts."""
    words = words.select("word").where("word <> ''").distinct()
    places = _places(texts, column, [], words.select(F.length("word").alias("n"))).distinct()
    met = words.withColumn("key", F.substring("word", 1, KEY)).join(places, "key")
    return met.where(F.substring("token", F.col("at"), F.length("word")) == F.col("word")).select("word").distinct()


def topic_scores(gold: DataFrame, system: DataFrame) -> DataFrame:
    """``(topic_precision, topic_recall, topic_f1, keyword_precision, keyword_recall, keyword_f1)``.

    Both inputs are ``(label, titles)``, dense. A system label is right if a word of one of its titles is a gold title; a
    gold label is found if a word of its first title stands in some system title. Keywords count words of a label's titles
    that stand in some first gold title, and the other way round. The empty word stands everywhere.
    """
    first = gold.select("label", F.coalesce(F.array_min("titles"), F.lit("")).alias("text"))
    whole = system.select("label", F.array_join("titles", " ").alias("text"))
    words = lambda d: d.select("label", F.posexplode(F.split("text", " ")).alias("pos", "word"))

    def counted(d: DataFrame, known: DataFrame) -> DataFrame:
        hit = words(d).join(known.withColumn("in_", F.lit(1)), "word", "left")
        return hit.select("label", F.when((F.col("word") == "") | F.col("in_").isNotNull(), 1).otherwise(0).alias("hit"))

    whole_titles = gold.select(F.explode("titles").alias("word")).distinct()
    exact = counted(whole, whole_titles.where("word <> ''"))
    right = system.join(exact.join(whole.where("text <> ''").select("label"), "label", "left_semi").groupBy("label").agg(F.max("hit").alias("hit")), "label", "left")
    inside = lambda d, texts: counted(d, _standing(words(d), texts, "text"))
    found = inside(first, whole)
    share = lambda d, to: d.agg(F.coalesce(F.avg(F.coalesce("hit", F.lit(0))), F.lit(0.0)).alias(to))
    parts = [share(right, "topic_precision"), share(found.groupBy("label").agg(F.max("hit").alias("hit")), "topic_recall"), share(inside(whole, first), "keyword_precision"), share(found, "keyword_recall")]
    out = parts[0]
    for p in parts[1:]:
        out = out.join(F.broadcast(p))
    f1 = lambda p, r: F.when(F.col(p) + F.col(r) > 0, 2 * F.col(p) * F.col(r) / (F.col(p) + F.col(r))).otherwise(0.0)
    return out.select("topic_precision", "topic_recall", f1("topic_precision", "topic_recall").alias("topic_f1"), "keyword_precision", "keyword_recall", f1("keyword_precision", "keyword_recall").alias("keyword_f1"))


class WindowTitles:
    """The titles of a window, found in texts. A title stands in a text where its words do: a word alone inside a word of the
    text; of several words the first one ends a word, the last one begins one, and those between are whole, in a row."""

    def __init__(self) -> None:
        self.alone: set[str] = set()
        self.lengths: set[int] = set()
        self.several: dict[str, dict[int, dict[tuple[str, ...], set[str]]]] = {}  # first word, number and words between, last words
        self.known: dict[str, tuple] = {}  # what was found of the words of texts

    def add(self, title: str) -> None:
        self.known.clear()
        first, *between = title.split(" ")
        if between:
            last = between.pop()
            self.several.setdefault(first, {}).setdefault(len(between), {}).setdefault(tuple(between), set()).add(last)
        else:
            self.alone.add(title)
            self.lengths.add(len(title))

    def _word(self, word: str) -> tuple[list[str], list[tuple[str, set[str]]], list[tuple[str, int, dict]]]:
        """The titles inside a word; of titles whose first word ends it: the last words of those of two, the rest of longer ones."""
        n = len(word)
        inside = {x for m in self.lengths if m <= n for k in range(n - m + 1) if (x := word[k : k + m]) in self.alone}
        ends = [(x, m, rest) for x in (word[k:] for k in range(n + 1)) for m, rest in self.several.get(x, {}).items()]
        return list(inside), [(x, rest[()]) for x, m, rest in ends if not m], [e for e in ends if e[1]]

    def found(self, text: str) -> set[str]:
        out: set[str] = set()
        words = text.split(" ")
        for i, word in enumerate(words):
            if (of := self.known.get(word)) is None:
                of = self.known[word] = self._word(word)
            out.update(of[0])
            left = len(words) - i - 1
            if left and of[1]:
                end = words[i + 1]
                heads = [end[:k] for k in range(len(end) + 1)]
                for first, lasts in of[1]:
                    for x in heads if len(lasts) > 2 else lasts:
                        if x in lasts if len(lasts) > 2 else end.startswith(x):
                            out.add(f"{first} {x}")
            if left > 1 and of[2]:
                pair = (words[i + 1],)
                for first, n, rest in of[2]:
                    if n < left and (lasts := rest.get(between := pair if n == 1 else tuple(words[i + 1 : i + n + 1]))):
                        end = words[i + n + 1]
                        out.update(" ".join((first, *between, x)) for x in lasts if end.startswith(x))
        return out


#: Titles of a window that one task holds, and posts of a window that one task reads (in ``MOST_TASKS`` tasks at most).
TITLES_AT_ONCE, POSTS_AT_ONCE, MOST_TASKS = 500_000, 10_000, 16


def titles_in_text(posts: DataFrame, topics: DataFrame) -> DataFrame:
    """``(pid, titles)``: the titles of a post's window that stand in its text, joined by ``|``, in order.

    ``posts`` has ``(pid, window, text)``, ``topics`` ``(window, title)``. A window's titles go to the tasks that read its posts,
    each in as many parts as ``TITLES_AT_ONCE`` asks for; texts and titles travel, but no pieces of words. A post is in one window.
    """
    titles = materialize(topics.where("title is not null and trim(title) <> ''").select("window", "title").distinct(), "window-titles")
    parts = titles.groupBy("window").agg(F.ceil(F.count("*") / TITLES_AT_ONCE).alias("parts"))
    salts = posts.groupBy("window").agg(F.least(F.ceil(F.count("*") / POSTS_AT_ONCE), F.lit(MOST_TASKS)).alias("salts"))
    plan = F.broadcast(materialize(parts.join(salts, "window"), "window-tasks"))
    every = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    task = lambda key, c: F.pmod(F.xxhash64(key), F.col(c))
    held = titles.join(plan, "window").select("window", task("title", "parts").alias("part"), every("salts").alias("salt"), F.lit(0).alias("kind"), F.lit(None).cast(posts.schema["pid"].dataType).alias("pid"), F.col("title").alias("text"))
    read = posts.where("pid is not null and text is not null").join(plan, "window").select("window", every("parts").alias("part"), task("pid", "salts").alias("salt"), F.lit(1).alias("kind"), "pid", "text")
    rows = held.unionByName(read).repartition("window", "part", "salt").sortWithinPartitions("window", "part", "salt", "kind", "pid")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, known, own, found = None, WindowTitles(), None, set()
        out: tuple[list, list] = [], []

        def close() -> None:
            if found:
                out[0].append(own)
                out[1].append("|".join(sorted(found)))
                found.clear()

        def batch() -> pa.RecordBatch:
            rows = pa.RecordBatch.from_arrays([pa.array(out[0], kind), pa.array(out[1], pa.string())], ["pid", "titles"])
            out[0].clear(), out[1].clear()
            return rows

        kind = pa.int64()
        for b in batches:
            kind = b.schema.field("pid").type
            for asked, pid, text, *key in zip(*(b.column(c).to_pylist() for c in ("kind", "pid", "text", "window", "part", "salt"))):
                if key != at or pid != own:
                    close()
                    own = pid
                if key != at:
                    at, known = key, WindowTitles()
                if asked:
                    found |= known.found(text)
                else:
                    known.add(text)
            yield batch()
        close()
        yield batch()

    hits = rows.mapInArrow(run, f"pid {posts.schema['pid'].dataType.simpleString()}, titles string")
    if not plan.where("parts > 1").limit(1).count():
        return hits
    each = F.explode(F.split("titles", r"\|"))  # of several parts of a window's titles
    return hits.select("pid", each.alias("title")).groupBy("pid").agg(F.array_join(F.array_sort(F.collect_set("title")), "|").alias("titles"))


def evaluate(gold: DataFrame, system: DataFrame, compat: str = "labels") -> DataFrame:
    """One row of all figures. ``system`` is ``(sequence_id, event_number, titles ARRAY)``."""
    rows = matched_samples(gold.where("topics_id is not null"), system)
    inside = in_class(rows).withColumns({"classes": F.array_distinct(label_list("topics_id", compat)), "clusters": F.array(F.col("event_number").cast("string"))})
    cluster = entropy(inside, "clusters", "classes", "sequence_id").withColumnRenamed("entropy", "cluster_entropy")
    classes = entropy(inside, "classes", "clusters", "sequence_id").withColumnRenamed("entropy", "class_entropy")
    found = topic_scores(gold_titles(rows), label_titles(inside.select(F.col("event_number").alias("label"), "titles")))
    out = cluster.join(F.broadcast(classes)).withColumn("total_entropy", (F.col("cluster_entropy") + F.col("class_entropy")) / 2)
    return out.join(F.broadcast(found))
