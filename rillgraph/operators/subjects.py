"""Subject scores of posts, their threshold and its calibration."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rillgraph.config import SUBJECTS, UNLABELLED_POSTS
from rillgraph.functions.text import label_key
from rillgraph.operators.lexicon import default_lexicon

# What labels call the subjects. A label is first looked up as it is, then without spaces.
LABEL_SUBJECTS = {
    "social": "social",
    "اجتماعی": "social",
    "society": "social",
    "economic": "economic",
    "economy": "economic",
    "اقتصادی": "economic",
    "business": "economic",
    "international": "international",
    "world": "international",
    "بین الملل": "international",
    "خارجی": "international",
    "political": "political",
    "politics": "political",
    "سیاسی": "political",
    "science technology": "science_tech",
    "science": "science_tech",
    "technology": "science_tech",
    "tech": "science_tech",
    "علمی": "science_tech",
    "علم و فناوری": "science_tech",
    "علمی و فناوری": "science_tech",
    "science-technology": "science_tech",
    "it": "science_tech",
    "digital": "science_tech",
    "cultural art": "cultural_art",
    "culture": "cultural_art",
    "art": "cultural_art",
    "arts": "cultural_art",
    "فرهنگی": "cultural_art",
    "هنری": "cultural_art",
    "فرهنگی و هنری": "cultural_art",
    "cultural-art": "cultural_art",
    "culture art": "cultural_art",
    "literature": "cultural_art",
    "sport": "sport",
    "sports": "sport",
    "ورزشی": "sport",
    "ورزش": "sport",
    "medical": "medical",
    "health": "medical",
    "پزشکی": "medical",
    "سلامت": "medical",
    "medicine": "medical",
}
# Not among the known names, added here: the subject's own name, as the test data spell it.
LABEL_SUBJECTS["science tech"] = "science_tech"


class SubjectClassifier(Protocol):
    """Gives ``(pid, subject_idx, score FLOAT)`` for posts; subjects without a score may be left out."""

    def scores(self, posts: DataFrame) -> DataFrame: ...


def canonical_subject(label: Column) -> Column:
    """The subject that a label names, else null."""
    pairs = lambda m: F.create_map(*(F.lit(x) for kv in m.items() for x in kv))
    key = label_key(label)
    tight = {k.replace(" ", ""): v for k, v in reversed(LABEL_SUBJECTS.items())}
    return F.coalesce(F.element_at(pairs(LABEL_SUBJECTS), key), F.element_at(pairs(tight), F.translate(key, " ", "")))


class KeywordClassifier:
    """Share of a post's lexicon words that belong to each subject. The lexicon ``(subject_idx, term)`` is injected and
    broadcast; it must stay below ``max_rows``."""

    def __init__(self, lexicon: DataFrame, max_rows: int = 1_000_000) -> None:
        self.lexicon = lexicon.select("subject_idx", "term").dropna().distinct()
        if self.lexicon.limit(max_rows + 1).count() > max_rows:
            raise ValueError(f"a lexicon of more than {max_rows} rows")

    def scores(self, posts: DataFrame) -> DataFrame:
        words = posts.select("pid", F.explode(F.array_distinct("tokens")).alias("term"))
        hits = words.join(F.broadcast(self.lexicon), "term").groupBy("pid", "subject_idx").agg(F.count("*").alias("hits"))
        share = F.col("hits").cast("float") / F.sum("hits").over(Window.partitionBy("pid")).cast("float")
        return hits.select("pid", "subject_idx", share.cast("float").alias("score"))


def logits_to_scores(logits: DataFrame, label_subjects: dict[int, int], mode: str = "softmax") -> DataFrame:
    """Scores of a model head: softmax or sigmoid of ``(pid, label, logit)``, the best label of each subject."""
    if mode == "softmax":
        per = Window.partitionBy("pid")
        e = F.exp(F.col("logit") - F.max("logit").over(per))
        scored = logits.withColumn("score", e).withColumn("score", F.col("score") / F.sum("score").over(per))
    elif mode == "sigmoid":
        scored = logits.withColumn("score", 1 / (1 + F.exp(-F.col("logit"))))
    else:
        raise ValueError(f"unknown score mode: {mode!r}")
    subject = F.element_at(F.create_map(*(F.lit(x) for kv in label_subjects.items() for x in kv)), F.col("label"))
    return scored.withColumn("subject_idx", subject).where("subject_idx is not null").groupBy("pid", "subject_idx").agg(F.max("score").cast("float").alias("score"))


def build_classifier(backend: str, lexicon: DataFrame | None = None, model: SubjectClassifier | None = None) -> SubjectClassifier:
    if backend == "keyword":
        return KeywordClassifier(lexicon if lexicon is not None else default_lexicon(SparkSession.active()))
    if backend == "model" and model is not None:
        return model
    raise ValueError(f"unknown subject backend: {backend!r}")


def assign_subjects(scores: DataFrame, threshold: float) -> DataFrame:
    """``(pid, subject_idx)`` of every score at or above the threshold, compared as FLOAT."""
    return scores.where(F.col("score") >= F.lit(threshold).cast("float")).select("pid", "subject_idx")


def labelled_posts(posts: DataFrame, assigned: DataFrame) -> DataFrame:
    """The posts with at least one subject."""
    return posts.join(assigned, "pid", "left_semi")


def calibrated_threshold(posts: DataFrame, scores: DataFrame, target: int = UNLABELLED_POSTS) -> DataFrame:
    """``(threshold)``: the value that leaves ``target`` posts without a subject.

    Order statistics come from the counts of distinct best scores, so no row order of all posts is needed. With the
    target at 0 the smallest best score; between two order statistics their middle; where they are equal just above them.
    """
    best = posts.select("pid").join(scores.groupBy("pid").agg(F.max("score").alias("best")), "pid", "left").select(F.coalesce("best", F.lit(0.0).cast("float")).cast("double").alias("best"))
    counts = best.groupBy("best").agg(F.count("*").alias("n"))
    upto = Window.orderBy("best").rowsBetween(Window.unboundedPreceding, 0)
    ranks = counts.withColumn("upto", F.sum("n").over(upto)).withColumn("total", F.sum("n").over(Window.partitionBy()))
    ranks = ranks.withColumn("k", F.least(F.greatest(F.lit(target), F.lit(0)), F.col("total")))
    found = ranks.agg(F.max("k").alias("k"), F.min("best").alias("least"), F.min(F.when(F.col("upto") >= F.col("k"), F.col("best"))).alias("lo"), F.min(F.when(F.col("upto") > F.col("k"), F.col("best"))).alias("hi"))
    hi = F.coalesce("hi", F.col("lo") + 1)
    between = F.when(hi > F.col("lo"), (F.col("lo") + hi) / 2).otherwise(F.col("lo") + 1e-9)
    return found.select(F.when(F.col("k") == 0, F.col("least")).otherwise(between).alias("threshold"))


def subject_counts(posts: DataFrame, assigned: DataFrame) -> DataFrame:
    """Posts of each of the eight subjects, 0 included, and of none (``subject_idx`` -1)."""
    names = posts.sparkSession.createDataFrame([*enumerate(SUBJECTS), (-1, "(unlabelled)")], "subject_idx int, subject string")
    some = assigned.groupBy("subject_idx").agg(F.count("*").alias("n"))
    none = posts.join(assigned, "pid", "left_anti").agg(F.count("*").alias("n")).select(F.lit(-1).alias("subject_idx"), "n")
    return names.join(some.unionByName(none), "subject_idx", "left").select("subject_idx", "subject", F.coalesce("n", F.lit(0)).alias("n_posts"))
