"""The queries of the training-text problems, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillgraph.llm import canonical, mixing, near_duplicates, packing, quality, repeated_lines, similar_vectors, subjects, term_frequency
from rillgraph.plans.materialize import materialize

Query = Callable[[SparkSession, str], DataFrame]


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a post that its channel repeats in at least 8 posts."""
    _, places = repeated_lines.repeated_lines(_read(spark, sf_dir, "posts"))
    return places.select("pid", "line_no")


def p1_clean_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every post without its channel's repeated lines."""
    return repeated_lines.remove_repeated_lines(_read(spark, sf_dir, "posts")).select("pid", "tokens", "removed_lines")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of types and terms of tokens that are too rare or too common."""
    bitmaps = term_frequency.term_bitmaps(_read(spark, sf_dir, "posts"))
    return term_frequency.term_frequencies(bitmaps).where("verdict is not null").select("field_name", "term", "verdict")


def p2_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occurrences and posts of every value and term."""
    return term_frequency.term_frequencies(term_frequency.term_bitmaps(_read(spark, sf_dir, "posts")))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strings of posts and graphs that are not in consistent form."""
    found = canonical.not_consistent(_read(spark, sf_dir, "posts"), _read(spark, sf_dir, "kg_store"))
    return found.select("place", "rec_id", "pos", "slot")


def p3_consistent_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every post with its tokens in consistent form."""
    return canonical.with_consistent_array(_read(spark, sf_dir, "posts").select("pid", "tokens"), "tokens")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of posts that share at least 70 % of their tokens."""
    return near_duplicates.near_duplicate_pairs(_read(spark, sf_dir, "posts"))


def p4_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class, copies and number of links of every post with tokens."""
    return near_duplicates.near_duplicate_degrees(_read(spark, sf_dir, "posts"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The subjects of every post."""
    posts = _read(spark, sf_dir, "posts")
    model = subjects.fit_subjects(posts, _read(spark, sf_dir, "subject_labels"), _read(spark, sf_dir, "subject_lexicon"))
    return subjects.subjects_of_posts(posts, model).select("pid", "subject_idx")


def p5_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts and tokens of each subject."""
    posts = _read(spark, sf_dir, "posts")
    model = subjects.fit_subjects(posts, _read(spark, sf_dir, "subject_labels"), _read(spark, sf_dir, "subject_lexicon"))
    return subjects.composition(posts, subjects.subjects_of_posts(posts, model))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of vectors of cosine 0.9 or more, one among the five most similar of the other."""
    return similar_vectors.similar_pairs(similar_vectors.most_similar(_vectors(spark, sf_dir), least=0.9, bits=128), 0.9)


def p6_similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five most similar of all vectors for every vector whose id is divisible by 100, however far they are."""
    found = similar_vectors.most_similar(_vectors(spark, sf_dir), asked=F.col("vec_id") % 100 == 0)
    return found.withColumn("cosine", F.round("cosine", 6))


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_vectors.all_vectors(_read(spark, sf_dir, "subject_events"), _read(spark, sf_dir, "final_events"))


def p7_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in a container of every capacity."""
    return packing.pack(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "pack_specs"))


def p7_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How full the containers are."""
    specs = _read(spark, sf_dir, "pack_specs")
    return packing.packing_report(packing.pack(_read(spark, sf_dir, "documents"), specs), specs)


def p7_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each capacity: the documents placed, and what the packing must not have."""
    documents, specs = _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "pack_specs")
    faults = packing.packing_faults(materialize(packing.pack(documents, specs), "packed"), documents, specs)
    return faults.select("spec_id", "documents", "overfull", "split", "broken", (F.col("wasted") > 0.01).alias("wasteful"))


def p8_mix_characters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixture by characters in place of tokens, which SQL can count."""
    documents = _read(spark, sf_dir, "documents")
    sizes = documents.select("doc_id", "source", F.length("text").cast("long").alias("n_tokens"))
    mixed = mixing.mix(documents, _read(spark, sf_dir, "mix_targets"), sizes=sizes)
    return mixed.withColumn("finish_time", F.round("finish_time", 2))


def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of the mixture, in its order."""
    return mixing.mix(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "mix_targets"))


def p8_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and actual share of each source."""
    targets = _read(spark, sf_dir, "mix_targets")
    return mixing.mixture_report(mixing.mix(_read(spark, sf_dir, "documents"), targets), targets)


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that are a list, a table or junk."""
    return _quality(spark, sf_dir).where("not is_prose").select("doc_id")


def p9_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and ratios of every document."""
    common = quality.common_words_of(_read(spark, sf_dir, "common_words"))
    measured = quality.with_statistics(_read(spark, sf_dir, "documents"), common)
    return measured.select("doc_id", *(F.round(c, 6).alias(c) for c in quality.PLAIN))


def p9_judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All statistics of every document, its probability of being prose, and the verdict."""
    return _quality(spark, sf_dir)


def _quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.text_quality(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "common_words"))


QUERIES: dict[str, Query] = {
    f.__name__: f for f in (p1_found, p1_clean_posts, p2_found, p2_frequencies, p3_found, p3_consistent_posts, p4_found, p4_classes, p5_found, p5_composition, p6_found, p6_similar, p7_pack, p7_report, p7_checked, p8_mix, p8_mix_characters, p8_report, p9_found, p9_statistics, p9_judged)
}
