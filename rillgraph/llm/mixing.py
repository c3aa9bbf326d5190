"""Problem 8: a mixture in which each source has its target share of the tokens, small sources repeated a capped number of
times.

Method: weighted fair queueing. Each source's documents are shuffled (by hash); every document, and every repeat of it, has
a virtual finish time, the tokens of its source up to its end divided by the source's target weight; all are sorted by that
time and cut at the total budget. Running sums are counted in two levels, per bucket of hash or time and then over the
small table of buckets, so a source with a third of all rows is spread over as many groups as there are buckets; their number
grows with the rows.

The budget defaults to the largest total at which every source can keep its share within its repeats. With a larger
``total_tokens`` sources run out and the actual shares show it. Shares are scaled to sum to 1. Sources that are not listed,
or listed with a null, zero or negative share or fewer than one repeat, are not wanted; a source listed twice counts once
(its largest share). Listed sources without tokens cannot contribute and do not limit the budget. Documents without tokens
(null and empty texts) are left out. Times are rounded to 6 places, so that the
order of additions decides nothing; ties go by source, id and repeat. No documents or targets give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillgraph.llm.tokenizer import DEFAULT_TOKENIZER, with_token_counts
from rillgraph.plans.materialize import materialize

#: Rows of a bucket, about, where there are more than the least number of buckets.
A_BUCKET = 20_000
MAX_SOURCES = 1000


def _targets(targets: DataFrame) -> DataFrame:
    rows = targets.where("source is not null and target_share > 0 and max_repeats >= 1")
    rows = rows.groupBy("source").agg(F.max("target_share").alias("share"), F.max("max_repeats").alias("repeats"))
    return rows.withColumn("share", F.col("share") / F.sum("share").over(Window.partitionBy()))


def _running(df: DataFrame, by: list[str], bucket: str, order: list[str], value: str, to: str) -> DataFrame:
    """``to``: the sum of ``value`` up to and with each row, in the order of ``bucket`` and ``order``, for each ``by``."""
    parts = df.groupBy(*by, bucket).agg(F.sum(value).alias("__n"))
    before = Window.partitionBy(*by).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select(*by, bucket, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    upto = Window.partitionBy(*by, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = df.withColumn("__sum", F.sum(value).over(upto)).join(offsets, [*by, bucket])
    return rows.withColumn(to, F.col("__sum") + F.col("__before")).drop("__sum", "__before")


def _shuffled(seed: int) -> Column:
    """A number of 52 bits that stands for the place of a document in its source."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}-"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), 1, 13), 16, 10).cast("long")


def mix(documents: DataFrame, targets: DataFrame, total_tokens: int | None = None, seed: int = 0, tokenizer: str = DEFAULT_TOKENIZER, sizes: DataFrame | None = None) -> DataFrame:
    """``(source, doc_id, repeat_no, n_tokens, finish_time, total)``, in the order of the mixture; ``total`` is the number of
    tokens up to and with the row. ``sizes``, ``(doc_id, source, n_tokens)``, stands for the texts where they are sized already."""
    wanted = _targets(targets)
    if wanted.limit(MAX_SOURCES + 1).count() > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    if sizes is None:
        texts = documents.select("doc_id", "source", "text").join(F.broadcast(wanted.select("source")), "source", "left_semi")
        sizes = with_token_counts(texts, tokenizer, ("doc_id", "source"))
    else:
        sizes = sizes.join(F.broadcast(wanted.select("source")), "source", "left_semi")
    sized = materialize(sizes.where("n_tokens > 0"), "mixing-sizes")
    sums = sized.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.max("n_tokens").alias("longest"), F.count("*").alias("n"))
    known = sums.join(F.broadcast(wanted), "source").select("source", "share", "repeats", "tokens", "longest", "n").collect()
    known_rows = sized.sparkSession.createDataFrame([tuple(r)[:4] for r in known], "source string, share double, repeats int, tokens long")
    budget = min((r.repeats * r.tokens / r.share for r in known), default=0.0) if total_tokens is None else float(total_tokens)
    last = _time_of(known, budget) + max((r.longest / r.share for r in known), default=1.0)
    buckets = 1 << max(8, (sum(r.n * r.repeats for r in known) // A_BUCKET).bit_length())
    rows = sized.withColumn("key", _shuffled(seed)).withColumn("bucket", F.floor(F.col("key") * (buckets / 2.0**52)))
    rows = _running(rows, ["source"], "bucket", ["key", "doc_id"], "n_tokens", "upto").join(F.broadcast(known_rows), "source")
    rows = rows.withColumn("repeat_no", F.explode(F.sequence(F.lit(0), F.col("repeats") - 1)))
    rows = rows.withColumn("finish_time", F.round(F.expr("(repeat_no * tokens + upto) / share"), 6)).where(F.col("finish_time") <= last)
    at = F.least(F.floor(F.col("finish_time") / last * buckets), F.lit(buckets - 1))
    rows = rows.select("source", "doc_id", "repeat_no", "n_tokens", "finish_time", at.alias("bucket"))
    rows = _running(rows, [], "bucket", ["finish_time", "source", "doc_id", "repeat_no"], "n_tokens", "total").where(F.col("total") <= budget)
    return rows.drop("bucket").orderBy("finish_time", "source", "doc_id", "repeat_no")


def _time_of(known: list, budget: float) -> float:
    """The virtual time at which ``budget`` tokens are through, sources standing still once their repeats are used up."""
    time, through, share = 0.0, 0.0, sum(r.share for r in known)
    for end, s in sorted((r.repeats * r.tokens / r.share, r.share) for r in known):
        if through + share * (end - time) >= budget:
            return time + (budget - through) / share
        through += share * (end - time)
        time, share = end, share - s
    return time


def mixture_report(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """``(source, target_share, actual_share, tokens, documents, most_repeats)`` of every wanted source."""
    sums = mixed.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count_distinct("doc_id").alias("documents"), (F.max("repeat_no") + 1).alias("most_repeats"))
    rows = _targets(targets).join(sums, "source", "left").na.fill(0, ["tokens", "documents", "most_repeats"])
    actual = F.coalesce(F.col("tokens") / F.sum("tokens").over(Window.partitionBy()), F.lit(0.0))
    return rows.select("source", F.col("share").alias("target_share"), actual.alias("actual_share"), "tokens", "documents", "most_repeats")
