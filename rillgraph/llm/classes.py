"""Classes of equal rows: a class may hold a third of all rows, so nothing here gathers a class in one task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillgraph.plans.materialize import broadcast_if_small, materialize

SALTS = 32
#: Repeating keys that a task remembers, about.
REPEATED_KEPT = 100_000


def with_classes(rows: DataFrame, order: list[str], broadcast_rows: int = 200_000) -> DataFrame:
    """``rows`` (written, with the class in ``h1`` and ``h2``) with ``first``, the least ``order`` of the row's class as a
    struct, and ``alone``, whether the class has one row.

    Classes are counted by partial aggregates of two hashes; only classes of two rows and more join back, by broadcast up
    to ``broadcast_rows`` of them, else by a salted join.
    """
    known = rows.groupBy("h1", "h2").agg(F.min(F.struct(*order)).alias("first"), F.count("*").alias("__n")).where("__n > 1").drop("__n")
    known, small = broadcast_if_small(materialize(known, "classes"), broadcast_rows)
    on = ["h1", "h2"]
    if not small:
        on.append("__salt")
        known = known.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows = rows.withColumn("__salt", F.pmod(F.xxhash64(*order), F.lit(SALTS)).cast("int"))
    joined = rows.join(known, on, "left").withColumn("alone", F.col("first").isNull())
    return joined.withColumn("first", F.coalesce("first", F.struct(*order))).drop("__salt")


def locally_distinct(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` with most repeats of ``key`` dropped where they are read, before any shuffle: those within one batch, and of
    keys that repeated before in the task. A later exact step drops the rest. Which of equal keys stays is not defined."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repeated = np.empty(0, "int64")
        for b in batches:
            keys = b.column(key).to_numpy(zero_copy_only=False)
            unique, first = np.unique(keys, return_index=True)
            if len(unique) == len(keys) and not len(repeated):
                yield b
                continue
            keep = first[~np.isin(unique, repeated)]
            if len(repeated) < REPEATED_KEPT:
                again = unique[np.bincount(np.searchsorted(unique, keys)) > 1]
                repeated = np.union1d(repeated, again)
            yield b if len(keep) == len(keys) else b.take(pa.array(np.sort(keep)))

    return rows.mapInArrow(run, rows.schema)
