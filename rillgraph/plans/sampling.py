"""Bounded samples that are the same at every number of tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hash_sample(rows: DataFrame, key: str, most: int, total: int | None = None) -> DataFrame:
    """At most ``most`` of ``rows``, those with the smallest hashes of ``key``.

    Rows whose hash is beyond the share wanted go where they are read, so what is gathered is about ``most`` rows in all
    and not ``most`` rows of every task. ``total`` is the number of rows, counted where it is not given. Where the share
    gives a few rows less than ``most``, those are the sample.
    """
    total = rows.count() if total is None else total
    if total > most:
        low = -(2**63) + int(2**64 * most / total)
        rows = rows.where(F.xxhash64(key) < F.lit(low).cast("long"))
    return rows.orderBy(F.xxhash64(key), key).limit(most)
