"""Vector expressions over ``ARRAY<FLOAT>`` and the hashing embedder.

Sums are taken in double precision. Vectors of different lengths, or with null members, give null.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def l2_normalise(a: Column) -> Column:
    """The vector at unit length; a zero vector stays zero."""
    length = norm(a)
    return F.when(length > 0, F.transform(a, lambda x: (x / length).cast("float"))).otherwise(a)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 where one of the two is zero."""
    both = norm(a) * norm(b)
    return F.when(both > 0, dot(a, b) / both).otherwise(F.when(both.isNotNull(), 0.0))


def euclidean(a: Column, b: Column) -> Column:
    squares = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, x: s + x))


def mean_vectors(df: DataFrame, by: list[str], vector: str = "vector", to: str = "vector") -> DataFrame:
    """The plain mean vector of each group: one partial aggregate per group and place."""
    places = df.select(*by, F.posexplode(vector).alias("__at", "__x")).groupBy(*by, "__at").agg(F.avg("__x").alias("__x"))
    whole = places.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("__at", "__x"))).alias("__v"))
    return whole.select(*by, F.transform("__v", lambda s: s["__x"].cast("float")).alias(to))


# -- the hashing embedder ------------------------------------------------------------------------------------------

NGRAMS = (2, 4)


@lru_cache(1 << 16)
def _bucket(gram: str) -> tuple[int, int]:
    h = hashlib.blake2b(gram.encode(), digest_size=8).digest()
    return int.from_bytes(h[:4], "little"), 1 if h[4] & 1 else -1


def hashed_vector(phrase: str, dim: int = 512, ngrams: tuple[int, int] = NGRAMS) -> np.ndarray:
    """Signed counts of the phrase's character n-grams, hashed into ``dim`` places. The empty phrase gives zeros."""
    v = np.zeros(dim, "float32")
    if phrase:
        padded = f" {phrase} "
        for n in range(ngrams[0], ngrams[1] + 1):
            for i in range(len(padded) - n + 1):
                at, sign = _bucket(padded[i : i + n])
                v[at % dim] += sign
    return v


def hashing_embedder(dim: int = 512, ngrams: tuple[int, int] = NGRAMS):
    """A column function from phrases to raw vectors. Each distinct phrase of a batch is hashed once."""

    @arrow_udf(T.ArrayType(T.FloatType()))
    def embed(phrases: pa.Array) -> pa.Array:
        coded = phrases.dictionary_encode()
        texts = coded.dictionary.to_pylist()
        table = np.stack([hashed_vector(t or "", dim, ngrams) for t in texts]) if texts else np.zeros((0, dim), "float32")
        at = coded.indices.fill_null(len(texts)).to_numpy(zero_copy_only=False)
        rows = np.vstack([table, np.zeros((1, dim), "float32")])[at]
        return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype="int32") * dim), pa.array(rows.reshape(-1)))

    return embed


def masked_mean(hidden: Column, mask: Column) -> Column:
    """The mean of the vectors in ``hidden`` whose ``mask`` is 1 (weights are allowed); zeros where nothing is masked in."""
    weighted = F.zip_with(hidden, mask, lambda v, m: F.transform(v, lambda x: x.cast("double") * m))
    zero = F.transform(F.element_at(hidden, 1), lambda x: F.lit(0.0))
    total = F.aggregate(weighted, zero, lambda s, v: F.zip_with(s, v, lambda a, b: a + b))
    weight = F.greatest(F.aggregate(mask, F.lit(0.0), lambda s, m: s + m), F.lit(1e-9))
    return F.transform(total, lambda x: (x / weight).cast("float"))


def build_embedder(backend: str = "hashing", dim: int = 512, encode: Callable[[list[str]], np.ndarray] | None = None, batch: int = 64) -> Callable[[Column], Column]:
    """A column function from phrases to raw vectors: the hashing one, or an injected ``encode`` of lists of phrases, called
    with the distinct phrases of an Arrow batch, ``batch`` at a time."""
    if backend == "hashing":
        return hashing_embedder(dim)
    if backend != "model" or encode is None:
        raise ValueError(f"unknown embedding backend: {backend!r}")

    @arrow_udf(T.ArrayType(T.FloatType()))
    def embed(phrases: pa.Array) -> pa.Array:
        coded = phrases.fill_null("").dictionary_encode()
        texts = coded.dictionary.to_pylist()
        rows = [np.asarray(v, "float32") for i in range(0, len(texts), batch) for v in encode(texts[i : i + batch])]
        return pa.array([rows[i] for i in coded.indices.to_pylist()], pa.list_(pa.float32()))

    return embed


def md5_buckets(df: DataFrame, phrase: str, dim: int = 64, n: int = 3) -> DataFrame:
    """``(phrase, bucket, weight)``, zero weights left out: the hashing embedder with md5 and one length of n-gram, in the JVM."""
    padded = F.concat(F.lit(" "), F.col(phrase), F.lit(" "))
    grams = F.when(F.length(padded) >= n, F.transform(F.sequence(F.lit(1), F.length(padded) - n + 1), lambda i: F.substring(padded, i, F.lit(n))))
    rows = df.select(phrase, F.explode(grams).alias("g"))
    number = F.conv(F.substring(F.md5("g"), 1, 8), 16, 10).cast("long")
    sign = F.when(F.conv(F.substring(F.md5("g"), 9, 1), 16, 10).cast("int") % 2 == 1, 1).otherwise(-1)
    return rows.groupBy(phrase, (number % dim).alias("bucket")).agg(F.sum(sign).alias("weight")).where("weight <> 0")


def md5_vectors(phrases: DataFrame, phrase: str, dim: int = 64, n: int = 3) -> DataFrame:
    """``(phrase, vector)``: :func:`md5_buckets` with its zeros; a phrase without n-grams has zeros only."""
    of = md5_buckets(phrases, phrase, dim, n).groupBy(phrase).agg(F.map_from_entries(F.collect_list(F.struct("bucket", "weight"))).alias("__of"))
    dense = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(dim - 1).cast("long")), lambda k: F.coalesce(F.element_at("__of", k), F.lit(0)).cast("float"))
    return phrases.join(of, phrase, "left").select(phrase, dense.alias("vector"))
