"""Problem 4: near-duplicate records with small edits, by Jaccard similarity of token sets.

Method: multiple global orders. Two sets of enough similarity share a token in their prefixes under every total order of
the tokens. Three orders are used: rarest first, ascending and descending fingerprint. The first generates candidates; its
keys carry the prefixes under the other two as 64-bit sets, and only pairs that can share a token in both of these, too, are
candidates. Sets are fetched after that; then the prefixes are intersected exactly, and the sets themselves.

Under the first order a prefix one token longer must share two tokens, two tokens longer three. So a token in at most
``light`` sets is a key alone, heavier tokens are keys only in twos, and twos expected in more than ``crowd`` sets only in
threes: posting lists stay short where tokens are independent, and no pair is lost. Where they are not (texts of one template),
lists longer than ``hot`` rows are met in blocks against blocks, each a group of its own. Keys are shuffled, never the sets; a
64-bit parity sketch beside each key drops pairs whose symmetric difference is surely too large.

Sets that are equal are one class, represented by its smallest ``pid``; only representatives are compared. Sets are kept as
sorted 64-bit fingerprints of tokens in consistent form. A post without tokens (null, empty, only null tokens) does not
count, nor does a null ``pid``; a second delivery counts once; an empty table gives no rows; other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rillgraph.llm.canonical import with_consistent_array
from rillgraph.llm.classes import SALTS, with_classes
from rillgraph.plans.materialize import broadcast_if_small, materialize

#: Bound of the table of token frequencies that every task gets: 16 bytes a row. Tokens beyond it count as rare.
FREQUENCY_ROWS = 1 << 18
_PAIRS_AT_ONCE = 1 << 20
_SAMPLED = 64  # one set in so many shows which keys are hot


def token_sets(posts: DataFrame, broadcast_rows: int = 200_000) -> DataFrame:
    """``(pid, rep, tokens)``: every post and its class; ``tokens``, the sorted fingerprints, in one row of each class and
    null in the others. Sets are written once and never shuffled."""
    rows = with_consistent_array(posts.where("pid is not null and size(tokens) > 0").select("pid", "tokens"), "tokens")
    marks = F.array_sort(F.array_distinct(F.transform(F.filter("tokens", lambda t: t.isNotNull()), lambda t: F.xxhash64(t))))
    rows = materialize(rows.select("pid", marks.alias("tokens"), F.monotonically_increasing_id().alias("row")), "near-sets").where("size(tokens) > 0")
    rows = rows.select("pid", "row", "tokens", F.xxhash64("tokens").alias("h1"), F.xxhash64(F.lit("second"), "tokens").alias("h2"))
    rows = with_classes(rows, ["pid", "row"], broadcast_rows)
    return rows.select("pid", F.col("first.pid").alias("rep"), F.when(F.col("first.row") == F.col("row"), F.col("tokens")).alias("tokens"))


def _frequencies(sets: DataFrame, rows: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Fingerprints and numbers of sets of the tokens in two sets or more, and the number for tokens not among them."""
    counts = materialize(sets.select(F.explode("tokens").alias("token")).groupBy("token").count().where("count > 1"), "near-frequencies")
    unknown = 1
    if counts.count() > rows:  # only counts of which all tokens fit are gathered, so no task sends more than that
        upto = counts.groupBy("count").agg(F.count("*").alias("n")).withColumn("upto", F.sum("n").over(Window.orderBy(F.desc("count"))))
        unknown = int(upto.where(F.col("upto") > rows).agg(F.max("count")).first()[0])
        counts = counts.where(F.col("count") > unknown)
    top = counts.toPandas()
    token, count = top["token"].to_numpy("int64"), top["count"].to_numpy("int64")
    order = np.argsort(token)
    return token[order], count[order], unknown


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = (a.astype("uint64") * np.uint64(0x9E3779B97F4A7C15)) ^ (b.astype("uint64") + np.uint64(0xC2B2AE3D27D4EB4F))
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ (x >> np.uint64(32))).view("int64")


def _ceil(share: Fraction, n):
    return -((-share.numerator * n) // share.denominator)


def _keys_of_size(tok: np.ndarray, df: np.ndarray, n: int, at_least: Fraction, total: int, light: int, crowd: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Keys of sets of ``n`` tokens, given rarest first: key, row, whether it serves against sets at least as large."""
    most, index = n - _ceil(at_least, n), n - _ceil(2 * at_least / (1 + at_least), n)
    p1, p2, p3 = (min(n, most + k) for k in (1, 2, 3))
    single = df <= light
    row, at = np.nonzero(single[:, :p1] & (df[:, :p1] > 1))
    yield tok[row, at], row, at < index + 1
    i, j = np.triu_indices(p2, 1)
    heavy = ~single[:, i] & ~single[:, j]
    crowded = df[:, i] * df[:, j] > crowd * total
    row, at = np.nonzero(heavy & ~crowded)
    yield _mix(tok[row, i[at]], tok[row, j[at]]), row, j[at] < index + 2
    row, at = np.nonzero(heavy & crowded)
    for last in range(2, p3):
        use = j[at] < last
        r, a = row[use], at[use]
        yield _mix(_mix(tok[r, i[a]], tok[r, j[a]]), tok[r, last]), r, np.full(len(r), last < index + 3)


KEYS = "key long, rep long, n int, small boolean, sketch long, up long, down long"


def _key_batches(token: np.ndarray, count: np.ndarray, unknown: int, at_least: Fraction, total: int, light: int, crowd: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("tokens")
            n = lists.value_lengths().to_numpy(zero_copy_only=False).astype("int64")
            rep, flat = b.column("rep").to_numpy(), lists.flatten().to_numpy(zero_copy_only=False).astype("int64")
            if not len(flat):
                continue
            of = np.repeat(np.arange(len(n)), n)
            at = np.minimum(np.searchsorted(token, flat), max(len(token) - 1, 0))
            df = np.where(token[at] == flat, count[at], unknown) if len(token) else np.full(len(flat), unknown)
            sketch = np.bitwise_xor.reduceat(np.uint64(1) << (flat.view("uint64") >> np.uint64(58)), np.cumsum(n) - n).view("int64")
            start = np.cumsum(n) - n
            bit = np.uint64(1) << ((flat.view("uint64") * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(58))
            place, reach = np.arange(len(flat)) - np.repeat(start, n), np.repeat(n - _ceil(at_least, n) + 1, n)
            up, down = (np.bitwise_or.reduceat(np.where(inside, bit, np.uint64(0)), start).view("int64") for inside in (place < reach, place >= np.repeat(n, n) - reach))
            order = np.lexsort((flat, df, of))
            flat, df = flat[order], df[order]
            for size in np.unique(n):
                rows = np.nonzero(n == size)[0]
                where = start[rows][:, None] + np.arange(size)
                for key, row, small in _keys_of_size(flat[where], df[where], int(size), at_least, total, light, crowd):
                    r = rows[row]
                    if len(r):
                        yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(rep[r]), pa.array(n[r].astype("int32")), pa.array(small), pa.array(sketch[r]), pa.array(up[r]), pa.array(down[r])], ["key", "rep", "n", "small", "sketch", "up", "down"])

    return run


def _meeting(cols: list[np.ndarray], at_least: Fraction) -> Iterator[pa.RecordBatch]:
    """Pairs of rows under one key that pass the filters of sizes, of the other two orders, and of sketches; each pair once for
    many keys. Rows are sorted by key."""
    key, rep, n, small, sketch, up, down = cols
    if not len(key):
        return
    group = np.cumsum(np.r_[False, key[1:] != key[:-1]])
    order = np.lexsort((n, group))
    rep, small, sketch, up, down, n = rep[order], small[order], sketch[order], up[order], down[order], n[order].astype("int64")
    widest = int(n.max()) + 1
    at = group[order] * widest + n  # by group, then size: a row is met with later rows that are not too large for it
    reach = group[order] * widest + np.minimum(n * at_least.denominator // at_least.numerator, widest - 1)
    later = np.where(small, np.searchsorted(at, reach, "right") - np.arange(len(at)) - 1, 0)
    i = np.nonzero(later > 0)[0]
    done = np.r_[0, np.cumsum(later[i])]
    lo = 0
    while lo < len(i):
        hi = max(lo + 1, int(np.searchsorted(done, done[lo] + _PAIRS_AT_ONCE, "right")) - 1)
        part = i[lo:hi]
        a = np.repeat(part, later[part])
        b = a + 1 + np.arange(len(a)) - np.repeat(done[lo:hi] - done[lo], later[part])
        lo = hi
        ok = ((up[a] & up[b]) != 0) & ((down[a] & down[b]) != 0)
        a, b = a[ok], b[ok]
        both = n[a] + n[b]
        ok = np.bitwise_count((sketch[a] ^ sketch[b]).view("uint64")) <= both - 2 * _ceil(at_least / (1 + at_least), both)
        a, b = a[ok], b[ok]
        ok = (rep[a] != rep[b]) & (small[b] | (n[a] < n[b]))
        if ok.any():
            a, b = rep[a[ok]], rep[b[ok]]
            a, b = np.minimum(a, b), np.maximum(a, b)
            order = np.lexsort((b, a))
            a, b = a[order], b[order]
            new = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]
            yield pa.RecordBatch.from_arrays([pa.array(a[new]), pa.array(b[new])], ["rep_a", "rep_b"])


def _meet_batches(at_least: Fraction):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        for b in batches:
            if not b.num_rows:
                continue
            cols = [b.column(k).to_numpy(zero_copy_only=False) for k in range(7)]
            if held and held[0][0][0] == cols[0][-1]:  # still one key
                held.append(cols)
                continue
            cut = int(np.searchsorted(cols[0], cols[0][-1]))
            whole = [np.concatenate(x) for x in zip(*held, [c[:cut] for c in cols])]
            yield from _meeting(whole, at_least)
            held = [[c[cut:].copy() for c in cols]]
        if held:
            yield from _meeting([np.concatenate(x) for x in zip(*held)], at_least)

    return run


def _in_blocks(keys: DataFrame, some: DataFrame, share: int, hot: int, broadcast_rows: int) -> DataFrame:
    """``keys`` with those of more than about ``hot`` rows, by the counts in ``some`` (one in ``share`` of the sets), replaced by
    one key for every two blocks of their rows; which keys are split changes no pair."""
    counts = some.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") >= max(2, hot // share))
    split = materialize(counts.select("key", F.ceil(F.col("n") * share / hot).cast("int").alias("blocks")), "near-hot")
    if split.isEmpty():
        return keys
    split, _ = broadcast_if_small(split, broadcast_rows)
    rows = keys.join(split, "key", "left")
    own = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    each = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.xxhash64("key", F.least(own, j), F.greatest(own, j)))
    return rows.select(F.explode(F.when(F.col("blocks").isNull(), F.array("key")).otherwise(each)).alias("key"), *(c for c in keys.columns if c != "key"))


def similar_classes(sets: DataFrame, threshold: float = 0.7, light: int = 1000, crowd: int = 400, frequency_rows: int = FREQUENCY_ROWS, hot: int = 20_000, broadcast_rows: int = 200_000) -> DataFrame:
    """``(rep_a, rep_b, shared, size_a, size_b)``: every two representatives of at least that similarity, smaller first.

    ``sets`` is a result of :func:`token_sets`. ``frequency_rows`` bounds the table of frequencies on the driver;
    it only decides the order and the kind of keys, so any bound gives the same pairs.
    """
    at_least = Fraction(threshold).limit_denominator(1000)
    if not Fraction(2, 3) < at_least <= 1:  # else two sets can be similar that share fewer tokens than a key holds
        raise ValueError("threshold must be above 2/3 and at most 1")
    reps = sets.where("tokens is not null").select("rep", "tokens")
    token, count, unknown = _frequencies(reps, frequency_rows)
    total = max(1, reps.count())
    keyed = _key_batches(token, count, unknown, at_least, total, light, crowd)
    some = reps.where(F.pmod(F.xxhash64("rep"), F.lit(_SAMPLED)) == 0).mapInArrow(keyed, KEYS)
    keys = _in_blocks(reps.mapInArrow(keyed, KEYS), some, _SAMPLED, hot, broadcast_rows)
    pairs = keys.repartition("key").sortWithinPartitions("key").mapInArrow(_meet_batches(at_least), "rep_a long, rep_b long")
    pairs, _ = broadcast_if_small(materialize(pairs.distinct(), "near-candidates"), broadcast_rows)
    a = reps.select(F.col("rep").alias("rep_a"), F.col("tokens").alias("a"))
    b = reps.select(F.col("rep").alias("rep_b"), F.col("tokens").alias("b"))
    both = a.join(pairs, "rep_a")
    both = b.join(broadcast_if_small(materialize(both, "near-half"), broadcast_rows // 8)[0], "rep_b")
    num, den = at_least.numerator, at_least.denominator
    both = both.withColumns({"size_a": F.size("a"), "size_b": F.size("b")})
    both = both.withColumn("least", F.ceil(F.expr(f"(size_a + size_b) * {num} / {num + den}") - 1e-9).cast("int"))
    both = both.withColumns({"pa": F.expr("size_a - least + 1"), "pb": F.expr("size_b - least + 1")}).where("pa > 0 and pb > 0")
    both = both.where("arrays_overlap(slice(a, 1, pa), slice(b, 1, pb)) and arrays_overlap(slice(a, -pa, pa), slice(b, -pb, pb))")
    both = both.withColumn("shared", F.size(F.array_intersect("a", "b"))).where(f"shared * {den} >= (size_a + size_b - shared) * {num}")
    return both.select("rep_a", "rep_b", "shared", "size_a", "size_b")


def near_duplicate_links(posts: DataFrame, threshold: float = 0.7, **options) -> tuple[DataFrame, DataFrame]:
    """Links between representatives, as :func:`similar_classes` gives them, and ``(pid, rep)`` of every post."""
    sets = token_sets(posts, options.get("broadcast_rows", 200_000))
    return similar_classes(sets, threshold, **options), sets.select("pid", "rep").distinct()


def near_duplicate_pairs(posts: DataFrame, threshold: float = 0.7, copies: int = 16, **options) -> DataFrame:
    """``(pid_a, pid_b)``, smaller first: the posts of at least that similarity.

    Of equal sets, each post is given with the ``copies`` smallest of its class (all pairs, where there are no more); of two
    similar classes, the ``copies`` smallest of one with those of the other. A class of a third of all posts so gives a
    result in proportion to it, and no link between different texts is lost.
    """
    links, members = near_duplicate_links(posts, threshold, **options)
    sizes = members.groupBy("rep").agg(F.count("*").alias("size")).where("size > 1").select("rep")
    known, _ = broadcast_if_small(materialize(sizes, "near-shared"), options.get("broadcast_rows", 200_000))
    equal = materialize(members.join(known, "rep").withColumn("salt", F.pmod(F.xxhash64("pid"), F.lit(SALTS)).cast("int")), "near-copies")
    first = equal
    for by in (["rep", "salt"], ["rep"]):
        first = first.withColumn("nth", F.row_number().over(Window.partitionBy(*by).orderBy("pid"))).where(F.col("nth") <= copies)
    first, small = broadcast_if_small(materialize(first.select("rep", F.col("pid").alias("pid_a")), "near-first"), options.get("broadcast_rows", 200_000))
    salted = first if small else first.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    inside = equal.join(salted, ["rep"] if small else ["rep", "salt"]).where("pid_a < pid").select("pid_a", F.col("pid").alias("pid_b"))
    across = links.select("rep_a", "rep_b")
    for side in ("a", "b"):
        across = across.join(first.select(F.col("rep").alias(f"rep_{side}"), F.col("pid_a").alias(f"pid_{side}")), f"rep_{side}", "left")
        across = across.withColumn(f"pid_{side}", F.coalesce(f"pid_{side}", f"rep_{side}"))
    return inside.unionByName(across.select(F.least("pid_a", "pid_b").alias("pid_a"), F.greatest("pid_a", "pid_b").alias("pid_b")))


def near_duplicate_degrees(posts: DataFrame, threshold: float = 0.7, **options) -> DataFrame:
    """``(pid, class_id, n_copies, n_links)`` of every post with tokens: its class, the posts in it, and how many other
    classes are similar to it."""
    links, members = near_duplicate_links(posts, threshold, **options)
    links = materialize(links, "near-links")
    ends = links.select(F.explode(F.array("rep_a", "rep_b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("n_links"))
    sizes = members.groupBy("rep").agg(F.count("*").alias("n_copies"))
    known = sizes.join(ends, "rep", "left").select("rep", "n_copies", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    return members.join(known, "rep").select("pid", F.col("rep").alias("class_id"), "n_copies", "n_links")
