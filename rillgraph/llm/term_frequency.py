"""Problem 2: how often every distinct value or term occurs, and in how many records.

Method: vertical layout. Record numbers are cut into chunks of ``CHUNK`` ids. Per term and chunk there is one compressed
bitmap of the records that hold the term, and beside it a counter for every record that holds it more than once. Bitmaps
are built where the posts are read, so posts are never shuffled; those of one term and chunk from different tasks merge by
union (a record that both hold is one record, with one counter); document frequency is their cardinality.

A bitmap is the sorted 16-bit places of its records, or all of the chunk's bits where that is shorter; so no bitmap is larger
than ``CHUNK / 8`` bytes and no term, however common, makes a hot task: bitmaps meet by term and span of ``SPAN`` chunks, and
only one row per term and span goes on. The number of spans grows with the range of ids.

A second delivery of a post (same ``pid``) counts once, by union: it must hold the same tokens, else the larger counter of a
term counts. A null ``pid`` is no record. Null arrays and null members count nowhere; the empty string is a term like any
other; an empty table gives no rows. Other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillgraph.llm.canonical import with_consistent_array
from rillgraph.plans.materialize import materialize

CHUNK = 1 << 16
SPAN = 64
#: The field under which posts with at least one token are counted, with the empty term.
ALL_POSTS = "posts"
BITMAPS = "field_name string, term string, chunk long, records binary, more binary"
_DENSE = CHUNK // 16  # records from which all bits are shorter than places
_AT_ONCE = 1 << 20  # occurrences of which a task builds bitmaps together, about
_MORE = np.dtype([("place", "<u2"), ("extra", "<u4")])


def _binary(lengths: np.ndarray, data: bytes) -> pa.Array:
    offsets = np.r_[0, np.cumsum(lengths)].astype("int32")
    return pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def pack_bitmaps(group: np.ndarray, place: np.ndarray, count: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """The bitmap and the counters of every group. Rows are sorted by group and place, without repeats."""
    size = np.bincount(group)
    first = np.cumsum(size) - size
    dense = np.flatnonzero(size >= _DENSE)
    if len(dense):
        parts = np.split(place.astype("<u2"), first[1:])
        for g in dense:
            bits = np.zeros(CHUNK, bool)
            bits[parts[g]] = True
            parts[g] = np.packbits(bits, bitorder="little").view("<u2")
        records = _binary(np.where(size >= _DENSE, CHUNK // 8, 2 * size), np.concatenate(parts).tobytes())
    else:
        records = _binary(2 * size, place.astype("<u2").tobytes())
    again = count > 1
    extra = np.zeros(int(again.sum()), _MORE)
    extra["place"], extra["extra"] = place[again], count[again] - 1
    return records, _binary(_MORE.itemsize * np.bincount(group[again], minlength=len(size)), extra.tobytes())


def unpack_bitmaps(records: pa.Array, more: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, place and count of every record of the bitmaps, sorted by row and place."""
    size = np.diff(_offsets(records))
    dense = np.flatnonzero(size == CHUNK // 8)
    data = _data(records)
    if len(dense):
        start, parts = np.cumsum(size) - size, []
        for r in range(len(size)):
            part = data[start[r] : start[r] + size[r]]
            parts.append(np.flatnonzero(np.unpackbits(part, bitorder="little")).astype("<u2") if size[r] == CHUNK // 8 else part.view("<u2"))
        row, place = np.repeat(np.arange(len(size)), [len(p) for p in parts]), np.concatenate(parts)
    else:
        row, place = np.repeat(np.arange(len(size)), size // 2), data.view("<u2")
    key = row.astype("int64") * CHUNK + place
    extra = _data(more).view(_MORE)
    of = np.repeat(np.arange(len(size)), np.diff(_offsets(more)) // _MORE.itemsize).astype("int64") * CHUNK + extra["place"]
    count = np.ones(len(key), "int64")
    count[np.searchsorted(key, of)] += extra["extra"]
    return row, place.astype("int64"), count


def _offsets(a: pa.Array) -> np.ndarray:
    return np.frombuffer(a.buffers()[1], "int32")[a.offset : a.offset + len(a) + 1] if len(a) else np.zeros(1, "int32")


def _data(a: pa.Array) -> np.ndarray:
    at = _offsets(a)
    return np.frombuffer(a.buffers()[2], "uint8")[at[0] : at[-1]].copy() if len(a) and a.buffers()[2] else np.empty(0, "uint8")


def _built(field: np.ndarray, term: np.ndarray, names: pa.Array, pid: np.ndarray) -> pa.RecordBatch:
    """Bitmaps of occurrences, each a field, the place of its term in ``names``, and a record."""
    chunk = pid // CHUNK
    order = np.lexsort((pid, term, field))  # a chunk is a run of ids
    field, term, pid, chunk = field[order], term[order], pid[order], chunk[order]
    same = (field[1:] == field[:-1]) & (term[1:] == term[:-1])
    record = np.flatnonzero(np.r_[True, ~(same & (pid[1:] == pid[:-1]))])
    group = np.cumsum(np.r_[False, ~(same & (chunk[1:] == chunk[:-1]))])
    count = np.diff(np.r_[record, len(pid)])
    records, more = pack_bitmaps(group[record], pid[record] % CHUNK, count)
    head = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    fields = pa.array(["tokens", "types", ALL_POSTS]).take(pa.array(field[head]))
    return pa.RecordBatch.from_arrays([fields, names.take(pa.array(term[head])), pa.array(chunk[head]), records, more], ["field_name", "term", "chunk", "records", "more"])


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    fields: list[np.ndarray] = []
    terms: list[pa.Array] = []
    pids: list[np.ndarray] = []
    posts: list[np.ndarray] = []

    def built() -> Iterator[pa.RecordBatch]:
        coded = pa.chunked_array(terms, pa.string()).combine_chunks().dictionary_encode()
        if len(coded):
            yield _built(np.concatenate(fields), coded.indices.to_numpy(zero_copy_only=False).astype("int64"), coded.dictionary, np.concatenate(pids))
        for held in (fields, terms, pids, posts):
            held.clear()

    waiting = 0
    for b in batches:
        pid = b.column("pid").to_numpy()
        _, one = np.unique(pid, return_index=True)  # a post over and over is one in all that is held
        one = one[~np.isin(pid[one], np.concatenate(posts))] if posts else one
        b = b.take(pa.array(np.sort(one)))
        pid = b.column("pid").to_numpy()
        posts.append(pid)
        for k, name in enumerate(("tokens", "types")):
            lists = b.column(name)
            flat = lists.flatten().cast(pa.string())
            of = np.repeat(pid, lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            known = flat.is_valid()
            fields.append(np.full(len(flat) - flat.null_count, k, "int8"))
            terms.append(flat.filter(known))
            pids.append(of[known.to_numpy(zero_copy_only=False)])
            waiting += len(flat)
        some = pid[b.column("tokens").value_lengths().fill_null(0).to_numpy(zero_copy_only=False) > 0]
        fields.append(np.full(len(some), 2, "int8"))
        terms.append(pa.array([""] * len(some), pa.string()))
        pids.append(some)
        if waiting > _AT_ONCE:
            yield from built()
            waiting = 0
    yield from built()


def term_bitmaps(posts: DataFrame) -> DataFrame:
    """:data:`BITMAPS` of the posts: a term and chunk has a row from every task that read some of its records."""
    rows = posts.where("pid is not null").select("pid", "tokens", "types")
    return with_consistent_array(rows, "tokens").mapInArrow(_build, BITMAPS)


def _union(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bitmaps of one term and chunk, which follow on one another, become one."""
    held: list[pa.RecordBatch] = []

    def starts(t: pa.Table) -> np.ndarray:
        """Where a row is of another term or chunk than the row before."""
        of = [t.column(c).combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False) for c in ("field_name", "term")]
        chunk = t.column("chunk").to_numpy()
        return np.flatnonzero(np.r_[True, (of[0][1:] != of[0][:-1]) | (of[1][1:] != of[1][:-1]) | (chunk[1:] != chunk[:-1])])

    def merged(t: pa.Table, head: np.ndarray) -> pa.RecordBatch:
        group = np.repeat(np.arange(len(head)), np.diff(np.r_[head, len(t)]))
        row, place, count = unpack_bitmaps(*(t.column(c).combine_chunks().cast(pa.binary()) for c in ("records", "more")))
        of = group[row]
        if len(head) < len(t):
            key = of * CHUNK + place
            order = np.lexsort((-count, key))
            kept = order[np.r_[True, key[order][1:] != key[order][:-1]]]
            of, place, count = of[kept], place[kept], count[kept]
        records, more = pack_bitmaps(of, place, count)
        sums = [pa.array(np.bincount(of, w).astype("int64")) for w in (None, count)]
        names = [t.column(c).combine_chunks().take(pa.array(head)) for c in ("field_name", "term", "chunk")]
        return pa.RecordBatch.from_arrays([*names, records, more, *sums], ["field_name", "term", "chunk", "records", "more", "posts", "occurrences"])

    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([*held, b])
        head = starts(t)
        if cut := int(head[-1]):
            yield merged(t.slice(0, cut), head[:-1])
        rest = t.slice(cut)
        held = [merged(rest, np.zeros(1, "int64")).select(b.schema.names)] if len(rest) > 1 else rest.to_batches()
    if held:
        rest = pa.Table.from_batches(held)
        yield merged(rest, starts(rest))


def merge_bitmaps(*parts: DataFrame) -> DataFrame:
    """The union of bitmaps, with ``posts``, the cardinality, and ``occurrences``: one row per term and chunk."""
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    every = every.withColumn("span", F.floor(F.col("chunk") / SPAN)).withColumn("key", F.xxhash64("field_name", "term"))
    every = every.repartition("key", "span").sortWithinPartitions("key", "field_name", "term", "chunk").select("field_name", "term", "chunk", "records", "more")
    return every.mapInArrow(_union, BITMAPS + ", posts long, occurrences long")


def term_frequencies(bitmaps: DataFrame, rare_below: int = 3, common_above: float = 0.05) -> DataFrame:
    """``(field_name, term, occurrences, posts, verdict)`` of every term; ``verdict`` is rare, common or null."""
    found = merge_bitmaps(bitmaps).groupBy("field_name", "term").agg(F.sum("occurrences").alias("occurrences"), F.sum("posts").alias("posts"))
    found = materialize(found, "term-frequencies")
    total = F.broadcast(found.where(F.col("field_name") == ALL_POSTS).agg(F.coalesce(F.max("posts"), F.lit(0)).alias("total")))
    verdict = F.when(F.col("posts") < rare_below, "rare").when(F.col("posts") > F.col("total") * common_above, "common")
    return found.where(F.col("field_name") != ALL_POSTS).join(total).select("field_name", "term", "occurrences", "posts", verdict.alias("verdict"))
