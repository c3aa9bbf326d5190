"""Problem 6: the k most similar vectors of every vector, by cosine.

Method: randomly rotated one-bit codes. Vectors are brought to unit length and put into cells around centroids. Of a
vector's residual to its centroid, rotated at random, only the signs are kept, packed: one bit a dimension for each of a few
independent rotations (``bits`` in all), with correction scalars (the residual's length, and how well the signs fit it). They give an unbiased estimate of the inner
product with any query, and an error bound; only vectors whose upper bound reaches what a query has already are compared
exactly. The estimates of many queries and vectors are one matrix product of rotated queries and unpacked signs.

1. Every vector is encoded once; the table of codes is written.
2. Home: cells that lie close together are gathered, with their vectors, in blocks of about ``home`` rows. Over its whole
   block a query has one threshold, its k-th best lower bound; what reaches it is compared exactly. This gives each query a
   k-th cosine to beat.
3. Elsewhere: queries (as bytes) meet *codes*, never vectors, in all blocks with a cell that can still hold something
   better: by the triangle inequality of angles with the cell's or the band's angles. A band is a run of a cell's rows by
   their angle to the centroid.
4. Vectors are fetched for the pairs that are left, which are compared exactly in double precision.

Nothing bounds the cells a query may look into or its candidates: a neighbour is lost only where an estimate is off by more
than ``EPSILON`` standard errors (about one in a thousand of those exactly on the threshold). ``least`` is a cosine below which neighbours are not wanted: it
makes the search of near neighbours cheap. Without it, angles are wide in many dimensions and few cells can be left out.

A block of a hot cell is split by the hash of the id, so a third of all rows in one place is many tasks. Equal vectors are
one query, and only the ``k + 1`` of them with the smallest ids can be in anyone's result, so masses of copies cost nothing.
Centroids are fitted on a bounded sample, ``A_CELL`` vectors a cell; every vector is indexed.

Null ids, null and all-zero vectors, and vectors with null, infinite or NaN members do not count. Vectors of different
lengths have no cosine: each length is searched by itself (more than ``MAX_LENGTHS`` lengths raise). Ties go to the smaller
``vec_id``; a second delivery counts once. Fewer than ``k`` others give fewer rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillgraph.llm.classes import SALTS, with_classes
from rillgraph.plans.materialize import broadcast_if_small, materialize
from rillgraph.plans.sampling import hash_sample

EPSILON = 3.0
MAX_CELLS = 4096
A_CELL = 40  # sampled vectors a centroid
MAX_LENGTHS = 16
BAND = 256
_PAIRS_AT_ONCE = 1 << 21
_SLACK = 1e-5  # of cosines and angles, above the rounding of single precision


def all_vectors(*tables: DataFrame) -> DataFrame:
    """``(vec_id, vector)`` of the tables together, each id once, without vectors that do not count."""
    every = tables[0].select("vec_id", "vector")
    for t in tables[1:]:
        every = every.unionByName(t.select("vec_id", "vector"))
    good = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0)
    return materialize(every.where(F.col("vec_id").isNotNull() & good).dropDuplicates(["vec_id"]), "vectors")


def _units(lists: pa.Array) -> np.ndarray:
    d = len(lists.flatten()) // max(1, len(lists))
    v = lists.flatten().to_numpy(zero_copy_only=False).astype("float64").reshape(len(lists), d)
    v = v / np.abs(v).max(1, keepdims=True, initial=1e-300)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _centroids(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means."""
    rng = np.random.default_rng(7)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].astype("float32")
    x = x.astype("float32")
    for _ in range(rounds):
        near = np.concatenate([(x[i : i + 4096] @ c.T).argmax(1) for i in range(0, len(x), 4096)])
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        c = np.where(norm > 0, total / np.maximum(norm, 1e-12), c)
    return c


def _rotations(d: int, bits: int) -> np.ndarray:
    """Independent random rotations of the vector with zeros appended to a multiple of 64 places, ``bits`` rows in all; the
    columns of each are orthonormal."""
    rng, size = np.random.default_rng(11), -(-d // 64) * 64
    out = []
    for _ in range(max(1, bits // size)):
        q, r = np.linalg.qr(rng.standard_normal((size, size)))
        out.append((q * np.sign(np.diag(r)))[:, :d])
    return np.stack(out)


def encode(residuals: np.ndarray, rotations: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed sign bits of the residuals under every rotation, their lengths, and for every rotation the inner product of signs
    and residual, both at unit length."""
    length = np.linalg.norm(residuals, axis=1)
    y = np.einsum("nd,mbd->nmb", residuals / np.maximum(length, 1e-12)[:, None], rotations)
    fit = np.abs(y).sum(2) / np.sqrt(y.shape[2])
    return np.packbits(y.reshape(len(y), -1) >= 0, axis=1, bitorder="little"), length, np.maximum(fit, 1e-6)


def _rotated(queries: np.ndarray, rotations: np.ndarray) -> np.ndarray:
    return (queries @ rotations.reshape(-1, rotations.shape[2]).T).astype("float32")


class Codes:
    """Codes of the rows of one cell, ready to meet queries. The estimate is the mean of those of the rotations, whose errors
    are independent; the first rotation alone is the coarse estimate."""

    def __init__(self, code: np.ndarray, length: np.ndarray, fit: np.ndarray, centre: np.ndarray, rotations: np.ndarray) -> None:
        m, size, _ = rotations.shape
        signs = np.unpackbits(code, axis=1, count=m * size, bitorder="little").astype("float32").reshape(-1, m, size) * 2 - 1
        signs *= (length[:, None] / fit / np.sqrt(size)).astype("float32")[:, :, None]
        # <x, q> = <c, q> + <r, c> + <r, q - c>, and <r, c> follows from |x| = 1
        own = (1 - centre @ centre - length.astype("float64") ** 2) / 2
        turned = rotations @ centre
        error = length[:, None] * np.sqrt(np.maximum(1 - fit**2, 0) / max(size - 1, 1)) / fit
        self.centre, self.first, self.m = centre, np.ascontiguousarray(signs[:, 0]), m
        self.first_shift, self.first_error = (own - self.first @ turned[0]).astype("float32"), (EPSILON * error[:, 0]).astype("float32")
        self.signs = signs.reshape(len(signs), -1) / np.float32(m)
        self.shift = (own - self.signs @ turned.reshape(-1)).astype("float32")
        self.error = (EPSILON * np.sqrt((error**2).sum(1)) / m).astype("float32")

    def bounds(self, queries: np.ndarray, rotated: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Estimated cosine of every query and row, and its error bound."""
        about = rotated @ self.signs.T + self.shift
        about += (queries @ self.centre).astype("float32")[:, None]
        return about, np.linalg.norm(queries - self.centre, axis=1).astype("float32")[:, None] * self.error

    def reaching(self, queries: np.ndarray, rotated: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The pairs whose upper bound reaches ``least``: query, row, upper and lower bound. The coarse estimates are one product
        and one comparison; what is left of them is estimated by all rotations."""
        away, dot, size = np.linalg.norm(queries - self.centre, axis=1).astype("float32"), (queries @ self.centre).astype("float32"), self.first.shape[1]
        asked = np.concatenate([rotated[:, :size], np.ones((len(queries), 1), "float32"), away[:, None]], 1)
        upper = asked @ np.concatenate([self.first, self.first_shift[:, None], self.first_error[:, None]], 1).T
        at, of = np.divmod(np.flatnonzero(upper >= (least - dot)[:, None]), upper.shape[1])  # much faster than in two dimensions
        about = dot[at] + self.shift[of] + _dots(rotated, self.signs, at, of)
        error = away[at] * self.error[of]
        keep = about + error >= least[at]
        return at[keep], of[keep], (about + error)[keep], (about - error)[keep]


def _angles(units: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Angle of every vector and centre, in double precision."""
    c = centres.astype("float64")
    return np.arccos(np.clip(units @ (c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)).T, -1, 1))


def _groups(counts: np.ndarray, centres: np.ndarray, size: int) -> list[list[int]]:
    """The cells that have rows, close ones together, in groups of about ``size`` rows; a larger cell is a group."""
    close = (centres @ _centroids(centres, max(1, int(np.sqrt(len(centres))))).T).argmax(1)
    groups: list[list[int]] = []
    held = size
    for c in np.lexsort((np.arange(len(centres)), close)):
        if counts[c]:
            if held + counts[c] > size:
                groups.append([])
                held = 0
            groups[-1].append(int(c))
            held += counts[c]
    return groups


def _best(at: np.ndarray, ids: np.ndarray, value: np.ndarray, k: int) -> np.ndarray:
    """Which rows are the best ``k`` of each query, by query and then value. Ties go to the smaller id."""
    order = np.lexsort((ids, -value, at))
    at = at[order]
    return order[np.arange(len(at)) - np.searchsorted(at, at) < k]


def _dots(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Exact cosines of pairs, in one fixed way, so that ties are ties."""
    return np.concatenate([np.einsum("ij,ij->i", a[i[lo : lo + 65536]], b[j[lo : lo + 65536]]) for lo in range(0, len(i), 65536)] or [np.empty(0)])


def home_top(ids: np.ndarray, units: np.ndarray, cells: np.ndarray, code: np.ndarray, length: np.ndarray, fit: np.ndarray, asks: np.ndarray, centres: np.ndarray, rotations: np.ndarray, k: int, floor: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The best ``k`` of a block for each of its rows ``asks``: how many, ids, exact cosines; and how many were compared."""
    held = [(rows, Codes(code[rows], length[rows], fit[rows], centres[c], rotations)) for c in np.unique(cells) for rows in [np.nonzero(cells == c)[0]]]
    step, found, compared = max(1, _PAIRS_AT_ONCE // max(1, len(ids))), [], 0
    for lo in range(0, len(asks), step):
        own = asks[lo : lo + step]
        q = units[own]
        rotated = _rotated(q, rotations)
        about, error = np.empty((len(q), len(ids)), "float32"), np.empty((len(q), len(ids)), "float32")
        for rows, codes in held:
            about[:, rows], error[:, rows] = codes.bounds(q, rotated)
        least = np.full(len(q), floor, "float32")
        if len(ids) > k:
            least = np.maximum(least, -np.partition(error - about, k - 1, axis=1)[:, k - 1])
        at, of = np.divmod(np.flatnonzero(about + error >= least[:, None] - _SLACK), len(ids))
        exact = _dots(q, units, at, of)
        compared += len(at)
        good = exact >= floor
        at, of, exact = at[good], of[good], exact[good]
        best = _best(at, ids[of], exact, k)
        found.append((np.bincount(at[best], minlength=len(q)), ids[of[best]], exact[best]))
    sizes, others, cosines = (np.concatenate(x) for x in zip(*found)) if found else (np.empty(0, "int64"), np.empty(0, "int64"), np.empty(0))
    return sizes, others, cosines, compared


def code_candidates(cells: np.ndarray, angles: np.ndarray, homes: np.ndarray, code: np.ndarray, length: np.ndarray, fit: np.ndarray, queries: np.ndarray, off: np.ndarray, query_homes: np.ndarray, least: np.ndarray, centres: np.ndarray, rotations: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of query and row of a block of codes whose upper bound reaches the query's ``least`` cosine and the k-th best
    lower bound that it finds here; without rows of the query's own home, which it has seen. ``off`` is how far a query is
    from the one it stands for."""
    rotated, q, least = _rotated(queries, rotations), queries, least - off
    wide = np.arccos(np.clip(least, -1, 1)) + off + _SLACK
    found = [(np.empty(0, "int64"), np.empty(0, "int64"), np.empty(0, "float32"), np.empty(0, "float32"))]
    order = np.lexsort((angles, cells))
    for c in np.unique(cells):
        rows = order[np.searchsorted(cells[order], c) : np.searchsorted(cells[order], c, "right")]
        far = _angles(q, centres[c : c + 1])[:, 0]
        for band in (rows[lo : lo + BAND] for lo in range(0, len(rows), BAND)):
            asks = np.nonzero((far - angles[band[-1]] <= wide) & (angles[band[0]] - far <= wide))[0]
            if not len(asks):
                continue
            codes = Codes(code[band], length[band], fit[band], centres[c], rotations)
            step = max(1, _PAIRS_AT_ONCE // len(band))
            for part in (asks[lo : lo + step] for lo in range(0, len(asks), step)):
                at, of, upper, lower = codes.reaching(q[part], rotated[part], (least[part] - _SLACK).astype("float32"))
                at, of = part[at], band[of]
                new = query_homes[at] != homes[of]
                found.append((at[new], of[new], upper[new], lower[new]))
    at, of, upper, lower = (np.concatenate(x) for x in zip(*found))
    kth = np.full(len(q), -np.inf)
    best = _best(at, of, lower, k)
    full = np.bincount(at[best], minlength=len(q)) == k
    np.minimum.at(low := np.full(len(q), np.inf), at[best], lower[best])
    kth[full] = low[full]
    keep = upper >= kth[at] - 2 * off[at] - _SLACK
    return at[keep], of[keep]


def _index(vectors: DataFrame, k: int, asked: Column | None, broadcast_rows: int) -> tuple[DataFrame, DataFrame]:
    """``(vec_id, class_id, salt, nth)`` of the rows that have an equal one, ``nth`` of the ``k + 1`` smallest ids of a class
    only; and ``(vec_id, asks, vector)`` of the rows that can be in a result."""
    hashed = vectors.select("vec_id", F.xxhash64("vector").alias("h1"), F.xxhash64(F.lit("second"), "vector").alias("h2"))
    shared = with_classes(hashed, ["vec_id"], broadcast_rows).where("not alone").select("vec_id", F.col("first.vec_id").alias("class_id"), F.pmod(F.xxhash64("vec_id"), F.lit(SALTS)).cast("int").alias("salt"))
    shared = materialize(shared, "vector-copies")
    least = shared  # the k + 1 smallest ids of a class: of each salt first, then of the class
    for by in (["class_id", "salt"], ["class_id"]):
        least = least.withColumn("nth", F.row_number().over(Window.partitionBy(*by).orderBy("vec_id"))).where(F.col("nth") <= k + 1)
    shared = materialize(shared.join(least.select("vec_id", "nth"), "vec_id", "left"), "vector-shared")
    known, _ = broadcast_if_small(shared.select("vec_id", F.coalesce("nth", F.lit(0)).alias("nth")), broadcast_rows)
    index = vectors.join(known, "vec_id", "left").where("nth is null or nth > 0")
    asks = F.coalesce(F.col("nth"), F.lit(1)) == 1
    if asked is not None:
        also, _ = broadcast_if_small(materialize(shared.where(asked).select(F.col("class_id").alias("vec_id")).distinct().withColumn("also", F.lit(True)), "vector-asked"), broadcast_rows)
        index = index.join(also, "vec_id", "left")
        asks = F.when(F.col("nth").isNull(), asked).otherwise(F.col("also").isNotNull())
    return shared, index.select("vec_id", asks.alias("asks"), "vector")


def most_similar(vectors: DataFrame, k: int = 5, least: float | None = None, asked: Column | None = None, bits: int = 256, cells: int | None = None, home: int = 4096, wide: int | None = None, broadcast_rows: int = 200_000) -> DataFrame:
    """``(vec_id, rank, other, cosine)``: for every vector its ``k`` most similar others, rank 1 first.

    ``vectors`` is a result of :func:`all_vectors`. ``least`` leaves out neighbours of a smaller cosine. ``asked`` is a
    condition on ``vec_id`` for the vectors that ask; all are searched. ``bits`` is the length of a code (a rotation takes
    as many as the dimensions, rounded up to a multiple of 64; there is one at least), ``cells`` defaults to the root of the number of vectors, ``home`` and ``wide`` are
    the rows of a block of vectors and of codes.
    """
    sizes = [r.d for r in vectors.select(F.size("vector").alias("d")).distinct().limit(MAX_LENGTHS + 1).collect()]
    if len(sizes) > MAX_LENGTHS:
        raise ValueError(f"vectors of more than {MAX_LENGTHS} lengths")
    parts = [_most_similar(vectors.where(F.size("vector") == d) if len(sizes) > 1 else vectors, d, k, least, asked, bits, cells, home, wide, broadcast_rows) for d in sorted(sizes)]
    return reduce(DataFrame.unionByName, parts) if parts else vectors.sparkSession.createDataFrame([], "vec_id long, rank int, other long, cosine double")


def _most_similar(vectors: DataFrame, d: int, k: int, least: float | None, asked: Column | None, bits: int, cells: int | None, home: int, wide: int | None, broadcast_rows: int) -> DataFrame:
    spark, floor, most = vectors.sparkSession, -2.0 if least is None else least, k + 1  # a query finds itself, too
    shared, index = _index(vectors, k, asked, broadcast_rows)
    n = vectors.count()
    cells = cells or int(np.clip(np.sqrt(n), 1, MAX_CELLS))
    some = hash_sample(vectors, "vec_id", max(1000, A_CELL * cells), n).select("vector").toArrow()
    centres = _centroids(_units(some.column(0).combine_chunks()), cells).astype("float64")
    cells, rotations = len(centres), _rotations(d, bits)
    bits, turns = rotations.shape[0] * rotations.shape[1], len(rotations)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near = centres.astype("float32").T
        for b in (b.slice(lo, 4096) for b in batches for lo in range(0, b.num_rows, 4096)):
            units = _units(b.column("vector"))
            cell = (units.astype("float32") @ near).argmax(1)
            code, length, fit = encode(units - centres[cell], rotations)
            angle = np.arccos(np.clip(np.einsum("ij,ij->i", units, centres[cell]) / np.maximum(np.linalg.norm(centres[cell], axis=1), 1e-12), -1, 1))
            packed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(bits // 8), len(code), [None, pa.py_buffer(np.ascontiguousarray(code))]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("asks"), b.column("vector"), pa.array(cell.astype("int32")), pa.array(angle.astype("float32")), packed, pa.array(length.astype("float32")), pa.array([x.tobytes() for x in fit.astype("float32")], pa.binary())], ["vec_id", "asks", "vector", "cell", "angle", "code", "length", "fit"])

    index = materialize(index.mapInArrow(coded, "vec_id long, asks boolean, vector array<float>, cell int, angle float, code binary, length float, fit binary"), "vector-index")
    count, radius, inner, queries = np.zeros(cells, "int64"), np.zeros(cells), np.zeros(cells), 0
    for r in index.groupBy("cell").agg(F.count("*").alias("n"), F.max("angle").alias("a"), F.min("angle").alias("b"), F.count_if("asks").alias("q")).collect():
        count[r["cell"]], radius[r["cell"]], inner[r["cell"]], queries = r["n"], r["a"], r["b"], queries + r["q"]
    wide = wide or int(np.clip(n // 5, 4096, 1 << 17))
    places: dict[int, list[int]] = {}
    blocks = 0
    for size in (home, wide):
        groups = _groups(count, centres.astype("float32"), size)
        pieces = np.array([-(-int(count[g].sum()) // size) for g in groups])
        first = np.cumsum(pieces) - pieces
        for g, members in enumerate(groups):
            for c in members:
                places.setdefault(c, []).extend((int(first[g]), int(pieces[g])))
        blocks, order, starts = int(pieces.sum()), np.concatenate(groups), np.cumsum([0, *(len(g) for g in groups)])[:-1]
    placed = F.broadcast(spark.createDataFrame([(c, *p) for c, p in places.items()], "cell int, h0 int, hn int, b0 int, bn int"))
    piece = lambda first, of: (F.col(first) + F.pmod(F.xxhash64("vec_id"), F.col(of))).cast("int")
    index = index.join(placed, "cell").withColumns({"hb": piece("h0", "hn"), "rb": piece("b0", "bn")}).drop("h0", "hn", "b0", "bn")

    def codes_of(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        code = np.frombuffer(b"".join(t.column("code").to_pylist()), "uint8").reshape(-1, bits // 8)
        fit = np.frombuffer(b"".join(t.column("fit").to_pylist()), "float32").reshape(-1, turns)
        return t.column("cell").to_numpy(), code, t.column("length").to_numpy(), fit

    def at_home(t: pa.Table) -> pa.Table:
        cell, code, length, fit = codes_of(t)
        ids, units = t.column("vec_id").to_numpy(), _units(t.column("vector").combine_chunks())
        asks = np.nonzero(t.column("asks").to_numpy(zero_copy_only=False))[0]
        sizes, others, cosines, _ = home_top(ids, units, cell, code, length, fit, asks, centres, rotations, most, floor)
        near = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype("int32")), pa.StructArray.from_arrays([pa.array(-cosines), pa.array(others)], ["far", "other"]))
        last = np.cumsum(sizes) - 1
        kth = np.maximum(np.where(sizes == most, cosines[last] if len(cosines) else -2.0, -2.0), floor) if len(asks) else np.empty(0)
        q = units[asks]
        scale = np.abs(q).max(1, initial=0) / 127
        byte = np.rint(q / np.maximum(scale, 1e-30)[:, None]).astype("int8")
        off = np.linalg.norm(q - byte * scale[:, None], axis=1)
        return pa.table({"asks": pa.array(ids[asks]), "hb": t.column("hb").take(pa.array(asks)), "near": near, "least": pa.array(kth), "query": pa.array([x.tobytes() for x in byte], pa.binary()), "scale": pa.array(scale), "off": pa.array(off)})

    seen = index.groupBy("hb").applyInArrow(at_home, "asks long, hb int, near array<struct<far:double,other:long>>, least double, query binary, scale double, off double")
    seen = materialize(seen, "vector-home")

    def query_of(t: pa.Table | pa.RecordBatch) -> np.ndarray:
        return np.frombuffer(b"".join(t.column("query").to_pylist()), "int8").reshape(-1, d) * t.column("scale").to_numpy()[:, None]

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Queries to every block with a cell that can hold something better than they have."""
        step = max(1, _PAIRS_AT_ONCE // max(cells, 64 * blocks))
        for b in (b.slice(lo, step) for b in batches for lo in range(0, b.num_rows, step)):
            far = _angles(query_of(b), centres[order])
            wide_ = (np.arccos(np.clip(b.column("least").to_numpy(), -1, 1)) + 2 * b.column("off").to_numpy() + _SLACK)[:, None]
            can = (far - radius[order] <= wide_) & (inner[order] - far <= wide_)
            row, to = np.nonzero(np.repeat(np.logical_or.reduceat(can, starts, axis=1), pieces, axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(to.astype("int32")), *b.take(pa.array(row)).columns], ["q_rb", *b.schema.names])

    query_blocks = max(1, -(-queries // wide))
    data = index.select("rb", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("qb"), "vec_id", "hb", "cell", "angle", "code", "length", "fit")
    asking = seen.select("asks", "hb", "least", "query", "scale", "off")
    asking = asking.mapInArrow(route, "q_rb int, asks long, q_hb int, least double, query binary, scale double, off double") if blocks else asking
    asking = asking.withColumn("q_qb", F.pmod(F.xxhash64("asks"), F.lit(query_blocks)).cast("int"))

    def elsewhere(left: pa.Table, right: pa.Table) -> pa.Table:
        at = of = np.empty(0, "int64")
        if left.num_rows and right.num_rows:
            cell, code, length, fit = codes_of(left)
            asked_for = [right.column(c).to_numpy() for c in ("off", "q_hb", "least")]
            at, of = code_candidates(cell, left.column("angle").to_numpy(), left.column("hb").to_numpy(), code, length, fit, query_of(right), *asked_for, centres, rotations, most)
        return pa.table({"asks": right.column("asks").to_numpy()[at] if right.num_rows else at, "other": left.column("vec_id").to_numpy()[of] if left.num_rows else of})

    pairs = data.groupBy("rb", "qb").cogroup(asking.groupBy("q_rb", "q_qb")).applyInArrow(elsewhere, "asks long, other long")
    pairs, _ = broadcast_if_small(materialize(pairs, "vector-candidates"), broadcast_rows)
    half = index.select(F.col("vec_id").alias("asks"), F.col("vector").alias("a")).join(pairs, "asks")
    both = index.select(F.col("vec_id").alias("other"), F.col("vector").alias("b")).join(half, "other").select("asks", "other", "a", "b")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                i = np.arange(b.num_rows)
                cosine = _dots(_units(b.column("a")), _units(b.column("b")), i, i)
                yield pa.RecordBatch.from_arrays([b.column("asks"), b.column("other"), pa.array(cosine)], ["asks", "other", "cosine"])

    exact = both.mapInArrow(compare, "asks long, other long, cosine double").where(F.col("cosine") >= floor)
    more = exact.groupBy("asks").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("cosine")).alias("far"), "other"))), 1, most).alias("near"))
    near = seen.select(F.col("asks").alias("class_id"), F.col("near").alias("here")).join(more.withColumnRenamed("asks", "class_id"), "class_id", "left")
    near = near.select("class_id", F.when(F.col("near").isNull(), F.col("here")).otherwise(F.slice(F.array_sort(F.concat("here", "near")), 1, most)).alias("near"))
    copies, _ = broadcast_if_small(shared.where("vec_id = class_id").select("class_id", F.lit(True).alias("copied")), broadcast_rows)
    near = near.join(copies, "class_id", "left")
    alone = near.where("copied is null").select(F.col("class_id").alias("vec_id"), "near")
    salted = near.where("copied").select("class_id", "near", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    wanted = shared if asked is None else shared.where(asked)
    members = alone.unionByName(wanted.join(salted, ["class_id", "salt"]).select("vec_id", "near"))
    rest = F.slice(F.filter("near", lambda x: x["other"] != F.col("vec_id")), 1, k)
    out = members.select("vec_id", F.posexplode(rest).alias("at", "x"))
    return out.select("vec_id", (F.col("at") + 1).alias("rank"), F.col("x.other").alias("other"), (-F.col("x.far")).alias("cosine"))


def similar_pairs(neighbours: DataFrame, least: float = 0.9) -> DataFrame:
    """``(vec_a, vec_b)``, smaller first: pairs of at least that cosine, one among the most similar of the other."""
    pairs = neighbours.where(F.col("cosine") >= least)
    return pairs.select(F.least("vec_id", "other").alias("vec_a"), F.greatest("vec_id", "other").alias("vec_b")).distinct()
