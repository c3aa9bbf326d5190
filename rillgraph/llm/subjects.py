"""Problem 5: the subjects of each post: none, one or two of eight.

Method: one interpolated n-gram language model per subject, and for each a background model of everything else; a post's
tokens are compared under both, and the differences of cross-entropy are calibrated into an acceptance per subject.

``P(w | h, s) = a * P2(w | h, s) + (1 - a) * P1(w | s)``, with ``P1`` smoothed by the model of all text. A token's gain
for a subject is the log ratio of the subject's to the background's probability, cut to +-3; tokens that clearly speak
for one subject are its evidence. A logistic regression over the mean gain, the evidence, how scattered it stands and its
share decides, with a threshold for each subject. It is fitted on posts that the language models were not trained on (cross-fitting), which teaches it that
a word in passing or an aside of two or three words is no subject.

Every labelled post counts, in the language models, in the acceptance and in the thresholds. Words and pairs of words are
counted by fold, so the models with one fold left out are differences; gains are a table by the hash of the word or pair.
Posts stand in blocks: a block asks for the gains of its words and pairs by a join and is then scored as one group, so no
task and not the driver holds the whole model. The acceptance is fitted on sums over tasks, the thresholds on sums over
ranges of probabilities. Every post is scored. Labels are mapped to the eight subjects by their known spellings; null, empty and unknown
labels mean none. A post without tokens, or with a null ``pid``, has no rows; a second delivery counts once; without usable labels no post has a
subject. Other columns of the inputs are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from rillgraph.config import SUBJECTS
from rillgraph.llm.canonical import consistent_form, with_consistent_array
from rillgraph.llm.fitting import Logistic
from rillgraph.operators.subjects import LABEL_SUBJECTS
from rillgraph.plans.materialize import materialize

_KNOWN = {name.replace("-", "").replace(" ", ""): SUBJECTS.index(subject) for name, subject in LABEL_SUBJECTS.items()}
N = len(SUBJECTS)
LEXICON_LIMIT = 100_000
LEAST_LABELLED = 200  # posts of a subject below which it has no threshold of its own
FOLDS = 4  # model ``f`` leaves fold ``f`` out, model ``FOLDS`` leaves none out
WHOLE = 840  # the weight of a post, an integer in equal shares for one to eight subjects
FEATURES = 8
MIX, SMOOTH = 0.3, 40.0
BLOCK_BITS = 12  # 4,096 posts a block
TOKENS_A_BUCKET = 100_000
BITS_A_KEY = 16
_GAIN = [f"g{k}" for k in range(N // 2)]  # two gains each
_GAIN_SCHEMA = "model int, key long, " + ", ".join(f"{g} long" for g in _GAIN)


def subject_of(label: str | None) -> int | None:
    """The index of the subject that a label names, else None."""
    key = (consistent_form(label) or "").lower().replace("_", " ").replace("-", " ").replace(" ", "")
    return _KNOWN.get(key)


@arrow_udf(T.IntegerType())
def _subject_index(labels: pa.Array) -> pa.Array:
    """Each distinct label once."""
    coded = labels.cast(pa.string()).dictionary_encode()
    return pa.array([subject_of(x) for x in coded.dictionary.to_pylist()], pa.int32()).take(coded.indices)


def pair_key(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """The key of two neighbouring words from their hashes."""
    x = first.astype("uint64") * np.uint64(0x9E3779B97F4A7C15) + second.astype("uint64")
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ x >> np.uint64(shift)) * np.uint64(by)
    return (x ^ x >> np.uint64(31)).view("int64")


class Places:
    """The words of a batch of posts, one after another, and the pairs that end at them."""

    def __init__(self, codes: pa.ListArray) -> None:
        flat = codes.flatten()
        self.sizes = codes.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype("int64")
        self.there = flat.is_valid().to_numpy(zero_copy_only=False)  # a null token is no word
        self.word = flat.fill_null(0).to_numpy(zero_copy_only=False)
        self.post = np.repeat(np.arange(len(self.sizes)), self.sizes)
        self.paired = np.zeros(len(self.word), bool)
        self.paired[1:] = self.there[1:] & self.there[:-1] & (self.post[1:] == self.post[:-1])
        self.pair = np.zeros(len(self.word), "int64")
        self.pair[1:] = pair_key(self.word[:-1], self.word[1:])


def _binary(rows: np.ndarray) -> pa.Array:
    """One binary value a row."""
    rows = np.ascontiguousarray(rows)
    width = rows.itemsize * rows.shape[1]
    offsets = np.arange(len(rows) + 1, dtype="int32") * np.int32(width)
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(rows.tobytes())])


def _rows(values: pa.Array | pa.ChunkedArray, width: int, kind: str = "int64") -> np.ndarray:
    """The opposite of :func:`_binary`."""
    return np.frombuffer(b"".join(values.to_pylist()), kind).reshape(-1, width)


# -- counts


def _weights(subjects: np.ndarray) -> np.ndarray:
    """For each post the share of every subject and, last, of none, in parts of ``WHOLE``."""
    about = subjects[:, None] >> np.arange(N) & 1
    about = np.c_[about, about.sum(1) == 0]
    return about * (WHOLE // about.sum(1, keepdims=True))


def _tallied(key: np.ndarray, post: np.ndarray, fold: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, ...]:
    """Per key and place (fold and class): an index of the key's first use, the place, the weight of the posts, of the uses."""
    _, first, at = np.unique(key, return_index=True, return_inverse=True)
    fresh = np.zeros(len(key), bool)
    fresh[np.unique(post * (len(first) + 1) + at, return_index=True)[1]] = True
    use, cls = np.nonzero(weights[post])
    w = weights[post[use], cls]
    width = FOLDS * (N + 1)
    cell, to = np.unique(at[use] * width + fold[post[use]] * (N + 1) + cls, return_inverse=True)
    total = lambda x: np.bincount(to, x, len(cell)).astype("int64")
    return first[cell // width], cell % width, total(w * fresh[use]), total(w)


def _counts(buckets: int, pairs: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = Places(b.column("codes"))
            keep = np.nonzero(p.paired if pairs else p.there)[0]
            key = (p.pair if pairs else p.word)[keep]
            at, place, posts, uses = _tallied(key, p.post[keep], b.column("fold").to_numpy(), _weights(b.column("subjects").to_numpy()))
            keys = {"head": p.word[keep[at] - 1], "tail": p.word[keep[at]]} if pairs else {"key": key[at], "posts": posts}
            yield pa.RecordBatch.from_pydict({"bucket": (key[at] % buckets).astype("int32"), "place": place.astype("int32"), "uses": uses} | keys)

    return run


def _dense(at: np.ndarray, place: np.ndarray, values: np.ndarray, rows: int, width: int) -> np.ndarray:
    return np.bincount(at * width + place, values, rows * width).astype("int64").reshape(rows, width)


def _packed_words(t: pa.Table) -> pa.Table:
    key, at = np.unique(t["key"].to_numpy(), return_inverse=True)
    dense = lambda c: _binary(_dense(at, t["place"].to_numpy(), t[c].to_numpy(), len(key), (FOLDS + 1) * (N + 1)))
    return pa.table({"key": key, "posts": dense("posts"), "uses": dense("uses")})


def _packed_pairs(t: pa.Table) -> pa.Table:
    """Pairs seen more than once."""
    head, tail, uses = t["head"].to_numpy(), t["tail"].to_numpy(), t["uses"].to_numpy()
    _, first, at = np.unique(pair_key(head, tail), return_index=True, return_inverse=True)
    often = np.bincount(at, uses, len(first)) > WHOLE
    to, keep = np.cumsum(often) - 1, often[at]
    n = int(often.sum())
    dense = _dense(to[at[keep]], t["place"].to_numpy()[keep], uses[keep], n, (FOLDS + 1) * (N + 1))
    return pa.table({"head": head[first[often]], "tail": tail[first[often]], "both": _binary(dense)})


def _by_model(values: pa.Array) -> np.ndarray:
    """Counts of each key, model and class from those of each key and fold; the lexicon, behind the folds, is in every model."""
    own = _rows(values, (FOLDS + 1) * (N + 1)).reshape(-1, FOLDS + 1, N + 1)
    every = own.sum(1, keepdims=True)
    return np.concatenate([every - own[:, :FOLDS], every], 1)


# -- gains


@dataclass
class Totals:
    """Of each model: weights of the classes, number of words."""

    weights: np.ndarray
    words: np.ndarray

    @staticmethod
    def of(words: DataFrame) -> Totals:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((FOLDS + 1, N + 2), "int64")
            for b in batches:
                counts = _by_model(b.column("posts"))
                total += np.concatenate([counts, counts.any(2, keepdims=True)], 2).sum(0)
            yield pa.RecordBatch.from_pydict({"total": _binary(total.reshape(1, -1))})

        parts = words.select("posts").mapInArrow(run, "total binary").collect()
        total = sum((np.frombuffer(r.total, "int64") for r in parts), np.zeros((FOLDS + 1) * (N + 2), "int64")).reshape(FOLDS + 1, N + 2)
        return Totals(total[:, : N + 1] / WHOLE, total[:, N + 1 :])

    def single(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Probabilities of words in each model for every subject and for all else."""
        counts = counts / WHOLE
        every, all_ = counts.sum(2, keepdims=True), self.weights.sum(1, keepdims=True)
        own, total = counts[:, :, :N], self.weights[:, :N]
        general = (every + 0.01) / (all_ + 0.01 * np.maximum(self.words, 1))
        return (own + SMOOTH * general) / (total + SMOOTH), (every - own + SMOOTH * general) / (all_ - total + SMOOTH)


def _gain_rows(key: np.ndarray, p: np.ndarray, q: np.ndarray, known: np.ndarray) -> pa.RecordBatch:
    row, model = np.nonzero(known)
    gain = np.clip(np.log(p[row, model]) - np.log(q[row, model]), -3, 3).astype("float32").view("int64")
    return pa.RecordBatch.from_pydict({"model": model.astype("int32"), "key": key[row]} | {g: np.ascontiguousarray(gain[:, k]) for k, g in enumerate(_GAIN)})


def gains(rows: DataFrame, lexicon: list[tuple[int, str]]) -> DataFrame:
    """``(model, key, g0, ...)``: the gains of the words and pairs that each model knows, from all labelled posts."""
    tokens = rows.agg(F.sum(F.size("codes"))).first()[0] or 0
    buckets = 1 + tokens // TOKENS_A_BUCKET
    terms = rows.sparkSession.createDataFrame(lexicon, "subject_idx int, term string").select(F.xxhash64("term").alias("key"), "subject_idx")
    place, weight = (F.col("subject_idx") + FOLDS * (N + 1)).alias("place"), F.lit(3 * WHOLE).cast("long").alias("posts")
    known = terms.select(F.pmod("key", F.lit(buckets)).cast("int").alias("bucket"), place, F.lit(0).cast("long").alias("uses"), "key", weight)
    trained = rows.select("subjects", "fold", "codes")
    words = trained.mapInArrow(_counts(buckets, False), "bucket int, place int, uses long, key long, posts long").unionByName(known)
    words = materialize(words.groupBy("bucket").applyInArrow(_packed_words, "key long, posts binary, uses binary"), "p5_words")
    pairs = trained.mapInArrow(_counts(buckets, True), "bucket int, place int, uses long, head long, tail long")
    pairs = pairs.groupBy("bucket").applyInArrow(_packed_pairs, "head long, tail long, both binary")
    pairs = pairs.join(words.select(F.col("key").alias("head"), "uses"), "head").join(words.select(F.col("key").alias("tail"), "posts"), "tail")
    totals = Totals.of(words)

    def of_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts = _by_model(b.column("posts"))
            yield _gain_rows(b.column("key").to_numpy(), *totals.single(counts), counts.any(2))

    def of_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            both, head = _by_model(b.column("both")), _by_model(b.column("uses")) / WHOLE
            p1, q1 = totals.single(_by_model(b.column("posts")))
            known = both.sum(2) > WHOLE
            own, every = both[:, :, :N] / WHOLE, both.sum(2, keepdims=True) / WHOLE
            h_own, h_every = head[:, :, :N], head.sum(2, keepdims=True)
            p, q = MIX * own / (h_own + 1) + (1 - MIX) * p1, MIX * (every - own) / (h_every - h_own + 1) + (1 - MIX) * q1
            yield _gain_rows(pair_key(b.column("head").to_numpy(), b.column("tail").to_numpy()), p, q, known)

    every = words.select("key", "posts").mapInArrow(of_words, _GAIN_SCHEMA).unionByName(pairs.select("head", "tail", "both", "uses", "posts").mapInArrow(of_pairs, _GAIN_SCHEMA))
    return materialize(every, "p5_gains")


# -- features


def features(g: np.ndarray, post: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Per post and subject, from the gains of the posts' words, one after another."""
    evidence = g > 0.8
    start = np.cumsum(sizes) - sizes
    add = lambda x: np.add.reduceat(np.vstack([x, np.zeros((1, N))]), np.minimum(start, len(x)), 0) * (sizes > 0)[:, None]
    total, mean = add(evidence), add(g) / np.maximum(sizes, 1)[:, None]
    fresh = evidence.copy()
    for back in (1, 2):  # evidence that stands apart from the evidence before it
        if len(g) > back:
            fresh[back:] &= ~(evidence[:-back] & (post[back:] == post[:-back])[:, None])
    runs, strength = add(fresh), add(np.where(evidence, g, 0))
    every = total.sum(1, keepdims=True)
    share, density = total / np.maximum(every, 1), total / np.maximum(sizes, 1)[:, None]
    return np.stack([np.log1p(total), np.log1p(runs), np.log1p(strength), mean, share, density, np.minimum(total, 4), np.minimum(runs, 3)], 2)


def _wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct words and pairs of each block, or of the parts of it that come in one batch."""
    for b in batches:
        p = Places(b.column("codes"))
        blocks, at = np.unique(b.column("block").to_numpy(), return_inverse=True)
        for i, block in enumerate(blocks):
            own = at[p.post] == i
            key = np.unique(np.r_[p.word[own & p.there], p.pair[own & p.paired]])
            yield pa.RecordBatch.from_pydict({"block": np.full(len(key), block), "key": key})


def _gains_at(p: Places, found: pa.Table) -> np.ndarray:
    """The gains at each place: the pair's where the model knows it, else the word's, else none."""
    g = np.zeros((len(p.word), N), "float32")
    key = found["key"].to_numpy()
    order = np.argsort(key)
    key, gain = key[order], np.stack([found[c].to_numpy() for c in _GAIN], 1)[order].view("float32")
    if len(key):
        for asked, of in ((p.word, p.there), (p.pair, p.paired)):
            at = np.minimum(np.searchsorted(key, asked), len(key) - 1)
            hit = np.nonzero(of & (key[at] == asked))[0]
            g[hit] = gain[at[hit]]
    return g


def with_features(rows: DataFrame, known: DataFrame, out: Callable[[pa.Table, np.ndarray], pa.Table], schema: str) -> DataFrame:
    """``out`` of each block of ``rows`` and its features; ``known`` has the gains by ``key``, of the model of the block's fold
    where it has ``model``."""
    wanted = rows.select("block", "codes").mapInArrow(_wanted, "block long, key long")
    if "model" in known.columns:
        wanted = wanted.withColumn("model", (F.col("block") % FOLDS).cast("int"))
    found = wanted.join(known, [c for c in known.columns if c not in _GAIN]).select("block", "key", *_GAIN)

    def run(posts: pa.Table, found: pa.Table) -> pa.Table:
        p = Places(posts["codes"].combine_chunks())
        return out(posts, features(_gains_at(p, found), p.post, p.sizes))

    return rows.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(run, schema)


def _blocks(bits: int) -> Column:
    """The number of a block of neighbouring rows; for rows that are written with it."""
    return F.shiftright(F.monotonically_increasing_id(), bits)


def _codes(posts: DataFrame) -> DataFrame:
    """``posts`` with the hashes of their words' consistent forms in place of ``tokens``."""
    rows = with_consistent_array(posts, "tokens")
    return rows.withColumn("codes", F.transform("tokens", lambda t: F.when(t.isNotNull(), F.xxhash64(t)))).drop("tokens")


# -- the acceptance


@dataclass
class SubjectModel:
    """Gains of the model that leaves no fold out, and the calibrated acceptance."""

    gains: DataFrame
    accept: Logistic
    thresholds: np.ndarray  # of each subject


def _accepted(accept: Logistic, thresholds: np.ndarray, x: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Probability of each subject; which of them, the ``most`` likeliest at most, are accepted."""
    p = accept.predict(x.reshape(-1, FEATURES)).reshape(x.shape[:2])
    rank = np.argsort(np.argsort(-p, 1, "stable"), 1, "stable")
    return p, (p >= thresholds) & (rank < most) & (x[:, :, 0] > 0)


def _truth(subjects: np.ndarray) -> np.ndarray:
    return (subjects[:, None] >> np.arange(N) & 1).astype(float)


def _fitted(table: DataFrame) -> Logistic:
    """The acceptance, from sums over all tasks."""

    def add(f: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = [f(_rows(b.column("x"), FEATURES, "float64"), _truth(b.column("subjects").to_numpy()).reshape(-1)) for b in batches if b.num_rows]
            if sums:
                yield pa.RecordBatch.from_pydict({"sums": _binary(sum(sums).reshape(1, -1))})

        return sum(np.frombuffer(r.sums, "float64") for r in table.mapInArrow(run, "sums binary").collect())

    return Logistic().fit_sums(add)


def _thresholds(table: DataFrame, accept: Logistic, positive: list[int]) -> np.ndarray:
    """Of each subject the threshold with the best F1 over all posts; the one shared by all where a subject has few.

    Equal probabilities count together. Ranges of probabilities are summed first, so each range is ranked on its own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = accept.predict(_rows(b.column("x"), FEATURES, "float64")).reshape(-1, N)
            truth = _truth(b.column("subjects").to_numpy())
            for s in range(N + 1):  # the last: all subjects
                value, at = np.unique(p[:, s] if s < N else p, return_inverse=True)
                hit = np.bincount(at.reshape(-1), (truth[:, s] if s < N else truth).reshape(-1), len(value))
                span = np.floor(np.log(value / (1 - value)) * 64).astype("int32")
                yield pa.RecordBatch.from_pydict({"s": np.full(len(value), s, "int32"), "span": span, "p": value, "n": np.bincount(at.reshape(-1), minlength=len(value)), "hit": hit.astype("int64")})

    spark = table.sparkSession
    ranked = table.mapInArrow(run, "s int, span int, p double, n long, hit long").groupBy("s", "span", "p").agg(F.sum("n").alias("n"), F.sum("hit").alias("hit"))
    ranked = materialize(ranked, "p5_ranked")
    spans = ranked.groupBy("s", "span").agg(F.sum("n").alias("n"), F.sum("hit").alias("hit"), F.max("p").alias("top")).collect()
    above = []
    for s, own in groupby(sorted(spans, key=lambda r: (r.s, -r.span)), key=lambda r: r.s):
        own, n, hit = list(own), 0, 0
        for r, below in zip(own, [*own[1:], None]):
            above.append((s, r.span, n, hit, below and below.top))
            n, hit = n + r.n, hit + r.hit
    before = spark.createDataFrame(above, "s int, span int, n_above long, hit_above long, below double")
    every = spark.createDataFrame([*enumerate(positive), (N, sum(positive))], "s int, positive long")
    down = Window.partitionBy("s", "span").orderBy(F.desc("p"))
    so_far = down.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    joined = ranked.join(F.broadcast(before), ["s", "span"]).join(F.broadcast(every), "s")
    n, hit = F.sum("n").over(so_far) + F.col("n_above"), F.sum("hit").over(so_far) + F.col("hit_above")
    f1 = joined.select("s", "p", (2 * hit / (n + F.col("positive") + 1e-9)).alias("f1"), F.coalesce(F.lead("p").over(down), "below", "p").alias("next"))
    best = {r.s: (r.best.p + r.best.next) / 2 for r in f1.groupBy("s").agg(F.max(F.struct("f1", "p", "next")).alias("best")).collect()}
    return np.array([best[s if positive[s] >= LEAST_LABELLED else N] for s in range(N)])


def _may_be_in(keys: DataFrame, key: str) -> Column:
    """False only where no row of ``keys`` has the value of ``key``, by a Bloom filter of two places and about ``BITS_A_KEY`` bits a
    row: rows that a join would drop are not shuffled for it."""
    size = 1 << max(10, min(31, (BITS_A_KEY * keys.count()).bit_length()))
    h = F.xxhash64(key)
    places = keys.select(F.explode(F.array(h, F.shiftrightunsigned(h, 32))).alias("h")).select(F.col("h").bitwiseAND(size - 1).alias("at"))
    words = places.groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("bits")).toArrow()
    bits = np.zeros(size >> 6, "int64")
    bits[words["word"].to_numpy()] = words["bits"].to_numpy()

    @arrow_udf(T.BooleanType())
    def may_be(hashes: pa.Array) -> pa.Array:
        h = hashes.to_numpy(zero_copy_only=False).view("uint64")
        there = np.ones(len(h), bool)
        for at in (h, h >> np.uint64(32)):
            at = (at & np.uint64(size - 1)).astype("int64")
            there &= (bits[at >> 6] >> (at & 63) & 1).astype(bool)
        return pa.array(there)

    return may_be(h)


def labelled(posts: DataFrame, labels: DataFrame, lexicon: DataFrame) -> tuple[DataFrame, dict[int, int], list[tuple[int, str]]]:
    """Every labelled post with tokens: ``(pid, subjects, fold, block, codes)``, the subjects as bits; the number of posts of
    each set of subjects; the lexicon."""
    terms = lexicon.select("subject_idx", "term").dropna().limit(LEXICON_LIMIT + 1).collect()
    if len(terms) > LEXICON_LIMIT:
        raise ValueError(f"a lexicon of more than {LEXICON_LIMIT} rows")
    of = labels.select("pid", _subject_index("label").alias("s")).groupBy("pid").agg(F.coalesce(F.bit_or(F.expr("shiftleft(1, s)")), F.lit(0)).alias("subjects"))
    of = materialize(of, "p5_sets")
    rows = posts.where("pid is not null and size(tokens) > 0").select("pid", "tokens").where(_may_be_in(of, "pid")).join(of, "pid").dropDuplicates(["pid"])
    rows = _codes(rows).select("pid", "subjects", F.pmod(F.xxhash64("pid"), F.lit(FOLDS)).cast("int").alias("fold"), F.array_compact("codes").alias("codes"))
    rows = materialize(rows.withColumn("block", _blocks(BLOCK_BITS + 2) * FOLDS + F.col("fold")), "p5_labelled")
    sets = {r.subjects: r["count"] for r in rows.groupBy("subjects").count().collect()}
    return rows, sets, [(int(r.subject_idx), consistent_form(r.term)) for r in terms]


def fit_subjects(posts: DataFrame, labels: DataFrame, lexicon: DataFrame) -> SubjectModel | None:
    """The model, or None where no label names a subject."""
    rows, sets, words = labelled(posts, labels, lexicon)
    if not any(sets) or all(s == 2**N - 1 for s in sets):
        return None
    known = gains(rows, words)
    out = lambda t, x: pa.table({"subjects": t["subjects"], "x": _binary(x.reshape(len(x), -1))})
    table = materialize(with_features(rows.select("block", "subjects", "codes"), known, out, "subjects int, x binary"), "p5_features")
    accept = _fitted(table)
    positive = [sum(n for bits, n in sets.items() if bits >> s & 1) for s in range(N)]
    return SubjectModel(known.where(F.col("model") == FOLDS).drop("model"), accept, _thresholds(table, accept, positive))


def subjects_of_posts(posts: DataFrame, model: SubjectModel | None, most: int = 2) -> DataFrame:
    """``(pid, subject_idx, probability)``: the subjects of every post, ``most`` of them at most (a post is about none, one or
    two here)."""
    schema = "pid long, subject_idx int, probability double"
    if model is None:
        return posts.sparkSession.createDataFrame([], schema)
    accept, thresholds = model.accept, model.thresholds

    def out(t: pa.Table, x: np.ndarray) -> pa.Table:
        p, ok = _accepted(accept, thresholds, x, most)
        post, subject = np.nonzero(ok)
        return pa.table({"pid": t["pid"].to_numpy()[post], "subject_idx": subject.astype("int32"), "probability": p[post, subject]})

    rows = _codes(posts.where("pid is not null and size(tokens) > 0").select("pid", "tokens"))
    rows = materialize(rows.withColumn("block", _blocks(BLOCK_BITS)), "p5_posts")
    return with_features(rows, model.gains, out, schema).dropDuplicates(["pid", "subject_idx"])


def composition(posts: DataFrame, found: DataFrame) -> DataFrame:
    """``(subject_idx, subject, posts, tokens)``: how much of the corpus is about each subject, 0 where nothing is."""
    sizes = posts.where("size(tokens) > 0").groupBy("pid").agg(F.max(F.size("tokens")).alias("n"))
    sums = found.join(sizes, "pid").groupBy("subject_idx").agg(F.count("*").alias("posts"), F.sum("n").alias("tokens"))
    every = posts.sparkSession.createDataFrame(list(enumerate(SUBJECTS)), "subject_idx int, subject string")
    return every.join(sums, "subject_idx", "left").na.fill(0, ["posts", "tokens"])
