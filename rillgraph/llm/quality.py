"""Problem 9: statistics of each text, and whether it is prose or else a list, a table or junk.

Method: gradient-boosted trees on document statistics, trained on weakly labelled prose and structural junk, with calibrated
probabilities. See :data:`STATISTICS` for what is measured.

Whole texts are measured in Arrow batches, many at once: characters become classes by a table, and everything else is sums
over the characters of sentences, lines and texts. Words and sentences are compared by 64-bit hashes.

Weak labels are votes of rules with abstention (:func:`weak_labels`): a text is labelled prose or junk only where several
rules agree. The share of running sentences, which comes closest to what is asked, is one vote among five and no feature of
the trees, so these must tell prose from the rest by the other statistics. The trees are fitted on the driver on two thirds
of at most ``train_documents`` texts, chosen by the hash of their id; slope and offset of the probability are fitted on the
third that no tree has seen. Every text is measured and judged. The words of ``common_words`` are a parameter of the
measuring task and bounded by ``COMMON_LIMIT``. ``lang`` is not used: it is often wrong, so the words of all languages count.

A null or empty text, or one of blanks only, has zeros for all statistics and is not prose. Nulls in other columns do not
matter; other columns are ignored; repeated rows are judged alike; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillgraph.llm.canonical import PERSIAN, consistent_form
from rillgraph.llm.fitting import BoostedTrees, Logistic, sigmoid
from rillgraph.plans.materialize import materialize
from rillgraph.plans.sampling import hash_sample

COMMON_LIMIT = 100_000
#: Counts and ratios of the whole text.
PLAIN = ("n_chars", "n_words", "n_lines", "mean_word_length", "symbol_ratio", "digit_ratio", "letter_ratio", "punctuated_lines", "common_words")
STATISTICS = (
    *PLAIN, "bullet_lines", "cell_lines", "words_a_line", "distinct_words", "repeated_share", "odd_ratio", "stops_a_word", "commonless_share",
    "upper_ratio", "bullet_share", "cell_share", "short_share", "sentence_share",
)
#: What the trees see: neither the length of the text nor the share of sentences.
FEATURES = tuple(s for s in STATISTICS if s not in ("n_chars", "n_words", "n_lines", "sentence_share"))

LETTER, DIGIT, SPACE, NEWLINE, STOP, ODD, UPPER, CELL, BULLET, DASH, CLOSING, GONE, COMMA, AFTER_NUMBER = (1 << i for i in range(14))
_AT_ONCE = 1 << 20  # characters measured together, about
_MULTIPLIER = 0x9E3779B97F4A7C15
# Characters that mark items of lists, end sentences, close lines, separate cells, or come from wrong decoding.
BULLETS, DASHES = "*•·▪■□★►▶✓✔✅§†‡#>+~", "-–—"
STOPS, CLOSINGS, CELLS = ".!?؟…", ".!?؟…:\"»)", "|;\t¦"
ODD_CHARACTERS = "¸-¿×÷ØÙÚÛÃÂÐÑˆ˜†‡€Œœ™„‚ƒ�"
INVISIBLE = "­​‍‎‏⁠﻿"


@lru_cache(1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Class of every character up to U+FFFE, and the character as which it is compared. The last place stands for all others."""
    kind, same = np.zeros(1 << 16, "uint16"), np.arange(1 << 16, dtype="uint64")
    odd = {chr(c) for lo, hi in ((0x80, 0xB6), (0xB8, 0xBF)) for c in range(lo, hi + 1)} | set(ODD_CHARACTERS) - {"-"}
    for i in range((1 << 16) - 1):
        c = chr(i)
        if c.isalpha():
            low = PERSIAN.get(c, c).lower()
            kind[i], same[i] = LETTER | (UPPER if "A" <= c <= "Z" else 0), ord(low) if len(low) == 1 else i
        elif c.isdecimal():
            kind[i] = DIGIT
        elif c == "\n":
            kind[i] = NEWLINE
        elif c.isspace() or c == "‌":
            kind[i] = SPACE
    for flag, members in ((STOP, STOPS), (ODD, odd), (CELL, CELLS), (BULLET, BULLETS + DASHES), (DASH, DASHES), (CLOSING, CLOSINGS), (COMMA, ","), (AFTER_NUMBER, ".):-")):
        for c in members:
            kind[ord(c)] |= flag
    for c in INVISIBLE:
        kind[ord(c)] = GONE
    kind[-1] = BULLET  # pictures
    return kind, same


_powers = [np.ones(1, "uint64"), np.ones(1, "uint64")]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the multiplier, and of its inverse, modulo 2 ** 64."""
    if len(_powers[0]) < n:
        for k, m in enumerate((_MULTIPLIER, pow(_MULTIPLIER, -1, 1 << 64))):
            x = np.full(2 * n, m, "uint64")
            x[0] = 1
            _powers[k] = np.multiply.accumulate(x)
    return _powers[0][:n], _powers[1][:n]


def _hashes(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of each stretch of ``values``, the same wherever it stands."""
    power, inverse = _power(len(values) + 1)
    upto = np.concatenate([np.zeros(1, "uint64"), np.cumsum(values * power[: len(values)], dtype="uint64")])
    return (upto[end] - upto[start]) * inverse[start]


def word_hashes(words: list[str]) -> np.ndarray:
    """The hashes of single words, sorted."""
    _, same = _tables()
    codes = [np.array([same[min(ord(c), 0xFFFF)] for c in w], "uint64") for w in words if w]
    return np.unique(np.array([_hashes(c, np.array([0]), np.array([len(c)]))[0] for c in codes], "uint64"))


def _again(key: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Whether a key stood before in the same text."""
    mixed = (key ^ (key >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9) + of.astype("uint64") * np.uint64(0x94D049BB133111EB)
    order = np.argsort(mixed, kind="stable")
    again = np.zeros(len(key), bool)
    again[order[1:]] = mixed[order[1:]] == mixed[order[:-1]]
    return again


def _measure(texts: pa.Array, common: np.ndarray) -> np.ndarray:
    """The statistics of texts that are measured together; none is null."""
    size = pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype("int64")
    out = np.zeros((len(size), len(STATISTICS)))
    code = np.frombuffer("".join(texts.to_pylist()).encode("utf-32-le", "replace"), "uint32")
    if not len(code):
        return out
    table, same = _tables()
    small = np.minimum(code, 0xFFFF)
    kind = table[small]
    n = len(code)
    doc_end = np.cumsum(size)
    last = np.zeros(n, bool)  # of a text
    last[doc_end[size > 0] - 1] = True
    first = np.r_[True, last[:-1]]
    is_ = lambda flag: (kind & flag) != 0
    after = lambda mask, end=False: np.where(last, end, np.r_[mask[1:], False])
    before = lambda mask: np.where(first, False, np.r_[False, mask[:-1]])
    letter, digit, space, newline, stop = map(is_, (LETTER, DIGIT, SPACE, NEWLINE, STOP))
    blank = space | newline | is_(GONE)
    # words
    w_start, w_end = np.flatnonzero(letter & ~before(letter)), np.flatnonzero(letter & ~after(letter)) + 1
    words = _hashes(same[small], w_start, w_end)
    known = common[np.minimum(np.searchsorted(common, words), len(common) - 1)] == words if len(common) else np.zeros(len(words), bool)
    # sentences end after a stop that blanks, the end or a closing sign follow, and with their line
    ends_sentence = stop & after(blank | is_(CLOSING), True)
    end = np.flatnonzero(newline | last | ends_sentence) + 1
    start = np.r_[0, end[:-1]]
    doc = np.searchsorted(doc_end, start, "right")
    count = lambda mask: np.add.reduceat(mask, start, dtype="int64")
    shown, chars, spaces = count(~blank), count(~newline), count(space)
    numbers, gaps = count(digit & ~before(digit)), count(space & before(space) & ~before(before(space)))
    cells = count(is_(CELL) | is_(COMMA) & ~after(blank, True))
    n_digits, n_letters, n_odd, n_upper = count(digit), count(letter), count(is_(ODD)), count(is_(UPPER))
    at = np.searchsorted(end, w_start, "right")
    own, common_ = np.bincount(at, minlength=len(end)), np.bincount(at[known], minlength=len(end))
    stopped = ends_sentence[end - 1]
    key = _hashes(words, np.cumsum(own) - own, np.cumsum(own))
    again = _again(key, doc) & (own > 0)
    # lines
    closes = newline[end - 1] | last[end - 1]
    l_last = np.flatnonzero(closes)
    l_first = np.r_[0, l_last[:-1] + 1]
    per_line = lambda x: np.add.reduceat(x, l_first)
    line = np.cumsum(closes) - closes
    l_doc, l_shown, l_chars, l_spaces, l_own, l_common = doc[l_first], *map(per_line, (shown, chars, spaces, own, common_))
    full = l_shown > 0
    seen = np.r_[np.flatnonzero(~blank), n]
    head = np.minimum(seen[np.minimum(np.searchsorted(seen, start[l_first]), len(seen) - 1)], n - 1)
    tail = seen[np.maximum(np.searchsorted(seen, end[l_last]) - 1, 0)] if len(seen) > 1 else head
    tail = np.minimum(tail, n - 1)
    then = lambda p, k: kind[np.minimum(p + k, n - 1)]
    marks = np.where((then(head, 1) & BULLET) != 0, 2, 1)
    item = ((kind[head] & BULLET) != 0) & ((then(head, marks) & (SPACE | NEWLINE)) != 0)
    no_digit = np.r_[np.flatnonzero(~digit), n]
    run = no_digit[np.minimum(np.searchsorted(no_digit, head), len(no_digit) - 1)] - head
    numbered = (run >= 1) & (run <= 3) & ((then(head, run) & AFTER_NUMBER) != 0) & ((then(head, run + 1) & SPACE) != 0)
    dash = item & ((kind[head] & DASH) != 0)
    bullet = (item | numbered) & full
    l_cells, l_gaps, l_numbers, l_digits = map(per_line, (cells, gaps, numbers, n_digits))
    row = ((l_cells >= 2) & (l_spaces <= 8 * l_cells)) | (l_gaps >= 2) | ((l_numbers >= 2) & (l_numbers >= 0.3 * (l_spaces + 1))) | (l_digits >= np.maximum(4, 0.25 * l_chars))
    row &= full
    listed = bullet & ~dash & ~row
    ends_stop = (kind[tail] & STOP) != 0
    # text goes over line ends where the line is long and does not end a sentence: lines that are read on are one stretch
    goes_on = (full & ~row & ~listed & (l_spaces >= 5) & (l_chars >= 30) & ~ends_stop)[full]
    follows = np.zeros(len(full), bool)
    follows[full] = np.r_[False, goes_on[:-1]][: full.sum()] & ~(row | listed)[full] & (l_doc[full] == np.r_[-1, l_doc[full][:-1]][: full.sum()])
    stretch = np.cumsum(full & ~follows)
    of_stretch = lambda x: np.bincount(stretch, x, minlength=stretch[-1] + 1)
    s_own, s_common, s_lines = of_stretch(l_own), of_stretch(l_common), of_stretch(full)
    fluent = (s_common >= np.maximum(1, 0.04 * s_own)) & (s_common <= 0.65 * s_own)
    place, mine = np.arange(len(end)), stretch[line]
    stop_at = np.full(len(fluent), -1)
    np.maximum.at(stop_at, mine[stopped], place[stopped])
    rest = place > stop_at[mine]  # what follows the last sentence, or all where there is none
    rest_spaces = np.bincount(mine, spaces * rest, minlength=len(fluent))
    long = np.where(stop_at >= 0, rest_spaces >= 9, of_stretch(l_spaces + full) >= 9 * s_lines) & (s_common >= np.maximum(1, 0.08 * s_own))
    inside = np.r_[False, ~stopped[:-1] & (mine[1:] == mine[:-1])]
    # running text: sentences that were not said before in a fluent stretch, and long lines without sentences
    said = stopped & (inside | (spaces >= np.where(dash[line], 5, 2))) | ~stopped & ~rest
    running = chars * (fluent[mine] & ~(row | listed)[line] & ~again & (said | rest & long[mine] & ~dash[line]))
    per_doc = lambda x, at=l_doc: np.bincount(at, x, minlength=len(size))
    total, n_shown, n_lines, n_words = np.maximum(per_doc(chars, doc), 1), np.maximum(per_doc(shown, doc), 1), np.maximum(per_doc(full), 1), per_doc(own, doc)
    letters = per_doc(n_letters, doc)
    w_doc = doc[at]
    distinct = per_doc(~_again(words, w_doc), w_doc)
    of = {
        "n_chars": size, "n_words": n_words, "n_lines": per_doc(full), "mean_word_length": letters / np.maximum(n_words, 1), "digit_ratio": per_doc(n_digits, doc) / n_shown,
        "letter_ratio": letters / n_shown, "punctuated_lines": per_doc(full & ((kind[tail] & CLOSING) != 0)) / n_lines, "common_words": per_doc(common_, doc) / np.maximum(n_words, 1),
        "bullet_lines": per_doc(bullet) / n_lines, "cell_lines": per_doc(row) / n_lines, "words_a_line": n_words / n_lines, "distinct_words": distinct / np.maximum(n_words, 1),
        "repeated_share": per_doc(chars * again, doc) / total, "odd_ratio": per_doc(n_odd, doc) / n_shown, "stops_a_word": per_doc(stopped, doc) / np.maximum(n_words, 1),
        "commonless_share": per_doc(l_chars * ((l_own >= 3) & (l_common == 0))) / total, "upper_ratio": per_doc(n_upper, doc) / np.maximum(letters, 1), "bullet_share": per_doc(l_chars * listed) / total,
        "cell_share": per_doc(l_chars * row) / total, "short_share": per_doc(l_chars * (full & ~row & ~listed & (l_own < 6) & ~follows)) / total, "sentence_share": per_doc(running, doc) / total,
    }
    of["symbol_ratio"] = np.maximum(0.0, 1 - of["digit_ratio"] - of["letter_ratio"])
    some = per_doc(shown, doc) > 0
    for k, name in enumerate(STATISTICS):
        out[:, k] = np.where(some, of[name], 0.0)
    return out


def statistics(texts: pa.Array, common: np.ndarray) -> np.ndarray:
    """One row of :data:`STATISTICS` for each text. ``common`` is a result of :func:`word_hashes`."""
    texts = texts.cast(pa.string()).fill_null("")
    size = np.cumsum(pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype("int64"))
    parts, lo = [np.empty((0, len(STATISTICS)))], 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(size, (size[lo - 1] if lo else 0) + _AT_ONCE, "right")))
        parts.append(_measure(texts.slice(lo, hi - lo), common))
        lo = hi
    return np.concatenate(parts)


def with_statistics(documents: DataFrame, common: set[str]) -> DataFrame:
    """``doc_id`` and the columns of :data:`STATISTICS` for every row."""
    names, hashes = list(STATISTICS), word_hashes(sorted(common))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = statistics(b.column("text"), hashes)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(x[:, k]) for k in range(len(names)))], ["doc_id", *names])

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, " + ", ".join(f"{n} double" for n in names))


def common_words_of(table: DataFrame) -> set[str]:
    """The words of the table in consistent form and lower case, those of all languages together."""
    rows = table.select("word").dropna().distinct().limit(COMMON_LIMIT + 1).collect()
    if len(rows) > COMMON_LIMIT:
        raise ValueError(f"more than {COMMON_LIMIT} common words")
    return {consistent_form(r.word).lower() for r in rows}


def votes(x: np.ndarray) -> np.ndarray:
    """What each of five rules says of rows of statistics: 1 prose, -1 list, table or junk, 0 nothing.

    They look at sentences, markup, function words, repetition and wrong characters, and the flow of lines.
    """
    of = dict(zip(STATISTICS, x.T))
    vote = lambda prose, junk: np.where(junk, -1, np.where(prose, 1, 0))
    markup, flows = of["bullet_share"] + of["cell_share"], of["words_a_line"] >= 9
    return np.stack([
        vote(of["sentence_share"] > 0.6, of["sentence_share"] < 0.4),
        vote(markup < 0.3, markup > 0.5),
        vote((of["common_words"] > 0.04) & (of["common_words"] < 0.65), (of["common_words"] < 0.01) | (of["common_words"] > 0.7) | (of["commonless_share"] > 0.6)),
        vote(False, (of["repeated_share"] > 0.5) | (of["odd_ratio"] > 0.15)),
        vote((of["short_share"] < 0.3) & (flows | (of["stops_a_word"] > 0.02)), (of["short_share"] > 0.5) | ~flows & (of["stops_a_word"] < 0.01)),
    ], 1)


def weak_labels(x: np.ndarray) -> np.ndarray:
    """1 where three rules say prose and none objects, 0 where two say it is none, else NaN."""
    v = votes(x)
    return np.where((v < 0).sum(1) >= 2, 0.0, np.where(((v > 0).sum(1) >= 3) & ~(v < 0).any(1), 1.0, np.nan))


@dataclass
class ProseModel:
    """Boosted trees and the calibration of their score."""

    trees: BoostedTrees
    slope: float
    offset: float

    @staticmethod
    def fit(x: np.ndarray) -> ProseModel | None:
        """From statistics of texts in random order; None where the weak labels do not show both kinds."""
        y = weak_labels(x)
        sure = np.flatnonzero(~np.isnan(y))
        held, seen = sure[::3], np.setdiff1d(sure, sure[::3])
        if not all(0 < y[part].sum() < len(part) for part in (held, seen)):
            return None
        trees = BoostedTrees(columns=0.4).fit(_features(x[seen]), y[seen])
        scale = Logistic().fit(trees.score(_features(x[held]))[:, None], y[held])
        slope = float(scale.weights[0] / scale.scale[0])
        return ProseModel(trees, slope, float(scale.weights[1] - slope * scale.mean[0]))

    def probability(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.slope * self.trees.score(_features(x)) + self.offset)


def _features(x: np.ndarray) -> np.ndarray:
    return x[:, [STATISTICS.index(f) for f in FEATURES]]


def fit_prose_model(measured: DataFrame, train_documents: int = 10_000) -> ProseModel | None:
    """From at most ``train_documents`` rows of :func:`with_statistics`, chosen by the hash of their id."""
    rows = hash_sample(measured.where("n_chars > 0"), "doc_id", train_documents).select(*STATISTICS).toPandas()
    return ProseModel.fit(rows.to_numpy("float64"))


def judge(measured: DataFrame, model: ProseModel | None) -> DataFrame:
    """``measured`` with ``prose_probability`` and ``is_prose``. Without a model the majority of the votes decides."""
    names = list(STATISTICS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.stack([b.column(n).to_numpy(zero_copy_only=False) for n in names], 1) if b.num_rows else np.empty((0, len(names)))
            p = model.probability(x) if model else (votes(x).sum(1) > 0).astype(float)
            p = np.where((x[:, 0] > 0) & (x[:, names.index("letter_ratio")] + x[:, names.index("symbol_ratio")] + x[:, names.index("digit_ratio")] > 0), p, 0.0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(p), pa.array(p >= 0.5)], [*b.schema.names, "prose_probability", "is_prose"])

    fields = ", ".join(f"{n} {t}" for n, t in measured.dtypes)
    return measured.mapInArrow(run, f"{fields}, prose_probability double, is_prose boolean")


def text_quality(documents: DataFrame, common_words: DataFrame, train_documents: int = 10_000) -> DataFrame:
    """``doc_id``, the statistics, ``prose_probability`` and ``is_prose`` of every document."""
    measured = materialize(with_statistics(documents, common_words_of(common_words)), "text-statistics")
    return judge(measured, fit_prose_model(measured, train_documents))
