"""Problem 3: text that looks the same, in one consistent form.

Method: quick-check properties isolate the unstable segments of a string; only those are normalized, together with the
character before them (a mark composes with its letter) and the word around them (a look-alike counts as Latin only in a
word with Latin letters); the results are spliced into the unchanged text. The quick check is a regular expression that
Spark evaluates itself, so only strings that fail it cross to Python, in Arrow batches and once per distinct string.

The form: compatibility forms, ligatures and full-width characters become plain ones; a letter and its mark become one
character; digits of any kind become 0-9; invisible characters go; U+200C and every other space become one plain space,
none at the ends; Arabic-script look-alikes of the Persian letters become those; look-alikes of Latin letters become
Latin inside words that hold Latin letters. Case is kept. ``None`` stays ``None``, the empty string stays empty.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

# Characters that never change, whatever stands beside them (a part of all such; the rest is decided in
# Python). Plain ASCII, Latin-1 letters, the Arabic and Persian letters in plain code points, their punctuation, emoji.
STABLE = (
    r"\x21-\x7eÀ-ÖØ-öø-ÿ،؛؟ء-غفقل-و"
    r"پچژکگی✅➖•"
)
EMOJI_JAVA, EMOJI_PYTHON = r"\x{1f300}-\x{1f64f}", "\U0001f300-\U0001f64f"
#: In Java's syntax: the whole string is stable words with one plain space between them.
STABLE_JAVA = rf"^(?:[{STABLE}{EMOJI_JAVA}]++(?: [{STABLE}{EMOJI_JAVA}]++)*+)?$"
_STABLE = re.compile(rf"(?:[{STABLE}{EMOJI_PYTHON}]+(?: [{STABLE}{EMOJI_PYTHON}]+)*)?")
_SEGMENT = re.compile(rf"[{STABLE}{EMOJI_PYTHON}]?[^ {STABLE}{EMOJI_PYTHON}]+")

# Arabic-script letters that look like the Persian yeh, kaf and heh.
PERSIAN = {"ي": "ی", "ى": "ی", "ك": "ک", "ڪ": "ک", "ہ": "ه", "ە": "ه", "ھ": "ه"}
# Letter and mark for which Unicode has one character but no composition from the Persian letter.
PERSIAN_MARKED = {"یٔ": "ئ", "هٔ": "ۀ", "ۂ": "ۀ", "ۓ": "ئ"}
# Letters of other scripts that look like a Latin letter.
LATIN_LOOKALIKES = {
    "a": "аα", "b": "ь", "c": "сϲ", "d": "ԁ", "e": "е", "g": "ց", "h": "һհ", "i": "іιӏ", "j": "јϳ", "k": "кκ",
    "n": "ոη", "o": "оοօσ", "p": "рρ", "q": "ԛզ", "s": "ѕ", "t": "тτ", "u": "υս", "v": "νѵ", "w": "ԝω", "x": "хχ",
    "y": "уγү", "A": "АΑ", "B": "ВΒ", "C": "СϹ", "D": "Ꭰ", "E": "ЕΕ", "F": "Ϝ", "G": "Ԍ", "H": "НΗ", "I": "ІΙӀ",
    "J": "ЈͿ", "K": "КΚ", "M": "МΜ", "N": "Ν", "O": "ОΟՕ", "P": "РΡ", "S": "ЅՏ", "T": "ТΤ", "U": "Ս", "V": "Ѵ",
    "W": "Ԝ", "X": "ХΧ", "Y": "ҮΥ", "Z": "Ζ",
}
_TO_LATIN = {ord(c): latin for latin, others in LATIN_LOOKALIKES.items() for c in others}
_LOOKALIKE = re.compile("[" + "".join(map(chr, _TO_LATIN)) + "]")
_LATIN = re.compile(r"[A-Za-zªºÀ-ÖØ-öø-ɏḀ-ỿ]")
_FORMAT_SEEN = set("؀؁؂؃؄؅۝܏࣢")  # format characters that show
_UNSEEN = set("͏ᅟᅠ឴឵ㅤﾠ")  # other characters that show nothing


@lru_cache(1 << 14)
def _mapped(c: str) -> str:
    """One character after compatibility decomposition: digit, space, nothing, or a Persian letter."""
    kind = unicodedata.category(c)
    if c == "‌" or kind in ("Zs", "Zl", "Zp") or c in "\t\n\v\f\r\x1c\x1d\x1e\x1f\x85":
        return " "
    if kind == "Nd":
        return str(unicodedata.decimal(c))
    if kind == "Cc" or kind == "Cf" and c not in _FORMAT_SEEN or c in _UNSEEN or "︀" <= c <= "️" or "\U000e0100" <= c <= "\U000e01ef":
        return ""
    return PERSIAN.get(c, c)


def _normalized(segment: str) -> str:
    for _ in range(4):
        before = segment
        segment = unicodedata.normalize("NFC", "".join(map(_mapped, unicodedata.normalize("NFKC", segment))))
        for pair, one in PERSIAN_MARKED.items():
            segment = segment.replace(pair, one)
        if segment == before:
            break
    return segment


def consistent_form(s: str | None) -> str | None:
    """The consistent form of one string."""
    if s is None or _STABLE.fullmatch(s):
        return s
    s = _SEGMENT.sub(lambda m: _normalized(m[0]), s)
    words = s.split()
    for i, w in enumerate(words):
        if _LATIN.search(w) and _LOOKALIKE.search(w):
            words[i] = unicodedata.normalize("NFC", w.translate(_TO_LATIN))
    return " ".join(words)


def _fixed(values: pa.Array) -> pa.Array:
    """Each distinct string once."""
    coded = values.dictionary_encode()
    known = pa.array([consistent_form(x) for x in coded.dictionary.to_pylist()], pa.string())
    return known.take(coded.indices)


@arrow_udf(T.StringType())
def _fix_string(values: pa.Array) -> pa.Array:
    return _fixed(values.cast(pa.string()))


@arrow_udf(T.ArrayType(T.StringType()))
def _fix_array(values: pa.Array) -> pa.Array:
    flat = _fixed(values.flatten().cast(pa.string()))
    sizes = values.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype("int32")
    offsets = pa.array([0, *sizes.cumsum().tolist()], pa.int32())
    return pa.ListArray.from_arrays(offsets, flat, mask=values.is_null() if values.null_count else None)


def is_stable(c: Column) -> Column:
    """The quick check: true if the string is surely in consistent form; if false, Python decides."""
    return c.rlike(STABLE_JAVA)


def consistent(c: Column) -> Column:
    """The consistent form of a string column."""
    return F.when(is_stable(c), c).otherwise(_fix_string(F.when(~is_stable(c), c)))


def with_consistent_array(df: DataFrame, source: str, to: str | None = None) -> DataFrame:
    """``df`` with the members of the string array ``source`` in consistent form, as column ``to``.

    Null arrays stay null, empty ones empty, null members null. Only members that fail the quick check go to Python.
    """
    open_, fixed = f"__{source}_open", f"__{source}_fixed"
    df = df.withColumn(open_, F.filter(source, lambda t: ~is_stable(t)))
    df = df.withColumn(fixed, _fix_array(F.when(F.size(open_) > 0, F.col(open_))))
    at = lambda t: F.array_position(open_, t).cast("int")
    spliced = F.transform(source, lambda t: F.when(at(t) > 0, F.element_at(fixed, at(t))).otherwise(t))
    return df.withColumn(to or source, F.when(F.col(fixed).isNull(), F.col(source)).otherwise(spliced)).drop(open_, fixed)


def not_consistent(posts: DataFrame, store: DataFrame) -> DataFrame:
    """The strings of ``posts.tokens`` and ``store.triples`` that are not in consistent form, with that form.

    Returns ``(place, rec_id, pos, slot, value, consistent_value)``. A second delivery of a post adds nothing; null arrays
    and null members have no rows; other columns of the inputs are ignored.
    """
    tokens = posts.select(
        F.lit("token").alias("place"), F.col("pid").alias("rec_id"),
        F.explode(F.filter(F.transform("tokens", lambda t, i: F.struct(i.alias("pos"), F.lit(-1).alias("slot"), t.alias("value"))), lambda x: ~is_stable(x["value"]))).alias("x"),
    )
    none = F.array().cast("array<struct<pos:int,slot:int,value:string>>")
    slots = F.flatten(F.transform("triples", lambda m, i: F.coalesce(F.transform(m, lambda t, j: F.struct(i.alias("pos"), j.alias("slot"), t.alias("value"))), none)))
    triples = store.select(F.lit("triple").alias("place"), F.col("seq").alias("rec_id"), F.explode(F.filter(slots, lambda x: ~is_stable(x["value"]))).alias("x"))
    found = tokens.unionByName(triples).select("place", "rec_id", "x.*")
    found = found.withColumn("consistent_value", _fix_string("value")).where("value <> consistent_value")
    return found.dropDuplicates(["place", "rec_id", "pos", "slot"])
