"""Text expressions. All run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def squeezed(c: Column) -> Column:
    """Runs of Unicode white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def normalise_phrase(c: Column) -> Column:
    """Arabic yeh and kaf as Persian ones, U+200C as a space, white space squeezed; null becomes the empty string."""
    return squeezed(F.translate(F.coalesce(c, F.lit("")), "يك‌", "یک "))


def strip_punctuation(c: Column) -> Column:
    """Letters, digits, marks, connectors and white space only, with Persian yeh and kaf."""
    return F.translate(F.regexp_replace(c, r"(?U)[^\w\s]", ""), "يك", "یک")


def label_key(c: Column) -> Column:
    """What two spellings of a label share: normalised, lower case, ``_`` as a space."""
    return F.trim(F.translate(F.lower(normalise_phrase(c)), "_", " "))


def text_of(tokens: str | Column) -> Column:
    """The tokens joined by one space; empty where there are none."""
    return F.concat_ws(" ", tokens)


def epoch_seconds(dt: str | Column) -> Column:
    """Seconds since the epoch, of a timestamp without time zone read as UTC."""
    return F.unix_micros(F.to_utc_timestamp(F.col(dt).cast("timestamp") if isinstance(dt, str) else dt.cast("timestamp"), F.current_timezone())) / 1e6


def joined_nonempty(parts: str | Column, by: str = " ") -> Column:
    """The members that are neither null nor empty, joined."""
    return F.array_join(F.filter(parts, lambda x: x != ""), by)
