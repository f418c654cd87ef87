"""Scalar functions as column expressions, all inside code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def stripped(text: Column) -> Column:
    """Without white space at both ends, line feeds and tabs included (``trim`` takes blanks only)."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def slug(text: Column) -> Column:
    """Lower-cased; only a-z, 0-9, blanks and hyphens stay; runs of white space become one hyphen; no hyphens at the ends."""
    plain = F.regexp_replace(F.lower(text), r"[^a-z0-9\s-]", "")
    return F.btrim(F.regexp_replace(plain, r"\s+", "-"), F.lit("-"))


def seconds(text: Column, strict: bool = False) -> Column:
    """``SS``, ``MM:SS`` or ``HH:MM:SS`` as seconds; all but the last part are whole numbers.

    Null or blank is null, unless ``strict``; anything else that is no time raises.
    """
    t = stripped(text)
    parts = F.split(t, ":")
    n = F.size(parts)
    part = lambda i: F.trim(F.try_element_at(parts, F.lit(i)))
    whole = lambda i: F.when(part(i).rlike(r"^[+-]?[0-9]+$"), part(i).try_cast("bigint"))
    last = part(-1).try_cast("double")
    value = F.when(n == 1, last).when(n == 2, whole(1) * 60 + last).when(n == 3, whole(1) * 3600 + whole(2) * 60 + last)
    bad = F.raise_error(F.concat(F.lit("no time: "), F.coalesce(text, F.lit("null")))).cast("double")
    blank = text.isNull() | (t == "")
    return F.when(blank, bad if strict else F.lit(None).cast("double")).otherwise(F.coalesce(value, bad))


def vtt_time(sec: Column) -> Column:
    """``HH:MM:SS.mmm``; rounded to milliseconds first, so 59.9996 carries into the minute."""
    ms = F.round(sec * 1000).cast("bigint")
    return F.format_string("%02d:%02d:%02d.%03d", F.floor(ms / 3600000), F.floor(ms / 60000) % 60, F.floor(ms / 1000) % 60, ms % 1000)


def caption_source(path: Column) -> Column:
    """``none`` without captions, ``whisper`` for a transcribed file, else ``youtube``."""
    name = F.element_at(F.split(path, "/"), -1)
    return F.when(path.isNull(), "none").when(F.contains(name, F.lit("whisper")), "whisper").otherwise("youtube")


def hamming(a: Column, b: Column) -> Column:
    """Number of differing bits of two 64-bit hashes."""
    return F.bit_count(a.bitwiseXOR(b))


def slot(t: Column) -> Column:
    """The tenth of a second that a time falls on."""
    return F.round(t, 1)


def yes_no(flag: Column) -> Column:
    return F.when(flag, "true").otherwise("false")


def frame_name(t: Column) -> Column:
    """File name of the frame at a time."""
    return F.format_string("frame_%08.2f.jpg", t)
