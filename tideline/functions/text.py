"""String and time formats as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tideline.params import SHAPES, GradeThresholds


def stripped(text: Column) -> Column:
    """Text without leading and trailing white space of any script."""
    return F.regexp_replace(text, "(?U)^[\\s\\x1c-\\x1f]+|[\\s\\x1c-\\x1f]+$", "")


def media_time(ms: Column) -> Column:
    """HH:MM:SS.mmm; hours may pass 24."""
    ms = ms.cast("bigint")
    return F.format_string("%02d:%02d:%02d.%03d", F.floor(ms / 3600000), F.floor(ms / 60000) % 60, F.floor(ms / 1000) % 60, ms % 1000)


def clock(seconds: Column) -> Column:
    """HH:MM:SS of a number of seconds; below 0 counts as 0."""
    s = F.greatest(F.floor(seconds), F.lit(0)).cast("bigint")
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60)


def safe_name(text: Column) -> Column:
    """A folder name: what is neither letter, digit, space, nor one of _ - . becomes an underscore."""
    return F.regexp_replace(text, "[^\\p{L}\\p{N} _.\\-]", "_")


def recorder_start_ms(name: Column) -> Column:
    """Epoch milliseconds that a recorder's file name starts with (yyyy-MM-dd-HH-mm-ss-SSS, session time zone), else null."""
    stamp = F.regexp_extract(name, "^(\\d{4}-\\d{2}-\\d{2}-\\d{2}-\\d{2}-\\d{2})-(\\d{3})", 1)
    ms = F.regexp_extract(name, "^(\\d{4}-\\d{2}-\\d{2}-\\d{2}-\\d{2}-\\d{2})-(\\d{3})", 2)
    at = F.try_to_timestamp(F.when(stamp != "", stamp), F.lit("yyyy-MM-dd-HH-mm-ss"))
    return F.unix_millis(at) + F.when(ms != "", ms).cast("int")


def shape(duration: Column) -> Column:
    """The kind of interval by its duration in seconds."""
    out = F.lit(SHAPES[-1][0])
    for name, below in reversed(SHAPES[:-1]):
        out = F.when(duration < below, name).otherwise(out)
    return out


def grade(score: Column, t: GradeThresholds = GradeThresholds()) -> Column:
    return F.when(score >= t.s, "S").when(score >= t.a, "A").when(score >= t.b, "B").when(score >= t.c, "C").otherwise("")


def percent(part: Column, whole: Column) -> Column:
    """A whole-number percentage, half to even; -- without a whole."""
    return F.when(whole > 0, F.concat(F.bround(part / whole * 100, 0).cast("bigint").cast("string"), F.lit("%"))).otherwise("--")
