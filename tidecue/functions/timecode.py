"""Times of cues as expressions; a time is a whole number of milliseconds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def format_ms(ms: Column) -> Column:
    """HH:MM:SS,mmm; negative times are 0; hours may take more than two digits."""
    t = F.greatest(F.lit(0).cast("long"), ms.cast("long"))
    return F.format_string("%02d:%02d:%02d,%03d", F.floor(t / 3600000), F.floor(t / 60000) % 60, F.floor(t / 1000) % 60, t % 1000)


def format_seconds(seconds: Column) -> Column:
    """HH:MM:SS,mmm of a double, rounded half to even."""
    return format_ms(F.rint(seconds * 1000).cast("long"))


def parse_ms(text: Column) -> Column:
    """Milliseconds of [HH:]MM:SS[.,]mmm or plain seconds; null if it is no time."""
    t = F.split(F.replace(F.trim(text), F.lit(","), F.lit(".")), ":")
    part = lambda k: F.try_element_at(t, F.lit(k)).try_cast("double")
    seconds = part(-1) + F.when(F.size(t) > 1, part(-2) * 60).otherwise(0) + F.when(F.size(t) > 2, part(-3) * 3600).otherwise(0)
    return F.when(F.size(t) <= 3, F.rint(seconds * 1000).cast("long"))


def duration_display(seconds: Column) -> Column:
    """H:MM:SS, or MM:SS under an hour; fractions are cut off."""
    s = F.floor(seconds).cast("long")
    long = F.format_string("%d:%02d:%02d", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60)
    return F.when(s >= 3600, long).otherwise(F.format_string("%02d:%02d", F.floor(s / 60), s % 60))


def file_size(n: Column) -> Column:
    """Bytes as B, KB, MB, GB, TB or PB with one decimal, rounded half to even."""
    out = None
    for k, unit in enumerate(("B", "KB", "MB", "GB", "TB")):
        shown = F.format_string("%.1f " + unit, F.bround(n / float(1024**k), 1))
        out = F.when(n < 1024 ** (k + 1), shown) if out is None else out.when(n < 1024 ** (k + 1), shown)
    return out.otherwise(F.format_string("%.1f PB", F.bround(n / float(1024**5), 1)))


def shifted(ms: Column, offset: Column) -> Column:
    return F.greatest(F.lit(0).cast("long"), ms - offset)


def seconds_of(text: Column) -> Column:
    """Seconds of [[HH:]MM:]SS[.mmm] with whole hours and minutes; null if it is no such time, as with a comma."""
    t = F.split(F.trim(text), ":")
    whole = lambda k: F.try_element_at(t, F.lit(k)).try_cast("long")
    last = F.try_element_at(t, F.lit(-1)).try_cast("double")
    return F.when(F.size(t) == 3, whole(1) * 3600 + whole(2) * 60 + last).when(F.size(t) == 2, whole(1) * 60 + last).when(F.size(t) == 1, last)


def seconds_text(seconds: Column, *, hours: bool = True, comma: bool = False) -> Column:
    """HH:MM:SS.mmm of seconds, or MM:SS.mmm under an hour without ``hours``; the seconds are rounded by themselves and may show as 60.000."""
    h, m = F.floor(seconds / 3600).cast("long"), F.floor(F.pmod(seconds, F.lit(3600.0)) / 60).cast("long")
    rest = F.format_string("%06.3f", F.bround(F.pmod(seconds, F.lit(60.0)), 3))
    whole = F.concat(F.format_string("%02d:%02d:", h, m), rest)
    text = whole if hours else F.when(h > 0, whole).otherwise(F.concat(F.format_string("%02d:", m), rest))
    return F.replace(text, F.lit("."), F.lit(",")) if comma else text


def time_range(text: Column) -> Column:
    """(start, end) in seconds of a range like 00:00 - 03:15; an error if it has another form or ends before it starts."""
    parts = F.split(F.replace(text, F.lit(" "), F.lit("")), "-")
    bounds = F.struct(seconds_of(F.get(parts, F.lit(0))).alias("start"), seconds_of(F.get(parts, F.lit(1))).alias("end"))
    valid = F.coalesce((F.size(parts) == 2) & (bounds["start"] < bounds["end"]), F.lit(False))
    return F.when(valid, bounds).otherwise(F.raise_error(F.concat(F.lit("Invalid time range: "), text)).cast("struct<start:double,end:double>"))
