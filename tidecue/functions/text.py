"""Text functions of cues as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def stripped(text: Column) -> Column:
    """Without white space at both ends, in the Unicode sense."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def for_compare(text: Column) -> Column:
    """White space squeezed, trimmed, lower case."""
    return F.lower(stripped(F.regexp_replace(text, r"(?U)\s+", " ")))


def normal_token(token: Column) -> Column:
    """Lower case without marks at both ends, but for apostrophes; a token of marks only stays as it is."""
    low = F.lower(token)
    return F.coalesce(F.nullif(F.regexp_replace(low, r"(?U)^[^\w']+|[^\w']+$", ""), F.lit("")), low)


def without_tags(text: Column, instead: str = " ") -> Column:
    return F.regexp_replace(text, "<[^>]+>", instead)


def file_name(name: Column, most: int = 100) -> Column:
    """A name that file systems take: illegal characters and spaces to one underscore, cut before its extension."""
    clean = F.regexp_replace(name, r'[<>:"/\\|?*\x00-\x1f]', "_")
    clean = F.regexp_replace(F.regexp_replace(clean, r"^[. ]+|[. ]+$", ""), " ", "_")
    clean = F.regexp_replace(clean, "_+", "_")
    extension = F.regexp_extract(clean, r"(\.[^.]*)$", 1)
    cut = F.concat(F.substring(clean, F.lit(1), F.lit(most) - F.length(extension)), extension)
    return F.when(F.length(clean) > most, cut).otherwise(clean)


def redacted(url: Column) -> Column:
    """User information before the last @ of an address is hidden."""
    return F.regexp_replace(url, r"^([A-Za-z][A-Za-z0-9+.-]*://)[^/?#]*@", "$1<redacted>@")


def unfenced(text: Column) -> Column:
    """The inside of a code fence, if the whole text is one with no language or json."""
    whole = stripped(text)
    inside = F.regexp_extract(whole, r"(?s)^```(?:json)?\n(.*)\n```$", 1)
    return F.when(whole.rlike(r"(?s)^```(?:json)?\n(.*)\n```$"), inside).otherwise(whole)


def preview(text: Column, most: int = 80) -> Column:
    """One line without control characters, at most ``most`` characters."""
    line = stripped(F.regexp_replace(F.regexp_replace(text, r"(?U)[\p{C}&&[^\s]]", ""), r"(?U)\s+", " "))
    return F.when(F.length(line) > most, F.concat(F.substring(line, 1, most - 3), F.lit("..."))).otherwise(line)


def path_part(value: Column, fallback: str) -> Column:
    """Lower case with anything but word characters, points and hyphens as one underscore, none at the ends."""
    clean = F.regexp_replace(F.lower(stripped(value)), r"(?U)[^\w.-]+", "_")
    return F.coalesce(F.nullif(F.regexp_replace(clean, r"^[._]+|[._]+$", ""), F.lit("")), F.lit(fallback))


def video_folder(extractor: Column, key: Column, video_id: Column) -> Column:
    """The name of a video's folder: where it comes from and its id."""
    blank = lambda c: F.nullif(c.cast("string"), F.lit(""))
    origin = F.coalesce(blank(extractor), blank(key), F.lit("video"))
    return F.concat(path_part(origin, "video"), F.lit("_"), path_part(F.coalesce(blank(video_id), F.lit("unknown")), "unknown"))


def safe_message(message: Column, proxy: str | None = None) -> Column:
    """An error message without the proxy's address and without user information of any address."""
    text = F.replace(message, F.lit(proxy), F.lit("<redacted-proxy>")) if proxy else message
    text = F.regexp_replace(text, r"(?i)([a-z][a-z0-9+.-]*://)[^/\s]+@", "$1<redacted-proxy>@")
    return F.regexp_replace(text, r"(?U)(?<![\w/:])[^\s/@:]+:[^\s/]+@", "<redacted-userinfo>@")


def is_video_url(url: Column) -> Column:
    """Whether an address begins like one of the three forms of a video's page; what follows doesn't matter."""
    # The forms.
    forms = (r"https?://(?:www\.)?youtube\.com/watch\?v=[\w-]+", r"https?://(?:www\.)?youtu\.be/[\w-]+", r"https?://(?:www\.)?youtube\.com/embed/[\w-]+")
    return url.rlike(r"(?U)\A(?:" + "|".join(forms) + ")")


def is_provider_url(url: Column) -> Column:
    """Whether an address has the scheme http or https and a host."""
    return url.rlike(r"(?i)\Ahttps?://[^/?#]+")


def subtitle_format(path: Column) -> Column:
    """srt or vtt by the end of the name in any case; another end is an error."""
    kind = F.regexp_extract(F.lower(path), r"\.(srt|vtt)$", 1)
    return F.when(kind != "", kind).otherwise(F.raise_error(F.concat(F.lit("unsupported subtitle format: "), path)).cast("string"))


def progress_bar(done: Column, total: Column, width: int = 30) -> Column:
    """A bar and the percentage with one decimal; null without a total."""
    filled = F.floor(width * done / F.nullif(total, F.lit(0))).cast("int")
    bar = F.concat(F.lit("["), F.repeat(F.lit("#"), filled), F.repeat(F.lit("-"), width - filled), F.lit("] "))
    return F.concat(bar, F.format_string("%.1f%%", F.bround(done * 100.0 / F.nullif(total, F.lit(0)), 1)))


def truth(text: Column) -> Column:
    """1, true, yes, on and 0, false, no, off in any case; anything else is an error."""
    low = F.lower(stripped(text))
    return F.when(low.isin("1", "true", "yes", "on"), True).when(low.isin("0", "false", "no", "off"), False).otherwise(F.raise_error(F.concat(F.lit("invalid boolean value: "), text)).cast("boolean"))
