"""Rules that find suspicious translations: one boolean expression each, over a source and its translation."""

from __future__ import annotations

import functools

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidecue.functions.text import stripped

# Patterns and words whose matches decide a rule.
URL = r"(?U)https?://\S+"
NUMBER = r"(?U)\d+(?:\.\d+)?"
OPTION = r"(?U)--[\w-]+"
ENV_VAR = r"(?U)(?<!\w)[A-Z][A-Z0-9_]{2,}(?!\w)"
TAG = r"(?U)</?[^>\s]+(?:\s+[^>]*)?>"
WINDOWS_PATH = r"(?U)[A-Za-z]:\\[^\s]+"
POSIX_PATH = r"(?U)(?<![A-Za-z0-9])/(?:[\w.-]+/)+[\w.-]+"
NUMBER_UNIT = r"(?iU)(\d+(?:\.\d+)?)\s*(ms|millisecond(?:s)?|sec(?:ond)?(?:s)?|s|minute(?:s)?|hour(?:s)?|gb|mb|kb|tb|px|fps|hz|khz|mhz|ghz|%|x|毫秒|秒|分钟|小时)"
CODE_TOKEN = r"(?U)(?<!\w)(?:[A-Za-z]:\\[^\s]+|[\w./-]+\.(?:py|js|ts|json|md|srt|vtt|txt|yaml|yml)|--[\w-]+|[A-Z_]{2,}|[a-zA-Z_][\w-]*\([^)]*\)|`[^`]+`)(?!\w)"
REFUSALS = ("as an ai", "i'm sorry", "i am sorry", "i cannot", "我不能", "作为ai", "作为 ai")
POLLUTIONS = ("translation:", "translated:", "explanation:", "note:", "here is")
TECHNICAL = ("ffmpeg", "codec", "api", "json", "yaml", "python", "cli", "subtitle", "script", "command", "token")
BRACKETS = ("()", "[]", "{}", "（）", "【】")
UNITS = {"ms": ("ms", "millisecond", "milliseconds", "毫秒"), "s": ("s", "sec", "second", "seconds", "秒"), "min": ("minute", "minutes", "分钟"), "h": ("hour", "hours", "小时")}
SCRIPTS = {"zh": r"[\x{4e00}-\x{9fff}]", "zh-cn": r"[\x{4e00}-\x{9fff}]", "ja": r"[\x{4e00}-\x{9fff}\x{3040}-\x{30ff}]", "ko": r"[\x{ac00}-\x{d7a3}]"}


def _bag(text: Column, pattern: str) -> Column:
    return F.array_sort(F.regexp_extract_all(text, F.lit(pattern), 0))


def _count(text: Column, mark: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(mark), F.lit("")))


def empty(translation: Column) -> Column:
    return stripped(translation) == ""


def differ(source: Column, translation: Column, pattern: str) -> Column:
    """The matches in the source, if it has any, aren't those of the translation, in any order."""
    return (F.size(_bag(source, pattern)) > 0) & (_bag(source, pattern) != _bag(stripped(translation), pattern))


def tags_differ(source: Column, translation: Column) -> Column:
    return F.regexp_count(source, F.lit(TAG)) != F.regexp_count(stripped(translation), F.lit(TAG))


def brackets_differ(source: Column, translation: Column) -> Column:
    """Some kind of bracket that the source has differs by two or more."""
    out = F.lit(False)
    for pair in BRACKETS:
        a, b = (_count(x, pair[0]) + _count(x, pair[1]) for x in (source, stripped(translation)))
        out = out | ((a > 0) & (F.abs(a - b) >= 2))
    return out


def leaks_markup(translation: Column) -> Column:
    """A code fence, or a bracketed whole with the keys of an answer."""
    t = stripped(translation)
    return t.contains("```") | (t.rlike(r"(?s)^(?:\{.*\}|\[.*\])$") & (t.contains('"id"') | t.contains('"translation"')))


def refuses(translation: Column) -> Column:
    low = F.lower(translation)
    return functools.reduce(Column.__or__, (low.contains(x) for x in REFUSALS))


def polluted(translation: Column) -> Column:
    return F.lower(stripped(translation)).rlike("^(?:" + "|".join(POLLUTIONS) + ")")


def _units(text: Column) -> Column:
    """Each number with its unit under one spelling, in order of value."""
    names = F.create_map(*[F.lit(x) for name, spellings in UNITS.items() for s in spellings for x in (s, name)])
    unit = lambda u: F.coalesce(F.element_at(names, F.lower(u)), F.lower(u))
    found = [F.regexp_extract_all(text, F.lit(NUMBER_UNIT), k) for k in (1, 2)]
    return F.array_sort(F.zip_with(*found, lambda n, u: F.concat(n, F.lit(" "), unit(u))))


def units_differ(source: Column, translation: Column) -> Column:
    return (F.size(_units(source)) > 0) & (_units(source) != _units(stripped(translation)))


def paths_differ(source: Column, translation: Column) -> Column:
    paths = lambda text: F.array_sort(F.concat(*[F.regexp_extract_all(text, F.lit(p), 0) for p in (WINDOWS_PATH, POSIX_PATH)]))
    return (F.size(paths(source)) > 0) & (paths(source) != paths(stripped(translation)))


def _plain_url(text: Column) -> Column:
    return stripped(text).rlike(r"(?U)\Ahttps?://\S+\z")


def code_differs(source: Column, translation: Column) -> Column:
    return ~_plain_url(source) & differ(source, translation, CODE_TOKEN)


def _words(text: Column) -> Column:
    return F.regexp_count(text, F.lit("[A-Za-z]+"))


def _gate(source: Column) -> Column:
    """Prose long enough to compare lengths: no address, no command, 12 letters and ten words."""
    s = stripped(source)
    command = ~s.contains("\n") & s.rlike(r"(?U)\S\s+\S") & (s.rlike(r"(?U)(?:^|\s)--") | s.contains("/") | s.contains("\\"))
    return ~_plain_url(source) & ~command & (F.regexp_count(s, F.lit(r"\p{L}")) >= 12) & (_words(source) >= 10)


def lacks_script(source: Column, translation: Column, lang: str) -> Column:
    """A translation of prose into a language with a script of its own that has no character of it."""
    script = SCRIPTS.get(lang.lower())
    return _gate(source) & (_words(source) >= 8) & ~translation.rlike(script) if script else F.lit(False)


def too_short_technical(source: Column, translation: Column) -> Column:
    """The rule for short technical lines, which holds where the one for prose doesn't apply."""
    low = F.lower(source)
    technical = functools.reduce(Column.__or__, [source.rlike(CODE_TOKEN), source.rlike(NUMBER), *(low.contains(x) for x in TECHNICAL)])
    return ~_gate(source) & (_words(source) >= 5) & technical & (F.length(stripped(translation)) < F.greatest(F.lit(4.0), F.length(source) * 0.18))


def too_short(source: Column, translation: Column) -> Column:
    return _gate(source) & (F.length(stripped(translation)) < F.greatest(F.lit(8.0), F.length(source) * 0.18))


def too_long(source: Column, translation: Column) -> Column:
    return _gate(source) & (F.length(stripped(translation)) > F.greatest(F.lit(80.0), F.length(source) * 3.5))


def issues(source: Column, translation: Column, lang: str) -> Column:
    """All reasons to look at a pair, in a fixed order; an empty translation has that one alone.

    The stripped translation is made once, by an array around the pair; the rules read it from there.
    """
    pair = F.struct(source.alias("source"), stripped(translation).alias("translation"))
    return F.get(F.transform(F.array(pair), lambda p: _issues(p["source"], p["translation"], lang)), F.lit(0))


def _issues(source: Column, translation: Column, lang: str) -> Column:
    rules = {
        "json or markdown leak": leaks_markup(translation),
        "model refusal": refuses(translation),
        "polluted output": polluted(translation),
        "url count mismatch": differ(source, translation, URL),
        "numeric token mismatch": differ(source, translation, NUMBER),
        "unit token mismatch": units_differ(source, translation),
        "path token mismatch": paths_differ(source, translation),
        "option token mismatch": differ(source, translation, OPTION),
        "env var mismatch": differ(source, translation, ENV_VAR),
        "tag count mismatch": tags_differ(source, translation),
        "bracket count mismatch": brackets_differ(source, translation),
        "code token loss": code_differs(source, translation),
        "unusually short": too_short(source, translation) | too_short_technical(source, translation),
        "unusually expanded": too_long(source, translation),
        "missing target-language characters": lacks_script(source, translation, lang),
    }
    found = F.filter(F.array(*[F.when(t, F.lit(r)) for r, t in rules.items()]), lambda x: x.isNotNull())
    return F.when(empty(translation), F.array(F.lit("empty translation"))).otherwise(found)
