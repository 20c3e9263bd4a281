"""Cues as a table: from subtitle text, and from tables whose lines stand for cues.

A cue is video_id, cue_index (dense from 1), source, start_ms, end_ms. One run holds any number of videos.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidecue.functions.text import stripped
from tidecue.functions.timecode import parse_ms

_TIME = r"(?:\d{2}:)?\d{2}:\d{2}[,.]\d{3}"
_GAP = r"[^\S\n]"
TIMING = rf"^\s*({_TIME})\s+-->\s+({_TIME})(.*)$"


def from_lines(table: DataFrame, video: str = "doc_id", text: str = "text") -> DataFrame:
    """Non-blank lines as cues, one every 2.5 s that lasts 2 s and a bit with its length. Nothing is shuffled."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")
    cues = table.select(F.col(video).alias("video_id"), F.posexplode(lines).alias("pos", "source"))
    start = F.col("pos").cast("long") * 2500
    return cues.select("video_id", (F.col("pos") + 1).cast("long").alias("cue_index"), "source", start.alias("start_ms"), (start + 2000 + F.length("source") % 1000).alias("end_ms"))


def from_turns(conversations: DataFrame) -> DataFrame:
    start = F.col("turn") * 2500
    return conversations.select(F.col("conv_id").alias("video_id"), (F.col("turn") + 1).alias("cue_index"), "role", F.col("text").alias("source"), start.alias("start_ms"), (start + 2000 + F.length("text") % 1000).alias("end_ms"))


def _unix_lines(content: Column) -> Column:
    """Without a byte-order mark, lines end in \n, blank lines are empty."""
    whole = F.regexp_replace(F.regexp_replace(content, r"^\x{feff}", ""), "\r\n?", "\n")
    return F.regexp_replace(whole, rf"(?md)^{_GAP}+$", "")


def _blocks(whole: Column) -> Column:
    """Runs of lines between empty lines, with their lines and the place of the first timing line (0: none)."""
    texts = F.filter(F.transform(F.split(whole, r"\n{2,}"), lambda b: F.regexp_replace(b, r"^\n+|\n+$", "")), lambda b: b != "")
    lines = F.transform(texts, lambda b: F.split(b, "\n"))
    return F.transform(lines, lambda x: F.struct(x.alias("lines"), F.array_position(F.transform(x, lambda y: y.rlike(TIMING)), F.lit(True)).cast("int").alias("at")))


def _body(block: Column) -> Column:
    """The text after the timing line, or the whole block if it has none."""
    return stripped(F.array_join(F.slice(block.lines, F.when(block["at"] > 0, block["at"] + 1).otherwise(1), F.size(block.lines)), "\n"))


def _to_cues(blocks: DataFrame, named: Column) -> DataFrame:
    """video_id, pos, block -> cues; ``named``: whether the line before the timing line is the cue's id."""
    at, lines = F.col("block.at"), F.col("block.lines")
    timing, before = stripped(F.get(lines, at - 1)), stripped(F.get(lines, at - 2))
    index = F.col("pos") + 1
    return blocks.select(
        "video_id",
        index.cast("long").alias("cue_index"),
        F.when(named & (before != ""), before).otherwise(index.cast("string")).alias("cue_id"),
        _body(F.col("block")).alias("source"),
        parse_ms(F.regexp_extract(timing, TIMING, 1)).alias("start_ms"),
        parse_ms(F.regexp_extract(timing, TIMING, 2)).alias("end_ms"),
        timing.alias("raw_timing"),
    )


def parse_srt(files: DataFrame, content: str = "content") -> DataFrame:
    """video_id and whole SRT text -> cues, by arrays within the row: blocks between blank lines, text after the timing.

    A block without a timing line, or without text, has null times or an empty source: see ``violations``.
    """
    rows = files.select("video_id", F.posexplode(_blocks(_unix_lines(F.col(content)))).alias("pos", "block"))
    return _to_cues(rows, (F.col("block.at") == 2) & stripped(F.col("block.lines")[0]).rlike(r"^(?U)\d+$"))


def parse_vtt(files: DataFrame, content: str = "content") -> DataFrame:
    """The same for WebVTT. Header, its metadata, notes, styles, regions and cues without text are dropped.

    One blank line right after a timing line doesn't end the cue. Any line before the timing line is the cue's id.
    """
    whole = F.regexp_replace(_unix_lines(F.col(content)), r"\AWEBVTT[^\n]*(?:\n|\z)", "")
    whole = F.regexp_replace(whole, rf"\A(?:{_GAP}*[A-Za-z][A-Za-z0-9-]*{_GAP}*:[^\n]*(?:\n|\z))+", "")
    whole = F.regexp_replace(whole, rf"(?md)^({_GAP}*{_TIME}{_GAP}+-->{_GAP}+{_TIME}[^\n]*)\n\n", "$1\n")
    kept = F.filter(_blocks(whole), lambda b: ~stripped(b.lines[0]).rlike(r"^(?:NOTE|STYLE|REGION)(?: |$)") & ((b["at"] == 0) | (_body(b) != "")))
    return _to_cues(files.select("video_id", F.posexplode(kept).alias("pos", "block")), F.col("block.at") > 1)


def parse_srt_lenient(files: DataFrame, content: str = "content") -> DataFrame:
    """SRT text as blocks between empty lines: number, time line and text as they stand; blocks under three lines are dropped."""
    blocks = F.filter(F.transform(F.split(stripped(F.col(content)), "\n\n"), lambda b: F.split(stripped(b), "\n")), lambda x: F.size(x) >= 3)
    rows = files.select("video_id", F.posexplode(blocks).alias("pos", "x"))
    return rows.select("video_id", F.col("pos").cast("long").alias("pos"), F.col("x")[0].alias("number"), F.col("x")[1].alias("time"), F.array_join(F.slice("x", F.lit(3), F.size("x")), "\n").alias("source"))


def glossary(files: DataFrame, content: str = "content", most: int = 12000) -> DataFrame:
    """The head of each glossary, whether it was cut, and the hash of the whole; null is empty."""
    whole = F.coalesce(F.col(content), F.lit(""))
    return files.select("video_id", F.substring(whole, 1, most).alias("glossary"), (F.length(whole) > most).alias("truncated"), F.sha2(whole, 256).alias("hash"))


def violations(cues: DataFrame) -> DataFrame:
    """What is wrong with cues, a row for each cue and reason; none if all is well."""
    tests = {"no timing line": F.col("start_ms").isNull() | F.col("end_ms").isNull(), "blank text": F.trim("source") == ""}
    reasons = F.filter(F.array(*[F.when(t, F.lit(r)) for r, t in tests.items()]), lambda x: x.isNotNull())
    return cues.select("video_id", "cue_index", F.explode(reasons).alias("reason"))
