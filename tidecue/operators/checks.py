"""What is wrong with cues and translations, as rows; and what takes the place of a translation that is missing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidecue.functions.text import stripped
from tidecue.functions.timecode import seconds_text


def cue_faults(cues: DataFrame) -> DataFrame:
    """video_id, pos, nth and reason: every fault of cues (video_id, pos from 1, cue_index, cue_id, start, end, source), in the order they are looked for.

    A video without cues has no row to tell by; see ``empty_videos``.
    """
    blank = lambda name: F.coalesce(stripped(F.col(name).cast("string")), F.lit("")) == ""
    earlier = F.row_number().over(Window.partitionBy("video_id", "cue_id").orderBy("pos")) > 1
    tests = {
        "index": F.col("cue_index") != F.col("pos"), "id": blank("cue_id"), "duplicate id": ~blank("cue_id") & F.col("again"),
        "start": blank("start"), "end": blank("end"), "source": blank("source"),
    }
    rows = cues.withColumn("again", earlier)
    found = F.filter(F.array(*[F.when(t, F.lit(r)) for r, t in tests.items()]), lambda x: x.isNotNull())
    return rows.select("video_id", "pos", F.posexplode(found).alias("nth", "reason"))


def first_fault(faults: DataFrame) -> DataFrame:
    """The fault that a strict reading of each video ends with."""
    return faults.groupBy("video_id").agg(F.min_by("reason", F.struct("pos", "nth")).alias("reason"), F.min("pos").alias("pos"))


def empty_videos(videos: DataFrame, cues: DataFrame) -> DataFrame:
    return videos.select("video_id").distinct().join(cues.select("video_id"), "video_id", "left_anti")


def incomplete(cues: DataFrame, translations: DataFrame) -> DataFrame:
    """video_id, cue_id and reason: cues without a translation or with a blank one, and translations of no cue."""
    both = cues.select("video_id", "cue_id", F.lit(True).alias("is_cue")).join(translations.select("video_id", "cue_id", "translation", F.lit(True).alias("is_said")), ["video_id", "cue_id"], "full_outer")
    reason = F.when(F.col("is_said").isNull(), "missing").when(F.col("is_cue").isNull(), "of no cue").when(F.coalesce(stripped(F.col("translation")), F.lit("")) == "", "blank")
    return both.select("video_id", "cue_id", reason.alias("reason")).filter("reason is not null")


def with_translations(cues: DataFrame, translations: DataFrame, *, instead: str = "") -> DataFrame:
    """``cues`` with their translations, ``instead`` where there is none, as the rules and the older bilingual file take them."""
    return cues.join(translations.select("video_id", "cue_id", "translation"), ["video_id", "cue_id"], "left").withColumn("translation", F.coalesce("translation", F.lit(instead)))


def bilingual_file(cues: DataFrame, *, source_first: bool = True) -> DataFrame:
    """The older bilingual file of each video: cues with seconds (start, end), text and translation, numbered anew."""
    number = F.row_number().over(Window.partitionBy("video_id").orderBy("cue_index"))
    lines = ("text", "translation") if source_first else ("translation", "text")
    time = lambda name: seconds_text(F.col(name), comma=True)
    block: Column = F.concat(F.col("number").cast("string"), F.lit("\n"), time("start"), F.lit(" --> "), time("end"), F.lit("\n"), F.col(lines[0]), F.lit("\n"), F.col(lines[1]), F.lit("\n\n"))
    rows = cues.withColumn("number", number)
    return rows.groupBy("video_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("number", block.alias("b")))), lambda x: x.b), "").alias("srt"))
