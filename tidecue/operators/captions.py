"""Operators on cues. All are keyed by video, and ordered by columns, never by the order of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidecue.functions.text import normal_token, without_tags
from tidecue.functions.timecode import format_ms


def overlaps(start: Column, end: Column) -> Column:
    """Half-open: touching intervals don't overlap."""
    return (F.col("end_ms") > start) & (F.col("start_ms") < end)


def crop(cues: DataFrame, start_ms: int, end_ms: int) -> DataFrame:
    """Cues that overlap the clip, clamped to it, counted from its start and numbered anew."""
    if start_ms >= end_ms:
        raise ValueError("a clip ends after its start")
    inside = cues.filter(overlaps(F.lit(start_ms), F.lit(end_ms)))
    a, b = F.greatest("start_ms", F.lit(start_ms)) - start_ms, F.least("end_ms", F.lit(end_ms)) - start_ms
    rank = F.row_number().over(Window.partitionBy("video_id").orderBy("cue_index")).cast("long")
    return inside.select("video_id", rank.alias("cue_index"), "source", a.cast("long").alias("start_ms"), b.cast("long").alias("end_ms"))


def shift(cues: DataFrame, offset_ms: int) -> DataFrame:
    """Cues moved by ``offset_ms``, not before 0; those that then end at 0 or before are gone."""
    moved = lambda name: (F.col(name) + offset_ms).cast("long")
    out = cues.filter(moved("end_ms") > 0)
    return out.withColumns({"start_ms": F.greatest(F.lit(0).cast("long"), moved("start_ms")), "end_ms": moved("end_ms")})


def window_flags(cues: DataFrame, start_ms: int, end_ms: int, before_ms: int, after_ms: int) -> DataFrame:
    """Cues in reach of the padded clip, with what they have to do with the clip itself."""
    near = cues.filter(overlaps(F.lit(max(0, start_ms - before_ms)), F.lit(end_ms + after_ms)))
    crossing = lambda bound: (F.col("start_ms") < bound) & (F.col("end_ms") > bound)
    inside = overlaps(F.lit(start_ms), F.lit(end_ms))
    return near.select("video_id", "cue_index", inside.alias("intersects_clip"), (~inside).alias("is_padding_only"), crossing(start_ms).alias("crosses_clip_start"), crossing(end_ms).alias("crosses_clip_end"))


def overlap_join(cues: DataFrame, windows: DataFrame, width_ms: int) -> DataFrame:
    """Cues and windows (window_id, window_start, window_end) of one video that overlap.

    Both are dealt into bins of ``width_ms``; a pair is kept in the first bin that both have, so that it comes once.
    The join is on video and bin, never on the interval alone.
    """
    bins = lambda a, b: F.explode(F.sequence(F.floor(a / width_ms), F.floor((b - 1) / width_ms)))
    left = cues.withColumn("bin", bins(F.col("start_ms"), F.col("end_ms")))
    right = windows.withColumn("bin", bins(F.col("window_start"), F.col("window_end")))
    first = F.greatest(F.floor(F.col("start_ms") / width_ms), F.floor(F.col("window_start") / width_ms))
    return left.join(right, ["video_id", "bin"]).filter(overlaps(F.col("window_start"), F.col("window_end")) & (F.col("bin") == first)).drop("bin")


def batches(cues: DataFrame, size: int) -> DataFrame:
    return cues.withColumn("batch_id", (F.floor((F.col("cue_index") - 1) / size) + 1).cast("long"))


def batch_contexts(cues: DataFrame, size: int, before: int, after: int) -> DataFrame:
    """For each batch the ids of its own cues and of its neighbours before and after, in order."""
    own = batches(cues, size)
    lists = own.groupBy("video_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("cue_index"))), lambda x: x.cue_index).alias("all"))
    ids = lists.select("video_id", "all", F.explode(F.sequence(F.lit(1), F.ceil(F.size("all") / size).cast("int"))).alias("batch_id"))
    lo = (F.col("batch_id") - 1) * size
    joined = lambda start, n: F.array_join(F.when(n > 0, F.slice("all", start, n)).otherwise(F.array().cast("array<long>")), ",")
    n_before = F.least(F.lit(before), lo)
    return ids.select("video_id", F.col("batch_id").cast("long").alias("batch_id"), joined(lo + 1 - n_before, n_before).alias("context_before"), joined(lo + 1, F.lit(size)).alias("target"), joined(lo + size + 1, F.lit(after)).alias("context_after"))


def split_halves(batch: DataFrame) -> DataFrame:
    """A failed batch (array ``cues``) as two children that keep its order; child ids follow the largest id by order of parents."""
    mid = F.floor(F.size("cues") / 2).cast("int")
    return batch.filter(F.size("cues") >= 2).select("batch_id", F.posexplode(F.array(F.slice("cues", F.lit(1), mid), F.slice("cues", mid + 1, F.size("cues")))).alias("half", "cues"))


def samples(cues: DataFrame, n: int = 5) -> DataFrame:
    """The first, middle and last ``n`` cues of each video; sections may share cues."""
    count = F.count("*").over(Window.partitionBy("video_id"))
    mid = F.greatest(F.floor((F.col("n_cues") - n) / 2), F.lit(0))
    tests = [("front", F.col("cue_index") <= n), ("middle", (F.col("cue_index") > mid) & (F.col("cue_index") <= mid + n)), ("tail", F.col("cue_index") > F.col("n_cues") - n)]
    sections = F.filter(F.array(*[F.when(t, F.lit(s)) for s, t in tests]), lambda x: x.isNotNull())
    return cues.withColumn("n_cues", count).select("video_id", "cue_index", F.explode(sections).alias("section"))


def tokens(cues: DataFrame) -> DataFrame:
    """Words of cues with times in proportion to their place, rounded half to even. Cues without length give none."""
    words = F.filter(F.split(without_tags(F.col("source")), r"(?U)\s+"), lambda x: x != "")
    rows = cues.filter("end_ms > start_ms").withColumn("words", words)
    rows = rows.select("video_id", "cue_index", "start_ms", "end_ms", F.size("words").alias("n"), F.posexplode("words").alias("i", "text"))
    at = lambda k: (F.col("start_ms") + F.rint((F.col("end_ms") - F.col("start_ms")) * k / F.col("n"))).cast("long")
    return rows.select("video_id", "cue_index", F.col("i").cast("long").alias("token_index"), "text", normal_token(F.col("text")).alias("normalized"), at(F.col("i")).alias("token_start"), at(F.col("i") + 1).alias("token_end"))


def render_srt(cues: DataFrame, text: Column) -> DataFrame:
    """The SRT file of each video."""
    block = F.concat(F.col("cue_index").cast("string"), F.lit("\n"), format_ms(F.col("start_ms")), F.lit(" --> "), format_ms(F.col("end_ms")), F.lit("\n"), text, F.lit("\n\n"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("cue_index", block.alias("block")))), lambda x: x.block)
    return cues.groupBy("video_id").agg(F.array_join(parts, "").alias("srt"))


def srt_to_vtt(srt: Column) -> Column:
    """An SRT file as WebVTT: a header, and times with a point."""
    return F.concat(F.lit("WEBVTT\n\n"), F.regexp_replace(srt, r"(\d{2}:\d{2}:\d{2}),(\d{3})", "$1.$2"))


def transcript(cues: DataFrame) -> DataFrame:
    """The timed transcript of each video, its length by its last cue, and about how many chapters of 180 s it has."""
    line = F.concat(F.lit("["), format_ms(F.col("start_ms")), F.lit("] "), F.col("source"))
    lists = cues.groupBy("video_id").agg(F.array_sort(F.collect_list(F.struct("cue_index", line.alias("line"), "end_ms"))).alias("rows"))
    last = F.element_at("rows", -1)["end_ms"]
    return lists.select("video_id", F.array_join(F.transform("rows", lambda x: x.line), "\n").alias("transcript"), last.alias("duration_ms"), F.size("rows").cast("long").alias("n_cues"), F.greatest(F.lit(1).cast("long"), F.floor(last / 180000).cast("long")).alias("estimated_chapters"))
