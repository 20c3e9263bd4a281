"""Files as tables: subtitles by their format, lenient forms, chapters and settings; and what is written."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidecue.functions import timecode
from tidecue.functions.text import stripped, subtitle_format, without_tags
from tidecue.sources import cues

CUE = "video_id string, cue_index long, cue_id string, source string, start_ms long, end_ms long, raw_timing string"


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """video_id (the path) and content of each file; UTF-8, a byte-order mark at the start is left out."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("video_id"), F.col("value").alias("content"))
    return whole.withColumn("content", F.regexp_replace("content", r"^\x{feff}", ""))


def parse(files: DataFrame) -> DataFrame:
    """The cues of files of either format, each by its own rules; the format is the end of video_id."""
    kind = files.withColumn("format", subtitle_format(F.col("video_id")))
    return cues.parse_srt(kind.filter("format = 'srt'")).unionByName(cues.parse_vtt(kind.filter("format = 'vtt'")))


def read_subtitles(spark: SparkSession, path: str, *, strict: bool = False) -> DataFrame:
    """The cues of all subtitle files under ``path``; ``strict`` fails on the first thing that is wrong with any."""
    found = parse(read_files(spark, path))
    return accepted(found) if strict else found


def accepted(found: DataFrame) -> DataFrame:
    """The cues as they are, or an error if a cue has no timing line or no text."""
    name = F.concat(F.lit("cue "), F.col("cue_index").cast("string"), F.lit(" of "), F.col("video_id").cast("string"))
    snippet = F.array_join(F.slice(F.split("source", "\n"), 1, 3), " | ")
    fault = F.when(F.col("start_ms").isNull() | F.col("end_ms").isNull(), F.concat(name, F.lit(" is malformed: "), snippet)).when(stripped(F.col("source")) == "", F.concat(name, F.lit(" has no text")))
    return found.withColumn("source", F.when(fault.isNull(), F.col("source")).otherwise(F.raise_error(fault).cast("string")))


def flat_cues(found: DataFrame) -> DataFrame:
    """Cues with seconds and one line of text, as the older flow has them."""
    return found.select("video_id", "cue_index", (F.col("start_ms") / 1000).alias("start"), (F.col("end_ms") / 1000).alias("end"), F.replace("source", F.lit("\n"), F.lit(" ")).alias("text"))


def parse_vtt_lenient(files: DataFrame, content: str = "content") -> DataFrame:
    """video_id, pos, start, end, text of the blocks of a WebVTT file that can be read; all others are left out.

    A style takes all up to the next arrow with it. Of several arrows in a block the last line counts; lines of digits
    alone are no text; times with a comma can't be read.
    """
    text = F.regexp_replace(F.regexp_replace(F.col(content), r"(?s)^WEBVTT.*?\n\n", ""), r"(?s)STYLE.*?-->", "")
    blocks = F.transform(F.split(stripped(text), "\n\n"), lambda b: F.split(stripped(b), "\n"))
    rows = files.select("video_id", F.posexplode(blocks).alias("pos", "x")).filter(F.size("x") >= 2)
    arrow = F.try_element_at(F.filter("x", lambda y: y.contains("-->")), F.lit(-1))
    lines = F.filter("x", lambda y: ~y.contains("-->") & (y != "") & ~y.rlike(r"(?U)^\d+$"))
    rows = rows.filter(F.exists("x", lambda y: y.contains("-->"))).select("video_id", "pos", stripped(F.regexp_replace(arrow, "align:.*|position:.*", "")).alias("time"), lines.alias("lines")).filter(F.size("lines") > 0)
    times = F.split("time", "-->")
    out = rows.select(
        "video_id", F.col("pos").cast("long").alias("pos"), timecode.seconds_of(stripped(F.get(times, F.lit(0)))).alias("start"), timecode.seconds_of(stripped(F.get(times, F.lit(1)))).alias("end"),
        stripped(without_tags(F.array_join("lines", " "), "")).alias("text"),
    )
    return out.filter("start is not null and end is not null and text <> ''")


def check_srt(files: DataFrame, content: str = "content") -> DataFrame:
    """video_id, pos and reason: what is wrong with the blocks of an SRT file, in order; the end before is that of the last whole block."""
    blocks = F.transform(F.split(stripped(F.col(content)), "\n\n"), lambda b: F.split(stripped(b), "\n"))
    rows = files.select("video_id", F.posexplode(blocks).alias("pos", "x"))
    stamp = r"^(\d{2}:\d{2}:\d{2},\d{3}) --> (\d{2}:\d{2}:\d{2},\d{3})$"
    line = F.get("x", F.lit(1))
    timed = (F.size("x") >= 3) & line.rlike(stamp)
    bound = lambda k: F.when(timed, timecode.parse_ms(F.regexp_extract(line, stamp, k)))
    from pyspark.sql import Window

    before = F.last("end_ms", True).over(Window.partitionBy("video_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("start_ms", bound(1)).withColumn("end_ms", bound(2)).withColumn("before", before)
    number = F.get("x", F.lit(0)) != (F.col("pos") + 1).cast("string")
    tests = {
        "too few lines": F.size("x") < 3, "wrong number": (F.size("x") >= 3) & number, "no time": (F.size("x") >= 3) & ~F.coalesce(line.rlike(stamp), F.lit(False)),
        "ends before it starts": F.col("start_ms") >= F.col("end_ms"), "starts before the last end": F.col("start_ms") < F.col("before"),
    }
    reasons = F.filter(F.array(*[F.when(t, F.lit(r)) for r, t in tests.items()]), lambda r: r.isNotNull())
    return rows.select("video_id", F.col("pos").cast("long").alias("pos"), F.explode(reasons).alias("reason"))


def vtt_to_srt(content: Column) -> Column:
    """WebVTT text as SRT: header, styles and notes go, times get commas, settings and voice tags go."""
    steps = ((r"(?s)^WEBVTT.*?\n\n", ""), (r"(?s)(?:STYLE|NOTE).*?\n\n", ""), (r"(\d{2}:\d{2}:\d{2})\.(\d{3})", "$1,$2"), (r"(\d{2}:\d{2}:\d{2},\d{3} --> \d{2}:\d{2}:\d{2},\d{3})[^\n]*", "$1"), (r"</?v[^>]*>", ""))
    return functools.reduce(lambda text, s: F.regexp_replace(text, *s), steps, content)


def read_chapters(spark: SparkSession, path: str) -> DataFrame:
    """The chapters of JSON files: title, time_range, summary, keywords, generated_at; what a file lacks is null."""
    schema = "title string, time_range string, summary string, keywords array<string>, generated_at string"
    return spark.read.schema(schema).json(path, multiLine=True)


def settings(lines: DataFrame, column: str = "value") -> DataFrame:
    """key and value of lines key=value; blank lines, comments and others are left out, quotes around a value too."""
    line = stripped(F.col(column))
    rows = lines.select(line.alias("line")).filter((F.col("line") != "") & ~F.col("line").startswith("#") & F.col("line").contains("="))
    unquoted = lambda t: F.regexp_replace(F.regexp_replace(t, r'^"+|"+$', ""), r"^'+|'+$", "")
    return rows.select(stripped(F.substring_index("line", "=", 1)).alias("key"), unquoted(stripped(F.regexp_replace("line", "^[^=]*=", ""))).alias("value"))


def preferred_subtitle(names: Column) -> Column:
    """Of a video's files the English WebVTT, else any WebVTT, else null."""
    first = lambda test: F.get(F.filter(names, test), F.lit(0))
    return F.coalesce(first(lambda n: n.endswith(".en.vtt")), first(lambda n: n.endswith(".vtt")))


def write_texts(texts: DataFrame, path: str, *, overwrite: bool = False) -> None:
    """A folder of text, dealt by video_id: one file for each video of ``texts`` (video_id, text); what exists is an error unless ``overwrite``.

    A file ends with a line end; a text without one gets it.
    """
    out = texts.select(F.col("video_id").cast("string").alias("video_id"), F.regexp_replace("text", r"\n\z", "").alias("value"))
    out.write.mode("overwrite" if overwrite else "errorifexists").partitionBy("video_id").text(path)


def write_artifacts(tables: dict[str, DataFrame], folder: str, *, overwrite: bool = False) -> None:
    """Each of ``tables`` under its name; nothing is written if any of them exists and may not be replaced."""
    if not overwrite and tables:
        spark = next(iter(tables.values())).sparkSession
        jvm = spark._jvm
        paths = [jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}") for name in tables]
        there = [p.toString() for p in paths if p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)]
        if there:
            raise FileExistsError(f"output already exists: {', '.join(there)}")
    for name, table in tables.items():
        write_texts(table, f"{folder}/{name}", overwrite=overwrite)
