"""Units refined by boundaries that a model proposes: read, checked and rebuilt set-wise; what fails keeps its units by rule.

A proposal is one JSON text for each video. Its segments are cut into rows, each check is an expression over a row or its
neighbour, and the first failure in the order of the checks is the least of all (check, segment) of a video.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidecue.operators import units

# Keys that a segment must not have, and how far a hard limit is above a limit.
FORBIDDEN = ("rewritten_text", "source_text", "text", "tokens")
HARD = 1.5


@dataclass(frozen=True)
class Options:
    max_chars: int = 220
    max_duration_ms: int = 9000
    min_duration_ms: int = 800
    max_words: int = 350
    fallback: bool = True


def eligible(active: DataFrame, of_units: DataFrame, made: DataFrame) -> DataFrame:
    """The words that aren't in units of padding alone, numbered anew (place), with the pos they had."""
    padding = made.filter("is_padding_only").select("video_id", "unit_pos")
    kept = of_units.join(padding, ["video_id", "unit_pos"], "left_anti").drop("unit_pos", "forced")
    return kept.withColumn("place", (F.row_number().over(Window.partitionBy("video_id").orderBy("pos")) - 1).cast("long"))


def _number(value: object) -> int:
    """A whole number as a proposal may give it: text of digits and numbers, cut to whole."""
    return int(value)  # type: ignore[call-overload]


def read_proposal(text: str | None) -> tuple[list[tuple[int, int, str | None]], str | None, str | None]:
    """(segments, parse error, forbidden keys of the first segment that has some)."""
    try:
        data = json.loads(text or "")
    except ValueError as e:
        return [], f"parse_error: {e}", None
    if not isinstance(data, dict):
        return [], "parse_error: payload is not a JSON object", None
    if "segments" not in data:
        return [], "parse_error: missing 'segments' key", None
    if not isinstance(data["segments"], list):
        return [], "parse_error: 'segments' is not an array", None
    out: list[tuple[int, int, str | None]] = []
    for s in data["segments"]:
        if not isinstance(s, dict):
            return [], "parse_error: segment entry is not an object", None
        if "start_token" not in s or "end_token" not in s:
            return [], "parse_error: segment missing start_token or end_token", None
        try:
            reason = s.get("reason")
            out.append((_number(s["start_token"]), _number(s["end_token"]), reason if reason is None else str(reason)))
        except (TypeError, ValueError, OverflowError):
            return [], f"parse_error: invalid start_token/end_token value in segment {s}", None
    named = next((sorted(set(FORBIDDEN) & set(s)) for s in data["segments"] if set(FORBIDDEN) & set(s)), None)
    return out, None, None if named is None else f"forbidden_text_fields: {named}"


def proposals(payloads: DataFrame) -> DataFrame:
    """video_id, error, forbidden, segments (start, stop, reason) of ``payloads`` (video_id, payload)."""
    kind = payloads.schema["video_id"].dataType.simpleString()
    segment = pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("reason", pa.string())])
    clip = lambda n: max(-(1 << 62), min(1 << 62, n))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [read_proposal(x) for x in batch.column(1).to_pylist()]
            lists = [[{"start": clip(a), "stop": clip(b), "reason": r} for a, b, r in s] for s, _, _ in got]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([e for _, e, _ in got], pa.string()), pa.array([f for _, _, f in got], pa.string()), pa.array(lists, pa.list_(segment))],
                names=["video_id", "error", "forbidden", "segments"],
            )

    return payloads.select("video_id", "payload").mapInArrow(run, f"video_id {kind}, error string, forbidden string, segments array<struct<start:long,stop:long,reason:string>>")


def segment_rows(read: DataFrame) -> DataFrame:
    return read.select("video_id", F.posexplode("segments").alias("i", "s")).select("video_id", F.col("i").cast("long").alias("i"), "s.*")


def faults(read: DataFrame, words: DataFrame, options: Options = Options()) -> DataFrame:  # noqa: B008
    """video_id and reason: the first thing wrong with each video's proposal, null if all is well.

    The checks come in a fixed order, and within one the segments in theirs; words are the ``eligible`` ones.
    """
    sizes = words.groupBy("video_id").agg(F.count("*").alias("n"))
    rows = segment_rows(read).join(sizes, "video_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    order = Window.partitionBy("video_id").orderBy("i")
    after = F.lead("start").over(order)
    rows = rows.withColumn("after", after).withColumn("last", F.max("i").over(Window.partitionBy("video_id")))
    at = lambda text: F.concat(F.lit(text), F.col("i").cast("string"))
    pair = lambda text: F.concat(F.lit(text), F.col("i").cast("string"), F.lit("/"), (F.col("i") + 1).cast("string"))
    # the first three are one check, told apart within a segment; overlap and gap are one check as well
    first = F.when(F.col("start") < 0, at("V4: invalid start_token at segment ")).when(F.col("stop") <= F.col("start"), at("V5: end_token <= start_token at segment "))
    first = first.when((F.col("start") >= F.col("n")) | (F.col("stop") > F.col("n")), at("V11: out_of_range at segment "))
    tests = [
        (1, first),
        (2, F.when((F.col("i") == 0) & (F.col("start") != 0), "V6: first segment does not start at 0")),
        (3, F.when((F.col("i") == F.col("last")) & (F.col("stop") != F.col("n")), F.concat(F.lit("V7: last segment end_token != "), F.col("n").cast("string")))),
        (4, F.when(F.col("stop") > F.col("after"), pair("V9: overlap at segment ")).when(F.col("stop") < F.col("after"), pair("V10: gap at segment "))),
    ]
    found = F.filter(F.array(*[F.when(t.isNotNull(), F.struct(F.lit(k).alias("check"), F.col("i"), t.alias("reason"))) for k, t in tests]), lambda x: x.isNotNull())
    by_row = rows.select("video_id", F.explode(found).alias("f"))
    hard_chars, hard_ms = int(options.max_chars * HARD), int(options.max_duration_ms * HARD)
    of_segments = measured(segment_rows(read), words)
    chars = F.concat(F.lit("V14: segment "), F.col("i").cast("string"), F.lit(" exceeds hard max chars ("), F.col("chars").cast("string"), F.lit(f" > {hard_chars})"))
    length = F.concat(F.lit("V15: segment "), F.col("i").cast("string"), F.lit(" exceeds hard max duration ("), F.col("duration_ms").cast("string"), F.lit(f" > {hard_ms})"))
    too_much = of_segments.select("video_id", F.lit(5).alias("check"), "i", F.when(F.col("chars") > hard_chars, chars).when(F.col("duration_ms") > hard_ms, length).alias("reason")).filter("reason is not null")
    every = by_row.select("video_id", "f.*").unionByName(too_much)
    least = every.groupBy("video_id").agg(F.min_by("reason", F.struct("check", "i")).alias("reason"))
    early = F.coalesce("error", F.when(F.size("segments") == 0, "empty_segments"), "forbidden")
    return read.join(least, "video_id", "left").select("video_id", F.coalesce(early, "reason").alias("reason"))


def measured(segments: DataFrame, words: DataFrame) -> DataFrame:
    """Characters and duration of each segment (video_id, i, start, stop) that holds words."""
    found = _words_of(segments, words)
    sums = found.groupBy("video_id", "i").agg((F.sum(F.length("text")) + F.count("*") - 1).cast("long").alias("chars"), F.min_by("token_start", "place").alias("a"), F.max_by("token_end", "place").alias("b"))
    return sums.select("video_id", "i", "chars", (F.col("b") - F.col("a")).alias("duration_ms"))


def _words_of(segments: DataFrame, words: DataFrame) -> DataFrame:
    """Words with each segment that holds them, as a join on video and block of places, not on ranges alone."""
    block = 256
    sane = segments.filter("start >= 0 and stop > start").join(words.groupBy("video_id").agg(F.max("place").alias("top")), "video_id").filter("start <= top")
    last = F.floor((F.least("stop", F.col("top") + 1) - 1) / block)
    dealt = sane.select("video_id", "i", "start", "stop", F.explode(F.sequence(F.floor(F.col("start") / block), last)).alias("block"))
    return words.withColumn("block", F.floor(F.col("place") / block)).join(dealt, ["video_id", "block"]).filter("place >= start and place < stop").drop("block", "start", "stop")


def short_segments(read: DataFrame, words: DataFrame, options: Options = Options()) -> DataFrame:  # noqa: B008
    """The advice on segments under the least duration."""
    rows = measured(segment_rows(read), words).filter(F.col("duration_ms") < options.min_duration_ms)
    message = F.concat(F.lit("segment "), F.col("i").cast("string"), F.lit(" duration "), F.col("duration_ms").cast("string"), F.lit(f"ms < min {options.min_duration_ms}ms (advisory)"))
    return rows.select("video_id", F.format_string("s%03d", F.col("i") + 1).alias("unit_id"), F.lit("semantic_short_segment").alias("code"), F.lit("info").alias("severity"), message.alias("message"))


def spans(labelled: DataFrame) -> DataFrame:
    """The spans of rebuilt units (words with video_id, i, place, pos): runs within one cue, by the pos that the words had."""
    own = Window.partitionBy("video_id", "i").orderBy("place")
    starts = F.lag("cue_index").over(own).isNull() | (F.lag("cue_index").over(own) != F.col("cue_index"))
    runs = labelled.withColumn("run", F.sum(starts.cast("int")).over(own.rowsBetween(Window.unboundedPreceding, 0)))
    found = runs.groupBy("video_id", "i", "run").agg(
        F.min("pos").alias("start"), (F.max("pos") + 1).alias("last"), F.min("cue_index").alias("cue_index"), F.min_by("token_index", "place").alias("cue_token_start"), (F.max_by("token_index", "place") + 1).alias("cue_token_end")
    )
    # a run ends where the next one of its unit begins
    after = F.lead("start").over(Window.partitionBy("video_id", "i").orderBy("run"))
    return found.select("video_id", "i", "start", F.coalesce(after, "last").alias("end"), "cue_index", "cue_token_start", "cue_token_end")


def refined(made: DataFrame, words: DataFrame, payloads: DataFrame, options: Options = Options(), clip: tuple[int, int] | None = None) -> DataFrame:  # noqa: B008
    """The units of each video with mode and reason: rebuilt ones and those of padding alone in the order of their times, or the
    ones by rule where the proposal is missing, has a fault, or the words are too many."""
    read = proposals(payloads)
    many = words.groupBy("video_id").agg(F.count("*").alias("n")).filter(F.col("n") > options.max_words).select("video_id", F.lit("too_many_tokens").alias("many"))
    verdict = faults(read, words, options).join(many, "video_id", "left").select("video_id", F.coalesce("many", "reason").alias("reason"))
    if not options.fallback:
        verdict = verdict.withColumn("reason", F.when(F.col("reason").isNotNull(), F.raise_error(F.col("reason")).cast("string")))
    good = verdict.filter("reason is null").select("video_id")
    labelled = _words_of(segment_rows(read).join(good, "video_id"), words).withColumn("unit_pos", F.col("i")).withColumn("forced", F.lit(False))
    # words in a unit are ordered by their own place
    rebuilt = units.units(labelled, clip, prefix="s").withColumn("mode", F.lit("semantic"))
    padding = made.filter("is_padding_only").join(good, "video_id").withColumn("mode", F.lit("semantic"))
    rest = made.join(good, "video_id", "left_anti").join(verdict, "video_id", "left").withColumn("mode", F.lit("fallback"))
    names = [c for c in made.columns if c not in ("unit_no", "unit_pos", "forced")] + ["mode"]
    every = rebuilt.select(*names, F.lit(None).cast("string").alias("reason")).unionByName(padding.select(*names, F.lit(None).cast("string").alias("reason"))).unionByName(rest.select(*names, "reason"))
    order = Window.partitionBy("video_id").orderBy("start_ms", "end_ms", "unit_id")
    return every.withColumn("nth", F.row_number().over(order).cast("long"))
