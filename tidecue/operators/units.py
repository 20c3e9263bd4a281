"""From cues to units of speech: timed words, what rolls over from one cue to the next, greedy units and their checks.

All tables hold any number of videos. Words are found within a row, without a shuffle. Two steps depend on the order of a
whole video and can't be told as built-in expressions: the fold over cues whose state is the trimmed cue before, and the
greedy walk whose forced splits go back. Both are streams over sorted rows that keep a bounded state, never a whole video.
``segments`` does both in one stream over cues, which are sent once; the tables of words are for those who need every word.
There, units always begin at strong phrases, so the walk is dealt by video and phrase.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidecue.functions.text import for_compare, normal_token, stripped, without_tags
from tidecue.functions.timecode import parse_ms

# What begins a unit, what doesn't end one, and the limits of a unit and of rolling over.
STRONG_PHRASES = (
    "now we're going to move on",
    "next project",
    "all right",
    "okay",
    "so now",
    "in this project",
    "let's create",
    "let's move on",
    "this next project",
)
DANGLING = (
    "the", "a", "an", "of", "to", "for", "with", "and", "or", "but", "so", "because", "that", "which", "who", "where", "when",
    "if", "is", "are", "was", "were", "be", "been", "being", "we're", "you're", "it's", "i'm",
)
NEAR_MS = 150
LONGEST_OVERLAP = 20
STAMP = r"^(?:\d{2}:)?\d{2}:\d{2}\.\d{3}$"


@dataclass(frozen=True)
class Limits:
    """The limits of a unit. ``sentences`` is checked and passed on, but no rule looks at it."""

    chars: int = 180
    duration_ms: int = 7000
    cues: int = 4
    sentences: int = 2
    phrases: tuple[str, ...] = STRONG_PHRASES
    dangling: tuple[str, ...] = DANGLING
    drop_repeats: bool = True
    trim_overlap: bool = True

    def __post_init__(self):
        for name in ("chars", "duration_ms", "cues", "sentences"):
            if getattr(self, name) <= 0:
                raise ValueError(f"{name} must be above 0")


def _words(text: Column) -> Column:
    return F.filter(F.split(text, r"(?U)\s+"), lambda x: x != "")


def _inline(source: Column) -> Column:
    """Each word of a cue with the time of the last time tag before it, if any; other tags are left out."""
    marked = F.regexp_replace(source, "<([^>]+)>", "\x01$1\x03")
    stamps = F.regexp_replace(marked, "(?U)\x01\\s*(" + STAMP.strip("^$") + ")\\s*\x03", " \x02$1 ")
    # cut at the stamps: every part but the first begins with one
    parts = F.split(F.regexp_replace(stamps, "\x01[^\x03]*\x03", " "), "\x02")
    timed = lambda p, i: F.struct(_words(p).alias("words"), F.when(i > 0, F.lit(1)).otherwise(0).alias("skip"))
    with_time = lambda p: F.struct(p["words"].alias("words"), p["skip"].alias("skip"), F.when(p["skip"] > 0, parse_ms(F.get(p["words"], F.lit(0)))).alias("at"))
    own = lambda p: F.transform(F.slice(p["words"], p["skip"] + 1, F.size(p["words"])), lambda w: F.struct(w.alias("text"), p["at"].alias("at")))
    return F.flatten(F.transform(F.transform(F.transform(parts, timed), with_time), own))


def _proportional(source: Column, start: Column, end: Column) -> Column:
    """Words with times in proportion to their place, rounded half to even."""
    at = lambda k, n: (start + F.rint((end - start) * k / n)).cast("long")
    timed = lambda words: F.transform(words, lambda w, i: F.struct(w.alias("text"), at(i, F.size(words)).alias("token_start"), at(i + 1, F.size(words)).alias("token_end")))
    # the words are bound once by an array around them
    return F.get(F.transform(F.array(_words(stripped(without_tags(source)))), timed), F.lit(0))


def _warning(code: str, severity: str, message: str) -> Column:
    return F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"), F.lit(message).alias("message"))


def tokenized(cues: DataFrame, kind: str, *, single_file: bool = False) -> DataFrame:
    """``cues`` with ``tokens`` (text, token_start, token_end), ``timing`` and ``warnings``, all within the row.

    WebVTT (kind vtt) uses the times in the text if they are whole: words before the first time share the span before it,
    times must grow, and no word may be without length; else, and for SRT, times are in proportion. A cue without
    length has no words. ``single_file`` warns of every cue whose times are less precise than a WebVTT file's. Explode the arrays
    with an outer generator: for an inner one the optimizer repeats the whole expression in a filter below it.
    """
    if kind not in ("srt", "vtt"):
        raise ValueError("kind must be srt or vtt")
    start, end = F.col("start_ms"), F.col("end_ms")
    rows = cues.withColumn("_raw", _inline(F.col("source")) if kind == "vtt" else F.array().cast("array<struct<text:string,at:bigint>>"))
    first = F.array_position(F.transform("_raw", lambda x: x["at"].isNotNull()), F.lit(True)).cast("int") - 1
    rows = rows.withColumn("_first", first).withColumn("_first_ms", F.get("_raw", F.col("_first"))["at"])
    filled = F.transform("_raw", lambda x, i: F.when(x["at"].isNull(), (start + F.floor((F.col("_first_ms") - start) * i / F.col("_first"))).cast("long")).otherwise(x["at"]))
    rows = rows.withColumn("_at", filled)
    ends = F.transform("_at", lambda x, i: F.coalesce(F.get("_at", i + 1), end))
    rows = rows.withColumn("_ends", ends)
    no_prefix = (F.col("_first") > 0) & (F.col("_first_ms") <= start)
    shrinks = F.array_sort("_at") != F.col("_at")
    empty = F.exists(F.arrays_zip(F.col("_at").alias("a"), F.col("_ends").alias("b")), lambda x: x["a"] >= x["b"])
    state = F.when(end <= start, "malformed").when(F.col("_first") < 0, "none").when(no_prefix, "prefix").when(shrinks, "shrinks").when(empty, "empty").otherwise("inline")
    rows = rows.withColumn("_state", state)
    inline = F.zip_with(F.arrays_zip(F.col("_raw").alias("r"), F.col("_at").alias("a")), F.col("_ends"), lambda x, e: F.struct(x["r"]["text"].alias("text"), x["a"].alias("token_start"), e.alias("token_end")))
    none = F.array().cast("array<struct<text:string,token_start:bigint,token_end:bigint>>")
    tokens = F.when(F.col("_state") == "malformed", none).when(F.col("_state") == "inline", inline).otherwise(_proportional(F.col("source"), start, end))
    fixed = "; falling back to cue-proportional timing"
    tests = [
        (F.col("_state") == "malformed", _warning("malformed_cue_skipped", "warning", "cue has zero or negative duration; skipped token generation")),
        (F.col("_state") == "prefix", _warning("invalid_inline_timing", "info", "inline timing prefix cannot be synthesized" + fixed)),
        (F.col("_state") == "shrinks", _warning("invalid_inline_timing", "warning", "inline timing is non-monotonic" + fixed)),
        (F.col("_state") == "empty", _warning("invalid_inline_timing", "warning", "inline timing produced zero or negative duration token" + fixed)),
    ]
    if kind == "vtt":
        late = ~F.col("_state").isin("malformed", "inline")
        tests.append((late, _warning("proportional_timing_fallback", "info", "inline timing unavailable or invalid; used cue-proportional timing")))
    rows = rows.withColumn("tokens", tokens)
    if single_file and kind == "srt":
        degraded = _warning("timing_precision_degraded", "warning", "single_file path uses cue-proportional timing without raw VTT inline precision")
        tests.append((F.size("tokens") > 0, degraded))
    warnings = F.filter(F.array(*[F.when(t, w) for t, w in tests]), lambda w: w.isNotNull())
    timing = F.when(F.col("_state") == "inline", "vtt_inline").otherwise("cue_proportional")
    return rows.withColumn("timing", timing).withColumn("warnings", warnings).drop("_raw", "_first", "_first_ms", "_at", "_ends", "_state")


class Fold:
    """The cues of a video in order; what is kept is the last kept cue's end, text and last words."""

    def __init__(self, limits: Limits):
        self.limits = limits
        self.before: tuple[int, str, list[str]] | None = None

    def removed(self, start: int, end: int, text: str, words: list[str]) -> tuple[int, str | None]:
        """How many words of this cue go, and why."""
        n, reason, before = 0, None, self.before
        if before is not None:
            if self.limits.drop_repeats and text and text == before[1] and abs(start - before[0]) <= NEAR_MS:
                return len(words), "duplicate_cue"
            if self.limits.trim_overlap and words:
                most = min(len(before[2]), len(words), LONGEST_OVERLAP)
                n = next((k for k in range(most, 0, -1) if before[2][-k:] == words[:k]), 0)
                reason = "rolling_overlap" if n else None
        if len(words) > n:
            self.before = (end, text, words[n:][-LONGEST_OVERLAP:])
        return n, reason


def trimmed(rows: DataFrame, limits: Limits = Limits()) -> DataFrame:  # noqa: B008
    """video_id, cue_index, n_words, n_removed, reason for ``tokenized`` rows: what repeats the kept cue before.

    A cue with the text of the last kept cue that begins near its end goes whole (duplicate_cue); else the longest
    end of that cue's words, after its own trimming, that begins this cue goes (rolling_overlap).
    """
    kind = rows.schema["video_id"].dataType.simpleString()
    state = rows.select("video_id", "cue_index", "start_ms", "end_ms", for_compare(without_tags(F.col("source"))).alias("text"), F.transform("tokens", lambda t: normal_token(t.text)).alias("words"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        video, fold = None, None
        for batch in batches:
            ids, out = batch.column(0).to_pylist(), []
            for own, start, end, text, words in zip(ids, *(batch.column(i).to_pylist() for i in (2, 3, 4, 5)), strict=True):
                if fold is None or own != video:
                    video, fold = own, Fold(limits)
                out.append((len(words), *fold.removed(start, end, text, words)))
            columns = [batch.column(0), batch.column(1), *(pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string())))]
            yield pa.RecordBatch.from_arrays(columns, names=["video_id", "cue_index", "n_words", "n_removed", "reason"])

    ordered = state.repartition("video_id").sortWithinPartitions("video_id", "cue_index")
    return ordered.mapInArrow(run, f"video_id {kind}, cue_index long, n_words long, n_removed long, reason string")


def token_table(rows: DataFrame, limits: Limits = Limits()) -> DataFrame:  # noqa: B008
    """A row for each word of ``tokenized`` rows: its place, times, and whether and why it is removed.

    token_id counts the words of a video from 0, pos those that stay (null for the others).
    """
    cut = trimmed(rows, limits).select("video_id", "cue_index", "n_removed", "reason")
    keep = [c for c in ("intersects_clip", "is_padding_only") if c in rows.columns]
    words = rows.join(cut, ["video_id", "cue_index"]).select("video_id", "cue_index", "timing", "n_removed", "reason", *keep, F.posexplode_outer("tokens").alias("i", "t")).filter("i is not null")
    gone = F.col("i") < F.col("n_removed")
    order = Window.partitionBy("video_id").orderBy("cue_index", "token_index")
    words = words.select(
        "video_id", "cue_index", F.col("i").cast("long").alias("token_index"), F.col("t.text").alias("text"), normal_token(F.col("t.text")).alias("normalized"),
        "t.token_start", "t.token_end", "timing", *keep, gone.alias("is_removed"), F.when(gone, F.col("reason")).alias("removal_reason"),
    )
    token_id = (F.row_number().over(order) - 1).cast("long")
    pos = F.when(~F.col("is_removed"), F.sum((~F.col("is_removed")).cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    return words.withColumn("token_id", token_id).withColumn("pos", pos)


def strong(active: DataFrame, phrases: tuple[str, ...] = STRONG_PHRASES) -> DataFrame:
    """``active`` words with ``is_strong``: a strong phrase begins here."""
    parts = [p.split() for p in phrases]
    order = Window.partitionBy("video_id").orderBy("pos")
    ahead = {k: F.lead("normalized", k).over(order) if k else F.col("normalized") for k in range(max(map(len, parts), default=0))}
    test = F.lit(False)
    for p in parts:
        whole = F.lit(True)
        for k, w in enumerate(p):
            whole = whole & F.coalesce(ahead[k] == w, F.lit(False))
        test = test | whole
    return active.withColumn("is_strong", test)


def walk(tokens: Iterator[tuple[int, int, int, int, bool]], limits: Limits) -> Iterator[tuple[int, bool]]:
    """(words, was forced) of each greedy unit of (chars, start, end, cue, dangles) words that hold no strong phrase but at the start.

    A word that breaks a limit forces a split: after the last word that doesn't dangle, else after the last whole cue, else
    before the word. Words after the split are looked at again, so at most one unit's words are held.
    """
    held: list[tuple[int, int, int, int, bool]] = []
    begin = chars = n_cues = 0
    good = edge = 0  # words up to the last good end, and up to the last cue's end

    def feed(i: int) -> bool:
        """Takes word ``i`` into the unit, or tells that it breaks a limit."""
        nonlocal begin, chars, n_cues, good, edge
        size, start, end, cue, dangles = held[i]
        if i == 0:
            begin, chars, n_cues, good, edge, more = start, 0, 0, 0, 0, size
        else:
            more = size + 1
            if cue != held[i - 1][3]:
                edge = i
        new_cues = n_cues + (i == 0 or cue != held[i - 1][3])
        if chars + more > limits.chars or end - begin > limits.duration_ms or new_cues > limits.cues:
            return False
        chars, n_cues = chars + more, new_cues
        if not dangles:
            good = i + 1
        return True

    at = 0
    for token in tokens:
        held.append(token)
        while at < len(held):
            if feed(at):
                at += 1
                continue
            cut = good or edge or max(1, at)
            yield cut, True
            del held[:cut]
            at = 0
    if held:
        yield len(held), False


def units_of(active: DataFrame, limits: Limits = Limits()) -> DataFrame:  # noqa: B008
    """``active`` words (those with a pos) with ``unit_pos``, the pos of their unit's first word, and ``forced``."""
    order = Window.partitionBy("video_id").orderBy("pos")
    dealt = strong(active, limits.phrases).withColumn("island", F.max(F.when(F.col("is_strong"), F.col("pos"))).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    dealt = dealt.withColumn("island", F.coalesce("island", F.lit(-1).cast("long")))
    kind = active.schema["video_id"].dataType.simpleString()
    narrow = dealt.select("video_id", "island", "pos", F.length("text").cast("long").alias("chars"), "token_start", "token_end", "cue_index", F.col("normalized").isin(*limits.dangling).alias("dangles"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []

        def rows() -> Iterator[tuple]:
            for batch in batches:
                yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

        stream = rows()
        row = next(stream, None)
        while row is not None:
            key, first = row[:2], row[2]

            def own() -> Iterator[tuple]:
                nonlocal row
                while row is not None and row[:2] == key:  # noqa: B023
                    yield row[3:]
                    row = next(stream, None)

            for n, forced in walk(own(), limits):
                out.append((key[0], first, n, forced))
                first += n
                if len(out) == 4096:
                    yield _batch(out)
                    out = []
        if out:
            yield _batch(out)

    def _batch(out: list[tuple]) -> pa.RecordBatch:
        names = ["video_id", "unit_pos", "n_words", "forced"]
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], id_type), pa.array([r[1] for r in out], pa.int64()), pa.array([r[2] for r in out], pa.int64()), pa.array([r[3] for r in out])], names=names)

    from pyspark.sql.pandas.types import to_arrow_type

    id_type = to_arrow_type(active.schema["video_id"].dataType)
    found = narrow.repartition("video_id", "island").sortWithinPartitions("video_id", "island", "pos").mapInArrow(run, f"video_id {kind}, unit_pos long, n_words long, forced boolean")
    heads = found.withColumn("pos", F.col("unit_pos"))
    joined = active.join(heads, ["video_id", "pos"], "left")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    return joined.withColumn("unit_pos", F.max("unit_pos").over(upto)).withColumn("forced", F.last("forced", True).over(upto)).drop("n_words")


def segments(cues: DataFrame, kind: str, limits: Limits = Limits(), *, single_file: bool = False) -> DataFrame:  # noqa: B008
    """Trimming, places and the greedy walk in one pass: cues are sent once, as they came, and no word is ever a row.

    A row for each cue (cue_index is set): what ``trimmed`` tells, the ``start`` and ``end`` of its words' places, and ``n_warned``, its
    own warnings of that severity. A row for each unit (unit_no is set): its text, times, whether a word lies in the clip, and its spans.
    A stream holds the words of one unit and the longest phrase ahead, never a whole video.
    """
    id_kind = cues.schema["video_id"].dataType.simpleString()
    marked = "intersects_clip" in cues.columns
    sent = cues.select("video_id", "cue_index", "source", "start_ms", "end_ms", *["intersects_clip"] * marked)
    rows = tokenized(sent.repartition("video_id").sortWithinPartitions("video_id", "cue_index"), kind, single_file=single_file)
    of = lambda c: F.transform("tokens", lambda t: t[c])
    state = rows.select(
        "video_id", "cue_index", "start_ms", "end_ms", for_compare(without_tags(F.col("source"))).alias("said"), F.transform("tokens", lambda t: normal_token(t.text)).alias("words"),
        of("text").alias("texts"), of("token_start").alias("starts"), of("token_end").alias("ends"), "timing",
        F.col("intersects_clip") if marked else F.lit(True).alias("intersects_clip"), F.size(F.filter("warnings", lambda w: w.severity == "warning")).cast("long").alias("n_warned"),
    )
    by_first: dict[str, list[list[str]]] = {}
    for phrase in limits.phrases:
        by_first.setdefault(phrase.split()[0], []).append(phrase.split())
    longest = max((len(p.split()) for p in limits.phrases), default=1)
    dangling = frozenset(limits.dangling)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        done: list[pa.RecordBatch] = []

        def live() -> Iterator[tuple]:
            """Words that stay: (video, chars, start, end, cue, dangles), text, place in the cue, in the clip, begins a phrase."""
            video, fold, ahead, norms, pos = None, None, [], [], 0

            def known(stop: int) -> Iterator[tuple]:
                for i in range(stop):
                    yield *ahead[i], any(norms[i : i + len(p)] == p for p in by_first.get(norms[i], ()))
                del ahead[:stop], norms[:stop]

            for batch in batches:
                for own, cue, start, end, said, words, texts, starts, ends, timing, inside, warned in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if fold is None or own != video:
                        yield from known(len(ahead))
                        video, fold, pos = own, Fold(limits), 0
                    n, reason = fold.removed(start, end, said, words)
                    stay = len(words) - n
                    out.append((own, cue, len(words), n, reason, timing, warned, pos, pos + stay) + (None,) * 9)
                    if len(out) >= 4096:
                        done.append(batch_of(out))
                    pos += stay
                    for i in range(n, len(words)):
                        ahead.append(((own, len(texts[i]), starts[i], ends[i], cue, words[i] in dangling), texts[i], i, inside))
                    norms += words[n:]
                    yield from known(max(0, len(ahead) - longest + 1))
            yield from known(len(ahead))

        stream = live()
        word, number, pos = next(stream, None), 0, 0
        while word is not None:
            video, kept = word[0][0], []

            def island() -> Iterator[tuple]:
                nonlocal word
                while True:
                    token = word[0]
                    kept.append(word)  # noqa: B023
                    word = next(stream, None)
                    yield token[1:]
                    if word is None or word[4] or word[0][0] != token[0]:
                        return

            for n, forced in walk(island(), limits):
                number += 1
                out.append((video,) + (None,) * 8 + (number, pos, n, forced, *_told(kept[:n], pos)))
                del kept[:n]
                pos += n
                if len(out) >= 4096:
                    done.append(batch_of(out))
                yield from done
                done.clear()
            if word is not None and word[0][0] != video:
                number = pos = 0
        yield from done
        if out:
            yield batch_of(out)

    def batch_of(out: list[tuple]) -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)
        out.clear()
        return batch

    from pyspark.sql.pandas.types import to_arrow_type

    span = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "end", "cue_index", "cue_token_start", "cue_token_end")]))
    columns = {"video_id": to_arrow_type(cues.schema["video_id"].dataType), "cue_index": pa.int64(), "n_words": pa.int64(), "n_removed": pa.int64(), "reason": pa.string(), "timing": pa.string(), "n_warned": pa.int64(), "start": pa.int64(), "end": pa.int64()}
    columns |= {"unit_no": pa.int64(), "unit_pos": pa.int64(), "unit_words": pa.int64(), "forced": pa.bool_(), "source_text": pa.string(), "times": pa.list_(pa.int64()), "intersects_clip": pa.bool_(), "source_cues": pa.list_(pa.int64()), "spans": span}
    names, types = list(columns), list(columns.values())
    schema = (
        f"video_id {id_kind}, cue_index long, n_words long, n_removed long, reason string, timing string, n_warned long, start long, end long, unit_no long, unit_pos long, unit_words long, forced boolean, "
        "source_text string, times array<long>, intersects_clip boolean, source_cues array<long>, spans array<struct<start:long,end:long,cue_index:long,cue_token_start:long,cue_token_end:long>>"
    )
    return state.mapInArrow(run, schema)


def _told(words: list[tuple], pos: int) -> tuple:
    """Text, times (of the first and last word, least, most), whether a word lies in the clip, cues and spans of a unit's words from ``pos`` on."""
    spans, cue, last = [], None, -1
    for k, ((_, _, _, _, own, _), _, i, _, _) in enumerate(words):
        if not spans or own != cue or i != last + 1:
            spans.append([pos + k, pos + k, own, i, i])
            cue = own
        spans[-1][1], spans[-1][4], last = pos + k + 1, i + 1, i
    starts, ends = [w[0][2] for w in words], [w[0][3] for w in words]
    inside = [w[3] for w in words if w[3] is not None]
    names = ("start", "end", "cue_index", "cue_token_start", "cue_token_end")
    times = [starts[0], ends[-1], min(starts), max(ends)]
    return " ".join(w[1] for w in words), times, any(inside) if inside else None, list(dict.fromkeys(w[0][4] for w in words)), [dict(zip(names, s, strict=True)) for s in spans]


def segment_spans(found: DataFrame) -> DataFrame:
    """What ``spans`` gives, of ``segments``."""
    return found.filter("unit_no is not null").select("video_id", "unit_pos", "unit_no", F.explode_outer("spans").alias("s")).select("video_id", "unit_pos", "unit_no", "s.*")


def segment_table(found: DataFrame, clip: tuple[int, int] | None = None, *, prefix: str = "u") -> DataFrame:
    """What ``units`` gives, of ``segments``."""
    made = found.filter("unit_no is not null").withColumn("n_words", F.col("unit_words"))
    for i, c in enumerate(("start_ms", "end_ms", "low", "high")):
        made = made.withColumn(c, F.col("times")[i])
    return _described(made, F.col("unit_no"), clip, prefix)


def segment_stats(found: DataFrame) -> DataFrame:
    """What ``stats`` gives, of ``segments``: one aggregation by video."""
    count = lambda test: F.count_if(test).cast("long")
    live, duplicate = F.col("n_words") - F.col("n_removed"), F.col("reason") == "duplicate_cue"
    total = lambda n, test=None: F.coalesce(F.sum(n if test is None else F.when(test, n)), F.lit(0)).cast("long")
    forced = F.coalesce("forced", F.lit(False))
    return found.groupBy("video_id").agg(
        F.count("cue_index").alias("extracted_cues"), count(duplicate).alias("removed_duplicate_cues"), total(live).alias("active_tokens"),
        total(F.col("n_removed"), duplicate).alias("removed_duplicate_tokens"), total(F.col("n_removed"), F.col("reason") == "rolling_overlap").alias("removed_overlap_tokens"),
        total(live, F.col("timing") == "vtt_inline").alias("inline_tokens"), total(live, F.col("timing") == "cue_proportional").alias("proportional_tokens"),
        F.count("unit_no").alias("units"), count(forced).alias("forced_splits"), count(F.col("unit_no").isNotNull() & ~F.col("intersects_clip")).alias("padding_only_units"),
        (total(F.col("n_warned")) + count(forced)).alias("warnings"),
    )


def spans(of_units: DataFrame) -> DataFrame:
    """video_id, unit_pos and the spans of each unit: runs of words that stand side by side in one cue."""
    own = Window.partitionBy("video_id", "unit_pos").orderBy("pos")
    starts = (F.lag("pos").over(own).isNull()) | (F.lag("cue_index").over(own) != F.col("cue_index")) | (F.lag("token_index").over(own) + 1 != F.col("token_index"))
    runs = of_units.withColumn("run", F.sum(starts.cast("int")).over(own.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("video_id", "unit_pos", "run").agg(
        F.min("pos").alias("start"), (F.max("pos") + 1).alias("end"), F.min("cue_index").alias("cue_index"),
        F.min("token_index").alias("cue_token_start"), (F.max("token_index") + 1).alias("cue_token_end"),
    )


def units(of_units: DataFrame, clip: tuple[int, int] | None = None, *, prefix: str = "u") -> DataFrame:
    """A row for each unit: id, text, times, cues in order of appearance, and what it has to do with the clip.

    Where words carry no ``intersects_clip`` all of them do; it is inherited from their cue.
    """
    inside = F.bool_or("intersects_clip") if "intersects_clip" in of_units.columns else F.lit(True)
    word = F.struct("pos", "text", "cue_index")
    found = of_units.groupBy("video_id", "unit_pos").agg(
        F.array_sort(F.collect_list(word)).alias("w"), F.min_by("token_start", "pos").alias("start_ms"), F.max_by("token_end", "pos").alias("end_ms"),
        F.min("token_start").alias("low"), F.max("token_end").alias("high"), F.first("forced").alias("forced"), inside.alias("intersects_clip"),
    )
    number = F.row_number().over(Window.partitionBy("video_id").orderBy("unit_pos"))
    text, cues = F.array_join(F.transform("w", lambda x: x.text), " "), F.array_distinct(F.transform("w", lambda x: x.cue_index))
    found = found.withColumn("n_words", F.size("w").cast("long")).withColumn("source_text", text).withColumn("source_cues", cues)
    return _described(found, number, clip, prefix)


def _described(found: DataFrame, number: Column, clip: tuple[int, int] | None, prefix: str) -> DataFrame:
    crosses = [(F.col("low") < F.lit(c)) & (F.col("high") > F.lit(c)) if clip else F.lit(False) for c in clip or (0, 0)]
    kind = F.when(~F.col("intersects_clip"), "padding_only").when(crosses[0], "crosses_clip_start").when(crosses[1], "crosses_clip_end").otherwise("inside_clip")
    return found.select(
        "video_id", F.format_string(prefix + "%03d", number).alias("unit_id"), number.cast("long").alias("unit_no"), "unit_pos", "n_words",
        "source_text", "start_ms", "end_ms", "source_cues", kind.alias("boundary_type"),
        (~F.col("intersects_clip")).alias("is_padding_only"), crosses[0].alias("crosses_clip_start"), crosses[1].alias("crosses_clip_end"), "intersects_clip", "forced",
    )


def invalid_words(active: DataFrame) -> DataFrame:
    """Words that stay and have no length: a cue with more words than milliseconds gives such; the file can't be used then."""
    reason = F.concat(F.lit("active token "), F.col("token_id").cast("string"), F.lit(" has invalid timing: start_ms >= end_ms"))
    return active.filter("token_start >= token_end").select("video_id", "token_id", reason.alias("reason"))


def word_runs(active: DataFrame) -> DataFrame:
    """video_id, cue_index, start, end: the words that stay as runs of neighbouring places in one cue."""
    own = Window.partitionBy("video_id", "cue_index").orderBy("pos")
    runs = active.select("video_id", "cue_index", "pos").withColumn("run", F.col("pos") - F.dense_rank().over(own))
    return runs.groupBy("video_id", "cue_index", "run").agg(F.min("pos").alias("start"), (F.max("pos") + 1).alias("end")).drop("run")


def invalid_units(made: DataFrame, of_spans: DataFrame, active: DataFrame) -> DataFrame:
    """What is wrong with units: times, their order, spans that leave the words, words in no or several units or of another cue.

    ``active`` is the words that stay, or their ``word_runs``. Spans and runs are compared as ranges, not word by word.
    """
    order = Window.partitionBy("video_id").orderBy("unit_pos")
    lag = lambda c: F.lag(c).over(order)
    checked = made.select(
        "video_id", "unit_pos",
        F.when(F.col("start_ms") >= F.col("end_ms"), "invalid timing").when((F.col("start_ms") < lag("start_ms")) | (F.col("end_ms") < lag("end_ms")), "non-monotonic unit order").alias("reason"),
    )
    runs = (active if "end" in active.columns else word_runs(active)).select("video_id", "cue_index", "start", "end").filter("start < end")
    of_spans = of_spans.select("video_id", "unit_pos", "cue_index", "start", "end")
    # strange: ranges that meet in a block of places
    blocks = F.explode(F.sequence(F.floor(F.col("start") / 64), F.floor((F.col("end") - 1) / 64))).alias("block")
    held = runs.select("video_id", F.col("cue_index").alias("own_cue"), F.col("start").alias("own_start"), F.col("end").alias("own_end"), blocks)
    met = of_spans.filter("start < end").select("*", blocks).join(held, ["video_id", "block"]).filter("start < own_end and own_start < end and cue_index <> own_cue")
    strange = met.select("video_id", "unit_pos", F.lit("span of another cue").alias("reason")).distinct()
    # each end of a range changes how many spans and runs lie over what follows; nothing else does
    ends = F.explode(F.array(F.struct(F.col("start").alias("at"), F.lit(1).alias("step")), F.struct(F.col("end").alias("at"), F.lit(-1).alias("step")))).alias("e")
    all_ends = of_spans.select("video_id", F.lit(True).alias("is_span"), "unit_pos", "start", "end", ends).union(runs.select("video_id", F.lit(False), F.lit(None).cast("long"), "start", "end", ends))
    all_ends = all_ends.select("video_id", "is_span", "unit_pos", "start", "end", "e.*")
    video = Window.partitionBy("video_id")
    upto = video.orderBy("at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    depth = lambda test: F.coalesce(F.sum(F.when(test, F.col("step"))).over(upto), F.lit(0))
    swept = all_ends.select(
        "*", depth(F.col("is_span") & (F.col("start") < F.col("end"))).alias("units"), depth(~F.col("is_span")).alias("words"),
        F.coalesce(F.max(F.when(~F.col("is_span"), F.col("end"))).over(video), F.lit(0)).alias("n"), F.row_number().over(video.orderBy("at")).alias("nth"),
    )
    most = F.max(F.when((F.col("words") > 0) & (F.col("units") != 1), F.col("units"))).over(video)
    outside = F.col("is_span") & (F.col("step") > 0) & ((F.col("start") < 0) | (F.col("end") > F.col("n")) | (F.col("start") >= F.col("end")))
    lost = F.when(F.col("most") > 1, "duplicate assignment").otherwise("missing coverage")
    found = F.array(
        F.when(outside, F.struct(F.col("unit_pos").alias("unit_pos"), F.lit("invalid span").alias("reason"))),
        F.when((F.col("nth") == 1) & F.col("most").isNotNull(), F.struct(F.lit(None).cast("long").alias("unit_pos"), lost.alias("reason"))),
    )
    told = swept.withColumn("most", most).select("video_id", F.explode_outer(F.filter(found, lambda x: x.isNotNull())).alias("f")).filter("f is not null").select("video_id", "f.*")
    return checked.filter("reason is not null").union(strange).union(told)


def warnings_of(rows: DataFrame, cut: DataFrame, made: DataFrame) -> DataFrame:
    """All warnings of a run in the order of its phases: words, rolling over, forced splits."""
    first = rows.select("video_id", F.lit(1).alias("phase"), F.col("cue_index").alias("at"), F.posexplode_outer("warnings").alias("n", "w")).filter("n is not null").select("video_id", "phase", "at", "n", "w.*")
    message = F.concat(F.lit("removed "), F.col("n_removed").cast("string"), F.lit(" rolling overlap tokens"))
    rolled = cut.filter("reason = 'rolling_overlap'")
    second = rolled.select("video_id", F.lit(2).alias("phase"), F.col("cue_index").alias("at"), F.lit(0).alias("n"), F.lit("rolling_overlap_removed").alias("code"), F.lit("info").alias("severity"), message.alias("message"))
    forced = made.filter("forced")
    third = forced.select("video_id", F.lit(3).alias("phase"), F.col("unit_no").alias("at"), F.lit(0).alias("n"), F.lit("forced_split").alias("code"), F.lit("warning").alias("severity"), F.lit("hard constraints forced fallback split selection").alias("message"))
    return first.union(second).union(third)


def stats(rows: DataFrame, cut: DataFrame, words: DataFrame, made: DataFrame, warnings: DataFrame) -> DataFrame:
    """The counts of a run, a row for each video; each table is aggregated once and joined by video."""
    count = lambda test: F.count_if(test).cast("long")
    live = ~F.col("is_removed")
    sides = [
        cut.groupBy("video_id").agg(count(F.col("reason") == "duplicate_cue").alias("removed_duplicate_cues")),
        words.groupBy("video_id").agg(
            count(live).alias("active_tokens"), count(F.col("removal_reason") == "duplicate_cue").alias("removed_duplicate_tokens"),
            count(F.col("removal_reason") == "rolling_overlap").alias("removed_overlap_tokens"), count(live & (F.col("timing") == "vtt_inline")).alias("inline_tokens"),
            count(live & (F.col("timing") == "cue_proportional")).alias("proportional_tokens"),
        ),
        made.groupBy("video_id").agg(F.count("*").alias("units"), count(F.col("forced")).alias("forced_splits"), count(F.col("is_padding_only")).alias("padding_only_units")),
        warnings.groupBy("video_id").agg(count(F.col("severity") == "warning").alias("warnings")),
    ]
    out = rows.groupBy("video_id").agg(F.count("*").alias("extracted_cues"))
    for side in sides:
        out = out.join(side, "video_id", "left")
    return out.na.fill(0)
