"""Queries on timed words and units, and their SQL. Lines of documents stand for cues; what rolls over, repeats, begins with a
strong phrase or carries times in its text is planted by the number of the line, so that every rule has hits and misses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidecue.functions import timecode
from tidecue.operators import units
from tidecue.sources import cues as sources

CLIP = (6000, 15000)


def _line_words(line: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(line, "[<>]", ""), r"\s+"), lambda y: y != "")


def rolling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line with the last words of the one before, some with a strong phrase, every seventh a repetition."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    lines = docs.select(F.col("doc_id").alias("video_id"), F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "").alias("x"))
    lines = lines.select("video_id", F.transform("x", F.length).alias("n"), F.transform("x", _line_words).alias("w"))
    none = F.array().cast("array<string>")

    def source(j: Column) -> Column:
        last = F.get("w", j - 1)
        before = F.when((j > 0) & (j % 4 > 0), F.slice(last, F.greatest(F.size(last) - j % 4, F.lit(0)) + 1, F.lit(3))).otherwise(none)
        phrase = F.when(j % 6 == 1, F.array(F.lit("okay"))).when(j % 6 == 3, F.split(F.lit("this next project"), " ")).when(j % 6 == 5, F.split(F.lit("so now"), " ")).otherwise(none)
        return F.array_join(F.concat(before, phrase, F.get("w", j)), " ")

    rows = lines.select("video_id", "w", F.posexplode("n").alias("k", "n"))
    start = F.col("k").cast("long") * 2500
    j = F.col("k") - (F.col("k") % 7 == 6).cast("int")
    return rows.select("video_id", (F.col("k") + 1).cast("long").alias("cue_index"), source(j).alias("source"), start.alias("start_ms"), (start + 2000 + F.col("n") % 1000).alias("end_ms"))


def stamped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with times in their text: for every word, for the second half, backwards, none, or tags of another kind."""
    rows = sources.from_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    kind, start = F.col("cue_index") % 5, F.col("start_ms")
    time = lambda ms: F.replace(timecode.format_ms(ms), F.lit(","), F.lit("."))

    def line(w: Column) -> Column:
        n = F.size(w)
        step = F.floor((F.col("end_ms") - start) / F.greatest(n, F.lit(1)))

        def word(x: Column, i: Column) -> Column:
            at = F.when(kind == 1, start + i * step).when((kind == 2) & (i >= F.floor(n / 2)), start + i * step + F.floor(step / 2)).when(kind == 3, start + (n - 1 - i) * step)
            return F.when(at.isNotNull(), F.concat(F.lit("<"), time(at), F.lit(">"), x)).when(kind == 4, F.concat(F.lit("<c>"), x, F.lit("</c>"))).otherwise(x)

        return F.array_join(F.transform(w, word), " ")

    # the words are bound once by an array around them
    return rows.withColumn("source", F.get(F.transform(F.array(_line_words(F.col("source"))), line), F.lit(0)))


def tokens_inline(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = units.tokenized(stamped(spark, sf_dir), "vtt")
    return rows.select("video_id", "cue_index", "timing", F.posexplode_outer("tokens").alias("i", "t")).filter("i is not null").select("video_id", "cue_index", F.col("i").cast("long").alias("token_index"), "t.*", "timing")


def token_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = units.tokenized(stamped(spark, sf_dir), "vtt").select("video_id", F.explode_outer("warnings").alias("w")).filter("w is not null")
    return rows.groupBy("video_id", F.col("w.code").alias("code"), F.col("w.severity").alias("severity")).agg(F.count("*").alias("n"))


def flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rolling lines with their relation to the clip."""
    return rolling(spark, sf_dir).withColumn("intersects_clip", (F.col("end_ms") > CLIP[0]) & (F.col("start_ms") < CLIP[1]))


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return units.token_table(units.tokenized(flagged(spark, sf_dir), "srt", single_file=True))


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return units.segments(flagged(spark, sf_dir), "srt", single_file=True)


def segment_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = units.segment_table(segments(spark, sf_dir), CLIP)
    return made.withColumn("source_cues", F.array_join(F.transform("source_cues", lambda x: x.cast("string")), ",")).drop("unit_pos")


def unit_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return units.segment_spans(segments(spark, sf_dir)).drop("unit_no")


def coverage_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The checks on spans of which every fifth unit's lose their last word and, in every third video, one is doubled."""
    found = segments(spark, sf_dir)
    cut = units.segment_spans(found).withColumn("end", F.when(F.col("unit_no") % 5 == 0, F.col("end") - 1).otherwise(F.col("end")))
    times = F.when((F.col("unit_no") == 1) & (F.col("video_id") % 3 == 0), 2).otherwise(1)
    cut = cut.select("*", F.explode(F.sequence(F.lit(1), times))).drop("col")
    found = units.invalid_units(units.segment_table(found, CLIP), cut, found.filter("cue_index is not null"))
    return found.filter("reason in ('invalid span', 'missing coverage', 'duplicate assignment')").groupBy("video_id", "reason").agg(F.count("*").alias("n"))


def words_without_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    short = rolling(spark, sf_dir).withColumn("end_ms", F.col("start_ms") + 3)
    return units.invalid_words(units.token_table(units.tokenized(short, "srt")).filter("pos is not null"))


def segmentation_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return units.segment_stats(segments(spark, sf_dir))


def strong_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    active = units.strong(words(spark, sf_dir).filter("pos is not null"))
    return active.filter("is_strong").select("video_id", "pos")


QUERIES = {
    "tokens_inline": tokens_inline,
    "token_warnings": token_warnings,
    "rolling_trim": lambda s, d: units.trimmed(units.tokenized(rolling(s, d), "srt")),
    "strong_phrase_positions": strong_positions,
    "segment_units": segment_units,
    "unit_spans": unit_spans,
    "unit_coverage_check": coverage_check,
    "words_without_length": words_without_length,
    "segmentation_stats": segmentation_stats,
}

_WORDS = r"list_filter(string_split_regex({}, '\s+'), lambda y: y <> '')"
_NORMAL = r"coalesce(nullif(regexp_replace(lower({0}), '^[^\pL\pM\p{{Nd}}\p{{Pc}}'']+|[^\pL\pM\p{{Nd}}\p{{Pc}}'']+$', '', 'g'), ''), lower({0}))"
_LINES = rf"""l AS (SELECT doc_id AS video_id, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS x FROM documents),
w AS (SELECT video_id, x, list_transform(x, lambda s: {_WORDS.format("regexp_replace(s, '[<>]', '', 'g')")}) AS w FROM l),
k AS (SELECT video_id, x, w, unnest(range(0, len(x))) AS k FROM w)"""
_ROLLING = (
    _LINES
    + """,
kk AS (SELECT *, k - (k % 7 = 6)::BIGINT AS j FROM k),
c AS (SELECT video_id, k + 1 AS cue_index, array_to_string(list_concat(list_concat(CASE WHEN j > 0 AND j % 4 > 0 THEN w[j][greatest(len(w[j]) - j % 4, 0) + 1:] ELSE [] END,
    CASE j % 6 WHEN 1 THEN ['okay'] WHEN 3 THEN ['this', 'next', 'project'] WHEN 5 THEN ['so', 'now'] ELSE [] END), w[j + 1]), ' ') AS source,
    k * 2500 AS start_ms, k * 2500 + 2000 + length(x[k + 1]) % 1000 AS end_ms FROM kk)"""
)
_TRIM = rf""",
t0 AS (SELECT *, {_WORDS.format("source")} AS words, lower(trim(regexp_replace(source, '\s+', ' ', 'g'))) AS cmp FROM c),
t AS (SELECT *, list_transform(words, lambda y: {_NORMAL.format("y")}) AS norm FROM t0),
r AS (SELECT DISTINCT video_id, 0::BIGINT AS cue_index, NULL::BIGINT AS p_end, NULL::VARCHAR AS p_text, []::VARCHAR[] AS p_words, 0::BIGINT AS n_words, 0::BIGINT AS n_removed, NULL::VARCHAR AS reason FROM t
    UNION ALL
    SELECT video_id, cue_index, CASE WHEN n > cut THEN end_ms ELSE p_end END, CASE WHEN n > cut THEN cmp ELSE p_text END, CASE WHEN n > cut THEN norm[cut + 1:] ELSE p_words END, n, cut,
        CASE WHEN dup THEN 'duplicate_cue' WHEN cut > 0 THEN 'rolling_overlap' END
    FROM (SELECT *, CASE WHEN dup THEN n ELSE coalesce(list_max(list_filter(range(1, least(len(p_words), n, 20) + 1), lambda q: p_words[-q:] = norm[1:q])), 0) END AS cut
        FROM (SELECT t.*, r.p_end, r.p_text, r.p_words, len(t.words)::BIGINT AS n, coalesce(t.cmp <> '' AND t.cmp = r.p_text AND abs(t.start_ms - r.p_end) <= 150, false) AS dup
            FROM r JOIN t ON t.video_id = r.video_id AND t.cue_index = r.cue_index + 1) z) z2),
cut AS (SELECT video_id, cue_index, n_words, n_removed, reason FROM r WHERE cue_index > 0)"""
_TOKENS = """,
tok0 AS (SELECT t.video_id, t.cue_index, t.start_ms AS cs, t.end_ms AS ce, n_words AS n, n_removed, reason, unnest(words) AS text, unnest(norm) AS norm, generate_subscripts(words, 1) - 1 AS i
    FROM t JOIN cut ON t.video_id = cut.video_id AND t.cue_index = cut.cue_index),
tok AS (SELECT *, cs + round_even((ce - cs) * i / n, 0)::BIGINT AS s, cs + round_even((ce - cs) * (i + 1) / n, 0)::BIGINT AS e,
    row_number() OVER (PARTITION BY video_id ORDER BY cue_index, i) - 1 AS token_id FROM tok0),
act AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY token_id) - 1 AS pos, dense_rank() OVER (PARTITION BY video_id ORDER BY cue_index) AS cr,
    sum(length(text)) OVER (PARTITION BY video_id ORDER BY token_id) AS upto, lead(cue_index) OVER (PARTITION BY video_id ORDER BY token_id) AS next_cue FROM tok WHERE i >= n_removed)"""
_PHRASES = " OR ".join(
    "(" + " AND ".join(f"lead(norm, {k}) OVER o = '{w.replace(chr(39), chr(39) * 2)}'" if k else f"norm = '{w.replace(chr(39), chr(39) * 2)}'" for k, w in enumerate(p.split())) + ")" for p in units.STRONG_PHRASES
)
_DANGLING = ", ".join("'" + w.replace("'", "''") + "'" for w in units.DANGLING)
_STRONG = f""",
act2 AS (SELECT *, coalesce({_PHRASES}, false) AS strong, norm IN ({_DANGLING}) AS dangles FROM act WINDOW o AS (PARTITION BY video_id ORDER BY pos))"""
_UNITS = """,
size AS (SELECT video_id, count(*) AS n_all FROM act2 GROUP BY video_id),
ahead AS (SELECT a.video_id, a.pos, min(b.pos) FILTER (b.pos > a.pos AND b.strong) AS s,
    min(b.pos) FILTER (b.upto - a.upto + length(a.text) + b.pos - a.pos > 180 OR b.e - a.s > 7000 OR b.cr - a.cr >= 4) AS v
    FROM act2 a JOIN act2 b ON a.video_id = b.video_id AND b.pos BETWEEN a.pos AND a.pos + 91 GROUP BY a.video_id, a.pos),
good AS (SELECT *, max(CASE WHEN NOT dangles THEN pos + 1 END) OVER o AS g, max(CASE WHEN next_cue <> cue_index THEN pos + 1 END) OVER o AS edge FROM act2 WINDOW o AS (PARTITION BY video_id ORDER BY pos)),
nxt AS (SELECT h.video_id, h.pos, coalesce(v < coalesce(h.s, v + 1), false) AS forced,
    CASE WHEN v < coalesce(h.s, v + 1) THEN CASE WHEN g.g > h.pos AND v > h.pos THEN g.g WHEN g.edge > h.pos AND v > h.pos THEN g.edge ELSE greatest(h.pos + 1, v) END ELSE coalesce(h.s, n_all) END AS stop
    FROM ahead h JOIN size USING (video_id) LEFT JOIN good g ON g.video_id = h.video_id AND g.pos = h.v - 1),
walk AS (SELECT video_id, pos, stop, forced FROM nxt WHERE pos = 0 UNION ALL SELECT nxt.video_id, nxt.pos, nxt.stop, nxt.forced FROM walk JOIN nxt ON nxt.video_id = walk.video_id AND nxt.pos = walk.stop),
no AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY pos) AS unit_no FROM walk),
u AS (SELECT no.video_id, unit_no, no.pos AS unit_pos, any_value(no.forced) AS forced, count(*) AS n_words, string_agg(text, ' ' ORDER BY a.pos) AS source_text, arg_min(s, a.pos) AS start_ms, arg_max(e, a.pos) AS end_ms,
    min(s) AS low, max(e) AS high, list_distinct(list(cue_index)) AS cue_list, bool_or(ce > 6000 AND cs < 15000) AS inside
    FROM no JOIN act2 a ON a.video_id = no.video_id AND a.pos >= no.pos AND a.pos < no.stop GROUP BY no.video_id, unit_no, no.pos)"""
_SPANS = """,
lab AS (SELECT a.*, no.pos AS unit_pos, unit_no FROM no JOIN act2 a ON a.video_id = no.video_id AND a.pos >= no.pos AND a.pos < no.stop),
brk AS (SELECT *, coalesce(lag(cue_index) OVER o <> cue_index OR lag(i) OVER o + 1 <> i, true) AS b FROM lab WINDOW o AS (PARTITION BY video_id, unit_pos ORDER BY pos)),
run AS (SELECT *, sum(b::INT) OVER (PARTITION BY video_id, unit_pos ORDER BY pos) AS rn FROM brk),
sp AS (SELECT video_id, unit_pos, any_value(unit_no) AS unit_no, min(pos) AS start, max(pos) + 1 AS end, min(cue_index) AS cue_index, min(i) AS cue_token_start, max(i) + 1 AS cue_token_end FROM run GROUP BY video_id, unit_pos, rn)"""
_ALL = "WITH RECURSIVE " + _ROLLING + _TRIM + _TOKENS + _STRONG
_CROSS = "(low < {0} AND high > {0})"
_STAMPED = rf"""WITH {_LINES},
c AS (SELECT video_id, k + 1 AS cue_index, w[k + 1] AS v, k * 2500 AS s, k * 2500 + 2000 + length(x[k + 1]) % 1000 AS e FROM k),
q AS (SELECT *, len(v) AS n, (e - s) // greatest(len(v), 1) AS step FROM c),
m AS (SELECT *, CASE WHEN n = 0 OR cue_index % 5 IN (0, 4) THEN 'none' WHEN cue_index % 5 = 3 THEN CASE WHEN n = 1 THEN 'inline' WHEN step > 0 THEN 'shrinks' ELSE 'empty' END
    WHEN step > 0 OR n = 1 THEN 'inline' WHEN cue_index % 5 = 2 THEN 'prefix' ELSE 'empty' END AS state FROM q)"""

ORACLE_SQL = {
    "tokens_inline": _STAMPED
    + """, t AS (SELECT *, unnest(v) AS text, generate_subscripts(v, 1) - 1 AS i FROM m),
a AS (SELECT *, CASE WHEN state <> 'inline' THEN s + round_even((e - s) * i / n, 0)::BIGINT WHEN cue_index % 5 = 1 THEN s + i * step WHEN cue_index % 5 = 3 THEN s
    WHEN i >= n // 2 THEN s + i * step + step // 2 ELSE s + ((n // 2) * step + step // 2) * i // (n // 2) END AS token_start FROM t)
SELECT video_id, cue_index, i AS token_index, text, token_start, CASE WHEN state <> 'inline' THEN s + round_even((e - s) * (i + 1) / n, 0)::BIGINT
    ELSE coalesce(lead(token_start) OVER (PARTITION BY video_id, cue_index ORDER BY i), e) END AS token_end, CASE WHEN state = 'inline' THEN 'vtt_inline' ELSE 'cue_proportional' END AS timing FROM a""",
    "token_warnings": _STAMPED
    + """ SELECT video_id, code, severity, count(*) AS n FROM (SELECT video_id, 'proportional_timing_fallback' AS code, 'info' AS severity FROM m WHERE state <> 'inline'
    UNION ALL SELECT video_id, 'invalid_inline_timing', CASE state WHEN 'prefix' THEN 'info' ELSE 'warning' END FROM m WHERE state IN ('prefix', 'shrinks', 'empty')) GROUP BY ALL""",
    "rolling_trim": "WITH RECURSIVE " + _ROLLING + _TRIM + " SELECT * FROM cut",
    "strong_phrase_positions": _ALL + " SELECT video_id, pos FROM act2 WHERE strong",
    "segment_units": _ALL
    + _UNITS
    + f""" SELECT video_id, printf('u%03d', unit_no) AS unit_id, unit_no, n_words, source_text, start_ms, end_ms, array_to_string(list_sort(cue_list), ',') AS source_cues,
    CASE WHEN NOT inside THEN 'padding_only' WHEN {_CROSS.format(CLIP[0])} THEN 'crosses_clip_start' WHEN {_CROSS.format(CLIP[1])} THEN 'crosses_clip_end' ELSE 'inside_clip' END AS boundary_type,
    NOT inside AS is_padding_only, {_CROSS.format(CLIP[0])} AS crosses_clip_start, {_CROSS.format(CLIP[1])} AS crosses_clip_end, inside AS intersects_clip, forced FROM u""",
    "unit_spans": _ALL + _UNITS + _SPANS + ' SELECT video_id, unit_pos, start, "end", cue_index, cue_token_start, cue_token_end FROM sp',
    "unit_coverage_check": _ALL
    + _UNITS
    + _SPANS
    + """, sh AS (SELECT video_id, unit_no, start, "end" - (unit_no % 5 = 0)::INT AS stop FROM sp), tw AS (SELECT * FROM sh UNION ALL SELECT * FROM sh WHERE unit_no = 1 AND video_id % 3 = 0)
SELECT video_id, 'invalid span' AS reason, count(*) AS n FROM tw WHERE start >= stop GROUP BY video_id
UNION ALL SELECT video_id, CASE WHEN video_id % 3 = 0 THEN 'duplicate assignment' ELSE 'missing coverage' END, 1 FROM (SELECT video_id, max(unit_no) AS top FROM sp GROUP BY video_id) WHERE video_id % 3 = 0 OR top >= 5""",
    "words_without_length": "WITH RECURSIVE "
    + _ROLLING.replace("k * 2500 + 2000 + length(x[k + 1]) % 1000 AS end_ms", "k * 2500 + 3 AS end_ms")
    + _TRIM
    + _TOKENS
    + " SELECT video_id, token_id, 'active token ' || token_id || ' has invalid timing: start_ms >= end_ms' AS reason FROM act WHERE s >= e",
    "segmentation_stats": _ALL
    + _UNITS
    + """, a1 AS (SELECT video_id, count(*) AS extracted_cues, count(*) FILTER (n_words > 0) AS degraded, count(*) FILTER (reason = 'duplicate_cue') AS removed_duplicate_cues,
    sum(CASE WHEN reason = 'duplicate_cue' THEN n_removed ELSE 0 END)::BIGINT AS removed_duplicate_tokens, sum(CASE WHEN reason = 'rolling_overlap' THEN n_removed ELSE 0 END)::BIGINT AS removed_overlap_tokens FROM cut GROUP BY video_id),
a2 AS (SELECT video_id, count(*) AS active_tokens FROM act2 GROUP BY video_id),
a3 AS (SELECT video_id, count(*) AS units, count(*) FILTER (forced) AS forced_splits, count(*) FILTER (NOT inside) AS padding_only_units FROM u GROUP BY video_id)
SELECT a1.video_id, extracted_cues, removed_duplicate_cues, coalesce(active_tokens, 0) AS active_tokens, removed_duplicate_tokens, removed_overlap_tokens, 0::BIGINT AS inline_tokens, coalesce(active_tokens, 0) AS proportional_tokens,
    coalesce(units, 0) AS units, coalesce(forced_splits, 0) AS forced_splits, coalesce(padding_only_units, 0) AS padding_only_units, degraded + coalesce(forced_splits, 0) AS warnings
FROM a1 LEFT JOIN a2 USING (video_id) LEFT JOIN a3 USING (video_id)""",
}
