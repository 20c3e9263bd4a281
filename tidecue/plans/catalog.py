"""The queries of the library by name, and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidecue.functions import qa, text, timecode
from tidecue.operators import captions
from tidecue.plans import flow, segmentation
from tidecue.sources import cues as sources

# Planted by the number of a line, so that every rule has hits and misses: what follows the source, precedes and follows the translation.
PLANTS = (
    ("", "", ""),
    (" see http://a.test/x", "", ""),
    (" see http://a.test/x", "", " http://a.test/x"),
    (" use --flag now", "", ""),
    (" use --flag now", "", " --flag"),
    (" <b>x</b>", "", ""),
    ("", "```json ", ""),
    ("", "I'm sorry, ", ""),
    ("", "Note: ", ""),
    (" API_KEY", "", ""),
    (" open C:\\a\\b", "", ""),
    (" run main.py", "", ""),
    (" took 5 seconds", "", " took 5 minutes"),
    (" took 5 seconds", "", " took 5 s"),
    (" open /usr/lib/x.so", "", " open /usr/lib/y.so"),
)


def _cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources.from_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources.from_turns(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line and the next one of its document stand for a source and its translation, with what is planted. Nothing is shuffled."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "").alias("x"))
    rows = docs.select(F.col("doc_id").alias("video_id"), F.posexplode(F.zip_with("x", F.slice("x", F.lit(2), F.size("x")), lambda a, b: F.struct(a.alias("a"), b.alias("b")))).alias("k", "p"))
    plant = lambda i: F.get(F.array(*[F.lit(p[i]) for p in PLANTS]), F.col("k") % len(PLANTS))
    translation = F.concat(plant(1), F.coalesce("p.b", F.lit("")), plant(2))
    return rows.select("video_id", (F.col("k") + 1).cast("long").alias("cue_index"), F.concat("p.a", plant(0)).alias("source"), translation.alias("translation"))


def _rule(test) -> object:
    return lambda spark, sf_dir: _pairs(spark, sf_dir).filter(test(F.col("source"), F.col("translation"))).select("video_id", "cue_index")


def chapter_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _cues(spark, sf_dir)
    chapters = own.groupBy("video_id").agg(F.max("end_ms").alias("n")).select("video_id", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / 20000).cast("long"))).alias("window_id"))
    chapters = chapters.withColumn("window_start", F.col("window_id") * 20000).withColumn("window_end", F.col("window_start") + 20000)
    return captions.overlap_join(own, chapters, 20000).select("video_id", "cue_index", "window_id")


def bilingual(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = (F.col("cue_index") - 1) * 2500
    pairs = _pairs(spark, sf_dir).filter("translation <> ''").withColumn("start_ms", start).withColumn("end_ms", start + 2000 + F.length("source") % 1000)
    return captions.render_srt(pairs, F.concat("translation", F.lit("\n"), "source"))


def positional(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _turns(spark, sf_dir)
    rank = F.row_number().over(Window.partitionBy("video_id").orderBy("cue_index")).cast("long")
    side = lambda role, name: turns.filter(F.col("role") == role).select("video_id", rank.alias("pos"), F.col("source").alias(name))
    return side("user", "english").join(side("assistant", "other"), ["video_id", "pos"])


def round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = captions.render_srt(_cues(spark, sf_dir), F.trim("source")).withColumnRenamed("srt", "content")
    return sources.parse_srt(files).select("video_id", "cue_index", "source", "start_ms", "end_ms")


def vtt_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = captions.render_srt(_cues(spark, sf_dir), F.trim("source")).select("video_id", captions.srt_to_vtt(F.col("srt")).alias("content"))
    return sources.parse_vtt(files).select("video_id", "cue_index", "cue_id", "source", "start_ms", "end_ms")


def lenient_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = captions.render_srt(_cues(spark, sf_dir), F.trim("source")).withColumnRenamed("srt", "content")
    return sources.parse_srt_lenient(files)


def halves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation as one failed batch."""
    whole = _turns(spark, sf_dir).groupBy(F.col("video_id").alias("batch_id")).agg(F.array_sort(F.collect_list("cue_index")).alias("cues"))
    return captions.split_halves(whole).select("batch_id", F.col("half").cast("long").alias("half"), F.array_join("cues", ",").alias("cues"))


def glossary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources.glossary(spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("video_id"), "text"), "text")


def redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.when(F.col("doc_id") % 3 == 0, "").when(F.col("doc_id") % 3 == 1, "me:p@").otherwise(F.concat(F.lit("me:p@"), F.col("doc_id").cast("string"), F.lit("@")))
    url = F.concat(F.lit("https://"), name, F.lit("host/"), F.col("lang"))
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", text.redacted(url).alias("url"))


QUERIES = {
    "crop_rebase": lambda s, d: captions.crop(_cues(s, d), 5000, 20000).withColumns({"start": timecode.format_ms(F.col("start_ms")), "end": timecode.format_ms(F.col("end_ms"))}),
    "window_boundary_flags": lambda s, d: captions.window_flags(_cues(s, d), 6000, 15000, 2000, 2000),
    "chapter_overlap_join": chapter_join,
    "batch_assign": lambda s, d: captions.batches(_turns(s, d), 3).select("video_id", "cue_index", "batch_id"),
    "batch_contexts": lambda s, d: captions.batch_contexts(_turns(s, d), 3, 2, 2),
    "context_samples": lambda s, d: captions.samples(_cues(s, d)),
    "positional_merge": positional,
    "srt_render": lambda s, d: captions.render_srt(_cues(s, d), F.col("source")),
    "bilingual_render": bilingual,
    "transcript": lambda s, d: captions.transcript(_cues(s, d)),
    "tokens_proportional": lambda s, d: captions.tokens(_cues(s, d)),
    "srt_round_trip": round_trip,
    "vtt_round_trip": vtt_round_trip,
    "qa_empty": _rule(lambda a, b: qa.empty(b)),
    "qa_url": _rule(lambda a, b: qa.differ(a, b, qa.URL)),
    "qa_numeric": _rule(lambda a, b: qa.differ(a, b, qa.NUMBER)),
    "qa_leak": _rule(lambda a, b: qa.leaks_markup(b)),
    "qa_refusal": _rule(lambda a, b: qa.refuses(b)),
    "qa_polluted": _rule(lambda a, b: qa.polluted(b)),
    "qa_unit": _rule(qa.units_differ),
    "qa_option": _rule(lambda a, b: qa.differ(a, b, qa.OPTION)),
    "qa_code": _rule(qa.code_differs),
    "qa_env_var": _rule(lambda a, b: qa.differ(a, b, qa.ENV_VAR)),
    "qa_path": _rule(qa.paths_differ),
    "qa_short_technical": _rule(qa.too_short_technical),
    "qa_script": _rule(lambda a, b: qa.lacks_script(a, b, "zh")),
    "qa_issues": lambda s, d: _pairs(s, d).select("video_id", "cue_index", F.array_join(qa.issues(F.col("source"), F.col("translation"), "zh"), "; ").alias("issues")).filter("issues <> ''"),
    "qa_tag_count": _rule(qa.tags_differ),
    "qa_bracket": _rule(qa.brackets_differ),
    "qa_short": _rule(qa.too_short),
    "qa_long": _rule(qa.too_long),
    "timecode_format": lambda s, d: s.read.parquet(f"{d}/orders.parquet").select("o_orderkey", timecode.format_ms(F.col("o_orderkey") * 977).alias("t"), timecode.duration_display(F.col("o_orderkey") * 7).alias("shown"), timecode.parse_ms(timecode.format_ms(F.col("o_orderkey") * 977)).alias("back")),
    "html_tag_strip": lambda s, d: s.read.parquet(f"{d}/pages.parquet").select("page_id", F.sha2(text.without_tags(F.col("html")), 256).alias("stripped")),
    "shift_cues": lambda s, d: captions.shift(_cues(s, d), -4000),
    "srt_lenient_scan": lenient_scan,
    "batch_halves": halves,
    "glossary_head": glossary,
    "url_redacted": redacted,
    "file_size_display": lambda s, d: s.read.parquet(f"{d}/orders.parquet").select("o_orderkey", timecode.file_size(F.col("o_orderkey") * 64).alias("small"), timecode.file_size(F.col("o_orderkey") * F.col("o_orderkey") * 977).alias("large")),
    "source_hash": lambda s, d: s.read.parquet(f"{d}/documents.parquet").select("doc_id", F.sha2("text", 256).alias("hash")),
}

_T = "printf('%02d:%02d:%02d,%03d', ({0}) // 3600000, ({0}) // 60000 % 60, ({0}) // 1000 % 60, ({0}) % 1000)"
_CUES = r"""WITH l AS (SELECT doc_id AS video_id, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS x FROM documents),
c0 AS (SELECT video_id, unnest(x) AS source, generate_subscripts(x, 1)::BIGINT AS cue_index FROM l),
c AS (SELECT video_id, cue_index, source, (cue_index - 1) * 2500 AS start_ms, (cue_index - 1) * 2500 + 2000 + length(source) % 1000 AS end_ms FROM c0) """
_TURNS = """WITH c AS (SELECT conv_id AS video_id, (turn + 1)::BIGINT AS cue_index, role, text AS source FROM conversations) """
_PLANT = ["[" + ", ".join("'" + p[i].replace("'", "''") + "'" for p in PLANTS) + "][(cue_index - 1) % " + str(len(PLANTS)) + " + 1]" for i in range(3)]
_PAIRS = _CUES + f", p AS (SELECT video_id, cue_index, start_ms, source || {_PLANT[0]} AS source, {_PLANT[1]} || coalesce(lead(source) OVER (PARTITION BY video_id ORDER BY cue_index), '') || {_PLANT[2]} AS translation FROM c) "
_BAG = "list_sort(regexp_extract_all({}, '{}'))"
_GATE = r"(NOT regexp_full_match(source, '\s*https?://\S+\s*') AND NOT (regexp_matches(source, '\S\s+\S') AND (regexp_matches(source, '(^|\s)--') OR contains(source, '/') OR contains(source, '\'))) AND len(regexp_extract_all(source, '\pL')) >= 12 AND len(regexp_extract_all(source, '[A-Za-z]+')) >= 10)"
_STRIP = r"regexp_replace(translation, '^\s+|\s+$', '', 'g')"
_N = "(length({0}) - length(replace({0}, '{1}', '')) + length({0}) - length(replace({0}, '{2}', '')))"
_NUMBERS = r"\p{Nd}+(?:\.\p{Nd}+)?"


def _differ(pattern: str) -> str:
    return f"len(regexp_extract_all(source, '{pattern}')) > 0 AND {_BAG.format('source', pattern)} <> {_BAG.format(_STRIP, pattern)}"


def _units(text: str) -> str:
    pattern = qa.NUMBER_UNIT.removeprefix("(?iU)").replace(r"\d", r"\p{Nd}")
    cases = " ".join("WHEN lower(u) IN (" + ", ".join(f"'{x}'" for x in spellings) + f") THEN '{name}'" for name, spellings in qa.UNITS.items())
    units = f"list_transform(regexp_extract_all({text}, '{pattern}', 2, 'i'), lambda u: CASE {cases} ELSE lower(u) END)"
    return f"list_sort(list_transform(list_zip(regexp_extract_all({text}, '{pattern}', 1, 'i'), {units}), lambda x: x[1] || ' ' || x[2]))"


def _size(n: str) -> str:
    cases = " ".join(f"WHEN {n} < {1024 ** (k + 1)} THEN printf('%.1f {unit}', ({n}) / {1024**k}.0::DOUBLE)" for k, unit in enumerate(("B", "KB", "MB", "GB", "TB")))
    return f"CASE {cases} ELSE printf('%.1f PB', ({n}) / {1024**5}.0::DOUBLE) END"


def _where(test: str) -> str:
    return _PAIRS + "SELECT video_id, cue_index FROM p WHERE " + test


_W = r"\pL\pM\p{Nd}\p{Pc}"


def _env(text: str) -> str:
    # what stands between two names is doubled, as a pattern without look-behind takes it along
    return f"list_sort(regexp_extract_all(regexp_replace({text}, '([^{_W}])', '\\1\\1', 'g'), '(?:^|[^{_W}])([A-Z][A-Z0-9_]{{2,}})(?:[^{_W}]|$)', 1))"


def _paths(text: str) -> str:
    windows, posix = r"[A-Za-z]:\\\S+", rf"(?:^|[^A-Za-z0-9])(/(?:[{_W}.-]+/)+[{_W}.-]+)"
    return f"list_sort(list_concat(regexp_extract_all({text}, '{windows}'), regexp_extract_all({text}, '{posix}', 1)))"


ORACLE_SQL = {
    "crop_rebase": _CUES + f", k AS (SELECT video_id, row_number() OVER (PARTITION BY video_id ORDER BY cue_index) AS cue_index, source, greatest(start_ms, 5000) - 5000 AS start_ms, least(end_ms, 20000) - 5000 AS end_ms FROM c WHERE end_ms > 5000 AND start_ms < 20000) SELECT *, {_T.format('start_ms')} AS start, {_T.format('end_ms')} AS end FROM k",
    "window_boundary_flags": _CUES + "SELECT video_id, cue_index, end_ms > 6000 AND start_ms < 15000 AS intersects_clip, NOT (end_ms > 6000 AND start_ms < 15000) AS is_padding_only, start_ms < 6000 AND end_ms > 6000 AS crosses_clip_start, start_ms < 15000 AND end_ms > 15000 AS crosses_clip_end FROM c WHERE end_ms > 4000 AND start_ms < 17000",
    "chapter_overlap_join": _CUES + ", w AS (SELECT video_id, unnest(range(0, (max(end_ms) - 1) // 20000 + 1)) AS window_id FROM c GROUP BY video_id) SELECT c.video_id, cue_index, window_id FROM c JOIN w ON c.video_id = w.video_id AND end_ms > window_id * 20000 AND start_ms < window_id * 20000 + 20000",
    "batch_assign": _TURNS + "SELECT video_id, cue_index, (cue_index - 1) // 3 + 1 AS batch_id FROM c",
    "batch_contexts": _TURNS + ", b AS (SELECT DISTINCT video_id, (cue_index - 1) // 3 + 1 AS batch_id FROM c) SELECT b.video_id, batch_id, coalesce(string_agg(cue_index::VARCHAR, ',' ORDER BY cue_index) FILTER (cue_index BETWEEN batch_id * 3 - 4 AND batch_id * 3 - 3), '') AS context_before, string_agg(cue_index::VARCHAR, ',' ORDER BY cue_index) FILTER (cue_index BETWEEN batch_id * 3 - 2 AND batch_id * 3) AS target, coalesce(string_agg(cue_index::VARCHAR, ',' ORDER BY cue_index) FILTER (cue_index BETWEEN batch_id * 3 + 1 AND batch_id * 3 + 2), '') AS context_after FROM b JOIN c ON b.video_id = c.video_id GROUP BY b.video_id, batch_id",
    "context_samples": _CUES + ", n AS (SELECT *, count(*) OVER (PARTITION BY video_id) AS n FROM c) SELECT video_id, cue_index, 'front' AS section FROM n WHERE cue_index <= 5 UNION ALL SELECT video_id, cue_index, 'middle' FROM n WHERE cue_index > greatest((n - 5) // 2, 0) AND cue_index <= greatest((n - 5) // 2, 0) + 5 UNION ALL SELECT video_id, cue_index, 'tail' FROM n WHERE cue_index > n - 5",
    "positional_merge": _TURNS + ", u AS (SELECT video_id, row_number() OVER (PARTITION BY video_id ORDER BY cue_index) AS pos, source AS english FROM c WHERE role = 'user'), a AS (SELECT video_id, row_number() OVER (PARTITION BY video_id ORDER BY cue_index) AS pos, source AS other FROM c WHERE role = 'assistant') SELECT * FROM u JOIN a USING (video_id, pos)",
    "srt_render": _CUES + f"SELECT video_id, string_agg(cue_index::VARCHAR || chr(10) || {_T.format('start_ms')} || ' --> ' || {_T.format('end_ms')} || chr(10) || source || chr(10) || chr(10), '' ORDER BY cue_index) AS srt FROM c GROUP BY video_id",
    "bilingual_render": _PAIRS + f"SELECT video_id, string_agg(cue_index::VARCHAR || chr(10) || {_T.format('start_ms')} || ' --> ' || {_T.format('(start_ms + 2000 + length(source) % 1000)')} || chr(10) || translation || chr(10) || source || chr(10) || chr(10), '' ORDER BY cue_index) AS srt FROM p WHERE translation <> '' GROUP BY video_id",
    "transcript": _CUES + f"SELECT video_id, string_agg('[' || {_T.format('start_ms')} || '] ' || source, chr(10) ORDER BY cue_index) AS transcript, arg_max(end_ms, cue_index) AS duration_ms, count(*) AS n_cues, greatest(1, arg_max(end_ms, cue_index) // 180000) AS estimated_chapters FROM c GROUP BY video_id",
    "tokens_proportional": _CUES
    + rf""", t AS (SELECT *, list_filter(string_split_regex(regexp_replace(source, '<[^>]+>', ' ', 'g'), '\s+'), lambda y: y <> '') AS w FROM c), u AS (SELECT *, unnest(w) AS text, generate_subscripts(w, 1) - 1 AS i, len(w) AS n FROM t)
SELECT video_id, cue_index, i AS token_index, text, {segmentation._NORMAL.format("text")} AS normalized, start_ms + round_even((end_ms - start_ms) * i / n, 0)::BIGINT AS token_start, start_ms + round_even((end_ms - start_ms) * (i + 1) / n, 0)::BIGINT AS token_end FROM u""",
    "srt_round_trip": _CUES + "SELECT video_id, cue_index, trim(source) AS source, start_ms, end_ms FROM c",
    "vtt_round_trip": _CUES + "SELECT video_id, cue_index, cue_index::VARCHAR AS cue_id, trim(source) AS source, start_ms, end_ms FROM c",
    "qa_empty": _where(f"{_STRIP} = ''"),
    "qa_url": _where(_differ(r"https?://\S+")),
    "qa_numeric": _where(_differ(_NUMBERS)),
    "qa_option": _where(_differ(r"--[\pL\pM\p{Nd}\p{Pc}-]+")),
    "qa_leak": _where(f"contains({_STRIP}, '```') OR (regexp_full_match({_STRIP}, '(?s)\\{{.*\\}}|\\[.*\\]') AND (contains(translation, '\"id\"') OR contains(translation, '\"translation\"')))"),
    "qa_refusal": _where(" OR ".join("contains(lower(translation), '" + x.replace("'", "''") + "')" for x in qa.REFUSALS)),
    "qa_polluted": _where(" OR ".join(f"starts_with(lower({_STRIP}), '{x}')" for x in qa.POLLUTIONS)),
    "qa_unit": _where(f"len({_units('source')}) > 0 AND {_units('source')} <> {_units('translation')}"),
    "qa_env_var": _where(f"len({_env('source')}) > 0 AND {_env('source')} <> {_env(_STRIP)}"),
    "qa_path": _where(f"len({_paths('source')}) > 0 AND {_paths('source')} <> {_paths(_STRIP)}"),
    "qa_script": _where(f"{_GATE} AND NOT regexp_matches(translation, '[\u4e00-\u9fff]')"),
    "qa_tag_count": _where(rf"len(regexp_extract_all(source, '</?[^>\s]+(?:\s+[^>]*)?>')) <> len(regexp_extract_all({_STRIP}, '</?[^>\s]+(?:\s+[^>]*)?>'))"),
    "qa_bracket": _where(" OR ".join(f"({_N.format('source', *x)} > 0 AND abs({_N.format('source', *x)} - {_N.format(_STRIP, *x)}) >= 2)" for x in qa.BRACKETS)),
    "qa_short": _where(f"{_GATE} AND length({_STRIP}) < greatest(8.0, length(source) * 0.18)"),
    "qa_long": _where(f"{_GATE} AND length({_STRIP}) > greatest(80.0, length(source) * 3.5)"),
    "timecode_format": f"SELECT o_orderkey, {_T.format('o_orderkey * 977')} AS t, CASE WHEN o_orderkey * 7 >= 3600 THEN printf('%d:%02d:%02d', o_orderkey * 7 // 3600, o_orderkey * 7 // 60 % 60, o_orderkey * 7 % 60) ELSE printf('%02d:%02d', o_orderkey * 7 // 60, o_orderkey * 7 % 60) END AS shown, (o_orderkey * 977)::BIGINT AS back FROM orders",
    "html_tag_strip": "SELECT page_id, sha256(regexp_replace(html, '<[^>]+>', ' ', 'g')) AS stripped FROM pages",
    "shift_cues": _CUES + "SELECT video_id, cue_index, source, greatest(0, start_ms - 4000) AS start_ms, end_ms - 4000 AS end_ms FROM c WHERE end_ms > 4000",
    "srt_lenient_scan": _CUES + f"SELECT video_id, cue_index - 1 AS pos, cue_index::VARCHAR AS number, {_T.format('start_ms')} || ' --> ' || {_T.format('end_ms')} AS time, trim(source) AS source FROM c",
    "batch_halves": _TURNS + ", n AS (SELECT *, count(*) OVER (PARTITION BY video_id) AS n, row_number() OVER (PARTITION BY video_id ORDER BY cue_index) AS r FROM c) SELECT video_id AS batch_id, (r > n // 2)::BIGINT AS half, string_agg(cue_index::VARCHAR, ',' ORDER BY cue_index) AS cues FROM n WHERE n >= 2 GROUP BY ALL",
    "glossary_head": "SELECT doc_id AS video_id, left(coalesce(text, ''), 12000) AS glossary, length(coalesce(text, '')) > 12000 AS truncated, sha256(coalesce(text, '')) AS hash FROM documents",
    "url_redacted": "SELECT doc_id, 'https://' || CASE WHEN doc_id % 3 = 0 THEN '' ELSE '<redacted>@' END || 'host/' || lang AS url FROM documents",
    "file_size_display": f"SELECT o_orderkey, {_size('o_orderkey * 64')} AS small, {_size('o_orderkey * o_orderkey * 977')} AS large FROM orders",
    "source_hash": "SELECT doc_id, sha256(text) AS hash FROM documents",
}

QUERIES |= segmentation.QUERIES | flow.QUERIES
ORACLE_SQL |= segmentation.ORACLE_SQL | flow.ORACLE_SQL
