"""Queries on batches, answers, the cache, reviews and reports, and their SQL. Turns of conversations stand for cues; answers, faults and
failures are planted by number, so that every rule has hits and misses."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidecue.functions import prompts, text, timecode
from tidecue.operators import calls, captions, checks, reports, semantic, units
from tidecue.sources import cues as sources
from tidecue.sources import files

FAULTS = ("none", "fence", "json", "array", "count", "keys", "blank id", "twice", "context", "unknown", "type", "empty")


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources.from_turns(spark.read.parquet(f"{sf_dir}/conversations.parquet")).withColumn("cue_id", F.concat(F.lit("c"), F.col("cue_index").cast("string")))


def _batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calls.made_batches(_turns(spark, sf_dir), 4, 2, 2)


def broken(batch: calls.Batch, fault: str) -> str:
    """An answer to ``batch`` with one fault."""
    ids = calls.record_ids(batch)
    items: list = [{"cue_id": ids[c["cue_index"]], "translation": f"t{c['cue_index']}"} for c in batch.cues]
    first = items[0]
    if fault == "count":
        items = items[1:]
    elif fault == "keys":
        first["note"] = "x"
    elif fault == "blank id":
        first["cue_id"] = " "
    elif fault == "twice":
        items[-1]["cue_id"] = first["cue_id"]
    elif fault == "context":
        first["cue_id"] = ids[(batch.after or batch.before or batch.cues)[0]["cue_index"]]
    elif fault == "unknown":
        first["cue_id"] = "zzz"
    elif fault == "type":
        first["translation"] = 7
    elif fault == "empty":
        first["translation"] = " "
    if fault == "json":
        return "{not json"
    if fault == "array":
        return json.dumps({"items": items})
    return f"```json\n{json.dumps(items)}\n```" if fault == "fence" else json.dumps(items)


def failing(batch: calls.Batch, attempt: int, route: str) -> str:
    """Planted by the first cue of a batch: a timeout, bad text, a wrong shape, at first or always, and sound answers."""
    kind = batch.cues[0]["cue_index"] // 4 % 5
    if kind == 1 and attempt < 3:
        raise calls.CallError("provider_timeout", "translation provider request timed out")
    if kind == 2 and route == "main":
        raise calls.CallError("provider_http_5xx", "translation provider HTTP 503")
    if kind == 3 and len(batch.cues) > 2:
        return broken(batch, "count")
    if kind == 4 and attempt == 1:
        return broken(batch, "json")
    return broken(batch, "none")


POLICY = calls.Policy(max_retries=2, fallback=True)


def _answered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calls.translated(_batches(spark, sf_dir), failing, POLICY)


def batch_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _answered(spark, sf_dir)
    return out.select("video_id", "batch_id", "state", "cue_count", "attempts", "calls", "fallback_calls", "retries", "error_type", "route", F.array_join(F.col("child_batch_ids").cast("array<string>"), ",").alias("children"), "split_attempt")


def translations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _answered(spark, sf_dir).select("video_id", F.explode("answers").alias("a")).select("video_id", "a.*")


def run_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calls.counters(_answered(spark, sf_dir))


def answer_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every batch with every fault."""
    from collections.abc import Iterator

    import pyarrow as pa

    batches = _batches(spark, sf_dir)
    kind = batches.schema["video_id"].dataType.simpleString()
    cue = "array<struct<cue_id:string,cue_index:bigint,source:string>>"

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            out = []
            for r in batch.to_pylist():
                own = calls.Batch(r["batch_id"], r["cues"], r["before"], r["after"])
                out += [r | {"response": broken(own, f), "batch_id": r["batch_id"] * 100 + k} for k, f in enumerate(FAULTS)]
            yield pa.RecordBatch.from_pylist(out, schema=batch.schema.append(pa.field("response", pa.string())))

    given = batches.select("video_id", "batch_id", "cues", "before", "after").mapInArrow(run, f"video_id {kind}, batch_id long, cues {cue}, before {cue}, after {cue}, response string")
    return calls.checked(given).select("video_id", "batch_id", "ok", "error_type", F.size("answers").cast("long").alias("n"))


def review_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A review for each conversation with a fault by its number; the fixes are laid over the turns."""
    turns = _turns(spark, sf_dir)
    item = F.struct("cue_index", "cue_id")
    lists = turns.groupBy("video_id").agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x.cue_id).alias("ids"))
    kind = F.col("video_id") % 5
    action = lambda i: F.when(i % 3 == 0, "fix").otherwise("keep")
    reason = lambda i: F.when((kind == 1) & (i == 0), " ").otherwise("r")
    one = lambda x, i: F.concat(F.lit('{"id": "'), x, F.lit('", "action": "'), action(i), F.lit('", "translation": "new '), x, F.lit('", "reason": "'), reason(i), F.lit('"}'))
    listed = F.transform(F.when(kind == 2, F.reverse("ids")).otherwise(F.col("ids")), one)
    body = F.concat(F.lit("["), F.array_join(F.when(kind == 3, F.slice(listed, F.lit(2), F.size(listed))).otherwise(listed), ", "), F.lit("]"))
    got = calls.reviewed(lists.withColumn("response", body))
    fixes = got.select("video_id", F.explode("fixes").alias("f")).select("video_id", "f.*")
    return calls.overlaid(turns.select("video_id", "cue_id", F.col("source").alias("translation")), fixes)


def prompt_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    prompt = prompts.translate_prompt(F.col("before"), F.col("cues"), F.col("after"), lang="zh-CN", glossary=F.lit(" "), context=F.lit("about it"), key="cue_id")
    named = _batches(spark, sf_dir).select("video_id", "batch_id", F.sha2(prompt, 256).alias("batch_source_hash"))
    fields = {k: F.lit(k) for k in prompts.KEY_FIELDS} | {"batch_source_hash": F.col("batch_source_hash"), "structured_output": F.lit(True), "target_lang": F.lit("zh-CN")}
    return named.withColumn("cache_key", prompts.cache_key(fields))


def _cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An older cache: documents by source, without the columns that came later."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.filter("doc_id % 3 <> 0").select(F.concat(F.lit("k"), (F.col("doc_id") % 150).cast("string")).alias("cache_key"), F.col("lang").alias("target_lang"), F.concat(F.lit("r"), F.col("doc_id").cast("string")).alias("result_json"), F.lpad(F.col("doc_id").cast("string"), 9, "0").alias("updated_at"))


def cache_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = calls.migrated(_cache(spark, sf_dir).filter("result_json like '%1'"))
    new = calls.migrated(_cache(spark, sf_dir).filter("not result_json like '%1'"))
    return calls.stored(old, new).select("cache_key", "engine_version", "structured_output", "target_lang", "result_json", "updated_at")


def cache_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = spark.range(0, 200).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("cache_key"))
    cache = calls.stored(_cache(spark, sf_dir), _cache(spark, sf_dir))
    return calls.looked_up(asked, cache).withColumn("is_hit", F.col("response").isNotNull())


def adaptive_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select((F.col("user_id") % 50).alias("run_id"), F.col("event_id").alias("pos"), (F.col("event_id") % 7 > 1).alias("ok"))
    return calls.adaptive(events, 4)


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    ok = F.col("event_id") % 11 != 0
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select((F.col("user_id") % 20).alias("run_id"), "event_id")
    split = F.col("event_id") % 9 == 0
    return e.select(
        "run_id", F.col("event_id").alias("pos"), F.col("event_id").alias("batch_id"), F.when(ok, "success").otherwise("failed_permanent").alias("state"), (F.col("event_id") % 4).alias("attempts"), F.lit(None).cast("long").alias("attempt"),
        (F.col("event_id") % 4 == 0).alias("cache_hit"), F.struct((F.col("event_id") * 3).alias("lo"), (F.col("event_id") * 3 + 2).alias("hi")).alias("cue_range"), F.when(F.col("event_id") % 5 == 0, "invalid_json").alias("error_type"), F.lit(None).cast("long").alias("duration_ms"),
        F.when(split, "shrink").when(F.col("event_id") % 6 == 0, "fallback").otherwise("main").alias("route"), F.lit(None).cast("long").alias("parent_batch_id"), F.when(split, F.array(F.col("event_id") * 2, F.col("event_id") * 2 + 1)).otherwise(F.array().cast("array<long>")).alias("child_batch_ids"),
        F.when(split, F.when(F.col("event_id") % 2 == 0, "schema_mismatch").otherwise("invalid_json")).alias("split_reason"), F.when(split, F.col("event_id") % 2 + 1).alias("split_attempt"), F.when(split, "v1").alias("split_strategy_version"), F.when(split, F.struct(F.lit(1).alias("lo"), F.lit(2).alias("hi"))).alias("original_range"),
    )


def batch_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.batch_summary(_entries(spark, sf_dir)).withColumn("details", F.sha2("details", 256))


def report_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = reports.batch_summary(_entries(spark, sf_dir)).withColumns({"failed_batches": (F.col("run_id") % 3).cast("long"), "qa_failed": (F.col("run_id") % 2).cast("long"), "fallback_provider_calls": F.lit(0)})
    return rows.select("run_id", reports.shrink_section().alias("shrink"), reports.batch_section().alias("batches"), reports.terminal_section().alias("terminal"), reports.warning_section().alias("warned"))


def global_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = sources.from_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    name = F.concat(F.lit("d"), F.col("video_id").cast("string"), F.lit(".srt"))
    return reports.global_context(own, captions.samples(own), settings={"target_lang": "zh-CN", "mode": "balanced", "batch_size": 80}, name=name).select("video_id", "hash")


def chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    words = F.filter(F.array(F.when(F.col("doc_id") % 2 == 0, F.col("lang")), F.when(F.col("doc_id") % 3 == 0, F.col("source"))), lambda x: x.isNotNull())
    page = reports.chapter_summary(F.when(F.col("doc_id") % 4 > 0, F.col("lang")), F.lit("00:00 - 03:00"), F.lit(None).cast("string"), F.when(F.col("doc_id") % 5 > 0, words), F.lit(None).cast("string"))
    return docs.select("doc_id", page.alias("page"))


def lenient_vtt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cues of documents as WebVTT with styles, digits, settings, tags and commas planted by number."""
    own = sources.from_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    time = lambda c: F.replace(timecode.format_ms(F.col(c)), F.lit(","), F.when(F.col("cue_index") % 13 == 0, ",").otherwise("."))
    k = F.col("cue_index")
    body = F.concat(F.when(k % 11 == 0, "STYLE\n::cue {}\n\n").otherwise(""), F.when(k % 2 == 0, F.concat(k.cast("string"), F.lit("\n"))).otherwise(""), time("start_ms"), F.lit(" --> "), time("end_ms"), F.when(k % 3 == 0, " align:start position:0%").otherwise(""))
    line = F.regexp_replace(F.regexp_replace("source", r"[<>]|-->|STYLE", ""), r"^\s+|\s+$", "")
    block = F.concat(body, F.lit("\n"), F.when(k % 5 == 0, F.concat(F.lit("<i>"), line, F.lit("</i>"))).otherwise(F.concat(F.lit("x"), line)), F.lit("\n\n"))
    text_of = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("cue_index", block.alias("b")))), lambda x: x.b), "")
    content = own.groupBy("video_id").agg(F.concat(F.lit("WEBVTT\nKind: captions\n\n"), text_of).alias("content"))
    return files.parse_vtt_lenient(content).select("video_id", F.rint(F.col("start") * 1000).cast("long").alias("start_ms"), F.rint(F.col("end") * 1000).cast("long").alias("end_ms"), "text")


def srt_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rendered cues, which overlap where lines are long, with wrong numbers, short blocks and turned times planted."""
    own = sources.from_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    k = F.col("cue_index")
    start, end = timecode.format_ms(F.col("start_ms")), timecode.format_ms(F.col("end_ms"))
    block = F.concat(F.when(k % 7 == 0, "9999").otherwise(k.cast("string")), F.lit("\n"), F.when(k % 5 == 0, F.concat(end, F.lit(" --> "), start)).when(k % 6 == 0, "soon").otherwise(F.concat(start, F.lit(" --> "), end)), F.when(k % 11 == 0, "").otherwise("\ntext"), F.lit("\n\n"))
    content = own.groupBy("video_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("cue_index", block.alias("b")))), lambda x: x.b), "").alias("content"))
    return files.check_srt(content)


def scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("o_orderkey")
    url = F.when(n % 3 == 0, F.concat(F.lit("https://www.youtube.com/watch?v=a"), n.cast("string"))).when(n % 3 == 1, F.concat(F.lit("http://youtu.be/b"), n.cast("string"))).otherwise(F.concat(F.lit("see https://youtu.be/c"), n.cast("string")))
    message = F.concat(F.lit("fail http://u:p@h/x"), n.cast("string"), F.lit(" and me:secret@h2"))
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        "o_orderkey", text.is_video_url(url).alias("is_video"), text.safe_message(message).alias("message"), text.video_folder(F.when(n % 2 == 0, "You Tube!"), F.lit(None).cast("string"), n).alias("folder"),
        text.path_part(F.concat(F.lit(" A/b  c."), n.cast("string")), "none").alias("part"), text.progress_bar(n % 100, F.when(n % 10 > 0, F.lit(100))).alias("bar"),
        text.file_name(F.concat(F.lit(" a:b?c__"), n.cast("string"), F.lit(" .mp4"))).alias("file"), (timecode.seconds_of(F.concat((n % 50).cast("string"), F.lit(":"), (n % 60).cast("string"), F.lit(".5"))) * 1000).cast("long").alias("ms"),
        timecode.seconds_text((n * 977) / 1000, comma=True).alias("shown"), text.is_provider_url(F.when(n % 2 == 0, "http://h/v1").otherwise("ftp://h")).alias("is_provider"),
    )


def _words(source):
    return F.filter(F.split(text.without_tags(source), r"(?U)\s+"), lambda x: x != "")


def _proposed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Units by rule of conversations, their words, and proposals of ten words a segment with faults by the video's number."""
    turns = sources.from_turns(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    active = units.token_table(units.tokenized(turns, "srt"), units.Limits(drop_repeats=False, trim_overlap=False)).filter("pos is not null")
    labelled = units.units_of(active)
    made = units.units(labelled)
    words = active.withColumn("place", F.col("pos"))  # none of these units is padding
    kind, last = F.col("video_id") % 8, F.floor((F.col("n") - 1) / 10).cast("int")

    def segment(i):
        start = F.when((kind == 5) & (i == 0), 1).otherwise(i * 10)
        stop = F.least(F.col("n"), i * 10 + 10) + F.when((kind == 2) & (i == 0), -1).when((kind == 3) & (i == 0), 1).when((kind == 6) & (i == last), -1).otherwise(0)
        extra = F.when((kind == 4) & (i == 0), ', "text": "x"').otherwise("")
        return F.concat(F.lit('{"start_token": "'), start.cast("string"), F.lit('", "end_token": '), stop.cast("string"), extra, F.lit("}"))

    sizes = turns.groupBy("video_id").agg(F.sum(F.size(_words(F.col("source")))).alias("n")).filter("n > 0")
    listed = F.array_join(F.transform(F.sequence(F.lit(0), last), segment), ", ")
    payload = F.when(kind == 1, "{not json").otherwise(F.concat(F.lit('{"segments": ['), F.when(kind == 7, "").otherwise(listed), F.lit("]}")))
    return made, words, sizes.select("video_id", payload.alias("payload"))


WIDE = semantic.Options(max_chars=10**6, max_duration_ms=10**9, max_words=10**6)


def semantic_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, words, payloads = _proposed(spark, sf_dir)
    reason = F.when(F.col("reason").startswith("parse_error"), "parse_error").otherwise(F.col("reason"))
    return semantic.faults(semantic.proposals(payloads), words, WIDE).select("video_id", reason.alias("reason"))


def semantic_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    made, words, payloads = _proposed(spark, sf_dir)
    out = semantic.refined(made, words, payloads, WIDE)
    return out.filter("mode = 'semantic'").select("video_id", "nth", "unit_id", "source_text", "start_ms", "end_ms")


def _faulty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as cues with faults by number."""
    own = sources.from_lines(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumnRenamed("cue_index", "pos")
    k = F.col("pos")
    return own.select(
        "video_id", "pos", F.when(k % 9 == 0, k + 1).otherwise(k).alias("cue_index"), F.when(k % 17 == 0, " ").when((k % 7 == 0) & (k > 1), (k - 1).cast("string")).otherwise(k.cast("string")).alias("cue_id"),
        F.when(k % 13 == 0, F.lit(None)).otherwise(timecode.format_ms(F.col("start_ms"))).alias("start"), timecode.format_ms(F.col("end_ms")).alias("end"), F.when(k % 11 == 0, "\t").otherwise(F.col("source")).alias("source"),
    )


def cue_first_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.first_fault(checks.cue_faults(_faulty(spark, sf_dir)))


def _partly(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    turns = _turns(spark, sf_dir)
    k = F.col("cue_index")
    other = turns.filter(k % 5 != 0).select("video_id", F.when(k % 7 == 0, F.concat(F.lit("z"), F.col("cue_id"))).otherwise(F.col("cue_id")).alias("cue_id"), F.when(k % 3 == 0, " ").otherwise(F.concat(F.lit("t "), F.col("source"))).alias("translation"))
    return turns, other


def translation_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.incomplete(*_partly(spark, sf_dir))


def bilingual_older(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns, other = _partly(spark, sf_dir)
    rows = checks.with_translations(turns, other, instead="[未翻译]")
    return checks.bilingual_file(rows.select("video_id", "cue_index", (F.col("start_ms") / 1000).alias("start"), (F.col("end_ms") / 1000).alias("end"), F.col("source").alias("text"), "translation"))


def unit_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The artifacts of each conversation's units: the renumbered file, and the hashes of the two documents' unit lists."""
    turns = sources.from_turns(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    labelled = units.units_of(units.token_table(units.tokenized(turns, "srt"), units.Limits(drop_repeats=False, trim_overlap=False)).filter("pos is not null"))
    made = units.units(labelled)
    docs = reports.unit_documents(reports.unit_payload(made, units.spans(labelled)), mode="single_file", input_format="srt")
    srt = captions.render_srt(made.withColumnRenamed("unit_no", "cue_index"), F.col("source_text"))
    ids = F.array_join(F.from_json("units_json", "units array<struct<unit_id:string>>")["units"]["unit_id"], ",")
    keys = F.array_join(F.map_keys(F.from_json("cue_map_json", "units map<string,string>")["units"]), ",")
    return docs.join(srt, "video_id").select("video_id", ids.alias("unit_ids"), (keys == ids).alias("same_keys"), F.get_json_object("units_json", "$.schema_version").alias("version"), F.regexp_count("srt", F.lit("(?m)^\\d+\n\\d\\d:")).cast("long").alias("blocks"))


QUERIES = {
    "cue_faults": lambda s, d: checks.cue_faults(_faulty(s, d)).select("video_id", "pos", "reason"), "cue_first_faults": cue_first_faults, "translation_gaps": translation_gaps, "bilingual_older": bilingual_older,
    "unit_documents": unit_documents,
    "semantic_faults": semantic_faults, "semantic_units": semantic_units,
    "batch_results": batch_results, "batch_translations": translations, "run_counters": run_counters, "answer_checks": answer_checks, "review_overlay": review_checks, "prompt_hashes": prompt_hashes,
    "cache_upsert": cache_upsert, "cache_lookup": cache_lookup, "adaptive_fold": adaptive_fold, "batch_report": batch_report, "report_sections": report_sections, "global_context": global_contexts,
    "chapter_summary": chapters, "vtt_lenient_scan": lenient_vtt, "srt_checks": srt_checks, "scalars": scalars,
}

_TURNS = "WITH c AS (SELECT conv_id AS video_id, (turn + 1)::BIGINT AS cue_index, 'c' || (turn + 1) AS cue_id, text AS source FROM conversations)"
_B = _TURNS + ", b AS (SELECT video_id, (cue_index - 1) // 4 + 1 AS batch_id, count(*) AS n FROM c GROUP BY ALL)"
# by kind of the first cue: attempts, fallback, error, route
_R = _B + """, r AS (SELECT *, (4 * batch_id - 3) // 4 % 5 AS kind FROM b), o AS (SELECT *, CASE WHEN kind = 1 THEN 3 WHEN kind = 2 THEN 4 WHEN kind = 3 AND n > 2 THEN 5 WHEN kind = 4 THEN 2 ELSE 1 END AS attempts,
    (kind = 2)::BIGINT AS fallback_calls, CASE WHEN kind = 1 THEN 'provider_timeout' WHEN kind = 2 THEN 'provider_http_5xx' WHEN kind = 3 AND n > 2 THEN 'schema_mismatch' WHEN kind = 4 THEN 'invalid_json' END AS error_type,
    kind = 3 AND n > 2 AS split FROM r)"""
_CACHE = "k AS (SELECT 'k' || (doc_id % 150) AS cache_key, lang AS target_lang, 'r' || doc_id AS result_json, lpad(doc_id::VARCHAR, 9, '0') AS updated_at FROM documents WHERE doc_id % 3 <> 0), s AS (SELECT cache_key, arg_max(target_lang, updated_at) AS target_lang, arg_max(result_json, updated_at) AS result_json, max(updated_at) AS updated_at FROM k GROUP BY cache_key)"
_LINES = "l AS (SELECT doc_id AS video_id, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS x FROM documents), c0 AS (SELECT video_id, unnest(x) AS source, generate_subscripts(x, 1)::BIGINT AS k FROM l), c AS (SELECT *, (k - 1) * 2500 AS s, (k - 1) * 2500 + 2000 + length(source) % 1000 AS e FROM c0)"
_E = """WITH e AS (SELECT user_id % 20 AS run_id, event_id AS id, event_id % 9 = 0 AS split, event_id % 4 AS attempts, CASE WHEN event_id % 9 = 0 THEN 'shrink' WHEN event_id % 6 = 0 THEN 'fallback' ELSE 'main' END AS route,
    CASE WHEN event_id % 9 = 0 THEN CASE WHEN event_id % 2 = 0 THEN 'schema_mismatch' ELSE 'invalid_json' END END AS why, CASE WHEN event_id % 9 = 0 THEN event_id % 2 + 1 END AS deep, event_id % 11 <> 0 AS ok FROM events),
g AS (SELECT run_id, count(*) AS batch_entries, count(*) FILTER (route = 'fallback') AS fallback_routes, count(*) FILTER (route = 'main') AS main_routes, count(*) FILTER (attempts = 0) AS cache_hit_batches, count(*) FILTER (attempts > 1) AS batches_with_retries,
    count(*) FILTER (split) AS parents_split, 2 * count(*) FILTER (split) AS children_spawned, coalesce(array_to_string(list_sort(list(DISTINCT why)), ','), '') AS split_reasons, max(deep) AS max_split_attempt,
    coalesce(string_agg(id::VARCHAR, ',' ORDER BY id) FILTER (NOT ok), '') AS terminal_ids, sum(greatest(attempts - 1, 0))::BIGINT AS retries,
    sha256(string_agg('- batch_id: ' || id || ' | cue_range: ' || id * 3 || '-' || id * 3 + 2 || ' | status: ' || CASE WHEN ok THEN 'success' ELSE 'failed_permanent' END || ' | attempt: ' || attempts || ' | error_type: ' || CASE WHEN id % 5 = 0 THEN 'invalid_json' ELSE 'none' END
        || ' | cache_hit: ' || CASE WHEN attempts = 0 THEN 'True' ELSE 'False' END || ' | duration_ms: none | final_route_label: ' || route || ' | parent_batch_id: none | child_batch_ids: ' || CASE WHEN split THEN id * 2 || ',' || id * 2 + 1 ELSE 'none' END
        || ' | split_reason: ' || coalesce(why, 'none') || ' | split_attempt: ' || coalesce(deep::VARCHAR, 'none') || ' | split_strategy_version: ' || CASE WHEN split THEN 'v1' ELSE 'none' END || ' | original_target_cue_range: ' || CASE WHEN split THEN '1-2' ELSE 'none' END, chr(10) ORDER BY id)) AS details FROM e GROUP BY run_id)"""
_Q = lambda t: "'" + t.replace("'", "''") + "'"
_HEAD = _Q("\n".join(x.replace("{lang}", "zh-CN").replace("{id}", "cue_id") for x in prompts.TRANSLATE) + "\nGlossary:\n[]\nGlobal Context:\nabout it\nBefore context:\n")
_SHOW = "printf('%02d:%02d:%02d{2}%03d', ({0}) // 3600000, ({0}) // 60000 % 60, ({0}) // 1000 % 60, ({0}) % 1000)"


def _json_list(test: str) -> str:
    return f"""coalesce('[' || chr(10) || string_agg('  {{' || chr(10) || '    "cue_id": "' || cue_id || '",' || chr(10) || '    "source": ' || to_json(source)::VARCHAR || chr(10) || '  }}', ',' || chr(10) ORDER BY cue_index) FILTER ({test}) || chr(10) || ']', '[]')"""


_KEYS = ",".join(
    f'"{k}":' + ("true" if k == "structured_output" else "\"' || h || '\"" if k == "batch_source_hash" else '"zh-CN"' if k == "target_lang" else f'"{k}"') for k in prompts.KEY_FIELDS
)
_SEM = r"""WITH c AS (SELECT conv_id AS video_id, turn + 1 AS cue_index, list_filter(string_split_regex(regexp_replace(text, '<[^>]+>', ' ', 'g'), '\s+'), lambda y: y <> '') AS w, turn * 2500 AS s, turn * 2500 + 2000 + length(text) % 1000 AS e FROM conversations),
t AS (SELECT *, unnest(w) AS x, generate_subscripts(w, 1) - 1 AS i, len(w) AS k FROM c), p AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY cue_index, i) - 1 AS pos, count(*) OVER (PARTITION BY video_id) AS n,
    s + round_even((e - s) * i / k, 0)::BIGINT AS a, s + round_even((e - s) * (i + 1) / k, 0)::BIGINT AS z FROM t) """
_FAULTY = "WITH " + _LINES + r""", f AS (SELECT video_id, k AS pos, CASE WHEN k % 9 = 0 THEN k + 1 ELSE k END AS ix, CASE WHEN k % 17 = 0 THEN ' ' WHEN k % 7 = 0 AND k > 1 THEN (k - 1)::VARCHAR ELSE k::VARCHAR END AS id FROM c),
d AS (SELECT *, trim(id) <> '' AND row_number() OVER (PARTITION BY video_id, id ORDER BY pos) > 1 AS again FROM f),
r AS (SELECT video_id, pos, 1 AS n, 'index' AS reason FROM d WHERE ix <> pos UNION ALL SELECT video_id, pos, 2, 'id' FROM d WHERE trim(id) = '' UNION ALL SELECT video_id, pos, 3, 'duplicate id' FROM d WHERE again
UNION ALL SELECT video_id, pos, 4, 'start' FROM d WHERE pos % 13 = 0 UNION ALL SELECT video_id, pos, 6, 'source' FROM d WHERE pos % 11 = 0) """
_PARTLY = """WITH c AS (SELECT conv_id AS video_id, turn + 1 AS k, text AS source, turn * 2500 AS s, turn * 2500 + 2000 + length(text) % 1000 AS e FROM conversations) """
ORACLE_SQL = {
    "cue_faults": _FAULTY + "SELECT video_id, pos, reason FROM r",
    "cue_first_faults": _FAULTY + "SELECT video_id, arg_min(reason, pos * 10 + n) AS reason, min(pos) AS pos FROM r GROUP BY video_id",
    "translation_gaps": _PARTLY + """SELECT video_id, 'c' || k AS cue_id, CASE WHEN k % 5 = 0 OR k % 7 = 0 THEN 'missing' ELSE 'blank' END AS reason FROM c WHERE k % 5 = 0 OR k % 7 = 0 OR k % 3 = 0 UNION ALL SELECT video_id, 'zc' || k, 'of no cue' FROM c WHERE k % 5 <> 0 AND k % 7 = 0""",
    "bilingual_older": _PARTLY + f"""SELECT video_id, string_agg(k || chr(10) || {_SHOW.replace("{2}", ",").format("s")} || ' --> ' || {_SHOW.replace("{2}", ",").format("e")} || chr(10) || source || chr(10) || CASE WHEN k % 5 = 0 OR k % 7 = 0 THEN '[未翻译]' WHEN k % 3 = 0 THEN ' ' ELSE 't ' || source END || chr(10) || chr(10), '' ORDER BY k) AS srt FROM c GROUP BY video_id""",
    "semantic_faults": _SEM + """, v AS (SELECT DISTINCT video_id, n, video_id % 8 AS f FROM p) SELECT video_id, CASE f WHEN 1 THEN 'parse_error' WHEN 2 THEN CASE WHEN n > 10 THEN 'V10: gap at segment 0/1' WHEN n = 1 THEN 'V5: end_token <= start_token at segment 0' ELSE 'V7: last segment end_token != ' || n END
        WHEN 3 THEN CASE WHEN n > 10 THEN 'V9: overlap at segment 0/1' ELSE 'V11: out_of_range at segment 0' END WHEN 4 THEN 'forbidden_text_fields: [''text'']' WHEN 5 THEN CASE WHEN n = 1 THEN 'V5: end_token <= start_token at segment 0' ELSE 'V6: first segment does not start at 0' END
        WHEN 6 THEN CASE WHEN n % 10 = 1 THEN 'V5: end_token <= start_token at segment ' || (n - 1) // 10 ELSE 'V7: last segment end_token != ' || n END WHEN 7 THEN 'empty_segments' END AS reason FROM v""",
    "semantic_units": _SEM + """, u AS (SELECT video_id, pos // 10 AS b, string_agg(x, ' ' ORDER BY pos) AS source_text, arg_min(a, pos) AS start_ms, arg_max(z, pos) AS end_ms FROM p WHERE video_id % 8 = 0 GROUP BY video_id, pos // 10)
        SELECT video_id, row_number() OVER (PARTITION BY video_id ORDER BY start_ms, end_ms, printf('s%03d', b + 1)) AS nth, printf('s%03d', b + 1) AS unit_id, source_text, start_ms, end_ms FROM u""",
    "batch_results": _R + """ SELECT video_id, batch_id, 'success' AS state, n AS cue_count, attempts::BIGINT AS attempts, attempts::BIGINT AS calls, fallback_calls, CASE WHEN split THEN 2 ELSE attempts - 1 END::BIGINT AS retries, error_type,
        CASE WHEN split THEN 'shrink' WHEN kind = 2 THEN 'fallback' ELSE 'main' END AS route, CASE WHEN split THEN (max(batch_id) OVER w + 1 + 6 * (batch_id - 1)) || ',' || (max(batch_id) OVER w + 2 + 6 * (batch_id - 1)) ELSE '' END AS children,
        CASE WHEN split THEN 1::BIGINT END AS split_attempt FROM o WINDOW w AS (PARTITION BY video_id)""",
    "batch_translations": _TURNS + " SELECT video_id, cue_id, 't' || cue_index AS translation FROM c",
    "run_counters": _R + " SELECT video_id, count(*) AS total_batches, sum(attempts)::BIGINT AS calls, sum(fallback_calls)::BIGINT AS fallback_calls, sum(CASE WHEN split THEN 2 ELSE attempts - 1 END)::BIGINT AS retries, 0::BIGINT AS failed_batches FROM o GROUP BY video_id",
    "answer_checks": _B + """, t AS (SELECT video_id, max(batch_id) AS top FROM b GROUP BY video_id), f AS (SELECT b.*, top, unnest(range(0, 12)) AS k FROM b JOIN t USING (video_id)),
        g AS (SELECT *, CASE k WHEN 2 THEN 'invalid_json' WHEN 3 THEN 'schema_mismatch' WHEN 4 THEN 'schema_mismatch' WHEN 5 THEN 'schema_mismatch' WHEN 6 THEN 'missing_required_cue_id' WHEN 7 THEN CASE WHEN n > 1 THEN 'duplicate_cue_id' END
        WHEN 8 THEN CASE WHEN top > 1 THEN 'context_cue_output_violation' END WHEN 9 THEN 'invalid_cue_id' WHEN 10 THEN 'schema_mismatch' WHEN 11 THEN 'empty_translation' END AS error_type FROM f)
        SELECT video_id, batch_id * 100 + k AS batch_id, error_type IS NULL AS ok, error_type, CASE WHEN error_type IS NULL THEN n ELSE 0 END AS n FROM g""",
    "review_overlay": _TURNS + """, n AS (SELECT video_id, count(*) AS n FROM c GROUP BY video_id), j AS (SELECT c.*, (cue_index - 1) % 3 = 0 AND (video_id % 5 IN (0, 4) OR (video_id % 5 = 2 AND n = 1)) AS is_fixed FROM c JOIN n USING (video_id))
        SELECT video_id, cue_id, CASE WHEN is_fixed THEN 'new ' || cue_id ELSE source END AS translation, is_fixed FROM j""",
    "prompt_hashes": _B + f""", p AS (SELECT b.video_id, batch_id, sha256({_HEAD} || {_json_list("cue_index BETWEEN batch_id * 4 - 5 AND batch_id * 4 - 4")} || chr(10) || 'Current cues to translate:' || chr(10) || {_json_list("cue_index BETWEEN batch_id * 4 - 3 AND batch_id * 4")}
        || chr(10) || 'After context:' || chr(10) || {_json_list("cue_index BETWEEN batch_id * 4 + 1 AND batch_id * 4 + 2")}) AS h FROM b JOIN c USING (video_id) GROUP BY b.video_id, batch_id)
        SELECT video_id, batch_id, h AS batch_source_hash, sha256('{{{_KEYS}}}') AS cache_key FROM p""",
    "cache_upsert": "WITH " + _CACHE + " SELECT cache_key, '' AS engine_version, 0 AS structured_output, target_lang, result_json, updated_at FROM s",
    "cache_lookup": "WITH " + _CACHE + " SELECT 'k' || i AS cache_key, result_json AS response, result_json IS NOT NULL AS is_hit FROM range(0, 200) r(i) LEFT JOIN s ON s.cache_key = 'k' || i",
    "adaptive_fold": """WITH RECURSIVE e AS (SELECT user_id % 50 AS run_id, event_id AS pos, event_id % 7 > 1 AS ok, row_number() OVER (PARTITION BY user_id % 50 ORDER BY event_id) AS i FROM events),
        f AS (SELECT DISTINCT run_id, 0::BIGINT AS i, NULL::BIGINT AS pos, 4::BIGINT AS at_once, 0::BIGINT AS change, 0::BIGINT AS streak FROM e UNION ALL
        SELECT e.run_id, e.i, e.pos, CASE WHEN NOT ok THEN greatest(1, at_once - 1) WHEN streak >= 1 AND at_once < 4 THEN at_once + 1 ELSE at_once END,
        CASE WHEN NOT ok THEN greatest(1, at_once - 1) - at_once WHEN streak >= 1 AND at_once < 4 THEN 1 ELSE 0 END, CASE WHEN NOT ok OR (streak >= 1 AND at_once < 4) THEN 0 ELSE streak + 1 END FROM f JOIN e ON e.run_id = f.run_id AND e.i = f.i + 1)
        SELECT run_id, pos, at_once, change FROM f WHERE i > 0""",
    "batch_report": _E + " SELECT * FROM g",
    "report_sections": _E + f""" SELECT run_id, '- parent_batches_split: ' || parents_split || chr(10) || '- child_batches_spawned: ' || children_spawned || chr(10) || '- split_reasons: ' || coalesce(nullif(split_reasons, ''), 'none') || chr(10) || '- max_split_attempt: ' || coalesce(max_split_attempt::VARCHAR, 'none') AS shrink,
        '- batch_entries: ' || batch_entries || chr(10) || '- batches_with_fallback_final_route: ' || fallback_routes || chr(10) || '- batches_with_main_final_route: ' || main_routes || chr(10) || '- cache_hit_batches: ' || cache_hit_batches || chr(10) || '- batches_with_retries: ' || batches_with_retries AS batches,
        '- final_status: ' || CASE WHEN run_id % 3 = 0 THEN 'success' ELSE 'completed_with_failures' END || chr(10) || '- failed_batches: ' || run_id % 3 || chr(10) || '- terminal_batch_ids: ' || coalesce(nullif(terminal_ids, ''), 'none') AS terminal,
        coalesce(nullif(array_to_string(list_filter([CASE WHEN run_id % 2 > 0 THEN {_Q(reports.WARNINGS[0])} END, CASE WHEN fallback_routes > 0 THEN {_Q(reports.WARNINGS[1])} END, CASE WHEN parents_split > 0 THEN {_Q(reports.WARNINGS[2])} END, CASE WHEN run_id % 3 > 0 THEN {_Q(reports.WARNINGS[3])} END], lambda x: x IS NOT NULL), chr(10)), ''), '- none') AS warned FROM g""",
    "global_context": "WITH " + _LINES + """, n AS (SELECT *, count(*) OVER (PARTITION BY video_id) AS n, '- [' || k || '] ' || source AS y FROM c)
        SELECT video_id, sha256('# Translation Global Context' || chr(10) || chr(10) || '## Metadata' || chr(10) || '- input_filename: d' || video_id || '.srt' || chr(10) || '- cue_count: ' || any_value(n) || chr(10) || '- target_lang: zh-CN' || chr(10) || '- mode: balanced' || chr(10) || '- batch_size: 80'
        || chr(10) || chr(10) || '## Front Samples' || chr(10) || string_agg(y, chr(10) ORDER BY k) FILTER (k <= 5) || chr(10) || chr(10) || '## Middle Samples' || chr(10) || string_agg(y, chr(10) ORDER BY k) FILTER (k > greatest((n - 5) // 2, 0) AND k <= greatest((n - 5) // 2, 0) + 5)
        || chr(10) || chr(10) || '## Tail Samples' || chr(10) || string_agg(y, chr(10) ORDER BY k) FILTER (k > n - 5) || chr(10)) AS hash FROM n GROUP BY video_id""",
    "chapter_summary": """WITH d AS (SELECT *, CASE WHEN doc_id % 5 > 0 THEN list_filter([CASE WHEN doc_id % 2 = 0 THEN lang END, CASE WHEN doc_id % 3 = 0 THEN source END], lambda x: x IS NOT NULL) ELSE [] END AS w FROM documents)
        SELECT doc_id, '# ' || CASE WHEN doc_id % 4 > 0 THEN lang ELSE '未命名章节' END || replace('||## 章节信息||- 时间范围: 00:00 - 03:00|- 核心摘要: N/A|- 关键词: ', '|', chr(10)) || array_to_string(w, ', ')
        || replace('||## 核心观点||[待生成]||## 适合平台||### 小红书版本||[待生成]||### 抖音版本||[待生成]||### 微信公众号版本||[待生成]||## 标签||', '|', chr(10)) || array_to_string(list_transform(w, lambda x: '#' || x), ' ') || replace('||---||生成时间: N/A|', '|', chr(10)) AS page FROM d""",
    "vtt_lenient_scan": "WITH " + _LINES + r""" SELECT video_id, s AS start_ms, e AS end_ms, text FROM (SELECT *, CASE WHEN k % 5 = 0 THEN '' ELSE 'x' END || regexp_replace(regexp_replace(source, '[<>]|-->|STYLE', '', 'g'), '^\s+|\s+$', '', 'g') AS text FROM c) WHERE k % 13 <> 0 AND k % 11 <> 0 AND text <> '' AND NOT regexp_full_match(text, '\p{Nd}+')""",
    "srt_checks": "WITH " + _LINES + """, m AS (SELECT *, k % 11 <> 0 AND NOT (k % 6 = 0 AND k % 5 <> 0) AS ok, CASE WHEN k % 5 = 0 THEN e ELSE s END AS a, CASE WHEN k % 5 = 0 THEN s ELSE e END AS z FROM c),
        q AS (SELECT *, last_value(CASE WHEN ok THEN z END IGNORE NULLS) OVER (PARTITION BY video_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM m)
        SELECT video_id, k - 1 AS pos, 'too few lines' AS reason FROM q WHERE k % 11 = 0 UNION ALL SELECT video_id, k - 1, 'wrong number' FROM q WHERE k % 7 = 0 AND k % 11 <> 0 AND k <> 9999
        UNION ALL SELECT video_id, k - 1, 'no time' FROM q WHERE k % 11 <> 0 AND k % 6 = 0 AND k % 5 <> 0 UNION ALL SELECT video_id, k - 1, 'ends before it starts' FROM q WHERE ok AND a >= z UNION ALL SELECT video_id, k - 1, 'starts before the last end' FROM q WHERE ok AND a < p""",
    "scalars": f"""SELECT o_orderkey, o_orderkey % 3 < 2 AS is_video, 'fail http://<redacted-proxy>@h/x' || o_orderkey || ' and <redacted-userinfo>@h2' AS message, CASE WHEN o_orderkey % 2 = 0 THEN 'you_tube' ELSE 'video' END || '_' || o_orderkey AS folder,
        'a_b_c.' || o_orderkey AS part, CASE WHEN o_orderkey % 10 > 0 THEN '[' || repeat('#', (30 * (o_orderkey % 100) // 100)::INT) || repeat('-', 30 - (30 * (o_orderkey % 100) // 100)::INT) || '] ' || (o_orderkey % 100) || '.0%' END AS bar,
        'a_b_c_' || o_orderkey || '_.mp4' AS file, ((o_orderkey % 50) * 60000 + (o_orderkey % 60) * 1000 + 500)::BIGINT AS ms, {_SHOW.replace("{2}", ",").format("o_orderkey * 977")} AS shown, o_orderkey % 2 = 0 AS is_provider FROM orders""",
}
