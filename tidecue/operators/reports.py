"""Reports of a run: counts as aggregates, and one text for each run or video. Lines and their order are fixed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidecue.functions.timecode import format_ms

# Versions, names of files and the keys of each section, in order.
REPORT_VERSION = "translation-v2-report-v2"
SEGMENTATION_VERSION = "segmentation.v1"
STRATEGY, TIMING = "cycle1-rules-v1", "cycle1-timing-v1"
ARTIFACTS = {"segmentation_report": "segmentation_report.md", "translation_units": "translation_units.json", "cue_map": "cue_map.json", "segmented_source": "segmented_source.srt"}
SETTINGS = (
    "target_lang", "model", "review_model", "effective_review_model", "base_url", "mode", "batch_size", "context_before", "context_after", "temperature", "max_retries",
    "glossary_path", "qa_mode", "engine_version", "structured_output", "failure_mode", "main_model_alias", "repair_model_alias", "fallback_model_alias", "fallback_model",
    "batch_max_chars", "batch_max_cues", "output_schema_version", "batching_strategy_version", "glossary_hash", "context_hash",
)
WARNINGS = (
    "- QA failures occurred but translation-stage output was preserved.",
    "- Fallback route used for one or more batches.",
    "- Shrink-batch compensation activated for one or more parent batches.",
    "- One or more batches terminated with failure metadata in report.",
)


def shown(value: Column) -> Column:
    """A value as text; none if there is none."""
    return F.coalesce(value.cast("string"), F.lit("none"))


def _truth(value: Column) -> Column:
    return F.when(value, "True").otherwise("False")


def batch_line(entry: Column) -> Column:
    """One line on a batch: all it is known by, with none for what isn't known."""
    e = lambda name: entry[name]
    span = lambda r: F.when(r.isNull(), "none").otherwise(F.concat_ws("-", r["lo"].cast("string"), r["hi"].cast("string")))
    children = F.when(F.coalesce(F.size(e("child_batch_ids")), F.lit(0)) > 0, F.array_join(e("child_batch_ids").cast("array<string>"), ",")).otherwise("none")
    parts = {
        "batch_id": e("batch_id").cast("string"), "cue_range": span(e("cue_range")), "status": e("state"), "attempt": F.coalesce(e("attempt"), e("attempts")).cast("string"),
        "error_type": shown(e("error_type")), "cache_hit": _truth(e("cache_hit")), "duration_ms": shown(e("duration_ms")), "final_route_label": F.coalesce(F.nullif(e("route"), F.lit("")), F.lit("none")),
        "parent_batch_id": shown(e("parent_batch_id")), "child_batch_ids": children, "split_reason": F.coalesce(F.nullif(e("split_reason"), F.lit("")), F.lit("none")),
        "split_attempt": shown(e("split_attempt")), "split_strategy_version": F.coalesce(F.nullif(e("split_strategy_version"), F.lit("")), F.lit("none")), "original_target_cue_range": span(e("original_range")),
    }
    return F.concat(F.lit("- "), F.concat_ws(" | ", *[F.concat(F.lit(f"{k}: "), v) for k, v in parts.items()]))


def batch_summary(entries: DataFrame) -> DataFrame:
    """The counts over a run's batches (run_id and the fields of ``batch_line``), in one aggregation."""
    split = (F.coalesce(F.size("child_batch_ids"), F.lit(0)) > 0) | F.col("split_reason").isNotNull()
    count = lambda test: F.count_if(test).cast("long")
    return entries.groupBy("run_id").agg(
        F.count("*").alias("batch_entries"), count(F.col("route") == "fallback").alias("fallback_routes"), count(F.col("route") == "main").alias("main_routes"),
        count(F.col("cache_hit")).alias("cache_hit_batches"), count(F.col("attempts") > 1).alias("batches_with_retries"), count(split).alias("parents_split"),
        F.sum(F.greatest(F.coalesce(F.size("child_batch_ids"), F.lit(0)), F.lit(0)).cast("long")).alias("children_spawned"),
        F.array_join(F.array_sort(F.collect_set(F.nullif("split_reason", F.lit("")))), ",").alias("split_reasons"), F.max("split_attempt").alias("max_split_attempt"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("state") != "success", F.struct("pos", "batch_id")))), lambda x: x.batch_id.cast("string")), ",").alias("terminal_ids"),
        F.sum(F.greatest(F.col("attempts") - 1, F.lit(0))).cast("long").alias("retries"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", batch_line(F.struct("*")).alias("line")))), lambda x: x.line), "\n").alias("details"),
    )


def _lines(**values: Column) -> Column:
    return F.concat_ws("\n", *[F.concat(F.lit(f"- {k}: "), v) for k, v in values.items()])


def _none(text: Column) -> Column:
    return F.coalesce(F.nullif(text, F.lit("")), F.lit("- none"))


def _or_none(text: Column) -> Column:
    return F.coalesce(F.nullif(text, F.lit("")), F.lit("none"))


def shrink_section(s: DataFrame | None = None) -> Column:
    return _lines(parent_batches_split=F.col("parents_split").cast("string"), child_batches_spawned=F.col("children_spawned").cast("string"), split_reasons=_or_none(F.col("split_reasons")), max_split_attempt=shown(F.col("max_split_attempt")))


def batch_section() -> Column:
    return _lines(
        batch_entries=F.col("batch_entries").cast("string"), batches_with_fallback_final_route=F.col("fallback_routes").cast("string"), batches_with_main_final_route=F.col("main_routes").cast("string"),
        cache_hit_batches=F.col("cache_hit_batches").cast("string"), batches_with_retries=F.col("batches_with_retries").cast("string"),
    )


def terminal_section() -> Column:
    status = F.when(F.col("failed_batches") == 0, "success").otherwise("completed_with_failures")
    return _lines(final_status=status, failed_batches=F.col("failed_batches").cast("string"), terminal_batch_ids=_or_none(F.col("terminal_ids")))


def warning_section() -> Column:
    tests = [F.col("qa_failed") > 0, (F.col("fallback_provider_calls") > 0) | (F.col("fallback_routes") > 0), F.col("parents_split") > 0, F.col("failed_batches") > 0]
    said = F.filter(F.array(*[F.when(t, F.lit(w)) for t, w in zip(tests, WARNINGS, strict=True)]), lambda x: x.isNotNull())
    return _none(F.array_join(said, "\n"))


QA_FIELDS = ("qa_mode", "qa_candidates", "qa_reviewed", "qa_provider_calls", "qa_fixed", "qa_kept", "qa_failed", "qa_parser_failures", "qa_provider_failures", "qa_skipped", "qa_prompt_version")


def qa_counts(issues: DataFrame, reviews: DataFrame, *, mode: str = "suspicious-only", version: str = "translation-v2-suspicious-qa-v2") -> DataFrame:
    """The counts of a review by run: ``issues`` (run_id, cue_id), ``reviews`` (run_id, ok, n_fixed; ok null if the call failed)."""
    candidates = issues.groupBy("run_id").agg(F.count_distinct("cue_id").alias("n"))
    both = candidates.join(reviews, "run_id", "left").withColumn("n_fixed", F.when(F.col("ok"), F.col("n_fixed")).otherwise(0))
    ok = F.coalesce("ok", F.lit(False))
    count = lambda c: c.cast("long")
    return both.select(
        "run_id", F.lit(mode).alias("qa_mode"), F.col("n").alias("qa_candidates"), F.col("n").alias("qa_reviewed"), F.lit(1).cast("long").alias("qa_provider_calls"), count(F.col("n_fixed")).alias("qa_fixed"),
        count(F.when(ok, F.col("n") - F.col("n_fixed")).otherwise(0)).alias("qa_kept"), count((~ok).cast("int")).alias("qa_failed"), count((F.col("ok") == F.lit(False)).cast("int")).alias("qa_parser_failures"),
        count(F.col("ok").isNull().cast("int")).alias("qa_provider_failures"), count(F.when(ok, 0).otherwise(F.col("n"))).alias("qa_skipped"), F.lit(version).alias("qa_prompt_version"),
    ).withColumn("qa_parser_failures", F.coalesce("qa_parser_failures", F.lit(0).cast("long")))


def qa_section() -> Column:
    return _lines(**{f: F.col(f).cast("string") for f in QA_FIELDS})


def issue_lines(issues: DataFrame) -> DataFrame:
    """run_id and a line for each issue (run_id, pos, cue_id, severity, reason) in order."""
    line = F.concat(F.lit("- "), F.concat_ws(" | ", "cue_id", "severity", "reason"))
    return issues.groupBy("run_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", line.alias("line")))), lambda x: x.line), "\n").alias("issue_lines"))


def run_report(runs: DataFrame) -> Column:
    """The whole report of a run from one row of ``runs``: the counts of ``batch_summary`` and ``qa_counts``, issue_lines, a struct
    ``settings`` (SETTINGS and cache_enabled, cache_path, provider, concurrency fields), ``run`` (paths, formats, counts) and ``outputs``."""
    s, r, o = (lambda k: F.col(f"settings.{k}")), (lambda k: F.col(f"run.{k}")), (lambda k: F.col(f"outputs.{k}"))
    text = lambda c: F.coalesce(c.cast("string"), F.lit("None"))
    status = F.when(F.col("failed_batches") == 0, "success").otherwise("completed_with_failures")
    own = lambda *names: {n: F.col(n).cast("string") for n in names}
    names = lambda *keys: {k: text(s(k)) for k in keys}
    concurrency = ("adaptive_concurrency_max", "adaptive_concurrency_initial", "adaptive_concurrency_low_watermark", "adaptive_concurrency_high_watermark")
    sections = {
        "Run Summary": _lines(**{k: text(r(k)) for k in ("input_path", "input_format", "output_format", "cue_count", "dry_run", "provider_called")}, **own("total_batches", "provider_calls", "cache_hits", "cache_misses", "retries", "failed_batches"), final_status=status),
        "Config Snapshot": _lines(**names(*SETTINGS)),
        "Cache Summary": _lines(**names("cache_enabled", "cache_path"), **own("cache_hits", "cache_misses"), cache_scope=F.lit("translation-stage only")),
        "Provider / Fallback Summary": _lines(**names("provider", "model", "effective_review_model"), **own("provider_calls", "fallback_provider_calls"), **names("main_model_alias", "repair_model_alias", "fallback_model_alias")),
        "Concurrency Summary": _lines(
            **names("concurrency", "adaptive_concurrency_enabled", "adaptive_concurrency_min"), **{k: shown(s(k)) for k in concurrency},
            **names("adaptive_concurrency_increase_events", "adaptive_concurrency_decrease_events", "adaptive_concurrency_pressure_events", "engine_version", "structured_output"),
        ),
        "Shrink-Batch Summary": shrink_section(), "QA Summary": qa_section(), "QA": qa_section(), "QA Issues": _none(F.col("issue_lines")), "Batch Summary": batch_section(),
        "Batch Details": _none(F.col("details")), "Batch Results": _none(F.col("details")), "Terminal / Failure Summary": terminal_section(), "Warnings": warning_section(),
        "Output Artifacts": _lines(**{k: text(o(k)) for k in ("output_dir", "translated_srt", "bilingual_srt", "translation_report", "global_context", "glossary_truncated")}),
    }
    head = F.lit(f"# Translation Report\n\n- report_schema_version: {REPORT_VERSION}")
    return F.concat(head, *[F.concat(F.lit(f"\n\n## {title}\n"), body) for title, body in sections.items()], F.lit("\n"))


def segmentation_report(stats: DataFrame, warnings: DataFrame, *, mode: str, input_format: str) -> DataFrame:
    """video_id and the report on its units: ``stats`` of ``units.stats`` with original_cues, warnings in the order of phases."""
    lines = warnings.select("video_id", F.struct("phase", "at", "n", F.concat(F.lit("- "), F.col("code"), F.lit(": "), F.col("message")).alias("line")).alias("w"))
    lines = lines.groupBy("video_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("w")), lambda x: x.line), "\n").alias("warned"))
    c = lambda name: F.col(name).cast("string")
    summary = _lines(mode=F.lit(mode), input_format=F.lit(input_format), original_cue_count=c("original_cues"), extracted_cue_count=c("extracted_cues"), active_token_count=c("active_tokens"), translation_unit_count=c("units"))
    timing = _lines(inline_timing_token_count=c("inline_tokens"), proportional_timing_token_count=c("proportional_tokens"), unknown_timing_token_count=F.lit("0"))
    cleanup = _lines(removed_duplicate_cue_count=c("removed_duplicate_cues"), removed_duplicate_token_count=c("removed_duplicate_tokens"), removed_rolling_overlap_token_count=c("removed_overlap_tokens"))
    parts = ["# Segmentation Report\n\n## Summary\n", summary, "\n\n## Detection / timing\n", timing, "\n\n## Cleanup stats\n", cleanup, "\n\n## Validation\n- fatal_errors: none\n\n## Warnings\n", _none(F.col("warned"))]
    text = F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts], F.lit("\n\n## Coverage domain note\n- coverage is based on cleaned active token stream, not raw removed tokens."))
    return stats.join(lines, "video_id", "left").select("video_id", text.alias("report"))


def unit_payload(made: DataFrame, of_spans: DataFrame) -> DataFrame:
    """video_id, unit_no, unit_id and each unit as a struct whose JSON is its entry in the artifacts."""
    span = F.struct("start", "end", F.col("cue_index").cast("string").alias("cue_id"), "cue_token_start", "cue_token_end")
    lists = of_spans.groupBy("video_id", "unit_pos").agg(F.array_sort(F.collect_list(span)).alias("source_spans"))
    unit = F.struct(
        "unit_id", "source_text", "start_ms", "end_ms", format_ms(F.col("start_ms")).alias("start"), format_ms(F.col("end_ms")).alias("end"), "source_spans",
        F.col("source_cues").cast("array<string>").alias("source_cue_ids"), "boundary_type", "is_padding_only", "crosses_clip_start", "crosses_clip_end", "intersects_clip",
    )
    return made.join(lists, ["video_id", "unit_pos"]).select("video_id", "unit_no", "unit_id", unit.alias("unit"))


def unit_documents(payload: DataFrame, *, mode: str, input_format: str) -> DataFrame:
    """video_id, units_json (a list in order) and cue_map_json (by unit id)."""
    head = {"schema_version": SEGMENTATION_VERSION, "segmentation_strategy_version": STRATEGY, "timing_strategy_version": TIMING, "mode": mode}
    lists = payload.groupBy("video_id").agg(F.array_sort(F.collect_list(F.struct("unit_no", "unit_id", "unit"))).alias("u"))
    fixed = [F.lit(v).alias(k) for k, v in head.items()]
    listed = F.to_json(F.struct(*fixed, F.lit(input_format).alias("input_format"), F.transform("u", lambda x: x.unit).alias("units")))
    mapped = F.to_json(F.struct(*fixed, F.map_from_entries(F.transform("u", lambda x: F.struct(x.unit_id, x.unit))).alias("units")))
    return lists.select("video_id", listed.alias("units_json"), mapped.alias("cue_map_json"))


def global_context(cues: DataFrame, sampled: DataFrame, *, settings: dict[str, object], name: Column) -> DataFrame:
    """video_id, context and its hash: metadata and the samples of ``captions.samples`` joined with their texts."""
    line = F.concat(F.lit("- ["), F.col("cue_index").cast("string"), F.lit("] "), F.col("source"))
    of = lambda section: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("section") == section, F.struct("cue_index", line.alias("line"))))), lambda x: x.line), "\n").alias(section)
    texts = sampled.join(cues.select("video_id", "cue_index", "source"), ["video_id", "cue_index"]).groupBy("video_id").agg(of("front"), of("middle"), of("tail"))
    counts = cues.groupBy("video_id").agg(F.count("*").alias("n"))
    meta = F.concat(F.lit("# Translation Global Context\n\n## Metadata\n- input_filename: "), name, F.lit("\n- cue_count: "), F.col("n").cast("string"), *[F.lit(f"\n- {k}: {v}") for k, v in settings.items()])
    text = F.concat(meta, *[F.concat(F.lit(f"\n\n## {t} Samples\n"), _none(F.col(c))) for t, c in (("Front", "front"), ("Middle", "middle"), ("Tail", "tail"))], F.lit("\n"))
    return counts.join(texts, "video_id", "left").select("video_id", text.alias("context"), F.sha2(text, 256).alias("hash"))


def chapter_summary(title: Column, time_range: Column, summary: Column, keywords: Column, generated_at: Column, *, hint: str = "[待生成]") -> Column:
    """The summary page of a chapter; what is missing has a fixed stand-in, and ``hint`` stands where the points are to be written."""
    known = F.coalesce(keywords, F.array().cast("array<string>"))
    tags = F.array_join(F.transform(known, lambda k: F.concat(F.lit("#"), k)), " ")
    # Fixed texts of the page.
    return F.concat(
        F.lit("# "), F.coalesce(title, F.lit("未命名章节")), F.lit("\n\n## 章节信息\n\n- 时间范围: "), F.coalesce(time_range, F.lit("N/A")), F.lit("\n- 核心摘要: "), F.coalesce(summary, F.lit("N/A")),
        F.lit("\n- 关键词: "), F.array_join(known, ", "),
        F.lit("\n\n## 核心观点\n\n" + hint + "\n\n## 适合平台\n\n### 小红书版本\n\n[待生成]\n\n### 抖音版本\n\n[待生成]\n\n### 微信公众号版本\n\n[待生成]\n\n## 标签\n\n"),
        tags, F.lit("\n\n---\n\n生成时间: "), F.coalesce(generated_at, F.lit("N/A")), F.lit("\n"),
    )
