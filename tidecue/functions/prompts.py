"""Prompts for the external text function, and keys of their answers, as expressions: one string for each batch."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidecue.functions.text import stripped

# Versions, and the lines of a prompt, whose hash is part of a cached answer's key. {id} is id or cue_id.
PROMPT_VERSION = "translation-v2-json-cue-v2"
REVIEW_VERSION = "translation-v2-suspicious-qa-v2"
TRANSLATE = (
    "Translate current subtitle cues into {lang}.",
    "Technical subtitles: prioritize accuracy, then natural concise wording.",
    "only return JSON. do not return Markdown or explanations.",
    "Return a JSON array whose item count must equal the number of cues.",
    "Each item must have {id} and translation fields.",
    "{id} must match exactly. translation must not be empty.",
    "preserve code, commands, variable names, paths, URLs, and library names.",
    "Each output item must translate only that item's source cue text.",
    "Do not move source content between {id}s.",
    "Do not translate adjacent cue content into the current cue.",
    "If a source cue is a fragment, preserve it as a fragment; do not complete it with neighboring cues.",
    "Do not make the translation more complete by borrowing from neighboring cues.",
    "Follow the glossary consistently when translating current cues.",
    "Global context is only for disambiguation, not a content source; do not translate global context or output it.",
    "Before/after context is only for disambiguation, not a content source; do not translate context or include context ids in output.",
    "Expected JSON shape:",
    '[{"{id}": "1", "translation": "..."}]',
)
REVIEW = (
    "Review only suspicious subtitle translations for {lang}.",
    "Only fix obvious errors; otherwise keep the existing translation.",
    "only return JSON. do not return Markdown or explanations.",
    "Return a JSON array with exactly one item for each candidate.",
    "do not add, delete, or reorder ids. id must match exactly.",
    'Each item shape: {"id": "...", "action": "keep" | "fix", "translation": "...", "reason": "..."}.',
    "translation required for both keep and fix. translation must not be empty.",
    "reason required and brief.",
    "preserve numbers, units, URLs, paths, commands, code, variable names, and library names.",
    "Follow the glossary consistently when fixing translations.",
    "Global context is only for understanding; do not translate global context; do not output global context.",
)
KEY_FIELDS = (
    "base_url", "batch_source_hash", "batching_strategy_version", "context_hash", "engine_version", "glossary_hash", "main_model_alias",
    "model", "output_schema_version", "prompt_version", "provider", "structured_output", "target_lang",
)


def section(text: Column) -> Column:
    """A free text of a prompt, or [] if it is blank."""
    return F.coalesce(F.nullif(stripped(text), F.lit("")), F.lit("[]"))


def quoted(text: Column) -> Column:
    """A JSON string; characters beyond ASCII stay."""
    json = F.to_json(F.struct(F.coalesce(text, F.lit("")).alias("v")))
    return F.substring(json, F.lit(6), F.length(json) - 6)


def quoted_ascii(text: Column) -> Column:
    """A JSON string in which characters beyond ASCII are escaped, those beyond 16 bits as a pair."""
    escape = lambda c: F.regexp_replace(F.lower(F.hex(F.encode(c, "UTF-16BE"))), "(.{4})", r"\\u$1")
    letters = F.transform(F.split(quoted(text), ""), lambda c: F.when(c.rlike(r"[^\x00-\x7f]"), escape(c)).otherwise(c))
    return F.when(text.rlike(r"[^\x00-\x7f]"), F.array_join(letters, "")).otherwise(quoted(text))


def listed(cues: Column, key: str = "id") -> Column:
    """An array of (cue_id, source) as indented JSON; [] if it is empty."""
    one = lambda c: F.concat(F.lit(f'  {{\n    "{key}": '), quoted(c["cue_id"]), F.lit(',\n    "source": '), quoted(c["source"]), F.lit("\n  }"))
    return F.when(F.size(cues) > 0, F.concat(F.lit("[\n"), F.array_join(F.transform(cues, one), ",\n"), F.lit("\n]"))).otherwise("[]")


def translate_prompt(before: Column, target: Column, after: Column, *, lang: str, glossary: Column, context: Column, key: str = "id") -> Column:
    """The prompt of a batch; each of ``before``, ``target``, ``after`` is an array of (cue_id, source)."""
    head = "\n".join(x.replace("{lang}", lang).replace("{id}", key) for x in TRANSLATE)
    parts = [F.lit(head + "\nGlossary:"), section(glossary), F.lit("Global Context:"), section(context), F.lit("Before context:"), listed(before, key)]
    return F.concat_ws("\n", *parts, F.lit("Current cues to translate:"), listed(target, key), F.lit("After context:"), listed(after, key))


def review_prompt(candidates: Column, *, lang: str, glossary: Column, context: Column) -> Column:
    """The prompt for an array of (id, source, translation, issues), issues being (severity, reason)."""
    issue = lambda i: F.concat(F.lit('      {\n        "severity": '), quoted(i["severity"]), F.lit(',\n        "reason": '), quoted(i["reason"]), F.lit("\n      }"))
    one = lambda c: F.concat(
        F.lit('  {\n    "id": '), quoted(c["cue_id"]), F.lit(',\n    "source": '), quoted(c["source"]), F.lit(',\n    "translation": '), quoted(c["translation"]),
        F.lit(',\n    "issues": [\n'), F.array_join(F.transform(c["issues"], issue), ",\n"), F.lit("\n    ]\n  }"),
    )
    body = F.when(F.size(candidates) > 0, F.concat(F.lit("[\n"), F.array_join(F.transform(candidates, one), ",\n"), F.lit("\n]"))).otherwise("[]")
    head = "\n".join(x.replace("{lang}", lang) for x in REVIEW)
    return F.concat_ws("\n", F.lit(head + "\nGlossary:"), section(glossary), F.lit("Global Context:"), section(context), F.lit("Suspicious candidates:"), body)


def cache_key(fields: dict[str, Column]) -> Column:
    """The key of an answer: the hash of all its fields as compact JSON in the order of their names."""
    if set(fields) != set(KEY_FIELDS):
        raise ValueError("a key has exactly the fields of KEY_FIELDS")
    value = lambda name: fields[name].cast("string") if name == "structured_output" else quoted_ascii(fields[name])
    parts = [F.concat(F.lit(f'"{name}":'), value(name)) for name in KEY_FIELDS]
    return F.sha2(F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}")), 256)
